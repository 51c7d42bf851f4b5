"""Empirical-Bayes host reputation over labelled pages: suffix, registered domain, host.

Each level's good rate is shrunk towards its parent's with a beta prior.  The prior's strength is
estimated for the level from the data (moments of the beta-binomial: how much more children vary than
their counts explain).  A page stays if the lower bound of its host's posterior good rate is high enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import checkpoint

MIN_BOUND, Z = 0.5, 1.645
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
#: Rules of a suffix file, at most; the public list has some ten thousand.
MOST_RULES = 100_000


@dataclass(frozen=True)
class Suffixes:
    """Names under which others are registered, beside all single labels: ``co.uk``, ``*.ck`` (any label), ``!www.ck`` (not this one)."""

    names: frozenset[str]
    wild: frozenset[str] = frozenset()
    not_these: frozenset[str] = frozenset()

    @staticmethod
    def of(lines: list[str]) -> Suffixes:
        """Rules in the format of the public suffix list; comments and blank lines are skipped."""
        rules = [w[0].lower().rstrip(".") for line in lines if (w := line.split()) and not w[0].startswith("//")]
        rules = [r if r.isascii() else ".".join(x.encode("idna").decode() for x in r.split(".")) for r in rules]
        return Suffixes(frozenset(r for r in rules if "." in r and r[0] not in "*!"), frozenset(r[2:] for r in rules if r.startswith("*.")), frozenset(r[1:] for r in rules if r.startswith("!")))

    def labels(self) -> int:
        """The most labels that a suffix may have."""
        return max([1, *(n.count(".") + 1 for n in self.names), *(n.count(".") + 2 for n in self.wild)])


#: Without a suffix file: the registries that most names are under.  Others count as single labels.
DEFAULT = Suffixes.of("co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au edu.au gov.au co.nz org.nz co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr co.in net.in org.in com.br net.br org.br com.mx org.mx gob.mx com.ar com.co com.pe com.tr org.tr com.cn net.cn org.cn gov.cn edu.cn com.tw org.tw com.hk com.sg com.my com.vn co.id co.th co.za org.za co.ke co.il org.il com.ua com.pl github.io gitlab.io blogspot.com".split())


def read_suffixes(spark: SparkSession, path: str) -> Suffixes:
    """The rules of a public suffix list; raises beyond ``MOST_RULES``, as they become part of the plan."""
    lines = [r[0] for r in spark.read.text(path).where("trim(value) <> '' and not startswith(value, '//')").limit(MOST_RULES + 1).collect()]
    if len(lines) > MOST_RULES:
        raise ValueError(f"{path} has more than {MOST_RULES} rules")
    return Suffixes.of(lines)


def _suffix(host: Column, suffixes: Suffixes) -> Column:
    """The longest rule that fits, or the last label."""
    out = F.substring_index(host, ".", -1)
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    for n in range(2, suffixes.labels() + 1):
        end = F.substring_index(host, ".", -n)
        fits = end.isin(sorted(x for x in suffixes.names if x.count(".") == n - 1)) if suffixes.names else F.lit(False)
        if wild := sorted(x for x in suffixes.wild if x.count(".") == n - 2):
            fits = fits | F.substring_index(host, ".", 1 - n).isin(wild)
        if shorter := sorted(x for x in suffixes.not_these if x.count(".") == n - 1):
            fits = fits & ~end.isin(shorter)
        out = F.when((dots >= n - 1) & fits, end).otherwise(out)
    return out


def named(pages: DataFrame, suffixes: Suffixes = DEFAULT) -> DataFrame:
    """page_id, host, domain, suffix of each page."""
    host = F.rtrim(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)), F.lit("."))
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"))
    number = F.col("host").rlike(r"^[0-9.]+$")
    out = out.withColumn("suffix", F.when(number, F.col("host")).otherwise(_suffix(F.col("host"), suffixes)))
    own = F.expr("regexp_extract(substring(host, 1, greatest(length(host) - length(suffix) - 1, 0)), '([^.]*)$', 1)")
    return out.withColumn("domain", F.when(own == "", F.col("host")).otherwise(F.concat(own, F.lit("."), F.col("suffix"))))


def _level(counts: DataFrame, parent_mean: Column) -> DataFrame:
    """``counts`` (n, good, parent_mean) with the posterior's alpha and beta; the level's strength is one number, read here."""
    spread = parent_mean * (1 - parent_mean)
    chi = F.sum((F.col("good") - F.col("n") * parent_mean) ** 2 / spread)
    total, twice = F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1))
    rho = F.coalesce((chi - total) / F.nullif(twice, F.lit(0)), F.lit(0.0))
    strength = counts.agg((1 / F.greatest(F.lit(1e-4), F.least(F.lit(0.999), rho)) - 1).alias("s")).first()["s"]
    good, bad = F.col("good") + F.lit(strength) * parent_mean, F.col("n") - F.col("good") + F.lit(strength) * (1 - parent_mean)
    return counts.withColumns({"alpha": good, "beta": bad}).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def reputation(names: DataFrame, labels: DataFrame) -> DataFrame:
    """suffix, domain, host, n, good, alpha, beta: each host's labelled pages and posterior, from ``named`` pages.

    A page counts as good if its label (labels.doc_id = page_id) says quality 1 and not toxic; of several
    labels of a page each counts.  Pages are counted by host once, with map-side combining; the levels
    above are sums of those counts, and each level's prior strength is one number that the driver reads.  A
    host with no labelled page has its domain's prior, as wide as the level's strength says.
    """
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    marks = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("page_id"), good.alias("good"))
    counted = names.join(marks, "page_id", "left").groupBy("suffix", "domain", "host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = checkpoint(counted)
    domains = checkpoint(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    top = domains.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean")).first()["mean"]
    by_suffix = checkpoint(_level(suffixes, F.lit(top)).select("suffix", F.col("mean").alias("parent_mean")))
    by_domain = checkpoint(_level(domains.join(by_suffix, "suffix"), F.col("parent_mean")).select("domain", F.col("suffix"), F.col("mean").alias("parent_mean")))
    return _level(hosts.join(by_domain, ["suffix", "domain"]), F.col("parent_mean")).select("suffix", "domain", "host", "n", "good", "alpha", "beta")


def url_filter(pages: DataFrame, labels: DataFrame, min_bound: float = MIN_BOUND, z: float = Z, suffix_file: str | None = None) -> DataFrame:
    """page_id, host, domain, suffix, n_labelled, n_good, bound, keep for each page; only ids and urls are read.

    ``bound``: posterior mean less ``z`` standard deviations, to six places; ``keep``: it is ``min_bound`` or more.
    ``suffix_file``: a public suffix list; without one only ``DEFAULT`` and single labels are suffixes, and all
    names below another registry's second label count as one registered domain.

    Defined cases: a null or host-less url has the host, domain and suffix '' and is judged as one host; a
    null page_id meets no label; repeated rows count and are returned as often as they occur; numeric
    addresses are their own domain and suffix; with no labels every host has the prior 1/2; other
    columns are not read, of pages or labels.
    """
    a, b = F.col("alpha"), F.col("beta")
    bound = F.round(a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6)
    names = named(pages, read_suffixes(pages.sparkSession, suffix_file) if suffix_file else DEFAULT)
    hosts = reputation(names, labels).select("host", F.col("n").alias("n_labelled"), F.col("good").cast("long").alias("n_good"), bound.alias("bound"))
    return names.join(hosts, "host").select("page_id", "host", "domain", "suffix", "n_labelled", "n_good", "bound", (F.col("bound") >= min_bound).alias("keep"))


def oracle(min_bound: float = MIN_BOUND, z: float = Z) -> str:
    def level(name: str, counts: str, parent: str, on: str) -> str:
        join = f"JOIN {parent}_p USING ({on})" if on else f"CROSS JOIN {parent}_p"
        return f"""
{name}_j AS (SELECT * FROM {counts} {join}),
{name}_s AS (SELECT 1 / greatest(1e-4, least(0.999, coalesce((sum(pow(good - n * parent_mean, 2) / (parent_mean * (1 - parent_mean))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0))) - 1 AS strength FROM {name}_j),
{name}_r AS (SELECT *, good + strength * parent_mean AS alpha, n - good + strength * (1 - parent_mean) AS beta FROM {name}_j, {name}_s),
{name}_p AS (SELECT * EXCLUDE (n, good, parent_mean, strength, alpha, beta), alpha / (alpha + beta) AS parent_mean FROM {name}_r)"""

    listed = ", ".join(f"'{s}'" for s in sorted(DEFAULT.names))  # all of two labels
    return f"""
WITH u AS (SELECT page_id, rtrim(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '.') AS host FROM pages),
v AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host WHEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) IN ({listed}) THEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix FROM u),
w AS (SELECT *, regexp_extract(substring(host, 1, greatest(length(host) - length(suffix) - 1, 0)), '([^.]*)$', 1) AS own FROM v),
named AS (SELECT page_id, host, suffix, CASE WHEN own = '' THEN host ELSE own || '.' || suffix END AS domain FROM w),
marks AS (SELECT doc_id AS page_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL),
hosts AS (SELECT suffix, domain, host, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS good FROM named LEFT JOIN marks USING (page_id) GROUP BY ALL),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
top_p AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS parent_mean FROM suffixes),{level("suffix", "suffixes", "top", "")},{level("domain", "domains", "suffix", "suffix")},{level("host", "hosts", "domain", "suffix, domain")}
SELECT page_id, host, domain, suffix, CAST(n AS BIGINT) AS n_labelled, CAST(good AS BIGINT) AS n_good, bound, bound >= {min_bound} AS keep
FROM named JOIN (SELECT host, n, good, round(alpha / (alpha + beta) - {z} * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))), 6) AS bound FROM host_r) USING (host)"""
