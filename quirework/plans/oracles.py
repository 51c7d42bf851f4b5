"""DuckDB SQL for the registered queries: the same rows from the same tables, computed another way."""

from __future__ import annotations

#: Documents as books: a page is ``LINES_PER_PAGE`` lines of a document.
LINES_PER_PAGE = 3
PAGES = f"""
raw_lines AS (SELECT CAST(doc_id AS VARCHAR) AS book_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL),
pages AS (SELECT book_id, n // {LINES_PER_PAGE} + 1 AS page_seq, n // {LINES_PER_PAGE} + 1 AS page_id, string_agg(line, chr(10) ORDER BY n) AS content FROM raw_lines GROUP BY ALL),
lines AS (SELECT book_id, n // {LINES_PER_PAGE} + 1 AS page_seq, n // {LINES_PER_PAGE} + 1 AS page_id, n % {LINES_PER_PAGE} AS line_no, line,
  CAST(sum(length(line) + 1) OVER (PARTITION BY book_id, n // {LINES_PER_PAGE} ORDER BY n) AS BIGINT) - length(line) - 1 AS local FROM raw_lines),
starts AS (SELECT book_id, page_seq, page_id, length(content) AS size, CAST(sum(length(content) + 1) OVER (PARTITION BY book_id ORDER BY page_seq) AS BIGINT) - length(content) - 1 AS start FROM pages)"""
CHATS = """
pages AS (SELECT CAST(conv_id AS VARCHAR) AS book_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS page_seq, turn AS page_id, coalesce(text, '') AS content FROM conversations),
starts AS (SELECT book_id, page_seq, page_id, length(content) AS size, CAST(sum(length(content) + 1) OVER (PARTITION BY book_id ORDER BY page_seq) AS BIGINT) - length(content) - 1 AS start FROM pages)"""
#: Documents in Arabic letters, line by line of one of six kinds: chapter heading, entry, entry heading, prose, remark, paired forms.
LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "سصضطظذزخغجدرمكتلحسصضطظذزخغ" * 2
LEXICON_LINES = f"""
bare_lines AS (SELECT book_id, n, trim(regexp_replace(translate(regexp_replace(line, '[^a-zA-Z ]', '', 'g'), '{LATIN}', '{ARABIC}'), ' +', ' ', 'g')) AS a FROM raw_documents),
word_lines AS (SELECT *, split_part(a, ' ', 1) AS w, substring(a, length(split_part(a, ' ', 1)) + 2) AS r FROM bare_lines),
kind_lines AS (SELECT *, CASE WHEN length(w) < 2 OR r = '' THEN -1 ELSE n % 6 END AS kind FROM word_lines),
raw_lines AS (SELECT book_id, n, w, kind, CASE kind WHEN -1 THEN '' WHEN 0 THEN '## باب ' || w WHEN 1 THEN w || ': ' || r WHEN 2 THEN '## ' || w WHEN 3 THEN a WHEN 4 THEN 'قال: ' || r ELSE w || '، ' || split_part(r, ' ', 1) || ': ' || r END AS line FROM kind_lines)"""
LEXICON_PAGES = PAGES.replace("raw_lines AS", "raw_documents AS", 1).replace("pages AS", f"{LEXICON_LINES.strip()},\npages AS", 1).replace("AS line_no, line,", "AS line_no, line, w, kind,")
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x0B]"


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def split(hits: str, joiner: str = "' '", preamble: str = "true", pages: str = PAGES) -> str:
    """Segments of ``pages`` cut at ``hits``: rows of book_id, page_seq, local, off, meta (JSON)."""
    return f"""
WITH {pages},
hits AS ({hits}),
books AS (SELECT book_id, string_agg(content, {joiner} ORDER BY page_seq) AS text, min_by(page_id, page_seq) AS first_id FROM pages GROUP BY book_id),
points AS (SELECT hits.book_id, start + local AS idx, off, CASE WHEN local = size THEN 1 ELSE 0 END AS gap, meta FROM hits JOIN starts USING (book_id, page_seq)),
cuts AS (SELECT *, true AS real FROM points UNION ALL
  SELECT book_id, 0, 0, 0, '{{}}', false FROM books WHERE book_id NOT IN (SELECT book_id FROM points WHERE idx = 0) AND (book_id NOT IN (SELECT book_id FROM points) OR {preamble})),
bounds AS (SELECT *, coalesce(lead(idx) OVER (PARTITION BY book_id ORDER BY idx), length(text)) AS next FROM cuts JOIN books USING (book_id)),
cut AS (SELECT *, idx + off + gap AS a, substring(text, idx + off + gap + 1, next - idx - off - gap) AS r, NOT real OR off > 0 AS trims FROM bounds WHERE next > idx + off + gap),
shown AS (SELECT *, regexp_replace(r, '{SPACE}+$', '') AS rt, CASE WHEN trims THEN {_trim('r')} ELSE regexp_replace(r, '{SPACE}+$', '') END AS content FROM cut),
placed AS (SELECT *, CASE WHEN trims THEN a + length(rt) - length(content) ELSE a END AS p, a + length(rt) - 1 AS q FROM shown WHERE content <> ''),
located AS (SELECT placed.*, f.page_id AS from_id FROM placed ASOF JOIN starts f ON placed.book_id = f.book_id AND placed.p >= f.start),
ended AS (SELECT located.*, t.page_id AS last_id FROM located ASOF JOIN starts t ON located.book_id = t.book_id AND located.q >= t.start)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY idx) AS seg_seq, content, from_id, nullif(last_id, from_id) AS to_id, meta FROM ended"""


def line_hits(pattern: str, off: str = "0", at: str = "local", where: str = "true", meta: str = "'{}'") -> str:
    return f"SELECT book_id, page_seq, {at} AS local, {off} AS off, {meta} AS meta FROM lines WHERE regexp_matches(line, '{pattern}') AND {where}"


def nth_hit(hits: str, order: str) -> str:
    return f"SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_seq {order}, local {order}) AS nth FROM ({hits})) WHERE nth = 1"


#: What hides in scanned pages, put into the texts: invisible marks, runs of full stops, a waw apart from its word.
DIRT = (("e ", "e\u200b "), (". ", "... "), (" a ", " \u0648 \u0627"), ("-", "\u200f-"))
#: Letters with marks and variants, joiners and odd spaces.
MARKED = (("o", "\u0623\u064f"), ("s ", "\u0629 "), ("y", "\u0649"), ("n", "\u0646\u200d"), ("d ", "d\u00a0 "), ("u", "u\u0308"))


def replaced(pairs: tuple) -> str:
    out = "text"
    for a, b in pairs:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def preprocessed(expression: str, dirt: tuple = ()) -> str:
    source = f"(SELECT doc_id, {replaced(dirt)} AS text FROM documents)" if dirt else "documents"
    return f"SELECT doc_id, {expression} AS content FROM {source} WHERE text IS NOT NULL"


STRIP = [
    (r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", ""), (r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n"), (r"<[^>]+>", ""),
]


def html_text() -> str:
    out = "html"
    for pattern, to in STRIP:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    squeezed = f"regexp_replace({out}, '[ \t]*\n\\s*', '\n', 'g')"
    return f"SELECT page_id, {_trim(squeezed)} AS content FROM pages WHERE html IS NOT NULL"


def token_counts() -> str:
    """Latin text holds only these, and each is a single character but the rule of five or more."""
    kinds = {"tarqim": "[.!?؟؛]", "bullet": "[•*°]", "dash": r"[\-–—ـ]", "newline": r"\n", "num": "[0-9]", "hr": "[_=]{5,}"}
    parts = " UNION ALL ".join(f"SELECT '{t}' AS token, CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS count FROM documents" for t, p in kinds.items())
    return f"SELECT * FROM ({parts}) WHERE count > 0"


def detections() -> str:
    count = lambda p: f"CAST(coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS BIGINT)"
    return f"SELECT {count(r'[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{061C}]')} AS zero_width, {count(r'[.]{3,}')} AS ellipses, {count(r'\s\x{0648}\s+[\x{0600}-\x{06FF}]')} AS spaced_waw FROM (SELECT {replaced(DIRT)} AS text FROM documents)"


WORDS = r"[\-–—ـ]|[•*°]|[.!?؟؛]|[:：،()\[\]{}]|[^\s:：\-–—ـ،؛.?!؟()\[\]{}]+"


def sequences(top_k: int, min_count: int) -> str:
    """Pairs of items of the texts' item streams."""
    name = r"CASE WHEN x SIMILAR TO '[\-–—ـ]' THEN '{{dash}}' WHEN x SIMILAR TO '[•*°]' THEN '{{bullet}}' WHEN x SIMILAR TO '[.!?؟؛]' THEN '{{tarqim}}' ELSE regexp_replace(x, '([.*+?^${}|\\])', '\\\1', 'g') END"
    token = lambda c: f"CASE WHEN {c} IN ('{{{{dash}}}}', '{{{{bullet}}}}', '{{{{tarqim}}}}') THEN 1 ELSE 0 END"
    solid = lambda c: f"CASE WHEN {c} IN ('{{{{dash}}}}', '{{{{bullet}}}}', '{{{{tarqim}}}}') THEN 0 ELSE length({c}) END"
    return f"""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS book_id, regexp_extract_all(text, '{WORDS}') AS xs FROM documents WHERE text IS NOT NULL),
u AS (SELECT book_id, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM t),
v AS (SELECT book_id, i, {name} AS x FROM u),
g AS (SELECT book_id, i, x AS a, lead(x) OVER (PARTITION BY book_id ORDER BY i) AS b FROM v),
s AS (SELECT a || '\\s*' || b AS pattern, count(*) AS count, any_value({token('a')} + {token('b')}) AS token_count, any_value({solid('a')} + {solid('b')}) AS literal_length, min((book_id, i)) AS seen FROM g WHERE b IS NOT NULL GROUP BY pattern)
SELECT pattern, count, CAST(token_count AS BIGINT) AS token_count, CAST(literal_length AS BIGINT) AS literal_length FROM s WHERE count >= {min_count}
ORDER BY count DESC, token_count DESC, literal_length DESC, seen LIMIT {top_k}"""


def page_breaks(max_pages: int) -> str:
    """Books cut at page boundaries: single pages peel off while the rest spans more than ``max_pages``; the rest is one."""
    return f"""
WITH {CHATS},
spans AS (SELECT *, max(page_id) OVER (PARTITION BY book_id) AS last_id FROM pages),
parts AS (SELECT *, CASE WHEN last_id - page_id > {max_pages} THEN page_seq ELSE 1000000 END AS part FROM spans),
joined AS (SELECT book_id, part, {_trim("string_agg(content, ' ' ORDER BY page_seq)")} AS content, min(page_id) AS from_id, max(page_id) AS last_id FROM parts GROUP BY ALL)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY part) AS seg_seq, content, from_id, nullif(last_id, from_id) AS to_id, '{{}}' AS meta FROM joined WHERE content <> ''"""


def first_words() -> str:
    return r"SELECT start, count(*) AS count FROM (SELECT regexp_extract(line, '^([^\s]+)', 1) AS start FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)) WHERE start <> '' GROUP BY start"


def sentence_line_hits() -> str:
    """After a line end that follows closing punctuation."""
    return r"SELECT book_id, page_seq, local + length(line) + 1 AS local, 0 AS off, '{}' AS meta FROM (SELECT *, lead(line) OVER (PARTITION BY book_id ORDER BY page_seq, line_no) AS after FROM lines) WHERE regexp_matches(line, '[.!?؟؛]$') AND after IS NOT NULL"


def guarded_hits(pattern: str) -> str:
    """Line starts; at a page's start only where the page before ends in closing punctuation."""
    before = "(SELECT book_id, page_seq, lag(content) OVER (PARTITION BY book_id ORDER BY page_seq) AS before FROM pages)"
    return f"SELECT book_id, page_seq, local, 0 AS off, '{{}}' AS meta FROM lines JOIN {before} USING (book_id, page_seq) WHERE regexp_matches(line, '{pattern}') AND (local > 0 OR before IS NULL OR regexp_matches(before, '[.!?؟؛]\\s*$'))"


def line_starts(top_k: int, min_count: int) -> str:
    """First words of lines: what signatures are where no line begins with a token."""
    word = r"regexp_replace(regexp_extract(left(flat, 60), '^[^\s:،؛.?!؟]+'), '([.*+?^${}|\\])', '\\\1', 'g')"
    flat = _trim(f"regexp_replace(line, '{SPACE}+', ' ', 'g')")
    return f"""
WITH {PAGES}, f AS (SELECT book_id, page_seq, line_no, {flat} AS flat FROM lines), w AS (SELECT *, {word} AS pattern FROM f WHERE length(flat) >= 6)
SELECT pattern, count(*) AS count, min_by(flat, (book_id, page_seq, line_no)) AS example FROM w WHERE pattern <> '' GROUP BY pattern HAVING count(*) >= {min_count} ORDER BY count DESC, length(pattern) DESC, pattern LIMIT {top_k}"""


#: The rules of validation in SQL: ``bad`` has book_id, seg_seq, content, from_id, to_id; ``starts`` and ``pages`` the books.
JUDGED = """
books AS (SELECT book_id, string_agg(content, {glue} ORDER BY page_seq) AS text FROM pages GROUP BY book_id),
ids AS (SELECT book_id, page_id, max(start) AS start, max(start + size) AS stop FROM starts GROUP BY ALL),
known AS (SELECT bad.*, f.start, t.stop FROM bad LEFT JOIN ids f ON f.book_id = bad.book_id AND f.page_id = bad.from_id LEFT JOIN ids t ON t.book_id = bad.book_id AND t.page_id = coalesce(bad.to_id, bad.from_id)),
found AS (SELECT known.*, text, CASE WHEN content = '' THEN 0 ELSE strpos(substring(text, start + 1), content) END AS after, greatest(start - 1000, 0) AS low, strpos(text, content) AS whole FROM known JOIN books USING (book_id) WHERE start IS NOT NULL),
hits AS (SELECT *, CASE WHEN after > 0 AND start + after - 1 < coalesce(stop, length(text)) + 1 THEN start + after - 1 END AS own, strpos(substring(text, low + 1), content) AS near FROM found),
placed AS (SELECT *, CASE WHEN own IS NOT NULL THEN own + length(content) - 1 END AS ends, CASE WHEN content = '' OR own IS NOT NULL THEN NULL WHEN near > 0 AND low + near - 1 < stop + 1001 THEN low + near - 1 WHEN length(content) < 500 AND whole > 0 THEN whole - 1 END AS other FROM hits),
told AS (SELECT placed.*, e.page_id AS end_id, o.page_id AS other_id FROM placed ASOF LEFT JOIN starts e ON placed.book_id = e.book_id AND placed.ends >= e.start ASOF LEFT JOIN starts o ON placed.book_id = o.book_id AND placed.other >= o.start),
issues AS (
  SELECT book_id, seg_seq, 'page_not_found' AS type, from_id, to_id, NULL AS found_id, to_id AS actual_to FROM known WHERE start IS NULL OR stop IS NULL
  UNION ALL SELECT book_id, seg_seq, 'max_pages_violation', from_id, to_id, NULL, to_id FROM known WHERE start IS NOT NULL AND to_id <> from_id AND {max_pages} = 0 OR start IS NOT NULL AND to_id - from_id > {max_pages}
  UNION ALL SELECT book_id, seg_seq, 'max_pages_violation', from_id, to_id, NULL, end_id FROM told WHERE own IS NOT NULL AND NOT coalesce(to_id - from_id > {max_pages}, false) AND ({max_pages} = 0 AND end_id <> from_id OR end_id > coalesce(to_id, from_id + {max_pages}))
  UNION ALL SELECT book_id, seg_seq, 'page_attribution_mismatch', from_id, to_id, other_id, to_id FROM told WHERE own IS NULL AND other IS NOT NULL
  UNION ALL SELECT book_id, seg_seq, 'content_not_found', from_id, to_id, NULL, to_id FROM told WHERE own IS NULL AND other IS NULL)"""


def no_issues(segments: str, pages: str = PAGES) -> str:
    """The summary of the SQL's own segments, judged by the rules in SQL without a limit on pages."""
    judged = JUDGED.format(glue="' '", max_pages=1 << 40)
    return f"""
WITH bad AS ({segments}), {pages}, {judged}
SELECT (SELECT count(*) FROM bad) AS segments, count(*) AS issues, count(*) AS errors, CAST(0 AS BIGINT) AS warnings, count(*) = 0 AS ok FROM issues"""


def damaged() -> str:
    """Segments damaged in seven ways, judged in SQL."""
    return f"""
WITH good AS ({page_breaks(0)}), {CHATS},
led AS (SELECT *, (CAST(book_id AS BIGINT) + seg_seq) % 8 AS kind, lead(content) OVER w AS next, lead(from_id) OVER w AS after FROM good WINDOW w AS (PARTITION BY book_id ORDER BY seg_seq)),
bad AS (SELECT book_id, seg_seq,
  CASE WHEN kind = 1 THEN 'absent ' || content WHEN kind = 3 THEN content || ' and a tail that no page has' WHEN kind = 4 AND next IS NOT NULL THEN content || ' ' || next WHEN kind = 7 THEN '' ELSE content END AS content,
  CASE WHEN kind = 2 THEN -5 WHEN kind = 6 AND after IS NOT NULL THEN after ELSE from_id END AS from_id,
  CASE WHEN kind = 5 THEN coalesce(after, -7) ELSE to_id END AS to_id FROM led), {JUDGED.format(glue="' '", max_pages=0)}
SELECT book_id, seg_seq, type, from_id, to_id, CAST(found_id AS BIGINT) AS found_id, actual_to FROM issues"""


def suggested() -> str:
    """Latin lines hold tokens of no kind that names a rule."""
    return r"SELECT 'lineStartsAfter' AS pattern_type, CAST(NULL AS VARCHAR) AS meta_type, count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '[.!?؟؛•*°\-–—ـ0-9]|_{5}|={5}') HAVING count(*) > 0"


def shorter_breaks() -> str:
    """Pages of documents cut after each closing mark; a book's last page stays whole."""
    return f"""
WITH {PAGES},
ends AS (SELECT *, max(page_id) OVER (PARTITION BY book_id) AS last_id FROM pages),
listed AS (SELECT *, CASE WHEN page_id = last_id THEN [content] ELSE regexp_extract_all(content, '[^.!?؟؛]*[.!?؟؛]|[^.!?؟؛]+') END AS xs FROM ends),
cut AS (SELECT book_id, page_id, unnest(range(len(xs))) AS k, unnest(xs) AS x FROM listed),
trimmed AS (SELECT book_id, page_id, k, {_trim("x")} AS content FROM cut)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY page_id, k) AS seg_seq, content, page_id AS from_id, CAST(NULL AS BIGINT) AS to_id, '{{}}' AS meta FROM trimmed WHERE content <> ''"""


CHAT_LINES = f"""{CHATS},
chat_lines AS (SELECT book_id, page_seq, page_id, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS line_no FROM pages),
lines AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY book_id, page_seq ORDER BY line_no) AS BIGINT) - length(line) - 1 AS local FROM chat_lines)"""


def scored(pattern: str) -> str:
    """A rule for line starts, single pages, and options that are wrong."""
    judged = lambda segments, most: f"""(WITH bad AS ({segments}), {CHATS}, {JUDGED.format(glue="' '", max_pages=most)}
      SELECT (SELECT count(*) FROM bad) AS segment_count, (SELECT coalesce(max(length(content)), 0) FROM bad) AS max_length, (SELECT count(*) FROM bad WHERE to_id <> from_id) AS multi_page, (SELECT count(*) FROM issues) AS issues)"""  # noqa: E731
    rule = judged(split(line_hits(pattern), pages=CHAT_LINES), 1 << 40)
    pages = judged(page_breaks(0), 0)
    return f"""
WITH c AS (SELECT 0 AS index, * FROM {rule} UNION ALL SELECT 1, * FROM {pages}),
s AS (SELECT index, CAST(least(segment_count, 200) - 100 * issues - 5 * multi_page - max_length // 500 AS DOUBLE) AS score, segment_count, CAST(max_length AS INT) AS max_length, multi_page, issues FROM c
  UNION ALL SELECT 2, CAST('-inf' AS DOUBLE), NULL, NULL, NULL, NULL)
SELECT *, index = (SELECT index FROM s ORDER BY score DESC, index LIMIT 1) AS best FROM s"""


def lexicon_segments() -> str:
    meta = """CASE WHEN kind = 0 THEN '{"kind":"chapter"}' ELSE '{"kind":"entry","lemma":"' || w || '"}' END"""
    return split(f"SELECT book_id, page_seq, local, CASE WHEN kind = 1 THEN 0 ELSE 3 END AS off, {meta} AS meta FROM lines WHERE kind IN (0, 1, 2)", pages=LEXICON_PAGES)


def fuzzy_entries() -> str:
    """Chapters without their heading word; entries of 2 to 10 letters."""
    meta = """CASE WHEN kind = 0 THEN '{"type":"chapter"}' ELSE '{"lemma":"' || w || '"}' END"""
    return split(f"SELECT book_id, page_seq, local, CASE WHEN kind = 0 THEN 7 ELSE 0 END AS off, {meta} AS meta FROM lines WHERE kind = 0 OR kind = 1 AND length(w) <= 10", pages=LEXICON_PAGES)


def lexicon_counts(columns: str, rest: str = "") -> str:
    return f"WITH {LEXICON_PAGES} SELECT {columns} FROM lines {rest}"


def lexicon_surface() -> str:
    names = {"chapter": "kind = 0", "entry": "kind = 2", "lineEntry": "kind IN (1, 4)", "pairedForms": "kind = 5"}
    kinds = "chapter cluster codeLine entry inlineSubentry lineEntry marker noise pairedForms".split()
    return f"WITH {LEXICON_PAGES} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER ({names.get(k, 'false')}) AS count FROM lines" for k in kinds)


def heading_kinds() -> str:
    """Headings in five shapes, and what each is."""
    return f"""WITH {LEXICON_PAGES}
SELECT CASE n % 5 WHEN 0 THEN 'chapter' WHEN 2 THEN 'marker' WHEN 3 THEN 'noise' WHEN 4 THEN 'cluster' ELSE 'entry' END AS kind, count(*) AS headings FROM kind_lines WHERE kind >= 0 GROUP BY 1"""


def advised(lines: int, sequences: int, least: int) -> str:
    """The advice on Latin books: their lines open with words, and only sequences hold tokens."""
    name = r"CASE WHEN x SIMILAR TO '[\-–—ـ]' THEN '{{dash}}' WHEN x SIMILAR TO '[•*°]' THEN '{{bullet}}' WHEN x SIMILAR TO '[.!?؟؛]' THEN '{{tarqim}}' ELSE regexp_replace(x, '([.*+?^${}|\\])', '\\\1', 'g') END"
    token = lambda c: f"CASE WHEN {c} IN ('{{{{dash}}}}', '{{{{bullet}}}}', '{{{{tarqim}}}}') THEN 1 ELSE 0 END"
    word = r"regexp_replace(regexp_extract(left(flat, 60), '^[^\s:،؛.?!؟]+'), '([.*+?^${}|\\])', '\\\1', 'g')"
    flat = _trim(f"regexp_replace(line, '{SPACE}+', ' ', 'g')")
    return f"""
WITH {PAGES},
w AS (SELECT {word} AS pattern FROM (SELECT {flat} AS flat FROM lines) WHERE length(flat) >= 6),
openings AS (SELECT pattern, count(*) AS count FROM w WHERE pattern <> '' GROUP BY pattern HAVING count(*) >= {least} ORDER BY count DESC, length(pattern) DESC, pattern LIMIT {lines}),
u AS (SELECT book_id, page_seq, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM (SELECT *, regexp_extract_all(content, '{WORDS}') AS xs FROM pages)),
v AS (SELECT book_id, page_seq, i, {name} AS x FROM u),
k AS (SELECT *, {token("x")} AS t, CASE WHEN {token("x")} = 1 THEN 0 ELSE length(x) END AS solid FROM v),
g AS (SELECT *, lead(x) OVER p AS x2, lead(x, 2) OVER p AS x3, lead(t) OVER p AS t2, lead(t, 2) OVER p AS t3, lead(solid) OVER p AS s2, lead(solid, 2) OVER p AS s3 FROM k WINDOW p AS (PARTITION BY book_id, page_seq ORDER BY i)),
n AS (SELECT book_id, page_seq, i, 1 AS n, x AS pattern, t AS tokens, solid FROM g UNION ALL SELECT book_id, page_seq, i, 2, x || '\\s*' || x2, t + t2, solid + s2 FROM g WHERE x2 IS NOT NULL
  UNION ALL SELECT book_id, page_seq, i, 3, x || '\\s*' || x2 || '\\s*' || x3, t + t2 + t3, solid + s2 + s3 FROM g WHERE x3 IS NOT NULL),
s AS (SELECT pattern, count(*) AS count, min(tokens) AS tokens, min(solid) AS solid, min((book_id, page_seq, i, n)) AS seen FROM n WHERE tokens > 0 GROUP BY pattern),
repeats AS (SELECT pattern, count FROM s WHERE count >= {least} ORDER BY count DESC, tokens DESC, solid DESC, seen LIMIT {sequences}),
mode AS (SELECT CASE WHEN dense AND top_line >= greatest(2, top_repeat) THEN 'structured' WHEN NOT dense AND top_repeat > top_line THEN 'continuous' ELSE 'mixed' END AS mode FROM (
  SELECT coalesce((SELECT max(count) FROM openings), 0) AS top_line, coalesce((SELECT max(count) FROM repeats), 0) AS top_repeat, (SELECT count(*) FROM lines) > (SELECT count(*) FROM pages) AS dense)),
both_ AS (SELECT 'line-start' AS source, 'low' AS confidence, 1 AS rank, * FROM openings UNION ALL SELECT 'repeating-sequence', 'medium', 2, * FROM repeats),
weighed AS (SELECT *, CASE WHEN source = 'line-start' THEN CASE mode WHEN 'continuous' THEN 1 ELSE 3 END ELSE CASE mode WHEN 'structured' THEN 1 WHEN 'continuous' THEN 3 ELSE 2 END END AS weight FROM both_, mode)
SELECT CAST(row_number() OVER (ORDER BY weight DESC, rank DESC, count DESC, pattern) - 1 AS INT) AS place, source, confidence, pattern, count, mode FROM weighed"""
