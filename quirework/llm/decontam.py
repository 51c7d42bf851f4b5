"""Benchmark decontamination with a generalised suffix automaton over normalised tokens.

The automaton accepts every run of consecutive tokens of every test item.  A document's tokens are
streamed through it, which gives at each token the longest run ending there that some item has too, and
by the suffix links the longest one of each further item.  Runs are maximal for each item by itself, so
what other items (or shards) hold never hides one.  A maximal run is removed when

* it has at least ``max_span`` tokens, or
* it has at least ``min_span`` tokens and such runs of the document cover at least ``max_coverage``
  of one item's tokens.

Tokens are folded runs of letters, marks and digits, so case, punctuation and layout don't hide a
passage.  Most documents never reach the automaton: a matched run of ``min_span`` tokens needs
``min_span - 1`` consecutive token pairs that the items have, which is tested on whole Arrow batches.  That
test and the automaton take the same characters for word characters and fold them by one function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import checkpoint, fresh
from .textbatch import folded, normal_words, plain, slices, word_pattern

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("tokens", T.IntegerType()), T.StructField("item_id", T.LongType())]))
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32()), ("item_id", pa.int64())]))


def tokens_of(text: str) -> list[str]:
    return folded(word_pattern().findall(text))


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences; states know which items, by number, they occur in.

    ``names``: the id that each item is reported by; ids may be equal, items are still told apart.
    """

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.names = [name for name, _ in items]
        self.word = word_pattern()  # workers get it with the automaton
        self.vocab: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.of: list[set[int]] = [set()]
        self.item_tokens: dict[int, int] = {}
        pairs = set()
        for number, (_, words) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            self.item_tokens[number] = len(ids)
            last = 0
            for t in ids:
                last = self._extend(last, t)
                self.of[last].add(number)
            pairs.update(zip(ids, ids[1:], strict=False))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.of[self.link[state]] |= self.of[state]
        self.pairs = np.array(sorted(a * len(self.vocab) + b for a, b in pairs), dtype=np.int64)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.of.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, t: int) -> int:
        if t in self.next[last]:  # another item had this run already
            q = self.next[last][t]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, t, q)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and t not in self.next[p]:
            self.next[p][t] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][t]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
        return cur

    def _split(self, p: int, t: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def runs(self, words: list[str], least: int) -> list[tuple[int, int, set[int]]]:
        """(first, last + 1, items) of each maximal run of at least ``least`` tokens."""
        nxt, link, length, vocab = self.next, self.link, self.length, self.vocab
        state = matched = 0
        out: list[tuple[int, int, set[int]]] = []
        for j, w in enumerate(words):
            t = vocab.get(w, -1)
            if t in nxt[state]:
                state, matched = nxt[state][t], matched + 1
                continue
            if matched >= least:
                out.append((j - matched, j, self.of[state]))
            while state and t not in nxt[state]:
                state = link[state]
                matched = length[state]
            if t in nxt[state]:
                state, matched = nxt[state][t], matched + 1
            else:
                matched = 0
        if matched >= least:
            out.append((len(words) - matched, len(words), self.of[state]))
        return out

    def item_runs(self, words: list[str], least: int) -> list[tuple[int, int, int]]:
        """(first, last + 1, item) of each run of at least ``least`` tokens that is maximal for the item, whatever others hold."""
        nxt, link, length, vocab = self.next, self.link, self.length, self.vocab
        state = matched = 0
        out: list[tuple[int, int, int]] = []
        now: dict[int, int] = {}  # item: length of its longest run that ends here
        for j, w in enumerate([*words, None]):
            t = -1 if w is None else vocab.get(w, -1)
            while state and t not in nxt[state]:
                state = link[state]
                matched = length[state]
            state, matched = (nxt[state][t], matched + 1) if t in nxt[state] else (0, 0)
            before, now = now, {}
            s, n = state, matched
            while s and n >= least:
                for item in self.of[s]:
                    now.setdefault(item, n)
                s = link[s]
                n = length[s]
            out += [(j - n, j, item) for item, n in before.items() if now.get(item) != n + 1]
        return out


@dataclass(frozen=True)
class Limits:
    max_span: int = 13
    min_span: int = 6
    max_coverage: float = 0.5


def spans_of(text: str, automaton: SuffixAutomaton, limits: Limits) -> list[dict]:
    """Character ranges to remove: one for each item id of each offending run, in order."""
    found = list(automaton.word.finditer(text))
    runs = automaton.item_runs(folded([m[0] for m in found]), min(limits.min_span, limits.max_span))
    covered: dict[int, set[int]] = {}
    for a, b, item in runs:
        if b - a >= limits.min_span:
            covered.setdefault(item, set()).update(range(a, b))
    heavy = {i for i, at in covered.items() if len(at) >= limits.max_coverage * automaton.item_tokens[i]}
    kept = {(a, b, automaton.names[i]) for a, b, i in runs if b - a >= limits.max_span or b - a >= limits.min_span and i in heavy}
    return [{"start": found[a].start(), "end": found[b - 1].end(), "tokens": b - a, "item_id": name} for a, b, name in sorted(kept)]


def without(text: str, spans: list[dict], word: re.Pattern | None = None) -> tuple[str, int]:
    """``text`` without the spans' characters, and how many characters went.

    The gap's own white space becomes one blank (or line break, if it had one).
    """
    word = word or word_pattern()
    merged: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, at = "", 0
    for a, b in merged:
        out, at = out + text[at:a], b
        while at < len(text) and not text[at].isspace() and not word.match(text[at]):
            at += 1  # the passage's closing punctuation
        if (not out or out[-1].isspace()) and at < len(text) and text[at].isspace():
            brk = "\n" if "\n" in out[len(out.rstrip()) :] + text[at : at + 1] else " "
            out = out.rstrip() + (brk if out.strip() else "")
            while at < len(text) and text[at].isspace():
                at += 1
    out += text[at:]
    return out, len(text) - len(out)


def maybe_matching(texts: pa.Array, automaton: SuffixAutomaton, vocab: pa.Array, table: np.ndarray, least: int) -> np.ndarray:
    """Rows that may have a run of ``least`` tokens; it never misses one."""
    words = normal_words(texts)
    if not len(words.codes):
        return np.zeros(0, np.int64)
    known = np.asarray(pc.fill_null(pc.index_in(words.dictionary, value_set=vocab), -1)).astype(np.int64)
    ids = known[words.codes]
    if least <= 1:
        return np.unique(words.doc[ids >= 0])
    a, b = ids[:-1], ids[1:]
    good = (a >= 0) & (b >= 0) & (words.doc[:-1] == words.doc[1:])
    at = np.flatnonzero(good)
    good[at] = table[(a[at] * len(automaton.vocab) + b[at]) * 0x9E3779B97F4A7C1 >> 20 & len(table) - 1]
    need = least - 1
    if len(good) < need:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(good, dtype=np.int64)])
    return np.unique(words.doc[np.flatnonzero(total[need:] - total[:-need] == need)])


def _pass(automaton_of, limits: Limits, text_at: int, spans_at: int, last: bool, chars_at: int | None, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of.value
        least = min(limits.min_span, limits.max_span)
        vocab = pa.array(list(automaton.vocab), pa.string())
        table = np.zeros(1 << max(20, int(len(automaton.pairs) * 16).bit_length()), bool)
        table[automaton.pairs * 0x9E3779B97F4A7C1 >> 20 & len(table) - 1] = True
        for whole in batches:
            for batch in slices(whole, text_at, 8 << 20):
                texts = plain(batch.column(text_at))
                columns = list(batch.columns)
                found: dict[int, list[dict]] = {}
                if automaton.vocab:
                    for r in maybe_matching(texts, automaton, vocab, table, least).tolist():
                        if got := spans_of(texts[r].as_py(), automaton, limits):
                            found[r] = got
                spans = columns[spans_at].to_pylist() if columns[spans_at].null_count < len(texts) else [None] * len(texts)
                for r, got in found.items():
                    merged = {(s["start"], s["end"], s["item_id"]): s for s in (spans[r] or []) + got}
                    spans[r] = [merged[k] for k in sorted(merged)]
                if last and (hit := [r for r, s in enumerate(spans) if s]):
                    new = {r: without(texts[r].as_py(), spans[r], automaton.word)[0] for r in hit}
                    mask = np.zeros(len(texts), bool)
                    mask[hit] = True
                    columns[text_at] = pc.replace_with_mask(columns[text_at].cast(pa.string()), pa.array(mask), pa.array([new[r] for r in hit], pa.string()))
                    if chars_at is not None:
                        kind = columns[chars_at].type
                        columns[chars_at] = pc.replace_with_mask(columns[chars_at], pa.array(mask), pa.array([len(new[r]) for r in hit], kind))
                columns[spans_at] = pa.array([s or [] for s in spans] if last else spans, SPAN_ARROW)
                yield pa.RecordBatch.from_arrays(columns, schema_names)

    return run


def shards(benchmark: DataFrame, max_shard_chars: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The test items, in groups of bounded size that one worker can hold as an automaton."""
    items, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        words = tokens_of(row["text"])
        if size and size + len(row["text"]) > max_shard_chars:
            yield items
            items, size = [], 0
        items.append((-1 if row["item_id"] is None else row["item_id"], words))
        size += len(row["text"])
    if items:
        yield items


def decontaminate(docs: DataFrame, benchmark: DataFrame, limits: Limits | None = None, spans_column: str = "removed_spans", max_shard_chars: int = 1_000_000) -> DataFrame:
    """``docs`` with every offending span cut from ``text``, plus ``spans_column`` that lists them.

    Narrow: no shuffle.  What is broadcast is bounded: the items' texts are summed as they are read
    and cut into shards of at most ``max_shard_chars`` characters (a longer item is a shard), and each shard
    is one automaton and one pass.  A benchmark of one shard is one pass; after each pass of several the
    spans found so far are checkpointed and the shard's broadcast is released, so a worker holds one
    automaton at a time, however large the benchmark is.  Spans of all passes refer to the original text
    and are cut in the last.

    Defined cases: a null text stays null and an empty one empty, with no spans; other columns, extra
    ones included, pass unchanged, but ``n_chars`` (if there and integer) follows a changed text; equal
    rows get equal results; an empty benchmark changes nothing; items with a null text are ignored and
    a null item_id is reported as -1; items that share an item_id (or have none) are judged one by one, and equal
    spans of one id are listed once; items of fewer than ``min_span`` tokens are never matched.
    If ``docs`` has a column of the name ``spans_column``, the next free name is used.
    """
    limits = limits or Limits()
    (name,) = fresh(docs, spans_column)
    out = docs.withColumn(name, F.lit(None).cast(SPAN))
    schema = out.schema
    names = docs.columns + [name]
    text_at = next(i for i, c in enumerate(names) if c == "text")
    chars_at = next((i for i, f in enumerate(schema.fields) if f.name == "n_chars" and isinstance(f.dataType, T.IntegralType)), None)
    groups = shards(benchmark, max_shard_chars)
    now = next(groups, [])
    while True:
        after = next(groups, None)
        held = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(now))
        out = out.mapInArrow(_pass(held, limits, text_at, len(names) - 1, after is None, chars_at, names), schema)
        if after is None:
            return out
        out = checkpoint(out)
        held.destroy()
        now = after
