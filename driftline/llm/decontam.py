"""Benchmark decontamination: a generalised suffix automaton of test items, streamed over texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import arrow_columns, cut_lineage, struct

#: ASCII separators become spaces, A-Z become a-z; bytes of other characters stay.
TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: UTF-8 bytes of items in one automaton; more items make more automata, used one after another.
GROUP_BYTES = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class ItemAutomaton:
    """Suffix automaton over the words of all items.

    A state is a class of word sequences that end at the same places. `full` has, for
    the state of each window of `window` words, the items with it; `short` those of
    items of fewer words, by state and length.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.word = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = []
        for name, words in items:
            ids = [self.word.setdefault(w, len(self.word)) for w in words]
            if ids:
                coded.append((name, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        self.full: dict[int, set[str]] = {}
        self.short: dict[tuple[int, int], set[str]] = {}
        self.lengths = sorted({len(ids) for _, ids in coded if len(ids) < window})
        self.least = min([window, *self.lengths]) if coded else 0
        for name, ids in coded:
            state = held = 0
            for w in ids:
                state, held = self.next[state][w], held + 1
                if held >= window:
                    self.full.setdefault(self._cut(state, window), set()).add(name)
            if held < window:
                self.short.setdefault((self._cut(state, held), held), set()).add(name)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if (q := nxt[last].get(w)) is not None:
            return q if size[q] == size[last] + 1 else self._split(last, w, q)
        new = self._state(size[last] + 1, {})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][w]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.size[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, size: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.size.append(size)
        self.link.append(0)
        return len(self.size) - 1

    def _cut(self, state: int, length: int) -> int:
        """The state of the last `length` words of what led to state."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint word spans (start, end) inside occurrences, in order, and the items found."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        known = bytes(map(self.word.__contains__, words))
        if not self.least or b"\x01" * self.least not in known:
            return spans, found
        for run in re.finditer(b"\x01{%d,}" % self.least, known):
            state = held = 0
            for i in range(run.start(), run.end()):
                w = self.word[words[i]]
                while state and w not in self.next[state]:
                    state = self.link[state]
                    held = self.size[state]
                if w in self.next[state]:
                    state, held = self.next[state][w], held + 1
                if held >= self.window:
                    found |= self.full[self._cut(state, self.window)]
                    _cover(spans, i + 1 - held, i + 1)
                for m in self.lengths:
                    if m > held:
                        break
                    if names := self.short.get((self._cut(state, m), m)):
                        found |= names
                        _cover(spans, i + 1 - m, i + 1)
        return spans, found


def _cover(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Adds a span that ends last; earlier ones that it meets are merged."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append((start, end))


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(a + b):
        if out and out[-1][1] >= s:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def automata(benchmark: DataFrame, window: int = 10, group_bytes: int = GROUP_BYTES):
    """Yields automata over all items, each of at most about group_bytes of text.

    The driver holds one group at a time, so its memory doesn't grow with the benchmark.
    """
    # Without repeats, else those of one item would all fall into one group.
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // group_bytes) or 1
    items = cut_lineage(items) if n > 1 else items
    for g in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g)
        rows = part.collect()
        yield ItemAutomaton([(r.item_id or "", words_of(bytes(r.text or b""))) for r in rows], window)


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    carry: list[str] | None = None,
    group_bytes: int = GROUP_BYTES,
    cut: bool = False,
) -> DataFrame:
    """docs with n_words, n_hit, hit_spans and hit_items.

    hit_spans: word positions start, end, start, end, ... of the disjoint spans inside
    any occurrence of a window; hit_items: the distinct item ids, sorted as strings.
    A null text has no words; a null item id counts as an empty string. An empty
    benchmark hits nothing. Benchmarks beyond group_bytes take several automata in a
    row, whose findings are merged; results are the same. cut: the text comes back
    without the words of the spans.
    """
    out = struct(
        ("n_words", T.LongType()), ("n_hit", T.LongType()), ("hit_spans", T.ArrayType(T.IntegerType())), ("hit_items", T.ArrayType(T.StringType()))
    )
    kept = [c for c in (docs.columns if carry is None else carry) if c not in out.fieldNames()]
    held = list(dict.fromkeys([*kept, text]))
    found = automata(benchmark, window, group_bytes)
    k, now = 0, next(found)
    while now is not None:
        following = next(found, None)
        shared = docs.sparkSession.sparkContext.broadcast(now)
        docs = _matched(docs, shared, text, held, out, k > 0, cut and following is None)
        k, now = k + 1, following
        if k % 4 == 0 and now is not None:
            docs = cut_lineage(docs)
    return docs.select(*kept, *out.fieldNames())


def _matched(docs: DataFrame, shared, text: str, kept: list[str], out: T.StructType, again: bool, cut: bool) -> DataFrame:
    made = T.StructType([*out.fields, T.StructField(text, T.StringType())]) if cut else out

    def make():
        automaton = shared.value

        def work(texts, *before):
            n, hit, spans, items, left = [], [], [], [], []
            old = zip(*(c.to_pylist() for c in before), strict=True) if again else None
            for t in texts.cast(pa.binary()).to_pylist():
                words = words_of(t or b"")
                s, found = automaton.scan(words)
                if old:
                    flat, names = next(old)
                    s = _merged(s, list(zip(flat[::2], flat[1::2], strict=True)))
                    found = found | set(names)
                n.append(len(words))
                hit.append(sum(e - b for b, e in s))
                spans.append([x for p in s for x in p])
                items.append(sorted(found))
                if cut:
                    left.append(remove_spans(t, spans[-1]) if s else t)
            new = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            return [*new, pa.array(left, pa.binary()).cast(pa.string())] if cut else new

        return work

    return arrow_columns(docs, [text, *(["hit_spans", "hit_items"] if again else [])], made, make, kept)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_matches(named, benchmark, window, carry=["doc_id"]).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_spans(text: bytes, spans: list[int]) -> bytes:
    """text without the words of the spans and what lies between the words of one span."""
    words = [m.span() for m in WORD.finditer(text)]
    keep, at = [], 0
    for s, e in zip(spans[::2], spans[1::2], strict=True):
        keep.append(text[at : words[s][0]])
        at = words[e - 1][1]
    keep.append(text[at:])
    return b"".join(keep)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without benchmark passages.

    Spans of at least `window` matching words (or whole shorter items) go from the
    text, and n_chars follows. Rows of which more than max_coverage of the words are
    hit go as a whole. Other rows and columns stay as they are, null texts included.
    """
    found = with_matches(docs, benchmark, window, cut=True)
    cleaned = found.where(F.col("n_hit") <= F.col("n_words") * F.lit(float(max_coverage)))
    changed = F.size("hit_spans") > 0
    out = {c: F.col(c) for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return cleaned.select(*out.values())
