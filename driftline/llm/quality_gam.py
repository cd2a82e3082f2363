"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits shallow trees on one binned feature at a time, then on pairs of
features; what they add up to is one look-up table per feature or pair. A score is the
sum of the entries of a row's bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import arrow_columns, cut_lineage, struct, utf8
from driftline.llm.html_text import STOP_WORDS

#: Most labelled rows that the model is fitted on: those of least hash, whatever the input.
MAX_TRAIN_ROWS = 20_000
FEATURES = (
    "log_words", "log_lines", "mean_word", "upper_share", "symbol_share", "bar_share", "mark_share", "digit_share", "stop_share",
    "distinct_share", "repeat_line_share", "words_per_line", "long_word_share", "odd_byte_share", "top_word_share",
)
STOP_BYTES = frozenset(w.encode() for w in STOP_WORDS)


def _codes(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


UPPER, LOWER = _codes(bytes(range(65, 91))), _codes(bytes(range(97, 123)))
DIGIT, SYMBOL = _codes(b"0123456789"), _codes(b"#*$%&<>@^~=+_{}[]\\/")
SPACE, HIGH = _codes(b" \t\n\x0b\x0c\r"), np.arange(256) >= 128


def features_of(text: bytes) -> list[float]:
    """Numbers about a text, none of which depends on its language, source or id."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = max(1, int(byte[~SPACE].sum()))
    letters = max(1, int(byte[UPPER | LOWER | HIGH].sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    low = text.lower().split()
    count: dict[bytes, int] = {}
    for w in low:
        count[w] = count.get(w, 0) + 1
    stops = sum(c for w, c in count.items() if w.strip(b".,;:!?#*$%&") in STOP_BYTES)
    return [
        np.log1p(n),
        np.log1p(len(lines)),
        solid / n,
        byte[UPPER].sum() / letters,
        byte[SYMBOL].sum() / solid,
        byte[124] / n,
        byte[33] / n,
        byte[DIGIT].sum() / solid,
        stops / n,
        len(count) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(c for w, c in count.items() if len(w) > 20) / n,
        byte[HIGH].sum() / solid,
        max(count.values()) / n,
    ]


def with_features(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with `features`, an array of double in the order of FEATURES."""

    def make():
        def work(texts):
            flat = np.array([features_of(t) for t in utf8(texts)], np.float64)
            offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))

        return work

    return arrow_columns(docs, [text], struct(("features", T.ArrayType(T.DoubleType()))), make, carry)


@dataclass
class Gam:
    """edges[f]: inner bin borders of feature f; coarse[f]: those used in pairs."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        for (f, g), t in self.pairs.items():
            z += t[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _borders(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner borders at quantiles, midway between neighbouring values."""
    v = np.unique(values)
    if len(v) <= bins:
        return (v[1:] + v[:-1]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _stump_tree(grad: np.ndarray, hess: np.ndarray, leaves: int, reg: float) -> np.ndarray:
    """Values per bin of a greedy tree over ordered bins with at most `leaves` leaves."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + reg)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        m = np.arange(a + 1, b)
        gain = (g[m] - g[a]) ** 2 / (h[m] - h[a] + reg) + (g[b] - g[m]) ** 2 / (h[b] - h[m] + reg) - worth(a, b)
        i = int(np.argmax(gain))
        return float(gain[i]), int(m[i])

    parts = [(0, len(grad), *best(0, len(grad)))]
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda j: parts[j][2])
        a, b, gain, m = parts[i]
        if gain <= 1e-9:
            break
        parts[i : i + 1] = [(a, m, *best(a, m)), (m, b, *best(m, b))]
    out = np.zeros(len(grad))
    for a, b, *_ in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + reg)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, reg: float) -> tuple[np.ndarray, float]:
    """Values per cell of a depth-two tree: a cut on one axis, then one on the other each side."""
    best, table = -1.0, np.zeros_like(grad)
    for axis in (0, 1):
        g2, h2 = (grad, hess) if axis == 0 else (grad.T, hess.T)
        for m in range(1, g2.shape[0]):
            out, gain = np.zeros_like(g2), 0.0
            for rows in (slice(0, m), slice(m, None)):
                g, h = g2[rows].sum(0), h2[rows].sum(0)
                leaf = _stump_tree(g, h, 2, reg)
                out[rows] = leaf
                gain += float((leaf * g).sum() * 2 - (leaf**2 * (h + reg)).sum())
            if gain > best:
                best, table = gain, out if axis == 0 else out.T
    return table, best


def fit(
    x: np.ndarray,
    y: np.ndarray,
    bins: int = 32,
    pair_bins: int = 8,
    rounds: int = 120,
    pair_rounds: int = 30,
    n_pairs: int = 6,
    rate: float = 0.1,
    reg: float = 2.0,
) -> Gam:
    """Logistic loss. Rows of one class only, or none, give a constant model."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(intercept=float(np.log(share / (1 - share))))
    n_features = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        model.edges = model.coarse = [np.zeros(0)] * n_features
        model.tables = [np.zeros(1)] * n_features
        return model
    model.edges = [_borders(x[:, f], bins) for f in range(n_features)]
    model.coarse = [_borders(x[:, f], pair_bins) for f in range(n_features)]
    fine = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(n_features):
            g, h = slopes()
            n = len(model.tables[f])
            add = rate * _stump_tree(np.bincount(fine[f], g, n), np.bincount(fine[f], h, n), 4, reg)
            model.tables[f] += add
            z += add[fine[f]]

    def cells(f: int, k: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(model.coarse[f]) + 1, len(model.coarse[k]) + 1)
        return rough[f] * shape[1] + rough[k], shape

    g, h = slopes()
    gains = []
    for f, k in combinations(range(n_features), 2):
        cell, shape = cells(f, k)
        size = shape[0] * shape[1]
        gains.append((-_pair_tree(np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape), reg)[1], f, k))
    for _, f, k in sorted(gains)[:n_pairs]:
        model.pairs[f, k] = np.zeros(cells(f, k)[1])
    for _ in range(pair_rounds):
        for f, k in model.pairs:
            g, h = slopes()
            cell, shape = cells(f, k)
            size = shape[0] * shape[1]
            add = rate * _pair_tree(np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape), reg)[0]
            model.pairs[f, k] += add
            z += add.ravel()[cell]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learnt_labels(labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, quality) to learn from: one row per id, max_rows at most, those of least id hash.

    Held-out rows, null ids and labels other than 0 and 1 are left out; of clashing
    labels of one id the lower counts.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(F.col("quality").cast("double")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )


def train(featured: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Gam:
    """A model of learnt_labels() from featured (doc_id, features).

    max_rows rows at most come to the driver, as numbers, one per id (of repeated ids
    the least features) and in a fixed order, so that a repeated task or another
    partitioning gives the same model.
    """
    chosen = F.broadcast(learnt_labels(labels, max_rows))  # max_rows rows at most
    rows = (
        featured.join(chosen, "doc_id")
        .groupBy("doc_id")
        .agg(F.min("features").alias("features"), F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .toArrow()
    )
    flat = rows["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return fit(flat.reshape(-1, len(FEATURES)), rows["quality"].to_numpy())


def with_scores(featured: DataFrame, model: Gam, carry: list[str]) -> DataFrame:
    """featured with `score`, the probability of label 1."""

    def make():
        def work(features):
            flat = features.flatten().to_numpy(zero_copy_only=False)
            yield pa.array(model.scores(flat.reshape(-1, len(FEATURES))))

        return work

    return arrow_columns(featured, ["features"], struct(("score", T.DoubleType())), make, carry)


def score_documents(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Only the text is an input of a score. Null texts count as empty; long ones are
    measured whole. Rows that share a doc_id are scored each on its own. Without labels of both classes every score is
    the labels' mean with one row of either class added.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    featured = cut_lineage(with_features(named, carry=["doc_id"]))
    scored = with_scores(featured, train(featured, labels, max_rows), ["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of docs that score at least threshold, with their columns.

    Texts are read twice, once to fit and once to filter, so that no text is exchanged.
    """
    cols = docs.columns
    asked = F.broadcast(learnt_labels(labels, max_rows).select("doc_id"))  # max_rows rows at most
    seen = with_features(docs.select("doc_id", "text").join(asked, "doc_id", "left_semi"), carry=["doc_id"])
    model = train(cut_lineage(seen), labels, max_rows)

    def make():
        def work(texts):
            flat = np.array([features_of(t) for t in utf8(texts)], np.float64)
            yield pa.array(model.scores(flat))

        return work

    scored = arrow_columns(docs, ["text"], struct(("__score", T.DoubleType())), make)
    return scored.where(F.col("__score") >= threshold).select(*cols)
