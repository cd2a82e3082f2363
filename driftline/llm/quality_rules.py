"""Quality rules: measures of each document, and lines frequent across documents of a host."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import arrow_columns, cut_lineage, struct, utf8

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
#: A line is above the limits when it is in more than MIN_TEXTS distinct texts of its host,
#: and in more than MAX_SHARE of them or, however large the host is, in more than MAX_TEXTS.
MIN_TEXTS, MAX_SHARE, MAX_TEXTS = 20, 0.01, 1000
#: A document is depleted when fewer words, or a smaller share of them, remain.
LEAST_WORDS, LEAST_SHARE = 20, 0.5


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of `size` words that occur twice or more, first ones included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    width = 1
    while width < size:  # names for windows of 2, 4, 8 words; exact, as names are
        step = min(width, size - width)
        pair = ids[: len(ids) - step] * (len(words) + 1) + ids[step:]
        _, ids, count = np.unique(pair, return_inverse=True, return_counts=True)
        if len(count) == len(ids):
            return 0
        width += step
    hit = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(count[ids] > 1)
    np.add.at(hit, twice, 1)
    np.add.at(hit, twice + size, -1)
    return int(np.count_nonzero(np.cumsum(hit)[:-1]))


def line_code(line: bytes) -> int:
    """Signed hash of a line with A-Z lowered and white space made one space."""
    h = xxhash.xxh64_intdigest(b" ".join(line.lower().split()))
    return h - (1 << 64) if h >> 63 else h


MEASURES = struct(
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("text_code", T.LongType()),
    ("line_codes", T.ArrayType(T.LongType())),
    ("line_words", T.ArrayType(T.IntegerType())),
)


def with_measures(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with the measures, a hash of the text, and its distinct lines with their words."""

    def make():
        def work(texts):
            rows = [_measure(t) for t in utf8(texts)]
            return [pa.array(list(c), _arrow(f.dataType)) for c, f in zip(zip(*rows, strict=True), MEASURES.fields, strict=True)]

        return work

    return arrow_columns(docs, [text], MEASURES, make, carry)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()


def _measure(text: bytes) -> tuple:
    words = text.split()
    lines: dict[bytes, int] = {}
    n_dup = 0
    share: dict[int, int] = {}
    for line in text.split(b"\n"):
        if size := len(line.split()):
            n_dup += line in lines
            lines[line] = lines.get(line, 0) + size
    for line, size in lines.items():
        code = line_code(line)
        share[code] = share.get(code, 0) + size
    code = xxhash.xxh64_intdigest(text)
    return (
        len(words),
        len(text.translate(None, CONTINUATION + SPACES)),
        len(text) - len(text.translate(None, SYMBOLS)),
        n_dup,
        repeated_words(words),
        code - (1 << 64) if code >> 63 else code,
        list(share),
        list(share.values()),
    )


def frequent_lines(measured: DataFrame, min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE, max_texts: int = MAX_TEXTS) -> DataFrame:
    """(host, code) of lines in more than min_texts distinct texts, and in more than max_share of the host's or more than max_texts.

    Copies of a text count once, so that a copied document doesn't make its own lines
    boilerplate. Each line is counted once per text before rows are exchanged.
    """
    texts = measured.select("host", "text_code", "line_codes").dropDuplicates(["host", "text_code"])
    hosts = texts.groupBy("host").agg(F.count("*").alias("n_texts"))
    counts = (
        texts.select("host", F.explode("line_codes").alias("code"))
        .groupBy("host", "code")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > min_texts)
    )
    over = (F.col("n") > F.col("n_texts") * F.lit(float(max_share))) | (F.col("n") > max_texts)
    return counts.join(hosts, "host").where(over).select("host", "code")


def quality_report(
    docs: DataFrame,
    min_texts: int = MIN_TEXTS,
    max_share: float = MAX_SHARE,
    max_texts: int = MAX_TEXTS,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """Per row of docs: doc_id, the measures, removed_words, base_failed, kept.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows.
    Lines over the limits of frequent_lines() are removed; a document that loses words
    so and then has under 20, or under half of its own, is depleted. kept: neither.
    Null texts have no words; a null host counts as an empty name; rows that share a
    doc_id are judged each on its own.
    """
    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(host, F.lit("")).alias("host"), F.col(text).alias("text")
    )
    measured = cut_lineage(with_measures(named, carry=["doc_id", "host"]).withColumn("row", F.monotonically_increasing_id()))
    removed = _frequent_of(measured, min_texts, max_share, max_texts).groupBy("row").agg(F.sum("words").alias("removed_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rest = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((rest < LEAST_WORDS) | (rest < LEAST_SHARE * F.col("n_words")))
    return (
        measured.drop("line_codes", "line_words")
        .join(removed, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words",
            failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        )
    )


def _frequent_of(measured: DataFrame, min_texts: int, max_share: float, max_texts: int) -> DataFrame:
    """(row, code, words) of the frequent lines of each row."""
    lines = measured.select("row", "host", F.explode(F.arrays_zip("line_codes", "line_words")).alias("l")).select(
        "row", "host", F.col("l.line_codes").alias("code"), F.col("l.line_words").alias("words")
    )
    return lines.join(frequent_lines(measured, min_texts, max_share, max_texts), ["host", "code"]).select("row", "code", "words")


def remove_frequent_lines(
    docs: DataFrame, min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE, max_texts: int = MAX_TEXTS, host: str = "source"
) -> DataFrame:
    """docs with frequent lines cut from `text`, without the rows that quality_report() rejects."""
    cols = docs.columns
    held = cut_lineage(docs.withColumn("row", F.monotonically_increasing_id()))
    measured = cut_lineage(
        with_measures(held.withColumn("host", F.coalesce(host, F.lit(""))), carry=["row", "host"])
    )
    cuts = _frequent_of(measured, min_texts, max_share, max_texts).groupBy("row").agg(
        F.collect_set("code").alias("__cut"), F.sum("words").alias("__lost")
    )
    judged = held.join(measured.select("row", "n_words", "n_repeat_words"), "row").join(cuts, "row", "left")
    rest = F.col("n_words") - F.coalesce("__lost", F.lit(0))
    good = (
        (F.col("n_words") >= 20)
        & (100 * F.col("n_repeat_words") <= 30 * F.col("n_words"))
        & (F.col("__lost").isNull() | ((rest >= LEAST_WORDS) & (rest >= LEAST_SHARE * F.col("n_words"))))
    )

    def make():
        def work(texts, cuts):
            out = []
            for t, c in zip(texts.to_pylist(), cuts.to_pylist(), strict=True):
                if t and c:
                    gone = set(c)
                    t = b"\n".join([x for x in t.encode().split(b"\n") if not x.split() or line_code(x) not in gone]).decode()
                out.append(t)
            yield pa.array(out, pa.string())

        return work

    return arrow_columns(judged.where(good), ["text", "__cut"], struct(("text", T.StringType())), make).select(*cols)
