"""SimHash near-duplicates: pigeonhole blocks, joins on blocks, Hamming verification."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import arrow_columns, cut_lineage, struct, utf8
from driftline.llm.components import connected_components

BITS = 64


def simhash(text: bytes, shingle: int = 3, seed: int = 42, chunk: int = 1 << 15) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text; zero for a text without words.

    A-Z are lower-cased, words are runs of anything but ASCII white space, and every
    shingle counts as often as it occurs. A bit is set if over half the hashes have it.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined, k = b" ".join(words), min(shingle, n)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    starts, ends = (end - size)[: n - k + 1].tolist(), end[k - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(starts), chunk):
        part = zip(starts[i : i + chunk], ends[i : i + chunk], strict=True)
        codes = np.array([digest(joined[a:b], seed) for a, b in part], "<u8")
        ones += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    set_bits = (ones * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def with_fingerprint(
    docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42, carry: list[str] | None = None
) -> DataFrame:
    """docs with `fingerprint`, a long that holds the 64 bits. Null texts count as empty."""

    def make():
        def work(texts):
            yield pa.array(np.array([simhash(t, shingle, seed) for t in utf8(texts)], np.uint64).view(np.int64))

        return work

    return arrow_columns(docs, [text], struct(("fingerprint", T.LongType())), make, carry)


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of which one at least is untouched by any `distance` differing bits."""
    cut = [BITS * i // blocks for i in range(blocks + 1)]
    part = [((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in range(blocks)]
    return [sum(c) for c in combinations(part, blocks - distance)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_links(prints: DataFrame, distance: int = 2, blocks: int = 4, bucket: int = 64) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints within `distance` bits (1 or 2).

    Each fingerprint goes into one bucket per choice of `blocks - distance` blocks, so
    each close pair shares a bucket. Buckets of up to `bucket` members are joined and
    each pair is verified. Larger ones take an exact way without pairs: two
    fingerprints differ in at most two bits if and only if one bit flip (or none) on
    either side meets at a common hub, so members emit their hubs over the bits that
    the bucket leaves free, and a hub, which has 65 members at most, links them.
    Connectivity is the same as that of all close pairs; work is linear in each bucket.
    """
    if not 1 <= distance <= 2:
        raise ValueError("distance must be 1 or 2")
    masks = block_masks(blocks, distance)
    keys = F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("key"), F.lit(_long(~m & (1 << 64) - 1)).alias("free"))
        for i, m in enumerate(masks)
    ])
    dealt = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(dealt.join(sizes, ["t", "key"]))
    small = shared.where(F.col("n") <= bucket)
    pairs = (
        small.select("t", "key", F.col("fp").alias("a"))
        .join(small.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
        .where((F.col("a") < F.col("b")) & (_differing("a", "b") <= distance))
        .select("a", "b")
    )
    flips = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.expr("free").bitwiseAND(_bit(i)) != 0),
        lambda i: F.col("fp").bitwiseXOR(_bit(i)),
    )
    hubs = (
        shared.where(F.col("n") > bucket)
        .groupBy("fp")
        .agg(F.bit_or("free").alias("free"))
        .select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("hub"))
        .groupBy("hub")
        .agg(F.collect_set("fp").alias("members"))
        .where(F.size("members") > 1)
    )
    if distance == 1:
        near = hubs.select(F.explode("members").alias("a"), F.col("hub").alias("b"), "members")
        stars = near.where(F.array_contains("members", F.col("b")) & (F.col("a") != F.col("b"))).select("a", "b")
    else:
        stars = hubs.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    distance: int = 2,
    blocks: int = 4,
    bucket: int = 64,
) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of docs.

    fingerprint is a long; component_id is the smallest doc_id reachable over links of
    at most `distance` bits, the row's own included. Equal texts share a fingerprint.
    Texts without words have fingerprint zero and link like any other. A null doc_id
    keeps its row and is never a component_id unless all of its component are null.
    Repeated rows stay; an empty table gives none. Other columns are not carried.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = cut_lineage(with_fingerprint(named, "text", shingle, carry=["doc_id"]))
    groups = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = connected_components(close_links(groups.select(F.col("fingerprint").alias("fp")), distance, blocks, bucket))
    rooted = groups.join(roots, groups.fingerprint == roots.node, "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named_roots = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(named_roots, "fingerprint").select("doc_id", "fingerprint", "component_id")


SKETCH, KEYS = 192, 8
#: Sketches that say less than this are of no pair above 0.8: over six standard errors.
CLEAR_MISS = 0.6
#: Words whose hashes a task remembers, up to this many bytes long; beyond, it starts anew.
REMEMBERED, LONG_WORD = 200_000, 64
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29)


class ShingleCoder:
    """Distinct 64-bit codes of word shingles, ascending: a mix of the codes of their words, in order."""

    def __init__(self, shingle: int = 5):
        self.shingle, self.words = shingle, {}
        self.factors = [np.uint64(pow(int(MIX[0]), 2 * k + 1, 1 << 64)) for k in range(shingle)]

    def codes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        known = self.words
        fresh = set(words).difference(known)
        known.update(zip(fresh, map(xxhash.xxh64_intdigest, fresh), strict=True))
        n = len(words)
        each = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        for w in fresh:
            if len(w) > LONG_WORD:
                del known[w]
        k = min(self.shingle, n)
        mixed = np.zeros(max(1, n - k + 1), np.uint64)
        for i in range(k):
            mixed += each[i : n - k + 1 + i] * self.factors[i]
        mixed ^= mixed >> MIX[2]
        mixed *= MIX[1]
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def _sketch(codes: np.ndarray) -> bytes:
    return np.unique((codes[:SKETCH] >> np.uint64(32)).astype("<u4")).tobytes()


def sketch_of(text: bytes, shingle: int = 5) -> bytes:
    """The least SKETCH distinct hashes (32 bits, ascending) of the word shingles; one for a text without words."""
    return _sketch(ShingleCoder(shingle).codes(text))


def sketch_similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two texts' shingles: exact up to SKETCH shingles in all, else estimated."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.union1d(x, y)
    if len(x) == SKETCH or len(y) == SKETCH:
        both = both[:SKETCH]
    return float(np.isin(both, np.intersect1d(x, y, assume_unique=True), assume_unique=True).sum() / len(both))


def similar_links(
    items: DataFrame,
    similarity: float = 0.8,
    bucket: int = 16,
    known: DataFrame | None = None,
    whole: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Edges (a, b) that connect fingerprints whose texts reach the similarity in five-word shingles.

    items: fp, sketch, and for texts beyond SKETCH shingles item (one per distinct set
    of shingles), n (its size) and keys (its least codes), with whole(rows) giving rows
    (item, ...) with set. known: further edges, which the result connects too. Each
    fingerprint that is linked comes as a, with the smallest of its component as b.

    Two bits of 64 hold near-identical texts only: at a similarity of 0.8 fingerprints
    differ in about ten, beyond any useful choice of blocks. So texts are also blocked by
    their KEYS least shingle codes, of which similar texts share some (at 0.8 about
    seven of eight). In blocks of up to `bucket` members each pair is held against each
    other; in larger ones (groups of copies, frequent passages) each member against the
    one whose shingles are the most frequent, which stands in the middle of its copies.
    What large blocks then still hold in more than one component goes the exact way of
    _crossing(), so no link depends on a block's size. Sketches only discard clear misses.
    """
    held = items
    if "item" not in items.columns:
        size = (F.length("sketch") / 4).cast("int")
        codes = F.transform(F.sequence(F.lit(0), F.least(F.lit(KEYS), size) - 1), lambda i: F.conv(F.hex(F.substring("sketch", i * 4 + 1, F.lit(4))), 16, 10).cast("long"))
        held = cut_lineage(items.select("fp", F.col("fp").alias("item"), size.cast("long").alias("n"), codes.alias("keys"), "sketch"))
    dealt = held.select("item", F.explode("keys").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut_lineage(dealt.join(sizes, "key"))
    small = shared.where(F.col("size") <= bucket).select("key", "item")
    close = small.withColumnRenamed("item", "b").join(small.withColumnRenamed("item", "a"), "key").where("a > b").select("a", "b")
    large = shared.where(F.col("size") > bucket).select("key", "item")
    pairs = close.unionByName(_to_leaders(large, held)).distinct()
    links = _reaching(pairs, held, similarity, whole)
    links = links if known is None else links.unionByName(known)
    roots = cut_lineage(connected_components(links))
    placed = large.join(held.select("item", "fp"), "item").join(roots, F.col("fp") == F.col("node"), "left").select("key", "item", F.coalesce("root", "fp").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    left = cut_lineage(placed.join(mixed, "key", "left_semi").groupBy("item").agg(F.min("root").alias("root")))
    found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if left.isEmpty():
        return found
    sets = cut_lineage(whole(left) if whole else _sketch_sets(held.join(left, "item")))
    # Components of components: few edges, as what is alike in large blocks is mostly joined already.
    tops = connected_components(_alike(_crossing(sets, similarity), sets, similarity))
    alone = tops.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    above = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.unionByName(alone).join(above, "root", "left").select(F.col("node").alias("a"), F.coalesce("top", "root").alias("b"))


def _to_leaders(large: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b: each member of each large block (key, item) with the block's leader.

    The hashes in the leader's sketch are the most frequent on average among the members
    of large blocks: up to SKETCH shingles, it shares the most with the others. Ties go
    to the smaller item. Frequencies are counted, not gathered.
    """
    members = held.join(large.select("item").distinct(), "item", "left_semi")

    def make():
        return lambda sketches: [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in sketches.to_pylist()], pa.list_(pa.int64()))]

    probes = arrow_columns(members, ["sketch"], struct(("probes", T.ArrayType(T.LongType()))), make, ["item"]).select("item", F.explode("probes").alias("probe"))
    often = probes.groupBy("probe").agg(F.count("*").alias("often"))
    middle = cut_lineage(probes.join(often, "probe").groupBy("item").agg(F.avg("often").alias("middle")))
    ranked = large.join(middle, "item")
    best = F.max(F.struct("middle", F.bitwise_not("item").alias("last")))
    leaders = cut_lineage(ranked.groupBy("key").agg(best.alias("best")).select("key", F.bitwise_not("best.last").alias("leader")))
    leaders = F.broadcast(leaders) if leaders.count() <= SENT_ROWS else leaders
    return (
        large.join(leaders, "key")
        .where("item <> leader")
        .select(F.greatest("item", "leader").alias("a"), F.least("item", "leader").alias("b"))
    )


def _crossing(sets: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of different roots among sets (item, root, set): all that reach the similarity are there.

    Prefix filter: two such sets share a hash after which (in any common order) each
    still holds as many of the other's as the similarity asks for. Hashes that only one
    root has make no pair and are left out, rarer ones come first, and a hash counts
    only where enough follows it for the smallest set that has it. So copies with too
    many words of their own, and texts around a frequent passage, drop out before any
    join. Of each hash, the sets of its most frequent root are joined with those of
    other roots only.
    """
    sized = sets.select("item", "root", F.size("set").alias("n"), "set")
    tokens = sized.select("item", "root", "n", F.explode("set").alias("token"))
    often = (
        tokens.groupBy("token")
        .agg(F.count("*").alias("often"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least"))
        .where("low <> high")
        .select("token", "often", "least")
    )
    share = F.lit(similarity / (1 + similarity))
    lower = F.col("n") * F.lit(similarity)
    rest = F.col("m") - F.col("at")
    keyed = (
        tokens.join(often, "token")
        .groupBy("item", "root", "n")
        .agg(F.sort_array(F.collect_set(F.struct("often", "token", "least"))).alias("shared"))
        .where(F.size("shared") >= lower - F.lit(1e-9))
        .select("item", "root", "n", F.size("shared").alias("m"), F.posexplode("shared").alias("at", "t"))
        .where((rest >= lower - F.lit(1e-9)) & (rest >= (F.col("n") + F.greatest(F.col("t.least"), lower)) * share - F.lit(1e-6)))
        .select(F.col("t.token").alias("token"), "item", "root", "n", rest.alias("rest"))
    )
    keyed = cut_lineage(keyed)
    main = (
        keyed.groupBy("token", "root")
        .agg(F.count("*").alias("c"))
        .groupBy("token")
        .agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots"))
        .where("roots > 1")
        .select("token", F.col("top.root").alias("main"))
    )
    dealt = cut_lineage(keyed.join(main, "token"))
    side = lambda x: [F.col(c).alias(c + x) for c in ("item", "root", "n", "rest")]
    others = dealt.where("root <> main").select("token", *side("a"))
    enough = F.least("resta", "restb") >= (F.col("na") + F.col("nb")) * share - F.lit(1e-6)
    once = (F.col("rootb") == F.col("main")) | (F.col("roota") < F.col("rootb"))
    met = others.join(dealt.select("token", "main", *side("b")), "token").where((F.col("roota") != F.col("rootb")) & once & enough)
    return met.select(F.greatest("itema", "itemb").alias("a"), F.least("itema", "itemb").alias("b")).distinct()


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The roots (a, b) of those pairs of items whose whole sets reach the similarity."""
    of = lambda x: sets.select(F.col("item").alias(x), F.col("set").alias(f"set{x}"), F.col("root").alias(f"root{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(_jaccard("seta", "setb") >= similarity).select(F.col("roota").alias("a"), F.col("rootb").alias("b")).distinct()


def _jaccard(a: str, b: str) -> Column:
    both = F.array(F.size(F.array_intersect(a, b)))
    return F.element_at(F.transform(both, lambda o: o / (F.size(a) + F.size(b) - o)), 1)


def _reaching(pairs: DataFrame, held: DataFrame, similarity: float, whole: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The fingerprints (a, b) of those pairs of items that reach the similarity, judged by their whole sets."""
    side = lambda x: held.select(F.col("item").alias(x), *[F.col(c).alias(c + x) for c in ("fp", "n", "sketch")])
    sides = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("fpa") != F.col("fpb")) & (F.least("na", "nb") / F.greatest("na", "nb") >= similarity))

    def make():
        def work(left, right):
            yield pa.array([sketch_similarity(x, y) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())

        return work

    judged = arrow_columns(sides, ["sketcha", "sketchb"], struct(("s", T.DoubleType())), make, ["a", "b", "fpa", "fpb", "na", "nb"])
    edges = [F.col("fpa").alias("a"), F.col("fpb").alias("b")]
    if whole is None:
        return judged.where(F.col("s") >= similarity).select(*edges)
    full = F.greatest("na", "nb") < SKETCH  # sketches that are the whole sets
    judged = cut_lineage(judged.where(F.col("s") >= F.when(full, similarity).otherwise(min(CLEAR_MISS, similarity))))
    unsure = judged.where(~full)
    if unsure.isEmpty():
        return judged.select(*edges)
    sets = cut_lineage(whole(unsure.select(F.explode(F.array("a", "b")).alias("item")).distinct()))
    of = lambda x: sets.select(F.col("item").alias(x), F.col("set").alias(f"set{x}"))
    exact = unsure.join(of("a"), "a").join(of("b"), "b").where(_jaccard("seta", "setb") >= similarity)
    return judged.where(full).select(*edges).unionByName(exact.select(*edges))


def _sketch_sets(held: DataFrame) -> DataFrame:
    def make():
        return lambda sketches: [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in sketches.to_pylist()], pa.list_(pa.int64()))]

    return arrow_columns(held, ["sketch"], struct(("set", T.ArrayType(T.LongType()))), make, ["item", "root"])


#: Rows whose keys are sent to all tasks rather than exchanged with the texts.
SENT_ROWS = 200_000


def _reader(items: DataFrame, rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds to rows (item, ...) the set of all shingles, from the item's text; wholly repeated rows of documents repeat it."""

    def make():
        coder = ShingleCoder()
        return lambda texts: [pa.array([coder.codes(t).view(np.int64) for t in utf8(texts)], pa.list_(pa.int64()))]

    def whole(asked: DataFrame) -> DataFrame:
        places = cut_lineage(items.select("item", "rep.__id", "rep.__row").join(asked, "item"))
        places = F.broadcast(places) if places.count() <= SENT_ROWS else places
        return arrow_columns(rows.join(places, ["__id", "__row"]), ["text"], struct(("set", T.ArrayType(T.LongType()))), make, asked.columns)

    return whole


def _with_both(docs: DataFrame, carry: list[str]) -> DataFrame:
    """docs with fingerprint, and of the five-word shingles sketch, least codes, number n and a code of their set, from one pass over the texts."""

    def make():
        coder = ShingleCoder()

        def work(texts):
            rows = utf8(texts)
            codes = [coder.codes(t) for t in rows]
            yield pa.array(np.array([simhash(t) for t in rows], np.uint64).view(np.int64))
            yield pa.array([_sketch(c) for c in codes], pa.binary())
            yield pa.array([c[:KEYS].view(np.int64) for c in codes], pa.list_(pa.int64()))
            yield pa.array([len(c) for c in codes], pa.int64())
            yield pa.array(np.array([xxhash.xxh64_intdigest(c.tobytes()) for c in codes], np.uint64).view(np.int64))

        return work

    out = struct(
        ("fingerprint", T.LongType()), ("sketch", T.BinaryType()), ("keys", T.ArrayType(T.LongType())), ("n", T.LongType()), ("item", T.LongType())
    )
    return arrow_columns(docs, ["text"], out, make, carry)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __id and __row, which tell rows of different (doc_id, text) apart."""
    return docs.withColumns({"__id": F.coalesce("doc_id", F.lit(-1)), "__row": F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text"))})


def _grouped(docs: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, __id, __row, fingerprint, ...) per row of docs, and (fingerprint, root) per fingerprint."""
    rows = _keyed(docs.select("doc_id", "text"))
    prints = cut_lineage(_with_both(rows, ["doc_id", "__id", "__row"]))
    items = cut_lineage(
        prints.groupBy("item").agg(
            F.min("fingerprint").alias("fp"), F.min("n").alias("n"), F.min(F.struct("__id", "__row")).alias("rep"),
            F.first("sketch").alias("sketch"), F.first("keys").alias("keys"),
        )
    )
    prints = prints.select("doc_id", "__id", "__row", "fingerprint", "item")
    distinct = prints.select(F.col("fingerprint").alias("fp")).distinct()
    equal = prints.join(items.select("item", "fp"), "item").where("fingerprint <> fp").select(F.col("fingerprint").alias("a"), F.col("fp").alias("b")).distinct()
    known = close_links(distinct, distance).unionByName(equal)
    linked = similar_links(items, known=known, whole=_reader(items, rows.select("text", "__id", "__row")))
    return prints, distinct.join(linked, distinct.fp == linked.a, "left").select(F.col("fp").alias("fingerprint"), F.coalesce("b", "fp").alias("root"))


def similar_groups(docs: DataFrame, distance: int = 2) -> DataFrame:
    """One row (doc_id, root) per row of docs: rows of one root are near-duplicates by the rule of drop_near_duplicates()."""
    prints, roots = _grouped(docs, distance)
    return prints.join(roots, "fingerprint").select("doc_id", "root")


def drop_near_duplicates(docs: DataFrame, distance: int = 2) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id.

    Rows are in a group if linked by fingerprints within `distance` bits or by a
    similarity of 0.8 in five-word shingles. Ties on doc_id go to one text; of wholly
    repeated (doc_id, text) rows one stays. A null doc_id wins only in a group without
    any other. Null and empty texts are one group. Long texts are read whole. All
    columns stay; texts are exchanged once, to keep the rows chosen.
    """
    prints, roots = _grouped(docs, distance)
    order = F.struct(F.col("doc_id").isNull(), F.col("__id"), F.col("__row"))
    first = prints.groupBy("fingerprint").agg(F.min(order).alias("o")).join(roots, "fingerprint").groupBy("root").agg(F.min("o").alias("o"))
    return (
        _keyed(docs)
        .join(first.select("o.__id", "o.__row"), ["__id", "__row"], "left_semi")
        .dropDuplicates(["__id", "__row"])
        .select(*[docs[c] for c in docs.columns])
    )
