"""corpus_pipeline.run() against brute force, stage by stage, on a small table with awkward rows."""

import os
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import bpe, decontam, quality_gam, secrets, simhash
from tests.llm.test_text_operators import _brute_hits, _library, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """Documents of the small table, near copies and awkward rows, with columns of clashing names; labels and benchmark as they are."""
    at = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng, texts = random.Random(5), [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    more, k = [(None, None, None, None, None), (None, "a row without an id that says no more than this", "en", None, 3), (70_000, "", "en", "s", 0), (70_001, None, "en", "s", None)], 80_000
    for t in texts[:25]:
        words = t.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        more += [(k, " ".join(words), "en", "s", len(t)), (k, t, "en", "s", len(t)), (k, t, "en", "s", len(t))]
        k += 1
    same = docs.unionByName(spark.createDataFrame(more, docs.schema))
    clash = {c: F.lit(7) for c in ("fingerprint", "root", "score", "ids", "features", "item", "keys", "token")}
    same.withColumns(clash).repartition(3).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return at


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def kept_good(rows, labels):
    known = {}
    for d, q in labels:
        if q in (0, 1) and d is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            known[d] = min(q, known.get(d, 1))
    seen = {}
    for d, t in rows:
        if d in known:
            x = quality_gam.features_of((t or "").encode())
            seen[d] = min(x, seen.get(d, x))
    return known, seen


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    names, functions = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality classifier", "near-dedup", "benchmark decontamination", "secret scan", "bpe encoding and decoding")

    good = functions[0](spark, docs, folder).cache()
    assert good.columns == docs.columns
    known, seen = kept_good(rows_of(docs), labels)
    order = {r.doc_id: i for i, r in enumerate(spark.createDataFrame([(d,) for d in seen], "doc_id bigint").orderBy(F.xxhash64("doc_id"), "doc_id").collect())}
    ids = sorted(seen, key=order.get)
    model = quality_gam.fit(np.array([seen[d] for d in ids]), np.array([float(known[d]) for d in ids]))
    score = lambda t: float(model.scores(np.array([quality_gam.features_of((t or "").encode())]))[0])
    key = lambda row: (row[0] is None, row[0] or 0, row[1] or "")
    assert sorted(rows_of(good), key=key) == sorted([(d, t) for d, t in rows_of(docs) if score(t) >= 0.7], key=key)

    single = functions[1](spark, good, folder).cache()
    assert single.columns == docs.columns
    texts = sorted({t or "" for _, t in rows_of(good)})
    sets, prints = [shingles(t) for t in texts], [simhash.simhash(t.encode()) for t in texts]
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root = [root[i] if r == root[j] else r for r in root]
    least = {}
    for d, t in rows_of(good):
        r = root[texts.index(t or "")]
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    left = {root[texts.index(t or "")]: (d is None, d or 0) for d, t in rows_of(single)}
    assert left == least and single.count() == len(least)

    clean = functions[2](spark, single, folder).cache()
    items = [(str(r.item_id), decontam.words_of((r.text or "").encode())) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    after = {d: t for d, t in rows_of(clean)}
    for d, t in rows_of(single):
        words = decontam.words_of((t or "").encode())
        hit, _ = _brute_hits(words, items)
        assert (d in after) == (2 * len(hit) <= len(words))
        if d in after:
            assert (after[d] == t) if not hit else decontam.words_of(after[d].encode()) == [w for i, w in enumerate(words) if i not in hit]

    safe = functions[3](spark, clean, folder).cache()
    assert safe.columns == docs.columns and safe.count() == clean.count()
    safe_texts = dict(rows_of(safe))
    for d, t in rows_of(clean):
        spans = secrets.Scanner().spans(t or "")
        assert safe_texts[d] == t if not spans else re.search(r"\[\w+ removed\]", safe_texts[d])
    assert all(not secrets.Scanner().spans(t or "") for t in safe_texts.values())

    last = functions[4](spark, safe, folder).collect()
    pick = lambda found: sorted((r.doc_id or -1, r.n_tokens, tuple(r.input_ids), r.decoded) for r in found)
    assert pick(corpus_pipeline.run(spark, folder).collect()) == pick(last)
    lib = _library()
    assert {r.doc_id for r in last} == set(safe_texts) and len(last) == safe.count()
    for r in last:
        ids = lib.encode(safe_texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.input_ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_run_of_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_tokens", "input_ids", "decoded"]


def test_checkpoint_folder_of_a_cluster_must_be_named(monkeypatch):
    from driftline.llm import common

    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError):
        common.shared_folder(Session)
    assert os.path.isabs(bpe.default_path())
