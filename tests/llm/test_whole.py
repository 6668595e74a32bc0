"""Inputs on which an operator once did less than the whole job."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from backline.llm import ann, graph, repeats, sharding, toxicity


@pytest.mark.parametrize(("groups", "spread"), [(3, 0.1), (5, 0.3), (3, 0.001)])
def test_neighbours_in_clusters(spark, groups, spread):
    """Each group holds a fifth of the rows or more; at the least spread its vectors are near copies."""
    r = np.random.default_rng(3)
    n, d = 3000, 64
    centres = r.normal(size=(groups, d))
    v = centres[np.arange(n) % groups] / np.linalg.norm(centres, axis=1)[np.arange(n) % groups, None] + spread * r.normal(size=(n, d)) / d**0.5
    v /= np.linalg.norm(v, axis=1)[:, None]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    found = {}
    for x in ann.nearest(frame, ann.F.pmod("vec_id", ann.F.lit(20)) == 0).collect():
        found.setdefault(x.query_id, set()).add(x.vec_id)
    assert sorted(found) == list(range(0, n, 20))
    scores = v[::20] @ v.T
    scores[np.arange(len(scores)), np.arange(0, n, 20)] = -np.inf
    best = np.argsort(-scores, 1)[:, :20]
    assert np.mean([len(found[20 * i] & set(row.tolist())) / 20 for i, row in enumerate(best)]) >= 0.95


def test_repeats_of_texts_with_alike_hashes(spark):
    """Different texts under one id whose hashes share 24 bits, with and without a passage of their own that repeats."""
    low = F.xxhash64("text").bitwiseAND(F.lit((1 << 24) - 1))
    texts = spark.range(30000).select(F.sha2(F.col("id").cast("string"), 512).alias("text")).withColumn("low", low)
    alike = texts.groupBy("low").agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").collect()
    assert alike
    clean = [t for r in alike for t in r.texts]
    rows = [(None, t) for t in clean] + [(7, t + "!" * 250) for t in (x.upper() for x in clean)]
    expected = []
    seen = set()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        n = max(len(t) - 99, 0)
        fresh = [t[s : s + 100] not in seen and not seen.add(t[s : s + 100]) for s in range(n)]
        gone = {p for s in range(n) if not fresh[s] for p in range(s, s + 100)}
        if i is None:
            expected.append((len(t), len(gone), hashlib.sha256("".join(c for p, c in enumerate(t) if p not in gone).encode()).hexdigest()))
    for hot in (repeats.HOT, 1):
        got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), hot).collect()
        assert len(got) == len(rows)
        assert sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in got if r.doc_id is None) == sorted(expected)
        assert {r.n_removed for r in got if r.doc_id is None} == {0}
        # Of the run of signs the first text keeps 100 bytes and the others lose all but what precedes it.
        assert sum(r.n_removed >= 250 for r in got if r.doc_id == 7) >= len(clean) - 1


def test_shards_below_a_folder_named_data(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id bigint, text string")
    store, rows = sharding.shard_documents(docs, str(tmp_path / "data" / "more" / "store"))
    assert sorted(r.doc_id for r in rows.collect()) == list(range(60))
    assert store.read(docs.schema).count() == 60 and store.vacuum() == 0


def test_fixed_toxic_phrase_of_ordinary_words(spark):
    """Each word of the phrase stands in ordinary texts too; only their order tells."""
    r = random.Random(5)
    phrase = "over the old stone bridge they all went".split()
    words = [f"w{i}" for i in range(400)] + phrase
    rows, marks = [], []
    for i in range(1600):
        text, toxic = [r.choice(words) for _ in range(80)], int(r.random() < 0.15)
        if toxic:
            at = r.randrange(60)
            text[at:at] = phrase
        rows.append((i, " ".join(text)))
        marks.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    held = [x for x in toxicity.toxicity(docs, labels).collect() if x.held_out]
    for kind in (0, 1):
        of_kind = [x.predicted == kind for x in held if marks[x.doc_id][1] == kind]
        assert sum(of_kind) / len(of_kind) > 0.95


def test_components_settle_or_fail(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {tuple(r) for r in graph.components(edges).collect()} == {(i, 0) for i in range(201)}
    with pytest.raises(RuntimeError):
        graph.components(edges, most_rounds=2)


def test_compaction_goes_on_until_no_tier_is_due():
    """Each merge fills the next tier, twelve times."""

    class Files:
        """Stands for the reader: the paths asked for are what is written next."""

        read = property(lambda self: self)
        schema = coalesce = lambda self, _: self

        def parquet(self, *paths):
            self.paths = paths
            return self

    class Store(sharding.ShardStore):
        def __init__(self):
            self.spark, self.target, self.fanout = Files(), 1 << 40, 2
            sizes = [1 << 17] + [1 << (17 + i) for i in range(12)]
            self.shards = [sharding.Shard(f"s{i}", n, 1, self.tier(n)) for i, n in enumerate(sizes)]

        def manifest(self, version=None):
            return 0, self.shards

        def commit(self, base, shards, action):
            self.shards = shards
            return base + 1

        def _write(self, frame):
            parts = [s for s in self.kept if s.path in frame.paths]
            n = sum(s.bytes for s in parts)
            new = sharding.Shard("+".join(s.path for s in parts), n, sum(s.rows for s in parts), self.tier(n))
            self.kept.append(new)
            return [new]

    store = Store()
    store.kept = list(store.shards)
    assert store.compact(None) == 12
    assert [(s.rows, s.bytes) for s in store.shards] == [(13, 1 << 29)]
