"""Inputs that once broke an operator or cost it rows: odd names, very long texts, hot keys, several blocks, other writers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from backline.llm import ann, common, decontam, mixing, neardup, quality, repeats, secrets, sharding, tokens, toxicity

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string, `c``d` string, _metadata string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ra", "lo", "mi", "te", "su", "no", "ké"]) for _ in range(r.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Columns whose names hold dots and quotes or hide Spark's own."""
    rows = [(i, words(i % 7, 60) + (" vile" if i % 3 else ""), "en", f"s{i % 2}", 9, "x.y", "q", "mine") for i in range(14)]
    return spark.createDataFrame(rows, ODD).repartition(2)


def test_odd_column_names(spark, odd, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 > 0)) for i in range(14)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "no such words stand in any of the texts at all here")], "item_id bigint, text string")
    for frame in (toxicity.reject_toxic(odd, labels), neardup.keep_one(odd), decontam.decontaminate(odd, bench), mixing.mix(odd)):
        assert frame.columns == odd.columns
        assert {(r["a.b"], r["c`d"], r["_metadata"]) for r in frame.collect()} <= {("x.y", "q", "mine")}
    assert decontam.decontaminate(odd, bench).count() == 14
    store, rows = sharding.shard_documents(odd, str(tmp_path / "odd"))
    assert sorted(r.doc_id for r in rows.collect()) == list(range(14)) and store.read(odd.schema).exceptAll(odd).count() == 0


@pytest.fixture(scope="module")
def giant(spark):
    """Texts of about two megabytes, one all blank."""
    prose = words(1, 300_000)
    rows = [(1, " " * 2_000_000), (2, "\n" * 1_999_999 + "end"), (3, prose), (4, prose + " more"), (5, "a" * 1_500_000), (6, "password=abcdefghijklmnop " + prose), (7, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.lit("s"))


def test_giant_texts(spark, giant, tmp_path):
    enc = tokens.encoder(f"{tokens.VOCABULARIES}/{tokens.VOCABULARY}")
    counts = {r.doc_id: r.n_tokens for r in tokens.document_tokens(giant).collect()}
    assert counts[1] == len(enc._encode_single_piece(" " * 2_000_000)) and counts[7] == 0
    assert counts[2] == len(enc._encode_single_piece("\n" * 1_999_998)) + len(enc.encode_ordinary("\nend"))
    got = {r.doc_id: r for r in neardup.jaccard_join(giant).collect()}
    assert got[3].class_id == got[4].class_id == got[6].class_id == 3 and got[3].n_links == 2 and got[5].n_links == 0
    bench = spark.createDataFrame([(9, " ".join(words(1, 300_000).split()[-12:]))], "item_id bigint, text string")
    hit = {r.doc_id: r.n_hit for r in decontam.contamination(giant, bench).collect()}
    assert hit[3] >= 12 and hit[4] >= 12 and hit[1] == hit[2] == hit[5] == hit[7] == 0
    removed = {r.doc_id: r for r in repeats.remove_repeats(giant).collect()}
    assert removed[1].n_removed == 2_000_000 - 1 and removed[5].n_removed == 1_500_000 - 1 and removed[3].n_removed == 0
    size = len(words(1, 300_000).encode())
    assert removed[4].n_removed == removed[6].n_removed == size
    assert {r.doc_id: r.n_assign for r in secrets.secret_spans(giant).collect()}[6] == 1
    plan = {r.doc_id: r["size"] for r in mixing.mixed_documents(giant).collect()}
    assert plan[3] == 300_000 and plan[1] == 0 and plan[5] == 1
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(giant, labels).count() == quality.quality(giant, labels).count() == 7
    assert sharding.shard_documents(giant, str(tmp_path / "giant"))[1].count() == 7


@pytest.mark.parametrize("text", [" " * 99_999, " " * 150_000 + "x", "a" + "\t" * 120_000 + " b  c", "x" + " " * 100_000, "\u3000" * 110_000 + "é"])
def test_long_blanks_as_the_pattern_has_them(text):
    enc = tokens.encoder(f"{tokens.VOCABULARIES}/{tokens.VOCABULARY}")
    assert tokens.encode_whole(enc, text) == enc.encode_ordinary(text)


def test_similar_texts_parted_in_trie_order(spark, monkeypatch):
    """Texts that share most words with all and nearly all with one: each finds its own among the others below the same prefixes."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(40):
        own = list(base)
        for at in range(i % 5, 300, 25):
            own[at] = f"x{i}"
        twin = list(own)
        twin[r.randrange(300)] = "twin"
        texts += [" ".join(own), " ".join(twin)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [{tuple(t.split()[j : j + 5]) for j in range(296)} for t in texts]
    expected = {i: sum(len(a & b) * 10 >= 8 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    assert min(expected.values()) >= 1
    monkeypatch.setattr(neardup, "WIDE_BLOCK", 8)
    monkeypatch.setattr(neardup, "LEAST_ESTIMATE", 0.67)
    assert {x.doc_id: x.n_links for x in neardup.jaccard_join(frame).collect()} == expected


def test_hot_window_spreads(spark):
    """Of a passage that all texts hold the removed windows carry keys of their own documents, not the passage's."""
    passage = words(3, 80)
    batches = [(f"{words(100 + i, 5)} {passage} {words(200 + i, 5)}", i) for i in range(50)]
    import pyarrow as pa

    found = [{"key": 7, "place": repeats._packed(np.array([t.encode().index(passage.encode())]), np.array([300]))[0].item(), "hot": True} for t, _ in batches]
    batch = pa.RecordBatch.from_arrays([pa.array([i for _, i in batches]), pa.array([i * 31 for _, i in batches]), pa.array([t.encode() for t, _ in batches], pa.binary()), pa.array([[w] for w in found])], names=["doc", "hash", "text", "wanted"])
    out = pa.Table.from_batches(list(repeats._fetch(iter([batch]))))
    gone = out.filter(out["bytes"].is_null())
    assert out.num_rows == 50 * 201 and gone.num_rows == 49 * 201
    assert len(set(gone["key"].to_pylist())) == 49 and len(set(out.filter(out["bytes"].is_valid())["key"].to_pylist())) == 201


def test_vectors_of_several_lengths_and_repeated_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8 if i % 3 else 5).tolist()) for i in range(120)] + [(20, [1.0] * 8)] * 2 + [(0, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    expected = []
    for a, (q, v) in enumerate(rows):
        if q % 20 == 0:
            others = sorted((-float(np.dot(v, w)), i) for b, (i, w) in enumerate(rows) if b != a and len(w) == len(v))[:20]
            expected += [(q, k + 1, i, round(-s, 9)) for k, (s, i) in enumerate(others)]
    got = [(x.query_id, x.rank, x.vec_id, round(x.score, 9)) for x in ann.nearest_neighbours(frame).collect()]
    assert sorted(got) == sorted(expected)


def test_neighbours_among_vectors_without_structure(spark):
    """Gaussian vectors, where a narrow search finds too little: shards widen it by their own measure."""
    v = np.random.default_rng(6).normal(size=(3000, 64))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    found = {}
    for x in ann.nearest_neighbours(frame).collect():
        found.setdefault(x.query_id, set()).add(x.vec_id)
    scores = v[::20] @ v.T
    scores[np.arange(len(scores)), np.arange(0, 3000, 20)] = -np.inf
    best = np.argsort(-scores, 1)[:, :20]
    assert np.mean([len(found[20 * i] & set(row.tolist())) / 20 for i, row in enumerate(best)]) >= 0.9


def test_vacuum_and_conflicts(spark, odd, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "two"), target_bytes=1 << 20, fanout=2)
    store.append(odd)
    written = store._write(odd)  # by a writer that has not committed yet
    assert store.vacuum() == 0
    version, shards = store.manifest()
    commit, tried = store.commit, []

    def beaten(base, new, action):
        if not tried:
            tried.append(base)
            commit(base, shards + written, "append")  # the other writer is first
        return commit(base, new, action)

    store.commit = beaten
    assert store.append(odd) == version + 2 and store.read(odd.schema).count() == 3 * 14
    store.commit = commit
    store.compact(odd.schema)
    assert store.read(odd.schema).count() == 3 * 14
    store._write(odd)
    assert store.vacuum(keep=1) > 0 and store.read(odd.schema).count() == 3 * 14
    assert store.vacuum(keep=1, least_age=0) > 0 and store.read(odd.schema).count() == 3 * 14


def test_label_sample_of_any_size(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    n = toxicity.label_sample(labels, "toxic", F.lit(True), 500).count()
    assert 400 < n < 600 and toxicity.label_sample(labels, "toxic", F.lit(True), 20_000).count() == 20_000


def test_shared_store_is_asked_for_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(RuntimeError):
        common.scratch_dir(Session)


def test_token_files_of_several_blocks(spark, tmp_path):
    r = np.random.default_rng(5)
    for name, n in (("one", 5000), ("two", 1), ("three", 0)):
        r.integers(0, 40, n).astype("<u2").tofile(tmp_path / f"{name}.bin")
    got = tokens.count_tokens(tokens.read_token_files(spark, str(tmp_path), 64), separator=7).collect()
    for name, n in (("one", 5000), ("two", 1), ("three", 0)):
        ids = np.fromfile(tmp_path / f"{name}.bin", "<u2")
        ends = np.flatnonzero(ids == 7)
        sizes = np.diff(np.concatenate(([-1], ends))) - 1
        tail = len(ids) - (ends[-1] + 1 if len(ends) else 0)
        expected = sizes.tolist() + [tail] * int(tail > 0)
        assert [x.n_tokens for x in sorted((x for x in got if x.file.endswith(f"{name}.bin")), key=lambda x: x.ordinal)] == expected
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        tokens.read_token_files(spark, str(tmp_path))


def test_single_windows_need_no_transform(spark, monkeypatch):
    """Windows of crowded keys are equal or share nothing: no transform, whatever batches cut a key."""
    import pyarrow as pa

    r = np.random.default_rng(8)
    text = [bytes(r.integers(0, 256, repeats.LEAST, np.uint8)) for _ in range(40)]
    # Key 5 has two contents; of each equal window all but the first go, and a row met twice is one row.
    rows = sorted([(i, 100 + i, 1, i << 9 | repeats.LEAST, t) for i, t in enumerate(text)] + [(i, d, 2, i << 9 | repeats.LEAST, text[i]) for i in range(5, 15) for d in (7, 7, 300)] + [(5, 9, 3, repeats.LEAST, text[39])])
    names = ["key", "doc", "hash", "place", "bytes"]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[at : at + 3]], pa.binary() if i == 4 else pa.int64()) for i in range(5)], names=names) for at in range(0, len(rows), 3)]
    monkeypatch.setattr(repeats, "shared_runs", None)
    got = [tuple(x.values()) for b in repeats._expand(iter(batches)) for x in b.to_pylist()]
    assert sorted(got) == sorted((d, h, i << 9 | repeats.LEAST) for i in range(5, 15) for d, h in ((100 + i, 1), (300, 2)))


def test_repeated_rows_of_crowded_keys(spark):
    """Rows with equal id and text keep what the text keeps, whether their keys are crowded or not."""
    shared = words(5, 40)
    rows = [(i, f"{words(20 + i, 20)} {shared} {words(60 + i, 20)}") for i in range(4)] * 2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    plain, crowded = (sorted(map(tuple, repeats.remove_repeats(frame, hot).collect())) for hot in (repeats.HOT, 1))
    assert plain == crowded
    assert min(x[2] for x in plain if x[0] == 0) == 0
