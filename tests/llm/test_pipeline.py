"""The pipeline and the near-duplicate join against brute force on planted documents."""

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from backline.llm import neardup
from backline.llm.queries import SQL

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def planted():
    """Texts by id, and the ids of toxic ones, the labels, and the benchmark."""
    r = random.Random(8)
    words = ["".join(r.choice(["ra", "lo", "mi", "te", "su", "no"]) for _ in range(3)) + str(i) for i in range(500)]
    texts = {i: [r.choice(words) for _ in range(60)] for i in range(900)}
    toxic = {i for i in texts if i % 4 == 0}
    for i in toxic:
        for at in r.sample(range(60), 8):
            texts[i][at] = r.choice(["vile", "scum", "rotten"])
    bench = [[r.choice(words) for _ in range(20)] for _ in range(5)]
    for i in range(1, 900, 20):
        texts[i][20:32] = bench[i % 5][3:15]
    for i in range(2, 900, 12):
        texts[900 + i] = list(texts[i])
        if i % 24 == 2:
            texts[900 + i][30] = "changed"
        if i in toxic:
            toxic.add(900 + i)
    return {i: " ".join(w) for i, w in texts.items()}, toxic, [" ".join(b) for b in bench]


def grams(text, n):
    w = text.split()
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}


def near(texts):
    """Pairs of ids of unlike texts with a Jaccard of 0.8 or more, and each id's component by equal or near texts."""
    sets = {i: grams(t, 5) for i, t in texts.items()}
    ids, pairs, root = sorted(texts), set(), {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both * 10 >= 8 * (len(sets[i]) + len(sets[j]) - both):
                if texts[i] != texts[j]:
                    pairs.add((i, j))
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return pairs, {i: top(i) for i in ids}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("planted"))
    texts, toxic, bench = planted()
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in texts], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_join_against_all_pairs(spark, folder):
    texts, _, _ = planted()
    pairs, root = near(texts)
    assert len(pairs) > 20
    links = Counter(i for p in pairs for i in p)
    rows = neardup.jaccard_join(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (root[i], links[i]) for i in texts}


def test_pipeline_against_brute_force(spark, folder):
    texts, toxic, bench = planted()
    left = {i: t for i, t in texts.items() if i not in toxic}
    _, root = near(left)
    left = {i: t for i, t in left.items() if root[i] == i}
    windows = set().union(*(grams(b, 10) for b in bench))
    left = {i: t for i, t in left.items() if not grams(t, 10) & windows}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, f"s{i % 3}") for i, t in left.items()])
    expected = {i: taken // size for i, size, _, _, taken in con.execute(SQL["op5_mix_sources"]).fetchall() if taken}
    assert 0 < len(expected) < len(texts)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == expected


def test_pipeline_of_odd_rows(spark, folder, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, odd column names; then no rows at all."""
    r = random.Random(3)
    long = " ".join(f"w{r.randrange(9000)}" for _ in range(30_000))
    rows = [(1, "a few plain words stand here", "en", "s0", 5, "x"), (1, "a few plain words stand here", "en", "s0", 5, "x"), (2, None, "en", "s0", 0, "x"), (3, "", None, None, None, None), (None, "words of a text without id", "en", None, 1, "x"), (4, long, "en", "s0", 9, "x"), (5, long + " end", "en", "s0", 9, "x"), (None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA + ", `a.b` string")
    for name, docs in (("odd", frame), ("none", frame.limit(0))):
        path = str(tmp_path / name)
        docs.write.parquet(f"{path}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{folder}/{table}.parquet").write.parquet(f"{path}/{table}.parquet")
        step = spark.read.parquet(f"{path}/documents.parquet")
        for stage, work in corpus_pipeline.STAGES[:-1]:
            step = work(spark, step, path)
            assert step.columns == docs.columns, stage
        ids = {x.doc_id for x in corpus_pipeline.run(spark, path).collect()}
        assert ids <= {1, 2, 3, 4, None} and (name == "none") == (not ids)
