"""The queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, mixing, neardup, quality, repeats, secrets, sharding, tokens, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))[1]


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_join(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_tokens(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_shard_documents": op1_shard_documents,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scan": op4_secret_scan,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_remove_repeats": op10_remove_repeats,
}


def _op4_sql() -> str:
    """Positions from the pieces between matches, as DuckDB has no match positions."""
    cut, lists = [], []
    for i, r in enumerate(secrets.RULES):
        rx = "'" + r.pattern.replace("'", "''") + "'"
        cut.append(f"list_transform(string_split_regex(t, {rx}), lambda x: length(x)) AS gap{i}, list_transform(regexp_extract_all(t, {rx}, 0), lambda x: length(x)) AS hit{i}, list_transform(regexp_extract_all(t, {rx}, {r.group}), lambda x: length(x)) AS part{i}")
        lists.append(
            f"list_filter(list_transform(range(1, len(hit{i}) + 1), lambda j: {{'s': (coalesce(list_sum(gap{i}[1:j]), 0) + coalesce(list_sum(hit{i}[1:j-1]), 0))::BIGINT,"
            f" 'p': {i}, 'n': hit{i}[j]::BIGINT, 'k': '{r.kind}', 'g': part{i}[j]}}), lambda x: x.g >= {r.least})"
        )
    base = len([r for r in secrets.RULES if r.base])
    text = "list_transform(list_sort(list_filter(f, lambda x: x.p < {n})), lambda x: x.k || ':' || x.s || ':' || (x.s + x.n))"
    counts = ", ".join(f"len(list_filter(f, lambda x: x.k = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in secrets.RULES if r.base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS MATERIALIZED (SELECT doc_id, {", ".join(cut)} FROM d),
    s AS MATERIALIZED (SELECT doc_id, {" || ".join(lists)} AS f FROM c)
    SELECT doc_id, {counts}, sha256(array_to_string({text.format(n=base)}, ',')) AS base_sha256, array_to_string({text.format(n=99)}, ',') AS spans FROM s"""


_OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(sha256('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER ()) * 1.5::DOUBLE AS whole FROM w),
b AS (SELECT x.source, x.source_size, x.weight, x.cap, x.whole, x.ratio,
        (SELECT coalesce(sum(cap), 0) FROM r y WHERE y.ratio < x.ratio) AS below, (SELECT sum(weight) FROM r y WHERE y.ratio >= x.ratio) AS upward FROM r x),
c AS (SELECT *, whole - below >= ratio * upward AS capped FROM b),
l AS (SELECT (any_value(whole) - coalesce(sum(cap) FILTER (capped), 0)) / nullif(sum(weight) FILTER (NOT capped), 0) AS level FROM c),
g AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, weight * level) END AS target FROM c, l),
t AS (SELECT d.*, g.source_size, g.target, coalesce(g.target / nullif(g.source_size, 0), 0) AS rate FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM t
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP8_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') AS s FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(j) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win), dw AS (SELECT rid, n, j, array_to_string(w[j:j + n - 1], ' ') AS s FROM d, lens, unnest(range(1, len(w) - n + 2)) t(j)),
hit AS MATERIALIZED (SELECT DISTINCT rid, dw.n, j, item_id FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
cov AS (SELECT rid, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT DISTINCT rid, n, j FROM hit) h, unnest(range(j, j + n)) u(k) GROUP BY 1),
it AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""

SQL: dict[str, str] = {"op4_secret_scan": _op4_sql(), "op5_mix_sources": _OP5_SQL, "op8_decontamination": _OP8_SQL}
