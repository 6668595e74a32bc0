"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies.

Tokens are summed per source, a source's target is its share of the mix, capped at
``max_repeats`` times the source, and a document is taken floor(rate) times plus once more
with probability equal to the fraction, decided by a hash of its id and text.

Null texts have size 0; a null source is a source of its own, ordered last; a null id is drawn
by its text; repeated rows draw alike; sources without words get target 0; very long texts are counted whole in the JVM; other
columns, whatever their names, are carried; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, own_columns, plain_text

#: Weights of the sources, repeated in their order.
WEIGHTS = (5, 2, 1)
SHARE, MAX_REPEATS, SEED = 1.5, 2, 17


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII spaces, as bigint."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Targets are shared by weight, and what exceeds a source's cap is shared anew among the
    others until none is above. The closed form: sources in the order of cap/weight; one is
    capped if the level that all later ones would get is above its own. The two windows
    hold one row per source, not per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio")
    whole = Window.partitionBy()
    rows = sizes.withColumn("place", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int") + 1))
    rows = rows.withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("all_size", F.sum("source_size").over(whole) * F.lit(float(share)))
    lower = by_ratio.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("cap_to", F.sum("cap").over(lower)).withColumn("weight_to", F.sum("weight").over(lower)).withColumn("weight_all", F.sum("weight").over(whole))
    same = Window.partitionBy("ratio")
    rows = rows.withColumn("cap_below", F.col("cap_to") - F.sum("cap").over(same)).withColumn("weight_from", F.col("weight_all") - F.col("weight_to") + F.sum("weight").over(same))
    rows = rows.withColumn("capped", F.col("all_size") - F.col("cap_below") >= F.col("ratio") * F.col("weight_from"))
    rows = rows.withColumn("rest", F.col("all_size") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(whole))
    rows = rows.withColumn("open", F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(whole))
    level = F.col("weight") * F.try_divide(F.col("rest"), F.col("open"))
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", level)).alias("target"))


def draw(seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the document's id and text alone."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(plain_text()))
    return F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("double") / float(16**12)


def mix_plan(documents: DataFrame, seed: int = SEED, **targets) -> DataFrame:
    """``documents`` (whose other columns must not bear these names) with size, source_size, target and copies.

    One pass sums the sizes by source with map-side combining. The per-source table is written
    and reread, so the planner sees its true size: under the broadcast threshold no document is
    shuffled at all, beyond it the rows meet in a sort-merge join whose hot keys AQE splits.
    """
    sized = documents.withColumn("size", word_count(plain_text()))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialise(source_targets(sums, **targets).select(key.alias("_key"), "source_size", "target"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = sized.withColumn("_key", key).withColumn("_draw", draw(seed)).join(goal, "_key", "left")
    return rows.withColumn("copies", (F.floor(rate) + F.when(F.col("_draw") < rate - F.floor(rate), 1).otherwise(0)).cast("int")).drop("_key", "_draw")


def mix(documents: DataFrame, seed: int = SEED, **targets) -> DataFrame:
    """The mixed corpus: every document as often as its number of copies says, with its own columns whatever their names."""
    rows = documents.select("doc_id", "text", "source", F.struct(*own_columns(documents)).alias("doc"))
    plan = mix_plan(rows, seed, **targets).where("copies > 0")
    return plan.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The digest of op5: one row per document with the words that the mix takes."""
    plan = mix_plan(documents.select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
