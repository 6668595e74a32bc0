"""Artist categorisation: resolve audience, rank and genre by name, then decide type, tier and basis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T

TENANT_DATES, TENANT_HOME = 8, 4


def _lookups(table: DataFrame, value: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Values by exact key, and by normalised key of the best placed row."""
    keyed = table.where(F.col(value).isNotNull()).withColumn("_norm", T.norm_key(F.col("artist_key")))
    first = F.row_number().over(Window.partitionBy("_norm").orderBy("place", "artist_key"))
    exact = keyed.groupBy("artist_key").agg(F.min_by(value, "place").alias(f"{name}_exact"))
    norm = keyed.withColumn("_n", first).where("_n = 1").select("_norm", F.col(value).alias(f"{name}_norm"))
    return exact, norm


def categorise(artists: DataFrame, audience: DataFrame, charts: DataFrame, genres: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row per artist (artist_key, name, shows, venues, most_at_one) with type, category, basis and how it was matched.

    audience (artist_key, listeners, place), charts (artist_key, chart_rank, place), genres (artist_key, genre, place)
    are looked up by manual alias (name, artist_key), exact key, then normalised key; genre decides sport and
    family shows before tiers.
    """
    rows = artists.withColumn("_norm0", T.norm_key(F.col("name")))
    if aliases is not None:
        manual = aliases.select(T.norm_key(F.col("name")).alias("_norm0"), F.col("artist_key").alias("_manual")).dropDuplicates(["_norm0"])
        rows = rows.join(manual, "_norm0", "left")
    else:
        rows = rows.withColumn("_manual", F.lit(None).cast("string"))
    rows = rows.withColumn("artist_key", F.coalesce("_manual", "artist_key")).withColumn("_norm", F.when(F.col("_manual").isNotNull(), T.norm_key(F.col("_manual"))).otherwise(F.col("_norm0")))
    for table, value, name in ((audience, "listeners", "l"), (charts, "chart_rank", "r"), (genres, "genre", "g")):
        exact, norm = _lookups(table, value, name)
        rows = rows.join(exact, "artist_key", "left").join(norm, "_norm", "left")
    listeners, rank, genre = F.coalesce("l_exact", "l_norm"), F.coalesce("r_exact", "r_norm"), F.coalesce("g_exact", "g_norm")
    exact = F.col("l_exact").isNotNull() | (F.col("l_norm").isNull() & F.col("r_exact").isNotNull())
    method = F.when(F.col("_manual").isNotNull(), "manual").when(exact, "exact").when(F.col("l_norm").isNotNull() | F.col("r_norm").isNotNull(), "norm").otherwise("none")
    rows = rows.withColumn("listeners", listeners).withColumn("chart_rank", rank).withColumn("genre", genre).withColumn("match_method", method).withColumn("genre_class", T.genre_class(genre))
    tenant = (F.col("shows") >= TENANT_DATES) & (F.col("most_at_one") >= TENANT_HOME)
    sport, music = F.col("genre_class") == "Sport", F.col("genre_class") == "Music"
    tier = F.concat(F.lit("Category "), S.classify_tier(F.col("listeners"), F.col("chart_rank")))
    category = F.when(sport & tenant, T.SPORT_TYPES[0]).when(sport, T.SPORT_TYPES[1]).when(~music, T.OTHER_TYPE).otherwise(tier)
    basis = F.when(sport, F.format_string("Sport: %d dates, %d at one venue", "shows", "most_at_one")).when(~music, F.concat(F.lit("Genre: "), "genre")).otherwise(F.concat_ws(", ", F.format_string("%s listeners", F.col("listeners").cast("string")), F.format_string("rank %s", F.col("chart_rank").cast("string"))))
    rows = rows.withColumn("category", category).withColumn("event_type", F.when(music, "Artist").otherwise(F.col("category"))).withColumn("basis", basis)
    last = F.row_number().over(Window.partitionBy("artist_key").orderBy(F.desc("name")))
    return rows.withColumn("_n", last).where("_n = 1").select("artist_key", "name", "event_type", "category", "basis", "listeners", "chart_rank", "genre", "genre_class", "shows", "venues", "match_method")


def verify(artists: DataFrame, sheet: DataFrame) -> DataFrame:
    """Artists whose category differs from the sheet's (artist_key, category); empty when the rules reproduce it."""
    return artists.join(sheet.select("artist_key", F.col("category").alias("expected")), "artist_key").where(~F.col("category").eqNullSafe(F.col("expected"))).select("artist_key", "category", "expected")


def suspects(nights: DataFrame, big: int, few: int) -> DataFrame:
    """Acts with many nights in big venues but on few of them: likely tenants or misnamed."""
    large = nights.groupBy("venue_no").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= big).select("venue_no")
    rows = nights.join(large, "venue_no", "left_semi").groupBy("artist_key").agg(F.count(F.lit(1)).alias("nights"), F.countDistinct("venue_no").alias("venues"))
    return rows.where(F.col("venues") <= few)


def commonest_spelling(names: DataFrame, key: str, spelling: str) -> DataFrame:
    """The most used spelling of each key with its uses; of ties the first by name."""
    uses = names.groupBy(key, spelling).agg(F.count(F.lit(1)).alias("uses"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("uses"), spelling))
    return uses.withColumn("_n", first).where("_n = 1").drop("_n")
