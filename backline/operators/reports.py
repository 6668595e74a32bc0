"""Reports: top venues, pivots, funnels, seasonality, bands, yearly changes, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .identity import written


def ranked(rows: DataFrame, *order) -> DataFrame:
    """Rows with their place in ``order`` (which must be total), numbered by partition.

    Rows are range-partitioned and written in order; each partition numbers its own and adds the numbers before it, so no task
    sees more than a partition and a row a partition.
    """
    part = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = part.withColumn("place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(before, "_part").withColumn("place", (F.col("place") + F.col("_before")).cast("int")).drop("_part", "_before")


def top_venues(events: DataFrame) -> DataFrame:
    """Venues by number of events, with the smallest of the commonest values of kind and city, headliners and span."""
    v = events.groupBy("venue_key").agg(
        F.min("venue").alias("venue"),
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("headliner_key").alias("headliners"),
        F.max("capacity").alias("capacity"),
        F.mode("io", True).alias("io"),
        F.mode("city", True).alias("city"),
        F.min("date_iso").alias("first_date"),
        F.max("date_iso").alias("last_date"),
    )
    return ranked(v, F.desc("events"), "venue_key")


def pivot_counts(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Counts by key and a fixed list of values, 0 where none; null keys left out."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count(F.lit(1)).alias("all"))


def seasonality(events: DataFrame, unit: str) -> DataFrame:
    """Events and shares for each of the 12 months, 366 days or 7 weekdays (from Monday), all of them listed."""
    day = S.day(F.col("date_iso"))
    n, at = {"month": (12, F.month(day)), "day": (366, F.dayofyear(day)), "weekday": (7, F.weekday(day) + 1)}[unit]
    counts = events.where(day.isNotNull()).groupBy(at.alias(unit)).agg(F.count(F.lit(1)).alias("events"))
    spark = events.sparkSession
    calendar = spark.range(1, n + 1).select(F.col("id").cast("int").alias(unit))
    rows = calendar.join(F.broadcast(counts), unit, "left").withColumn("events", F.coalesce("events", F.lit(0)))
    return rows.withColumn("share", F.round(F.try_divide(F.col("events"), F.sum("events").over(Window.partitionBy())), 5))


def banded(events: DataFrame, value: Column, bands: list[tuple[int, str]]) -> DataFrame:
    """Every band with events, venues and headliners, shares of the known and of all."""
    rows = events.groupBy(S.band(value, bands).alias("band")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("venue_key").alias("venues"), F.countDistinct("headliner_key").alias("headliners"))
    labels = [*[b for _, b in bands], "capacity unknown"]
    order = events.sparkSession.createDataFrame([(i, b) for i, b in enumerate(labels)], "place int, band string")
    out = order.join(F.broadcast(rows), "band", "left").fillna(0, ["events", "venues", "headliners"])
    whole = Window.partitionBy()
    known = F.sum(F.when(F.col("band") != "capacity unknown", F.col("events"))).over(whole)
    share = F.when(F.col("band") != "capacity unknown", F.round(F.try_divide(F.col("events"), known), 4))
    return out.withColumn("of_known", share).withColumn("of_all", F.round(F.try_divide(F.col("events"), F.sum("events").over(whole)), 4))


def yearly(events: DataFrame) -> DataFrame:
    """Events and headliners by year with the change on the year before."""
    y = events.groupBy(F.substring("date_iso", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("headliner_key").alias("headliners"))
    before = F.lag("events").over(Window.orderBy("year"))
    return y.withColumn("change", F.round(F.try_divide(F.col("events").cast("double"), before) - 1, 4))


def tour_frame(events: DataFrame, area: Column) -> DataFrame:
    """Per tour: shows in all and in the area by kind, whether it plays either kind there."""
    rows = events.where(S.not_blank(F.col("tour"))).withColumn("_in", area)
    of = lambda io: F.count_if(F.col("_in") & (F.col("io") == io))
    return rows.groupBy("tour").agg(
        F.count(F.lit(1)).alias("shows"),
        F.count_if(F.col("io") == "inside").alias("inside"),
        F.count_if(F.col("io") == "outside").alias("outside"),
        F.count_if("_in").alias("area_shows"),
        of("inside").alias("area_inside"),
        of("outside").alias("area_outside"),
        (of("inside") > 0).cast("int").alias("plays_inside"),
        (of("outside") > 0).cast("int").alias("plays_outside"),
        F.countDistinct("city").alias("cities"),
    )


def funnel(tours: DataFrame) -> DataFrame:
    """Segments of tours and those that come to the area, with ratios."""
    part = lambda name, keep: tours.where(keep).agg(F.count(F.lit(1)).alias("tours"), F.count_if(F.col("area_shows") > 0).alias("came"), F.sum("shows").alias("shows")).withColumn("segment", F.lit(name))
    rows = part("all", F.lit(True)).unionByName(part("indoor", F.col("inside") > F.col("outside"))).unionByName(part("outdoor", F.col("outside") > F.col("inside")))
    return rows.withColumn("rate", F.round(F.try_divide(F.col("came"), F.col("tours")), 4)).select("segment", "tours", "came", "shows", "rate")


def skipped_tours(visits: DataFrame, country: str, city: str) -> DataFrame:
    """Tours that played the country but not the city: shows, cities, kind, typical rooms."""
    here = visits.where((F.col("country") == country) & (F.col("city") == city)).select("tour").distinct()
    rows = visits.where(F.col("country") == country).join(here, "tour", "left_anti")
    rows = rows.groupBy("tour").agg(
        F.sum("shows").alias("shows"),
        F.count(F.lit(1)).alias("cities"),
        F.sum("indoor").alias("indoor"),
        F.sum("outdoor").alias("outdoor"),
        F.percentile("largest", F.lit(0.5)).alias("typical_room"),
        F.percentile("largest_indoor", F.lit(0.5)).alias("typical_indoor"),
        F.percentile("largest_outdoor", F.lit(0.5)).alias("typical_outdoor"),
        F.min("first_date").alias("first_date"),
    )
    return rows.withColumn("plays", F.when(F.col("indoor") > F.col("outdoor"), "indoor").when(F.col("outdoor") > F.col("indoor"), "outdoor").otherwise("either"))


def area_legs(legs: DataFrame, country: str, cities: list[str]) -> DataFrame:
    """Legs that touch an area of a country: from, to, whether within, leaving or arriving, and how many. Places abroad bear their country."""
    inside = lambda c, k: F.coalesce((F.col(k) == country) & F.col(c).isin(cities), F.lit(False))
    name = lambda c, k: F.when(F.col(k) == country, F.col(c)).otherwise(F.concat(c, F.lit(" ("), k, F.lit(")")))
    rows = legs.where("city <> to_city").withColumn("_o", inside("city", "country")).withColumn("_d", inside("to_city", "to_country")).where("_o OR _d")
    direction = F.when(F.col("_o") & F.col("_d"), "within").when(F.col("_o"), "leaving").otherwise("arriving")
    return rows.groupBy(name("city", "country").alias("origin"), name("to_city", "to_country").alias("dest"), direction.alias("direction")).agg(F.count(F.lit(1)).alias("legs"))


def gross_bands(runs: DataFrame, edges: list[int] = S.GROSS_BANDS) -> DataFrame:
    """Gross by right-closed capacity band: count, median and quartiles, to one decimal."""
    q = lambda p, n: F.round(F.percentile("gross_usd", F.lit(p)), 1).alias(n)
    return runs.withColumn("band", S.right_closed(F.col("avg_capacity"), edges)).where("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("runs"), q(0.5, "median"), q(0.25, "p25"), q(0.75, "p75"))
