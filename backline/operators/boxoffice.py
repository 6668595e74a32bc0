"""Box office: sell-through against rooms of the same size, gross projections and what makes them uncertain, refits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .models import gross_curve

# Bands of a room's percentile and the residuals' percentiles that a refit can aim at.
PERFORMANCE_BANDS = ["bottom 10%", "bottom quarter", "below average", "above average", "top quarter", "top 10%"]
PLACES = [0.10, 0.25, 0.50, 0.75, 0.90]
UNKNOWN_TARGET = 2.3
LEAST_CAPACITY = 500


def quantile_bin(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin`` of each row among ``bins`` quantiles of a column: right-closed, the lowest edge included, equal edges one.

    The edges are one row, read by the driver; exact percentiles.
    """
    at = [i / bins for i in range(bins + 1)]
    edges = rows.agg(F.percentile(value, F.array(*[F.lit(a) for a in at])).alias("e")).first()["e"]
    edges = sorted(set(edges or []))
    out = F.lit(None).cast("int")
    for i, top in reversed(list(enumerate(edges[1:]))):
        out = F.when(F.col(value) <= float(top), i).otherwise(out)
    return rows.withColumn("bin", F.when(F.col(value) >= float(edges[0]), out) if len(edges) > 1 else F.lit(None).cast("int"))


def performance(venues: DataFrame, least_events: int = 5) -> DataFrame:
    """Venues with their sell-through in percent against the median of rooms of their size, and the percentile of the difference.

    venues: venue, capacity, pct, events. Sizes are quantile bins of the log capacity, 2 to 10 by number of venues; no fitted curve,
    as the relation isn't monotonic.
    """
    v = venues.where((F.col("capacity") >= LEAST_CAPACITY) & F.col("pct").between(0, 100) & (F.col("events") >= least_events)).withColumn("_x", F.log("capacity"))
    bins = min(10, max(2, v.count() // 40))
    v = quantile_bin(v, "_x", bins)
    typical = v.groupBy("bin").agg(F.percentile("pct", F.lit(0.5)).alias("expected_pct"))
    v = v.join(F.broadcast(typical), "bin").withColumn("residual_pp", F.round(F.col("pct") - F.col("expected_pct"), 2))
    v = v.withColumn("_all", F.lit(0)).withColumn("percentile", F.round(S.percent_rank_average(["_all"], "residual_pp"), 3))
    band = F.lit(PERFORMANCE_BANDS[0])
    for at, name in zip(PLACES, PERFORMANCE_BANDS[1:], strict=True):
        band = F.when(F.col("percentile") >= at, name).otherwise(band)
    return v.withColumn("band", band).drop("_x", "_all")


def residuals(shows: DataFrame, least_events: int = 20, bins: int = 20) -> DataFrame:
    """Venues' mean difference of sell-through from the median of shows in rooms of their size, for ``least_events`` shows or more.

    shows: venue, capacity, pct (over 0, to 100).
    """
    d = quantile_bin(shows.where((F.col("pct") > 0) & (F.col("pct") <= 100) & (F.col("capacity") > 0)).withColumn("_x", F.log("capacity")), "_x", bins)
    typical = d.groupBy("bin").agg(F.percentile("pct", F.lit(0.5)).alias("expected_pct"))
    d = d.join(F.broadcast(typical), "bin")
    v = d.groupBy("venue").agg(F.count(F.lit(1)).alias("shows"), F.avg(F.col("pct") - F.col("expected_pct")).alias("residual"), F.avg("pct").alias("pct"), F.percentile("capacity", F.lit(0.5)).alias("capacity"))
    return v.where(F.col("shows") >= least_events)


def targets(rated: DataFrame) -> DataFrame:
    """One row: the residual at each percentile that a refit can aim at."""
    return rated.agg(*[F.round(F.percentile("residual_pp", F.lit(p)), 2).alias(f"p{round(100 * p)}") for p in PLACES])


def project(capacity: Column, points: Column, low: Column, high: Column, slope: float, intercept: float, sigma: float) -> list[Column]:
    """Gross of a range of further visits: quartiles at its ends, medians between."""
    median, p25, p75 = (c for c in gross_curve(capacity, points, slope, intercept, sigma))
    return [(low * p25).alias("low"), (low * median).alias("central_low"), (high * median).alias("central_high"), (high * p75).alias("high")]


def uncertainty(low: Column, high: Column, sigma: float) -> list[Column]:
    """How many times the ends of visits and of a show's gross differ, and the share of visits in the logarithm of the whole span."""
    visits = F.try_divide(high, F.when(low > 0, low))
    gross = float(np.exp(2 * 0.6745 * sigma))
    share = F.try_divide(F.log(visits), F.log(visits) + float(np.log(gross)))
    return [F.round(visits, 2).alias("visits_factor"), F.round(F.lit(gross), 2).alias("gross_factor"), F.round(share, 3).alias("visits_share")]


def refurbish(rated: DataFrame, slope: float, intercept: float, sigma: float, percentile: float = 0.75) -> DataFrame:
    """What a room of each venue would gross a show at a percentile of sell-through, if it is below; rooms above it gain nothing."""
    name = f"p{round(100 * percentile)}"
    aim = targets(rated)
    goal = F.coalesce(name, F.lit(UNKNOWN_TARGET)) if name in aim.columns else F.lit(UNKNOWN_TARGET)
    rows = rated.crossJoin(F.broadcast(aim.select(goal.alias("target_pp"))))
    rows = rows.withColumn("gain_pp", F.greatest(F.col("target_pp") - F.col("residual_pp"), F.lit(0.0)))
    gross = lambda points: gross_curve(F.col("capacity"), points, slope, intercept, sigma)[0]
    rows = rows.withColumn("gross_before", gross(F.col("residual_pp"))).withColumn("gross_after", gross(F.col("residual_pp") + F.col("gain_pp")))
    return rows.withColumn("uplift", F.col("gross_after") - F.col("gross_before"))


def to_gbp(money: Column, rate: Column) -> Column:
    """Dollars at a rate of dollars a pound, to pence; nothing without money or rate."""
    return F.round(F.try_divide(money, rate), 2)


def half_scores(shows: DataFrame, unit: str, value: str, order: list[str]) -> DataFrame:
    """Each unit's mean over its odd and over its even rows in order."""
    nth = F.row_number().over(Window.partitionBy(unit).orderBy(*order)) - 1
    return shows.withColumn("_h", nth % 2).groupBy(unit).agg(F.avg(F.when(F.col("_h") == 0, F.col(value))).alias("even"), F.avg(F.when(F.col("_h") == 1, F.col(value))).alias("odd"))
