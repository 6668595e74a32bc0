"""Geospatial and market analytics: catchments, folding, gaps, verdicts, peers, cases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

RADII = (10, 30, 60, 90, 120)


def radius_catchment(cities: DataFrame, points: DataFrame, radii: tuple[int, ...] = RADII) -> DataFrame:
    """Population of a country's points within each radius of a city; null where the country has no points.

    Points and cities meet by one-degree cells around the city up to the largest radius, not all with all.
    """
    reach = max(radii) / 111.0
    c = cities.select("country", "city", "lat", "lon")
    wide = F.least(F.lit(180.0), reach / F.greatest(F.cos(F.radians(F.abs(F.col("lat")) + reach)), F.lit(0.001)))
    cells = lambda mid, by: F.sequence(F.floor(mid - by).cast("int"), F.floor(mid + by).cast("int"))
    c = c.withColumn("_y", F.explode(cells(F.col("lat"), F.lit(reach)))).withColumn("_x", F.explode(cells(F.col("lon"), wide)))
    p = points.select("country", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "population", F.floor("lat").cast("int").alias("_y"), F.floor("lon").cast("int").alias("_x"))
    near = c.join(p, ["country", "_y", "_x"]).withColumn("_km", S.haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    sums = near.where(F.col("_km") <= max(radii)).groupBy("country", "city").agg(*[F.sum(F.when(F.col("_km") <= r, F.col("population"))).alias(f"pop_{r}") for r in radii])
    covered = points.select("country").distinct().withColumn("_covered", F.lit(True))
    rows = cities.select("country", "city").join(sums, ["country", "city"], "left").join(covered, "country", "left")
    return rows.select("country", "city", *[F.when(F.col("_covered"), F.coalesce(f"pop_{r}", F.lit(0).cast("bigint"))).alias(f"pop_{r}") for r in radii])


def nearest_market(points: DataFrame, markets: DataFrame, most_km: float = 150.0) -> DataFrame:
    """Each point's nearest market of its country within ``most_km``; ties go to the market of least name."""
    m = markets.select("country", F.col("city").alias("market"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    reach = most_km / 111.0
    cells = lambda mid, by: F.sequence(F.floor(mid - by).cast("int"), F.floor(mid + by).cast("int"))
    # Markets are few: they are spread over the cells within reach, and a point has one. Longitudes meet across 180 degrees.
    around = F.transform(cells(F.col("_lon"), F.least(F.lit(180.0), reach / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("_lat")) + reach, F.lit(90.0)))), F.lit(0.001)))), lambda x: F.pmod(x + 180, F.lit(360)))
    m = m.withColumn("_y", F.explode(cells(F.col("_lat"), F.lit(reach)))).withColumn("_x", F.explode(F.array_distinct(around)))
    p = points.withColumn("_y", F.floor("lat").cast("int")).withColumn("_x", F.pmod(F.floor("lon").cast("int") + 180, F.lit(360)))
    km = S.haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    pairs = p.join(m, ["country", "_y", "_x"]).withColumn("km", km).where(F.col("km") <= most_km)
    return pairs.groupBy("point").agg(F.min(F.struct("km", "market")).alias("best"), F.first("population").alias("population")).select("point", "best.market", "best.km", "population")


def fold_markets(cities: DataFrame, radius_km: float = 15.0) -> DataFrame:
    """(country, city, market): in order of events each city joins the nearest earlier market within the radius, or founds one.

    The order matters, so a country is folded in one task; a country's cities are few.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["events", "city"], ascending=[False, True])
        lat, lon, names, out = [], [], [], []
        for r in rows.itertuples():
            home = None
            if names:
                a, b = np.radians(r.lat), np.radians(lat)
                h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.array(lon) - r.lon) / 2) ** 2
                km = 2 * S.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h)))
                if km.min() <= radius_km:
                    home = names[int(km.argmin())]
            if home is None:
                home = r.city
                lat.append(r.lat)
                lon.append(r.lon)
                names.append(home)
            out.append((r.country, r.city, home))
        return pd.DataFrame(out, columns=["country", "city", "market"])

    return cities.select("country", "city", "events", "lat", "lon").groupBy("country").applyInPandas(fold, "country string, city string, market string")


def market_rollup(cities: DataFrame, members: DataFrame) -> DataFrame:
    """Sums, ceilings, sorted members and the founder's coordinates of each market."""
    rows = cities.join(members, ["country", "city"])
    return rows.groupBy("country", "market").agg(
        F.count(F.lit(1)).alias("cities"),
        F.sum("venues").alias("venues"),
        F.sum("events").alias("events"),
        F.max("ceiling").alias("ceiling"),
        F.max("ceiling_indoor").alias("ceiling_indoor"),
        F.sum("population").alias("population"),
        F.array_join(F.array_sort(F.collect_set("city")), ", ").alias("members"),
        F.max(F.when(F.col("city") == F.col("market"), F.col("lat"))).alias("lat"),
        F.max(F.when(F.col("city") == F.col("market"), F.col("lon"))).alias("lon"),
    )


def ladder_gaps(venues: DataFrame, by: list[str]) -> DataFrame:
    """Venues and events on each rung of either kind: none, thin or served. All rungs are listed."""
    spark = venues.sparkSession
    tops = [0, *[t for t, _ in S.LADDER_BANDS]]
    rungs = spark.createDataFrame([(io, i, label, lo, hi) for io in ("inside", "outside") for i, ((hi, label), lo) in enumerate(zip(S.LADDER_BANDS, tops, strict=False))], "io string, rung int, band string, lo bigint, hi bigint")
    there = venues.withColumn("band", S.band(F.col("capacity"), S.LADDER_BANDS)).groupBy(*by, "io", "band").agg(F.count(F.lit(1)).alias("venues"), F.sum("events").alias("events"))
    grid = venues.select(*by).distinct().join(F.broadcast(rungs.select("io", "rung", "band")))
    rows = grid.join(there, [*by, "io", "band"], "left").fillna(0, ["venues", "events"])
    return rows.withColumn("status", F.when(F.col("venues") == 0, "none").when(F.col("venues") == 1, "thin").otherwise("served"))


def ceilings(venues: DataFrame, by: list[str]) -> DataFrame:
    """Largest room by kind, of all, and of those without a kind."""
    of = lambda keep: F.max(F.when(keep, F.col("capacity")))
    io = F.col("io")
    return venues.groupBy(*by).agg(of(io == "inside").alias("indoor"), of(io == "outside").alias("outdoor"), F.max("capacity").alias("overall"), of(io.isNull()).alias("largest_unlabelled"), F.count_if(io.isNull()).alias("unlabelled"))


def capacity_test(skipped: DataFrame, limits: DataFrame, gap: float = 1.2, borderline: float = 0.8) -> DataFrame:
    """Verdict, ratio and headroom of each skipping tour against its market's ceiling of the same kind.

    ``limits`` has the columns of ``ceilings``, keyed like the tours, or is a single row for one market.
    """
    kind = lambda a, b, c: F.when(F.col("plays") == "indoor", F.col(a)).when(F.col("plays") == "outdoor", F.col(b)).otherwise(F.col(c))
    keys = [c for c in ("country", "city", "market") if c in skipped.columns and c in limits.columns]
    limits = limits.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("indoor", "outdoor", "overall")])
    rows = skipped.join(limits, keys) if keys else skipped.join(F.broadcast(limits))
    rows = rows.withColumn("needs", F.coalesce(kind("typical_indoor", "typical_outdoor", "typical_room"), F.col("typical_room"))).withColumn("limit", kind("_indoor", "_outdoor", "_overall").cast("double")).drop("_indoor", "_outdoor", "_overall")
    need, limit = F.col("needs"), F.col("limit")
    return rows.withColumn("ratio", F.round(need / limit, 2)).withColumn("verdict", S.capacity_verdict(need, limit, gap, borderline)).withColumn("headroom", F.when(need > limit, F.bround(need - limit)))


def verdict_summary(tested: DataFrame) -> DataFrame:
    """Tours, shows, median need and share by verdict."""
    rows = tested.groupBy("verdict").agg(F.count(F.lit(1)).alias("tours"), F.sum("shows").alias("shows"), F.percentile("needs", F.lit(0.5)).alias("median_need"))
    return rows.withColumn("share", F.round(F.col("tours") / F.sum("tours").over(Window.partitionBy()), 4))


def peers(markets: DataFrame, name: str, size: str, value: str, within: float = 0.35) -> DataFrame:
    """Peers of each market: those with a size within the share of its own, itself left out; their number and median value.

    A peer's logarithm of size lies in the same or a neighbouring cell, so markets meet by cell.
    """
    width = float(np.log1p(within) - np.log1p(-within))
    m = markets.select(F.col(name).alias("n"), F.col(size).alias("s"), F.col(value).alias("v")).where("s > 0").withColumn("cell", F.floor(F.log("s") / width))
    other = m.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))).select(F.col("n").alias("on"), F.col("s").alias("os"), F.col("v").alias("ov"), "cell")
    near = m.join(other, "cell").where((F.col("n") != F.col("on")) & (F.col("os") >= F.col("s") * (1 - within)) & (F.col("os") <= F.col("s") * (1 + within)))
    found = near.groupBy("n").agg(F.count(F.lit(1)).alias("peers"), F.percentile("ov", F.lit(0.5)).alias("median"))
    return m.select("n", "v").join(found, "n", "left").select(F.col("n").alias(name), F.coalesce("peers", F.lit(0)).alias("peers"), "median", (F.col("median") - F.col("v")).alias("below_peers"))


def round_to(value: Column, step: int) -> Column:
    """To the nearest multiple, halves to even."""
    return (F.bround(value / step) * step).cast("bigint")


def recommend_sizes(tested: DataFrame, by: list[str]) -> DataFrame:
    """Blocked tours with the median, upper quartile and largest need, in steps of 500."""
    blocked = tested.where(F.col("verdict").startswith("capacity gap"))
    q = lambda p: round_to(F.percentile("needs", F.lit(p)), 500)
    return blocked.groupBy(*by).agg(F.count(F.lit(1)).alias("blocked"), q(0.5).alias("median"), q(0.75).alias("upper"), round_to(F.max("needs"), 500).alias("largest"))


def market_case(rows: DataFrame, least_blocked: int = 8, least_kept: float = 0.3) -> DataFrame:
    """unknown, satellite, build, too few or no case; the tests in this order."""
    gap, skipped = F.coalesce("gap_tours", F.lit(0)), F.coalesce("skipped_tours", F.lit(0))
    build = (gap >= least_blocked) & F.coalesce(F.col("suggested") > F.coalesce("indoor_ceiling", F.lit(0)), F.lit(False)) & F.coalesce(F.col("below_peers") > 0, F.lit(False))
    case = F.when(~F.col("assessable") | (skipped <= 0), "unknown").when(F.coalesce(F.col("kept") < least_kept, F.lit(False)), "satellite").when(build, "build").when(gap > 0, "too few").otherwise("no case")
    rows = rows.withColumn("case", case).withColumn("seats", F.when(F.col("case") == "build", F.col("suggested") - F.coalesce("indoor_ceiling", F.lit(0))))
    return rows.withColumn("blocked_share", F.round(F.try_divide(gap, skipped), 3))


def performance_verdict(actual: Column, expected: Column) -> Column:
    """Actual over expected visits in words."""
    r = F.try_divide(actual.cast("double"), F.nullif(F.greatest(expected, F.lit(0.0)), F.lit(0.0)))
    return F.when(r >= 1.5, "far more than expected").when(r >= 1.15, "more than expected").when(r <= 0.67, "far fewer than expected").when(r <= 0.87, "fewer than expected").otherwise("about as expected")


def can_host(need: Column, capacity: Column, plays: Column, io: Column) -> Column:
    """Whether a room suits an act: its kind, then its size; a room under a third of the need is far too small."""
    kind = (plays == "either") | ((plays == "indoor") & F.coalesce(io == "inside", F.lit(False))) | ((plays == "outdoor") & F.coalesce(io == "outside", F.lit(False)))
    return F.when(need.isNull(), "size unknown").when(~kind, "wrong kind of room").when(need / 3 > capacity, "far too small for the act").when(need > capacity, "too big for this room").otherwise("fits")


def screen(markets: DataFrame, tested: DataFrame, least_indoor: int = 10, least_people: int = 250_000) -> DataFrame:
    """All markets at once: skipping and blocked tours, whether the market can be judged, and its rank in the country by blocked shows.

    ``tested`` has a verdict for each (country, city, tour); a market can be judged with enough indoor shows and people.
    """
    gap = F.col("verdict").startswith("capacity gap")
    t = tested.groupBy("country", "city").agg(F.count(F.lit(1)).alias("skipped_tours"), F.count_if(gap).alias("gap_tours"), F.coalesce(F.sum(F.when(gap, F.col("shows"))), F.lit(0)).alias("gap_dates"))
    rows = markets.join(t, ["country", "city"], "left").fillna(0, ["skipped_tours", "gap_tours", "gap_dates"])
    rows = rows.withColumn("assessable", F.coalesce((F.col("indoor_events") >= least_indoor) & (F.col("population") >= least_people), F.lit(False)).cast("int"))
    most = F.max("skipped_tours").over(Window.partitionBy("country"))
    rows = rows.withColumn("gap_per_1k", F.bround(F.try_divide(F.col("gap_dates"), F.nullif(most, F.lit(0))) * 1000))
    return rows.withColumn("rank_in_country", F.rank().over(Window.partitionBy("country").orderBy(F.desc("gap_dates"))))


def screen_columns(rows: DataFrame) -> DataFrame:
    """Markets (country, city, population, exclusive, ceiling_indoor, suggested) with what the suggested room adds, the share of the people around
    for whom the market is the nearest, and how far its ceiling is below its peers'."""
    named = rows.withColumn("_n", F.concat_ws("|", "country", "city"))
    below = peers(named, "_n", "population", "ceiling_indoor").select("_n", F.col("below_peers").alias("ceiling_below_peers"))
    out = named.join(below, "_n", "left").drop("_n")
    return out.withColumn("headroom", F.col("suggested") - F.coalesce("ceiling_indoor", F.lit(0))).withColumn("catchment_kept", F.try_divide(F.col("exclusive").cast("double"), F.col("population")))


def skipped_everywhere(visits: DataFrame) -> DataFrame:
    """(country, city, tour) for every city of a country and tour of the country that left it out, with the tour's figures elsewhere in the country."""
    tours = visits.groupBy("country", "tour").agg(
        F.sum("shows").alias("shows"), F.sum("indoor").alias("indoor"), F.sum("outdoor").alias("outdoor"),
        F.percentile("largest", F.lit(0.5)).alias("typical_room"), F.percentile("largest_indoor", F.lit(0.5)).alias("typical_indoor"), F.percentile("largest_outdoor", F.lit(0.5)).alias("typical_outdoor"),
    )
    rows = visits.select("country", "city").distinct().join(tours, "country").join(visits.select("country", "city", "tour"), ["country", "city", "tour"], "left_anti")
    return rows.withColumn("plays", F.when(F.col("indoor") > F.col("outdoor"), "indoor").when(F.col("outdoor") > F.col("indoor"), "outdoor").otherwise("either"))
