"""Choice of city: occasions and alternatives, design matrix, counterfactuals and what they say of tours, cities and rooms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .models import linear, softmax

#: Variables of specification A; B adds the last.
NAMES = ["log_catchment", "log_income", "log_room", "big_enough", "fit_gap", "log_km", "km_x_stops", "km_x_need", "big_x_need"]
NAMES_B = [*NAMES, "log_shows"]
# The published coefficients of either specification, in the order of the names.
BETA_A = [1.630421, 1.097434, 0.284546, 0.209136, -0.844155, 0.680864, 0.004203, 0.067158, -0.015612]
BETA_B = [0.340565, 0.138614, -0.038228, 0.232022, -0.508391, 0.555949, 0.032717, 0.085608, 0.00916, 1.081449]
# Bands of a tour's best chance, and the chance from which a city is in play.
IN_PLAY = 0.02
CHANCE_BANDS = [(0.5, "better than even"), (0.2, "one in two to one in five"), (0.05, "one in five to one in twenty"), (IN_PLAY, "long shots"), (0.0, "not in play")]
#: Stands in where no occasion has a known value.
DEFAULTS = {"income_median": 1e4, "ceiling_floor": 500.0, "need_median": 1000.0, "fitgap_median": 0.75, "km_median": 0.0}


def candidate_markets(cities: DataFrame, years: float = 1.0, per_year: float = 5.0, floor: float = 12.0, covered: list[str] | None = None) -> DataFrame:
    """Cities on the menu: of a covered country, with people and with ``per_year`` events for each of ``years``, ``floor`` at least."""
    rows = cities.where((F.coalesce("events", F.lit(0)) >= max(per_year * years, floor)) & (F.coalesce("population", F.lit(0)) > 0))
    return rows if covered is None else rows.where(F.col("country").isin(covered))


def ladders(venues: DataFrame, keys: list[str]) -> DataFrame:
    """Known capacities of each market in ascending order: of halls, of open-air sites, of all."""
    of = lambda keep, name: F.array_sort(F.collect_list(F.when(keep, F.col("capacity")))).alias(name)
    known = venues.where(F.col("capacity").isNotNull())
    return known.groupBy(*keys).agg(of(F.col("io") == "inside", "rooms_indoor"), of(F.col("io") == "outside", "rooms_outdoor"), of(F.lit(True), "rooms"))


def log_gap(room: Column, need: Column) -> Column:
    """Distance of two capacities in log seats, from 50 on."""
    return F.abs(F.log(F.greatest(room, F.lit(50))) - F.log(F.greatest(need, F.lit(50))))


def of_kind(plays: Column, indoor: Column, outdoor: Column, either: Column) -> Column:
    return F.when(plays == "indoor", indoor).when(plays == "outdoor", outdoor).otherwise(either)


def _first(n: Column, is_past) -> Column:
    """The first of the places 1 to n from which on ``is_past`` holds, n + 1 if it never does, by bisection."""
    none, start = F.lit(0), F.struct(F.lit(1).alias("low"), (n + 1).cast("int").alias("high"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(n.cast("double") + 1)).cast("int") + 1)
    middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")

    def halved(s, _):
        past = is_past(middle(s))
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & ~past, middle(s) + 1).otherwise(s["low"]).alias("low"), F.when(open_ & past, middle(s)).otherwise(s["high"]).alias("high"))

    return F.when(n > 0, F.aggregate(rounds, start, halved, lambda s: s["low"])).otherwise(none)


def nearest_room(plays: Column, need: Column, indoor: Column, outdoor: Column, rooms: Column) -> Column:
    """The room of the ladder nearest in log capacity, of the act's kind if there is any; of ties the smaller. Null without rooms or need.

    Ladders ascend, so distances fall up to the need and rise from there; two bisections find the room, and a long ladder costs its logarithm.
    """
    own = of_kind(plays, indoor, outdoor, rooms)
    pool = F.when(F.size(F.coalesce(own, F.array())) > 0, own).otherwise(rooms)
    away = lambda room: F.round(log_gap(room, need), 9)

    def nearest(ladder):
        at = lambda i: F.get(ladder, i - 1)
        above = _first(F.size(ladder), lambda i: F.coalesce(at(i) >= need, F.lit(True)))
        # Of rooms as near as the nearer of the two around the need the first is the smallest.
        around = F.transform(F.array(above), lambda i: F.struct(i.alias("above"), F.least(away(at(i - 1)), away(at(i))).alias("least")))
        return F.get(F.transform(around, lambda a: at(_first(F.size(ladder), lambda i: (i >= a["above"]) | (away(at(i)) <= a["least"])))), 0)

    best = F.get(F.transform(F.array(pool), nearest), 0)
    return F.when(need.isNotNull() & (F.size(F.coalesce(pool, F.array())) > 0), best)


def median_of(values: Column) -> Column:
    """Median of an array without its nulls; null if nothing is left."""
    known = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(known)
    return (F.get(known, F.floor((n - 1) / 2).cast("int")) + F.get(known, F.floor(n / 2).cast("int"))) / 2.0


def occasions(visits: DataFrame, menu: DataFrame, least_stops: int = 2) -> DataFrame:
    """One row for each visit and alternative: the country's menu without the tour's other stops.

    Only tours with two or more stops on a country's menu count. What the tour is like is left-one-out, from its other stops: the
    median of the largest rooms, halls or open air by numbers of shows, and the distance of each alternative to the nearest.
    A tour's stops are gathered once; menus meet occasions by country.
    """
    stop = F.struct("city", "lat", "lon", "shows", "indoor", "outdoor", "largest")
    stops = visits.join(menu.select("country", "city", "lat", "lon"), ["country", "city"])
    tours = stops.groupBy("tour", "country").agg(F.collect_list(stop).alias("stops")).where(F.size("stops") >= least_stops)
    rows = tours.withColumn("here", F.explode("stops")).withColumn("others", F.filter("stops", lambda s: s["city"] != F.col("here.city")))
    total = lambda name: F.aggregate("others", F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(s[name], F.lit(0)))
    rows = rows.withColumn("_in", total("indoor")).withColumn("_out", total("outdoor"))
    plays = F.when(F.col("_in") > F.col("_out"), "indoor").when(F.col("_out") > F.col("_in"), "outdoor").otherwise("either")
    rows = rows.select(
        F.concat_ws("|", "tour", "country", "here.city").alias("occasion"), "tour", "country", F.col("here.city").alias("visited"), F.size("stops").alias("stops"), F.col("here.shows").alias("shows"),
        plays.alias("plays"), median_of(F.transform("others", lambda s: s["largest"])).alias("room_needed"), "others",
    )
    alts = menu.select("country", "city", "lat", "lon", F.col("events").alias("market_events"), "population", "income", "ceiling", "ceiling_indoor", "ceiling_outdoor", "rooms", "rooms_indoor", "rooms_outdoor")
    rows = rows.join(alts, "country").where(~F.exists("others", lambda s: s["city"] == F.col("city")))
    km = F.array_min(F.transform("others", lambda s: S.haversine_km(F.col("lat"), F.col("lon"), s["lat"], s["lon"])))
    chosen = F.col("city") == F.col("visited")
    kind, need = F.col("plays"), F.col("room_needed")
    return rows.select(
        "occasion", "tour", "country", "visited", "city", chosen.cast("int").alias("chosen"), "stops", "shows", "plays", "room_needed", km.alias("km"), "population", "income",
        of_kind(kind, F.col("ceiling_indoor"), F.col("ceiling_outdoor"), F.col("ceiling")).alias("ceiling"),
        nearest_room(kind, need, F.col("rooms_indoor"), F.col("rooms_outdoor"), F.col("rooms")).alias("best_room"),
        "market_events", F.when(chosen, F.col("shows")).otherwise(0).alias("own_shows"),
    )


def nearest_rung(needs: DataFrame, rooms: DataFrame, keys: list[str], need: str = "room_needed", room: str = "capacity") -> DataFrame:
    """The room nearest in log capacity (from 50 on) to each need; of ties the smaller."""
    pairs = needs.join(rooms.select(*keys, room), keys)
    mine = [c for c in needs.columns]
    away = F.round(log_gap(F.col(room), F.col(need)), 9)
    return pairs.groupBy(*mine).agg(F.min(F.struct(away.alias("away"), F.col(room).alias("room"))).alias("b")).select(*mine, F.col("b.room").alias("best_room"), F.col("b.away").alias("away"))


def design_constants(rows: DataFrame) -> DataFrame:
    """One row of constants that the design takes from all occasions and that counterfactuals keep: medians, the first percentile of ceilings, means."""
    p = lambda c, at, name: F.percentile(c, F.lit(at)).alias(name)
    filled = rows.crossJoin(F.broadcast(rows.agg(p("room_needed", 0.5, "_median"))))
    big = F.log(F.greatest(F.coalesce("room_needed", "_median"), F.lit(100)) / 1000)
    return filled.agg(
        p("income", 0.5, "income_median"), p("ceiling", 0.01, "ceiling_floor"), p("room_needed", 0.5, "need_median"), p(log_gap(F.col("best_room"), F.col("room_needed")), 0.5, "fitgap_median"),
        p("km", 0.5, "km_median"), F.avg(F.log(F.greatest(F.coalesce("stops", F.lit(2)), F.lit(1)))).alias("stops_mean"), F.avg(big).alias("big_mean"),
    )


def frozen(rows: DataFrame) -> dict[str, float]:
    """The constants as numbers, with defaults where nothing is known."""
    found = design_constants(rows).first().asDict()
    return {k: float(v if v is not None else DEFAULTS.get(k, 0.0)) for k, v in found.items()}


def variables(k: dict[str, float]) -> dict[str, Column]:
    """Expressions of the choice model's variables over the columns of ``occasions``, given the constants."""
    need, ceiling = F.col("room_needed"), F.col("ceiling")
    km = F.log1p(F.coalesce("km", F.lit(k["km_median"])))
    stops = F.log(F.greatest(F.coalesce("stops", F.lit(2)), F.lit(1))) - k["stops_mean"]
    big = F.log(F.greatest(F.coalesce(need, F.lit(k["need_median"])), F.lit(100)) / 1000) - k["big_mean"]
    enough = F.coalesce(F.coalesce(ceiling, F.lit(0)) >= need, F.lit(False)).cast("double")
    return {
        "log_catchment": F.log(F.greatest("population", F.lit(1000)) / 1e6),
        "log_income": F.log(F.greatest(F.coalesce("income", F.lit(k["income_median"])), F.lit(1000)) / 1e4),
        "log_room": F.log(F.greatest(F.coalesce(ceiling, F.lit(k["ceiling_floor"])), F.lit(k["ceiling_floor"]))),
        "big_enough": enough,
        "fit_gap": F.coalesce(log_gap(F.col("best_room"), need), F.lit(k["fitgap_median"])),
        "log_km": km,
        "km_x_stops": km * stops,
        "km_x_need": km * big,
        "big_x_need": enough * big,
        "log_shows": F.log1p(F.greatest(F.coalesce("market_events", F.lit(0)) - F.coalesce("own_shows", F.lit(0)), F.lit(0)).cast("double")),
    }


def design(rows: DataFrame, constants: dict[str, float], names: list[str] = NAMES) -> DataFrame:
    """Occasions with the variables of the model as further columns."""
    made = variables(constants)
    return rows.select("*", *[made[n].alias(n) for n in names])


def probabilities(rows: DataFrame, beta, names: list[str] = NAMES) -> DataFrame:
    return softmax(rows, "occasion", linear(names, beta))


def expected_and_actual(rows: DataFrame, beta, by: list[str], names: list[str] = NAMES) -> DataFrame:
    p = probabilities(rows, beta, names)
    return p.groupBy(*by).agg(F.sum("p").alias("expected"), F.sum("chosen").cast("bigint").alias("actual"), F.count(F.lit(1)).alias("offered"))


def why_expected(rows: DataFrame, beta, by: list[str], names: list[str] = NAMES) -> DataFrame:
    """What each variable adds to a city's utility against the mean alternative of its country: the mean difference times the coefficient."""
    mean = rows.groupBy("country").agg(*[F.avg(n).alias(f"_{n}") for n in names])
    own = rows.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])
    return own.join(mean, "country").select(*by, *[((F.col(n) - F.col(f"_{n}")) * float(b)).alias(n) for n, b in zip(names, beta, strict=True)])


def _utility(constants: dict[str, float], beta, names: list[str], ceiling: Column, best_room: Column) -> Column:
    """Utility of an alternative as if its ceiling and nearest room were these; other variables stay."""
    need = F.col("room_needed")
    enough = F.coalesce(F.coalesce(ceiling, F.lit(0)) >= need, F.lit(False)).cast("double")
    big = F.log(F.greatest(F.coalesce(need, F.lit(constants["need_median"])), F.lit(100)) / 1000) - constants["big_mean"]
    changed = {
        "log_room": F.log(F.greatest(F.coalesce(ceiling, F.lit(constants["ceiling_floor"])), F.lit(constants["ceiling_floor"]))),
        "big_enough": enough,
        "fit_gap": F.coalesce(log_gap(best_room, need), F.lit(constants["fitgap_median"])),
        "big_x_need": enough * big,
    }
    out = F.lit(0.0)
    for n, b in zip(names, beta, strict=True):
        out = out + changed.get(n, F.col(n)) * float(b)
    return out


def with_room(capacity: Column) -> tuple[Column, Column]:
    """Ceiling and nearest room of an alternative that gets a room of this size."""
    need, old = F.col("room_needed"), F.col("best_room")
    nearer = F.coalesce(log_gap(capacity, need) < log_gap(old, need), old.isNull() & need.isNotNull())
    return F.greatest(F.coalesce("ceiling", F.lit(0)), capacity), F.when(nearer, capacity.cast("double")).otherwise(old)


def applies(kind: str) -> Column:
    """Acts that a room of this kind can help: those of the kind and those that play either."""
    return F.col("plays").isin(kind, "either") if kind in ("indoor", "outdoor") else F.lit(True)


def counterfactual(rows: DataFrame, constants: dict[str, float], beta, target: Column, ceiling: Column, best_room: Column, names: list[str] = NAMES) -> DataFrame:
    """Design rows with probabilities before (``p``) and after (``p_after``) the target rows' ceiling and room are replaced, in one pass."""
    w = rows.withColumn("_v", linear(names, beta)).withColumn("_t", F.coalesce(target, F.lit(False)))
    w = w.withColumn("_after", F.when(F.col("_t"), _utility(constants, beta, names, ceiling, best_room)).otherwise(F.col("_v")))
    g = Window.partitionBy("occasion")
    top = F.greatest(F.max("_v").over(g), F.max("_after").over(g))
    w = w.withColumn("_top", top).withColumn("_e", F.exp(F.col("_v") - F.col("_top"))).withColumn("_f", F.exp(F.col("_after") - F.col("_top")))
    w = w.withColumn("p", F.col("_e") / F.sum("_e").over(g)).withColumn("p_after", F.col("_f") / F.sum("_f").over(g))
    return w.drop("_v", "_t", "_after", "_top", "_e", "_f")


def impact(rows: DataFrame, constants: dict[str, float], beta, target: Column, capacity: int, by: list[str], kind: str = "indoor", names: list[str] = NAMES) -> DataFrame:
    """Expected visits before and after the target gets a room of a size and kind."""
    after = counterfactual(rows, constants, beta, target & applies(kind), *with_room(F.lit(capacity)), names)
    return after.groupBy(*by).agg(F.sum("p").alias("before"), F.sum("p_after").alias("after")).withColumn("gain", F.col("after") - F.col("before"))


def tour_gains(rows: DataFrame, constants: dict[str, float], beta, target: Column, capacity: int, kind: str = "indoor", names: list[str] = NAMES) -> DataFrame:
    """Of each tour offered the target: its chances there before and after, and whether the room clears its bar."""
    after = counterfactual(rows, constants, beta, target & applies(kind), *with_room(F.lit(capacity)), names).where(target)
    per = after.groupBy("tour").agg(F.count(F.lit(1)).alias("occasions"), F.sum("p").alias("before"), F.sum("p_after").alias("after"), F.percentile("room_needed", F.lit(0.5)).alias("room_needed"))
    return per.withColumn("gain", F.col("after") - F.col("before")).withColumn("clears", F.coalesce(F.col("room_needed") <= capacity, F.lit(False)).cast("int"))


def cleared(rows: DataFrame, target: Column, capacity: int, kind: str = "indoor") -> DataFrame:
    """One row: occasions that the room could help, and the share of them whose bar the market clears before and after."""
    rows = rows.where(target)
    could = rows.where(applies(kind)).where("room_needed IS NOT NULL")
    now = F.coalesce("ceiling", F.lit(0))
    share = lambda c: F.avg((c >= F.col("room_needed")).cast("double"))
    return could.agg(F.count(F.lit(1)).alias("testable"), share(now).alias("before"), share(F.greatest(now, F.lit(capacity))).alias("after"))


def sweep(rows: DataFrame, constants: dict[str, float], beta, target: Column, sizes: list[int], kind: str = "indoor", names: list[str] = NAMES) -> DataFrame:
    """Expected visits of the target for each size of a new room, and the step from the size before.

    The other alternatives' sum is taken once an occasion; each size only changes the target's own term.
    """
    g = Window.partitionBy("occasion")
    w = rows.withColumn("_v", linear(names, beta)).withColumn("_top", F.max("_v").over(g))
    w = w.withColumn("_e", F.exp(F.col("_v") - F.col("_top"))).withColumn("_others", F.sum("_e").over(g) - F.col("_e")).where(target)
    at = []
    for i, size in enumerate(sizes):
        e = F.when(applies(kind), F.exp(_utility(constants, beta, names, *with_room(F.lit(size))) - F.col("_top"))).otherwise(F.col("_e"))
        at.append(F.sum(e / (F.greatest(F.col("_others"), F.lit(0.0)) + e)).alias(f"s{i}"))
    one = w.agg(*at)
    pairs = F.array(*[F.struct(F.lit(size).cast("bigint").alias("size"), F.col(f"s{i}").alias("expected"), (F.col(f"s{i}") - (F.col(f"s{i - 1}") if i else F.lit(None))).alias("step")) for i, size in enumerate(sizes)])
    return one.select(F.explode(pairs).alias("x")).select("x.size", "x.expected", "x.step").where("expected IS NOT NULL")


def ladder_without(menu: DataFrame, venue_capacity: Column, venue_io: Column) -> DataFrame:
    """Menu rows whose ladders and ceilings lack one room of this size and kind."""
    drop = lambda rooms, size: F.when(F.array_position(rooms, size) > 0, F.concat(F.slice(rooms, 1, (F.array_position(rooms, size) - 1).cast("int")), F.slice(rooms, (F.array_position(rooms, size) + 1).cast("int"), F.size(rooms)))).otherwise(rooms)
    of = lambda kind, name: F.when(venue_io == kind, drop(F.col(name), venue_capacity)).otherwise(F.col(name))
    rows = menu.withColumn("rooms_indoor", of("inside", "rooms_indoor")).withColumn("rooms_outdoor", of("outside", "rooms_outdoor")).withColumn("rooms", drop(F.col("rooms"), venue_capacity))
    return rows.withColumn("ceiling_indoor", F.array_max("rooms_indoor")).withColumn("ceiling_outdoor", F.array_max("rooms_outdoor")).withColumn("ceiling", F.array_max("rooms"))


def without_largest(rows: DataFrame, constants: dict[str, float], beta, target: Column, menu: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """Probabilities before and after the target's largest room is gone, from its ladder; ``menu`` has the ladders of the target alone."""
    largest = F.array_max("rooms")
    io = F.when(F.array_contains("rooms_indoor", largest), "inside").when(F.array_contains("rooms_outdoor", largest), "outside")
    less = ladder_without(menu.where(target).withColumn("_size", largest).withColumn("_io", io), F.col("_size"), F.col("_io"))
    less = less.select("country", "city", *[F.col(c).alias(f"_{c}") for c in ("ceiling", "ceiling_indoor", "ceiling_outdoor", "rooms", "rooms_indoor", "rooms_outdoor")])
    joined = rows.join(less, ["country", "city"], "left")
    plays = F.col("plays")
    ceiling = of_kind(plays, F.col("_ceiling_indoor"), F.col("_ceiling_outdoor"), F.col("_ceiling"))
    room = nearest_room(plays, F.col("room_needed"), F.col("_rooms_indoor"), F.col("_rooms_outdoor"), F.col("_rooms"))
    return counterfactual(joined, constants, beta, target, ceiling, room, names)


def decompose(rows: DataFrame, beta, by: list[str], names: list[str] = NAMES) -> DataFrame:
    """Mean part of each variable in the utility of chosen alternatives, less that over all alternatives."""
    parts = [(F.avg(F.when(F.col("chosen") == 1, F.col(n))) - F.avg(n)) * float(b) for n, b in zip(names, beta, strict=True)]
    return rows.groupBy(*by).agg(*[p.alias(n) for p, n in zip(parts, names, strict=True)])


def tours_of_city(scored: DataFrame, by: list[str]) -> DataFrame:
    """Of rows with ``p``: each tour's expected visits to a city, its best occasion, and whether the city is in play for it."""
    out = scored.groupBy(*by, "tour").agg(F.sum("p").alias("expected"), F.max("p").alias("best"), F.count(F.lit(1)).alias("occasions"), F.percentile("room_needed", F.lit(0.5)).alias("room_needed"))
    return out.withColumn("in_play", (F.col("best") >= IN_PLAY).cast("int"))


def chance_shape(tours: DataFrame, by: list[str]) -> DataFrame:
    """What a city's expected visits are made of: tours and expected visits by band of the best chance; all bands are listed."""
    band = F.lit(None).cast("string")
    for least, label in reversed(CHANCE_BANDS):
        band = F.when(F.col("best") >= least, label).otherwise(band)
    labels = tours.sparkSession.createDataFrame([(i, b) for i, (_, b) in enumerate(CHANCE_BANDS)], "place int, band string")
    found = tours.withColumn("band", band).groupBy(*by, "band").agg(F.count(F.lit(1)).alias("tours"), F.round(F.sum("expected"), 2).alias("expected"))
    grid = tours.select(*by).distinct().join(F.broadcast(labels))
    rows = grid.join(found, [*by, "band"], "left").fillna(0, ["tours", "expected"])
    return rows.withColumn("share", F.round(F.try_divide(F.col("expected"), F.sum("expected").over(Window.partitionBy(*by))), 3))


def cities_of_tour(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with ``p`` and ``p_after``: a tour's mean chance of each city over the menus it stood on, before and after, with ranks and the move."""
    out = scored.groupBy("tour", *keys).agg(F.avg("p").alias("chance"), F.avg("p_after").alias("chance_after"), F.count(F.lit(1)).alias("menus"), F.max("chosen").alias("played"))
    rank = lambda c: F.rank().over(Window.partitionBy("tour", keys[0]).orderBy(F.desc(F.round(c, 12))))
    out = out.withColumn("rank_before", rank("chance")).withColumn("rank_after", rank("chance_after"))
    return out.withColumn("rank_move", F.col("rank_before") - F.col("rank_after"))


def touring_share(visits: DataFrame, cities: DataFrame) -> DataFrame:
    """Of each city the share of its shows by tours of two or more cities, and what the model sees of its calendar."""
    several = visits.groupBy("tour").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("tour")
    seen = visits.join(several, "tour", "left_semi").groupBy("country", "city").agg(F.sum("shows").alias("touring"))
    rows = cities.where("events > 0").select("country", "city", "events").join(seen, ["country", "city"], "left").withColumn("touring", F.coalesce("touring", F.lit(0)))
    share = F.col("touring") / F.col("events")
    verdict = F.when(share >= 0.55, "most of the calendar").when(share >= 0.3, "about half of the calendar").otherwise("a small corner of the year")
    return rows.withColumn("share", share).withColumn("verdict", verdict)


def _menus_of_a_size(lengths: np.ndarray, rows: int):
    """Places of the alternatives of menus, a row a menu, for menus of the same length and at most ``rows`` alternatives at a time (a longer menu comes alone)."""
    starts = np.cumsum(lengths) - lengths
    for k in np.unique(lengths[lengths > 0]):
        of = starts[lengths == k]
        most = max(1, rows // int(k))
        for i in range(0, len(of), most):
            yield of[i : i + most, None] + np.arange(k)


def simulate(rows: DataFrame, fit, by: list[str], draws: int = 300, seed: int = 0) -> DataFrame:
    """Expected choices with a 5 % to 95 % band over draws of the coefficients (drawn on the driver), for all draws in one pass.

    An occasion's menu comes together as one row; Python gets menus in Arrow batches, takes menus of the same length together, some 2 MB of
    probabilities at a time, and sends sums a draw.
    """
    drawn = np.ascontiguousarray(np.random.default_rng(seed).multivariate_normal(fit.beta, fit.covariance, size=draws).T)
    keys = F.concat_ws("\x1f", *by)
    menus = rows.groupBy("occasion").agg(F.collect_list(keys).alias("unit"), *[F.collect_list(F.col(n).cast("double")).alias(n) for n in fit.names]).drop("occasion")

    def expected(batches):
        sums: dict[str, np.ndarray] = {}
        table = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["unit", "sums"])
        for batch in batches:
            unit = batch.column(0).flatten().dictionary_encode()
            code, names = unit.indices.to_numpy(), unit.dictionary.to_pylist()
            x = np.stack([column.flatten().to_numpy(zero_copy_only=False) for column in batch.columns[1:]], 1)
            for places in _menus_of_a_size(pc.list_value_length(batch.column(0)).to_numpy(), (1 << 18) // draws):
                p = (x[places.ravel()] @ drawn).reshape(*places.shape, draws)
                p -= p.max(1, keepdims=True)
                np.exp(p, out=p)
                p /= p.sum(1, keepdims=True)
                mine = code[places.ravel()]
                order = np.argsort(mine, kind="stable")
                firsts = np.flatnonzero(np.diff(mine[order], prepend=-1))
                for c, s in zip(mine[order[firsts]], np.add.reduceat(p.reshape(-1, draws)[order], firsts), strict=True):
                    sums[names[c]] = sums.get(names[c], 0) + s
                if len(sums) * draws > 1 << 20:
                    yield table()
                    sums.clear()
        if sums:
            yield table()

    parts = menus.mapInArrow(expected, "unit string, sums array<double>")
    each = parts.select("unit", F.posexplode("sums").alias("draw", "x")).groupBy("unit", "draw").agg(F.sum("x").alias("expected"))
    out = each.groupBy("unit").agg(F.avg("expected").alias("mean"), F.percentile("expected", F.lit(0.05)).alias("p5"), F.percentile("expected", F.lit(0.95)).alias("p95"))
    names = F.split("unit", "\x1f")
    return out.select(*[F.get(names, F.lit(i)).alias(c) for i, c in enumerate(by)], "mean", "p5", "p95")
