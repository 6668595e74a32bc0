"""Queries of the choice model, over all visits and the whole menu."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import choice as C
from ..operators import market as M
from ..operators import models as X
from ..operators.identity import written
from .domain import CITIES_ONLY, PLACES, VISITS, Domain
from .registry import query

_KM = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin((radians({2}) - radians({0})) / 2) ** 2 + cos(radians({0})) * cos(radians({2})) * sin(radians({3} - {1}) / 2) ** 2)))"


def km(a, b, c, e):
    return _KM.format(a, b, c, e)


#: The sizes of a sweep.
SIZES = [1_000, 1_500, 2_000, 3_000, 4_000, 5_000, 6_500, 8_000, 10_000, 12_000, 15_000, 18_000, 20_000, 25_000, 35_000, 50_000]
_HERE = "country = 'ASIA' AND city = 'NATION_2'"
_GAP = "abs(ln(greatest({0}, 50)::DOUBLE) - ln(greatest({1}, 50)::DOUBLE))"


def _nearest(plays: str, need: str, rin: str, rout: str, rall: str) -> str:
    own = f"CASE {plays} WHEN 'indoor' THEN {rin} WHEN 'outdoor' THEN {rout} ELSE {rall} END"
    pool = f"CASE WHEN len(coalesce({own}, [])) > 0 THEN {own} ELSE {rall} END"
    return f"CASE WHEN {need} IS NOT NULL THEN (list_sort(list_transform({pool}, lambda r: {{'a': round({_GAP.format('r', need)}, 9), 'r': r}}))[1]).r END"


_MENU = """nights AS (SELECT l_suppkey AS venue_no, count(*) AS events FROM lineitem GROUP BY 1), venues AS (SELECT p.*, coalesce(n.events, 0)::BIGINT AS events FROM places p LEFT JOIN nights n USING (venue_no)),
lad AS (SELECT country, city, list_sort(coalesce(list(capacity) FILTER (io = 'inside'), [])) AS rin, list_sort(coalesce(list(capacity) FILTER (io = 'outside'), [])) AS rout, list_sort(list(capacity)) AS rall FROM venues WHERE capacity IS NOT NULL GROUP BY 1, 2)"""
_OCC = f"""{VISITS}, {_MENU}, {CITIES_ONLY},
menu AS (SELECT c.*, CASE WHEN venues % 4 <> 0 THEN 10000 + events % 5000 END AS income, rin, rout, rall FROM cities c LEFT JOIN lad USING (country, city) WHERE events >= 12 AND population > 0),
st AS (SELECT v.*, m.lat, m.lon, count(*) OVER (PARTITION BY tour, v.country)::INT AS stops FROM visits v JOIN menu m USING (country, city)),
foc AS (SELECT a.tour, a.country, a.city AS visited, any_value(a.stops) AS stops, any_value(a.shows) AS shows, median(b.largest)::DOUBLE AS room_needed, CASE WHEN sum(b.indoor) > sum(b.outdoor) THEN 'indoor' WHEN sum(b.outdoor) > sum(b.indoor) THEN 'outdoor' ELSE 'either' END AS plays
  FROM st a JOIN st b ON a.tour = b.tour AND a.country = b.country AND a.city <> b.city GROUP BY 1, 2, 3),
away AS (SELECT f.tour, f.country, f.visited, m.city, min({km('m.lat', 'm.lon', 's.lat', 's.lon')}) AS km, bool_or(s.city = m.city) AS taken FROM foc f JOIN st s ON s.tour = f.tour AND s.country = f.country AND s.city <> f.visited JOIN menu m ON m.country = f.country GROUP BY 1, 2, 3, 4),
occ AS MATERIALIZED (SELECT f.tour || '|' || f.country || '|' || f.visited AS occasion, f.tour, f.country, f.visited, m.city, (m.city = f.visited)::INT AS chosen, stops, shows, plays, room_needed, km, population, income,
  CASE plays WHEN 'indoor' THEN ceiling_indoor WHEN 'outdoor' THEN ceiling_outdoor ELSE ceiling END AS ceiling, {_nearest('plays', 'room_needed', 'rin', 'rout', 'rall')} AS best_room, m.events AS market_events, CASE WHEN m.city = f.visited THEN shows ELSE 0 END AS own_shows
  FROM foc f JOIN away a USING (tour, country, visited) JOIN menu m ON m.country = f.country AND m.city = a.city WHERE NOT taken),
k AS (SELECT median(income)::DOUBLE AS income_median, quantile_cont(ceiling, 0.01)::DOUBLE AS ceiling_floor, median(room_needed)::DOUBLE AS need_median, median({_GAP.format('best_room', 'room_needed')})::DOUBLE AS fitgap_median, median(km)::DOUBLE AS km_median,
  avg(ln(greatest(stops, 1))) AS stops_mean, avg(ln(greatest(coalesce(room_needed, (SELECT median(room_needed) FROM occ)), 100)::DOUBLE / 1000)) AS big_mean FROM occ),
des AS MATERIALIZED (SELECT occ.*, k.*, ln(greatest(population, 1000)::DOUBLE / 1000000) AS log_catchment, ln(greatest(coalesce(income, income_median), 1000)::DOUBLE / 10000) AS log_income, ln(greatest(coalesce(ceiling, ceiling_floor), ceiling_floor)::DOUBLE) AS log_room,
  CASE WHEN coalesce(ceiling, 0) >= room_needed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS big_enough, coalesce({_GAP.format('best_room', 'room_needed')}, fitgap_median) AS fit_gap, ln(1 + coalesce(km, km_median)) AS log_km,
  ln(1 + coalesce(km, km_median)) * (ln(greatest(stops, 1)) - stops_mean) AS km_x_stops, ln(1 + coalesce(km, km_median)) * (ln(greatest(coalesce(room_needed, need_median), 100)::DOUBLE / 1000) - big_mean) AS km_x_need,
  CASE WHEN coalesce(ceiling, 0) >= room_needed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * (ln(greatest(coalesce(room_needed, need_median), 100)::DOUBLE / 1000) - big_mean) AS big_x_need, ln(1 + greatest(market_events - own_shows, 0)::DOUBLE) AS log_shows FROM occ, k)"""


def _utility(names=C.NAMES, beta=C.BETA_A, **changed: str) -> str:
    return " + ".join(f"({b})::DOUBLE * ({changed.get(n, n)})" for n, b in zip(names, beta, strict=True))


def _p(v: str, name: str = "p") -> str:
    """Probabilities of the utilities in column v."""
    return f"exp({v} - max({v}) OVER (PARTITION BY occasion)) / sum(exp({v} - m_{v})) OVER (PARTITION BY occasion) AS {name}"


def _scored(names=C.NAMES, beta=C.BETA_A) -> str:
    return f"(SELECT *, {_p('v')} FROM (SELECT *, max(v) OVER (PARTITION BY occasion) AS m_v FROM (SELECT *, {_utility(names, beta)} AS v FROM des)))"


def _moved(table: str, hit: str, ceiling: str, room: str) -> str:
    """p and p_after where the rows of ``hit`` have another ceiling and nearest room."""
    enough = f"CASE WHEN coalesce({ceiling}, 0) >= room_needed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    after = _utility(
        log_room=f"ln(greatest(coalesce({ceiling}, ceiling_floor), ceiling_floor)::DOUBLE)", big_enough=enough, fit_gap=f"coalesce({_GAP.format(room, 'room_needed')}, fitgap_median)",
        big_x_need=f"{enough} * (ln(greatest(coalesce(room_needed, need_median), 100)::DOUBLE / 1000) - big_mean)",
    )
    return f"(SELECT *, {_p('v')}, {_p('w', 'p_after')} FROM (SELECT *, max(v) OVER (PARTITION BY occasion) AS m_v, max(w) OVER (PARTITION BY occasion) AS m_w FROM (SELECT *, {_utility()} AS v, CASE WHEN {hit} THEN {after} ELSE {_utility()} END AS w FROM {table})))"


def _with_room(size: int, kind: str = "indoor") -> str:
    nearer = f"coalesce({_GAP.format(size, 'room_needed')} < {_GAP.format('best_room', 'room_needed')}, best_room IS NULL AND room_needed IS NOT NULL)"
    return _moved("des", f"{_HERE} AND plays IN ('{kind}', 'either')", f"greatest(coalesce(ceiling, 0), {size})", f"CASE WHEN {nearer} THEN {size}::DOUBLE ELSE best_room END")


def menu(d: Domain) -> DataFrame:
    """Markets with income, ceilings and ladders of rooms."""
    income = F.when(F.col("venues") % 4 != 0, F.lit(10000) + F.col("events") % 5000)
    cities = d.cities().withColumn("income", income).join(C.ladders(d.places(), ["country", "city"]), ["country", "city"], "left")
    return C.candidate_markets(cities)


def rows(d: Domain) -> DataFrame:
    return C.occasions(d.visits(), menu(d))


def designed(d: Domain, names: list[str] = C.NAMES_B) -> tuple[DataFrame, dict[str, float]]:
    """The design, from occasions that are written once, and its constants."""
    occ = written(rows(d))
    constants = C.frozen(occ)
    return C.design(occ, constants, names), constants


def target():
    return F.expr(_HERE)


def tidy(name: str, places: int):
    """Rounded, without negative zeros."""
    x = F.round(name, places)
    return F.when(x == 0, F.lit(0.0)).otherwise(x).alias(name)


def _tidy(sql: str, places: int, name: str) -> str:
    return f"CASE WHEN round({sql}, {places}) = 0 THEN 0 ELSE round({sql}, {places}) END AS {name}"


@query("choice_occasions", f"WITH {_OCC} SELECT occasion, city, chosen, stops, shows, plays, round(room_needed, 3) AS room_needed, round(km, 3) AS km, population, income, ceiling, best_room, market_events, own_shows FROM occ")
def choice_occasions(d: Domain) -> DataFrame:
    return rows(d).select("occasion", "city", "chosen", "stops", "shows", "plays", F.round("room_needed", 3).alias("room_needed"), F.round("km", 3).alias("km"), "population", "income", "ceiling", "best_room", "market_events", "own_shows")


@query("loo_room_needed", f"WITH {_OCC} SELECT tour, country, visited, stops, plays, room_needed FROM foc")
def loo_room(d: Domain) -> DataFrame:
    return rows(d).where("chosen = 1").select("tour", "country", "visited", "stops", "plays", "room_needed")


@query("routing_min_km", f"WITH {_OCC} SELECT occasion, round(min(km), 3) AS least, round(max(km), 3) AS most FROM occ GROUP BY 1")
def routing_km(d: Domain) -> DataFrame:
    return rows(d).groupBy("occasion").agg(F.round(F.min("km"), 3).alias("least"), F.round(F.max("km"), 3).alias("most"))


@query("nearest_rung", f"WITH {PLACES}, n AS (SELECT c_custkey AS act, n_name AS city, floor(abs(c_acctbal) * 4)::BIGINT AS room_needed FROM customer JOIN nation ON c_nationkey = n_nationkey), j AS (SELECT act, n.city, room_needed, capacity, round(abs(ln(greatest(capacity, 50)::DOUBLE) - ln(greatest(room_needed, 50)::DOUBLE)), 9) AS away FROM n JOIN places p ON n.city = p.city) SELECT act, city, room_needed, capacity AS best_room, round(away, 6) AS away FROM (SELECT *, row_number() OVER (PARTITION BY act ORDER BY away, capacity) AS r FROM j) WHERE r = 1")
def nearest_rung(d: Domain) -> DataFrame:
    needs = d.raw("customer").join(F.broadcast(d.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("act"), F.col("n_name").alias("city"), F.floor(F.abs("c_acctbal") * 4).cast("bigint").alias("room_needed"))
    return C.nearest_rung(needs, d.places(), ["city"]).withColumn("away", F.round("away", 6))


@query("design_constants", f"WITH {_OCC} SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in ("income_median", "ceiling_floor", "need_median", "fitgap_median", "km_median", "stops_mean", "big_mean")) + " FROM k")
def design_constants(d: Domain) -> DataFrame:
    k = C.design_constants(written(rows(d)))
    return k.select(*[F.round(c, 6).alias(c) for c in k.columns])


@query("design_matrix", f"WITH {_OCC} SELECT occasion, city, chosen, " + ", ".join(_tidy(n, 6, n) for n in C.NAMES_B) + " FROM des")
def design_matrix(d: Domain) -> DataFrame:
    return designed(d)[0].select("occasion", "city", "chosen", *[tidy(n, 6) for n in C.NAMES_B])


@query("softmax_probs", f"WITH {_OCC}, a AS (SELECT occasion, city, p AS p_a FROM {_scored()}), b AS (SELECT occasion, city, p AS p_b FROM {_scored(C.NAMES_B, C.BETA_B)}) SELECT occasion, city, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b FROM a JOIN b USING (occasion, city)")
def softmax_probs(d: Domain) -> DataFrame:
    both = X.softmax(X.softmax(designed(d)[0], "occasion", X.linear(C.NAMES, C.BETA_A), "p_a"), "occasion", X.linear(C.NAMES_B, C.BETA_B), "p_b")
    return both.select("occasion", "city", F.round("p_a", 6).alias("p_a"), F.round("p_b", 6).alias("p_b"))


_EXPECTED = f"e AS (SELECT country, city, sum(p) AS expected, sum(chosen)::BIGINT AS actual, count(*)::BIGINT AS offered FROM {_scored(C.NAMES_B, C.BETA_B)} GROUP BY 1, 2)"


def expected(d: Domain) -> DataFrame:
    return C.expected_and_actual(designed(d)[0], C.BETA_B, ["country", "city"], C.NAMES_B)


@query("expected_vs_actual", f"WITH {_OCC}, {_EXPECTED} SELECT country, city, round(expected, 4) AS expected, actual, offered FROM e")
def expected_vs_actual(d: Domain) -> DataFrame:
    return expected(d).withColumn("expected", F.round("expected", 4))


@query("performance_verdict", f"WITH {_OCC}, {_EXPECTED} SELECT country, city, actual, CASE WHEN actual / expected >= 1.5 THEN 'far more than expected' WHEN actual / expected >= 1.15 THEN 'more than expected' WHEN actual / expected <= 0.67 THEN 'far fewer than expected' WHEN actual / expected <= 0.87 THEN 'fewer than expected' ELSE 'about as expected' END AS verdict FROM e")
def performance(d: Domain) -> DataFrame:
    return expected(d).select("country", "city", "actual", M.performance_verdict(F.col("actual"), F.col("expected")).alias("verdict"))


@query("why_expected", f"WITH {_OCC}, m AS (SELECT country, " + ", ".join(f"avg({n}) AS m_{n}" for n in C.NAMES) + " FROM des GROUP BY 1), o AS (SELECT country, city, " + ", ".join(f"avg({n}) AS {n}" for n in C.NAMES) + " FROM des GROUP BY 1, 2) SELECT country, city, " + ", ".join(_tidy(f"({n} - m_{n}) * ({b})::DOUBLE", 5, n) for n, b in zip(C.NAMES, C.BETA_A, strict=True)) + " FROM o JOIN m USING (country)")
def why_expected(d: Domain) -> DataFrame:
    out = C.why_expected(designed(d, C.NAMES)[0], C.BETA_A, ["country", "city"])
    return out.select("country", "city", *[tidy(n, 5) for n in C.NAMES])


@query("whatif_impact", f"WITH {_OCC} SELECT country, city, round(sum(p), 4) AS before, round(sum(p_after), 4) AS after, {_tidy('sum(p_after) - sum(p)', 4, 'gain')} FROM {_with_room(60000)} GROUP BY 1, 2")
def whatif_impact(d: Domain) -> DataFrame:
    out = C.impact(*designed(d, C.NAMES), C.BETA_A, target(), 60000, ["country", "city"])
    return out.select("country", "city", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), tidy("gain", 4))


@query("tour_gains", f"WITH {_OCC} SELECT tour, count(*)::BIGINT AS occasions, round(sum(p), 5) AS before, round(sum(p_after), 5) AS after, median(room_needed)::DOUBLE AS room_needed, {_tidy('sum(p_after) - sum(p)', 5, 'gain')}, coalesce(median(room_needed) <= 20000, false)::INT AS clears FROM {_with_room(20000, 'outdoor')} WHERE {_HERE} GROUP BY 1")
def tour_gains(d: Domain) -> DataFrame:
    out = C.tour_gains(*designed(d, C.NAMES), C.BETA_A, target(), 20000, "outdoor")
    return out.select("tour", "occasions", F.round("before", 5).alias("before"), F.round("after", 5).alias("after"), "room_needed", tidy("gain", 5), "clears")


@query("room_clears", f"WITH {_OCC} SELECT count(*)::BIGINT AS testable, round(avg((coalesce(ceiling, 0) >= room_needed)::INT), 6) AS before, round(avg((greatest(coalesce(ceiling, 0), 30000) >= room_needed)::INT), 6) AS after FROM des WHERE {_HERE} AND plays IN ('indoor', 'either') AND room_needed IS NOT NULL")
def room_clears(d: Domain) -> DataFrame:
    return C.cleared(rows(d), target(), 30000).select("testable", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("capacity_sweep", f"WITH {_OCC}, s AS (" + " UNION ALL ".join(f"SELECT {n}::BIGINT AS size, sum(p_after) AS expected FROM {_with_room(n)} WHERE {_HERE}" for n in SIZES) + f") SELECT size, round(expected, 4) AS expected, {_tidy('expected - lag(expected) OVER (ORDER BY size)', 4, 'step')} FROM s WHERE expected IS NOT NULL")
def capacity_sweep(d: Domain) -> DataFrame:
    out = C.sweep(*designed(d, C.NAMES), C.BETA_A, target(), SIZES)
    return out.select("size", F.round("expected", 4).alias("expected"), tidy("step", 4))


_LESS = f"""less AS (SELECT country, city, CASE WHEN list_contains(rin, list_max(rall)) THEN rin[1:len(rin) - 1] ELSE rin END AS lin, CASE WHEN NOT list_contains(rin, list_max(rall)) AND list_contains(rout, list_max(rall)) THEN rout[1:len(rout) - 1] ELSE rout END AS lout, rall[1:len(rall) - 1] AS lall FROM menu WHERE {_HERE}),
cut AS (SELECT des.*, CASE plays WHEN 'indoor' THEN list_max(lin) WHEN 'outdoor' THEN list_max(lout) ELSE list_max(lall) END AS new_ceiling, {_nearest('plays', 'room_needed', 'lin', 'lout', 'lall')} AS new_room FROM des LEFT JOIN less USING (country, city))"""


@query("venue_pull", f"WITH {_OCC}, {_LESS} SELECT country, city, round(sum(p), 4) AS before, round(sum(p_after), 4) AS after FROM {_moved('cut', _HERE, 'new_ceiling', 'new_room')} GROUP BY 1, 2")
def venue_pull(d: Domain) -> DataFrame:
    out = C.without_largest(*designed(d, C.NAMES), C.BETA_A, target(), menu(d))
    return out.groupBy("country", "city").agg(F.round(F.sum("p"), 4).alias("before"), F.round(F.sum("p_after"), 4).alias("after"))


@query("utility_decomposition", f"WITH {_OCC} SELECT country, " + ", ".join(_tidy(f"(avg({n}) FILTER (chosen = 1) - avg({n})) * ({b})::DOUBLE", 6, n) for n, b in zip(C.NAMES, C.BETA_A, strict=True)) + " FROM des GROUP BY 1")
def decomposition(d: Domain) -> DataFrame:
    return C.decompose(designed(d, C.NAMES)[0], C.BETA_A, ["country"]).select("country", *[tidy(n, 6) for n in C.NAMES])


_TOURS = f"t AS (SELECT country, city, tour, sum(p) AS expected, max(p) AS best, count(*)::BIGINT AS occasions, median(room_needed)::DOUBLE AS room_needed FROM {_scored()} GROUP BY 1, 2, 3)"


def tours_of_city_frame(d: Domain) -> DataFrame:
    return C.tours_of_city(C.probabilities(designed(d, C.NAMES)[0], C.BETA_A), ["country", "city"])


@query("tours_of_city", f"WITH {_OCC}, {_TOURS} SELECT country, city, tour, round(expected, 5) AS expected, round(best, 5) AS best, occasions, room_needed, (best >= 0.02)::INT AS in_play FROM t")
def tours_of_city(d: Domain) -> DataFrame:
    t = tours_of_city_frame(d)
    return t.select("country", "city", "tour", F.round("expected", 5).alias("expected"), F.round("best", 5).alias("best"), "occasions", "room_needed", "in_play")


_CHANCE = ", ".join(f"({i}, '{b}')" for i, (_, b) in enumerate(C.CHANCE_BANDS))


@query("chance_shape", f"WITH {_OCC}, {_TOURS}, b AS (SELECT country, city, CASE " + " ".join(f"WHEN best >= {x} THEN '{b}'" for x, b in C.CHANCE_BANDS) + f" END AS band, count(*)::BIGINT AS tours, round(sum(expected), 2) AS expected FROM t GROUP BY 1, 2, 3), g AS (SELECT c.*, x.* FROM (SELECT DISTINCT country, city FROM t) c CROSS JOIN (VALUES {_CHANCE}) x(place, band)), f AS (SELECT g.country, g.city, place, g.band, coalesce(tours, 0)::BIGINT AS tours, coalesce(expected, 0)::DOUBLE AS expected FROM g LEFT JOIN b USING (country, city, band)) SELECT *, round(expected / nullif(sum(expected) OVER (PARTITION BY country, city), 0), 3) AS share FROM f")
def chance_shape(d: Domain) -> DataFrame:
    return C.chance_shape(tours_of_city_frame(d), ["country", "city"])


@query("cities_of_tour", f"WITH {_OCC}, c AS (SELECT tour, country, city, avg(p) AS chance, avg(p_after) AS chance_after, count(*)::BIGINT AS menus, max(chosen) AS played FROM {_with_room(60000)} GROUP BY 1, 2, 3), r AS (SELECT *, rank() OVER (PARTITION BY tour, country ORDER BY round(chance, 12) DESC)::INT AS rank_before, rank() OVER (PARTITION BY tour, country ORDER BY round(chance_after, 12) DESC)::INT AS rank_after FROM c) SELECT tour, country, city, round(chance, 5) AS chance, round(chance_after, 5) AS chance_after, menus, played, rank_before, rank_after, rank_before - rank_after AS rank_move FROM r")
def cities_of_tour(d: Domain) -> DataFrame:
    rows, constants = designed(d, C.NAMES)
    scored = C.counterfactual(rows, constants, C.BETA_A, target() & C.applies("indoor"), *C.with_room(F.lit(60000)))
    out = C.cities_of_tour(scored, ["country", "city"])
    return out.withColumn("chance", F.round("chance", 5)).withColumn("chance_after", F.round("chance_after", 5))


@query("touring_share", f"WITH {VISITS}, {_MENU}, {CITIES_ONLY}, n AS (SELECT tour FROM visits GROUP BY 1 HAVING count(*) >= 2), s AS (SELECT country, city, sum(shows)::BIGINT AS touring FROM visits WHERE tour IN (SELECT tour FROM n) GROUP BY 1, 2), x AS (SELECT country, city, events, coalesce(touring, 0)::BIGINT AS touring, coalesce(touring, 0) / events AS share FROM cities LEFT JOIN s USING (country, city) WHERE events > 0) SELECT country, city, events, touring, round(share, 5) AS share, CASE WHEN share >= 0.55 THEN 'most of the calendar' WHEN share >= 0.3 THEN 'about half of the calendar' ELSE 'a small corner of the year' END AS verdict FROM x")
def touring_share(d: Domain) -> DataFrame:
    return C.touring_share(d.visits(), d.cities()).withColumn("share", F.round("share", 5))


@query("logit_fit")
def logit_fit(d: Domain) -> DataFrame:
    """A fit needs variables that vary; the test tables have no income to tell cities of a country apart, so specification A goes without."""
    fit = X.fit_logit(written(designed(d, C.NAMES)[0].select("occasion", "tour", "chosen", *C.NAMES)), C.NAMES, "occasion", "chosen", "tour")
    return d.spark.createDataFrame(fit.summary())


@query("expected_bands")
def expected_bands(d: Domain) -> DataFrame:
    rows = written(designed(d, C.NAMES)[0].select("occasion", "tour", "country", "city", "chosen", *C.NAMES))
    return C.simulate(rows, X.fit_logit(rows, C.NAMES, "occasion", "chosen", "tour"), ["country", "city"])
