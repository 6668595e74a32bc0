"""Queries of the market analytics and the models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import market as M
from ..operators import models as X
from ..operators import reports as R
from ..operators.identity import written
from .domain import CITIES, RUNS, SETLISTS, VENUES, Domain
from .choice_queries import km
from .registry import query
from .report_queries import _SKIPPED

def _towns(d: Domain) -> DataFrame:
    """Each supplier a town of its site's country."""
    return d.venues().withColumn("country", (F.col("site") % 25).cast("string")).withColumn("city", F.col("venue")).withColumn("venues", F.lit(1).cast("bigint"))


_TOWNS = f"{VENUES}, towns AS (SELECT (site % 25)::VARCHAR AS country, venue AS city, lat, lon, events, capacity, io, venue_no FROM venues)"
_POINTS = "points AS (SELECT c_custkey AS point, (c_custkey % 20)::VARCHAR AS country, 40.0::DOUBLE + (c_custkey * 37 % 1000)::DOUBLE / 100 AS lat, (c_custkey * 53 % 1500)::DOUBLE / 100 AS lon, floor(abs(c_acctbal))::BIGINT AS population FROM customer)"


def _points(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    return d.raw("customer").select(k.alias("point"), (k % 20).cast("string").alias("country"), (F.lit(40.0) + (k * 37 % 1000) / 100).alias("lat"), ((k * 53 % 1500) / 100).alias("lon"), F.floor(F.abs("c_acctbal")).cast("bigint").alias("population"))


@query("haversine_matrix", f"WITH {_TOWNS} SELECT a.country, a.city, b.city AS other, round({km('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS km FROM towns a JOIN towns b ON a.country = b.country AND a.city < b.city")
def haversine_matrix(d: Domain) -> DataFrame:
    t = _towns(d).select("country", "city", "lat", "lon")
    o = t.select("country", F.col("city").alias("other"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    return t.join(o, "country").where("city < other").select("country", "city", "other", F.round(S.haversine_km(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")), 3).alias("km"))


@query("radius_catchment", f"WITH {_TOWNS}, {_POINTS}, p AS (SELECT t.country, t.city, population, {km('t.lat', 't.lon', 'q.lat', 'q.lon')} AS km FROM towns t JOIN points q ON t.country = q.country) SELECT t.country, t.city, " + ", ".join(f"CASE WHEN t.country IN (SELECT country FROM points) THEN coalesce(sum(population) FILTER (km <= {r}), 0)::BIGINT END AS pop_{r}" for r in M.RADII) + " FROM towns t LEFT JOIN p USING (country, city) GROUP BY 1, 2")
def radius_catchment(d: Domain) -> DataFrame:
    return M.radius_catchment(_towns(d), _points(d))


@query("voronoi_catchment", f"WITH {_TOWNS}, {_POINTS}, p AS (SELECT point, city, population, {km('q.lat', 'q.lon', 't.lat', 't.lon')} AS km FROM towns t JOIN points q ON t.country = q.country) SELECT point, city AS market, round(km, 3) AS km, population FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, city) AS r FROM p WHERE km <= 150) WHERE r = 1")
def voronoi(d: Domain) -> DataFrame:
    return M.nearest_market(_points(d), _towns(d)).withColumn("km", F.round("km", 3))


@query("market_folding")
def market_folding(d: Domain) -> DataFrame:
    return M.fold_markets(_towns(d))


@query("city_rollup", f"WITH {CITIES} SELECT country, city, venues, events, ceiling, ceiling_indoor, ceiling_outdoor, population, lat, lon FROM cities")
def city_rollup(d: Domain) -> DataFrame:
    return d.cities()


@query("market_rollup", f"WITH {CITIES}, m AS (SELECT *, min(city) OVER (PARTITION BY country, events % 3) AS market FROM cities) SELECT country, market, count(*)::BIGINT AS cities, sum(venues)::BIGINT AS venues, sum(events)::BIGINT AS events, max(ceiling) AS ceiling, max(ceiling_indoor) AS ceiling_indoor, sum(population)::BIGINT AS population, string_agg(city, ', ' ORDER BY city) AS members, max(lat) FILTER (city = market) AS lat, max(lon) FILTER (city = market) AS lon FROM m GROUP BY 1, 2")
def market_rollup(d: Domain) -> DataFrame:
    c = d.cities()
    members = c.select("country", "city", F.min("city").over(Window.partitionBy("country", F.col("events") % 3)).alias("market"))
    return M.market_rollup(c, members)


_RUNGS = ", ".join(f"('{io}', {i}, '{b}')" for io in ("inside", "outside") for i, (_, b) in enumerate(S.LADDER_BANDS))
_RUNG = "CASE WHEN capacity IS NULL THEN 'capacity unknown' " + " ".join(f"WHEN capacity < {t} THEN '{b}'" for t, b in S.LADDER_BANDS[:-1]) + f" ELSE '{S.LADDER_BANDS[-1][1]}' END"


@query("ladder_gaps", f"WITH {VENUES}, v AS (SELECT country, io, {_RUNG} AS band, count(*)::BIGINT AS venues, sum(events)::BIGINT AS events FROM venues GROUP BY 1, 2, 3), g AS (SELECT country, r.* FROM (SELECT DISTINCT country FROM venues) CROSS JOIN (VALUES {_RUNGS}) r(io, rung, band)) SELECT g.country, g.io, g.rung, g.band, coalesce(venues, 0)::BIGINT AS venues, coalesce(events, 0)::BIGINT AS events, CASE WHEN coalesce(venues, 0) = 0 THEN 'none' WHEN venues = 1 THEN 'thin' ELSE 'served' END AS status FROM g LEFT JOIN v USING (country, io, band)")
def ladder_gaps(d: Domain) -> DataFrame:
    return M.ladder_gaps(d.venues(), ["country"])


_CEIL = "SELECT country, city, max(capacity) FILTER (io = 'inside') AS indoor, max(capacity) FILTER (io = 'outside') AS outdoor, max(capacity) AS overall, max(capacity) FILTER (io IS NULL) AS largest_unlabelled, count(*) FILTER (io IS NULL)::BIGINT AS unlabelled FROM venues GROUP BY 1, 2"


@query("ceilings", f"WITH {VENUES} {_CEIL}")
def ceilings(d: Domain) -> DataFrame:
    return M.ceilings(d.venues(), ["country", "city"])


_TEST = f"""{_SKIPPED}, nights AS (SELECT l_suppkey AS venue_no, count(*) AS events FROM lineitem GROUP BY 1), lim AS (SELECT max(capacity) FILTER (io = 'inside') AS indoor, max(capacity) FILTER (io = 'outside') AS outdoor, max(capacity) AS overall FROM places WHERE country = 'ASIA' AND city = 'NATION_2'),
need AS (SELECT s.*, coalesce(CASE plays WHEN 'indoor' THEN typical_indoor WHEN 'outdoor' THEN typical_outdoor ELSE typical_room END, typical_room) AS needs, (CASE plays WHEN 'indoor' THEN lim.indoor WHEN 'outdoor' THEN lim.outdoor ELSE lim.overall END)::DOUBLE AS ceil FROM skipped s, lim),
tested AS (SELECT *, CASE WHEN needs IS NULL THEN 'unknown' WHEN ceil IS NULL THEN 'capacity gap (none of this kind)' WHEN needs > ceil * 1.2::DOUBLE THEN 'capacity gap' WHEN needs > ceil * 0.8::DOUBLE THEN 'borderline' ELSE 'not capacity' END AS verdict FROM need)"""


def _tested(d: Domain) -> DataFrame:
    here = M.ceilings(d.venues().where("country = 'ASIA' AND city = 'NATION_2'"), [])
    return M.capacity_test(R.skipped_tours(d.visits(), "ASIA", "NATION_2"), here)


@query("capacity_verdict", f"WITH {_TEST} SELECT tour, plays, needs, ceil AS room_limit, round(needs / ceil, 2) AS ratio, verdict FROM tested")
def capacity_verdict(d: Domain) -> DataFrame:
    return _tested(d).select("tour", "plays", "needs", F.col("limit").alias("room_limit"), "ratio", "verdict")


@query("verdict_summary", f"WITH {_TEST} SELECT verdict, count(*)::BIGINT AS tours, sum(shows)::BIGINT AS shows, median(needs)::DOUBLE AS median_need, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM tested GROUP BY 1")
def verdict_summary(d: Domain) -> DataFrame:
    return M.verdict_summary(_tested(d))


@query("recommend_sizes", f"WITH {_TEST} SELECT plays, count(*)::BIGINT AS blocked, (round_even(quantile_cont(needs, 0.5) / 500, 0) * 500)::BIGINT AS median, (round_even(quantile_cont(needs, 0.75) / 500, 0) * 500)::BIGINT AS upper, (round_even(max(needs) / 500, 0) * 500)::BIGINT AS largest FROM tested WHERE verdict LIKE 'capacity gap%' GROUP BY 1")
def recommend_sizes(d: Domain) -> DataFrame:
    return M.recommend_sizes(_tested(d), ["plays"])


@query("peer_medians", f"WITH {CITIES} SELECT a.city, count(b.city)::BIGINT AS peers, median(b.ceiling)::DOUBLE AS median, median(b.ceiling)::DOUBLE - any_value(a.ceiling) AS below_peers FROM cities a LEFT JOIN cities b ON a.city <> b.city AND b.population > 0 AND b.population >= a.population * (1 - 0.35::DOUBLE) AND b.population <= a.population * (1 + 0.35::DOUBLE) WHERE a.population > 0 GROUP BY 1")
def peer_medians(d: Domain) -> DataFrame:
    return M.peers(d.cities(), "city", "population", "ceiling")


_CASES = "SELECT p_partkey AS market, (p_size % 12)::INT AS gap_tours, (p_size % 15)::INT AS skipped_tours, CASE WHEN p_partkey % 5 <> 0 THEN (p_size % 10)::DOUBLE / 10 END AS kept, CASE WHEN p_partkey % 3 <> 0 THEN p_size * 300 END AS indoor_ceiling, p_size * 250 + 2000 AS suggested, CASE WHEN p_partkey % 4 <> 0 THEN p_size - 20 END AS below_peers, p_partkey % 7 <> 0 AS assessable FROM part"


@query("rank_cases", f"""WITH s AS ({_CASES}), c AS (SELECT *, CASE WHEN NOT assessable OR skipped_tours <= 0 THEN 'unknown' WHEN coalesce(kept < 0.3::DOUBLE, false) THEN 'satellite' WHEN gap_tours >= 8 AND suggested > coalesce(indoor_ceiling, 0) AND coalesce(below_peers > 0, false) THEN 'build' WHEN gap_tours > 0 THEN 'too few' ELSE 'no case' END AS "case" FROM s)
SELECT market, "case", CASE WHEN "case" = 'build' THEN suggested - coalesce(indoor_ceiling, 0) END AS seats, round(gap_tours / nullif(skipped_tours, 0), 3) AS blocked_share FROM c""")
def rank_cases(d: Domain) -> DataFrame:
    s, k = F.col("p_size"), F.col("p_partkey")
    rows = d.raw("part").select(k.alias("market"), (s % 12).alias("gap_tours"), (s % 15).alias("skipped_tours"), F.when(k % 5 != 0, (s % 10) / 10).alias("kept"), F.when(k % 3 != 0, s * 300).alias("indoor_ceiling"), (s * 250 + 2000).alias("suggested"), F.when(k % 4 != 0, s - 20).alias("below_peers"), (k % 7 != 0).alias("assessable"))
    return M.market_case(rows).select("market", "case", "seats", "blocked_share")


@query("gross_ols", f"WITH {RUNS}, x AS (SELECT ln(avg_capacity) AS x, ln(gross_usd) AS y FROM runs WHERE avg_capacity >= 500 AND gross_usd > 0) SELECT count(*)::BIGINT AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)), 6) AS sigma, round(corr(y, x), 6) AS r FROM x")
def gross_ols(d: Domain) -> DataFrame:
    fit = X.gross_fit(d.runs(), "avg_capacity", "gross_usd")
    return fit.select("n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "sigma", "r")])


_PANEL = f"{SETLISTS}, c AS (SELECT venue, substr(date_iso, 1, 4)::INT AS year, count(*)::BIGINT AS shows FROM setlists GROUP BY 1, 2), panel AS (SELECT v.venue AS unit, y.year AS time, coalesce(shows, 0)::BIGINT AS y, [0, 1997, 1998, 1999, 0][(v.venue_no % 5 + 1)::INT] AS cohort FROM (SELECT DISTINCT venue, venue_no FROM setlists) v CROSS JOIN (SELECT DISTINCT year FROM c) y LEFT JOIN c ON v.venue = c.venue AND y.year = c.year)"


def _panel(d: Domain) -> DataFrame:
    """Shows of every venue and year, from one pass of the artist-nights, written once."""
    seen = written(d.setlists().groupBy("venue", "venue_no", F.substring("date_iso", 1, 4).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("shows")))
    p = X.balanced_panel(seen, "venue", "year", "shows")
    cohort = F.element_at(F.array(*[F.lit(x) for x in (0, 1997, 1998, 1999, 0)]), (F.col("venue_no") % 5 + 1).cast("int"))
    p = p.join(seen.select("venue", cohort.alias("cohort")).distinct(), "venue")
    return written(p.select(F.col("venue").alias("unit"), F.col("year").alias("time"), F.col("shows").alias("y"), "cohort"))


@query("panel_balanced", f"WITH {_PANEL} SELECT * FROM panel")
def panel_balanced(d: Domain) -> DataFrame:
    return _panel(d)


_ATT = f"""{_PANEL}, g AS (SELECT DISTINCT cohort AS g FROM panel WHERE cohort > 0), ch AS (SELECT g, p.time AS t, p.cohort = g AS own, p.y - b.y AS change FROM panel p, g JOIN panel b ON b.time = g - 1 WHERE b.unit = p.unit AND p.time <> g - 1 AND (p.cohort = g OR p.cohort = 0 OR (p.cohort > g AND p.cohort > p.time))),
att AS (SELECT g AS cohort, t AS time, avg(change) FILTER (own) - avg(change) FILTER (NOT own) AS att, count(*) FILTER (own)::BIGINT AS n_treated, count(*) FILTER (NOT own)::BIGINT AS n_control, t - g AS event_time FROM ch GROUP BY 1, 2 HAVING count(*) FILTER (own) >= 1 AND count(*) FILTER (NOT own) >= 2),
study AS (SELECT event_time, sum(att * n_treated) / sum(n_treated) AS effect, sum(n_treated)::BIGINT AS weight, count(*)::BIGINT AS cells FROM att GROUP BY 1)"""


@query("att_gt", f"WITH {_ATT} SELECT cohort, time, round(att, 6) AS att, n_treated, n_control, event_time FROM att")
def att_gt(d: Domain) -> DataFrame:
    return X.att_gt(_panel(d)).withColumn("att", F.round("att", 6))


@query("event_study", f"WITH {_ATT} SELECT event_time, round(effect, 6) AS effect, weight, cells FROM study")
def event_study(d: Domain) -> DataFrame:
    return X.event_study(X.att_gt(_panel(d))).withColumn("effect", F.round("effect", 6))


@query("pretrend", f"WITH {_ATT} SELECT round(sum(att * n_treated) FILTER (event_time >= 0) / sum(n_treated) FILTER (event_time >= 0), 6) AS att, round(sum(abs(att) * n_treated) FILTER (event_time < -1) / sum(n_treated) FILTER (event_time < -1), 6) AS pretrend FROM att")
def pretrend(d: Domain) -> DataFrame:
    return X.overall_att(X.att_gt(_panel(d))).select(F.round("att", 6).alias("att"), F.round("pretrend", 6).alias("pretrend"))


@query("detrend_wls", f"WITH {_ATT}, q AS (SELECT *, CASE WHEN event_time < -1 THEN weight ELSE 0 END::DOUBLE AS w FROM study), s AS (SELECT sum(w) AS w, sum(w * event_time) AS wx, sum(w * event_time * event_time) AS wxx, sum(w * effect) AS wy, sum(w * event_time * effect) AS wxy, count(*) FILTER (event_time < -1) AS leads FROM q), l AS (SELECT leads, (w * wxy - wx * wy) / nullif(w * wxx - wx * wx, 0) AS slope, (wxx * wy - wx * wxy) / nullif(w * wxx - wx * wx, 0) AS level FROM s) SELECT event_time, round(effect, 6) AS effect, weight, cells, round(CASE WHEN leads >= 3 AND slope IS NOT NULL THEN effect - (level + slope * event_time) ELSE effect END, 5) AS detrended FROM study, l")
def detrend_wls(d: Domain) -> DataFrame:
    return X.detrend(X.event_study(X.att_gt(_panel(d)))).withColumn("effect", F.round("effect", 6)).withColumn("detrended", F.round("detrended", 5))


@query("openings_cohorts", f"WITH {SETLISTS}, v AS (SELECT city, substr(date_iso, 1, 4)::INT AS year, count(*)::BIGINT AS shows FROM setlists GROUP BY 1, 2), f AS (SELECT city, min(1994 + venue_no % 8)::BIGINT AS opened FROM places WHERE capacity >= 30000 GROUP BY 1), b AS (SELECT city, sum(shows) AS before FROM v JOIN f USING (city) WHERE year < opened GROUP BY 1), r AS (SELECT c.city, opened, CASE WHEN opened IS NULL THEN 'no such room' WHEN opened < (SELECT min(year) FROM v) + 2 THEN 'too early' WHEN coalesce(before, 0) < 3 THEN 'too little before' ELSE '' END AS reason FROM (SELECT DISTINCT city FROM v) c LEFT JOIN f USING (city) LEFT JOIN b USING (city)) SELECT city, CASE reason WHEN 'no such room' THEN 0 WHEN '' THEN opened ELSE -1 END::BIGINT AS cohort, reason FROM r")
def openings(d: Domain) -> DataFrame:
    visits = d.setlists().groupBy("city", F.substring("date_iso", 1, 4).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("shows"))
    rooms = d.places().select("city", "capacity", (F.lit(1994) + F.col("venue_no") % 8).alias("opened"))
    return X.openings(rooms, visits, 30000).withColumn("cohort", F.col("cohort").cast("bigint"))
