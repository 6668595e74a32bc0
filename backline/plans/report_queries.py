"""Queries of the reports and of entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T
from ..operators import identity as I
from ..operators import reports as R
from .domain import EVENTS, PLACES, RUNS, SETLISTS, VENUES, VISITS, Domain
from .event_queries import _LEGS
from .registry import query

CATS = [f"Category {x}" for x in "ABCDE"]
HOME = ("ASIA", "NATION_12")


def _band_sql(value: str, bands: list[tuple[int, str]]) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'capacity unknown' " + " ".join(f"WHEN {value} < {top} THEN '{label}'" for top, label in bands[:-1]) + f" ELSE '{bands[-1][1]}' END"


@query("top_venues", f"""WITH {EVENTS}, m AS (SELECT venue_key, io, count(*) AS n FROM events WHERE io IS NOT NULL GROUP BY 1, 2), mi AS (SELECT venue_key, io FROM (SELECT *, row_number() OVER (PARTITION BY venue_key ORDER BY n DESC, io) AS r FROM m) WHERE r = 1),
c AS (SELECT venue_key, city, count(*) AS n FROM events GROUP BY 1, 2), mc AS (SELECT venue_key, city FROM (SELECT *, row_number() OVER (PARTITION BY venue_key ORDER BY n DESC, city) AS r FROM c) WHERE r = 1),
g AS (SELECT venue_key, min(venue) AS venue, count(*)::BIGINT AS events, count(DISTINCT headliner_key)::BIGINT AS headliners, max(capacity) AS capacity, min(date_iso) AS first_date, max(date_iso) AS last_date FROM events GROUP BY 1)
SELECT g.*, mi.io, mc.city, row_number() OVER (ORDER BY events DESC, g.venue_key)::INT AS place FROM g LEFT JOIN mi USING (venue_key) LEFT JOIN mc USING (venue_key)""")
def top_venues(d: Domain) -> DataFrame:
    return R.top_venues(d.events())


_FRAME = """tour_frame AS (SELECT tour, count(*)::BIGINT AS shows, count(*) FILTER (io = 'inside')::BIGINT AS inside, count(*) FILTER (io = 'outside')::BIGINT AS outside, count(*) FILTER (country = 'ASIA')::BIGINT AS area_shows,
  count(*) FILTER (country = 'ASIA' AND io = 'inside')::BIGINT AS area_inside, count(*) FILTER (country = 'ASIA' AND io = 'outside')::BIGINT AS area_outside, max(CASE WHEN country = 'ASIA' AND io = 'inside' THEN 1 ELSE 0 END) AS plays_inside,
  max(CASE WHEN country = 'ASIA' AND io = 'outside' THEN 1 ELSE 0 END) AS plays_outside, count(DISTINCT city)::BIGINT AS cities FROM events WHERE trim(tour) <> '' GROUP BY 1)"""


@query("tour_summary", f"WITH {EVENTS}, {_FRAME} SELECT * FROM tour_frame")
def tour_summary(d: Domain) -> DataFrame:
    return R.tour_frame(d.events(), F.col("country") == "ASIA")


@query("tour_funnel", f"""WITH {EVENTS}, {_FRAME}, s AS (SELECT 'all' AS segment, * FROM tour_frame UNION ALL SELECT 'indoor', * FROM tour_frame WHERE inside > outside UNION ALL SELECT 'outdoor', * FROM tour_frame WHERE outside > inside)
SELECT n.segment, count(tour)::BIGINT AS tours, count(*) FILTER (area_shows > 0)::BIGINT AS came, sum(shows)::BIGINT AS shows, round(count(*) FILTER (area_shows > 0) / nullif(count(tour), 0), 4) AS rate FROM (VALUES ('all'), ('indoor'), ('outdoor')) n(segment) LEFT JOIN s USING (segment) GROUP BY 1""")
def tour_funnel(d: Domain) -> DataFrame:
    return R.funnel(R.tour_frame(d.events(), F.col("country") == "ASIA"))


def _pivot_sql(key: str, column: str, values: list[str]) -> str:
    return f"SELECT {key}, " + ", ".join(f"""count(*) FILTER ({column} = '{v}')::BIGINT AS "{v}" """ for v in values) + f', count(*)::BIGINT AS "all" FROM e WHERE {key} IS NOT NULL GROUP BY 1'


@query("city_io_pivot", f"WITH {EVENTS}, e AS (SELECT * FROM events) {_pivot_sql('city', 'io', ['inside', 'outside'])}")
def city_io(d: Domain) -> DataFrame:
    return R.pivot_counts(d.events(), "city", "io", ["inside", "outside"])


@query("year_category_pivot", f"WITH {EVENTS}, e AS (SELECT *, substr(date_iso, 1, 4) AS year FROM events) {_pivot_sql('year', 'category', CATS)}")
def year_category(d: Domain) -> DataFrame:
    return R.pivot_counts(d.events().withColumn("year", F.substring("date_iso", 1, 4)), "year", "category", CATS)


def _season_sql(unit: str, n: int, at: str) -> str:
    return f"WITH {EVENTS}, c AS (SELECT {at}::INT AS u, count(*)::BIGINT AS n FROM events GROUP BY 1), k AS (SELECT i::INT AS {unit}, coalesce(n, 0)::BIGINT AS events FROM range(1, {n + 1}) t(i) LEFT JOIN c ON u = i) SELECT {unit}, events, round(events / (sum(events) OVER ()), 5) AS share FROM k"


@query("month_seasonality", _season_sql("month", 12, "month(date_iso::DATE)"))
def month_seasonality(d: Domain) -> DataFrame:
    return R.seasonality(d.events(), "month")


@query("doy_seasonality", _season_sql("day", 366, "dayofyear(date_iso::DATE)"))
def doy_seasonality(d: Domain) -> DataFrame:
    return R.seasonality(d.events(), "day")


@query("weekday_seasonality", _season_sql("weekday", 7, "isodow(date_iso::DATE)"))
def weekday_seasonality(d: Domain) -> DataFrame:
    return R.seasonality(d.events(), "weekday")


_BANDS = ", ".join(f"({i}, '{b}')" for i, b in enumerate([*[b for _, b in S.CAPACITY_BANDS], "capacity unknown"]))


@query("capacity_bands", f"""WITH {EVENTS}, b AS (SELECT {_band_sql("CASE WHEN venue_no % 11 <> 0 THEN capacity END", S.CAPACITY_BANDS)} AS band, count(*)::BIGINT AS events, count(DISTINCT venue_key)::BIGINT AS venues, count(DISTINCT headliner_key)::BIGINT AS headliners FROM events WHERE io = 'outside' GROUP BY 1),
k AS (SELECT place, l.band, coalesce(events, 0)::BIGINT AS events, coalesce(venues, 0)::BIGINT AS venues, coalesce(headliners, 0)::BIGINT AS headliners FROM (VALUES {_BANDS}) l(place, band) LEFT JOIN b USING (band))
SELECT *, CASE WHEN band <> 'capacity unknown' THEN round(events / nullif(sum(events) FILTER (band <> 'capacity unknown') OVER (), 0), 4) END AS of_known, round(events / nullif(sum(events) OVER (), 0), 4) AS of_all FROM k""")
def capacity_bands(d: Domain) -> DataFrame:
    return R.banded(d.events().where("io = 'outside'"), F.when(F.col("venue_no") % 11 != 0, F.col("capacity")), S.CAPACITY_BANDS)


@query("by_year_yoy", f"WITH {EVENTS}, y AS (SELECT substr(date_iso, 1, 4) AS year, count(*)::BIGINT AS events, count(DISTINCT headliner_key)::BIGINT AS headliners FROM events GROUP BY 1) SELECT *, round(events::DOUBLE / lag(events) OVER (ORDER BY year) - 1, 4) AS change FROM y")
def by_year(d: Domain) -> DataFrame:
    return R.yearly(d.events())


_SKIP = f"""{VISITS}, skipped AS (SELECT *, CASE WHEN indoor > outdoor THEN 'indoor' WHEN outdoor > indoor THEN 'outdoor' ELSE 'either' END AS plays FROM (SELECT tour, sum(shows)::BIGINT AS shows, count(*)::BIGINT AS cities, sum(indoor)::BIGINT AS indoor, sum(outdoor)::BIGINT AS outdoor,
  median(largest)::DOUBLE AS typical_room, median(largest_indoor)::DOUBLE AS typical_indoor, median(largest_outdoor)::DOUBLE AS typical_outdoor, min(first_date) AS first_date FROM visits WHERE country = '{{0}}' AND tour NOT IN (SELECT tour FROM visits WHERE country = '{{0}}' AND city = '{{1}}') GROUP BY 1))"""


def _home(d: Domain) -> tuple[str, str]:
    return "ASIA", "NATION_2"


_SKIPPED = _SKIP.replace("{0}", "ASIA").replace("{1}", "NATION_2")


@query("skipped_tours", f"WITH {_SKIPPED} SELECT * FROM skipped")
def skipped_tours(d: Domain) -> DataFrame:
    return R.skipped_tours(d.visits(), *_home(d))


@query("where_skippers_went", f"WITH {_SKIPPED} SELECT v.city, count(DISTINCT tour)::BIGINT AS tours, sum(v.shows)::BIGINT AS shows, max(largest) AS largest FROM visits v JOIN skipped s USING (tour) WHERE v.country = 'ASIA' GROUP BY 1")
def where_went(d: Domain) -> DataFrame:
    v = d.visits()
    went = v.where("country = 'ASIA'").join(R.skipped_tours(v, *_home(d)).select("tour"), "tour", "left_semi")
    return went.groupBy("city").agg(F.countDistinct("tour").alias("tours"), F.sum("shows").alias("shows"), F.max("largest").alias("largest"))


@query("artists_skipped", f"WITH {EVENTS} SELECT headliner, count(*)::BIGINT AS shows, count(DISTINCT city)::BIGINT AS cities FROM events WHERE country = 'ASIA' GROUP BY 1 HAVING count(*) FILTER (city = 'NATION_2') = 0")
def artists_skipped(d: Domain) -> DataFrame:
    rows = d.events().where("country = 'ASIA'").groupBy("headliner").agg(F.count(F.lit(1)).alias("shows"), F.countDistinct("city").alias("cities"), F.count_if(F.col("city") == "NATION_2").alias("here"))
    return rows.where("here = 0").drop("here")


@query("box_office_list", f"WITH {RUNS} SELECT artist_key, venue, start_iso, end_iso, n_shows, avg_capacity, gross_usd FROM runs WHERE city = 'NATION_2' AND n_shows >= 2")
def box_office(d: Domain) -> DataFrame:
    return d.runs().where("city = 'NATION_2' AND n_shows >= 2").select("artist_key", "venue", "start_iso", "end_iso", "n_shows", "avg_capacity", "gross_usd").orderBy(F.desc("gross_usd"), "artist_key")


@query("category_mix", f"WITH {EVENTS} SELECT venue_key, category, count(*)::BIGINT AS events, round(count(*) / sum(count(*)) OVER (PARTITION BY venue_key), 4) AS share FROM events GROUP BY 1, 2")
def category_mix(d: Domain) -> DataFrame:
    n = d.events().groupBy("venue_key", "category").agg(F.count(F.lit(1)).alias("events"))
    return n.withColumn("share", F.round(F.col("events") / F.sum("events").over(Window.partitionBy("venue_key")), 4))


@query("dominant_category", f"WITH {EVENTS}, n AS (SELECT venue_key, category, count(*)::BIGINT AS events FROM events GROUP BY 1, 2) SELECT venue_key, category, events FROM (SELECT *, row_number() OVER (PARTITION BY venue_key ORDER BY events DESC, category) AS r FROM n) WHERE r = 1")
def dominant_category(d: Domain) -> DataFrame:
    n = d.events().groupBy("venue_key", "category").agg(F.count(F.lit(1)).alias("events"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("venue_key").orderBy(F.desc("events"), "category"))).where("r = 1").drop("r")


_ADHOC = "category IN ('Category A', 'Category B', 'Category C') AND country = 'EUROPE' AND date_iso > '1997-01-01'"


@query("adhoc_venue_counts", f"WITH {EVENTS} SELECT venue, min(city) AS city, count(*)::BIGINT AS event_count FROM events WHERE {_ADHOC} GROUP BY 1")
def adhoc_venues(d: Domain) -> DataFrame:
    return d.events().where(_ADHOC).groupBy("venue").agg(F.min("city").alias("city"), F.count(F.lit(1)).alias("event_count"))


@query("adhoc_city_counts", f"WITH {EVENTS} SELECT city, count(*)::BIGINT AS event_count FROM events WHERE {_ADHOC} GROUP BY 1")
def adhoc_cities(d: Domain) -> DataFrame:
    return d.events().where(_ADHOC).groupBy("city").agg(F.count(F.lit(1)).alias("event_count"))


@query("gross_bands", f"WITH {RUNS}, b AS (SELECT CASE {' '.join(f'''WHEN avg_capacity > {a} AND avg_capacity <= {b} THEN '({a}, {b}]' ''' for a, b in zip(S.GROSS_BANDS, S.GROSS_BANDS[1:], strict=False))} END AS band, gross_usd FROM runs) SELECT band, count(*)::BIGINT AS runs, round(quantile_cont(gross_usd, 0.5), 1) AS median, round(quantile_cont(gross_usd, 0.25), 1) AS p25, round(quantile_cont(gross_usd, 0.75), 1) AS p75 FROM b WHERE band IS NOT NULL GROUP BY 1")
def gross_bands(d: Domain) -> DataFrame:
    return R.gross_bands(d.runs())


@query("pct_rank_avg", f"WITH {VENUES} SELECT venue_no, country, events, round((rank() OVER (PARTITION BY country ORDER BY events) + (count(*) OVER (PARTITION BY country, events) - 1) / 2) / count(*) OVER (PARTITION BY country), 6) AS pct FROM venues")
def pct_rank(d: Domain) -> DataFrame:
    return d.venues().select("venue_no", "country", "events", F.round(S.percent_rank_average(["country"], "events"), 6).alias("pct"))


@query("alias_ambiguous", "SELECT 'a' || (c_custkey % 900) AS alias, count(DISTINCT c_nationkey)::BIGINT AS n, CASE WHEN count(DISTINCT c_nationkey) > 1 THEN 1 ELSE 0 END AS ambiguous FROM customer GROUP BY 1")
def alias_ambiguous(d: Domain) -> DataFrame:
    return I.flag_counts(d.raw("customer").select(F.concat(F.lit("a"), F.col("c_custkey") % 900).alias("alias"), "c_nationkey"), "alias", "c_nationkey", 2, "ambiguous")


@query("alias_generic", "SELECT p_name AS alias, count(DISTINCT p_brand)::BIGINT AS n, CASE WHEN count(DISTINCT p_brand) >= 3 THEN 1 ELSE 0 END AS generic FROM part GROUP BY 1")
def alias_generic(d: Domain) -> DataFrame:
    return I.flag_counts(d.raw("part").select(F.col("p_name").alias("alias"), "p_brand"), "alias", "p_brand", 3, "generic")


@query("alias_passes", f"""WITH {PLACES}, ev AS (SELECT venue_no AS event_id, 'hall ' || (venue_no % 9) AS norm, CASE WHEN venue_no % 4 = 0 THEN city || ' west' ELSE city END AS city, country FROM places), al AS (SELECT 'hall ' || (venue_no % 9) AS norm, city, country, venue_no AS arena_id, CASE WHEN venue_no % 9 < 3 THEN 1 ELSE 0 END AS generic FROM places WHERE venue_no % 4 = 0),
j AS (SELECT e.event_id, min(arena_id) FILTER (e.city = a.city) AS one, min(arena_id) FILTER (starts_with(e.city, a.city || ' ') OR starts_with(a.city, e.city || ' ')) AS two, min(arena_id) FILTER (generic = 0) AS three FROM ev e JOIN al a USING (norm, country) GROUP BY 1)
SELECT event_id, coalesce(one, two, three) AS arena_id, CASE WHEN one IS NOT NULL THEN 1 WHEN two IS NOT NULL THEN 2 WHEN three IS NOT NULL THEN 3 END AS found_by FROM ev LEFT JOIN j USING (event_id)""")
def alias_passes(d: Domain) -> DataFrame:
    p = d.places()
    norm = F.concat(F.lit("hall "), F.col("venue_no") % 9).alias("norm")
    ev = p.select(F.col("venue_no").alias("event_id"), norm, F.when(F.col("venue_no") % 4 == 0, F.concat("city", F.lit(" west"))).otherwise(F.col("city")).alias("city"), "country")
    al = p.where("venue_no % 4 = 0").select(norm, "city", "country", F.col("venue_no").alias("arena_id"), F.when(F.col("venue_no") % 9 < 3, 1).otherwise(0).alias("generic"))
    return I.alias_passes(ev, al)


def _sites(d: Domain) -> DataFrame:
    """Venues whose place comes from their site, so that neighbours share country and city."""
    v = d.venues().withColumn("country", (F.col("site") % 25).cast("string")).withColumn("city", F.concat(F.lit("SITE_"), F.col("site")))
    names = F.element_at(F.array(*[F.lit(x) for x in ("grand hall", "grand hall 2", "the grand hall club", "city arena")]), (F.col("venue_no") % 4 + 1).cast("int"))
    return v.withColumn("norm", F.concat(names, F.lit(" "), F.col("site")))


@query("name_similarity_pairs")
def name_pairs(d: Domain) -> DataFrame:
    return I.similar_names(_sites(d)).select("country", "city", "keep_venue_no", "fold_venue_no", "score", "overlap")


@query("dedup_verdict")
def dedup_verdict(d: Domain) -> DataFrame:
    return I.dedup_verdict(I.similar_names(_sites(d))).select("keep_venue_no", "fold_venue_no", "capacity_ratio", "overlap", "verdict", "should_merge")


_NEAR = f"""{PLACES}, sp AS (SELECT venue_no, (site % 25)::VARCHAR AS country, lat, lon FROM places), mid AS (SELECT country, avg(lat) AS mid FROM sp GROUP BY 1), xy AS (SELECT venue_no, country, lon * 6371000.0::DOUBLE * pi() / 180 * cos(radians(mid)) AS x, lat * 6371000.0::DOUBLE * pi() / 180 AS y FROM sp JOIN mid USING (country)),
near AS (SELECT a.country, a.venue_no, b.venue_no AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS metres FROM xy a JOIN xy b ON a.country = b.country AND a.venue_no < b.venue_no WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25)"""


@query("colocated_pairs", f"WITH {_NEAR} SELECT country, venue_no, other, round(metres, 3) AS metres FROM near")
def colocated_pairs(d: Domain) -> DataFrame:
    return I.colocated(_sites(d)).select("country", "venue_no", "other", F.round("metres", 3).alias("metres"))


@query("colocated_clusters", f"WITH RECURSIVE {_NEAR}, e AS (SELECT venue_no AS u, other AS v FROM near UNION SELECT other, venue_no FROM near), r AS (SELECT u AS node, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON r.node = e.u) SELECT node, min(c) AS component FROM r GROUP BY 1")
def colocated_clusters(d: Domain) -> DataFrame:
    return I.connected_components(I.colocated(_sites(d)), "venue_no", "other")


_EDGES = "e0 AS (SELECT s_suppkey AS u, s_suppkey + 3 AS v FROM supplier WHERE s_suppkey % 7 < 4)"


@query("connected_components", f"WITH RECURSIVE {_EDGES}, e AS (SELECT u, v FROM e0 UNION SELECT v, u FROM e0), r AS (SELECT u AS node, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON r.node = e.u) SELECT node, min(c) AS component FROM r GROUP BY 1")
def components(d: Domain) -> DataFrame:
    edges = d.raw("supplier").where("s_suppkey % 7 < 4").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 3).alias("b"))
    return I.connected_components(edges)


@query("merge_survivors", f"WITH RECURSIVE {_EDGES}, e AS (SELECT u, v FROM e0 UNION SELECT v, u FROM e0), r AS (SELECT u AS node, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON r.node = e.u), k AS (SELECT node, min(c) AS component FROM r GROUP BY 1), s AS (SELECT component, first(node ORDER BY (node * 7919) % 101 DESC, node) AS survivor FROM k GROUP BY 1) SELECT node, survivor FROM k JOIN s USING (component)")
def merge_survivors(d: Domain) -> DataFrame:
    c = components(d)
    return I.survivors(c, c.select("node", ((F.col("node") * 7919) % 101).alias("weight")))


@query("resolve_chains", f"WITH RECURSIVE {_EDGES}, e AS (SELECT u, v FROM e0 UNION SELECT v, u FROM e0), r AS (SELECT u AS node, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON r.node = e.u), k AS (SELECT node, min(c) AS component FROM r GROUP BY 1), s AS (SELECT k.*, coalesce(min(u % 5), 99) AS rank, (EXISTS (SELECT 1 FROM e0 f WHERE f.u = k.node))::INT AS folded FROM k LEFT JOIN e0 ON v = node GROUP BY node, component), b AS (SELECT component, first(node ORDER BY rank, folded, node) AS survivor FROM s GROUP BY 1) SELECT node AS alias, survivor FROM k JOIN b USING (component) WHERE node <> survivor")
def resolve_chains(d: Domain) -> DataFrame:
    edges = d.raw("supplier").where("s_suppkey % 7 < 4").select(F.col("s_suppkey").alias("alias"), (F.col("s_suppkey") + 3).alias("canonical"), (F.col("s_suppkey") % 5).alias("trust"))
    return I.resolve_chains(edges)


@query("rename_grade", f"WITH {VENUES} SELECT venue_no, CASE WHEN (events % 5) = 0 THEN 'low' WHEN (capacity % 50) <= 25 AND 1 + (venue_no % 10)::DOUBLE / 20 <= 1.25 AND (events % 5) * 120 <= 400 THEN 'high' WHEN (capacity % 50) <= 25 AND (1 + (venue_no % 10)::DOUBLE / 20 <= 1.25 OR (events % 5) * 120 <= 400) THEN 'medium' ELSE 'low' END AS grade FROM venues")
def rename_grade(d: Domain) -> DataFrame:
    return d.venues().select("venue_no", S.rename_grade(F.col("capacity") % 50, 1 + (F.col("venue_no") % 10) / 20, (F.col("events") % 5) * 120).alias("grade"))


@query("identity_priority_dedupe", "WITH u AS (SELECT 'c' || (c_custkey % 500) AS alias, c_custkey AS canonical, ['dashboard', 'manual', 'dedup', 'arena_csv', 'geo'][(c_custkey % 5 + 1)::INT] AS source, (c_custkey * 31 % 5)::INT AS trust FROM customer) SELECT alias, canonical, source, trust FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY trust, canonical) AS r FROM u) WHERE r = 1")
def identity_dedupe(d: Domain) -> DataFrame:
    source = F.element_at(F.array(*[F.lit(x) for x in ("dashboard", "manual", "dedup", "arena_csv", "geo")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    u = d.raw("customer").select(F.concat(F.lit("c"), F.col("c_custkey") % 500).alias("alias"), F.col("c_custkey").alias("canonical"), source.alias("source"), (F.col("c_custkey") * 31 % 5).cast("int").alias("trust"))
    return I.first_by_trust(u, ["alias"], F.col("trust"), "canonical")


@query("enrich_targets", "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE c_custkey::DOUBLE END AS lat, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey ELSE 2 END::DOUBLE AS lon FROM customer), k AS (SELECT lat, lon FROM c GROUP BY 1, 2 HAVING count(*) > 20), e AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'not found' ELSE 'error' END AS status FROM customer WHERE c_custkey % 2 = 0) SELECT c.c_custkey AS venue_no, (k.lat IS NOT NULL)::INT AS centroid, mode FROM c LEFT JOIN k USING (lat, lon) CROSS JOIN (VALUES ('new'), ('errors'), ('all')) m(mode) WHERE mode = 'all' OR c_custkey NOT IN (SELECT c_custkey FROM e WHERE mode = 'new' OR status <> 'error')")
def enrich_targets(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    places = d.raw("customer").select(k.alias("venue_no"), F.when(k % 4 == 0, 1.0).otherwise(k.cast("double")).alias("lat"), F.when(k % 4 == 0, F.col("c_nationkey")).otherwise(2).cast("double").alias("lon"))
    status = F.element_at(F.array(F.lit("matched"), F.lit("not found"), F.lit("error")), (k % 3 + 1).cast("int"))
    known = d.raw("customer").where("c_custkey % 2 = 0").select(k.alias("venue_no"), status.alias("status"))
    parts = [I.enrichment_targets(places, known, redo).select("venue_no", "centroid", F.lit(redo).alias("mode")) for redo in I.REDO]
    return parts[0].union(parts[1]).union(parts[2])


_ROOMS = ["great theatre ii", "great theatre", "sports barn", "academy 3", "grand palace", "the loft", "hall iii north", "clubland"]


@query("subroom_names", f"WITH n AS (SELECT p_partkey, {_ROOMS}[(p_partkey % 8 + 1)::INT] AS name FROM part) SELECT p_partkey, name, (p_partkey % 8 IN (0, 2, 3, 5, 6, 7))::INT AS subroom FROM n")
def subroom_names(d: Domain) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(r) for r in _ROOMS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return d.raw("part").select("p_partkey", name.alias("name"), T.is_subroom(name).cast("int").alias("subroom"))


@query("status_counts", f"WITH {SETLISTS} SELECT (SELECT count(*) FROM setlists)::BIGINT AS setlists, (SELECT count(DISTINCT artist_key) FROM setlists)::BIGINT AS artists, (SELECT count(DISTINCT venue_no) FROM setlists)::BIGINT AS venues, (SELECT count(*) FROM setlists WHERE trim(tour) = '')::BIGINT AS without_tour, (SELECT max(date_iso) FROM setlists) AS last_date")
def status(d: Domain) -> DataFrame:
    return d.setlists().agg(F.count(F.lit(1)).alias("setlists"), F.countDistinct("artist_key").alias("artists"), F.countDistinct("venue_no").alias("venues"), F.count_if(~S.not_blank(F.col("tour"))).alias("without_tour"), F.max("date_iso").alias("last_date"))
