"""Queries of event assembly, matching, names and incremental loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T
from ..operators import events as E
from ..operators import reports as R
from ..operators import categorise as G
from ..operators.identity import written
from ..sources import ingest
from .domain import CATEGORIES, EVENTS, PLACES, RUNS, SETLISTS, VENUES, Domain
from .registry import query


@query("bill_collapse", f"WITH {EVENTS} SELECT * FROM events")
def bill_collapse(d: Domain) -> DataFrame:
    return d.events()


@query("headliner_rank", f"WITH {EVENTS} SELECT event_id, setlist_id, artist, category, slot::INT AS slot FROM slots")
def headliner_rank(d: Domain) -> DataFrame:
    return E.billed(d.setlists(), d.categories(), d.careers()).select("event_id", "setlist_id", "artist", "category", "slot")


_ROUTE = "CASE WHEN trim(tour) <> '' THEN coalesce(lag(city) OVER w, 'First Show') ELSE '' END AS previous_city, CASE WHEN trim(tour) <> '' THEN coalesce(lead(city) OVER w, 'Final Show') ELSE '' END AS next_city"


@query("route_prev_next", f"WITH {EVENTS} SELECT event_id, headliner, tour, city, {_ROUTE} FROM events WINDOW w AS (PARTITION BY headliner_key, tour ORDER BY date_iso, event_id)")
def route_prev_next(d: Domain) -> DataFrame:
    return E.route(d.events(), ["headliner_key", "tour"], ["date_iso", "event_id"]).select("event_id", "headliner", "tour", "city", "previous_city", "next_city")


@query("route_raw_artist_tour", f"WITH {SETLISTS} SELECT setlist_id, artist, tour, city, {_ROUTE} FROM setlists WINDOW w AS (PARTITION BY artist, tour ORDER BY date_iso, setlist_id)")
def route_raw(d: Domain) -> DataFrame:
    return E.route(d.setlists(), ["artist", "tour"], ["date_iso", "setlist_id"]).select("setlist_id", "artist", "tour", "city", "previous_city", "next_city")


_LEGS = """legs AS (SELECT * FROM (SELECT tour, event_id, date_iso, city, country, venue, capacity, lead(event_id) OVER w AS to_event_id, lead(date_iso) OVER w AS to_date_iso, lead(city) OVER w AS to_city, lead(country) OVER w AS to_country,
  lead(venue) OVER w AS to_venue, lead(capacity) OVER w AS to_capacity FROM events WHERE trim(tour) <> '' WINDOW w AS (PARTITION BY tour ORDER BY date_iso, event_id)) WHERE to_event_id IS NOT NULL)"""


@query("tour_legs", f"WITH {EVENTS}, {_LEGS} SELECT *, date_diff('day', date_iso::DATE, to_date_iso::DATE)::INT AS days_between FROM legs")
def tour_legs(d: Domain) -> DataFrame:
    return E.legs(d.events())


@query("leg_partners", f"WITH {EVENTS}, {_LEGS}, x AS (SELECT city AS place, to_city AS partner, 1 AS o, 0 AS i FROM legs WHERE city <> to_city UNION ALL SELECT to_city, city, 0, 1 FROM legs WHERE city <> to_city) SELECT place, partner, sum(o)::BIGINT AS legs_out, sum(i)::BIGINT AS legs_in, count(*)::BIGINT AS legs FROM x GROUP BY 1, 2")
def leg_partners(d: Domain) -> DataFrame:
    legs = E.legs(d.events()).where("city <> to_city")
    ends = legs.select(F.col("city").alias("place"), F.col("to_city").alias("partner"), F.lit(1).alias("o")).union(legs.select("to_city", "city", F.lit(0)))
    return ends.groupBy("place", "partner").agg(F.sum("o").alias("legs_out"), F.sum(1 - F.col("o")).alias("legs_in"), F.count(F.lit(1)).alias("legs"))


@query("leg_matrix", f"WITH {EVENTS}, {_LEGS} SELECT country, to_country, count(*)::BIGINT AS legs, median(date_diff('day', date_iso::DATE, to_date_iso::DATE))::DOUBLE AS median_days FROM legs GROUP BY 1, 2")
def leg_matrix(d: Domain) -> DataFrame:
    return E.legs(d.events()).groupBy("country", "to_country").agg(F.count(F.lit(1)).alias("legs"), F.percentile("days_between", F.lit(0.5)).alias("median_days"))


@query("tier_classify", f"WITH {CATEGORIES} SELECT artist_key, listeners, chart_rank, category FROM categories")
def tier_classify(d: Domain) -> DataFrame:
    return d.categories()


@query("tier_summary", f"WITH {CATEGORIES} SELECT category, count(*)::BIGINT AS artists, max(listeners) AS most_listeners, min(chart_rank) AS best_rank FROM categories GROUP BY 1")
def tier_summary(d: Domain) -> DataFrame:
    return d.categories().groupBy("category").agg(F.count(F.lit(1)).alias("artists"), F.max("listeners").alias("most_listeners"), F.min("chart_rank").alias("best_rank"))


@query("artist_two_level_counts", f"WITH {SETLISTS}, v AS (SELECT artist_key, venue_no, count(*) AS n FROM setlists GROUP BY 1, 2) SELECT artist_key, sum(n)::BIGINT AS shows, count(*)::BIGINT AS venues, max(n)::BIGINT AS most_at_one FROM v GROUP BY 1")
def two_level(d: Domain) -> DataFrame:
    v = d.setlists().groupBy("artist_key", "venue_no").agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("artist_key").agg(F.sum("n").alias("shows"), F.count(F.lit(1)).alias("venues"), F.max("n").alias("most_at_one"))


_SPELL = "upper(p_name)"


@query("canonical_spelling", f"WITH x AS (SELECT lower(p_name) AS k, CASE WHEN p_partkey % 3 = 0 THEN {_SPELL} ELSE p_name END AS spelling, count(*)::BIGINT AS uses FROM part GROUP BY 1, 2) SELECT k AS artist_key, spelling, uses FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY uses DESC, spelling) AS r FROM x) WHERE r = 1")
def canonical_spelling(d: Domain) -> DataFrame:
    p = d.raw("part").select(F.lower("p_name").alias("artist_key"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("spelling"))
    return G.commonest_spelling(p, "artist_key", "spelling")


_MATCH = f"""{RUNS}, ev AS (SELECT *, CASE WHEN venue_no % 3 <> 0 THEN venue_no // 4 END AS arena_id FROM events), rn AS (SELECT r.*, CASE WHEN p.venue_no % 5 <> 0 THEN p.venue_no // 4 END AS arena_id FROM runs r JOIN places p USING (venue)),
pairs AS (SELECT e.event_id, r.pid, CASE WHEN e.arena_id = r.arena_id THEN 1 WHEN e.venue = r.venue THEN 2 ELSE 3 END AS tier, CASE WHEN e.date_iso < r.start_iso THEN date_diff('day', r.start_iso::DATE, e.date_iso::DATE) WHEN e.date_iso > r.end_iso THEN date_diff('day', r.end_iso::DATE, e.date_iso::DATE) ELSE 0 END::INT AS day_off,
  r.n_shows, r.gross_usd FROM ev e JOIN rn r ON e.headliner_key = r.artist_key AND e.date_iso::DATE BETWEEN r.start_iso::DATE - 1 AND r.end_iso::DATE + 1 AND (e.arena_id = r.arena_id OR e.venue = r.venue OR e.city = r.city)),
matched AS (SELECT event_id, pid, tier, day_off, n_shows, gross_usd FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY tier, abs(day_off), n_shows, pid) AS nth FROM pairs) WHERE nth = 1)"""


def _sited(d: Domain) -> tuple[DataFrame, DataFrame]:
    """Events and runs with the arena, where it is known."""
    arena = lambda known: F.when(F.col("venue_no") % known != 0, F.floor(F.col("venue_no") / 4)).alias("arena_id")
    return d.events().select("*", arena(3)), d.runs().join(d.places().select("venue", arena(5)), "venue")


@query("range_match_tiered", f"WITH {_MATCH} SELECT * FROM matched")
def range_match(d: Domain) -> DataFrame:
    return E.match_runs(*_sited(d))


@query("match_summary_by_tier", f"WITH {_MATCH} SELECT coalesce(m.tier, 0) AS tier, count(*)::BIGINT AS events, count(*) FILTER (day_off <> 0)::BIGINT AS off_by_days, round(sum(gross_usd), 0) AS gross FROM events e LEFT JOIN matched m USING (event_id) GROUP BY 1")
def match_summary(d: Domain) -> DataFrame:
    e, runs = _sited(d)
    e = written(e)
    m = e.select("event_id").join(E.match_runs(e, runs), "event_id", "left")
    return m.groupBy(F.coalesce("tier", F.lit(0)).alias("tier")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("day_off") != 0).alias("off_by_days"), F.round(F.sum("gross_usd"), 0).alias("gross"))


@query("match_incremental", f"WITH {_MATCH}, previous AS (SELECT event_id, 'kept' AS pid FROM events WHERE substr(date_iso, 1, 4) <= '1997') SELECT * FROM previous UNION ALL SELECT e.event_id, coalesce(m.pid, 'none') FROM events e LEFT JOIN matched m USING (event_id) WHERE substr(e.date_iso, 1, 4) > '1997'")
def match_incremental(d: Domain) -> DataFrame:
    e, runs = _sited(d)
    e = written(e)
    before = e.where(F.substring("date_iso", 1, 4) <= "1997").select("event_id", F.lit("kept").alias("pid"))
    return E.match_incremental(e, runs, before)


@query("unmatched_anti", f"WITH {_MATCH} SELECT artist_key, venue, month, n_shows FROM runs WHERE pid NOT IN (SELECT pid FROM matched)")
def unmatched_anti(d: Domain) -> DataFrame:
    e, runs = _sited(d)
    runs = written(runs)
    return E.unmatched(runs, E.match_runs(e, runs)).select("artist_key", "venue", "month", "n_shows")


@query("duplicate_risk_semi", f"WITH {SETLISTS}, fixtures AS (SELECT o_orderkey AS fixture, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Supplier#' || lpad((o_custkey % 100 + 1)::VARCHAR, 9, '0') END AS venue, strftime(o_orderdate, '%Y-%m-%d') AS date_iso FROM orders) SELECT fixture, venue, date_iso, CASE WHEN venue <> '' AND (venue, date_iso) IN (SELECT venue, date_iso FROM setlists) THEN 1 ELSE 0 END AS duplicate_risk FROM fixtures")
def duplicate_risk(d: Domain) -> DataFrame:
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("o_custkey") % 100 + 1).cast("string"), 9, "0"))
    fixtures = d.raw("orders").select(F.col("o_orderkey").alias("fixture"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(name).alias("venue"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_iso"))
    return E.duplicate_risk(fixtures, d.setlists(), ["venue", "date_iso"])


@query("fixture_union", f"WITH {SETLISTS}, u AS (SELECT venue || '|' || date_iso AS key, 'setlists' AS origin, num_songs, 0 AS o FROM (SELECT venue, date_iso, max(num_songs) AS num_songs FROM setlists GROUP BY 1, 2) UNION ALL SELECT venue || '|' || start, 'runs', NULL, 1 FROM (SELECT venue, min(date_iso) AS start FROM setlists GROUP BY venue, substr(date_iso, 1, 7))) SELECT key, origin, num_songs FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o) AS r FROM u) WHERE r = 1")
def fixture_union(d: Domain) -> DataFrame:
    s = d.setlists()
    key = lambda day: F.concat("venue", F.lit("|"), day).alias("key")
    one = s.groupBy("venue", "date_iso").agg(F.max("num_songs").alias("num_songs")).select(key("date_iso"), F.lit("setlists").alias("origin"), "num_songs")
    two = s.groupBy("venue", F.substring("date_iso", 1, 7)).agg(F.min("date_iso").alias("start")).select(key("start"), F.lit("runs").alias("origin"))
    return E.union_sources([one, two], "key").select("key", "origin", "num_songs")


@query("country_backfill", f"WITH {SETLISTS}, k AS (SELECT country, countryCode, count(*) AS n FROM setlists WHERE countryCode <> '' GROUP BY 1, 2), dom AS (SELECT country, countryCode AS fill FROM (SELECT *, n / sum(n) OVER (PARTITION BY country) AS share, row_number() OVER (PARTITION BY country ORDER BY n DESC, countryCode) AS r FROM k) WHERE r = 1 AND share >= 0.9) SELECT setlist_id, country, coalesce(nullif(countryCode, ''), fill) AS countryCode FROM setlists LEFT JOIN dom USING (country)")
def country_backfill(d: Domain) -> DataFrame:
    return E.backfill(d.setlists().select("setlist_id", "country", "countryCode"), "country", "countryCode").select("setlist_id", "country", "countryCode")


@query("capacity_outlier_trim", "WITH s AS (SELECT l_suppkey AS venue_no, (l_quantity * 1000)::BIGINT * CASE WHEN l_orderkey % 997 = 0 THEN 20 ELSE 1 END AS cap FROM lineitem), t AS (SELECT venue_no, count(*)::BIGINT AS samples, floor(avg(cap))::BIGINT AS typical, max(cap) AS cap_max FROM s GROUP BY 1), k AS (SELECT s.venue_no, max(cap) AS kept FROM s JOIN t USING (venue_no) WHERE cap <= 3 * typical GROUP BY 1) SELECT t.*, CASE WHEN samples >= 3 AND typical > 0 AND cap_max > 3 * typical THEN kept ELSE cap_max END AS capacity, CASE WHEN samples >= 3 AND typical > 0 AND cap_max > 3 * typical THEN cap_max END AS rejected FROM t LEFT JOIN k USING (venue_no)")
def capacity_trim(d: Domain) -> DataFrame:
    s = d.raw("lineitem").select(F.col("l_suppkey").alias("venue_no"), ((F.col("l_quantity") * 1000).cast("bigint") * F.when(F.col("l_orderkey") % 997 == 0, 20).otherwise(1)).alias("cap"))
    return E.trimmed_capacity(s, "venue_no", "cap")


@query("tenant_test", f"WITH {SETLISTS}, a AS (SELECT artist_key, substr(date_iso, 1, 4) AS year, venue_no, count(*) AS n FROM setlists GROUP BY 1, 2, 3), y AS (SELECT artist_key, year, sum(n) AS dates, max(n) AS home FROM a GROUP BY 1, 2) SELECT artist_key, max(dates)::BIGINT AS best_dates, coalesce(max(home) FILTER (dates >= 8), 0)::BIGINT AS best_home, CASE WHEN max(dates) >= 8 AND coalesce(max(home) FILTER (dates >= 8), 0) >= 4 THEN 1 ELSE 0 END AS tenant FROM y GROUP BY 1")
def tenant_test(d: Domain) -> DataFrame:
    return E.tenants(d.setlists(), "artist_key", "venue_no", "date_iso")


@query("integrity_checks", f"WITH {EVENTS} SELECT (SELECT sum(n_artists)::BIGINT FROM events) AS bill_slots, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM setlists) AS source_rows, (SELECT count(*) FROM (SELECT 1 FROM events GROUP BY headliner_key, date_iso, venue_key HAVING count(*) > 1)) AS duplicates")
def integrity(d: Domain) -> DataFrame:
    return E.integrity(d.events(), d.setlists())


@query("venue_uid_assign", f"WITH {PLACES} SELECT venue_no, lower(regexp_replace(venue, '[^A-Za-z0-9]+', ' ', 'g')) || '|' || lower(replace(city, '_', '_')) || '|' || cc AS venue_uid FROM places")
def venue_uid(d: Domain) -> DataFrame:
    return d.places().select("venue_no", F.concat_ws("|", T.norm_ascii(F.col("venue")), F.lower("city"), "cc").alias("venue_uid"))


@query("norm_key", r"SELECT c_custkey, trim(regexp_replace(regexp_replace(replace(replace(lower(trim('The ' || c_name || ' & $ons')), '&', ' and '), '$', 's'), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g'))[5:] AS norm FROM customer")
def norm_key(d: Domain) -> DataFrame:
    return d.raw("customer").select("c_custkey", T.norm_key(F.concat(F.lit("The "), "c_name", F.lit(" & $ons"))).alias("norm"))


_GENRES = "['Rock, Sports', 'Sports Entertainment', 'comedy', 'Family Entertainment, Rock', 'Spoken Word', 'Pop', '']"


@query("genre_class", f"WITH g AS (SELECT p_partkey, {_GENRES}[(p_partkey % 7 + 1)::INT] AS genre FROM part) SELECT p_partkey, genre, CASE WHEN genre LIKE '%, Sports' THEN 'Sport' WHEN genre = 'Sports Entertainment' THEN 'Entertainment' WHEN genre = 'comedy' THEN 'Comedy' WHEN genre LIKE 'Family%' THEN 'Family' WHEN genre = 'Spoken Word' THEN 'Entertainment' ELSE 'Music' END AS class, CASE WHEN genre LIKE '%, Sports' THEN 'Sporting Event' WHEN genre IN ('Pop', '') THEN NULL ELSE 'Family, Entertainment, Comedy & Other' END AS event_type FROM g")
def genre_class(d: Domain) -> DataFrame:
    names = ["Rock, Sports", "Sports Entertainment", "comedy", "Family Entertainment, Rock", "Spoken Word", "Pop", ""]
    g = d.raw("part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % 7 + 1).cast("int")).alias("genre"))
    return g.withColumn("class", T.genre_class(F.col("genre"))).withColumn("event_type", T.event_type_for_genre(F.col("genre")))


@query("io_inference", "WITH v AS (SELECT s_suppkey, ['Teatro Romano', 'PalaSport Nord', 'Palazzo Vecchio', 'Hyde Park', 'Forum Club', 'Plain Name', 'Arena Sud'][(s_suppkey % 7 + 1)::INT] AS name FROM supplier) SELECT s_suppkey, name, CASE WHEN name IN ('Teatro Romano', 'Hyde Park', 'Arena Sud') THEN 'outside' WHEN name IN ('PalaSport Nord', 'Forum Club', 'Palazzo Vecchio') THEN 'inside' END AS io FROM v")
def io_inference(d: Domain) -> DataFrame:
    names = ["Teatro Romano", "PalaSport Nord", "Palazzo Vecchio", "Hyde Park", "Forum Club", "Plain Name", "Arena Sud"]
    v = d.raw("supplier").select("s_suppkey", F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("s_suppkey") % 7 + 1).cast("int")).alias("name"))
    return v.withColumn("io", T.io_from_name(F.col("name")))


@query("date_multi_parse", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def date_multi_parse(d: Domain) -> DataFrame:
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.date_format("o_orderdate", "M/d/yy")).otherwise("soon")
    return d.raw("orders").select("o_orderkey", S.parse_date(t).alias("day"))


def _raw_setlists(d: Domain) -> DataFrame:
    """Events as nested setlists of up to three songs in sets of two, as JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    song = lambda p: F.struct(F.concat(F.lit("song "), (k + p).cast("string")).alias("name"), (p == 2).alias("tape"))
    songs = F.transform(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda p: p <= k % 4), song)
    sets = F.filter(F.array(*[F.struct(F.slice(songs, at, 2).alias("song")) for at in (1, 3)]), lambda s: F.size(s["song"]) > 0)
    venue = F.struct(F.lit("v").alias("id"), F.struct(F.lit("Rome").alias("name"), F.struct(F.lit("IT").alias("code")).alias("country")).alias("city"))
    return d.raw("events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "dd-MM-yyyy").alias("eventDate"), venue.alias("venue"), F.struct(sets.alias("set")).alias("sets"))).alias("json"))


@query("songs_explode", "WITH s AS (SELECT event_id, (props::JSON->>'k')::INT AS k FROM events), x AS (SELECT event_id, unnest(range(1, k % 4 + 1)) AS position, k FROM s) SELECT event_id, position::INT AS position, ((position - 1) // 2 + 1)::INT AS set_no, 'song ' || (k + position) AS name, (position = 2)::INT AS tape FROM x")
def songs_explode(d: Domain) -> DataFrame:
    return ingest.explode_songs(_raw_setlists(d)).select(F.col("setlist_id").cast("bigint").alias("event_id"), "position", "set_no", "name", "tape")


@query("setlists_flatten", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date_iso, (props::JSON->>'k')::INT % 4 AS num_songs, 'Rome' AS city, 'IT' AS countryCode, '' AS tour FROM events")
def setlists_flatten(d: Domain) -> DataFrame:
    return ingest.flatten_setlists(_raw_setlists(d)).select(F.col("setlist_id").cast("bigint").alias("event_id"), "date_iso", "num_songs", "city", "countryCode", "tour")


@query("upsert_latest", "WITH r AS (SELECT user_id AS key, event_id AS version, CASE WHEN event_id % 3 = 0 THEN 'api' ELSE 'csv' END AS source, value FROM events) SELECT key, version, source, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN source = 'api' THEN 0 ELSE 1 END, version DESC) AS n FROM r) WHERE n = 1")
def upsert_latest(d: Domain) -> DataFrame:
    r = d.raw("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.when(F.col("event_id") % 3 == 0, "api").otherwise("csv").alias("source"), "value")
    return E.upsert(r.where("version % 2 = 0"), r.where("version % 2 = 1"), "key", "version", "source")


@query("venue_rollup", f"WITH {VENUES} SELECT venue_no, venue, city, country, capacity, io, events, first_event::VARCHAR AS first_event, last_event::VARCHAR AS last_event FROM venues")
def venue_rollup(d: Domain) -> DataFrame:
    return d.venues().select("venue_no", "venue", "city", "country", "capacity", "io", "events", F.col("first_event").cast("string").alias("first_event"), F.col("last_event").cast("string").alias("last_event"))


@query("venue_routes", f"WITH {EVENTS}, r AS (SELECT venue_key, headliner_key, {_ROUTE} FROM events WINDOW w AS (PARTITION BY headliner_key, tour ORDER BY date_iso, event_id)), g AS (SELECT venue_key, count(*)::BIGINT AS events, count(DISTINCT headliner_key)::BIGINT AS headliners, count(DISTINCT nullif(previous_city, ''))::BIGINT AS came_from, count(DISTINCT nullif(next_city, ''))::BIGINT AS went_to FROM r GROUP BY 1) SELECT *, row_number() OVER (ORDER BY events DESC, venue_key)::INT AS place FROM g")
def venue_routes(d: Domain) -> DataFrame:
    routed = E.route(d.events(), ["headliner_key", "tour"], ["date_iso", "event_id"])
    blank = lambda c: F.countDistinct(F.nullif(c, F.lit("")))
    v = routed.groupBy("venue_key").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("headliner_key").alias("headliners"), blank("previous_city").alias("came_from"), blank("next_city").alias("went_to"))
    return R.ranked(v, F.desc("events"), "venue_key")


@query("categorised_artists", f"WITH {SETLISTS}, v AS (SELECT artist_key, venue_no, count(*) AS n FROM setlists GROUP BY 1, 2), a AS (SELECT artist_key, sum(n)::BIGINT AS shows, max(n)::BIGINT AS most_at_one FROM v GROUP BY 1), {CATEGORIES}, g AS (SELECT artist_key, min(p_size) % 7 AS g FROM (SELECT lower(trim(p_name || ' ' || p_brand)) AS artist_key, p_size FROM part) GROUP BY 1) SELECT artist_key, CASE WHEN g IN (0, 1) AND shows >= 8 AND most_at_one >= 4 THEN 'Tenant Sporting Event' WHEN g IN (0, 1) THEN 'Non-Tenant Sporting Event' WHEN g = 2 THEN 'Family, Entertainment, Comedy & Other' ELSE category END AS category, shows FROM a JOIN categories USING (artist_key) JOIN g USING (artist_key)")
def categorised_artists(d: Domain) -> DataFrame:
    v = d.setlists().groupBy("artist_key", "venue_no").agg(F.count(F.lit(1)).alias("n"))
    artists = v.groupBy("artist_key").agg(F.sum("n").alias("shows"), F.count(F.lit(1)).alias("venues"), F.max("n").alias("most_at_one")).withColumn("name", F.col("artist_key"))
    cat = d.categories().withColumn("place", F.lit(1))
    genre = F.element_at(F.array(*[F.lit(g) for g in ("Sports", "Rock, basketball", "Comedy", "Rock", "Pop", "", "Jazz")]), (F.min("p_size") % 7 + 1).cast("int"))
    genres = d.raw("part").select(F.lower(F.trim(F.concat("p_name", F.lit(" "), "p_brand"))).alias("artist_key"), "p_size").groupBy("artist_key").agg(genre.alias("genre")).withColumn("place", F.lit(1))
    return G.categorise(artists, cat, cat, genres).select("artist_key", "category", "shows")


@query("rule_regression", f"WITH {CATEGORIES} SELECT artist_key, category, 'Category A' AS expected FROM categories WHERE category <> 'Category A' AND artist_key < 'm'")
def rule_regression(d: Domain) -> DataFrame:
    cat = d.categories()
    return G.verify(cat, cat.where("artist_key < 'm'").select("artist_key", F.lit("Category A").alias("category")))


@query("suspect_acts", f"WITH {SETLISTS}, b AS (SELECT venue_no FROM setlists GROUP BY 1 HAVING count(*) >= 100) SELECT artist_key, count(*)::BIGINT AS nights, count(DISTINCT venue_no)::BIGINT AS venues FROM setlists WHERE venue_no IN (SELECT venue_no FROM b) GROUP BY 1 HAVING count(DISTINCT venue_no) <= 3")
def suspect_acts(d: Domain) -> DataFrame:
    return G.suspects(d.setlists(), 100, 3)
