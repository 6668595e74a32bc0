"""Queries of venue assembly, aliases and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import identity as I
from ..operators import venues as V
from ..operators.identity import written
from .domain import PLACES, SETLISTS, VENUES, Domain
from .registry import query
from .report_queries import _NEAR, _sites

_TYPES = ["Arena", "Stadium", "Club", "Fairground", ""]
_TYPE_SQL = "['Arena', 'Stadium', 'Club', 'Fairground', '']"


def _events(d: Domain) -> DataFrame:
    """Artist-nights as events with a normalised venue, an observed capacity and a type."""
    n = F.col("venue_no")
    songs = F.split("setlist_id", "-")[0].cast("bigint")
    cap = F.when(songs % 3 != 0, F.col("num_songs").cast("bigint") * 1000 * F.when(songs % 97 == 0, 20).otherwise(1))
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (n % 5 + 1).cast("int"))
    return d.setlists().join(d.places().select("venue_no", F.col("lat").alias("latitude"), F.col("lon").alias("longitude")), "venue_no").select(
        "venue_no", F.when(n % 9 != 0, T.norm_ascii(F.col("venue"))).otherwise("").alias("venue_norm"), F.concat_ws("|", "venue", "city").alias("venue_key"), "venue", "city", F.lower("city").alias("city_norm"), "country", "countryCode",
        "latitude", "longitude", F.when(n % 8 == 0, n).alias("arena_id"), kind.alias("venue_type"), cap.alias("observed_capacity"), "date_iso",
    )


def _aliases(d: Domain) -> DataFrame:
    return d.places().where("venue_no % 6 = 1").select(T.norm_ascii(F.col("venue")).alias("alias_norm"), F.lower("city").alias("city_norm"), "countryCode", F.concat(F.lit("hall "), F.col("venue_no") % 4).alias("canonical_norm"))


def _arenas(d: Domain) -> DataFrame:
    n = F.col("venue_no")
    return d.places().where("venue_no % 8 = 0").select(n.alias("arena_id"), F.when(n % 16 == 0, 0).otherwise(F.col("capacity")).alias("concert_capacity"), F.when(n % 24 == 0, "").otherwise("Dome").alias("arena_type"), F.when(n % 32 == 0, "Inside").otherwise("").alias("outside_inside"))


def _enrichment(d: Domain) -> DataFrame:
    n = F.col("venue_no")
    uid = F.concat_ws("|", T.norm_ascii(F.col("venue")), F.lower("city"), F.col("countryCode"))
    return d.places().where("venue_no % 3 = 0").select(uid.alias("venue_uid"), F.lit("matched").alias("status"), F.when(n % 2 == 0, "High").otherwise("Low").alias("confidence"), (F.col("lat") + 1).alias("latitude"), (F.col("lon") + 1).alias("longitude"), F.when(n % 4 == 0, n * 5000).alias("capacity"), F.lit("Park").alias("venue_type"), F.lit("Outside").alias("outside_inside"))


_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9_]+', ' ', 'g'))"
_ASSEMBLY = f"""{SETLISTS}, ev AS (SELECT s.venue_no, CASE WHEN s.venue_no % 9 <> 0 THEN {_NORM.format('s.venue')} ELSE '' END AS venue_norm, s.venue || '|' || s.city AS venue_key, s.venue, s.city, lower(s.city) AS city_norm, s.country, s.countryCode, p.lat AS latitude, p.lon AS longitude,
  CASE WHEN s.venue_no % 8 = 0 THEN s.venue_no END AS arena_id, {_TYPE_SQL}[(s.venue_no % 5 + 1)::INT] AS venue_type, CASE WHEN split_part(setlist_id, '-', 1)::BIGINT % 3 <> 0 THEN num_songs::BIGINT * 1000 * CASE WHEN split_part(setlist_id, '-', 1)::BIGINT % 97 = 0 THEN 20 ELSE 1 END END AS cap, date_iso FROM setlists s JOIN places p USING (venue_no)),
al AS (SELECT {_NORM.format('venue')} AS alias_norm, lower(city) AS city_norm, countryCode, min('hall ' || (venue_no % 4)) AS canonical FROM places WHERE venue_no % 6 = 1 GROUP BY 1, 2, 3),
eu AS (SELECT ev.*, CASE WHEN venue_norm = '' THEN venue_key ELSE coalesce(canonical, venue_norm) || '|' || ev.city_norm || '|' || ev.countryCode END AS venue_uid FROM ev LEFT JOIN al ON al.alias_norm = ev.venue_norm AND al.city_norm = ev.city_norm AND al.countryCode = ev.countryCode),
ob AS (SELECT venue_uid, max(venue) AS venue, max(venue_norm) AS venue_norm, max(city) AS city, max(city_norm) AS city_norm, max(country) AS country, max(countryCode) AS countryCode, max(latitude) AS latitude, max(longitude) AS longitude, max(arena_id) AS arena_id, max(venue_type) AS ps_type,
  count(DISTINCT venue_key)::BIGINT AS n_keys, count(DISTINCT venue)::BIGINT AS n_names, string_agg(DISTINCT venue, ',' ORDER BY venue) AS aliases, count(*)::BIGINT AS events, min(date_iso) AS first_event, max(date_iso) AS last_event, max(cap) AS cap_max, floor(avg(cap))::BIGINT AS cap_typical, count(cap)::BIGINT AS cap_samples FROM eu GROUP BY 1),
tr AS (SELECT ob.*, CASE WHEN cap_samples >= 3 AND cap_typical > 0 AND cap_max > 3 * cap_typical THEN cap_max END AS cap_rejected, CASE WHEN cap_samples >= 3 AND cap_typical > 0 AND cap_max > 3 * cap_typical THEN (SELECT max(cap) FROM eu WHERE eu.venue_uid = ob.venue_uid AND cap <= 3 * ob.cap_typical) ELSE cap_max END AS cap_trimmed FROM ob),
ar AS (SELECT venue_no AS arena_id, CASE WHEN venue_no % 16 <> 0 THEN nullif(capacity, 0) END AS a_cap, CASE WHEN venue_no % 24 <> 0 THEN 'Dome' END AS a_type, CASE WHEN venue_no % 32 = 0 THEN 'Inside' END AS a_io FROM places WHERE venue_no % 8 = 0),
en AS (SELECT {_NORM.format('venue')} || '|' || lower(city) || '|' || countryCode AS venue_uid, lat + 1 AS e_lat, lon + 1 AS e_lon, CASE WHEN venue_no % 4 = 0 THEN venue_no * 5000 END AS e_cap FROM places WHERE venue_no % 3 = 0 AND venue_no % 2 = 0),
fa AS (SELECT tr.venue_uid, venue, venue_norm, city, city_norm, country, countryCode, coalesce(e_lat, latitude) AS latitude, coalesce(e_lon, longitude) AS longitude, CASE WHEN e_lat IS NOT NULL THEN 'lookup' ELSE 'events' END AS coords_source, n_keys, n_names, aliases, events, first_event, last_event, tr.arena_id,
  coalesce(a_cap, e_cap, cap_trimmed) AS capacity, CASE WHEN a_cap IS NOT NULL THEN 'dashboard' WHEN e_cap IS NOT NULL THEN 'lookup' WHEN cap_rejected IS NOT NULL THEN 'box office (outlier trimmed)' WHEN cap_trimmed IS NOT NULL THEN 'box office' END AS capacity_source, cap_max, cap_typical, cap_samples, cap_rejected,
  coalesce(a_type, nullif(ps_type, ''), CASE WHEN e_lat IS NOT NULL THEN 'Park' END) AS venue_type, CASE WHEN a_type IS NOT NULL THEN 'dashboard' WHEN ps_type <> '' THEN 'box office' WHEN e_lat IS NOT NULL THEN 'lookup' END AS venue_type_source,
  coalesce(a_io, CASE WHEN ps_type IN ('Stadium', 'Fairground') THEN 'Outside' WHEN ps_type IN ('Arena', 'Club') THEN 'Inside' END, CASE WHEN e_lat IS NOT NULL THEN 'Outside' END) AS outside_inside,
  CASE WHEN a_io IS NOT NULL THEN 'dashboard' WHEN ps_type <> '' THEN 'inferred from venue type' WHEN e_lat IS NOT NULL THEN 'lookup' END AS outside_inside_source FROM tr LEFT JOIN ar USING (arena_id) LEFT JOIN en USING (venue_uid)),
rv AS (SELECT *, nullif(concat_ws('; ', CASE WHEN events >= 20 THEN CASE WHEN capacity IS NULL AND outside_inside IS NULL THEN 'no capacity, no indoor/outdoor' WHEN capacity IS NULL THEN 'no capacity' WHEN outside_inside IS NULL THEN 'no indoor/outdoor' END END,
  CASE WHEN capacity > 100000 AND coalesce(venue_type, '') NOT IN ('Stadium', 'Outdoor Venues', 'Untyped Venue', '') THEN 'capacity implausible for venue type' END), '') AS review_reason FROM fa), vn AS (SELECT *, (review_reason IS NOT NULL)::INT AS needs_review FROM rv)"""


def assembled(d: Domain) -> tuple[DataFrame, DataFrame]:
    events = written(V.with_uid(_events(d), _aliases(d)))
    return events, V.assemble(events, _arenas(d), _enrichment(d))


@query("venue_assembly", f"WITH {_ASSEMBLY} SELECT * FROM vn")
def venue_assembly(d: Domain) -> DataFrame:
    return assembled(d)[1]


@query("venue_fact_precedence", f"WITH {_ASSEMBLY} SELECT venue_uid, capacity, capacity_source, venue_type, venue_type_source FROM vn")
def fact_precedence(d: Domain) -> DataFrame:
    return assembled(d)[1].select("venue_uid", "capacity", "capacity_source", "venue_type", "venue_type_source")


@query("venue_facts_attached", f"WITH {_ASSEMBLY} SELECT venue_capacity_source, venue_outside_inside, count(*)::BIGINT AS events, sum(venue_capacity)::BIGINT AS seats FROM (SELECT capacity AS venue_capacity, capacity_source AS venue_capacity_source, outside_inside AS venue_outside_inside FROM eu LEFT JOIN vn USING (venue_uid)) GROUP BY 1, 2")
def facts_attached(d: Domain) -> DataFrame:
    e, v = assembled(d)
    return V.attach(e, v).groupBy("venue_capacity_source", "venue_outside_inside").agg(F.count(F.lit(1)).alias("events"), F.sum("venue_capacity").alias("seats"))


@query("review_flags", f"WITH {_ASSEMBLY} SELECT review_reason, count(*)::BIGINT AS venues, sum(events)::BIGINT AS events FROM vn WHERE needs_review = 1 GROUP BY 1")
def review_flags(d: Domain) -> DataFrame:
    return assembled(d)[1].where("needs_review = 1").groupBy("review_reason").agg(F.count(F.lit(1)).alias("venues"), F.sum("events").alias("events"))


@query("arena_aliases", f"WITH {PLACES}, s AS (SELECT 'hall ' || (venue_no % 9) AS alias_norm, venue_no // 5 AS arena_id, city, ['identity', 'manual', 'name'][(venue_no % 3 + 1)::INT] AS source FROM places), o AS (SELECT *, row_number() OVER (PARTITION BY alias_norm, arena_id ORDER BY CASE source WHEN 'name' THEN 1 WHEN 'manual' THEN 4 ELSE 5 END, city) AS r FROM s), k AS (SELECT * FROM o WHERE r = 1), n AS (SELECT alias_norm, count(DISTINCT arena_id)::BIGINT AS n_arenas, count(DISTINCT city)::BIGINT AS n_cities FROM k GROUP BY 1) SELECT alias_norm, arena_id, city, source, n_arenas, n_cities, (n_arenas > 1)::INT AS ambiguous, (n_cities >= 3)::INT AS generic FROM k JOIN n USING (alias_norm)")
def arena_aliases(d: Domain) -> DataFrame:
    n = F.col("venue_no")
    source = F.element_at(F.array(F.lit("identity"), F.lit("manual"), F.lit("name")), (n % 3 + 1).cast("int"))
    return V.arena_aliases(d.places().select(F.concat(F.lit("hall "), n % 9).alias("alias_norm"), F.floor(n / 5).alias("arena_id"), "city", source.alias("source")))


@query("arena_by_venue_id", f"WITH {PLACES}, a AS (SELECT venue_id, min(venue_no) AS arena_id FROM places WHERE trim(venue_id) <> '' GROUP BY 1) SELECT o_orderkey, a.arena_id FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE (o_custkey % 130)::VARCHAR END AS venue_id FROM orders) o LEFT JOIN a USING (venue_id)")
def arena_by_id(d: Domain) -> DataFrame:
    k = F.col("o_custkey")
    runs = d.raw("orders").select("o_orderkey", F.when(k % 5 == 0, "").otherwise((k % 130).cast("string")).alias("venue_id"))
    return V.arena_by_id(runs, d.places().select(F.col("venue_no").alias("arena_id"), "venue_id")).select("o_orderkey", "arena_id")


@query("identity_clashes", "WITH u AS (SELECT 'c' || (c_custkey % 500) AS alias, c_custkey % 700 AS canonical, (c_custkey * 31 % 5)::INT AS trust FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY trust, canonical) AS r, count(*) OVER (PARTITION BY alias) AS n FROM u) SELECT r.alias, r.canonical, r.trust, k.names - 1 AS others FROM r JOIN (SELECT alias, count(DISTINCT canonical)::BIGINT AS names FROM u GROUP BY 1) k USING (alias) WHERE r.r = 1 AND names > 1")
def identity_clashes(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    return V.clashes(d.raw("customer").select(F.concat(F.lit("c"), k % 500).alias("alias"), (k % 700).alias("canonical"), (k * 31 % 5).cast("int").alias("trust")))


@query("foreign_key_remap", "WITH m AS (SELECT s_suppkey AS alias, s_suppkey - s_suppkey % 3 AS survivor FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey > 2) SELECT coalesce(survivor, l_suppkey) AS venue_no, count(*)::BIGINT AS nights FROM lineitem LEFT JOIN m ON alias = l_suppkey GROUP BY 1")
def remapped(d: Domain) -> DataFrame:
    k = F.col("s_suppkey")
    survivors = d.raw("supplier").where("s_suppkey % 3 <> 0 AND s_suppkey > 2").select(k.alias("alias"), (k - k % 3).alias("survivor"))
    return V.remap(d.raw("lineitem").select(F.col("l_suppkey").alias("venue_no")), "venue_no", survivors).groupBy("venue_no").agg(F.count(F.lit(1)).alias("nights"))


@query("coordinate_crowding", f"WITH {PLACES} SELECT venue_no, n AS names_here FROM places JOIN (SELECT round(lat, 6) AS x, round(lon, 6) AS y, count(DISTINCT venue)::BIGINT AS n FROM places GROUP BY 1, 2) c ON round(lat, 6) = x AND round(lon, 6) = y")
def coordinate_crowding(d: Domain) -> DataFrame:
    return V.crowding(d.places()).select("venue_no", "names_here")


@query("hybrid_venue_key", f"WITH {PLACES}, c AS (SELECT round(lat, 6) AS x, round(lon, 6) AS y, count(DISTINCT venue) AS n FROM places GROUP BY 1, 2) SELECT venue_no, CASE WHEN venue_no % 7 = 0 THEN 'alias:hall ' || (venue_no % 4) WHEN n <= 1 THEN printf('at,%.6f,%.6f', round(lat, 6), round(lon, 6)) ELSE lower(venue) || '|' || lower(city) END AS group_key FROM places JOIN c ON round(lat, 6) = x AND round(lon, 6) = y")
def hybrid_key(d: Domain) -> DataFrame:
    aliases = d.places().where("venue_no % 7 = 0").select("venue", F.concat(F.lit("hall "), F.col("venue_no") % 4).alias("canonical"))
    return V.hybrid_key(d.places(), aliases, 1).select("venue_no", "group_key")


@query("rename_review", f"WITH RECURSIVE {_NEAR}, nn AS (SELECT l_suppkey AS venue_no, count(*)::BIGINT AS events FROM lineitem GROUP BY 1), v AS (SELECT p.*, coalesce(events, 0) AS events, DATE '1990-01-01' + (venue_no % 4 * 1000)::INT AS first_event, DATE '1990-01-01' + (venue_no % 4 * 1000 + CASE WHEN venue_no % 8 < 4 THEN 700 ELSE 1100 END)::INT AS last_event FROM places p LEFT JOIN nn USING (venue_no)), e AS (SELECT venue_no AS u, other AS v FROM near UNION SELECT other, venue_no FROM near), r AS (SELECT u AS node, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON r.node = e.u), k AS (SELECT node, min(c) AS component FROM r GROUP BY 1), m AS (SELECT component, count(*)::BIGINT AS members, first(node ORDER BY events DESC, node) AS anchor FROM k JOIN v ON node = venue_no GROUP BY 1)," + """
g AS (SELECT component, members, anchor, b.venue_no, 1000 * 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin((radians(a.lat) - radians(b.lat)) / 2) ** 2 + cos(radians(b.lat)) * cos(radians(a.lat)) * sin(radians(a.lon - b.lon) / 2) ** 2))) AS metres, greatest(a.capacity, b.capacity)::DOUBLE / nullif(least(a.capacity, b.capacity), 0) AS ratio,
CASE WHEN a.first_event > b.last_event THEN date_diff('day', b.last_event, a.first_event) WHEN b.first_event > a.last_event THEN date_diff('day', a.last_event, b.first_event) ELSE 0 END::DOUBLE AS gap_days FROM k JOIN m USING (component) JOIN v b ON b.venue_no = node JOIN v a ON a.venue_no = anchor WHERE node <> anchor)
SELECT component, members, anchor, venue_no, round(metres, 1) AS metres, round(ratio, 3) AS capacity_ratio, gap_days, CASE WHEN gap_days > 0 THEN 'rename' ELSE 'concurrent' END AS kind, CASE WHEN gap_days = 0 THEN 'low' WHEN metres <= 25 AND coalesce(ratio <= 1.25, false) AND gap_days <= 400 THEN 'high' WHEN metres <= 25 AND (coalesce(ratio <= 1.25, false) OR gap_days <= 400) THEN 'medium' ELSE 'low' END AS confidence FROM g""")
def rename_review(d: Domain) -> DataFrame:
    n = F.col("venue_no")
    start = n % 4 * 1000
    day = lambda x: F.date_add(F.lit("1990-01-01").cast("date"), x.cast("int"))
    places = _sites(d).drop("first_event", "last_event").withColumn("first_event", day(start)).withColumn("last_event", day(start + F.when(n % 8 < 4, 700).otherwise(1100)))
    clusters = I.connected_components(I.colocated(places), "venue_no", "other")
    return V.rename_review(clusters, places.select("venue_no", "lat", "lon", "capacity", "events", "first_event", "last_event"))


@query("io_cascade", "WITH v AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN ' Inside ' WHEN s_suppkey % 4 = 1 THEN '' END AS v_io, CASE WHEN s_suppkey % 3 = 0 THEN 'OUTSIDE' END AS a_io, ['Hyde Park', 'Forum Club', 'Plain Name'][(s_suppkey % 3 % 2 + s_suppkey % 2 + 1)::INT] AS name FROM supplier), c AS (SELECT *, nullif(lower(trim(v_io)), '') AS a, nullif(lower(trim(a_io)), '') AS b, CASE name WHEN 'Hyde Park' THEN 'outside' WHEN 'Forum Club' THEN 'inside' END AS i FROM v) SELECT s_suppkey, coalesce(a, b, i, 'unknown') AS io, CASE WHEN a IS NOT NULL THEN 'venue' WHEN b IS NOT NULL THEN 'arena' WHEN i IS NOT NULL THEN 'inferred' ELSE 'unknown' END AS io_source FROM c")
def io_cascade(d: Domain) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.element_at(F.array(F.lit("Hyde Park"), F.lit("Forum Club"), F.lit("Plain Name")), (k % 3 % 2 + k % 2 + 1).cast("int"))
    v = d.raw("supplier").select("s_suppkey", F.when(k % 4 == 0, " Inside ").when(k % 4 == 1, "").alias("v_io"), F.when(k % 3 == 0, "OUTSIDE").alias("a_io"), name.alias("name"))
    return V.io_cascade(v, "v_io", "a_io", "name").select("s_suppkey", "io", "io_source")


#: Pairs of names (kept, folded, city, capacities, overlap of spans), one for each rule in order.
_PAIRS = [
    ("club", "club 11", "amsterdam", 10, 10, -1.0),
    ("fillmore", "fillmore west", "sf", 10, 10, -1.0),
    ("o2 academy 2", "academy", "liverpool", 10, 10, -1.0),
    ("paramount", "paramount lounge", "x", 10, 10, 0.9),
    ("ao dome", "men dome", "x", 100, 10, 0.9),
    ("ao dome", "men dome", "x", 100, 99, 0.9),
    ("paramount", "paramount lounge", "x", 10, 10, -0.9),
    ("ao dome", "men dome", "x", 100, 99, -0.1),
    ("paramount", "paramount theatre", "x", 1, None, None),
    ("garage ludlow", "garage ludlow cincinnati", "cincinnati", 1, None, -1.0),
    ("aa bb", "aa cc", "x", 100, 120, -1.0),
    ("aa bb", "aa dd", "x", 100, None, -1.0),
    ("aa bb", "aa ee", "x", 100, 500, -1.0),
]


@query("dedup_rules", "SELECT * FROM (VALUES ('club', 'club 11', 'separate: a name too generic for a building', 0), ('fillmore', 'fillmore west', 'separate: a word tells one room or site from others', 0), ('o2 academy 2', 'academy', 'separate: a number names a second room', 0), ('paramount', 'paramount lounge', 'separate: a smaller room, in use at the same time', 0), ('ao dome', 'men dome', 'separate: in use at the same time, one half the size', 0), ('ao dome', 'men dome', 'separate: both names in use at once', 0), ('paramount', 'paramount lounge', 'separate: a smaller room in the venue', 0), ('ao dome', 'men dome', 'merge: a new sponsor, spans apart', 1), ('paramount', 'paramount theatre', 'merge: descriptive words only', 1), ('garage ludlow', 'garage ludlow cincinnati', 'merge: descriptive words only', 1), ('aa bb', 'aa cc', 'merge: spans apart, capacities agree', 1), ('aa bb', 'aa dd', 'review: spans apart, capacity unknown', 0), ('aa bb', 'aa ee', 'review: unclear', 0)) t(keep_norm, fold_norm, verdict, should_merge)")
def dedup_rules(d: Domain) -> DataFrame:
    pairs = d.spark.createDataFrame(_PAIRS, "keep_norm string, fold_norm string, city string, keep_capacity bigint, fold_capacity bigint, overlap double")
    return I.dedup_verdict(pairs).select("keep_norm", "fold_norm", "verdict", F.col("should_merge").cast("int").alias("should_merge"))
