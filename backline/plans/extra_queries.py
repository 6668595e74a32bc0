"""Further queries of screening, box office, enrichment and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import identity as I
from ..operators import market as M
from ..operators import models as X
from ..operators import reports as R
from .domain import CITIES_ONLY, EVENTS, RUNS, VENUES, VISITS, Domain
from .registry import query

_NIGHTS = "nights AS (SELECT l_suppkey AS venue_no, count(*) AS events FROM lineitem GROUP BY 1), venues AS (SELECT p.*, coalesce(n.events, 0)::BIGINT AS events FROM places p LEFT JOIN nights n USING (venue_no))"


@query("screen_assessable", f"""WITH {VISITS}, {_NIGHTS}, {CITIES_ONLY}, ind AS (SELECT country, city, sum(events) FILTER (io = 'inside')::BIGINT AS indoor_events FROM venues GROUP BY 1, 2),
tr AS (SELECT country, tour, sum(shows)::BIGINT AS shows, sum(indoor) AS indoor, sum(outdoor) AS outdoor, median(largest)::DOUBLE AS room, median(largest_indoor)::DOUBLE AS room_in, median(largest_outdoor)::DOUBLE AS room_out FROM visits GROUP BY 1, 2),
sk AS (SELECT c.country, c.city, t.*  EXCLUDE (country), CASE WHEN indoor > outdoor THEN 'indoor' WHEN outdoor > indoor THEN 'outdoor' ELSE 'either' END AS plays FROM (SELECT DISTINCT country, city FROM visits) c JOIN tr t ON c.country = t.country WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.country = c.country AND v.city = c.city AND v.tour = t.tour)),
te AS (SELECT s.country, s.city, s.shows, coalesce(CASE plays WHEN 'indoor' THEN room_in WHEN 'outdoor' THEN room_out ELSE room END, room) AS needs, (CASE plays WHEN 'indoor' THEN k.ceiling_indoor WHEN 'outdoor' THEN k.ceiling_outdoor ELSE k.ceiling END)::DOUBLE AS lim FROM sk s JOIN cities k ON s.country = k.country AND s.city = k.city),
ag AS (SELECT country, city, count(*)::BIGINT AS skipped_tours, count(*) FILTER (needs IS NOT NULL AND (lim IS NULL OR needs > lim * 1.2::DOUBLE))::BIGINT AS gap_tours, coalesce(sum(shows) FILTER (needs IS NOT NULL AND (lim IS NULL OR needs > lim * 1.2::DOUBLE)), 0)::BIGINT AS gap_dates FROM te GROUP BY 1, 2),
j AS (SELECT k.country, k.city, coalesce(skipped_tours, 0)::BIGINT AS skipped_tours, coalesce(gap_tours, 0)::BIGINT AS gap_tours, coalesce(gap_dates, 0)::BIGINT AS gap_dates, CASE WHEN indoor_events >= 10 AND population >= 250000 THEN 1 ELSE 0 END AS assessable FROM cities k JOIN ind USING (country, city) LEFT JOIN ag USING (country, city))
SELECT *, round_even(gap_dates / nullif(max(skipped_tours) OVER (PARTITION BY country), 0) * 1000, 0) AS gap_per_1k, (rank() OVER (PARTITION BY country ORDER BY gap_dates DESC))::INT AS rank_in_country FROM j""")
def screen_assessable(d: Domain) -> DataFrame:
    indoor = d.venues().groupBy("country", "city").agg(F.sum(F.when(F.col("io") == "inside", F.col("events"))).alias("indoor_events"))
    markets = d.cities().join(indoor, ["country", "city"])
    tested = M.capacity_test(M.skipped_everywhere(d.visits()), M.ceilings(d.venues(), ["country", "city"]))
    cols = ["country", "city", "skipped_tours", "gap_tours", "gap_dates", "assessable", "gap_per_1k", "rank_in_country"]
    return M.screen(markets, tested).select(*cols)


@query("city_peers", f"WITH {VENUES}, {CITIES_ONLY} SELECT country, city, events, venues, ceiling, round(events::DOUBLE / venues, 4) AS per_venue, (row_number() OVER (ORDER BY events DESC, city))::INT AS place FROM cities")
def city_peers(d: Domain) -> DataFrame:
    c = d.cities().select("country", "city", "events", "venues", "ceiling", F.round(F.col("events") / F.col("venues"), 4).alias("per_venue"))
    return R.ranked(c, F.desc("events"), "city")


@query("month_io_pivot", f"WITH {EVENTS} SELECT month(date_iso::DATE)::INT AS month, count(*) FILTER (io = 'inside')::BIGINT AS inside, count(*) FILTER (io = 'outside')::BIGINT AS outside, count(*)::BIGINT AS \"all\" FROM events GROUP BY 1")
def month_io(d: Domain) -> DataFrame:
    return R.pivot_counts(d.events().withColumn("month", F.month(F.col("date_iso").cast("date"))), "month", "io", ["inside", "outside"])


@query("gross_curve", f"WITH {VENUES} SELECT venue_no, " + ", ".join(f"round(exp(0.223::DOUBLE + 1.389::DOUBLE * ln(greatest(capacity, 1)::DOUBLE)) * greatest(1 + (venue_no % 41 - 20) / 80.0::DOUBLE, 0.1::DOUBLE) * exp({z}::DOUBLE * 0.9::DOUBLE), 2) AS {n}" for n, z in (("median", "0"), ("p25", "-0.6745"), ("p75", "0.6745"))) + " FROM venues")
def gross_curve(d: Domain) -> DataFrame:
    v = d.venues().select("venue_no", *X.gross_curve(F.col("capacity"), F.col("venue_no") % 41 - 20, 1.389, 0.223, 0.9))
    return v.select("venue_no", *[F.round(c, 2).alias(c) for c in ("median", "p25", "p75")])


@query("split_half", f"WITH {RUNS}, h AS (SELECT venue, gross_usd, (row_number() OVER (PARTITION BY venue ORDER BY pid) - 1) % 2 AS h FROM runs), m AS (SELECT venue, avg(gross_usd) FILTER (h = 0) AS a, avg(gross_usd) FILTER (h = 1) AS b, count(*) AS n FROM h GROUP BY 1) SELECT count(*)::BIGINT AS units, round(corr(a, b), 6) AS reliability FROM m WHERE n >= 4")
def split_half(d: Domain) -> DataFrame:
    return X.split_half(d.runs(), "venue", "gross_usd", ["pid"]).withColumn("reliability", F.round("reliability", 6))


@query("can_host", f"WITH {VENUES}, n AS (SELECT *, CASE WHEN venue_no % 8 <> 0 THEN (venue_no * 977 % 60000)::BIGINT END AS need, ['indoor', 'outdoor', 'either'][(venue_no % 7 % 3 + 1)::INT] AS plays FROM venues) SELECT venue_no, CASE WHEN need IS NULL THEN 'size unknown' WHEN NOT (plays = 'either' OR coalesce(plays = 'indoor' AND io = 'inside', false) OR coalesce(plays = 'outdoor' AND io = 'outside', false)) THEN 'wrong kind of room' WHEN need / 3 > capacity THEN 'far too small for the act' WHEN need > capacity THEN 'too big for this room' ELSE 'fits' END AS verdict FROM n")
def can_host(d: Domain) -> DataFrame:
    need = F.when(F.col("venue_no") % 8 != 0, F.col("venue_no") * 977 % 60000)
    plays = F.element_at(F.array(F.lit("indoor"), F.lit("outdoor"), F.lit("either")), (F.col("venue_no") % 7 % 3 + 1).cast("int"))
    return d.venues().select("venue_no", M.can_host(need, F.col("capacity"), plays, F.col("io")).alias("verdict"))


@query("enrichment_best", "WITH c AS (SELECT c_nationkey AS target, c_custkey AS candidate, c_custkey % 3 = 0 AS exact, (c_custkey % 100)::DOUBLE AS ratio, c_custkey % 5 = 0 AS city_ok, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 60)::DOUBLE END AS km, c_custkey % 2 = 0 AS country_ok FROM customer), s AS (SELECT target, candidate, CASE WHEN exact AND (city_ok OR coalesce(km <= 25, false)) THEN 'High' WHEN exact AND country_ok THEN 'Medium' WHEN ratio >= 88 AND NOT exact AND (city_ok OR coalesce(km <= 25, false)) THEN 'Medium' WHEN exact OR ratio >= 88 THEN 'Low' END AS confidence FROM c) SELECT target, candidate, confidence FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE confidence WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, candidate) AS r FROM s WHERE confidence IS NOT NULL) WHERE r = 1")
def enrichment_best(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    score = I.enrichment_score(k % 3 == 0, (k % 100).cast("double"), k % 5 == 0, F.when(k % 7 != 0, (k % 60).cast("double")), k % 2 == 0)
    return I.best_candidates(d.raw("customer").select(F.col("c_nationkey").alias("target"), k.alias("candidate"), score.alias("confidence")), "target", "confidence", "candidate")


@query("blank_country_splits", f"WITH {VENUES}, v AS (SELECT 'hall ' || (venue_no % 9) AS name, CASE WHEN venue_no % 4 <> 0 THEN io END AS city, countryCode FROM venues) SELECT name, city, count(*) FILTER (trim(countryCode) = '')::BIGINT AS blank, count(DISTINCT nullif(countryCode, ''))::BIGINT AS codes, min(nullif(countryCode, '')) AS code FROM v GROUP BY 1, 2 HAVING count(*) FILTER (trim(countryCode) = '') > 0 AND count(nullif(countryCode, '')) > 0")
def blank_splits(d: Domain) -> DataFrame:
    v = d.venues().select(F.concat(F.lit("hall "), F.col("venue_no") % 9).alias("name"), F.when(F.col("venue_no") % 4 != 0, F.col("io")).alias("city"), "countryCode")
    return I.blank_country_splits(v, "name", "city", "countryCode")


@query("user_routes", "SELECT user_id, event_id, event_type, coalesce(lag(event_type) OVER w, 'First Show') AS previous_city, coalesce(lead(event_type) OVER w, 'Final Show') AS next_city FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def user_routes(d: Domain) -> DataFrame:
    e = d.raw("events").withColumn("tour", F.col("user_id").cast("string"))
    return E.route(e, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "previous_city", "next_city")
