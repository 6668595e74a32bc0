"""Queries of loaders, search, box office and incremental state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boxoffice as B
from ..operators import events as E
from ..operators import market as M
from ..operators import models as X
from ..operators import reports as R
from ..operators import search as Q
from ..operators.identity import written
from ..sources import loaders as L
from ..streaming import upserts
from .domain import CITIES, EVENTS, PLACES, RUNS, SETLISTS, VENUES, Domain
from .market_queries import _panel
from .registry import query

_N = "trim(regexp_replace(lower({0}), '[^a-z0-9_]+', ' ', 'g'))"


def pick(values: list[str], at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


# Loaders: the test tables as sheets of text.


def _runs_sheet(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    return d.raw("orders").select(
        F.when(k % 11 == 0, "").when(k % 13 == 0, "n/a").otherwise(F.date_format("o_orderdate", "M/d/yyyy")).alias(" Start Date"), F.when(k % 3 == 0, F.date_format(F.date_add("o_orderdate", 2), "yyyy-MM-dd")).alias("End Date"),
        F.when(k % 5 == 0, "-").when(k % 7 == 0, "1,0").otherwise((k % 4).cast("string")).alias("Number of Shows"), F.when(k % 17 == 0, "  ").otherwise(F.concat(F.lit("The Act & "), F.col("o_custkey"))).alias("HEADLINER"),
        F.concat(F.lit("Hall-"), k % 50).alias("Venue"), F.lit("Rome ").alias("City"), F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0)).alias("Total Gross USD"), F.concat((k % 100).cast("string"), F.lit("%")).alias("Average Capacity Sold"),
    )


@query("load_box_office", """WITH s AS (SELECT o_orderkey AS k, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS start_iso, CASE WHEN k % 3 = 0 THEN strftime(o_orderdate::DATE + 2, '%Y-%m-%d') END AS e, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN 10 ELSE k % 4 END AS n, CASE WHEN k % 17 = 0 THEN '' ELSE 'The Act & ' || o_custkey END AS headliner, o_totalprice FROM orders)
SELECT start_iso, coalesce(e, start_iso) AS end_iso, coalesce(nullif(n, 0), 1)::BIGINT AS n_shows, headliner, 'act and ' || substr(headliner, 11) AS headliner_norm, 'Hall-' || (k % 50) AS venue, 'hall ' || (k % 50) AS venue_norm, 'Rome' AS city, floor(o_totalprice)::DOUBLE AS total_gross_usd, (k % 100)::DOUBLE AS avg_capacity_sold FROM s WHERE headliner <> '' AND start_iso <> ''""")
def load_box_office(d: Domain) -> DataFrame:
    return L.box_office(_runs_sheet(d)).select("start_iso", "end_iso", "n_shows", "headliner", "headliner_norm", "venue", "venue_norm", "city", "total_gross_usd", "avg_capacity_sold")


@query("load_fixtures", """WITH s AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS date_iso, 'Team ' || (o_custkey % 40) || CASE WHEN k % 4 <> 0 THEN ' vs Club vs ' || (k % 9) ELSE '' END AS headliner, ['EuroLeague', 'Pollstar', 'setlistfm', ''][(k % 4 + 1)::INT] AS source, CASE WHEN k % 5 = 0 THEN 'Artist' WHEN k % 2 = 0 THEN 'Tenant Sporting Event' ELSE 'Non-Tenant Sporting Event' END AS event_type FROM orders)
SELECT date_iso, headliner, CASE WHEN contains(headliner, ' vs ') THEN trim(substr(headliner, 1, strpos(headliner, ' vs ') - 1)) END AS home_team, CASE WHEN contains(headliner, ' vs ') THEN trim(substr(headliner, strpos(headliner, ' vs ') + 4)) END AS away_team, event_type, lower(source) AS source FROM s WHERE source NOT IN ('', 'Pollstar', 'setlistfm') AND event_type <> 'Artist'""")
def load_fixtures(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Team "), F.col("o_custkey") % 40, F.when(k % 4 != 0, F.concat(F.lit(" vs Club vs "), k % 9)).otherwise(""))
    kind = F.when(k % 5 == 0, "Artist").when(k % 2 == 0, "Tenant Sporting Event").otherwise("Non-Tenant Sporting Event")
    rows = d.raw("orders").select(F.lit("Dome").alias("venue"), F.lit("Rome").alias("Venue_City"), F.lit("Italy").alias("venue_country"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("event_date"), name.alias("headliner"), pick(["EuroLeague", "Pollstar", "setlistfm", ""], k % 4).alias("source"), kind.alias("event_category"))
    return L.fixtures(rows).select("date_iso", "headliner", "home_team", "away_team", "event_type", "source")


@query("load_arenas", "SELECT s_suppkey::VARCHAR AS arena_id, s_name AS name, floor(abs(s_acctbal))::DOUBLE AS concert_capacity, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 1990.0::DOUBLE END AS opened_year, s_name AS notes, 'x' AS notes_2 FROM supplier WHERE s_suppkey % 10 <> 0")
def load_arenas(d: Domain) -> DataFrame:
    k = F.col("s_suppkey")
    rows = d.raw("supplier").select(F.when(k % 10 == 0, "").otherwise(k.cast("string")).alias("Arena ID"), F.col("s_name").alias("Name"), F.format_number(F.floor(F.abs("s_acctbal")), 0).alias("Concert Capacity"), F.when(k % 3 == 0, "N/A").otherwise("1990").alias("Opened (year)"), F.concat("s_name", F.lit(" ")).alias("Notes"), F.lit("x").alias("notes!"))
    return L.arenas(rows.withColumnRenamed("Opened (year)", "Opened Year"))


@query("load_thresholds", "SELECT * FROM (VALUES ('cat_a_spotify', 41000000.0::DOUBLE, 'Category A: Spotify listeners'), ('cat_b_pollstar', 90.0::DOUBLE, 'CATEGORY B (Pollstar rank)'), ('tenant_min_per_venue', 4.0::DOUBLE, 'Tenant, dates per venue')) t(name, value, label)")
def load_thresholds(d: Domain) -> DataFrame:
    block = [(1, "Category A: Spotify listeners", "41,000,000"), (2, "category a spotify again", "5"), (3, "CATEGORY B (Pollstar rank)", "n/a"), (4, " CATEGORY B (Pollstar rank) ", "90"), (5, "Tenant, dates per venue", "4"), (6, "Other", "1"), (7, None, "3")]
    return L.thresholds(d.spark.createDataFrame(block, "place int, label string, value string"))


@query("load_fx_rates", "WITH c AS (SELECT n_nationkey AS place, upper(substr(n_name, 1, 3)) AS iso, n_nationkey::DOUBLE / 10 AS rate FROM nation WHERE n_nationkey > 0) SELECT iso, rate AS units_per_gbp, 'spot' AS basis FROM (SELECT *, row_number() OVER (PARTITION BY iso ORDER BY place DESC) AS r FROM c WHERE regexp_matches(iso, '^[A-Z]{3}$') AND rate <> 0) WHERE r = 1")
def load_fx(d: Domain) -> DataFrame:
    cells = d.raw("nation").select((F.col("n_nationkey") + 5).alias("place"), F.when(F.col("n_nationkey") == 0, " ISO").otherwise(F.lower(F.substring("n_name", 1, 3))).alias("a"), F.when(F.col("n_nationkey") == 0, "rate").otherwise((F.col("n_nationkey") / 10).cast("string")).alias("b"), F.lit(" spot ").alias("c"))
    prose = d.spark.createDataFrame([(1, "Rates as quoted", None, None), (2, "USD", "1.2", "before the header")], "place bigint, a string, b string, c string")
    return L.fx_rates(cells.unionByName(prose))


@query("load_hospitality", "SELECT s_name AS venue, " + _N.format("s_name") + " AS venue_norm, s_suppkey::DOUBLE * 10 AS price, 'Gold' AS package FROM supplier WHERE s_suppkey % 4 <> 0")
def load_hospitality(d: Domain) -> DataFrame:
    k = F.col("s_suppkey")
    rows = d.raw("supplier").select(F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(" "), "s_name")).alias("Team/Arena/Venue"), F.concat(F.lit("$"), k * 10).alias("Price"), F.lit("Gold").alias("Package Name"))
    return L.hospitality(rows).select("venue", "venue_norm", "price", "package")


@query("load_reviewed_merges", "SELECT 'fold ' || s_suppkey AS alias_norm, 'new york' AS city_norm, 'US' AS countryCode, 'keep ' || (s_suppkey % 5) AS canonical_norm FROM supplier WHERE s_suppkey % 3 = 0")
def load_reviewed(d: Domain) -> DataFrame:
    k = F.col("s_suppkey")
    rows = d.raw("supplier").select(F.concat(F.lit("keep "), k % 5).alias("keep_norm"), F.concat(F.lit("fold "), k).alias("fold_norm"), F.lit("New York").alias("city"), F.lit("US").alias("countryCode"), F.when(k % 3 == 0, "TRUE").when(k % 3 == 1, "False").alias("should_merge"), F.lit("Keep").alias("keep"), F.lit("ok").alias("verdict"))
    return L.reviewed_merges(rows).select("alias_norm", "city_norm", "countryCode", "canonical_norm")


@query("load_overrides", "SELECT 'name ' || s_suppkey AS alias, 'key' || s_suppkey AS artist_key FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def load_overrides(d: Domain) -> DataFrame:
    k = F.col("s_suppkey")
    rows = d.raw("supplier").select(F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit(" name "), k)).alias("Alias"), F.when(k % 5 != 0, F.concat(F.lit("KEY"), k)).alias("artist_key"))
    return L.overrides(rows, ["alias", "artist_key"], ("artist_key",))


@query("load_chart", "WITH c AS (SELECT lower(p_name) AS artist_key, p_name AS artist, p_size::BIGINT AS place, p_retailprice AS gross_usd FROM part) SELECT artist_key, any_value(place) AS place, count(*)::BIGINT * 0 + 1 AS rows FROM (SELECT *, row_number() OVER (PARTITION BY artist_key ORDER BY place DESC NULLS LAST) AS r FROM c) WHERE r = 1 GROUP BY 1")
def load_chart(d: Domain) -> DataFrame:
    rows = d.raw("part").select(F.concat("p_name", F.lit(" ")).alias("Artist"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("Rank"), F.col("p_retailprice").cast("string").alias("gross_usd"))
    return L.chart(rows, ["gross_usd"]).select("artist_key", "place", F.lit(1).cast("bigint").alias("rows"))


@query("best_rank_merge", "WITH c AS (SELECT lower(p_name) || p_partkey % 150 AS artist_key, p_size AS rank, p_partkey AS listeners FROM part) SELECT artist_key, rank, listeners FROM (SELECT *, row_number() OVER (PARTITION BY artist_key ORDER BY rank, listeners) AS r FROM c) WHERE r = 1")
def best_rank(d: Domain) -> DataFrame:
    return L.best_ranks(d.raw("part").select(F.concat(F.lower("p_name"), F.col("p_partkey") % 150).alias("artist_key"), F.col("p_size").alias("rank"), F.col("p_partkey").alias("listeners")))


@query("entity_facts", "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 7 <> 0 AND c_custkey * 1000 BETWEEN 1 AND 399999 THEN c_custkey * 1000 END AS capacity, CASE WHEN c_custkey % 5 <> 0 THEN 1900 + c_custkey % 120 END::INT AS opened_year, (c_custkey % 90)::DOUBLE AS latitude, NULL::DOUBLE AS longitude FROM customer")
def entity_facts(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    rows = d.raw("customer").select(k.cast("string").alias("id"), F.when(k % 7 == 0, "-").otherwise((k * 1000).cast("string")).alias("capacity"), F.when(k % 5 == 0, "+").otherwise(F.concat(F.lit("+"), F.lit(1900) + k % 120, F.lit("-01-01T00:00:00Z"))).alias("opened"), (k % 90).cast("string").alias("latitude"), F.lit("east").alias("longitude"))
    return L.entity_facts(rows)


@query("html_table_cells", "SELECT p_partkey AS page_id, p_size::BIGINT AS rank, p_name || ' & co' AS artist, (p_partkey * 1000)::BIGINT AS listeners, lower(p_name) || ' & co' AS artist_key FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL, p_name || ' & co', (p_partkey * 1000)::BIGINT, lower(p_name) || ' & co' FROM part WHERE p_partkey % 2 = 1")
def html_cells(d: Domain) -> DataFrame:
    """Pages with a chart in a table; even ones list rank first and odd ones have none."""
    even = F.col("p_partkey") % 2 == 0
    number = F.format_number(F.col("p_partkey") * 1000, 0)
    head = F.when(even, "<tr><th>#</th><th> Artist </th><th>Listeners</th></tr>").otherwise("<TR><TH>Listeners</TH><TH>Artist</TH></TR>")
    name = F.concat(F.lit("<a href='x'>"), "p_name", F.lit("</a> &amp; co"))
    body = F.when(even, F.concat(F.lit("<tr><td>"), "p_size", F.lit("</td><td>"), name, F.lit("</td><td>"), number, F.lit("</td></tr>"))).otherwise(F.concat(F.lit("<tr class='r'><td>"), number, F.lit("</td>\n<td>"), name, F.lit("</td></tr>")))
    pages = d.raw("part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("<table>"), head, body, F.lit("</table>")).alias("html"))
    return L.listeners_table(L.html_table(pages)).select("page_id", "rank", "artist", "listeners", "artist_key")


@query("page_tables", r"SELECT page_id, len(regexp_extract_all(html, '(?s)<tr[^>]*>.*?</tr>', 0))::BIGINT AS table_rows FROM pages WHERE len(regexp_extract_all(html, '(?s)<tr[^>]*>.*?</tr>', 0)) > 0")
def page_tables(d: Domain) -> DataFrame:
    return L.html_table(d.raw("pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("table_rows"))


# Search.


@query("since_categories", f"WITH {EVENTS} SELECT event_id, category FROM events WHERE date_iso::DATE >= DATE '1996-06-01' AND category IN ('Category A', 'Category C')")
def since_categories(d: Domain) -> DataFrame:
    return Q.since(d.events(), "1996-06-01", Q.categories(["a", "Category C"])).select("event_id", "category")


_FACETS = f"""{EVENTS}, vv AS (SELECT p.*, e.events, CASE WHEN p.venue_no % 3 <> 0 THEN 1900 + (p.venue_no % 90)::INT END AS opened_year, ['Arena', 'Club'][(p.venue_no % 2 + 1)::INT] AS venue_type FROM places p LEFT JOIN (SELECT venue_no, count(*)::BIGINT AS events FROM events GROUP BY 1) e USING (venue_no)),
mix AS (SELECT venue_no, category, count(*)::BIGINT AS events FROM events GROUP BY 1, 2), dom AS (SELECT venue_no FROM (SELECT *, row_number() OVER (PARTITION BY venue_no ORDER BY events DESC, category) AS r FROM mix) WHERE r = 1 AND category = 'Category B')"""


@query("faceted_search", f"WITH {_FACETS} SELECT venue_no, venue, capacity, events FROM vv WHERE coalesce(events, 0) >= 2 AND coalesce(capacity, 0) >= 100 AND capacity <= 60000 AND capacity > 0 AND contains(lower(venue), 'supplier') AND coalesce(opened_year, 0) >= 1901 AND opened_year <= 1985 AND opened_year > 0 AND venue_type = 'Club' AND venue_no IN (SELECT venue_no FROM dom)")
def faceted_search(d: Domain) -> DataFrame:
    e = written(d.events().select("venue_no", "category"))
    n = F.col("venue_no")
    v = d.places().join(e.groupBy("venue_no").agg(F.count(F.lit(1)).alias("events")), "venue_no", "left")
    v = v.withColumn("opened_year", F.when(n % 3 != 0, F.lit(1900) + (n % 90).cast("int"))).withColumn("venue_type", pick(["Arena", "Club"], n % 2))
    mix = e.groupBy("venue_no", "category").agg(F.count(F.lit(1)).alias("events"))
    found = Q.faceted(v, mix, least_events=2, least_capacity=100, most_capacity=60_000, contains="SUPPLIER", opened_from=1901, opened_to=1985, venue_type="Club", io=None, dominant="Category B")
    return found.select("venue_no", "venue", "capacity", "events")


@query("continent_facet", "SELECT n_nationkey FROM nation WHERE n_nationkey % 5 IN (0, 3)")
def continent_facet(d: Domain) -> DataFrame:
    code = pick(["GB", "US", "TR", "IT", "ZZ"], F.col("n_nationkey") % 5)
    return Q.faceted(d.raw("nation").withColumn("countryCode", code), continent="Europe").select("n_nationkey")


@query("resolve_city", f"WITH {CITIES} SELECT country, city FROM cities WHERE city = (SELECT min(city) FROM cities)")
def resolve_city(d: Domain) -> DataFrame:
    cities = written(d.cities().select("country", "city", "events"))
    name = cities.agg(F.min("city")).first()[0]
    return d.spark.createDataFrame([Q.resolve(cities, f" {name.lower()} ")], "country string, city string")


@query("city_suggestions", f"WITH {CITIES} SELECT city, country, events FROM cities WHERE contains(city, '_1') ORDER BY events DESC, city, country LIMIT 8")
def city_suggestions(d: Domain) -> DataFrame:
    return Q.suggestions(d.cities(), "_1")


def _profile(d: Domain) -> dict[str, DataFrame]:
    chosen = d.raw("supplier").where("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("venue_no"))
    e = d.events().withColumn("tickets", F.when(F.col("songs") % 3 != 0, F.col("songs") * 10)).withColumn("category", F.when(F.col("songs") % 10 == 0, "").otherwise(F.col("category")))
    return Q.profile(e, chosen, "venue_no", "1994-01-01", "1996-12-31")


_SET = f"{EVENTS}, e AS (SELECT * REPLACE (CASE WHEN songs % 10 = 0 THEN '' ELSE category END AS category), CASE WHEN songs % 3 <> 0 THEN songs * 10 ELSE 0 END AS tickets FROM events WHERE venue_no IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 1) AND date_iso BETWEEN '1994-01-01' AND '1996-12-31')"


@query("dashboard_head", f"WITH {_SET} SELECT count(*)::BIGINT AS events, sum(tickets)::BIGINT AS tickets, count(DISTINCT venue_no)::BIGINT AS venues, min(date_iso) AS first_event, max(date_iso) AS last_event FROM e")
def dashboard_head(d: Domain) -> DataFrame:
    return _profile(d)["head"]


@query("dashboard_categories", f"WITH {_SET} SELECT coalesce(nullif(category, ''), 'Uncategorised') AS category, count(*)::BIGINT AS events, sum(tickets)::BIGINT AS tickets FROM e GROUP BY 1")
def dashboard_categories(d: Domain) -> DataFrame:
    return _profile(d)["categories"]


@query("dashboard_years", f"WITH {_SET} SELECT substr(date_iso, 1, 4) AS year, count(*)::BIGINT AS events FROM e GROUP BY 1")
def dashboard_years(d: Domain) -> DataFrame:
    return _profile(d)["years"]


@query("dashboard_months", f"WITH {_SET} SELECT substr(date_iso, 6, 2) AS month, count(*)::BIGINT AS events FROM e GROUP BY 1")
def dashboard_months(d: Domain) -> DataFrame:
    return _profile(d)["months"]


@query("dashboard_venues", f"WITH {_SET} SELECT venue_no, min(venue) AS venue, min(city) AS city, count(*)::BIGINT AS events, sum(tickets)::BIGINT AS tickets, max(capacity) AS capacity FROM e GROUP BY 1 ORDER BY events DESC, venue_no LIMIT 200")
def dashboard_venues(d: Domain) -> DataFrame:
    return _profile(d)["venues"]


@query("dashboard_artists", f"WITH {_SET} SELECT headliner_key, min(headliner) AS headliner, count(*)::BIGINT AS shows, count(DISTINCT venue_no)::BIGINT AS venues, max(category) AS category FROM e GROUP BY 1 ORDER BY shows DESC, headliner_key LIMIT 100")
def dashboard_artists(d: Domain) -> DataFrame:
    return _profile(d)["artists"]


@query("hospitality_labels", "SELECT c_custkey AS package, CASE WHEN c_custkey % 3 = 0 THEN 'Team ' || c_custkey || ' / Supplier#' || lpad((c_custkey % 30)::VARCHAR, 9, '0') WHEN c_custkey % 3 = 1 THEN 'SUPPLIER ' || lpad((c_custkey % 30)::VARCHAR, 9, '0') ELSE 'Nowhere/Else' END AS label FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 30 IN (SELECT s_suppkey FROM supplier)")
def hospitality_labels(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    number = F.lpad((k % 30).cast("string"), 9, "0")
    label = F.when(k % 3 == 0, F.concat(F.lit("Team "), k, F.lit(" / Supplier#"), number)).when(k % 3 == 1, F.concat(F.lit("SUPPLIER "), number)).otherwise("Nowhere/Else")
    return Q.labelled(d.raw("customer").select(k.alias("package"), label.alias("label")), d.places())


@query("label_merge", f"WITH {PLACES}, l AS (SELECT lower(venue) AS v, lower(city) AS c, min(CASE WHEN venue_no % 2 = 0 THEN 'b' ELSE 'a' END) AS label FROM places WHERE venue_no % 3 = 0 GROUP BY 1, 2) SELECT venue_no, label FROM places LEFT JOIN l ON v = lower(venue) AND c = lower(city)")
def label_merge(d: Domain) -> DataFrame:
    labels = d.places().where("venue_no % 3 = 0").select(F.upper("venue").alias("venue"), F.concat(F.lit(" "), "city").alias("city"), pick(["b", "a"], F.col("venue_no") % 2).alias("label"))
    return Q.label_merge(d.places().select("venue_no", "venue", "city"), labels.union(labels), ["venue", "city"], "label").select("venue_no", "label")


@query("snowball_discovery", "WITH b AS (SELECT DISTINCT l_partkey AS artist, l_suppkey * 1000 + l_orderkey % 97 AS venue FROM lineitem), s AS (SELECT DISTINCT artist FROM b WHERE artist <= 3), r1 AS (SELECT DISTINCT artist FROM b WHERE venue IN (SELECT venue FROM b WHERE artist IN (SELECT artist FROM s)) AND artist NOT IN (SELECT artist FROM s)), r2 AS (SELECT DISTINCT artist FROM b WHERE venue IN (SELECT venue FROM b WHERE artist IN (SELECT artist FROM r1)) AND artist NOT IN (SELECT artist FROM s) AND artist NOT IN (SELECT artist FROM r1)) SELECT artist, 0 AS found_in FROM s UNION ALL SELECT artist, 1 FROM r1 UNION ALL SELECT artist, 2 FROM r2")
def snowball(d: Domain) -> DataFrame:
    b = d.raw("lineitem").select(F.col("l_partkey").alias("artist"), (F.col("l_suppkey") * 1000 + F.col("l_orderkey") % 97).alias("venue"))
    return Q.discover(b, b.where("artist <= 3").select("artist"))


@query("number_words", "SELECT n_nationkey AS n, n_nationkey || CASE WHEN n_nationkey % 100 BETWEEN 10 AND 20 THEN 'th' WHEN n_nationkey % 10 = 1 THEN 'st' WHEN n_nationkey % 10 = 2 THEN 'nd' WHEN n_nationkey % 10 = 3 THEN 'rd' ELSE 'th' END AS place, CASE WHEN n_nationkey IN (8, 11, 18) THEN 'an' ELSE 'a' END AS article FROM nation")
def number_words(d: Domain) -> DataFrame:
    n = F.col("n_nationkey")
    return d.raw("nation").select(n.alias("n"), Q.ordinal(n).alias("place"), Q.article(n).alias("article"))


@query("years_covered", f"WITH {VENUES} SELECT venue_no, round(greatest(date_diff('day', first_event, last_event) / 365.25, 0.25), 6) AS years FROM venues WHERE first_event IS NOT NULL")
def years(d: Domain) -> DataFrame:
    return d.venues().where("first_event IS NOT NULL").select("venue_no", F.round(Q.years_covered(F.col("first_event"), F.col("last_event")), 6).alias("years"))


# Box office.


def _edges(bins: int) -> str:
    return f"list_sort(list_distinct(quantile_cont(x, [{', '.join(str(i / bins) for i in range(bins + 1))}])))"


_BY_SIZE = "CASE (SELECT least(10, greatest(2, count(*) // 40)) FROM q) " + " ".join(f"WHEN {b} THEN {_edges(b)}" for b in range(2, 11)) + " END"
_CASES = " ".join(f"WHEN percentile >= {p} THEN '{b}'" for p, b in reversed(list(zip(B.PLACES, B.PERFORMANCE_BANDS[1:], strict=True)))) + f" ELSE '{B.PERFORMANCE_BANDS[0]}'"
_RATED = f"""{VENUES}, q AS (SELECT *, ln(capacity) AS x, (venue_no * 37 % 100)::DOUBLE + 0.5 AS pct FROM venues WHERE capacity >= 500 AND (venue_no * 37 % 100)::DOUBLE + 0.5 BETWEEN 0 AND 100 AND events >= 5), ed AS (SELECT {_BY_SIZE} AS e FROM q),
b AS (SELECT q.*, len(list_filter(e[2:], lambda t: t < x)) AS bin FROM q, ed), ex AS (SELECT bin, median(pct)::DOUBLE AS expected_pct FROM b GROUP BY 1), rs AS (SELECT b.*, expected_pct, round(pct - expected_pct, 2) AS residual_pp FROM b JOIN ex USING (bin)),
pc AS (SELECT *, round((rank() OVER (ORDER BY residual_pp) + (count(*) OVER (PARTITION BY residual_pp) - 1) / 2) / count(*) OVER (), 3) AS percentile FROM rs), rt AS (SELECT *, CASE {_CASES} END AS band FROM pc)"""


def _rated(d: Domain) -> DataFrame:
    return B.performance(written(d.venues().withColumn("pct", (F.col("venue_no") * 37 % 100).cast("double") + 0.5)))


@query("venue_performance", f"WITH {_RATED} SELECT venue_no, bin::INT AS bin, expected_pct, residual_pp, percentile, band FROM rt")
def venue_performance(d: Domain) -> DataFrame:
    return _rated(d).select("venue_no", "bin", "expected_pct", "residual_pp", "percentile", "band")


@query("performance_targets", f"WITH {_RATED} SELECT " + ", ".join(f"round(quantile_cont(residual_pp, {p}), 2) AS p{round(100 * p)}" for p in B.PLACES) + " FROM rt")
def performance_targets(d: Domain) -> DataFrame:
    return B.targets(_rated(d))


_GROSS = "exp(0.223::DOUBLE + 1.389::DOUBLE * ln(greatest(capacity, 1)::DOUBLE)) * greatest(1 + ({0}) / 80.0::DOUBLE, 0.1::DOUBLE)"


@query("refurbishment", f"WITH {_RATED}, t AS (SELECT round(quantile_cont(residual_pp, 0.75), 2) AS target_pp FROM rt), g AS (SELECT *, greatest(target_pp - residual_pp, 0) AS gain_pp FROM rt, t) SELECT venue_no, target_pp, round(gain_pp, 4) AS gain_pp, round({_GROSS.format('residual_pp')}, 0) AS gross_before, round({_GROSS.format('residual_pp + gain_pp')}, 0) AS gross_after FROM g")
def refurbishment(d: Domain) -> DataFrame:
    out = B.refurbish(_rated(d), 1.389, 0.223, 0.9)
    return out.select("venue_no", "target_pp", F.round("gain_pp", 4).alias("gain_pp"), F.round("gross_before", 0).alias("gross_before"), F.round("gross_after", 0).alias("gross_after"))


@query("sellthrough_residual", f"WITH {RUNS}, q AS (SELECT venue, ln(avg_capacity) AS x, avg_capacity, (n_shows * 37 % 100 + 1)::DOUBLE AS pct FROM runs WHERE avg_capacity > 0), ed AS (SELECT {_edges(20)} AS e FROM q), b AS (SELECT q.*, len(list_filter(e[2:], lambda t: t < x)) AS bin FROM q, ed), m AS (SELECT bin, median(pct)::DOUBLE AS expected FROM b GROUP BY 1) SELECT venue, count(*)::BIGINT AS shows, round(avg(pct - expected), 4) AS residual, round(avg(pct), 4) AS pct, median(avg_capacity)::DOUBLE AS capacity FROM b JOIN m USING (bin) GROUP BY 1 HAVING count(*) >= 20")
def sellthrough(d: Domain) -> DataFrame:
    shows = written(d.runs().select("venue", F.col("avg_capacity").alias("capacity"), (F.col("n_shows") * 37 % 100 + 1).cast("double").alias("pct")))
    return B.residuals(shows).select("venue", "shows", F.round("residual", 4).alias("residual"), F.round("pct", 4).alias("pct"), "capacity")


_LOW, _HIGH = "(venue_no % 5)::DOUBLE", "(venue_no % 5 + 3)::DOUBLE"


@query("gross_projection", f"WITH {PLACES}, m AS (SELECT venue_no, {_LOW} AS lo, {_HIGH} AS hi, {_GROSS.format('venue_no % 41 - 20')} AS g FROM places) SELECT venue_no, round(lo * g * exp(-0.6745::DOUBLE * 0.9::DOUBLE), 1) AS low, round(lo * g, 1) AS central_low, round(hi * g, 1) AS central_high, round(hi * g * exp(0.6745::DOUBLE * 0.9::DOUBLE), 1) AS high, round(hi / nullif(lo, 0), 2) AS visits_factor, round(exp(2 * 0.6745::DOUBLE * 0.9::DOUBLE), 2) AS gross_factor, round(ln(hi / nullif(lo, 0)) / (ln(hi / nullif(lo, 0)) + 2 * 0.6745::DOUBLE * 0.9::DOUBLE), 3) AS visits_share FROM m")
def gross_projection(d: Domain) -> DataFrame:
    n = F.col("venue_no")
    low, high = (n % 5).cast("double"), (n % 5 + 3).cast("double")
    out = d.places().select("venue_no", *B.project(F.col("capacity"), n % 41 - 20, low, high, 1.389, 0.223, 0.9), *B.uncertainty(low, high, 0.9))
    return out.select("venue_no", *[F.round(c, 1).alias(c) for c in ("low", "central_low", "central_high", "high")], "visits_factor", "gross_factor", "visits_share")


@query("fx_convert", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 10 THEN round(l_extendedprice / 1.25, 2) END AS gbp FROM lineitem")
def fx_convert(d: Domain) -> DataFrame:
    money = F.when(F.col("l_quantity") > 10, F.col("l_extendedprice"))
    return d.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", B.to_gbp(money, F.lit(1.25)).alias("gbp"))


# Reports.


@query("southern_legs", f"""WITH {EVENTS}, l AS (SELECT tour, city, country, lead(city) OVER w AS to_city, lead(country) OVER w AS to_country FROM events WHERE trim(tour) <> '' WINDOW w AS (PARTITION BY tour ORDER BY date_iso, event_id)),
s AS (SELECT *, country = 'ASIA' AND city IN ('NATION_2', 'NATION_7') AS o, to_country = 'ASIA' AND to_city IN ('NATION_2', 'NATION_7') AS d FROM l WHERE to_city IS NOT NULL AND city <> to_city)
SELECT CASE WHEN country = 'ASIA' THEN city ELSE city || ' (' || country || ')' END AS origin, CASE WHEN to_country = 'ASIA' THEN to_city ELSE to_city || ' (' || to_country || ')' END AS dest, CASE WHEN o AND d THEN 'within' WHEN o THEN 'leaving' ELSE 'arriving' END AS direction, count(*)::BIGINT AS legs FROM s WHERE o OR d GROUP BY 1, 2, 3""")
def southern_legs(d: Domain) -> DataFrame:
    return R.area_legs(E.legs(d.events()), "ASIA", ["NATION_2", "NATION_7"])


@query("same_day_merge", "WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN user_id % 10 <> 0 THEN user_id END AS venue, event_type, event_id, value FROM events), f AS (SELECT day, venue, event_type, min(event_id) AS f_at FROM e GROUP BY 1, 2, 3), k AS (SELECT day, venue, string_agg(event_type, ' & ' ORDER BY f_at) AS kinds FROM f GROUP BY 1, 2) SELECT e.day, e.venue, any_value(kinds) AS kinds, min(event_id) AS first_event, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM e JOIN k ON e.day = k.day AND e.venue IS NOT DISTINCT FROM k.venue GROUP BY 1, 2")
def same_day(d: Domain) -> DataFrame:
    e = d.raw("events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("venue"), "event_type", "event_id", "value")
    return E.merge_days(e, ["day", "venue"], "event_type", "event_id", "value").select("day", "venue", F.col("names").alias("kinds"), F.col("first").alias("first_event"), "n", F.round("total", 4).alias("total"))


@query("route_by_tour", f"WITH {SETLISTS}, t AS (SELECT setlist_id, nullif(tour, '') AS tour, city, date_iso FROM setlists) SELECT setlist_id, CASE WHEN tour IS NOT NULL THEN coalesce(lag(city) OVER w, 'First Show') END AS previous_city, CASE WHEN tour IS NOT NULL THEN coalesce(lead(city) OVER w, 'Final Show') END AS next_city FROM t WINDOW w AS (PARTITION BY tour ORDER BY date_iso, setlist_id)")
def route_by_tour(d: Domain) -> DataFrame:
    rows = d.setlists().select("setlist_id", F.nullif("tour", F.lit("")).alias("tour"), "city", "date_iso")
    return E.route(rows, ["tour"], ["date_iso", "setlist_id"], without=None).select("setlist_id", "previous_city", "next_city")


@query("route_ingested", f"WITH {SETLISTS}, i AS (SELECT *, split_part(setlist_id, '-', 1)::BIGINT % 1000 AS ordinal FROM setlists), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY setlist_id ORDER BY ordinal) AS r FROM i) WHERE r = 1) SELECT setlist_id, {"CASE WHEN trim(tour) <> '' THEN coalesce(lag(city) OVER w, 'First Show') ELSE '' END"} AS previous_city FROM k WINDOW w AS (PARTITION BY artist, tour ORDER BY date_iso, ordinal, setlist_id)")
def route_ingested(d: Domain) -> DataFrame:
    rows = d.setlists().withColumn("ordinal", F.split("setlist_id", "-")[0].cast("bigint") % 1000)
    return E.route_ingested(rows.union(rows), "ordinal").select("setlist_id", "previous_city")


_EXPORT_KEEP = "(category IN ('Category A', 'Category B', 'Category C') OR event_type <> 'Artist') AND date_iso >= '1995-01-01'"


@query("export_events", f"WITH {EVENTS}, x AS (SELECT *, CASE WHEN songs % 7 = 0 THEN 'Tenant Sporting Event' ELSE 'Artist' END AS event_type FROM events) SELECT coalesce(date_iso, '') AS date_iso, coalesce(headliner, '') AS headliner, coalesce(support, '') AS support, n_artists::VARCHAR AS n_artists, coalesce(tour, '') AS tour, coalesce(venue, '') AS venue, coalesce(city, '') AS city, coalesce(countryCode, '') AS countryCode, event_type, category, event_id, 'setlistfm' AS source, substr(date_iso, 9, 2) || '-' || substr(date_iso, 6, 2) || '-' || substr(date_iso, 1, 4) AS eventDate, '' AS competition FROM x WHERE {_EXPORT_KEEP}")
def export_events(d: Domain) -> DataFrame:
    e = d.events().withColumn("event_type", F.when(F.col("songs") % 7 == 0, "Tenant Sporting Event").otherwise("Artist"))
    out = E.export_frame(E.exportable(e, "1995-01-01"))
    return out.select("date_iso", "headliner", "support", "n_artists", "tour", "venue", "city", "countryCode", "event_type", "category", "event_id", "source", "eventDate", "competition")


@query("arena_export", f"WITH {EVENTS} SELECT event_id FROM events WHERE venue_no % 8 = 0 AND category IN ('Category A', 'Category B', 'Category C') AND date_iso >= '1996-01-01'")
def arena_export(d: Domain) -> DataFrame:
    e = d.events().withColumn("event_type", F.lit("Artist")).withColumn("arena_id", F.when(F.col("venue_no") % 8 == 0, F.col("venue_no")))
    return E.exportable(e, "1996-01-01", arenas_only=True).select("event_id")


@query("venue_kind_by_class", "WITH p AS (SELECT p_partkey, ['Amphitheatre and theatre', 'Opera House', 'old PARK', 'nothing', 'indoor arena', 'festival church'][(p_partkey % 6 + 1)::INT] AS t FROM part) SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Amphitheatre' WHEN 1 THEN 'Auditorium / Theatre' WHEN 2 THEN 'Outdoor Venues' WHEN 4 THEN 'Arena' WHEN 5 THEN 'Festival Site' END AS venue_type, CASE p_partkey % 6 WHEN 0 THEN 'Outside' WHEN 1 THEN 'Inside' WHEN 2 THEN 'Outside' WHEN 4 THEN 'Inside' WHEN 5 THEN 'Outside' END AS io FROM p")
def venue_kind(d: Domain) -> DataFrame:
    texts = ["Amphitheatre and theatre", "Opera House", "old PARK", "nothing", "indoor arena", "festival church"]
    p = d.raw("part").withColumn("t", pick(texts, F.col("p_partkey") % 6))
    kind, io = T.kind_of_class(F.array(F.split("t", " and ")[0], F.lit(None).cast("string")), F.col("t"))
    return p.select("p_partkey", kind.alias("venue_type"), io.alias("io"))


@query("indoor_hints", f"WITH {PLACES}, n AS (SELECT venue_no, ['Palasport Sud', 'Big Arena', 'Open Field', 'Stadthalle', 'Forum'][(venue_no % 5 + 1)::INT] AS name FROM places) SELECT venue_no, CASE WHEN name IN ('Palasport Sud', 'Stadthalle') THEN 'likely mislabelled' WHEN name IN ('Big Arena', 'Forum') THEN 'check' END AS hint FROM n")
def indoor_hints(d: Domain) -> DataFrame:
    return d.places().select("venue_no", T.indoor_hint(pick(["Palasport Sud", "Big Arena", "Open Field", "Stadthalle", "Forum"], F.col("venue_no") % 5)).alias("hint"))


@query("opening_validation", f"WITH {VENUES}, d AS (SELECT venue_no, capacity, year(first_event) - (1990 + venue_no % 8) AS gap FROM venues WHERE capacity >= 8000 AND first_event IS NOT NULL AND venue_no % 3 <> 0) SELECT count(*)::BIGINT AS checked, median(gap)::DOUBLE AS median_gap, round(avg((abs(gap) <= 1)::INT), 6) AS within_1yr, round(avg((abs(gap) <= 3)::INT), 6) AS within_3yr, round(avg((gap > 5)::INT), 6) AS opened_before_panel FROM d")
def opening_validation(d: Domain) -> DataFrame:
    v = d.venues().withColumn("opened_year", F.when(F.col("venue_no") % 3 != 0, F.lit(1990) + F.col("venue_no") % 8))
    out = X.validate_openings(v.withColumn("first_seen", F.year("first_event")), 8000)
    return out.select("checked", "median_gap", *[F.round(c, 6).alias(c) for c in ("within_1yr", "within_3yr", "opened_before_panel")])


@query("robustness_grid")
def robustness(d: Domain) -> DataFrame:
    visits = d.setlists().groupBy("city", F.substring("date_iso", 1, 4).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("shows"))
    rooms = d.places().select("city", "capacity", (F.lit(1994) + F.col("venue_no") % 8).alias("opened"))
    return X.robustness(written(rooms), written(visits), [5_000, 10_000, 20_000, 30_000, 40_000, 45_000, 49_000])


@query("effect_bootstrap")
def effect_bootstrap(d: Domain) -> DataFrame:
    return X.bootstrap(_panel(d), draws=30)


@query("daily_quota", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS used, greatest(500 - count(*), 0)::BIGINT AS remaining FROM events WHERE ts >= (SELECT max(ts) FROM events)::DATE - 30 GROUP BY 1")
def daily_quota(d: Domain) -> DataFrame:
    return upserts.quota(d.raw("events").select("ts"), "ts", 500)


@query("screen_columns", f"WITH {VENUES}, c AS (SELECT country, city, max(capacity) FILTER (io = 'inside') AS ceiling_indoor, sum(capacity)::BIGINT * 10 AS population, sum(capacity)::BIGINT * 3 AS own, sum(events)::BIGINT AS events FROM venues GROUP BY 1, 2), k AS (SELECT *, (events * 100)::DOUBLE AS suggested FROM c), p AS (SELECT a.country, a.city, median(b.ceiling_indoor)::DOUBLE AS m FROM k a JOIN k b ON a.city <> b.city AND b.population BETWEEN a.population * (1 - 0.35::DOUBLE) AND a.population * (1 + 0.35::DOUBLE) WHERE a.population > 0 AND b.population > 0 GROUP BY 1, 2) SELECT k.country, k.city, suggested - coalesce(ceiling_indoor, 0) AS headroom, round(own::DOUBLE / nullif(population, 0), 3) AS catchment_kept, round(m - ceiling_indoor, 1) AS ceiling_below_peers FROM k LEFT JOIN p USING (country, city)")
def screen_columns(d: Domain) -> DataFrame:
    v = d.venues().groupBy("country", "city").agg(F.max(F.when(F.col("io") == "inside", F.col("capacity"))).alias("ceiling_indoor"), (F.sum("capacity") * 10).alias("population"), (F.sum("capacity") * 3).alias("exclusive"), F.sum("events").alias("events"))
    rows = written(v.withColumn("suggested", (F.col("events") * 100).cast("double")))
    out = M.screen_columns(rows)
    return out.select("country", "city", "headroom", F.round("catchment_kept", 3).alias("catchment_kept"), F.round("ceiling_below_peers", 1).alias("ceiling_below_peers"))
