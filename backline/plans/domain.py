"""The test tables seen as live-event tables, in Spark and as DuckDB CTEs of the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import events as E
from ..operators.identity import Steps


class Domain:
    """Live-event tables over one folder of test tables; each is planned when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def places(self) -> DataFrame:
        """Suppliers as venues with city, country, code, capacity, kind and coordinates."""
        s = self.raw("supplier").join(F.broadcast(self.raw("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        s = s.join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        k, site = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / 4)
        shift = F.element_at(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0001), F.lit(0.05)), (k % 4 + 1).cast("int"))
        return s.select(
            k.alias("venue_no"),
            F.col("s_name").alias("venue"),
            F.when(k % 3 == 0, "").otherwise(k.cast("string")).alias("venue_id"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("country"),
            F.when(k % 5 == 0, "").otherwise(F.substring("r_name", 1, 2)).alias("countryCode"),
            F.substring("r_name", 1, 2).alias("cc"),
            F.floor(F.abs("s_acctbal") * 5).cast("bigint").alias("capacity"),
            F.when(k % 3 == 0, "inside").when(k % 3 == 1, "outside").alias("io"),
            site.cast("bigint").alias("site"),
            (F.lit(40.0) + (site * 37 % 1000) / 100 + shift).alias("lat"),
            ((site * 53 % 1500) / 100).cast("double").alias("lon"),
        )

    def setlists(self, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Line items as artist-nights; what ``step`` makes of each join goes on."""
        li = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        orders = self.raw("orders").select("o_orderkey", "o_custkey").join(self.raw("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
        part = self.raw("part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("artist"))
        li = step(li.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey"))
        li = step(li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("o_orderkey", "o_custkey", "c_custkey"))
        li = step(li.join(self.places().drop("cc", "site", "lat", "lon"), F.col("l_suppkey") == F.col("venue_no")))
        day = F.date_format("l_shipdate", "yyyy-MM-dd")
        return li.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("setlist_id"),
            "artist",
            F.lower(F.trim("artist")).alias("artist_key"),
            day.alias("date_iso"),
            F.when(F.col("l_orderkey") % 4 == 0, "").otherwise(F.concat("c_mktsegment", F.lit(" "), F.year("l_shipdate"))).alias("tour"),
            F.col("l_quantity").cast("int").alias("num_songs"),
            F.col("l_extendedprice").alias("gross"),
            "venue_no", "venue", "venue_id", "city", "country", "countryCode", "capacity", "io",
        )

    def nights(self) -> DataFrame:
        """Artist-nights joined step by step, for what reads them several times."""
        return self.setlists(Steps())

    def categories(self) -> DataFrame:
        """Parts as artists with audience, chart rank and tier."""
        none = F.col("p_partkey") % 7 == 0
        p = self.raw("part").select(
            F.lower(F.trim(F.concat("p_name", F.lit(" "), "p_brand"))).alias("artist_key"),
            F.when(~none, F.round((F.col("p_retailprice") - 900) * 500000).cast("bigint")).alias("listeners"),
            F.when(~none & (F.col("p_size") % 2 == 1), F.col("p_size") * 3).alias("chart_rank"),
        )
        p = p.groupBy("artist_key").agg(F.max("listeners").alias("listeners"), F.min("chart_rank").alias("chart_rank"))
        return p.withColumn("category", F.concat(F.lit("Category "), S.classify_tier(F.col("listeners"), F.col("chart_rank"))))

    def careers(self) -> DataFrame:
        """Artist-nights by artist, from the two tables that hold them."""
        part = self.raw("part").select("p_partkey", F.lower(F.trim(F.concat("p_name", F.lit(" "), "p_brand"))).alias("artist_key"))
        nights = self.raw("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
        return nights.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("artist_key").agg(F.sum("n").alias("career"))

    def events(self) -> DataFrame:
        return E.bill_collapse(self.setlists(), self.categories(), self.careers())

    def venues(self) -> DataFrame:
        """Places with their number of artist-nights and span."""
        nights = self.raw("lineitem").groupBy(F.col("l_suppkey").alias("venue_no")).agg(
            F.count(F.lit(1)).alias("events"), F.min(F.to_date("l_shipdate")).alias("first_event"), F.max(F.to_date("l_shipdate")).alias("last_event")
        )
        return self.places().join(nights, "venue_no", "left").withColumn("events", F.coalesce("events", F.lit(0)))

    def runs(self, nights: DataFrame | None = None) -> DataFrame:
        """Box-office runs: an act in a venue for a month."""
        s = self.setlists() if nights is None else nights
        g = s.groupBy("artist_key", "venue", "city", F.substring("date_iso", 1, 7).alias("month"))
        g = g.agg(F.min("date_iso").alias("start_iso"), F.max("date_iso").alias("end_iso"), F.count(F.lit(1)).alias("n_shows"), F.round(F.avg("num_songs") * 1000).cast("bigint").alias("avg_capacity"), F.round(F.sum("gross"), 2).alias("gross_usd"))
        return g.withColumn("pid", F.concat_ws("|", "artist_key", "venue", "month"))

    def visits(self) -> DataFrame:
        """Acts' tours by city with counts and the largest rooms played."""
        s = self.setlists().where(S.not_blank(F.col("tour"))).withColumn("tour", F.concat("artist_key", F.lit(" / "), "tour"))
        return s.groupBy("tour", "country", "city").agg(
            F.count(F.lit(1)).alias("shows"),
            F.count_if(F.col("io") == "inside").alias("indoor"),
            F.count_if(F.col("io") == "outside").alias("outdoor"),
            F.max("capacity").alias("largest"),
            F.max(F.when(F.col("io") == "inside", F.col("capacity"))).alias("largest_indoor"),
            F.max(F.when(F.col("io") == "outside", F.col("capacity"))).alias("largest_outdoor"),
            F.min("date_iso").alias("first_date"),
        )

    def cities(self) -> DataFrame:
        """Cities with coordinates (of their first venue), venues, shows and ceilings; population by rank of size."""
        v = self.venues()
        return v.groupBy("country", "city").agg(
            F.count(F.lit(1)).alias("venues"),
            F.sum("events").alias("events"),
            F.max("capacity").alias("ceiling"),
            F.max(F.when(F.col("io") == "inside", F.col("capacity"))).alias("ceiling_indoor"),
            F.max(F.when(F.col("io") == "outside", F.col("capacity"))).alias("ceiling_outdoor"),
            F.min_by("lat", "venue_no").alias("lat"),
            F.min_by("lon", "venue_no").alias("lon"),
            (F.sum("capacity") * 10).alias("population"),
        )


PLACES = """places AS (SELECT s_suppkey AS venue_no, s_name AS venue, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_suppkey::VARCHAR END AS venue_id, n_name AS city, r_name AS country,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE substr(r_name, 1, 2) END AS countryCode, substr(r_name, 1, 2) AS cc, floor(abs(s_acctbal) * 5)::BIGINT AS capacity,
  CASE s_suppkey % 3 WHEN 0 THEN 'inside' WHEN 1 THEN 'outside' END AS io, (s_suppkey // 4)::BIGINT AS site,
  40.0::DOUBLE + ((s_suppkey // 4) * 37 % 1000)::DOUBLE / 100 + [0.0, 0.0, 0.0001, 0.05][(s_suppkey % 4 + 1)::INT]::DOUBLE AS lat, ((s_suppkey // 4) * 53 % 1500)::DOUBLE / 100 AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SETLISTS = f"""{PLACES}, setlists AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS setlist_id, p_name || ' ' || p_brand AS artist, lower(trim(p_name || ' ' || p_brand)) AS artist_key,
  strftime(l_shipdate, '%Y-%m-%d') AS date_iso, CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE c_mktsegment || ' ' || year(l_shipdate) END AS tour, trunc(l_quantity)::INT AS num_songs, l_extendedprice AS gross,
  p.venue_no, p.venue, p.venue_id, p.city, p.country, p.countryCode, p.capacity, p.io
  FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey JOIN places p ON l_suppkey = p.venue_no)"""
CATEGORIES = """cat0 AS (SELECT lower(trim(p_name || ' ' || p_brand)) AS artist_key, max(CASE WHEN p_partkey % 7 <> 0 THEN round((p_retailprice - 900) * 500000)::BIGINT END) AS listeners,
  min(CASE WHEN p_partkey % 7 <> 0 AND p_size % 2 = 1 THEN p_size * 3 END) AS chart_rank FROM part GROUP BY 1),
categories AS (SELECT *, 'Category ' || CASE WHEN listeners IS NULL AND chart_rank IS NULL THEN 'E' WHEN listeners >= 40000000 OR chart_rank <= 50 THEN 'A' WHEN listeners >= 10000000 OR chart_rank <= 100 THEN 'B' WHEN listeners >= 1000000 THEN 'C' ELSE 'D' END AS category FROM cat0)"""
EVENTS = f"""{SETLISTS}, {CATEGORIES}, career AS (SELECT artist_key, count(*) AS career FROM setlists GROUP BY 1),
slots AS (SELECT s.*, coalesce(c.category, 'Category E') AS category, date_iso || '|' || coalesce(nullif(venue_id, ''), venue || '|' || city) AS event_id, coalesce(nullif(venue_id, ''), venue || '|' || city) AS venue_key,
  row_number() OVER (PARTITION BY date_iso || '|' || coalesce(nullif(venue_id, ''), venue || '|' || city) ORDER BY coalesce(c.category, 'Category E'), num_songs DESC NULLS LAST, career DESC, artist, setlist_id) AS slot
  FROM setlists s LEFT JOIN categories c USING (artist_key) JOIN career USING (artist_key) WHERE trim(coalesce(date_iso, '')) <> '' AND trim(coalesce(artist, '')) <> ''),
events AS (SELECT event_id, any_value(date_iso) AS date_iso, any_value(venue_key) AS venue_key, max(CASE WHEN slot = 1 THEN venue END) AS venue, max(CASE WHEN slot = 1 THEN city END) AS city, max(CASE WHEN slot = 1 THEN country END) AS country,
  max(CASE WHEN slot = 1 THEN countryCode END) AS countryCode, max(CASE WHEN slot = 1 THEN artist END) AS headliner, max(CASE WHEN slot = 1 THEN artist_key END) AS headliner_key, max(CASE WHEN slot = 1 THEN category END) AS category,
  coalesce(nullif(max(CASE WHEN slot = 1 THEN tour END), ''), max(nullif(tour, '')), '') AS tour, string_agg(CASE WHEN slot > 1 THEN artist END, ' + ' ORDER BY slot) AS support, string_agg(setlist_id, ' | ' ORDER BY slot) AS setlist_ids,
  count(*)::BIGINT AS n_artists, sum(num_songs)::BIGINT AS songs, max(CASE WHEN slot = 1 THEN capacity END) AS capacity, max(CASE WHEN slot = 1 THEN io END) AS io, max(CASE WHEN slot = 1 THEN venue_no END) AS venue_no FROM slots GROUP BY event_id)"""
VENUES = f"""{PLACES}, nights AS (SELECT l_suppkey AS venue_no, count(*) AS events, min(l_shipdate)::DATE AS first_event, max(l_shipdate)::DATE AS last_event FROM lineitem GROUP BY 1),
venues AS (SELECT p.*, coalesce(n.events, 0)::BIGINT AS events, first_event, last_event FROM places p LEFT JOIN nights n USING (venue_no))"""
RUNS = f"""{EVENTS}, runs AS (SELECT artist_key, venue, city, substr(date_iso, 1, 7) AS month, min(date_iso) AS start_iso, max(date_iso) AS end_iso, count(*)::BIGINT AS n_shows, round(avg(num_songs) * 1000)::BIGINT AS avg_capacity,
  round(sum(gross), 2) AS gross_usd, artist_key || '|' || venue || '|' || substr(date_iso, 1, 7) AS pid FROM setlists GROUP BY 1, 2, 3, 4)"""
VISITS = f"""{SETLISTS}, visits AS (SELECT artist_key || ' / ' || tour AS tour, country, city, count(*)::BIGINT AS shows, count(*) FILTER (io = 'inside')::BIGINT AS indoor, count(*) FILTER (io = 'outside')::BIGINT AS outdoor, max(capacity) AS largest,
  max(capacity) FILTER (io = 'inside') AS largest_indoor, max(capacity) FILTER (io = 'outside') AS largest_outdoor, min(date_iso) AS first_date FROM setlists WHERE trim(coalesce(tour, '')) <> '' GROUP BY 1, 2, 3)"""
CITIES_ONLY = """cities AS (SELECT country, city, count(*)::BIGINT AS venues, sum(events)::BIGINT AS events, max(capacity) AS ceiling, max(capacity) FILTER (io = 'inside') AS ceiling_indoor, max(capacity) FILTER (io = 'outside') AS ceiling_outdoor,
  arg_min(lat, venue_no) AS lat, arg_min(lon, venue_no) AS lon, (sum(capacity) * 10)::BIGINT AS population FROM venues GROUP BY 1, 2)"""
CITIES = f"{VENUES}, {CITIES_ONLY}"
