"""Loaders of reference sheets: rows of text as a CSV export of a sheet holds them, to typed tables by the sheets' rules.

Every loader takes a DataFrame of strings (``sheet`` reads one) and finds its columns by header, in any case and order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T

# Labels of the threshold block with the words that each must hold, in order, and defaults.
THRESHOLD_PATTERNS = [
    ("cat_a_spotify", ["category a", "spotify"]),
    ("cat_b_spotify", ["category b", "spotify"]),
    ("cat_a_pollstar", ["category a", "pollstar"]),
    ("cat_b_pollstar", ["category b", "pollstar"]),
    ("cat_d_spotify", ["category d", "spotify"]),
    ("tenant_min_dates", ["tenant", "minimum dates for"]),
    ("tenant_min_per_venue", ["tenant", "per venue"]),
]
# Numeric columns of the arena sheet.
ARENA_NUMERIC = [
    "concert_capacity", "concert_capacity_seated", "concert_capacity_standing", "observed_concert_capacity_max", "observed_concert_capacity_typical", "observed_concert_bookings",
    "sporting_capacity", "seating_capacity", "observed_sport_capacity_max", "observed_sport_capacity_typical", "observed_sport_fixtures", "hospitality_capacity", "max_capacity",
    "opened_year", "renovated_year", "latitude", "longitude",
]
#: Columns of the box-office sheet that hold numbers, whole ones first.
RUN_WHOLE = {"total tickets sold": "total_tickets", "average tickets sold": "avg_tickets", "average show capacity": "avg_capacity", "total show capacity": "total_capacity"}
RUN_NUMBERS = {"total gross usd": "total_gross_usd", "average gross usd": "avg_gross_usd", "average capacity sold": "avg_capacity_sold", "ticket price min": "price_min", "ticket price max": "price_max", "ticket price average": "price_avg"}
RUN_TEXTS = {"support": "support", "venue id": "venue_id", "venue type": "venue_type", "state": "state", "zip": "zip", "country": "country", "currency": "currency", "promoter": "promoter", "genre": "genre", "market": "market"}


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export as texts; a byte order mark, quoted line breaks and other encodings' stray bytes are tolerated."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, mode="PERMISSIVE")
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def by_header(rows: DataFrame, needed: list[str]) -> dict[str, Column]:
    """Columns by trimmed lower-case header; an error names the needed ones that are missing."""
    found = {c.strip().lower(): F.col("`" + c.replace("`", "``") + "`") for c in reversed(rows.columns)}
    if missing := [c for c in needed if c not in found]:
        raise ValueError(f"missing columns: {missing}")
    return found


def text(c: Column | None) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) if c is not None else F.lit("")


def number(c: Column | None) -> Column:
    return S.parse_number(c) if c is not None else F.lit(None).cast("double")


def whole(c: Column | None) -> Column:
    return number(c).cast("bigint")


def thresholds(block: DataFrame) -> DataFrame:
    """(place, label, value) rows of the block to (name, value, label): the first row of each pattern that has a number."""
    low = F.lower("label")
    name = F.array(*[F.when(F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(n)) for n, words in THRESHOLD_PATTERNS])
    rows = block.where(S.not_blank(F.col("label"))).withColumn("label", F.trim("label")).withColumn("value", number(F.col("value"))).withColumn("name", F.explode(F.filter(name, lambda x: x.isNotNull())))
    first = F.row_number().over(Window.partitionBy("name").orderBy("place"))
    return rows.where("value IS NOT NULL").withColumn("_n", first).where("_n = 1").select("name", "value", "label")


def box_office(rows: DataFrame) -> DataFrame:
    """Runs: rows with a headliner and a start; the end is the start where unknown, and a run has one show at least."""
    c = by_header(rows, ["start date", "headliner", "venue"])
    start = S.parse_date(c["start date"])
    end = F.coalesce(F.nullif(S.parse_date(c["end date"]), F.lit("")), start) if "end date" in c else start
    shows = F.coalesce(F.nullif(whole(c.get("number of shows")), F.lit(0)), F.lit(1))
    head, venue, city = text(c["headliner"]), text(c["venue"]), text(c.get("city"))
    out = rows.select(
        start.alias("start_iso"), end.alias("end_iso"), shows.alias("n_shows"), head.alias("headliner"), T.norm_key(head).alias("headliner_norm"), venue.alias("venue"), T.norm_key(venue).alias("venue_norm"), city.alias("city"), T.norm_key(city).alias("city_norm"),
        *[text(c.get(h)).alias(n) for h, n in RUN_TEXTS.items()], *[whole(c.get(h)).alias(n) for h, n in RUN_WHOLE.items()], *[number(c.get(h)).alias(n) for h, n in RUN_NUMBERS.items()],
    )
    return out.where("headliner <> '' AND start_iso <> ''")


def fixtures(rows: DataFrame) -> DataFrame:
    """Sporting rows that neither box office nor setlists hold, with the teams of 'A vs B'."""
    c = by_header(rows, ["venue", "venue_city", "venue_country", "event_date", "headliner", "source", "event_category"])
    head, source, kind = text(c["headliner"]), F.lower(text(c["source"])), text(c["event_category"])
    day = S.parse_date(c["event_date"])
    keep = (source != "") & ~source.isin("pollstar", "setlistfm") & kind.isin(T.SPORT_TYPES) & (head != "") & (day != "")
    teams = F.split(head, " vs ", 2)
    both = F.size(teams) == 2
    venue, city = text(c["venue"]), text(c["venue_city"])
    return rows.where(keep).select(
        day.alias("date_iso"), head.alias("headliner"), F.when(both, F.trim(teams[0])).alias("home_team"), F.when(both, F.trim(F.get(teams, F.lit(1)))).alias("away_team"), text(c.get("competition")).alias("competition"), text(c.get("result")).alias("result"),
        venue.alias("venue"), T.norm_key(venue).alias("venue_norm"), city.alias("city"), T.norm_key(city).alias("city_norm"), text(c["venue_country"]).alias("country"), whole(c.get("tickets_sold")).alias("tickets_sold"), whole(c.get("show_capacity")).alias("capacity"), kind.alias("event_type"), source.alias("source"), text(c.get("arena_id")).alias("arena_id"),
    )


def safe_header(name: str) -> str:
    """A header as a column name."""
    out = "".join(ch if ch.isascii() and ch.isalnum() else "_" for ch in (name or "").strip().lower())
    return "_".join(p for p in out.split("_") if p) or "col"


def safe_headers(names: list[str]) -> list[str]:
    """Headers as column names, repeated ones numbered from 2."""
    out: list[str] = []
    for name in map(safe_header, names):
        n, i = name, 2
        while n in out:
            n, i = f"{name}_{i}", i + 1
        out.append(n)
    return out


def arenas(rows: DataFrame) -> DataFrame:
    """The arena sheet under its own headers, numbers where the column is known to hold them; rows without a first cell are left out."""
    named = rows.toDF(*safe_headers(rows.columns))
    if "name" not in named.columns:
        raise ValueError("missing columns: ['name']")
    kept = named.where(F.coalesce(F.col(named.columns[0]), F.lit("")) != "")
    return kept.select(*[(number(F.col(c)) if c in ARENA_NUMERIC else text(F.col(c))).alias(c) for c in named.columns])


def hospitality(rows: DataFrame) -> DataFrame:
    """Packages with a venue, texts trimmed, the price as a number."""
    named = rows.toDF(*safe_headers(rows.columns))
    c = {n: F.col(n) for n in named.columns}
    venue = text(c.get("team_arena_venue", c.get("venue")))
    names = {"type": "type", "package": "package_name", "total_capacity": "total_capacity", "room_capacity": "room_capacity", "currency": "currency", "vat_incl": "vat_incl", "price_basis": "price_basis", "contact": "contact", "info": "package_information", "price_quoted": "price_as_quoted"}
    return named.select(venue.alias("venue"), T.norm_key(venue).alias("venue_norm"), number(c.get("price")).alias("price"), *[text(c.get(h, c.get(n))).alias(n) for n, h in names.items()]).where("venue <> ''")


def fx_rates(rows: DataFrame) -> DataFrame:
    """(place, a, b, c) cells of a sheet without fixed header to (iso, units_per_gbp, basis): what follows the first row that begins with 'iso'."""
    head = rows.where(F.lower(F.trim("a")) == "iso").agg(F.min("place").alias("_head"))
    below = rows.join(F.broadcast(head), F.col("place") > F.col("_head"))
    iso, rate = F.upper(F.trim("a")), number(F.col("b"))
    out = below.select("place", iso.alias("iso"), rate.alias("units_per_gbp"), text(F.col("c")).alias("basis")).where(F.col("iso").rlike("^[A-Z]{3}$") & (F.coalesce("units_per_gbp", F.lit(0.0)) != 0))
    last = F.row_number().over(Window.partitionBy("iso").orderBy(F.desc("place")))
    return out.withColumn("_n", last).where("_n = 1").select("iso", "units_per_gbp", "basis")


def newest(paths: list[str]) -> str:
    """The last of dated file names."""
    if not paths:
        raise ValueError("no file to load")
    return max(paths, key=lambda p: p.rsplit("/", 1)[-1])


def reviewed_merges(rows: DataFrame) -> DataFrame:
    """Reviewed pairs that are to be merged."""
    c = by_header(rows, ["keep_norm", "fold_norm", "city", "countrycode", "should_merge", "keep", "verdict"])
    merge = F.lower(text(c["should_merge"])).isin("true", "1", "yes")
    return rows.where(merge).select(text(c["fold_norm"]).alias("alias_norm"), T.norm_key(c["city"]).alias("city_norm"), text(c["countrycode"]).alias("countryCode"), text(c["keep_norm"]).alias("canonical_norm"), text(c["keep"]).alias("canonical"), text(c["verdict"]).alias("note"))


def overrides(rows: DataFrame, required: list[str], lower: tuple[str, ...] = ()) -> DataFrame:
    """A table of manual overrides, trimmed: rows without a required value are left out."""
    c = by_header(rows, required)
    out = rows.select(*[(F.lower(text(v)) if n in lower else text(v)).alias(n) for n, v in c.items()])
    for n in required:
        out = out.where(F.col(n) != "")
    return out


def chart(rows: DataFrame, values: list[str]) -> DataFrame:
    """A chart tab to one row an artist key, of repeated keys the last place: artist_key, artist, place and the values as numbers."""
    c = by_header(rows, ["artist", "rank"])
    name = text(c["artist"])
    key = F.coalesce(F.nullif(F.lower(text(c.get("artist_key"))), F.lit("")), F.lower(name))
    out = rows.where(name != "").select(key.alias("artist_key"), name.alias("artist"), whole(c["rank"]).alias("place"), *[number(c.get(v)).alias(v) for v in values])
    last = F.row_number().over(Window.partitionBy("artist_key").orderBy(F.desc_nulls_last("place"), "artist"))
    return out.withColumn("_n", last).where("_n = 1").drop("_n")


def best_ranks(pages: DataFrame, least: int = 100) -> DataFrame:
    """Artists of several pages, each with its best rank; fewer than ``least`` artists are refused, as a page has failed then."""
    first = F.row_number().over(Window.partitionBy("artist_key").orderBy("rank", "listeners"))
    out = pages.withColumn("_n", first).where("_n = 1").drop("_n")
    if out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} artists: the pages are incomplete")
    return out


def entity_facts(entities: DataFrame) -> DataFrame:
    """Looked-up entities (id, capacity, opened, latitude, longitude as texts): implausible capacities dropped, the year of a time stamp."""
    cap = number(F.col("capacity"))
    year = F.substring("opened", 2, 4).try_cast("int")
    return entities.select("id", F.when((cap > 0) & (cap < 400_000), cap.cast("bigint")).alias("capacity"), year.alias("opened_year"), F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"))


def html_table(pages: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    """Rows of the HTML tables of each page: (key, row, header, cells). A row's cells are its td or th texts, tags dropped and entities resolved."""
    tr = F.regexp_extract_all(column, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    rows = pages.select(key, F.posexplode(tr).alias("row", "tr"))
    cells = F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return rows.select(key, "row", F.col("tr").rlike(r"(?i)<th\b").alias("header"), F.transform(cells, plain_html).alias("cells"))


def plain_html(c: Column) -> Column:
    """Text of a piece of HTML."""
    out = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out


def listeners_table(tables: DataFrame, key: str = "page_id") -> DataFrame:
    """Of scraped tables the columns labelled '#' or rank, artist and listeners, by the header row's labels wherever they stand."""
    low = F.transform("cells", lambda x: F.lower(F.trim(x)))
    at = lambda *labels: F.array_max(F.transform(F.array(*[F.lit(x) for x in labels]), lambda w: F.array_position(low, w)))
    heads = tables.where("header").select(key, at("#", "rank").alias("_r"), at("artist").alias("_a"), at("listeners", "monthly listeners").alias("_l"), F.col("row").alias("_h")).where("_a > 0 AND _l > 0")
    first = F.row_number().over(Window.partitionBy(key).orderBy("_h"))
    heads = heads.withColumn("_n", first).where("_n = 1").drop("_n")
    rows = tables.where("NOT header").join(heads, key).where("row > _h")
    cell = lambda c: F.get("cells", F.col(c) - 1)
    out = rows.select(key, whole(F.when(F.col("_r") > 0, cell("_r").cast("string"))).alias("rank"), cell("_a").alias("artist"), whole(cell("_l")).alias("listeners"))
    return out.where(S.not_blank(F.col("artist"))).withColumn("artist_key", F.lower(F.trim("artist")))
