"""Event assembly: bills, routes, legs, box-office matching, country backfill and venue facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def billed(setlists: DataFrame, categories: DataFrame, careers: DataFrame | None = None) -> DataFrame:
    """Artist-nights with event, category and slot on the bill (1 is the headliner).

    Order: category, most songs, longest career, name, id. Career counts are joined, not gathered; ``careers`` (artist_key, career)
    saves counting them from ``setlists`` where a narrower table holds them.
    """
    rows = setlists.where(S.not_blank(F.col("date_iso")) & S.not_blank(F.col("artist")))
    career = setlists.groupBy("artist_key").agg(F.count(F.lit(1)).alias("career")) if careers is None else careers
    rows = rows.join(categories.select("artist_key", "category"), "artist_key", "left").join(career, "artist_key")
    rows = rows.withColumn("category", F.coalesce("category", F.lit("Category E"))).withColumn("venue_key", S.venue_key(F.col("venue_id"), F.col("venue"), F.col("city")))
    rows = rows.withColumn("event_id", F.concat("date_iso", F.lit("|"), "venue_key"))
    order = [S.category_rank(F.col("category")), F.col("num_songs").desc_nulls_last(), F.col("career").desc(), "artist", "setlist_id"]
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy("event_id").orderBy(*order)))


def bill_collapse(setlists: DataFrame, categories: DataFrame, careers: DataFrame | None = None) -> DataFrame:
    """One row per event: the headliner's facts, support in order, counts; the tour is the headliner's or any other on the bill."""
    top = lambda c: F.max(F.when(F.col("slot") == 1, F.col(c)))
    facts = ["venue", "city", "country", "countryCode"]
    rest = ["capacity", "io", "venue_no"]
    return billed(setlists, categories, careers).groupBy("event_id").agg(
        F.first("date_iso").alias("date_iso"),
        F.first("venue_key").alias("venue_key"),
        *[top(c).alias(c) for c in facts],
        top("artist").alias("headliner"),
        top("artist_key").alias("headliner_key"),
        top("category").alias("category"),
        F.coalesce(F.nullif(top("tour"), F.lit("")), F.max(F.nullif(F.col("tour"), F.lit(""))), F.lit("")).alias("tour"),
        F.expr("listagg(CASE WHEN slot > 1 THEN artist END, ' + ') WITHIN GROUP (ORDER BY slot)").alias("support"),
        F.expr("listagg(setlist_id, ' | ') WITHIN GROUP (ORDER BY slot)").alias("setlist_ids"),
        F.count(F.lit(1)).alias("n_artists"),
        F.sum("num_songs").alias("songs"),
        *[top(c).alias(c) for c in rest],
    )


def route(rows: DataFrame, keys: list[str], order: list[str], city: str = "city", without: str | None = "") -> DataFrame:
    """previous_city and next_city in a tour; ``without`` where there is no tour, as no route is known."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = S.not_blank(F.col("tour"))
    before, after = F.coalesce(F.lag(city).over(w), F.lit("First Show")), F.coalesce(F.lead(city).over(w), F.lit("Final Show"))
    none = F.lit(without).cast("string")
    return rows.withColumn("previous_city", F.when(known, before).otherwise(none)).withColumn("next_city", F.when(known, after).otherwise(none))


def route_ingested(rows: DataFrame, ordinal: str) -> DataFrame:
    """Routes of files read one after the other: of repeated setlists the first read stays, and shows of a day go by reading order."""
    first = F.row_number().over(Window.partitionBy("setlist_id").orderBy(ordinal))
    once = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    return route(once, ["artist", "tour"], ["date_iso", ordinal, "setlist_id"])


def merge_days(rows: DataFrame, keys: list[str], name: str, order: str, value: str) -> DataFrame:
    """One row a day and place, unknown places included: names in first-seen order, the first row's ``order``, rows and the sum of ``value``."""
    each = rows.groupBy(*keys, name).agg(F.min(order).alias("_at"), F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    seen = F.array_sort(F.collect_list(F.struct("_at", name)))
    return each.groupBy(*keys).agg(F.array_join(F.transform(seen, lambda x: x[name]), " & ").alias("names"), F.min("_at").alias("first"), F.sum("_n").alias("n"), F.sum("_v").alias("total"))


def legs(events: DataFrame) -> DataFrame:
    """Successive shows of a tour with the days between; tours are told apart by name alone. Shows without a valid date drop out."""
    w = Window.partitionBy("tour").orderBy("date_iso", "event_id")
    ahead = {c: F.lead(c).over(w).alias(f"to_{c}") for c in ("event_id", "date_iso", "city", "country", "venue", "capacity")}
    dated = events.where(S.not_blank(F.col("tour")) & S.day(F.col("date_iso")).isNotNull())
    rows = dated.select("tour", "event_id", "date_iso", "city", "country", "venue", "capacity", *ahead.values())
    days = F.date_diff(S.day(F.col("to_date_iso")), S.day(F.col("date_iso")))
    return rows.where("to_event_id IS NOT NULL").withColumn("days_between", days)


#: Places by which an event and a run can agree, best first.
MATCH_TIERS = ("arena_id", "venue", "city")


def match_runs(events: DataFrame, runs: DataFrame, slack: int = 1) -> DataFrame:
    """The best box-office run of each event: same headliner, date in the run or ``slack`` days around it, and the same arena (tier 1, where
    both tables have ``arena_id``), venue (2) or city (3).

    Both sides are taken apart by tier and by month, so headliner, place and month are an equality and a busy headliner's shows
    don't meet all its runs. Best: tier, days off, fewest shows, id. Blank places match nothing; rows without valid dates drop out.
    """
    tiers = [(i, c) for i, c in enumerate(MATCH_TIERS, 1) if c in events.columns and c in runs.columns]
    places = lambda: F.array(*[F.struct(F.lit(i).alias("tier"), F.col(c).cast("string").alias("place")) for i, c in tiers])
    r = runs.withColumn("_from", S.day(F.col("start_iso"))).withColumn("_to", F.coalesce(S.day(F.col("end_iso")), F.col("_from"))).where("_from <= _to")
    months = F.sequence(F.trunc(F.date_sub("_from", slack), "month"), F.trunc(F.date_add("_to", slack), "month"), F.expr("INTERVAL 1 MONTH"))
    r = r.select(F.col("artist_key").alias("_act"), F.explode(places()).alias("_p"), "_from", "_to", "n_shows", "pid", "gross_usd", months.alias("_months"))
    r = r.where(S.not_blank(F.col("_p.place"))).select("_act", "_p.tier", "_p.place", F.explode("_months").alias("_month"), "_from", "_to", "n_shows", "pid", "gross_usd")
    e = events.where(S.not_blank(F.col("headliner_key"))).select("event_id", F.col("headliner_key").alias("_act"), S.day(F.col("date_iso")).alias("_day"), F.explode(places()).alias("_p"))
    e = e.where(F.col("_day").isNotNull() & S.not_blank(F.col("_p.place"))).select("event_id", "_act", "_day", "_p.tier", "_p.place", F.trunc("_day", "month").alias("_month"))
    near = (F.col("_day") >= F.date_sub("_from", slack)) & (F.col("_day") <= F.date_add("_to", slack))
    pairs = e.join(r, ["_act", "tier", "place", "_month"]).where(near)
    off = F.when(F.col("_day") < F.col("_from"), F.date_diff("_day", "_from")).when(F.col("_day") > F.col("_to"), F.date_diff("_day", "_to")).otherwise(0)
    best = pairs.withColumn("day_off", off).groupBy("event_id").agg(F.min(F.struct("tier", F.abs("day_off").alias("_off"), "n_shows", "pid", "day_off", "gross_usd")).alias("b"))
    return best.select("event_id", "b.pid", "b.tier", "b.day_off", "b.n_shows", "b.gross_usd")


def match_by_tier(events: DataFrame, runs: DataFrame, slack: int = 1, step=lambda df: df) -> DataFrame:
    """As ``match_runs``, a tier at a time: what a better tier has matched isn't tried again, and ``step`` gets each tier's matches."""
    tiers = [c for c in MATCH_TIERS if c in events.columns and c in runs.columns]
    out = None
    for c in tiers:
        others = [x for x in tiers if x != c]
        left = events if out is None else events.join(out.select("event_id"), "event_id", "left_anti")
        found = step(match_runs(left.drop(*others), runs, slack))
        out = found if out is None else out.unionByName(found)
    return out


def match_incremental(events: DataFrame, runs: DataFrame, previous: DataFrame, slack: int = 1) -> DataFrame:
    """(event_id, pid) with earlier matches kept; only events never tried are matched, and those without a run are marked 'none'."""
    fresh = events.join(previous, "event_id", "left_anti")
    found = fresh.select("event_id").join(match_runs(fresh, runs, slack).select("event_id", "pid"), "event_id", "left")
    return previous.select("event_id", "pid").unionByName(found.withColumn("pid", F.coalesce("pid", F.lit("none"))))


def unmatched(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """Runs that no event was matched to."""
    return runs.join(matches.select("pid").distinct(), "pid", "left_anti")


def duplicate_risk(rows: DataFrame, against: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with duplicate_risk 1 where ``against`` has the same non-blank keys."""
    known = against.select(*keys).where(S.not_blank(F.col(keys[0]))).distinct().withColumn("_hit", F.lit(1))
    return rows.join(known, keys, "left").withColumn("duplicate_risk", F.coalesce("_hit", F.lit(0))).drop("_hit")


def union_sources(sources: list[DataFrame], key: str) -> DataFrame:
    """All sources by column name; of equal keys the earliest source's row stays."""
    whole = None
    for i, s in enumerate(sources):
        part = s.withColumn("_source", F.lit(i))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_source"))
    return whole.withColumn("_nth", first).where("_nth = 1").drop("_nth", "_source")


def dominant_value(rows: DataFrame, key: str, value: str, least: float = 0.9) -> DataFrame:
    """(key, value, share) of the commonest value where it makes up ``least`` of the key's rows; ties go to the smaller value."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key)
    counts = counts.withColumn("share", F.col("_n") / F.sum("_n").over(w)).withColumn("_nth", F.row_number().over(w.orderBy(F.desc("_n"), value)))
    return counts.where((F.col("_nth") == 1) & (F.col("share") >= least)).select(key, value, "share")


def backfill(rows: DataFrame, key: str, value: str, fallbacks: DataFrame | None = None, least: float = 0.9) -> DataFrame:
    """Blank values filled from the key's dominant value, then from ``fallbacks`` (key, value); present values never change."""
    known = rows.where(S.not_blank(F.col(value)))
    table = dominant_value(known, key, value, least).select(key, F.col(value).alias("_fill"))
    if fallbacks is not None:
        extra = fallbacks.select(key, F.col(value).alias("_fill")).join(known.select(key).distinct(), key, "left_anti")
        table = table.unionByName(extra)
    return rows.join(table, key, "left").withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), "_fill")).drop("_fill")


def trimmed_capacity(samples: DataFrame, key: str, value: str, factor: float = 3.0, least: int = 3) -> DataFrame:
    """Largest value per key, with an outlier above ``factor`` times the truncated mean rejected if there are ``least`` samples."""
    stats = samples.groupBy(key).agg(F.count(value).alias("samples"), F.floor(F.avg(value)).cast("bigint").alias("typical"), F.max(value).alias("cap_max"))
    odd = (F.col("samples") >= least) & (F.col("typical") > 0) & (F.col("cap_max") > factor * F.col("typical"))
    kept = samples.join(stats.select(key, "typical"), key).where(F.col(value) <= factor * F.col("typical")).groupBy(key).agg(F.max(value).alias("_kept"))
    both = stats.join(kept, key, "left")
    return both.select(key, "samples", "typical", "cap_max", F.when(odd, F.col("_kept")).otherwise(F.col("cap_max")).alias("capacity"), F.when(odd, F.col("cap_max")).alias("rejected"))


def tenants(nights: DataFrame, act: str, place: str, day: str, least_dates: int = 8, least_home: int = 4) -> DataFrame:
    """Acts with a season of ``least_dates`` dates, ``least_home`` of them in one place; the best such season's figures."""
    at = nights.groupBy(act, F.substring(day, 1, 4).alias("year"), place).agg(F.count(F.lit(1)).alias("_n"))
    year = at.groupBy(act, "year").agg(F.sum("_n").alias("dates"), F.max("_n").alias("home"))
    return year.groupBy(act).agg(F.max("dates").alias("best_dates"), F.coalesce(F.max(F.when(F.col("dates") >= least_dates, F.col("home"))), F.lit(0)).alias("best_home")).withColumn(
        "tenant", ((F.col("best_dates") >= least_dates) & (F.col("best_home") >= least_home)).cast("int")
    )


def integrity(events: DataFrame, setlists: DataFrame) -> DataFrame:
    """One row of invariants: bill slots equal source rows, and no headliner stands twice on a date in a venue."""
    slots = events.agg(F.sum("n_artists").alias("bill_slots"), F.count(F.lit(1)).alias("events"))
    source = setlists.where(S.not_blank(F.col("date_iso")) & S.not_blank(F.col("artist"))).agg(F.count(F.lit(1)).alias("source_rows"))
    twice = events.groupBy("headliner_key", "date_iso", "venue_key").count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicates"))
    return slots.crossJoin(source).crossJoin(twice)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str, source: str, trusted: str = "api") -> DataFrame:
    """Latest row per key; rows of the trusted source are never replaced by others, whatever comes in whatever order."""
    rows = old.unionByName(new)
    order = [F.when(F.col(source) == trusted, 0).otherwise(1), F.col(version).desc_nulls_last()]
    tie = [F.xxhash64(*sorted(rows.columns))]
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order, *tie))).where("_nth = 1").drop("_nth")


# Columns of the exported events, in order.
EXPORT_COLUMNS = [
    "source", "date_iso", "eventDate", "headliner", "support", "artists", "n_artists", "tour", "venue", "city", "state", "stateCode", "country", "countryCode", "latitude", "longitude", "num_songs",
    "event_type", "category", "monthly_listeners", "pollstar_rank", "previous_city", "next_city", "pollstar_match", "pollstar_headliner", "pollstar_support", "pollstar_venue", "pollstar_venue_type",
    "pollstar_market", "pollstar_genre", "pollstar_promoter", "pollstar_run_shows", "pollstar_tickets_sold", "pollstar_capacity", "pollstar_capacity_pct", "pollstar_gross_usd", "pollstar_price_min",
    "pollstar_price_max", "pollstar_price_avg", "event_id", "setlist_urls", "competition", "result", "duplicate_risk",
]
EXPORTED_CATEGORIES = ["Category A", "Category B", "Category C"]


def exportable(events: DataFrame, since: str, arenas_only: bool = False) -> DataFrame:
    """Events from a day on of categories A to C or of another type than artists, in arenas only if asked."""
    rows = events.where((F.col("date_iso") >= since) & (F.col("category").isin(EXPORTED_CATEGORIES) | (F.col("event_type") != "Artist")))
    return rows.where(S.not_blank(F.col("arena_id").cast("string"))) if arenas_only else rows


def export_frame(events: DataFrame) -> DataFrame:
    """The export's columns as texts, '' for what is unknown or that the table doesn't have; the other date form is made from the ISO one."""
    made = {"eventDate": S.flip_date(F.col("date_iso")), "source": F.lit("setlistfm")}
    value = lambda c: F.col(c) if c in events.columns else made.get(c, F.lit(""))
    return events.select(*[F.coalesce(value(c).cast("string"), F.lit("")).alias(c) for c in EXPORT_COLUMNS], F.col("venue_key").alias("_key"))


def write_export(events: DataFrame, path: str) -> None:
    """The exported events as CSV with a header, in order of date and venue; partitions are ranges of that order, so parts concatenate."""
    rows = export_frame(events).repartitionByRange("date_iso", "_key").sortWithinPartitions("date_iso", "_key", "event_id")
    rows.drop("_key").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
