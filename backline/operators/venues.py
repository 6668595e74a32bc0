"""Venue assembly: one row per building with every fact's source, alias tables, review flags and facts put back on events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T

# Venue types that tell the kind, and those whose rooms may hold more than 100,000.
OUTSIDE_TYPES = ["amphitheater", "amphitheatre", "fairground", "festival site", "outdoor venues", "race track", "racetrack", "stadium"]
INSIDE_TYPES = ["arena", "auditorium / theatre", "ballroom", "casino", "club", "convention center", "theater", "theatre"]
VAST_TYPES = ["Stadium", "Outdoor Venues", "Untyped Venue", ""]
OUTLIER_RATIO, OUTLIER_SAMPLES, PLAUSIBLE = 3, 3, 100_000
#: Sources of an arena alias, the first that has it wins.
ALIAS_SOURCES = ["name", "also_known_as", "matched_venue", "manual", "identity"]


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def with_uid(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Events with ``venue_uid``: the canonical or own normalised name with city and country, or the venue key without a name.

    An alias (alias_norm, city_norm, countryCode, canonical_norm) holds in its own city only; of several the least name wins.
    """
    known = aliases.groupBy(F.col("alias_norm").alias("venue_norm"), blank("city_norm").alias("_city"), blank("countryCode").alias("_cc")).agg(F.min("canonical_norm").alias("_canonical"))
    e = events.withColumn("_city", blank("city_norm")).withColumn("_cc", blank("countryCode")).join(known, ["venue_norm", "_city", "_cc"], "left")
    uid = F.concat(F.coalesce("_canonical", "venue_norm"), F.lit("|"), F.col("_city"), F.lit("|"), F.col("_cc"))
    return e.withColumn("venue_uid", F.when(blank("venue_norm") == "", F.col("venue_key")).otherwise(uid)).drop("_canonical", "_city", "_cc")


def observed(events: DataFrame) -> DataFrame:
    """One row a building: the greatest value of each attribute, numbers of keys and names, the names in order, span, and observed capacities
    with an outlying largest one set aside."""
    top = lambda *names: [F.max(n).alias(n) for n in names]
    cap = F.col("observed_capacity")
    rows = events.where(S.not_blank(F.col("venue_uid"))).groupBy("venue_uid").agg(
        *top("venue", "venue_norm", "city", "city_norm", "country", "countryCode", "latitude", "longitude", "arena_id", "venue_type"),
        F.countDistinct("venue_key").alias("n_keys"), F.countDistinct("venue").alias("n_names"), F.array_join(F.array_sort(F.collect_set("venue")), ",").alias("aliases"),
        F.count(F.lit(1)).alias("events"), F.min("date_iso").alias("first_event"), F.max("date_iso").alias("last_event"),
        F.max(cap).alias("cap_max"), F.floor(F.avg(cap)).cast("bigint").alias("cap_typical"), F.count(cap).alias("cap_samples"),
    )
    odd = (F.col("cap_samples") >= OUTLIER_SAMPLES) & (F.col("cap_typical") > 0) & (F.col("cap_max") > OUTLIER_RATIO * F.col("cap_typical"))
    strange = rows.where(odd).select("venue_uid", F.col("cap_typical").alias("_typical"))
    kept = events.select("venue_uid", cap.alias("_cap")).join(strange, "venue_uid").where(F.col("_cap") <= OUTLIER_RATIO * F.col("_typical")).groupBy("venue_uid").agg(F.max("_cap").alias("_kept"))
    rows = rows.join(kept, "venue_uid", "left")
    return rows.withColumn("cap_rejected", F.when(odd, F.col("cap_max"))).withColumn("cap_trimmed", F.when(odd, F.col("_kept")).otherwise(F.col("cap_max"))).drop("_kept")


def first_known(*sources: tuple[str, Column]) -> tuple[Column, Column]:
    """The first value that isn't null, and the name of its source."""
    return F.coalesce(*[v for _, v in sources]), F.coalesce(*[F.when(v.isNotNull(), n) for n, v in sources])


def review(venues: DataFrame, least_events: int = 20) -> DataFrame:
    """needs_review and review_reason: busy venues without capacity or kind, and capacities that the type belies."""
    c, io = F.col("capacity").isNull(), F.col("outside_inside").isNull()
    gap = F.when(c & io, "no capacity, no indoor/outdoor").when(c, "no capacity").when(io, "no indoor/outdoor")
    gap = F.when(F.col("events") >= least_events, gap)
    odd = F.when((F.col("capacity") > PLAUSIBLE) & ~blank("venue_type").isin(VAST_TYPES), "capacity implausible for venue type")
    reason = F.nullif(F.concat_ws("; ", gap, odd), F.lit(""))
    return venues.withColumn("review_reason", reason).withColumn("needs_review", reason.isNotNull().cast("int"))


def assemble(events: DataFrame, arenas: DataFrame, enrichment: DataFrame, identity: DataFrame | None = None, least_events: int = 20) -> DataFrame:
    """Buildings of ``events`` (with ``venue_uid``), each fact from the most trusted source that has it, with that source's name.

    arenas (arena_id, concert_capacity, arena_type, outside_inside) are the curated sheet; enrichment (venue_uid, status, confidence,
    latitude, longitude, capacity, venue_type, outside_inside) are lookups, used where matched with high confidence;
    identity (canonical, canonical_norm, city_norm, countryCode) names buildings. One row a key is taken from each.
    """
    rows = observed(events)
    if identity is not None:
        uid = F.concat_ws("|", F.col("canonical_norm"), blank("city_norm"), blank("countryCode"))
        names = identity.where(S.not_blank(F.col("canonical"))).groupBy(uid.alias("venue_uid")).agg(F.max("canonical").alias("_name"), F.max("canonical_norm").alias("_norm"))
        rows = rows.join(names, "venue_uid", "left").withColumn("venue", F.coalesce("_name", "venue")).withColumn("venue_norm", F.coalesce("_norm", "venue_norm")).drop("_name", "_norm")
    a = arenas.select("arena_id", F.nullif("concert_capacity", F.lit(0)).alias("a_cap"), F.nullif("arena_type", F.lit("")).alias("a_type"), F.nullif("outside_inside", F.lit("")).alias("a_io")).dropDuplicates(["arena_id"])
    en = enrichment.where("status = 'matched' AND confidence = 'High'").dropDuplicates(["venue_uid"])
    en = en.select("venue_uid", *[F.col(c).alias(f"e_{c}") for c in ("latitude", "longitude", "capacity", "venue_type", "outside_inside")])
    rows = rows.join(a, "arena_id", "left").join(en, "venue_uid", "left")
    capacity, _ = first_known(("", F.col("a_cap")), ("", F.col("e_capacity")), ("", F.col("cap_trimmed")))
    source = F.when(F.col("a_cap").isNotNull(), "dashboard").when(F.col("e_capacity").isNotNull(), "lookup").when(F.col("cap_rejected").isNotNull(), "box office (outlier trimmed)").when(F.col("cap_trimmed").isNotNull(), "box office")
    seen = F.nullif(F.col("venue_type"), F.lit(""))
    kind, kind_source = first_known(("dashboard", F.col("a_type")), ("box office", seen), ("lookup", F.col("e_venue_type")))
    low = F.lower(blank("venue_type"))
    inferred = F.when(low.isin(OUTSIDE_TYPES), "Outside").when(low.isin(INSIDE_TYPES), "Inside")
    io, io_source = first_known(("dashboard", F.col("a_io")), ("inferred from venue type", inferred), ("lookup", F.col("e_outside_inside")))
    out = rows.select(
        "venue_uid", "venue", "venue_norm", "city", "city_norm", "country", "countryCode", F.coalesce("e_latitude", "latitude").alias("latitude"), F.coalesce("e_longitude", "longitude").alias("longitude"),
        F.when(F.col("e_latitude").isNotNull(), "lookup").otherwise("events").alias("coords_source"), "n_keys", "n_names", "aliases", "events", "first_event", "last_event", "arena_id",
        capacity.alias("capacity"), source.alias("capacity_source"), "cap_max", "cap_typical", "cap_samples", "cap_rejected", kind.alias("venue_type"), kind_source.alias("venue_type_source"), io.alias("outside_inside"), io_source.alias("outside_inside_source"),
    )
    return review(out, least_events)


def attach(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events with their building's capacity, its source, type and kind; events without a building keep none."""
    facts = venues.select("venue_uid", F.col("capacity").alias("venue_capacity"), F.col("capacity_source").alias("venue_capacity_source"), F.col("venue_type").alias("assembled_type"), F.col("outside_inside").alias("venue_outside_inside"))
    return events.join(facts, "venue_uid", "left")


def arena_by_id(runs: DataFrame, arenas: DataFrame) -> DataFrame:
    """Runs with the arena that bears their venue id (arenas: arena_id, venue_id); blank ids find none, of several arenas the least."""
    known = arenas.where(S.not_blank(F.col("venue_id"))).groupBy("venue_id").agg(F.min("arena_id").alias("arena_id"))
    return runs.drop("arena_id").join(known, "venue_id", "left")


def fold_table(identity: DataFrame) -> DataFrame:
    """Aliases that fold a building: rows of the identity table whose alias isn't their canonical name."""
    return identity.where("alias_norm <> canonical_norm").select("alias_norm", "city_norm", "countryCode", "canonical_norm")


def arena_aliases(sources: DataFrame) -> DataFrame:
    """(alias_norm, arena_id, city, countryCode, source) rows to one per alias and arena, from the first source, with ``ambiguous`` (the alias means
    several arenas) and ``generic`` (it is used in three cities or more)."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in ALIAS_SOURCES]), F.col("source")), F.lit(99))
    first = F.row_number().over(Window.partitionBy("alias_norm", "arena_id").orderBy(order, "city"))
    rows = sources.where(S.not_blank(F.col("alias_norm"))).withColumn("_n", first).where("_n = 1").drop("_n")
    n = rows.groupBy("alias_norm").agg(F.countDistinct("arena_id").alias("n_arenas"), F.countDistinct("city").alias("n_cities"))
    return rows.join(n, "alias_norm").withColumn("ambiguous", (F.col("n_arenas") > 1).cast("int")).withColumn("generic", (F.col("n_cities") >= 3).cast("int"))


def remap(rows: DataFrame, key: str, survivors: DataFrame) -> DataFrame:
    """Rows whose foreign key points at a merged one point at its survivor (alias, survivor); the others stay."""
    table = survivors.select(F.col("alias").alias(key), F.col("survivor").alias("_to"))
    return rows.join(table, key, "left").withColumn(key, F.coalesce("_to", key)).drop("_to")


def clashes(edges: DataFrame, trust: str = "trust") -> DataFrame:
    """Aliases that sources send to different canonical names: the name that wins, by trust, and how many others there are."""
    best = edges.groupBy("alias").agg(F.min(F.struct(trust, "canonical")).alias("b"), F.countDistinct("canonical").alias("names"))
    return best.where("names > 1").select("alias", F.col("b.canonical").alias("canonical"), F.col(f"b.{trust}").alias("trust"), (F.col("names") - 1).alias("others"))


def crowding(places: DataFrame) -> DataFrame:
    """Places with the number of different names at their coordinate, to six decimals."""
    at = places.withColumn("_x", F.round("lat", 6)).withColumn("_y", F.round("lon", 6))
    return at.join(at.groupBy("_x", "_y").agg(F.countDistinct("venue").alias("names_here")), ["_x", "_y"]).drop("_x", "_y")


def hybrid_key(places: DataFrame, aliases: DataFrame, most_names: int = 8) -> DataFrame:
    """Places with a grouping key: the alias's canonical name, else the coordinate if ``most_names`` or fewer share it, else name and city."""
    rows = crowding(places).join(aliases.select("venue", "canonical").dropDuplicates(["venue"]), "venue", "left")
    point = F.concat_ws(",", F.lit("at"), F.format_string("%.6f", F.round("lat", 6)), F.format_string("%.6f", F.round("lon", 6)))
    key = F.when(F.col("canonical").isNotNull(), F.concat(F.lit("alias:"), F.col("canonical"))).when(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("names_here") <= most_names), point).otherwise(F.concat_ws("|", F.lower("venue"), F.lower("city")))
    return rows.withColumn("group_key", key)


def rename_review(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Co-located clusters (node, component) as renames of their anchor, the place with most events: grade by distance, capacities and gap.

    ``places``: venue_no, lat, lon, capacity, events, first_event, last_event (dates). Names in use at once are marked concurrent.
    """
    rows = pairs.join(places, pairs["node"] == places["venue_no"])
    size = rows.groupBy("component").agg(F.max(F.struct("events", -F.col("venue_no"))).alias("_top"), F.count(F.lit(1)).alias("members"))
    rows = rows.join(size, "component").withColumn("anchor", -F.col("_top.col2"))
    a = places.select(F.col("venue_no").alias("anchor"), *[F.col(c).alias(f"a_{c}") for c in ("lat", "lon", "capacity", "first_event", "last_event")])
    rows = rows.where("venue_no <> anchor").join(a, "anchor")
    metres = S.haversine_km(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon")) * 1000
    ratio = F.greatest("capacity", "a_capacity") / F.nullif(F.least("capacity", "a_capacity"), F.lit(0))
    ratio = F.when(F.col("capacity").isNotNull() & F.col("a_capacity").isNotNull(), ratio)
    gap = S.gap_days(F.col("first_event"), F.col("last_event"), F.col("a_first_event"), F.col("a_last_event"))
    graded = rows.withColumn("metres", metres).withColumn("capacity_ratio", ratio).withColumn("gap_days", gap)
    graded = graded.withColumn("kind", F.when(F.col("gap_days") > 0, "rename").otherwise("concurrent")).withColumn("confidence", S.rename_grade(F.col("metres"), F.col("capacity_ratio"), F.col("gap_days")))
    return graded.select("component", "members", "anchor", "venue_no", F.round("metres", 1).alias("metres"), F.round("capacity_ratio", 3).alias("capacity_ratio"), "gap_days", "kind", "confidence")


def io_cascade(rows: DataFrame, venue_io: str, arena_io: str, name: str) -> DataFrame:
    """Kind of place from the venue's label, the arena's, or the name, with where it came from."""
    clean = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    io, source = first_known(("venue", clean(venue_io)), ("arena", clean(arena_io)), ("inferred", T.io_from_name(F.col(name))), ("unknown", F.lit("unknown")))
    return rows.withColumn("io", io).withColumn("io_source", source)
