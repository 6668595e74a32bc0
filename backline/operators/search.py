"""Finding things: categories, cities and markets by name, faceted venue search, a set's profile, labels in venues, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T
from .identity import written

# Labels of events.category by short name, and those taken by default.
LABELS = {**{x: f"Category {x}" for x in "ABCDE"}, "OTHER": T.OTHER_TYPE, "TENANT": T.SPORT_TYPES[0], "NONTENANT": T.SPORT_TYPES[1]}
DEFAULT_CATEGORIES = ["A", "B", "C"]
SUGGESTIONS = 8


class Ambiguous(ValueError):
    """A name that means places in several countries."""


class Unknown(ValueError):
    """A name that means none, with those that hold it."""


def categories(values: list[str] | None = None) -> list[str]:
    """Labels of short or full names in any case, A to C by default; 'all' stands for all eight, and another name is an error."""
    names = [v.strip().upper().removeprefix("CATEGORY ") for v in values or DEFAULT_CATEGORIES]
    if "ALL" in names:
        return list(LABELS.values())
    if wrong := [n for n in names if n not in LABELS]:
        raise ValueError(f"unknown category: {wrong}")
    return [LABELS[n] for n in names]


def since(events: DataFrame, day: str, wanted: list[str]) -> DataFrame:
    """Events of the categories from a day on; those without a valid date drop out."""
    return events.withColumn("event_dt", S.day(F.col("date_iso"))).where((F.col("event_dt") >= F.lit(day).cast("date")) & F.col("category").isin(wanted))


def same_name(c: Column, name: str) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))) == name.strip().lower()


def resolve(places: DataFrame, name: str, country: str | None = None, members: DataFrame | None = None) -> tuple[str, str]:
    """(country, city) of a name in any case; Ambiguous if several countries have it, Unknown if none does.

    places: country, city, events. ``members`` (country, city, market) lets a city that was folded stand for its market.
    At most a few rows come to the driver.
    """
    within = lambda df: df if country is None else df.where(same_name(F.col("country"), country))
    hit = within(places).where(same_name(F.col("city"), name)).groupBy("country").agg(F.max("city").alias("city"), F.sum("events").alias("events")).orderBy(F.desc("events"), "country").limit(SUGGESTIONS).collect()
    if len(hit) > 1:
        raise Ambiguous(f"{name!r} is in {', '.join(r['country'] for r in hit)}")
    if hit:
        return hit[0]["country"], hit[0]["city"]
    if members is not None:
        home = within(members).where(same_name(F.col("city"), name)).orderBy("country", "market").first()
        if home:
            return home["country"], home["market"]
    near = places.where(F.contains(F.lower("city"), F.lit(name.strip().lower()))).groupBy("city", "country").agg(F.sum("events").alias("n")).orderBy(F.desc("n"), "city").limit(SUGGESTIONS).collect()
    raise Unknown(f"no {name!r}; there are {[f'{r.city}, {r.country}' for r in near]}")


def suggestions(places: DataFrame, part: str) -> DataFrame:
    """The busiest cities whose name holds a text."""
    rows = places.where(F.contains(F.lower("city"), F.lit(part.strip().lower()))).groupBy("city", "country").agg(F.sum("events").alias("events"))
    return rows.orderBy(F.desc("events"), "city", "country").limit(SUGGESTIONS)


def faceted(venues: DataFrame, mix: DataFrame | None = None, **facets) -> DataFrame:
    """Venues that meet every given facet: continent, country, city, contains, venue_type, io, opened_from, opened_to, least_capacity,
    most_capacity, least_events, dominant (the category most of a venue's events are of, by ``mix``: venue_no, category, events).

    Missing numbers count as 0, and an upper bound also asks for more than 0; other facets compare a column of that name.
    """
    c = lambda name: F.coalesce(name, F.lit(0))
    rows = venues
    rules = {
        "continent": lambda v: S.continent(F.col("countryCode")) == v,
        "contains": lambda v: F.contains(F.lower(F.coalesce("venue", F.lit(""))), F.lit(v.lower())),
        "opened_from": lambda v: c("opened_year") >= v,
        "opened_to": lambda v: (c("opened_year") <= v) & (c("opened_year") > 0),
        "least_capacity": lambda v: c("capacity") >= v,
        "most_capacity": lambda v: (c("capacity") <= v) & (c("capacity") > 0),
        "least_events": lambda v: c("events") >= v,
    }
    for name, value in facets.items():
        if value is None:
            continue
        if name == "dominant":
            first = F.row_number().over(Window.partitionBy("venue_no").orderBy(F.desc("events"), "category"))
            top = mix.select("venue_no", "category", "events").withColumn("_n", first).where("_n = 1").where(F.col("category") == value)
            rows = rows.join(top.select("venue_no"), "venue_no", "left_semi")
        else:
            rows = rows.where(rules[name](value) if name in rules else F.col(name) == value)
    return rows


def profile(events: DataFrame, chosen: DataFrame, key: str, first: str, last: str) -> dict[str, DataFrame]:
    """Roll-ups of a set of venues in a period: head, categories, years, months, venues (200 busiest), artists (100 busiest).

    The chosen events are written once and all six read them.
    """
    e = written(events.join(chosen.select(key).distinct(), key, "left_semi").where(F.col("date_iso").between(first, last)).withColumn("tickets", F.coalesce("tickets", F.lit(0))))
    n, t = F.count(F.lit(1)).alias("events"), F.sum("tickets").alias("tickets")
    return {
        "head": e.agg(n, t, F.countDistinct(key).alias("venues"), F.min("date_iso").alias("first_event"), F.max("date_iso").alias("last_event")),
        "categories": e.groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorised")).alias("category")).agg(n, t),
        "years": e.groupBy(F.substring("date_iso", 1, 4).alias("year")).agg(n),
        "months": e.groupBy(F.substring("date_iso", 6, 2).alias("month")).agg(n),
        "venues": e.groupBy(key).agg(F.min("venue").alias("venue"), F.min("city").alias("city"), n, t, F.max("capacity").alias("capacity")).orderBy(F.desc("events"), key).limit(200),
        "artists": e.groupBy("headliner_key").agg(F.min("headliner").alias("headliner"), F.count(F.lit(1)).alias("shows"), F.countDistinct(key).alias("venues"), F.max("category").alias("category")).orderBy(F.desc("shows"), "headliner_key").limit(100),
    }


def labelled(packages: DataFrame, venues: DataFrame) -> DataFrame:
    """Packages whose label, or a part of it between slashes, is the name of one of the venues."""
    parts = F.array_distinct(F.concat(F.array("label"), F.split("label", "/")))
    rows = packages.select("package", "label", F.explode(parts).alias("_part")).withColumn("_key", T.norm_key(F.col("_part")))
    keys = venues.select(T.norm_key(F.col("venue")).alias("_key")).where("_key <> ''").distinct()
    return rows.join(keys, "_key", "left_semi").select("package", "label").distinct()


def label_merge(rows: DataFrame, labels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with a label by several keys in any case; of repeated labels the least."""
    low = lambda df: [F.lower(F.trim(F.coalesce(k, F.lit("")))).alias(f"_{k}") for k in keys]
    table = labels.select(*low(labels), value).groupBy(*[f"_{k}" for k in keys]).agg(F.min(value).alias(value))
    return rows.select("*", *low(rows)).join(table, [f"_{k}" for k in keys], "left").drop(*[f"_{k}" for k in keys])


def discover(bills: DataFrame, seeds: DataFrame, rounds: int = 2) -> DataFrame:
    """(artist, found_in): artists reached from the seeds through venues that both played, in the round that first reaches them.

    Each round joins the newest artists with their venues and those with their artists, distinct before each join, and is written.
    """
    pairs = written(bills.select("artist", "venue").distinct())
    known = written(seeds.select("artist").distinct().withColumn("found_in", F.lit(0)))
    fresh = known
    for n in range(1, rounds + 1):
        venues = pairs.join(fresh.select("artist"), "artist", "left_semi").select("venue").distinct()
        fresh = pairs.join(venues, "venue", "left_semi").select("artist").distinct().join(known.select("artist"), "artist", "left_anti")
        fresh = written(fresh.withColumn("found_in", F.lit(n)))
        if fresh.isEmpty():
            break
        known = written(known.union(fresh))
    return known


def ordinal(c: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    end = F.when((c % 100).between(10, 20), "th").when(c % 10 == 1, "st").when(c % 10 == 2, "nd").when(c % 10 == 3, "rd").otherwise("th")
    return F.concat(c.cast("string"), end)


def article(c: Column) -> Column:
    """'an' before numbers that are said with a vowel first: those that begin with 8, 11 or 18."""
    return F.when(c.cast("string").rlike("^(8|11|18)"), "an").otherwise("a")


def years_covered(first: Column, last: Column) -> Column:
    """Years between two dates, a quarter at least."""
    return F.greatest(F.date_diff(last, first) / 365.25, F.lit(0.25))
