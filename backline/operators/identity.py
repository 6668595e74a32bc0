"""Entity resolution: similar names, shared places, components, priorities, verdicts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T


def shared_store(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one on a single machine and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="backline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each action go when it ends; else they stay until the driver's garbage is collected."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    path = shared_store(df.sparkSession)
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of a chain of steps: each is written, its shuffle files go, and with them the table of the step before."""

    def __init__(self):
        self.path = None

    def __call__(self, df: DataFrame) -> DataFrame:
        spark, old, self.path = df.sparkSession, self.path, shared_store(df.sparkSession)
        with released(spark):
            df.write.option("compression", "zstd").parquet(self.path)
        if old:
            folder = spark._jvm.org.apache.hadoop.fs.Path(old)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return spark.read.schema(df.schema).parquet(self.path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable from each.

    Labels fall along edges and then jump to their label's label, so rounds grow with the logarithm of the
    longest path. Each round is written to the shared store.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct()
    both = written(both)
    label = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")))
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("m"))
        low = label.join(near, "u").select("u", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        jump = low.join(label.select(F.col("u").alias("c"), F.col("c").alias("cc")), "c", "left")
        following = written(jump.select("u", F.least("c", F.coalesce("cc", "c")).alias("c"), "old"))
        moved = following.where("c <> old").limit(1).count()
        label = following.select("u", "c")
        if not moved:
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return label.select(F.col("u").alias("node"), F.col("c").alias("component"))


def survivors(components: DataFrame, weights: DataFrame) -> DataFrame:
    """Every member with its component's heaviest member (ties: the least), and no chains: each points straight at it."""
    rows = components.join(weights, "node")
    best = rows.groupBy("component").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("survivor"))
    return rows.join(best, "component").select("node", "survivor")


def similar_names(venues: DataFrame, floor: float = 88.0, most: int = 400) -> DataFrame:
    """Pairs of a city's venues with similar names; the busier one is kept. Cities with more than ``most`` venues are left out, as the rule says."""
    size = venues.groupBy("country", "city").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= 2) & (F.col("_n") <= most))
    v = venues.join(size.drop("_n"), ["country", "city"])
    cols = ["venue_no", "norm", "events", "capacity", "first_event", "last_event"]
    left, right = (v.select("country", "city", *[F.col(c).alias(f"{side}_{c}") for c in cols]) for side in "ab")
    pairs = left.join(right, ["country", "city"]).where("a_venue_no < b_venue_no")
    # Names without a common word can only reach the floor if few letters differ, which the JVM tells; the rest isn't scored.
    tokens = lambda side: F.array_sort(F.array_distinct(F.split(f"{side}_norm", " ")))
    one, two = F.array_join(tokens("a"), " "), F.array_join(tokens("b"), " ")
    near = F.levenshtein(one, two) <= (F.length(one) + F.length(two)) * (1 - floor / 100)
    pairs = pairs.where(F.arrays_overlap(tokens("a"), tokens("b")) | near)
    pairs = pairs.withColumn("score", T.token_set_score(F.col("a_norm"), F.col("b_norm"))).where(F.col("score") >= floor)
    swap = F.col("b_events") > F.col("a_events")
    pick = lambda c, one, two: F.when(swap, F.col(f"{two}_{c}")).otherwise(F.col(f"{one}_{c}"))
    out = [x for c in cols for x in (pick(c, "a", "b").alias(f"keep_{c}"), pick(c, "b", "a").alias(f"fold_{c}"))]
    overlap = S.overlap_fraction(F.col("a_first_event"), F.col("a_last_event"), F.col("b_first_event"), F.col("b_last_event"))
    return pairs.select("country", "city", *out, F.round("score", 1).alias("score"), F.round(overlap, 2).alias("overlap"))


def colocated(places: DataFrame, metres: float = 25.0) -> DataFrame:
    """Pairs of a country's places within ``metres`` of each other, by grid cells of that size and their neighbours."""
    step = 1000 * S.EARTH_KM * 3.141592653589793 / 180
    mean = places.groupBy("country").agg(F.avg("lat").alias("_mid"))
    p = places.join(F.broadcast(mean), "country")
    p = p.withColumn("x", F.col("lon") * step * F.cos(F.radians("_mid"))).withColumn("y", F.col("lat") * step)
    p = p.withColumn("cx", F.floor(F.col("x") / metres)).withColumn("cy", F.floor(F.col("y") / metres)).select("country", "venue_no", "x", "y", "cx", "cy")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = p.withColumn("s", F.explode(around)).select("country", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), F.col("venue_no").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    away = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
    return p.join(other, ["country", "cx", "cy"]).where("venue_no < other").withColumn("metres", away).where(F.col("metres") <= metres).select("country", "venue_no", "other", "metres")


def first_by_trust(rows: DataFrame, key: list[str], trust: Column, *tie) -> DataFrame:
    """Of rows with equal key the most trusted (least value), then by ``tie``."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(trust, *tie))).where("_nth = 1").drop("_nth")


def alias_passes(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Arena of each event: by alias in its city, by alias where the city's name starts the other's, then by alias in the country if it isn't generic.

    A later pass only fills what earlier ones left; of several arenas the least id wins.
    """
    e = events.select("event_id", "norm", "city", "country")
    a = aliases.select(F.col("norm").alias("_norm"), F.col("city").alias("_city"), F.col("country").alias("_country"), "arena_id", "generic")
    same = e.join(a, (F.col("norm") == F.col("_norm")) & (F.col("country") == F.col("_country")))
    begins = F.col("city").startswith(F.concat("_city", F.lit(" "))) | F.col("_city").startswith(F.concat("city", F.lit(" ")))
    best = lambda keep: F.min(F.when(keep, F.col("arena_id")))
    found = same.groupBy("event_id").agg(best(F.col("city") == F.col("_city")).alias("one"), best(begins).alias("two"), best(F.col("generic") == 0).alias("three"))
    return e.join(found, "event_id", "left").select("event_id", F.coalesce("one", "two", "three").alias("arena_id"), F.when(F.col("one").isNotNull(), 1).when(F.col("two").isNotNull(), 2).when(F.col("three").isNotNull(), 3).alias("found_by"))


def flag_counts(aliases: DataFrame, key: str, value: str, least: int, name: str) -> DataFrame:
    """Keys with their number of distinct values and a flag from ``least`` on."""
    return aliases.groupBy(key).agg(F.countDistinct(value).alias("n")).withColumn(name, (F.col("n") >= least).cast("int"))


# Vocabularies of the verdict on two similar names.
SPONSORS = [
    "o2", "ao", "men", "carling", "3", "3arena", "3olympia", "citizens", "vodafone", "movistar", "barclaycard", "barclays", "santander", "utilita",
    "motorpoint", "ovo", "co op", "coop", "bonus", "first direct", "m and s", "m and s bank", "resorts world", "mercedes benz", "telekom", "lanxess", "sap",
    "uber", "crypto com", "chase", "t mobile", "xfinity", "toyota", "honda", "prudential", "capital one", "rocket mortgage", "little caesars", "fiserv",
    "delta", "footprint", "climate pledge", "moda", "paycom", "frost bank", "at and t", "golden 1", "bridgestone", "nationwide", "keybank", "wells fargo",
    "cfg bank", "amalie", "kaseya", "amerant", "gainbridge", "ball", "verizon", "sprint", "enterprise", "ppg", "smoothie king", "target", "united center",
    "scotiabank", "canadian tire", "rogers", "bell", "videotron", "place bell", "avicii", "friends", "tele2", "hovet", "globen", "jyske bank", "royal", "forum",
    "zenith", "accor", "bercy", "paris la defense", "adidas", "puma", "emirates", "etihad", "eventim", "mitsubishi electric", "wizink", "riyadh air",
    "swansea com", "principality", "cardiff city",
]
GENERIC_NAMES = [
    "club", "hall", "theatre", "theater", "arena", "stadium", "stadion", "venue", "the venue", "auditorium", "upstairs", "downstairs", "basement", "bar",
    "cafe", "centre", "center", "pavilion", "festival", "park", "square", "church", "cathedral", "museum", "gallery", "studio", "studios", "tent", "big top",
    "main stage", "outdoor", "indoor", "unknown",
]
DESCRIPTIVE = [
    "theatre", "theater", "centre", "center", "coliseum", "stadium", "arena", "hall", "poppodium", "concert", "venue", "campground", "convention", "auditorium",
    "playhouse", "complex", "the", "at", "and", "of", "in", "s", "zaal", "sala", "salle", "teatro", "teatre", "halle", "palais", "pavilion", "amphitheater",
    "amphitheatre", "music",
]
DISTINGUISHERS = [
    "west", "east", "north", "south", "upper", "lower", "grand", "main", "big", "little", "old", "new", "annex", "terrassen", "terrace", "side", "bayside",
    "front", "back", "red", "blue", "green", "black", "white", "one", "two", "three", "a", "b", "i", "ii", "iii",
]


def dedup_verdict(pairs: DataFrame, overrides: DataFrame | None = None, concurrent: float = 0.25) -> DataFrame:
    """verdict and should_merge of pairs of similar names (columns of ``similar_names``); the first rule that holds decides.

    Unknown spans don't count as concurrent. ``overrides`` (one, two, merge, why) settles pairs of names in either order.
    """
    words = F.array_union(F.array_except(F.split("keep_norm", " "), F.split("fold_norm", " ")), F.array_except(F.split("fold_norm", " "), F.split("keep_norm", " ")))
    known = F.col("keep_capacity").isNotNull() & F.col("fold_capacity").isNotNull()
    ratio = F.when(known, F.greatest("keep_capacity", "fold_capacity") / F.nullif(F.least("keep_capacity", "fold_capacity"), F.lit(0)))
    rows = pairs.withColumn("differing", F.array_sort(words)).withColumn("capacity_ratio", F.round(ratio, 2))
    some = F.size("differing") > 0
    among = lambda values: F.exists("differing", lambda w: w.isin(values))
    city = F.split(F.lower("city"), " ")
    together = F.coalesce(F.col("overlap") > concurrent, F.lit(False))
    room = among(T.SUBROOM_MARKERS)
    verdict = (
        F.when(F.col("keep_norm").isin(GENERIC_NAMES) | F.col("fold_norm").isin(GENERIC_NAMES), "separate: a name too generic for a building")
        .when(among(DISTINGUISHERS), "separate: a word tells one room or site from others")
        .when(F.exists("differing", lambda w: w.rlike(r"^\d+$")), "separate: a number names a second room")
        .when(room & together, "separate: a smaller room, in use at the same time")
        .when(together & F.coalesce(ratio >= 2.0, F.lit(False)), "separate: in use at the same time, one half the size")
        .when(together, "separate: both names in use at once")
        .when(room, "separate: a smaller room in the venue")
        .when(some & F.forall("differing", lambda w: w.isin(SPONSORS)), "merge: a new sponsor, spans apart")
        .when(some & F.forall("differing", lambda w: w.isin(DESCRIPTIVE + SPONSORS) | F.array_contains(city, w)), "merge: descriptive words only")
        .when(F.coalesce(ratio < 1.5, F.lit(False)), "merge: spans apart, capacities agree")
        .when(~known, "review: spans apart, capacity unknown")
        .otherwise("review: unclear")
    )
    rows = rows.withColumn("verdict", verdict)
    if overrides is not None:
        o = overrides.select("one", "two", "merge", "why")
        both = o.union(o.select("two", "one", "merge", "why")).select(F.col("one").alias("keep_norm"), F.col("two").alias("fold_norm"), F.concat(F.when(F.col("merge"), "merge: by hand, ").otherwise("separate: by hand, "), "why").alias("_hand")).dropDuplicates(["keep_norm", "fold_norm"])
        rows = rows.join(both, ["keep_norm", "fold_norm"], "left").withColumn("verdict", F.coalesce("_hand", "verdict")).drop("_hand")
    return rows.withColumn("should_merge", F.col("verdict").startswith("merge"))


def resolve_chains(edges: DataFrame, rank: str = "trust") -> DataFrame:
    """(alias, survivor) for edges alias to canonical (bigint nodes): over all edges a component's survivor is its most trusted canonical, then the least.

    Former canonicals get rows of their own, so no alias points at an alias.
    """
    parts = connected_components(edges, "alias", "canonical")
    names = edges.groupBy(F.col("canonical").alias("node")).agg(F.min(rank).alias("_rank"))
    folded = edges.select(F.col("alias").alias("node")).distinct().withColumn("_folded", F.lit(1))
    scored = parts.join(names, "node", "left").join(folded, "node", "left")
    best = scored.groupBy("component").agg(F.min(F.struct(F.coalesce("_rank", F.lit(99)).alias("r"), F.coalesce("_folded", F.lit(0)).alias("f"), "node")).alias("b"))
    return scored.join(best, "component").where(F.col("node") != F.col("b.node")).select(F.col("node").alias("alias"), F.col("b.node").alias("survivor"))


def enrichment_score(name_exact: Column, ratio: Column, city_ok: Column, km: Column, country_ok: Column, most_km: float = 25.0, least: float = 88.0) -> Column:
    """High, Medium, Low or null for a candidate from name, place and country; unknown distances don't agree."""
    place = F.coalesce(city_ok, F.lit(False)) | F.coalesce(km <= most_km, F.lit(False))
    near = F.coalesce(ratio >= least, F.lit(False))
    return F.when(name_exact & place, "High").when(name_exact & F.coalesce(country_ok, F.lit(False)), "Medium").when(near & ~name_exact & place, "Medium").when(name_exact | near, "Low")


def best_candidates(scored: DataFrame, target: str, confidence: str, *order) -> DataFrame:
    """The most confident candidate of each target, then the first by ``order``."""
    rank = F.when(F.col(confidence) == "High", 0).when(F.col(confidence) == "Medium", 1).when(F.col(confidence) == "Low", 2)
    return first_by_trust(scored.where(F.col(confidence).isNotNull()), [target], rank, *order)


def blank_country_splits(venues: DataFrame, name: str, city: str, code: str) -> DataFrame:
    """Names and cities found both without and with a country code; null cities are a group too."""
    blank = ~S.not_blank(F.col(code))
    rows = venues.groupBy(name, city).agg(F.count_if(blank).alias("blank"), F.countDistinct(F.when(~blank, F.col(code))).alias("codes"), F.min(F.when(~blank, F.col(code))).alias("code"))
    return rows.where("blank > 0 AND codes > 0")


#: Which earlier lookups are done again: none, those that failed, or all.
REDO = ("new", "errors", "all")


def enrichment_targets(places: DataFrame, known: DataFrame, redo: str = "new", crowd: int = 20) -> DataFrame:
    """Places to look up (known: venue_no, status), with ``centroid`` 1 where more than ``crowd`` places share the coordinate, which is then a city's."""
    if redo not in REDO:
        raise ValueError(f"redo is one of {REDO}")
    done = {"new": known, "errors": known.where("status <> 'error'"), "all": known.limit(0)}[redo]
    shared = places.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select("lat", "lon", F.lit(1).alias("centroid"))
    left = places.join(done.select("venue_no").distinct(), "venue_no", "left_anti")
    return left.join(shared, ["lat", "lon"], "left").withColumn("centroid", F.coalesce("centroid", F.lit(0)))
