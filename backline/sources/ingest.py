"""Reading and writing: nested setlists, paged sources, tolerant CSV, snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SETLIST = (
    "id string, eventDate string, lastUpdated string, url string, artist struct<mbid:string,name:string>, tour struct<name:string>, "
    "venue struct<id:string,name:string,city:struct<name:string,state:string,stateCode:string,coords:struct<lat:double,long:double>,country:struct<code:string,name:string>>>, "
    "sets struct<set:array<struct<name:string,encore:int,song:array<struct<name:string,tape:boolean,info:string,cover:struct<name:string>,with:struct<name:string>>>>>>"
)
#: Most rows that one date's pages hold; a date with more is marked as capped.
PAGE_CAP = 10_000


def flatten_setlists(raw: DataFrame, column: str = "json") -> DataFrame:
    """JSON texts to flat rows; num_songs counts the songs of all sets; the date's parts are reordered, not checked."""
    s = raw.select(F.from_json(column, SETLIST).alias("s")).where("s.id IS NOT NULL")
    p = F.split("s.eventDate", "-")
    songs = F.aggregate(F.coalesce("s.sets.set", F.array()), F.lit(0), lambda a, x: a + F.coalesce(F.size(x["song"]), F.lit(0)))
    c = "s.venue.city"
    return s.select(
        F.col("s.id").alias("setlist_id"), F.col("s.artist.name").alias("artist"), F.col("s.artist.mbid").alias("artist_mbid"), F.col("s.eventDate").alias("event_date"),
        F.when(F.size(p) == 3, F.concat_ws("-", p[2], p[1], p[0])).otherwise("").alias("date_iso"), F.coalesce("s.tour.name", F.lit("")).alias("tour"),
        F.col("s.venue.name").alias("venue"), F.col("s.venue.id").alias("venue_id"), F.col(f"{c}.name").alias("city"), F.col(f"{c}.state").alias("state"), F.col(f"{c}.country.name").alias("country"),
        F.col(f"{c}.country.code").alias("countryCode"), F.col(f"{c}.coords.lat").alias("latitude"), F.col(f"{c}.coords.long").alias("longitude"),
        F.greatest(songs, F.lit(0)).alias("num_songs"), F.col("s.url").alias("setlist_url"), F.col("s.lastUpdated").alias("last_updated"),
    )


def explode_songs(raw: DataFrame, column: str = "json") -> DataFrame:
    """One row per song with its position over all sets, and its set's number from 1."""
    s = raw.select(F.from_json(column, SETLIST).alias("s")).select(F.col("s.id").alias("setlist_id"), F.posexplode("s.sets.set").alias("_set", "x"))
    rows = s.select("setlist_id", "_set", F.col("x.encore").alias("encore"), F.posexplode("x.song").alias("_at", "song"))
    nth = F.row_number().over(Window.partitionBy("setlist_id").orderBy("_set", "_at"))
    return rows.select(
        "setlist_id", nth.alias("position"), (F.col("_set") + 1).alias("set_no"), "encore", F.col("song.name").alias("name"),
        F.col("song.cover.name").alias("cover_of"), F.col("song.with.name").alias("with_artist"), F.coalesce(F.col("song.tape").cast("int"), F.lit(0)).alias("tape"), F.col("song.info").alias("info"),
    )


class PagedDates(DataSource):
    """A batch source of paged JSON, one partition a date. The option ``pages`` names a JSON file {date: [page, ...]} that stands for the service."""

    @classmethod
    def name(cls) -> str:
        return "paged_dates"

    def schema(self) -> str:
        return "day string, page int, json string, capped boolean"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.done = options["pages"], set(filter(None, options.get("done", "").split(",")))

    def partitions(self) -> list[InputPartition]:
        with open(self.path) as f:
            return [InputPartition(day) for day in sorted(json.load(f)) if day not in self.done]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path) as f:
            pages = json.load(f)[partition.value]
        seen, total = 0, sum(len(p) for p in pages)
        for number, page in enumerate(pages, 1):
            if not page or seen >= PAGE_CAP:
                return
            for item in page[: PAGE_CAP - seen]:
                yield partition.value, number, json.dumps(item), total > PAGE_CAP
            seen += len(page)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, quoted line breaks and columns by name."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', enforceSchema=False)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key isn't stored yet, one a key; the number appended."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fresh = rows.dropDuplicates([key])
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti").select(*rows.columns)
    fresh = fresh.cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def write_snapshot(tables: dict[str, DataFrame], root: str, tag: str) -> None:
    """Parquet of every table under root/tag, then a manifest with their row counts, so a reader sees whole snapshots only."""
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for name, table in tables.items():
        table.write.parquet(f"{root}/{tag}/{name}")
        counts[name] = spark.read.parquet(f"{root}/{tag}/{name}").count()
    manifest = spark.createDataFrame([(tag, json.dumps(counts))], "tag string, rows string")
    manifest.coalesce(1).write.json(f"{root}/{tag}/MANIFEST")


def read_snapshot(spark: SparkSession, root: str, tag: str | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, by default of the greatest tag that has a manifest."""
    manifests = spark.read.json(f"{root}/*/MANIFEST", schema="tag string, rows string")
    row = (manifests.where(F.col("tag") == tag) if tag else manifests.orderBy(F.desc("tag"))).first()
    return {name: spark.read.parquet(f"{root}/{row['tag']}/{name}") for name in json.loads(row["rows"])}


def write_report(sheets: dict[str, DataFrame], path: str, methodology: dict[str, str]) -> None:
    """A report as one CSV folder a sheet, with its methodology as JSON."""
    for name, sheet in sheets.items():
        sheet.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{path}/{name}")
    spark = next(iter(sheets.values())).sparkSession
    spark.createDataFrame(list(methodology.items()), "topic string, text string").coalesce(1).write.mode("overwrite").json(f"{path}/methodology")
