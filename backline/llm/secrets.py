"""Secret scans: an incremental, content-addressed blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger keeps, for
each blob, which rule versions have read it and what they found; a scan reads only blobs with
a rule version not yet in the ledger, and findings are joined back to all paths that hold the
blob. Everything runs as DataFrame expressions.

Null texts count as empty; empty texts, empty tables and repeated rows give empty or repeated
results; a null path is kept; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, plain_text, scratch_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    ``hint`` matches every text that holds a finding, and is cheap.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str
    base: bool = True

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: A greedy run that is too short holds no longer match further on, so access and hex carry their least length
#: in the pattern. An assignment must not: one that is dropped still uses up its text.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
    Rule("github", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40, r"gh[opsur]_[A-Za-z0-9]{36}", base=False),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)
FOUND = "array<struct<start:bigint,place:int,end:bigint,kind:string>>"


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Code-point spans of one rule: pieces between matches give the positions."""
    rx = F.lit(rule.pattern)
    cut = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, rx, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, rx, F.lit(rule.group)).alias("part"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(FOUND).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = F.coalesce(F.length(x["part"]), F.lit(0)) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).cast(FOUND).alias("out"))

    return F.when(text.rlike(rule.hint), F.aggregate(cut, start, step)["out"]).otherwise(F.array().cast(FOUND))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, due array of rule names) to ledger rows (blob, rules, found)."""
    due = F.col("due")
    parts = [F.when(F.array_contains(due, r.name), _spans(F.col("text"), r, i)).otherwise(F.array().cast(FOUND)) for i, r in enumerate(rules)]
    return blobs.select("blob", due.alias("rules"), F.concat(*parts).alias("found"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows, or None where none has been written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(f"blob string, rules array<string>, found {FOUND}").parquet(ledger) if fs.exists(hadoop) else None


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``versions`` (with a ``text`` column) and return them with ``blob`` and ``found``.

    Every row of ``versions`` comes back once, without its text; ``found`` holds the findings
    of the current rule versions, ordered by start and then by the order of the rules.
    """
    spark = versions.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules])
    addressed = versions.withColumn("text", plain_text()).withColumn("blob", F.sha2("text", 256))
    texts = addressed.select("blob", "text")
    known = read_ledger(spark, ledger)
    if known is None:
        due = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("due", names)
    else:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        left = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
        due = texts.join(seen, "blob", "left").withColumn("due", left).where(F.size("due") > 0)
        due = due.groupBy("blob").agg(F.first("text").alias("text"), F.first("due").alias("due"))
    scan_blobs(due, rules).write.mode("append").option("compression", "zstd").parquet(ledger)
    # Each rule of a blob is read once in each version, so its findings stand in one ledger row.
    kinds = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.name))])
    current = (
        read_ledger(spark, ledger)
        .withColumn("found", F.filter("found", lambda x: F.array_contains(F.col("rules"), kinds[x["kind"]])))
        .where(F.size("found") > 0)
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    )
    # Written, so that both sides of the join are exchanged and a blob with many paths can be split.
    current = materialise(current)
    paths = addressed.drop("text")
    return paths.join(current, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(FOUND)))


def written(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_spans(documents: DataFrame, ledger: str | None = None) -> DataFrame:
    """The digest of op4: one row per document with counts, base hash and all spans."""
    ledger = ledger or scratch_dir(documents.sparkSession)
    rows = scan(documents.select("doc_id", "text"), ledger)
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in RULES if r.base]))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select(
        "doc_id",
        *[count(r.kind) for r in RULES if r.base],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )
