"""What the corpus operators share: scratch tables, byte-level words, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes worked on at a time inside one Python task; bounds its memory.
SLICE_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name in the store that driver and executors share, which ``spark.checkpoint.dir`` names.

    Where it is unset, a session on a single machine (master local) gets a temporary folder; on a cluster, whose
    executors would write to disks of their own, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared store and return the table read back.

    Cuts the lineage, and what reads it survives the loss of an executor.
    """
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_text(column: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def own_columns(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns c0, c1, ..., for steps that names with dots break, and what gives a frame the names back."""
    plain = df.select(*[c.alias(f"c{i}") for i, c in enumerate(own_columns(df))])
    return plain, lambda out: out.toDF(*df.columns)


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into (first row, last row + 1, bytes, offsets) of about ``limit`` bytes of text."""
    arr = batch.column(column)
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if not n:
        return
    _, off_buf, data = arr.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, to, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that their order looks random."""
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: (64-bit hashes, starts, ends, word offsets of each text).

    A word is a run of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII;
    in UTF-8 that is a run of bytes, so no text is decoded. Words don't cross texts.
    """
    n = len(raw)
    if not n:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e, np.zeros(len(off), np.int64)
    low = _LOWER[raw]
    is_word = _IS_WORD[low]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    first = off[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    last = off[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends, np.zeros(len(off), np.int64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    within = np.arange(at[-1] + lens[-1]) - np.repeat(at, lens)
    terms = (low[is_word].astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[within]
    return mixed(np.add.reduceat(terms, at)), starts, ends, np.searchsorted(starts, off)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k words from each position (positions whose k words exist)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + words[j : j + n]
    return mixed(out)


def gram_hashes_at(words: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """As gram_hashes, for some positions only."""
    out = np.zeros(len(places), np.uint64)
    for j in range(k):
        out = out * _BASE + words[places + j]
    return mixed(out)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
