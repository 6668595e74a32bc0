"""Token counts by scanning flat, unindexed token streams for end-of-document ids.

A token file is a flat run of 16-bit little-endian ids without an index; each document ends with the
separator. Files are read as blocks. A block is searched for separators with one vectorised
comparison; a prefix scan over the blocks' summaries (length, number of separators, place of the last) stitches the documents that
straddle blocks, and each block then counts its own documents. A scan never holds more than a block, and what a file's scan
gathers is a short row a block.

Empty documents count 0 tokens; null texts are empty; a null id names its own row; repeated rows count each; very long
texts are encoded whole, long runs of white space as the one piece that they are (``pieces``); an unterminated tail counts as a
document; a file with an odd byte at its end raises; empty tables and files give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import importlib
import importlib.util
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, plain_text

#: The folder of the public vocabularies; a parameter of ``write_tokens``.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY, SEPARATOR, BLOCK_TOKENS = "byte_bpe_50k.tiktoken", 50256, 1 << 19
#: The split pattern published with the vocabulary, used where the vocabulary package has none.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a rank file, once per process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        spec = importlib.util.find_spec("public_tokenizers")
        pattern = getattr(importlib.import_module("public_tokenizers"), "PATTERN", PATTERN) if spec else PATTERN
        _ENCODERS[path] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


# White space as Unicode has it; a run that is longer would exhaust the stack of the pattern's matcher.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")


def encode_whole(enc, text: str) -> list[int]:
    """Tokens of a text of any kind. Of a run of white space the pattern makes one piece, but for its last sign if the text goes on; long runs are cut out so."""
    out, at = [], 0
    for run in _LONG_BLANK.finditer(text):
        out += enc.encode_ordinary(text[at : run.start()])
        at = run.end() - (run.end() < len(text))
        out += enc._encode_single_piece(text[run.start() : at])
    return out + enc.encode_ordinary(text[at:])


TOKEN_TABLE = "file int, block int, payload binary, ids array<bigint>"


def write_tokens(documents: DataFrame, vocabulary: str = f"{VOCABULARIES}/{VOCABULARY}", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encode documents to flat token streams, one a partition, written to the shared store in blocks.

    Documents straddle blocks. The table has the blocks (file, block, payload) and, apart from
    them, the roster: rows without payload that hold the ids in the order of the file, needed
    only to name the documents again.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        file = TaskContext.get().partitionId()
        held, size, block, roster, rosters = [], 0, 0, [], 0

        def row(block, payload, ids):
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([payload], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "payload", "ids"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.array([*encode_whole(enc, text), SEPARATOR], dtype="<u2")
                roster.append(doc_id)
                held.append(tokens)
                size += len(tokens)
                if size >= block_tokens:
                    whole = np.concatenate(held)
                    while len(whole) >= block_tokens:
                        yield row(block, whole[:block_tokens].tobytes(), None)
                        whole, block = whole[block_tokens:], block + 1
                    held, size = [whole], len(whole)
                if len(roster) >= 100_000:
                    yield row(rosters, None, roster)
                    roster, rosters = [], rosters + 1
        if size:
            yield row(block, np.concatenate(held).tobytes(), None)
        if roster:
            yield row(rosters, None, roster)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text().alias("text"))
    return materialise(rows.mapInArrow(encode, TOKEN_TABLE))


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, payload) of flat binary files below ``path``, of any size: each task reads byte ranges of its own.

    The driver lists names and sizes only. Executors open the files by pyarrow's file systems (local, HDFS, object stores).
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(conf).listFiles(root, True)
    files = []
    while found.hasNext():
        status = found.next()
        name = status.getPath().toString()
        if status.getLen() % 2:
            raise ValueError(f"{name} doesn't hold whole 16-bit ids")
        if not status.getPath().getName().startswith(("_", ".")):
            files.append((name, status.getLen()))
    step = 2 * block_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened = (None, None)
        for batch in batches:
            for name, block, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if opened[0] != name:
                    uri = re.sub("^file:/+", "file:///", name)
                    system, inner = fs.FileSystem.from_uri(uri)
                    opened = name, system.open_input_file(inner)
                data = opened[1].read_at(min(step, size - block * step), block * step)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["file", "block", "payload"])

    listed = spark.createDataFrame(files, "file string, size bigint").where("size > 0")
    blocks = listed.select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / step).cast("int"))).alias("block"), "size")
    return blocks.repartition("file", "block").sortWithinPartitions("file", "block").mapInArrow(read, "file string, block int, payload binary")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in blocks (file, block, payload)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, places = [], []
            for payload in batch.column(2):
                ids = np.frombuffer(payload.as_buffer(), dtype="<u2") if payload.is_valid and len(payload.as_buffer()) else np.empty(0, "<u2")
                lengths.append(len(ids))
                places.append(np.flatnonzero(ids == separator).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["file", "block", "length", "at"])

    kind = blocks.schema["file"].dataType.simpleString()
    found = materialise(blocks.select("file", "block", "payload").mapInArrow(scan, f"file {kind}, block int, length bigint, at array<int>"))
    # The prefix scan sees a few numbers a block; the places of the separators stay with their blocks.
    short = found.select("file", "block", "length", F.size("at").cast("bigint").alias("n"), F.get("at", F.size("at") - 1).alias("last"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    short = short.withColumn("base", F.coalesce(F.sum("length").over(before), none)).withColumn("ordinal", F.coalesce(F.sum("n").over(before), none))
    ends = F.col("base") + F.col("last") + 1
    short = short.withColumn("open_at", F.coalesce(F.max(ends).over(before), none))
    tail = F.when(F.lead("block").over(order).isNull(), F.col("base") + F.col("length") - F.coalesce(ends, F.col("open_at"))).otherwise(none)
    short = short.select("file", "block", "base", "ordinal", "open_at", tail.alias("tail"))
    stitched = found.join(short, ["file", "block"])
    counts = F.transform(
        "at", lambda x, i: F.struct((F.col("ordinal") + i).alias("ordinal"), (F.col("base") + x - F.when(i == 0, F.col("open_at")).otherwise(F.col("base") + F.get("at", i - 1) + 1)).alias("n_tokens"))
    )
    open_end = F.when(F.col("tail") > 0, F.array(F.struct((F.col("ordinal") + F.size("at")).alias("ordinal"), F.col("tail").alias("n_tokens")))).otherwise(F.array().cast("array<struct<ordinal:bigint,n_tokens:bigint>>"))
    return stitched.select("file", F.explode(F.concat(counts, open_end)).alias("d")).select("file", "d.ordinal", "d.n_tokens")


def document_tokens(documents: DataFrame, vocabulary: str = f"{VOCABULARIES}/{VOCABULARY}") -> DataFrame:
    """op3: doc_id and n_tokens of every document, from the flat streams that hold them."""
    if not os.path.isabs(vocabulary):
        raise ValueError("the vocabulary's path must be absolute, as executors read it")
    stored = write_tokens(documents, vocabulary)
    counted = count_tokens(stored.where("payload IS NOT NULL"))
    names = stored.where("ids IS NOT NULL").select("file", "block", F.posexplode("ids").alias("place", "doc_id"))
    names = names.select("file", (F.col("block").cast("bigint") * 100_000 + F.col("place")).alias("ordinal"), "doc_id")
    return names.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
