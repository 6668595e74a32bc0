"""Benchmark decontamination by winnowing.

A benchmark item is cut into windows of ``WINDOW`` words (an item with fewer words is one
window). Of each window the minimum k-gram hash is its fingerprint, so a document that shares
a whole window holds that fingerprint too. Document fingerprints are joined with those of the
benchmark, and each hit is extended to the full window by comparing the hashes of its words.

The benchmark meets the documents in blocks of about ``BLOCK_WINDOWS`` windows, one after the other: a pass over
the documents a block, no shuffle of texts, and one block on the driver and in the executors at a time, whose size is bounded
whatever the benchmark's. With several blocks each pass is written, and a document's parts are united by its id and text hash.

Null and wordless texts have no words; a null item id marks words but isn't counted as an item;
repeated items count once; repeated documents each give a row; an empty benchmark marks nothing; an empty table gives no rows.
Very long texts are taken whole, in a slice of their own. Other columns, whatever their names, are ignored or carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, gram_hashes_at, materialise, numbered, plain_text, text_slices, window_minima, words_of

#: Words of a window, of a k-gram, and windows of a block (32 bytes each).
WINDOW, GRAM, BLOCK_WINDOWS = 10, 5, 1_000_000


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) to (n words, window hash, fingerprint, item_id)."""
    for batch in batches:
        ids = batch.column(0)
        for at, _, raw, off in text_slices(batch, 1):
            words, _, _, wo = words_of(raw, off)
            for i in range(len(off) - 1):
                own = words[wo[i] : wo[i + 1]]
                if not len(own):
                    continue
                n = min(WINDOW, len(own))
                full = gram_hashes(own, n)
                prints = window_minima(gram_hashes(own, GRAM), WINDOW - GRAM + 1) if n == WINDOW else full
                rows = pa.table({"n": np.full(len(full), n, np.int32), "window": full.view(np.int64), "print": prints.view(np.int64)})
                yield from rows.append_column("item_id", pa.array([ids[at + i].as_py()] * len(full), pa.int64())).to_batches()


@dataclass
class Block:
    """Windows of one block: for each length the sorted windows, their items, and the fingerprints."""

    lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    prints: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Block:
        lengths = {}
        n_of, window, fingerprint = (rows[c].to_numpy() for c in ("n", "window", "print"))
        named, item = rows["item_id"].is_valid().to_numpy(), rows["item_id"].fill_null(0).to_numpy()
        for n in np.unique(n_of):
            own = n_of == n
            windows, inverse = np.unique(window[own].view(np.uint64), return_inverse=True)
            pairs = np.unique(np.stack([inverse[named[own]], item[own & named]], 1), axis=0)
            lengths[int(n)] = windows, np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1]
        prints = np.unique(fingerprint[n_of == WINDOW].view(np.uint64))
        table = np.zeros(1 << 20, bool)
        table[prints >> np.uint64(44)] = True
        return Block(lengths, prints, table)


def _found(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return (sorted_values[at] == values if len(sorted_values) else np.zeros(len(values), bool)), at


def _matches(words: np.ndarray, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window length, word positions where a window occurs, index of that window)."""
    for n, (windows, _, _) in block.lengths.items():
        if len(words) < n:
            continue
        if n < WINDOW:
            hashes, places = gram_hashes(words, n), np.arange(len(words) - n + 1)
        else:
            minima = window_minima(gram_hashes(words, GRAM), WINDOW - GRAM + 1)
            kept = np.flatnonzero(np.concatenate(([True], minima[1:] != minima[:-1])))
            kept = kept[block.table[minima[kept] >> np.uint64(44)]]
            kept = kept[_found(block.prints, minima[kept])[0]]
            if not len(kept):
                continue
            runs = np.concatenate(([0], np.flatnonzero(minima[1:] != minima[:-1]) + 1, [len(minima)]))
            last = runs[np.searchsorted(runs, kept, side="right")]
            size = last - kept
            places = np.repeat(kept - (np.cumsum(size) - size), size) + np.arange(size.sum())
            hashes = gram_hashes_at(words, places, WINDOW)
        ok, at = _found(windows, hashes)
        if ok.any():
            yield n, places[ok], at[ok]


def _marks(batch: pa.RecordBatch, column: int, b: Block) -> tuple[list, list, list]:
    """Of each text: number of words, hit runs as start, end, start, ..., and items."""
    n_words, hits, items = [], [], []
    for _, _, raw, off in text_slices(batch, column):
        words, _, _, wo = words_of(raw, off)
        n = len(off) - 1
        n_words += np.diff(wo).tolist()
        own_hits: list = [[]] * n
        own_items: list = [[]] * n
        hit_docs, pairs, edge = [], [], np.zeros(len(words) + 1, np.int32)
        for k, places, at in _matches(words, b):
            d = np.searchsorted(wo, places, side="right") - 1
            inside = places + k <= wo[d + 1]
            places, at, d = places[inside], at[inside], d[inside]
            np.add.at(edge, places, 1)
            np.add.at(edge, places + k, -1)
            _, starts, ids = b.lengths[k]
            size = starts[at + 1] - starts[at]
            take = np.repeat(starts[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            hit_docs.append(d)
            pairs.append(np.stack([np.repeat(d, size), ids[take]], 1))
        if hit_docs:
            covered = (np.cumsum(edge)[:-1] > 0).astype(np.int8)
            for d in np.unique(np.concatenate(hit_docs)):
                step = np.diff(np.concatenate(([0], covered[wo[d] : wo[d + 1]], [0])))
                own_hits[d] = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1).ravel().tolist()
            both = np.unique(np.concatenate(pairs), axis=0)
            docs, begin = np.unique(both[:, 0], return_index=True)
            for d, own in zip(docs, np.split(both[:, 1], begin[1:]), strict=False):
                own_items[d] = own.tolist()
        hits += own_hits
        items += own_items
    return n_words, hits, items


def _windows(benchmark: DataFrame, block_windows: int) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), plain_text().alias("text"))
    windows = materialise(items.mapInArrow(_item_windows, "n int, window bigint, print bigint, item_id bigint").distinct())
    return windows, max(1, -(-windows.count() // block_windows))


def _held(windows: DataFrame, blocks: int, i: int):
    part = windows if blocks == 1 else windows.where(F.pmod("window", F.lit(blocks)) == i)
    return windows.sparkSession.sparkContext.broadcast(Block.of(part.toArrow()))


def marked(documents: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id of each document with n_words, hits (start and end word of each maximal hit run) and items."""
    windows, blocks = _windows(benchmark, block_windows)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.sha2(plain_text(), 256).alias("sha") if blocks > 1 else F.lit("").alias("sha"), plain_text().alias("text"))

    def marker(block):
        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, hits, items = _marks(batch, 2, block.value)
                parts = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(parts, names=["doc_id", "sha", "n_words", "hits", "items"])

        return mark

    whole = None
    for i in range(blocks):
        held = _held(windows, blocks, i)
        part = rows.mapInArrow(marker(held), f"doc_id {id_type}, sha string, n_words bigint, hits array<int>, items array<bigint>")
        if blocks == 1:
            return part.drop("sha")
        part = materialise(part)
        held.destroy()
        whole = part if whole is None else whole.unionByName(part)
    none = F.array().cast("array<int>")
    at = F.flatten(F.transform("hits", lambda x, i: F.when(i % 2 == 0, F.sequence(x, F.get("hits", i + 1) - 1)).otherwise(none)))
    merged = whole.withColumn("hits", F.when(F.size("hits") > 0, at).otherwise(none)).groupBy("doc_id", "sha")
    merged = merged.agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("at"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        (F.count(F.lit(1)) / blocks).cast("int").alias("times"),
    )
    first = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    last = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    merged = merged.withColumn("hits", F.flatten(F.zip_with(first, last, lambda a, b: F.array(a, b + 1))))
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select("doc_id", "n_words", "hits", "items")


def _hit_words() -> Column:
    """Sum of ends minus sum of starts."""
    signed = F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("bigint"))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, x: a + x)


def contamination(documents: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The digest of op8: one row per document."""
    rows = marked(documents, benchmark, block_windows)
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select(
        "doc_id",
        "n_words",
        _hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Documents without any hit word, with their own columns: a filter for each block, no shuffle."""
    windows, blocks = _windows(benchmark, block_windows)
    (kept, named), place = numbered(documents), documents.columns.index("text")
    schema = kept.schema

    def clean(block):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not h for h in _marks(batch, place, block.value)[1]], pa.bool_()))

        return keep

    for i in range(blocks):
        held = _held(windows, blocks, i)
        kept = kept.mapInArrow(clean(held), schema)
        if i + 1 < blocks:
            kept = materialise(kept)
            held.destroy()
    return named(kept)
