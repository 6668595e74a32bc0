"""Exact substring deduplication by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A string of ``LEAST`` bytes that starts earlier too (smaller id, or earlier in the same document) is
removed wherever it occurs again. Suffixes that share that many bytes must meet in one task:

1. Of every window of ``LEAST`` bytes the minimum hash of its ``GRAM``-byte grams is its key. Equal windows have equal
   keys, and neighbouring windows mostly share one, so a document becomes stretches of windows
   with a key each, at most ``STRETCH`` windows long.
2. Stretches are dealt by key, as hashes and places only. Equal stretches need no further look: all but
   the first are removed. This is done within each chunk of rows before the shuffle, so a group of
   copies sends a row a chunk. A key with a single stretch ends here.
3. What is left are keys with different stretches. Their bytes are fetched and transformed in chunks of whole keys.
   Intervals of the transform are expanded backwards, breadth first: level l finds
   the borders where neighbours share exactly l bytes, by increasing value, and the expansion stops at ``LEAST``, so
   that borders never found lie inside runs of suffixes that share ``LEAST`` bytes. All but the first of a run
   are removed. A key with more than ``HOT`` stretches is dealt anew by single windows, each under its content's key; these
   are equal or share nothing, so windows that stand alone end here too and equal ones are settled without a transform.
4. Removed places are united a document, and its remaining bytes are digested.

Null and empty texts have no bytes. Null ids come last. Of rows with equal ids the one with the smaller text
hash comes first; of repeated rows with equal id and text the first keeps what the text keeps and the others
lose all that windows cover. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, materialise, mixed, plain_text, text_slices, window_minima

LEAST, GRAM, STRETCH, HOT = 100, 32, 256, 4096
#: Rows that are collapsed together before the shuffle, and bytes that are transformed together.
CHUNK_ROWS, CHUNK_BYTES = 1000, 1 << 18
#: Bytes of pieces that a task holds before it sends them on.
HELD_BYTES = 1 << 20
#: A place packs 30 bits of start and 9 of length, so places order by start. The text is named by id and 64-bit hash.
_START, _LENGTH = 9, 511
_LAST = (1 << 63) - 1
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def _power(n: int, name: str, base: np.uint64) -> np.ndarray:
    if len(_POWERS.get(name, ())) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        _POWERS[name] = np.cumprod(out)
    return _POWERS[name][:n]


def stretches(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, key) arrays of the stretches of texts laid end to end, then their content hashes."""
    n = len(raw)
    if n < LEAST:
        e = np.empty(0, np.int64)
        return e, e, e, np.empty((2, 0), np.uint64)
    h = raw.astype(np.uint64) + np.uint64(1)
    scale, k = int(_BASE), 1
    while k < GRAM:
        h = h[:-k] * np.uint64(scale) + h[k:]
        scale, k = scale * scale & ((1 << 64) - 1), 2 * k
    grams = mixed(h)
    span = LEAST - GRAM + 1
    key = window_minima(grams, span)
    edge = np.zeros(len(key) + 1, np.int32)
    long = np.flatnonzero(np.diff(off) >= LEAST)
    edge[off[long]] += 1
    edge[off[long + 1] - LEAST + 1] -= 1
    ok = np.cumsum(edge[:-1]) > 0
    fresh = np.empty(len(key), bool)
    fresh[:1] = True
    fresh[1:] = (key[1:] != key[:-1]) | ~ok[:-1]
    places = np.flatnonzero(ok)
    begins = np.flatnonzero(fresh[places])
    windows = np.diff(np.append(begins, len(places)))
    parts = -(-windows // STRETCH)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(places[begins], parts) + part * STRETCH
    windows = np.minimum(np.repeat(windows, parts) - part * STRETCH, STRETCH)
    # A stretch whose key stands in two places may repeat itself: cut in unequal parts, it meets itself under its key.
    across = np.arange(span)
    first = (grams[start[:, None] + across] == key[start][:, None]).argmax(1)
    last = span - 1 - (grams[(start + windows - 1)[:, None] + across[::-1]] == key[start][:, None]).argmax(1)
    parts = 1 + ((first != windows - 1 + last) & (windows > 1))
    left = np.maximum(windows // 3, 1)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    whole, left = np.repeat(windows, parts), np.repeat(left, parts)
    start = np.repeat(start, parts) + part * left
    windows = np.where(np.repeat(parts, parts) == 1, whole, np.where(part == 0, left, whole - left))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(n, "up", _BASE), out=sums[1:])
    content = mixed((sums[start + windows + LEAST - 1] - sums[start]) * _power(n, "down", _INVERSE)[start] + windows.astype(np.uint64))
    text = np.searchsorted(off, start, side="right") - 1
    return text, start - off[text], windows, np.stack([key[start], content])


def _packed(start, length):
    return (start.astype(np.int64) << _START) | length.astype(np.int64)


_DEALT = ["key", "content", "doc", "hash", "place"]


def _rows(columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=names)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text hash, text) to stretches (key, content, doc, hash, place), and to removed places (content null, key for dealing only)."""

    def collapsed(found):
        key, content, doc, text, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, text, doc, content, key))
        key, content, doc, text, place = key[order], content[order], doc[order], text[order], place[order]
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
        twice = np.zeros(len(key), bool)
        twice[1:] = same[1:] & (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (place[1:] == place[:-1])
        yield _rows([key[~same].view(np.int64), content[~same].view(np.int64), doc[~same], text[~same], place[~same]], _DEALT)
        gone = same & ~twice
        if gone.any():
            spread = mixed(doc[gone].view(np.uint64) + np.uint64(1))
            yield _rows([spread.view(np.int64), pa.nulls(int(gone.sum()), pa.int64()), doc[gone], text[gone], place[gone]], _DEALT)

    found, rows = [], 0
    for batch in batches:
        doc, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for at, to, raw, off in text_slices(batch, 2):
            text, start, windows, both = stretches(raw, off)
            if len(text):
                found.append((both[0], both[1], doc[at:to][text], hashes[at:to][text], _packed(start, windows + LEAST - 1)))
            rows += to - at
            if rows >= CHUNK_ROWS and found:
                yield from collapsed(found)
                found, rows = [], 0
    if found:
        yield from collapsed(found)


_FOUND = ["key", "doc", "hash", "place"]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by (key, content, doc, hash, place) to removed places (key null) and to the first of each content of a key with several."""
    last = None  # key, content, doc, hash, place, and whether the key has shown several contents
    for batch in batches:
        key, doc, text, place = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
        live = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        if not live.all():
            yield _rows([pa.nulls(int((~live).sum()), pa.int64()), doc[~live], text[~live], place[~live]], _FOUND)
            key, doc, text, place = key[live], doc[live], text[live], place[live]
        if not len(key):
            continue
        content = batch.column(1).filter(pa.array(live)).to_numpy(zero_copy_only=False).astype(np.int64)
        carried = last is not None
        if carried:
            key, content, doc, text, place = (np.concatenate(([x], y)) for x, y in zip(last[:5], (key, content, doc, text, place), strict=True))
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= content[1:] != content[:-1]
        heads = np.flatnonzero(new)
        gone = ~new
        gone[1:] &= (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1])
        if gone.any():
            yield _rows([pa.nulls(int(gone.sum()), pa.int64()), doc[gone], text[gone], place[gone]], _FOUND)
        runs = np.cumsum(new_key) - 1
        several = np.bincount(runs, new) > 1
        first_several = carried and last[5]
        if first_several:
            several[0] = True
        take = several[runs[heads]]
        if first_several:
            take[0] = False  # sent before
        at = heads[take]
        if len(at):
            yield _rows([key[at], doc[at], text[at], place[at]], _FOUND)
        # The last content's first row goes on: its key may yet show another content.
        h = heads[-1]
        last = (key[h], content[h], doc[h], text[h], place[h], bool(several[-1]))


def _windows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of ``LEAST`` bytes in pieces: piece, start in it, and two 64-bit hashes of the content."""
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) + np.uint64(1)
    size = np.array([len(d) for d in data], np.int64)
    count = np.maximum(size - LEAST + 1, 0)
    piece = np.repeat(np.arange(len(data)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = inside + np.repeat(np.cumsum(size) - size, count)
    out = []
    for name, base in (("", _BASE), ("other ", _OTHER)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * _power(len(raw), name + "up", base))))
        down = _power(len(raw), name + "down", np.uint64(pow(int(base), -1, 1 << 64)))
        out.append(mixed((sums[at + LEAST] - sums[at]) * down[at]))
    return piece, inside, *out


_PIECES = ["key", "doc", "hash", "place", "bytes"]


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text hash, text, wanted places, their keys, hot flags) to (key, doc, text hash, place, bytes); bytes null: removed.

    Of a hot key's stretches single windows go out, under keys by content; of equal ones only the first, and the places of the
    others under keys by document, as they only pass through.
    """

    def sent(keys, docs, hashes, places, parts):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(places, pa.int64()), parts], names=_PIECES)

    def single(rows):
        doc, own_hash, begin = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        piece, inside, one, two = _windows([r[3] for r in rows])
        doc, own_hash, place = doc[piece], own_hash[piece], _packed(begin[piece] + inside, np.full(len(piece), LEAST))
        order = np.lexsort((place, own_hash, doc, two, one))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] = (doc[order][1:] == doc[order][:-1]) & (own_hash[order][1:] == own_hash[order][:-1]) & (place[order][1:] == place[order][:-1])
        at, gone = order[fresh], order[~fresh & ~twice]
        parts = pa.array([rows[p][3][i : i + LEAST] for p, i in zip(piece[at].tolist(), inside[at].tolist(), strict=True)], pa.binary())
        yield sent(one[at].view(np.int64), doc[at], own_hash[at], place[at], parts)
        if len(gone):
            spread = mixed(doc[gone].view(np.uint64) ^ mixed(own_hash[gone].view(np.uint64)))
            yield sent(spread.view(np.int64), doc[gone], own_hash[gone], place[gone], pa.nulls(len(gone), pa.binary()))

    hot, size = [], 0
    for batch in batches:
        rows, whole = [], 0
        for doc, own_hash, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            data = memoryview(text.as_buffer()) if len(wanted) else b""
            for w in wanted:
                start, length = w["place"] >> _START, w["place"] & _LENGTH
                part = bytes(data[start : start + length])
                if w["hot"]:
                    hot.append((doc, own_hash, start, part))
                    size += length
                else:
                    rows.append((w["key"], doc, own_hash, w["place"], part))
                    whole += length
            if whole >= HELD_BYTES:
                yield sent(*[list(c) for c in zip(*rows, strict=True)][:4], pa.array([r[4] for r in rows], pa.binary()))
                rows, whole = [], 0
            if size >= HELD_BYTES:
                yield from single(hot)
                hot, size = [], 0
        if rows:
            yield sent(*[list(c) for c in zip(*rows, strict=True)][:4], pa.array([r[4] for r in rows], pa.binary()))
    if hot:
        yield from single(hot)


def _transform(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by at least ``depth`` symbols (ties in any order), and each suffix's row."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | padded[j : j + n]
    length = 7
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1]))).astype(np.uint64)
        if length >= depth or int(rank.max()) == n - 1:
            row = np.empty(n, np.int64)
            row[order] = np.arange(n)
            return order, row
        ahead = np.zeros(n, np.uint64)
        ahead[: n - length] = rank[length:] + np.uint64(1)
        key = (rank << np.uint64(32)) | ahead
        length *= 2


def shared_runs(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and the number of the run of suffixes with ``least`` common symbols that each row is in.

    Symbols are 0 for a separator, which matches nothing, and 1 to 256. Breadth-first backward extension:
    of each interval of suffixes starting with w, the suffixes before it starting with c w make an interval
    too; its right border separates suffixes sharing fewer symbols than those before and is set once, at
    the first level that finds it. Only intervals that set a border are extended.
    """
    n = len(symbols)
    order, row = _transform(symbols, least + 1)
    before = symbols[order - 1].astype(np.int64)
    to = row[order - 1]
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for level in range(least):
        size = high - low + 1
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        c = before[rows]
        if level:
            kept = c > 0  # a separator ends a piece
            owner, rows, c = owner[kept], rows[kept], c[kept]
        if not len(rows):
            break
        group = owner * 257 + c
        by = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(group[by]) != 0)))
        target = to[rows[by]]
        first, last = np.minimum.reduceat(target, starts), np.maximum.reduceat(target, starts)
        # Intervals of one level are disjoint, so no two share a right border.
        new = ~border[last + 1]
        border[last + 1] = True
        low, high = first[new], last[new]
        if not len(low):
            break
    return order, np.cumsum(border[:-1]) - 1


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, text hash, place, bytes) sorted by key to removed (doc, text hash, place).

    Pieces of ``LEAST`` bytes share a string only if they are equal, so a key of nothing else needs no transform.
    """

    def removed(rows):
        rows = sorted(set(rows), key=lambda r: r[:3])
        sizes = np.array([len(r[3]) + 1 for r in rows])
        ends = np.cumsum(sizes)
        symbols = np.frombuffer(b"".join(r[3] + b"\x00" for r in rows), np.uint8).astype(np.uint64) + np.uint64(1)
        symbols[ends - 1] = 0
        order, run = shared_runs(symbols, LEAST)
        at = np.arange(len(symbols))
        whole = at + LEAST <= np.repeat(ends - 1, sizes)
        rows_of = np.flatnonzero(whole[order])
        by = np.lexsort((order[rows_of], run[rows_of]))
        start, group = order[rows_of][by], run[rows_of][by]
        again = np.zeros(len(start), bool)
        again[1:] = group[1:] == group[:-1]
        gone = np.sort(start[again])
        if not len(gone):
            return
        piece = np.searchsorted(ends, gone, side="right")
        new = np.ones(len(gone), bool)
        new[1:] = (np.diff(gone) != 1) | (np.diff(piece) != 0)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(gone)))
        doc = np.array([r[0] for r in rows], np.int64)[piece[first]]
        text = np.array([r[1] for r in rows], np.int64)[piece[first]]
        place = np.array([r[2] for r in rows], np.int64)[piece[first]]
        inside = gone[first] - (ends - sizes)[piece[first]]
        start = (place >> _START) + inside
        yield _rows([doc, text, _packed(start, count + LEAST - 1)], ["doc", "hash", "place"])

    held, size = [], 0

    def settled(batch):
        nonlocal held, size
        key, doc, text, place = (batch.column(i).to_numpy() for i in range(4))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        rows, longer = np.bincount(group), np.bincount(group, (place & _LENGTH) != LEAST)
        at = np.flatnonzero(((longer == 0) & (rows > 1))[group])
        if len(at):
            _, data = np.unique(batch.column(4).take(pa.array(at)).to_numpy(zero_copy_only=False), return_inverse=True)
            order = np.lexsort((place[at], text[at], doc[at], data, key[at]))
            at, data = at[order], data[order]
            again = (key[at][1:] == key[at][:-1]) & (data[1:] == data[:-1])
            twice = (doc[at][1:] == doc[at][:-1]) & (text[at][1:] == text[at][:-1]) & (place[at][1:] == place[at][:-1])
            at = at[1:][again & ~twice]
            yield _rows([doc[at], text[at], place[at]], ["doc", "hash", "place"])
        last = None
        batch = batch.filter(pa.array((longer > 0)[group]))
        for k, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if k != last and size >= CHUNK_BYTES:
                yield from removed(held)
                held, size = [], 0
            last = k
            held.append(tuple(row))
            size += len(row[3])

    rest = None  # pieces of the last key, which may go on
    for batch in batches:
        passed = batch.filter(batch.column(4).is_null())
        if passed.num_rows:
            yield _rows([passed.column(i) for i in (1, 2, 3)], ["doc", "hash", "place"])
        batch = batch.filter(batch.column(4).is_valid())
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int((key != key[-1]).sum())
        rest = batch.slice(cut)
        yield from settled(batch.slice(0, cut))
    if rest is not None:
        yield from settled(rest)
    if held:
        yield from removed(held)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, removed, number among equal rows) to the digest of op10 and the kept bytes' hash."""
    for batch in batches:
        out = []
        for text, gone, nth in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            n = len(data)
            if nth > 1:
                out.append((n, n, 1, hashlib.sha256(b"").hexdigest()) if n >= LEAST else (n, 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            kept, at, cut, spans = hashlib.sha256(), 0, 0, 0
            end = -1
            for start, size in sorted((p >> _START, p & _LENGTH) for p in gone or ()):
                if start > end:
                    kept.update(data[at:start])
                    spans += 1
                    cut += size
                    end = start + size
                elif start + size > end:
                    cut += start + size - end
                    end = start + size
                at = end
            kept.update(data[at:])
            out.append((n, cut, spans, kept.hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        parts = [batch.column(0), *[pa.array(list(c), pa.int64()) for c in columns[:3]], pa.array(list(columns[3]), pa.string())]
        yield pa.RecordBatch.from_arrays(parts, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """op10: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    text = plain_text()
    rows = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"), "doc_id")
    dealt = rows.select("doc", "hash", "text").mapInArrow(_deal, "key bigint, content bigint, doc bigint, hash bigint, place bigint")
    found = dealt.repartition("key").sortWithinPartitions("key", "content", "doc", "hash", "place").mapInArrow(_meet, "key bigint, doc bigint, hash bigint, place bigint")
    found = materialise(found)
    wanted = found.where("key IS NOT NULL")
    crowd = wanted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("hot"))
    # Written, so that the planner knows its true size and a key with many stretches can be split.
    crowd = materialise(crowd)
    wanted = wanted.join(crowd, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = wanted.groupBy("doc", "hash").agg(F.collect_list(F.struct("key", "place", "hot")).alias("wanted"))
    fetched = rows.select("doc", "hash", F.col("text").cast("binary").alias("text"), "doc_id").join(wanted, ["doc", "hash"]).select("doc", "hash", "text", "wanted")
    pieces = fetched.mapInArrow(_fetch, "key bigint, doc bigint, hash bigint, place bigint, bytes binary")
    expanded = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_expand, "doc bigint, hash bigint, place bigint")
    gone = found.where("key IS NULL").select("doc", "hash", "place").union(expanded)
    gone = gone.groupBy("doc", "hash").agg(F.collect_list("place").alias("gone"))
    whole = rows.select("doc", "hash", F.col("text").cast("binary").alias("text"), "doc_id").join(gone, ["doc", "hash"], "left")
    nth = F.row_number().over(Window.partitionBy("doc", "hash").orderBy("hash"))
    return whole.withColumn("nth", nth).select("doc_id", "text", "gone", "nth").mapInArrow(_digest, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
