"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Every text gets the MinHash signature of its five-word shingles, one byte a value. Texts of the same words are a
   class and go on once.
2. Each of ``TREES`` trees is a prefix trie of ``DEPTH`` signature values. The forest is one globally sorted table (tree, whole
   signature row, class), range-partitioned, so a hot prefix spreads over partitions. Neighbours in trie order are tied by
   their longest common prefix, so the classes below any prefix are chained: rows in proportion to the classes, never all pairs.
3. Whole signatures give each tie's similarity. The matched prefix starts at full depth and is shortened until, in every
   band of similarity that holds links, the expected recall reaches ``RECALL``: links found, each weighed by the reciprocal of its
   chance of being found at this depth. At the depth that reaches it for links at the threshold themselves it ends in any case.
4. Ties that are surely below the threshold are cut; what remains connected is a neighbourhood. Where classes below one prefix
   are in different neighbourhoods, because unlike ones stand between them in trie order, all pairs across neighbourhoods
   are estimated there, in blocks, and joined. So two similar classes that meet in some tree are in one neighbourhood.
5. Neighbourhoods get their shingle sets and all their pairs are verified exactly, by counting
   common shingles in blocks of ``BLOCK`` classes; a large one is dealt out as pairs of blocks.
   Tasks return link counts and a spanning forest, not pairs. Groups are components of verified links alone.

Words are runs of digits, letters (A-Z in lower case) and characters beyond ASCII. A text of
fewer than five words is one shingle. A text without words, null ones included, is linked to nothing
and is a class of its own row's id. Very long texts are shingled whole. Repeated rows are copies. Null ids are kept; a group's
id is its least id that isn't null. Other columns, whatever their names, are ignored or carried. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gram_hashes_at, materialise, mixed, own_columns, plain_text, text_slices, words_of
from .graph import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH = 32, 8
VALUES = TREES * DEPTH
#: A tie with an estimate below this is surely under the threshold: five deviations of an estimate from 256 values lie between.
LEAST_ESTIMATE, BAND = 0.67, 0.05
#: Classes of a block in verification, and in the estimation across neighbourhoods.
BLOCK, WIDE_BLOCK = 512, 256
_DRAW = np.random.default_rng(20240229)
_MOST = np.iinfo(np.int64).max
_XOR = _DRAW.integers(0, 2**32, VALUES, dtype=np.uint32)
_MUL = _DRAW.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def chance(similarity, depth: int, trees: int = TREES):
    """Probability that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def least_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The depth that meets a pair at the threshold with this probability."""
    depth = DEPTH
    while depth > 1 and chance(threshold, depth) < recall:
        depth -= 1
    return depth


def prefix_depth(found: list[tuple[int, float, int]], threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Shorten the prefix from full depth while a band's expected recall is short.

    ``found``: (depth at which pairs met, estimated similarity, number of pairs).
    """
    floor = least_depth(threshold, recall)
    for depth in range(DEPTH, floor, -1):
        bands: dict[int, list[float]] = {}
        for met, similarity, n in found:
            if similarity >= threshold:
                # A band whose links have only met at shorter prefixes is known to be missed at this one.
                band = bands.setdefault(int((similarity - threshold) / BAND), [0.0, 0.0])
                if met >= depth:
                    band[0] += n
                    band[1] += n / float(chance(similarity, depth))
        if bands and all(hit and hit / all_of >= recall for hit, all_of in bands.values()):
            return depth
    return floor


def shingles(words: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts laid end to end, and their offsets. Repeated shingles stay."""
    size = np.diff(wo)
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(len(wo), np.int64)
    count = np.where(size >= SHINGLE, size - SHINGLE + 1, (size > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(at[-1], np.uint64)
    places = np.repeat(wo[:-1] - at[:-1], count) + np.arange(at[-1])
    full = np.repeat(size >= SHINGLE, count)
    out[full] = gram_hashes_at(words, places[full], SHINGLE)
    for n in range(1, SHINGLE):
        short = np.repeat(size == n, count)
        if short.any():
            out[short] = mixed(gram_hashes_at(words, places[short], n) + np.uint64(n))
    return out, at


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash signatures, one row a text (texts without shingles: all ones)."""
    out = np.full((len(at) - 1, TREES * DEPTH), 0xFFFFFFFF, np.uint32)
    has = np.flatnonzero(np.diff(at))
    if len(has):
        x, starts = (values >> np.uint64(32)).astype(np.uint32), at[:-1][has]
        for i in range(TREES * DEPTH):
            out[has, i] = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], starts)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text hash, text) to (doc_id, text hash, node, signature); node is null without words."""
    for batch in batches:
        for at, to, raw, off in text_slices(batch, 2):
            words, _, _, wo = words_of(raw, off)
            made = (signatures(*shingles(words, wo)) & np.uint32(255)).astype(np.uint8)
            own = words.tobytes()
            node = [int.from_bytes(hashlib.blake2b(own[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True) if b > a else None for a, b in zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True)]
            parts = [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(node, pa.int64()), pa.array([r.tobytes() for r in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(parts, names=["doc_id", "hash", "node", "signature"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, signature) to the trie entries (tree, signature row as a number, node) of every tree."""
    for batch in batches:
        rows, node = _matrix(batch.column(1)).view(">u8").astype(np.uint64), batch.column(0)
        for tree in range(TREES):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), tree, np.int32)), pa.array(rows[:, tree].view(np.int64)), node], names=["tree", "row", "node"])


def common_prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values that signature rows have in common from the first on."""
    apart = x ^ y
    return sum((apart < np.uint64(1 << (64 - 8 * k))).astype(np.int32) for k in range(1, DEPTH)) + (apart == 0)


_SCAN = "kind int, a bigint, b bigint, depth int, tree int, row bigint"


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries to ties of neighbours (kind 0: a, b, depth), entries with a tie (kind 1: tree, row, a), and the partition's first and last entry (kinds 2, 3; b: partition)."""
    floor, place = least_depth(), TaskContext.get().partitionId()

    def table(kind, n, a, b=None, depth=None, tree=None, row=None):
        whole = [np.full(n, kind, np.int32), a, b, depth, tree, row]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(whole, kinds, strict=True)], names=["kind", "a", "b", "depth", "tree", "row"])

    last, last_tied = None, True  # an entry at the edge may be tied to the next partition's
    for batch in batches:
        tree, row, node = (batch.column(i).to_numpy() for i in range(3))
        if not len(node):
            continue
        if last is None:
            yield table(2, 1, node[:1], [place], None, tree[:1], row[:1])
        else:
            tree, row, node = (np.concatenate(([x], y)) for x, y in zip(last, (tree, row, node), strict=True))
        bits = row.view(np.uint64)
        depth = np.where(tree[1:] == tree[:-1], common_prefix(bits[1:], bits[:-1]), 0)
        hit = depth >= floor
        pairs = np.flatnonzero(hit & (node[1:] != node[:-1]))
        if len(pairs):
            yield table(0, len(pairs), np.minimum(node[pairs], node[pairs + 1]), np.maximum(node[pairs], node[pairs + 1]), depth[pairs])
        tied = np.concatenate(([last_tied], hit)) | np.concatenate((hit, [False]))
        at = np.flatnonzero(tied[:-1])
        if len(at):
            yield table(1, len(at), node[at], None, None, tree[at], row[at])
        last, last_tied = (tree[-1], row[-1], node[-1]), bool(tied[-1])
    if last is not None:
        yield table(1, 1, [last[2]], None, None, [last[0]], [last[1]])
        yield table(3, 1, [last[2]], [place], None, [last[0]], [last[1]])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, depth, signatures) to (a, b, depth, number of equal values)."""
    for batch in batches:
        same = (_matrix(batch.column(3)) == _matrix(batch.column(4))).sum(axis=1).astype(np.int32) if batch.num_rows else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(same)], names=["a", "b", "depth", "same"])


def similarity(same):
    """Estimate from the number of equal values; different shingles' bytes agree once in 256 times."""
    return (np.asarray(same, float) / VALUES - 1 / 256) / (1 - 1 / 256)


_LEAST_SAME = next(n for n in range(VALUES + 1) if similarity(n) >= LEAST_ESTIMATE)


def _least_linked(nodes: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Least node reachable by links, for each of the nodes."""
    label = nodes.copy()
    while True:
        best = np.minimum(label, np.where(hit, label[None, :], _MOST).min(axis=1))
        if (best == label).all():
            return label
        label = best


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tree, prefix, x, y) with node, root and signature to ties (a, b) between different roots whose estimate isn't below the threshold."""

    def group(rows):
        nodes, roots = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, VALUES)
        hit = np.zeros((len(rows), len(rows)), bool)
        kinds, times = np.unique(roots, return_counts=True)
        # Of the largest neighbourhood's rows only those with others count.
        for i in np.flatnonzero(roots != kinds[times.argmax()]):
            hit[i] = hit[:, i] = ((sig == sig[i]).sum(axis=1) >= _LEAST_SAME) & (roots != roots[i])
        some = np.flatnonzero(hit.any(axis=1))
        if len(some):
            tie = _least_linked(nodes[some], hit[np.ix_(some, some)])
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(tie)], names=["a", "b"])

    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if row[:4] != key:
                if rows:
                    yield from group(rows)
                key, rows = row[:4], []
            rows.append(row[3:])
    if rows:
        yield from group(rows)


def neighbourhoods(classes: DataFrame) -> DataFrame:
    """(node, signature) of classes to (node, root): similar classes have one root; classes without any have no row."""
    forest = classes.select("node", "signature").mapInArrow(_entries, "tree int, row bigint, node bigint")
    forest = forest.repartitionByRange("tree", "row", "node").sortWithinPartitions("tree", "row", "node")
    scan = materialise(forest.mapInArrow(_ties, _SCAN))
    # Ties across the edges of partitions; there is one row a partition.
    ends = scan.where("kind >= 2").groupBy(F.col("b").alias("place")).agg(*[F.max(F.when(F.col("kind") == k, F.struct("tree", "row", "a"))).alias(n) for k, n in ((2, "first"), (3, "last"))])
    ends = ends.withColumn("next", F.lead("first").over(Window.orderBy("place"))).where("next.tree = last.tree")
    shared = F.lit(0)
    for k in range(1, DEPTH + 1):
        shared = shared + (F.shiftrightunsigned("last.row", 64 - 8 * k) == F.shiftrightunsigned("next.row", 64 - 8 * k)).cast("int")
    ends = ends.select(F.least("last.a", "next.a").alias("a"), F.greatest("last.a", "next.a").alias("b"), shared.alias("depth")).where(f"a <> b AND depth >= {least_depth()}")
    ties = scan.where("kind = 0").select("a", "b", "depth").union(ends).groupBy("a", "b").agg(F.max("depth").alias("depth"))
    of = lambda side: classes.select(F.col("node").alias(side), F.col("signature").alias(f"s{side}"))
    both = ties.join(of("a"), "a").join(of("b"), "b").select("a", "b", "depth", "sa", "sb")
    ties = materialise(both.mapInArrow(_estimated, "a bigint, b bigint, depth int, same int").where(F.col("same") >= _LEAST_SAME))
    # At most a row for each depth and number of equal values.
    found = [(r["depth"], float(similarity(r["same"])), r["n"]) for r in ties.groupBy("depth", "same").agg(F.count(F.lit(1)).alias("n")).collect()]
    depth = prefix_depth(found)
    near = components(ties.where(F.col("depth") >= depth).select("a", "b"))
    # Prefixes with three classes or more, not all in one neighbourhood.
    below = scan.where("kind = 1").select("tree", F.shiftrightunsigned("row", 64 - 8 * depth).alias("prefix"), F.col("a").alias("node")).distinct()
    below = below.join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = below.groupBy("tree", "prefix", "root").agg(F.count(F.lit(1)).alias("own"))
    crowd = roots.groupBy("tree", "prefix").agg(F.sum("own").alias("n"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("own", "root")).alias("most")).where("n > 2 AND roots > 1")
    crowd = materialise(below.join(crowd.select("tree", "prefix", "n", "most"), ["tree", "prefix"]))
    # Where one neighbourhood outweighs the others, its classes go out once, in blocks, and the few others meet each block; else
    # all pairs of blocks meet.
    few = F.col("n") - F.col("most.own") <= WIDE_BLOCK
    blocks = F.ceil(F.when(few, F.col("most.own")).otherwise(F.col("n")) / WIDE_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("bigint")).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    crowd = crowd.withColumn("own", own).withColumn("other", F.explode(F.when(few & (F.col("root") == F.col("most.root")), F.array(own)).otherwise(every)))
    x, y = F.when(few, F.col("other")).otherwise(F.least("own", "other")), F.when(few, F.col("other")).otherwise(F.greatest("own", "other"))
    crowd = crowd.select("tree", "prefix", x.alias("x"), y.alias("y"), "node", "root").join(classes.select("node", "signature"), "node")
    crowd = crowd.select("tree", "prefix", "x", "y", "node", "root", "signature").repartition("tree", "prefix", "x", "y").sortWithinPartitions("tree", "prefix", "x", "y")
    more = materialise(crowd.mapInArrow(_across, "a bigint, b bigint"))
    return near if more.isEmpty() else components(near.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, block, blocks, node, text) to a row for every pair of blocks that the class is in, with its sorted shingle set."""
    names = ["root", "x", "y", "side", "node", "set"]
    for batch in batches:
        for at, to, raw, off in text_slices(batch, 4):
            words, _, _, wo = words_of(raw, off)
            values, vo = shingles(words, wo)
            sets = [np.unique(values[a:b]).tobytes() for a, b in zip(vo[:-1], vo[1:], strict=True)]
            root, own, blocks, node = (batch.column(i).slice(at, to - at).to_pylist() for i in range(4))
            # A large neighbourhood's sets go out in parts, so that its copies don't lie in memory together.
            for lo in range(0, max(blocks), 8):
                rows = [(r, min(b, o), max(b, o), int(b > o), v, s) for r, b, n, v, s in zip(root, own, blocks, node, sets, strict=True) for o in range(lo, min(lo + 8, n))]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common members of all sets of either side, by products over the shared vocabulary."""
    values = [np.concatenate(side) if side else np.empty(0, np.uint64) for side in (left, right)]
    shared = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    if left is right and len(shared):
        kinds, times = np.unique(values[0], return_counts=True)
        shared = kinds[times > 1]
    out = np.zeros((len(left), len(right)), np.float32)
    ends = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    columns = []
    for v, rows in zip(values, ends, strict=True):
        at = np.searchsorted(shared, v)
        at[at == len(shared)] = 0
        ok = shared[at] == v if len(shared) else np.zeros(len(v), bool)
        order = np.argsort(at[ok], kind="stable")
        columns.append((at[ok][order], rows[ok][order]))
    step = 2048
    for lo in range(0, len(shared), step):
        halves = []
        for (at, rows), side in zip(columns, (left, right), strict=True):
            i, j = np.searchsorted(at, [lo, lo + step])
            m = np.zeros((len(side), min(step, len(shared) - lo)), np.float32)
            m[rows[i:j], at[i:j] - lo] = 1
            halves.append(m)
        out += halves[0] @ halves[1].T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs reach the threshold: common >= threshold * union, in whole numbers."""
    if left is right and len(left) == 2:
        a, b = left
        n = len(np.intersect1d(a, b, assume_unique=True))
        hit = 10 * n >= round(10 * THRESHOLD) * (len(a) + len(b) - n)
        return np.array([[False, hit], [hit, False]])
    n = _common(left, right).astype(np.int64)
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    hit = 10 * n >= round(10 * THRESHOLD) * (sizes[0][:, None] + sizes[1][None, :] - n)
    if left is right:
        np.fill_diagonal(hit, False)
    return hit


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, x, y) to (node, links, least connected node) for each linked class of each block pair."""

    def group(rows):
        left, right = [r for r in rows if not r[0]], [r for r in rows if r[0]]
        sets = [[np.frombuffer(r[2], np.uint64) for r in side] for side in (left, right)]
        nodes = np.array([r[1] for r in left + right], np.int64)
        n = len(left)
        if not rows[0][3]:
            hit = _linked(sets[0], sets[0])
        elif left and right:
            across = _linked(sets[0], sets[1])
            hit = np.zeros((len(nodes), len(nodes)), bool)
            hit[:n, n:], hit[n:, :n] = across, across.T
        else:
            return
        some = np.flatnonzero(hit.any(axis=1))
        if len(some):
            links = hit[some].sum(axis=1).astype(np.int64)
            tie = _least_linked(nodes[some], hit[np.ix_(some, some)])
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links), pa.array(tie)], names=["node", "links", "tie"])

    key, rows, seen = None, [], set()
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(6)]
        for root, x, y, side, node, data in zip(*cols, strict=True):
            if (root, x, y) != key:
                if rows:
                    yield from group(rows)
                key, rows, seen = (root, x, y), [], set()
            if node not in seen:
                seen.add(node)
                rows.append((side, node, data, x != y))
    if rows:
        yield from group(rows)


def link_classes(documents: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), node (class of equal words), root (its group), class_id, n_links and n_copies of every row.

    ``class_id`` is the least id of the texts connected by links, ``n_links`` the number of other texts
    (classes) with similarity of the threshold or more, ``n_copies`` the number of rows of the class.
    """
    texts = documents.select("doc_id", F.xxhash64(plain_text()).alias("hash"), plain_text().alias("text"))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    signed = materialise(texts.mapInArrow(_sign, f"doc_id {id_type}, hash bigint, node bigint, signature binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    classes = signed.where("node IS NOT NULL").groupBy("node").agg(first.alias("first"), F.count(F.lit(1)).alias("n_copies"), F.first("signature").alias("signature"))
    classes = materialise(classes.select("node", "first.doc_id", "first.hash", "n_copies", "signature"))
    near = neighbourhoods(classes)
    size = near.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    placed = near.join(size, "root").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    # Blocks are dealt by hash, so that no task has to number the rows of a hot root.
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int"))
    members = placed.join(classes.select("node", F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")), "node")
    held = members.join(texts, texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["hash"] == F.col("_hash")))
    sets = held.select("root", "block", "blocks", "node", "text").mapInArrow(_sets, "root bigint, x int, y int, side int, node bigint, set binary")
    dealt = sets.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    checked = materialise(dealt.mapInArrow(_verify, "node bigint, links bigint, tie bigint"))
    n_links = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    group = components(checked.select(F.col("node").alias("a"), F.col("tie").alias("b")))
    known = classes.select("node", "doc_id", "n_copies").join(group, "node", "left").join(n_links, "node", "left")
    known = materialise(known.select("node", "doc_id", "n_copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")))
    ids = known.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    known = materialise(known.join(ids, "root").select("node", "root", "class_id", "n_links", "n_copies"))
    rows = signed.select("doc_id", "hash", "node").join(known, "node", "left")  # wordless rows have no node
    zero = F.lit(0).cast("bigint")
    return rows.select("doc_id", "hash", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies"))


def jaccard_join(documents: DataFrame) -> DataFrame:
    """op2: doc_id, class_id, n_links and n_copies of every document."""
    return link_classes(documents).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each group of linked texts, that with the least id; texts without words all stay."""
    rows = materialise(link_classes(documents).where("node IS NOT NULL").select("doc_id", "hash", "root"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.hash").alias("_hash"))
    worded = F.col("_text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    rows = documents.select(F.struct(*own_columns(documents)).alias("_doc"), F.col("doc_id").alias("_d"), plain_text().alias("_text")).withColumn("_t", F.xxhash64("_text"))
    kept = rows.where(worded).join(best, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_hash")), "left_semi")
    kept = kept.select("_doc", "_d", "_t").dropDuplicates(["_d", "_t"])
    return kept.select("_doc").union(rows.where(~worded).select("_doc")).select("_doc.*")
