"""Links within buckets and connected components of links; links and labels stay in DataFrames throughout.

``linked`` verifies the members of buckets in cells, blocks of bounded size that one task holds, and gives the components of all similar
pairs that share a bucket. No pairs are emitted: a cell counts the common elements of all its members at once and sends only links that
join two components (fewer than it has members).

Cases: empty buckets and buckets of one member have no links; repeated (key, bucket) rows must be left out by the caller; ties
can't change the components; null keys must be left out by the caller; nulls in edges and loops are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import step, stored


def lows(edges: DataFrame) -> DataFrame:
    """Of each node its least neighbour or itself (m), its least and greatest lower neighbour, and whether it has a higher one. Stored, so that a hot node's links are split in a join with it."""
    lower = F.when(F.col("b") < F.col("a"), F.col("b"))
    return stored(edges.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"), F.min(lower).alias("first"), F.max(lower).alias("last"), F.bool_or(F.col("b") > F.col("a")).alias("higher")), "lows")


@step
def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; the root is the least node of its component. ``edges`` has columns a and b; nulls and loops are left out."""
    now = edges.select("a", "b").where("a <> b")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = lows(both)
        if low.where("first <> last OR (first IS NOT NULL AND higher)").isEmpty():
            # Every node hangs at one lower one, which hangs at none: the roots.
            return low.select(F.col("a").alias("node"), F.col("m").alias("root"))
        # Large star: higher neighbours go to the node's least one. Small star: so do the node and its lower neighbours.
        large = both.join(low.select("a", "m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = lows(large)
        small = large.join(low.select("a", "m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = stored(small.where("a <> b").distinct(), "small")


#: What one block of a cell holds at most on average: members, and elements of their sets. A cell is one block, or two.
BLOCK, BLOCK_ELEMENTS = 256, 1 << 20
#: Members of a cell whose pairs are looked at one by one, and columns of a dense table of members by elements.
FEW, COLUMNS = 6, 4096


def parent(roots: list, x):
    while roots[x] != x:
        x = roots[x]
    return x


def common(owner: np.ndarray, column: np.ndarray, count: np.ndarray, value: np.ndarray | None, n: int) -> np.ndarray:
    """By pair of members (x, y) the number of common elements, or the sum of x's ``value`` of them.

    ``column`` numbers the elements, each of which ``count`` members have. Elements of many members are counted by a product of dense
    tables, a slice of columns at a time; those of few by their pairs of members, a bounded number at a time."""
    out = np.zeros((n, n))
    dense = count > max(2, n // 8)
    number = np.cumsum(dense) - 1
    mine = dense[column]
    o, c, v = owner[mine], number[column[mine]], None if value is None else value[mine]
    order = np.argsort(c, kind="stable")
    o, c, v = o[order], c[order], None if v is None else v[order]
    for k in range(0, int(dense.sum()), COLUMNS):
        i, j = np.searchsorted(c, [k, k + COLUMNS])
        has = np.zeros((n, COLUMNS))
        has[o[i:j], c[i:j] - k] = 1
        own = has
        if v is not None:
            own = np.zeros((n, COLUMNS))
            own[o[i:j], c[i:j] - k] = v[i:j]
        out += own @ has.T
    order = np.argsort(column[~mine], kind="stable")
    o, c, v = owner[~mine][order], column[~mine][order], None if value is None else value[~mine][order]
    begin = np.searchsorted(c, c)
    times = count[c]
    ends = np.cumsum(times)
    flat = out.reshape(-1)
    at = 0
    while at < len(o):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
        t = times[at:stop]
        left = np.repeat(np.arange(at, stop), t)
        right = begin[left] + np.arange(len(left)) - np.repeat(np.cumsum(t) - t, t)
        flat += np.bincount(o[left] * n + o[right], None if v is None else v[left], n * n)
        at = stop
    return out


def forest(elements: list[np.ndarray], weights: list[np.ndarray | None], roots: list, threshold: float) -> list[tuple[int, int]]:
    """Pairs of members with different roots that are similar, by the Jaccard of the sets or by the probability Jaccard of their weights, and join all whom
    such pairs join; none that joins what is joined already. A weight of None is one for each element."""
    n, links = len(elements), []
    if n <= FEW:
        names = {x: x for x in roots}
        sets = [set(x.tolist()) for x in elements]
        for i in range(n):
            for j in range(i):
                a, b = parent(names, roots[i]), parent(names, roots[j])
                if a == b:
                    continue
                both = len(sets[i] & sets[j])
                if both < (threshold - 1e-12) * (len(sets[i]) + len(sets[j]) - both):
                    if (weights[i] is None and weights[j] is None) or not both or not similar(elements, weights, i, j, threshold):
                        continue
                names[a] = b
                links.append((i, j))
        return links
    label = np.unique(np.array(roots, object), return_inverse=True)[1].reshape(-1)
    size = np.array([len(x) for x in elements], float)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    _, column, count = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    heavy = np.array([w is not None for w in weights])
    value = np.concatenate([np.ones(len(x)) if w is None else w for x, w in zip(elements, weights)])[shared] if heavy.any() else None
    total = np.array([len(x) if w is None else float(w.sum()) for x, w in zip(elements, weights)])
    owner, column = owner[shared], column.reshape(-1)[shared]
    both = common(owner, column, count, None, n)
    near = both >= (threshold - 1e-12) * (size[:, None] + size[None, :] - both)
    near &= both > 0

    def join(i: int, others: np.ndarray) -> None:
        for x, k in zip(*np.unique(label[others], return_index=True)):
            links.append((i, int(others[k])))
            label[label == x] = label[i]

    for i in range(n):
        if (others := np.flatnonzero(near[i] & (label != label[i]))).size:
            join(i, others)
    if value is not None:
        # The probability Jaccard is at most the weight that either side has in common.
        part = common(owner, column, count, value, n) / np.maximum(total, 1)[:, None]
        maybe = (np.minimum(part, part.T) >= threshold - 1e-9) & (heavy[:, None] | heavy[None, :]) & ~near
        for i, j in zip(*np.nonzero(np.tril(maybe, -1))):
            if label[i] != label[j] and similar(elements, weights, i, j, threshold):
                join(int(i), np.array([j]))
    return links


def similar(elements: list[np.ndarray], weights: list[np.ndarray | None], i: int, j: int, threshold: float) -> bool:
    x, y = ((elements[k], np.ones(len(elements[k]), np.int64) if weights[k] is None else weights[k]) for k in (i, j))
    return max(S.similarity(x, y)) >= threshold - 1e-12


def in_cells(rows: DataFrame, cell: list[str], threshold: float, width: int) -> DataFrame:
    """(a, b): roots joined by links between members of one cell. ``rows`` has the columns of ``cell``, key, root, elements and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, out = None, []

        def flush():
            if len({x[0] for x in held}) > 1:
                elements = [np.frombuffer(x[1], f"<u{width}") for x in held]
                weights = [None if x[2] is None else np.frombuffer(x[2], "<i8") for x in held]
                out.extend((held[i][0], held[j][0]) for i, j in forest(elements, weights, [x[0] for x in held], threshold))
            held.clear()

        for b in batches:
            where = list(zip(*(b.column(c).to_pylist() for c in cell)))
            for at, *member in zip(where, *(b.column(c).to_pylist() for c in ("root", "elements", "weights"))):
                if at != last:
                    flush()
                    last = at
                held.append(tuple(member))
            if len(out) > 4096:
                yield edges(out)
                out = []
        flush()
        yield edges(out)

    def edges(pairs: list[tuple]) -> pa.RecordBatch:
        low_high = [(min(x), max(x)) for x in pairs]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in low_high], pa.binary()) for k in (0, 1)], names=["a", "b"])

    dealt = rows.select(*cell, "root", "elements", "weights").repartition(*cell).sortWithinPartitions(*cell)
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def blocks(count: str, elements: str) -> Column:
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(elements) / BLOCK_ELEMENTS)).cast("int")


def bucketed(buckets: DataFrame) -> DataFrame:
    """(key, size, bucket, n_blocks) of the members of buckets of two or more; of buckets with the same members one stays."""
    seen = F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("s"), *seen).where("n > 1")
    kept = sizes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.max("s").alias("s"))
    kept = stored(kept.select("bucket", blocks("n", "s").alias("n_blocks")), "buckets")
    return stored(buckets.join(kept, "bucket").select("key", "size", "bucket", "n_blocks"), "members")


def first_cells(members: DataFrame) -> DataFrame:
    """(key, cells) of the members: the bucket and the block in it of each membership, of which a key has at most as many as bands."""
    block = F.pmod(F.xxhash64("key", "bucket"), F.col("n_blocks").cast("long"))
    return members.groupBy("key").agg(F.collect_list(F.struct("bucket", block.alias("block"))).alias("cells"))


def with_cells(cells: DataFrame, contents: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, elements, weights, bucket, block) of the members in each of their cells."""
    sets = contents(cells)
    if "cells" not in sets.columns:
        sets = sets.join(cells, "key")
    return sets.select("key", "elements", "weights", F.inline("cells"))


def rooted(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """``keys`` with the root of each key's component; a key without links is its own."""
    of = labels.select(F.col("node").alias("key"), F.col("root").alias("_root"))
    return keys.join(of, "key", "left").withColumn("root", F.coalesce("_root", "key")).drop("_root")


#: Slots of the counts by which elements are ordered, and rows of a prefix that count as one row with a set beside it.
SLOTS, PREFIX_ROWS = 1 << 18, 4


def by_prefix(hot: DataFrame, threshold: float) -> DataFrame:
    """(bucket, by_prefix) of the buckets with several components: whether their members are dealt by the elements of their prefixes, which are a share of their sets, and not by pairs of
    blocks, whose number grows with the bucket. A member so has a bounded number of rows: of its prefix, or of few more blocks."""
    parts = hot.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    of = parts.groupBy("bucket").agg(F.max(F.struct("n", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k")).where("k > 1")
    of = of.select("bucket", "n", "s", F.col("top.n").alias("n_top"), F.col("top.s").alias("s_top"), (F.col("n") - F.col("top.n")).alias("n_rest"), (F.col("s") - F.col("top.s")).alias("s_rest"))
    tops, rests = blocks("n_top", "s_top"), blocks("n_rest", "s_rest")
    cells = F.col("n_top") * rests + F.col("n_rest") * (tops + rests - 1)
    return stored(of.select("bucket", ((1 - threshold) * F.col("s") + F.col("n") <= PREFIX_ROWS * cells).alias("by_prefix")), "choice")


def slots(x: np.ndarray) -> np.ndarray:
    return (S.mix(x.astype(S.U)) % S.U(SLOTS)).astype(np.int64)


def slot_counts(sets: DataFrame, width: int) -> np.ndarray:
    """How many sets have an element of each slot: tasks count their own, so the elements are not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(SLOTS, np.int64)
        for b in batches:
            for x in b.column("elements").to_pylist():
                np.add.at(out, slots(np.frombuffer(x, f"<u{width}")), 1)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["slot", "n"])

    found = sets.select("elements").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def prefix(x: np.ndarray, w: np.ndarray | None, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The first elements of a set, rare ones first by ``counts``, so many that what is left is under the threshold's share of the set and of its weight.

    Similar sets have at least that share of either in common, and prefixes of one order that share no element leave all common elements to what
    is left of one of the sets; so similar sets share an element of their prefixes, whatever the counts."""
    order = np.lexsort((x, counts[slots(x)]))
    left = len(x) - 1 - np.arange(len(x)) >= (threshold - 1e-9) * len(x)
    if w is not None and len(w):
        sums = np.cumsum(w[order])
        left |= sums[-1] - sums >= (threshold - 1e-9) * sums[-1]
    return x[order[: int(left.sum()) + 1]]


def dealt_by_prefix(hot: DataFrame, sets: DataFrame, threshold: float, width: int) -> DataFrame:
    """(key, size, bucket, element, root) of members of buckets for each element of their prefixes."""
    names = ["key", "size", "bucket", "root"]
    counts = hot.sparkSession.sparkContext.broadcast(slot_counts(sets.join(hot.select("key").distinct(), "key", "left_semi"), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = [prefix(np.frombuffer(x, f"<u{width}"), None if w is None else np.frombuffer(w, "<i8"), counts.value, threshold) for x, w in zip(b.column("elements").to_pylist(), b.column("weights").to_pylist())]
            take = pa.array(np.repeat(np.arange(len(of)), [len(x) for x in of]))
            element = np.concatenate([np.zeros(0, f"<u{width}"), *of]).astype(S.U).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(take) for n in names), pa.array(element)], names=[*names, "element"])

    kinds = ", ".join(f"{n} {hot.schema[n].dataType.simpleString()}" for n in names)
    return hot.select(*names).join(sets, "key").select(*names, "elements", "weights").mapInArrow(run, f"{kinds}, element long")


def block_pairs(hot: DataFrame, by: list[str]) -> DataFrame:
    """Each member of the buckets (key, size, root and the columns ``by`` that name a bucket) in the cells of two blocks (i, j) that together hold all pairs of members with different roots.

    The members of a bucket's largest component are dealt into blocks of their own, which meet all other blocks but not each other."""
    parts = hot.groupBy(*by, "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    of = parts.groupBy(*by).agg(F.max(F.struct("n", "s", "root")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k")).where("k > 1")
    of = of.select(*by, F.col("top.root").alias("top"), F.col("top.n").alias("n_top"), F.col("top.s").alias("s_top"), (F.col("n") - F.col("top.n")).alias("n_rest"), (F.col("s") - F.col("top.s")).alias("s_rest"))
    of = stored(of.select(*by, "top", blocks("n_top", "s_top").alias("tops"), blocks("n_rest", "s_rest").alias("rests")), "hot")
    both = hot.join(of, by).withColumn("is_top", F.col("root") == F.col("top"))
    both = both.withColumn("block", F.pmod(F.xxhash64("key", *by, F.lit(2)), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rests")).cast("long")).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_tops = F.transform(upto("tops"), lambda g: F.struct(F.col("block").alias("i"), (g + F.col("rests")).alias("j")))
    # A block's own pairs are looked at with those of the largest component.
    with_rests = F.transform(F.filter(upto("rests"), lambda r: r != F.col("block")), lambda r: F.struct(F.least("block", r).alias("i"), F.greatest("block", r).alias("j")))
    of_top = F.transform(upto("rests"), lambda r: F.struct(r.alias("i"), (F.col("block") + F.col("rests")).alias("j")))
    cells = F.when(F.col("is_top"), of_top).otherwise(F.concat(with_tops, with_rests))
    return both.select("key", "root", *by, F.explode(cells).alias("c")).select("key", "root", *by, "c.i", "c.j")


@step
def linked(buckets: DataFrame, contents: Callable[[DataFrame], DataFrame], *, threshold: float = S.THRESHOLD, width: int = 8) -> DataFrame:
    """(node, root) of the components of all similar pairs of keys that share a bucket; keys without links may be left out.

    ``buckets`` has distinct (key, bucket) and the size of the key's set; ``contents`` gives (key, elements, weights) of wanted keys, each
    once: the sorted distinct elements as unsigned integers of ``width`` bytes and their weights as 64-bit ones (null where all are one).
    If it carries the other columns of the wanted keys along, the sets go to their cells from the tasks that make them: they are neither stored nor
    shuffled by key. It is asked again for the members of large buckets that still have several components; only those sets are stored.

    First every bucket, in blocks where it is large, is verified inside its blocks, so each membership is sent once. That finds the components
    of all buckets of one block, and nearly all links of the large ones. Then the blocks of those large buckets that still have members of
    several components meet, but for members of one component. Where pairs of blocks would be many, members meet by the elements of their prefixes
    instead, of which similar sets share one. So any two similar members of a bucket are verified or in one component. The rows sent for a member are
    bounded by its prefix, but where an element of the prefixes is itself in several blocks of strangers, whose blocks meet."""
    members = bucketed(buckets)
    first = with_cells(stored(first_cells(members), "cells"), contents).withColumn("root", F.col("key"))
    links = stored(in_cells(first, ["bucket", "block"], threshold, width), "links")
    labels = components(links)
    large = members.where("n_blocks > 1").select("key", "size", "bucket")
    if large.isEmpty():
        return labels
    hot = stored(rooted(large, labels), "large")
    hot = stored(hot.join(by_prefix(hot, threshold), "bucket"), "several")
    if hot.isEmpty():
        return labels
    sets = stored(contents(stored(hot.select("key").distinct(), "keys")), "sets")
    links = in_cells(block_pairs(hot.where("NOT by_prefix"), ["bucket"]).join(sets, "key"), ["bucket", "i", "j"], threshold, width)
    if not (rare := hot.where("by_prefix")).isEmpty():
        rare = stored(dealt_by_prefix(rare, sets, threshold, width), "prefixes")
        links = links.union(in_cells(block_pairs(rare, ["bucket", "element"]).join(sets, "key"), ["bucket", "element", "i", "j"], threshold, width))
    more = stored(links, "more")
    if more.isEmpty():
        return labels
    joined = components(more).select(F.col("node").alias("root"), F.col("root").alias("last"))
    # Keys without links in the first step are their own roots.
    alone = joined.join(labels, joined["root"] == labels["node"], "left_anti").select(F.col("root").alias("node"), F.col("last").alias("root"))
    return labels.join(joined, "root", "left").select("node", F.coalesce("last", "root").alias("root")).union(alone)
