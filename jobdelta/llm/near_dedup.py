"""Near-duplicates by an LSH forest.

Texts with equal shingle sets form a class, and each class takes part once. Every tree of the forest is an order of
the classes by a label of its own, a row of MinHash values: ranges are sorted side by side, and each class is told
apart from the one before it by their longest common prefix. A run of classes that share a prefix is a region.

1. Each class is checked against two others: the neighbour with which it shares the longest prefixes, added up over the
   orders, and the first class of its regions. The depth of a region is adapted: where more than CROWDED classes share
   the least prefix, longer ones are taken, until no more do or the labels end. What links becomes components.
2. Regions of the least depth that still hold several components compare classes of different components by long
   sketches, without writing the pairs down: first only as many likely links as would join the components, one per
   component at most; then, with the components that these make, every pair that the sketches do not rule out.

Step 2 goes back to the least depth, so a longer prefix loses no link. Crowded regions are split into blocks there, and
all blocks meet whose set sizes allow the similarity. Every link is confirmed on the full sets. A pair at the
threshold shares no region of 16 trees at depth 3 with a chance of 0.0002, and less the more alike it is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobdelta.llm.common import bytes_of, mixed, sized, texts_of, written
from jobdelta.llm.components import components
from jobdelta.llm.shingles import shingle_sets

PERCENT = 75  # intersection of at least so many percent of the union
TREES, DEPTH, LABEL = 16, 3, 8  # orders; values that a region shares at least; values of a label
VALUES = TREES * LABEL  # of a signature
CROWDED = 2048  # rows that one comparison holds about; a region of more is compared block by block, and goes deeper for its first class
SIZE_STEP = 1.001 * 100 / PERCENT  # sets whose sizes are two such steps apart cannot be similar enough; a little more, for rounding
SKETCH = 2048  # bits of a sketch: one of each further MinHash value, which agrees with chance (1 + similarity) / 2
_SHARE = (1 + PERCENT / 100) / 2
_ERROR = (SKETCH * _SHARE * (1 - _SHARE)) ** 0.5
#: Sketches that agree in fewer bits rule the similarity out; in more, they all but prove it: 4.5 standard errors.
LEAST_EQUAL, SURELY_EQUAL = int(SKETCH * _SHARE - 4.5 * _ERROR), int(SKETCH * _SHARE + 4.5 * _ERROR)
BITMAP_BITS = 1 << 25

def _numbers(first: int, n: int) -> np.ndarray:
    return (mixed(np.arange(first, first + n, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def minima(sets: list[np.ndarray], first: int, n: int) -> np.ndarray:
    """MinHash values of each set, which must not be empty, under the hash functions first, first + 1 ...: one row of n unsigned 32-bit numbers."""
    lengths = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    starts = np.cumsum(lengths) - lengths
    keys = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    factors, shifts = _numbers(1 + first, n) | np.uint32(1), _numbers((1 << 40) + first, n)
    out = np.empty((len(sets), n), dtype=np.uint32)
    held, high = np.empty_like(keys), np.empty_like(keys)
    for k in range(n):
        np.multiply(keys, factors[k], out=held)
        np.add(held, shifts[k], out=held)
        # The low bits of a product are its weakest: mix the high ones in before comparing.
        np.right_shift(held, np.uint32(15), out=high)
        np.bitwise_xor(held, high, out=held)
        np.multiply(held, np.uint32(0x2C1B3C6D), out=held)
        out[:, k] = np.minimum.reduceat(held, starts)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    return minima(sets, 0, VALUES)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One bit of each of SKETCH further MinHash values, packed into bytes."""
    return np.packbits((minima(sets, VALUES, SKETCH) >> np.uint32(7)) & np.uint32(1) == 1, axis=1)


def _shingled(batches):
    """Per document: id, set size, 128-bit digest of the set, signature (empty for an empty set)."""
    for big in batches:
        for b in sized(big, "text", 1 << 20):
            sets = shingle_sets(*bytes_of(b.column("text")))
            sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            some = [s for s in sets if len(s)]
            values = signatures(some).astype("<u4") if some else np.zeros((0, VALUES), dtype="<u4")
            it = iter(values)
            a = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
            c = [int(mixed(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array([next(it).tobytes() if n else b"" for n in sizes], pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])


def _bucket(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """Which buckets of ids the nodes fall into: at most BITMAP_BITS bits, however many nodes there are."""

    def run(batches):
        bits = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
        some = False
        for b in batches:
            at = _bucket(b.column(0).to_numpy(zero_copy_only=False), BITMAP_BITS)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            some = some or len(at) > 0
        if some:  # in pages, of which empty ones are left out
            pages = bits.reshape(-1, 4096)
            held = np.flatnonzero(pages.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([pages[p].tobytes() for p in held], pa.binary())], names=["page", "bits"])

    def merge(key: tuple, pdf: "pd.DataFrame") -> "pd.DataFrame":  # noqa: F821
        pdf = pdf.iloc[:1].assign(bits=[np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in pdf["bits"]]).tobytes()])
        return pdf

    out = np.zeros((BITMAP_BITS // 8 // 4096, 4096), dtype=np.uint8)
    for r in nodes.mapInArrow(run, "page long, bits binary").groupBy("page").applyInPandas(merge, "page long, bits binary").collect():
        out[r["page"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, members (the full shingle set), n, sketch of the nodes, and of a few more: a small bitmap picks the rows, no text is shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(nodes))

    def run(batches):
        for big in batches:
            at = _bucket(big.column("doc_id").to_numpy(zero_copy_only=False), BITMAP_BITS)
            asked = (bits.value[at >> 3] >> (at & 7)) & 1
            some = big.filter(pa.array(asked.astype(bool)))
            if some.num_rows:
                for b in sized(some, "text", 1 << 20):
                    own = shingle_sets(*bytes_of(b.column("text")))
                    full = np.asarray([len(x) > 0 for x in own])
                    own = [x for x in own if len(x)]
                    if own:
                        yield pa.RecordBatch.from_arrays(
                            [b.column("doc_id").filter(pa.array(full)), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64()),
                             pa.array([x.tobytes() for x in sketches(own)], pa.binary())], names=["node", "members", "n", "sketch"])

    return written(docs.mapInArrow(run, "node long, members binary, n long, sketch binary"), "near-sets")


def _confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def check(batches):
        for b in (part for big in batches for part in sized(big, "x", 4 << 20)):
            good = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = 0
                if 100 * len(x) >= PERCENT * len(y):
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, other = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return written(written(pairs, "near-pairs").join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "near-links")


def _label(tree: int, depth: int) -> "Column":  # noqa: F821
    """The first values of a signature's label in one tree."""
    return F.substring("signature", 4 * LABEL * tree + 1, 4 * depth)


def _region(depth: int) -> "Column":  # noqa: F821
    return F.xxhash64("tree", F.substring("label", 1, 4 * depth))


def _common(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many values two rows of (tree, label) have in common from the first on; none in different trees."""
    return np.cumprod(one == other, axis=1).sum(axis=1) - 1


def _neighbours(batches):
    """Of the sorted rows (tree, label, node) of one range those that share a region with the row before or after them.

    `before` is that row's node and `common` the length of the prefix; the first and the last row of a range always
    stay, since their other neighbour is elsewhere, with `common` -1 in the first and `last` in the last.
    """
    part = TaskContext.get().partitionId()
    held, before = None, None  # the last row so far, and what was before it

    def rows_of(b: pa.RecordBatch) -> np.ndarray:
        labels = np.frombuffer(bytes_of(b.column("label"))[0].tobytes(), dtype="<u4").reshape(-1, LABEL)
        return np.c_[b.column("tree").to_numpy(zero_copy_only=False).astype(np.uint32), labels]

    def given(b: pa.RecordBatch, rows: np.ndarray, n: int, last: bool) -> pa.RecordBatch:
        """The first n of the rows, of which one more is known unless the range ends."""
        nonlocal before
        node = b.column("node").to_numpy(zero_copy_only=False)
        step = _common(rows[:-1], rows[1:]) if len(rows) > 1 else np.zeros(0, dtype=np.int64)
        up = np.r_[-1 if before is None else max(0, int(_common(before[0][None], rows[:1])[0])), np.maximum(step, 0)][:n]
        down = np.r_[np.maximum(step, 0), -1][:n]
        above = np.r_[-1 if before is None else before[1], node][:n]
        keep = pa.array((up >= DEPTH) | (down >= DEPTH) | (up < 0) | (down < 0))
        before = (rows[n - 1], node[n - 1])
        ends = np.zeros(n, dtype=bool)
        ends[-1] = last
        own = b.slice(0, n)
        return pa.RecordBatch.from_arrays(
            [own.column("tree"), own.column("label"), own.column("node"), pa.array(up.astype(np.int32)), pa.array(above, mask=up < 0), pa.array(ends),
             pa.array(np.full(n, part, dtype=np.int32))], names=["tree", "label", "node", "common", "before", "last", "part"]).filter(keep)

    for b in batches:
        if b.num_rows:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            held = b.slice(b.num_rows - 1)
            if b.num_rows > 1:
                yield given(b, rows_of(b), b.num_rows - 1, False)
    if held is not None:
        yield given(held, rows_of(held), 1, True)


def _orders(classes: DataFrame) -> DataFrame:
    """tree, label, node, common, before, last, part and region of classes that share a region with others, in every tree's order."""
    spark = classes.sparkSession
    labels = F.array(*[_label(t, LABEL) for t in range(TREES)])
    rows = classes.select("node", F.posexplode(labels).alias("tree", "label")).select("tree", "label", "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node") \
        .mapInArrow(_neighbours, "tree int, label binary, node long, common int, before long, last boolean, part int").withColumn("region", _region(DEPTH))


def _next_to(orders: DataFrame) -> DataFrame:
    """Per class the pair (a, b) with the neighbour that shares the longest prefixes with it, added up over the orders."""
    # The neighbours on both sides of a border between ranges: two rows per range reach the driver.
    ends = orders.filter("common < 0 or last").orderBy("part", "tree", "label", "node").select("part", "tree", "label", "node").collect()
    rows = [np.r_[np.uint32(r["tree"]), np.frombuffer(bytes(r["label"]), dtype="<u4")] for r in ends]
    across = [(x["node"], y["node"], int(_common(u[None], v[None])[0])) for x, y, u, v in zip(ends, ends[1:], rows, rows[1:]) if x["part"] != y["part"]]
    pairs = orders.filter(F.col("common") >= DEPTH).select("before", "node", "common") \
        .union(orders.sparkSession.createDataFrame([p for p in across if p[2] >= DEPTH], "before long, node long, common int"))
    pairs = pairs.groupBy(F.least("before", "node").alias("a"), F.greatest("before", "node").alias("b")).agg(F.sum("common").alias("n")).filter("a < b")
    sides = pairs.select("n", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    best = sides.groupBy("p.b").agg(F.max(F.struct("n", (-F.col("p.a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _first_of(orders: DataFrame) -> DataFrame:
    """Per class the pair (a, b) with the first class of most of its regions, each at the depth where it is not crowded."""
    least = written(orders.groupBy("region").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "near-regions")
    crowded = orders.join(least.filter(F.col("rows") > CROWDED).select("region", F.col("a").alias("whole")), "region")
    deeper = crowded.select("region", "node", "whole", F.posexplode(F.array(*[_region(d) for d in range(DEPTH + 1, LABEL + 1)])).alias("more", "run"))
    runs = deeper.groupBy("more", "run").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # The shortest prefix that is not crowded, else the longest one that is shared, else the region's own.
    big = F.col("rows") > CROWDED
    depth = F.when(F.col("rows").isNotNull(), F.struct(big.alias("big"), F.when(big, -F.col("more")).otherwise(F.col("more")).alias("more"), "a"))
    deep = deeper.join(runs, ["more", "run"], "left").groupBy("region", "node").agg(F.min(depth).alias("d"), F.min("whole").alias("whole")) \
        .select(F.col("node").alias("b"), F.coalesce("d.a", "whole").alias("a"))
    plain = orders.join(least.filter(F.col("rows") <= CROWDED).select("region", "a"), "region").select(F.col("node").alias("b"), "a")
    shared = plain.unionByName(deep).filter("a < b").groupBy("b", "a").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")


def _mixed(orders: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of regions that hold several parts, with their part, keys (of the class's regions in all trees) and `rows`, how many the region has."""
    placed = orders.select("region", "tree", "node").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    several = placed.groupBy("region").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low < high")
    keys = classes.select("node", F.array(*[F.hash(_label(t, DEPTH)) for t in range(TREES)]).alias("keys"))
    return placed.join(several.select("region", "rows"), "region").join(keys, "node")


def _compare(rows: list, joining: bool) -> list[tuple[int, int]]:
    """Likely links between the parts of one region's rows (node, part, n, tree, block, keys, sketch).

    `joining`: no more than would join the parts; else all of them, each in the first tree that the two share.
    """
    node, part, n, tree, block, keys, sketch = rows
    order = np.argsort(node, kind="stable")
    node, n, block, keys, sketch = node[order], n[order], block[order], keys[order], sketch[order]
    _, part = np.unique(part[order], return_inverse=True)
    up = np.arange(part.max() + 1)
    one_block = (block == block[0]).all()
    out, best, partner = [], np.zeros(len(node), dtype=np.int64), np.full(len(node), -1)

    def join(i: int, j: int) -> None:
        x, y = up[part[i]], up[part[j]]
        if x != y:
            up[up == y] = x
            out.append((int(node[i]), int(node[j])))

    for i in range(len(node) - 1):
        fits = (up[part[i + 1 :]] != up[part[i]]) & (100 * np.minimum(n[i], n[i + 1 :]) >= PERCENT * np.maximum(n[i], n[i + 1 :]))
        if not one_block:
            fits &= block[i + 1 :] != block[i]
        if not joining and tree:
            fits &= ~(keys[i + 1 :, :tree] == keys[i, :tree]).any(axis=1)
        others = i + 1 + np.flatnonzero(fits)
        if not len(others):
            continue
        equal = SKETCH - np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        likely = equal >= LEAST_EQUAL
        others, equal = others[likely], equal[likely]
        if not joining:
            out += [(int(node[i]), int(node[j])) for j in others]
            continue
        for j in others[equal >= SURELY_EQUAL].tolist():
            join(i, j)
        if len(others):
            k = int(equal.argmax())
            if equal[k] > best[i]:
                best[i], partner[i] = equal[k], others[k]
            better = equal > best[others]
            best[others[better]], partner[others[better]] = equal[better], i
    for i in np.flatnonzero(partner >= 0).tolist():
        join(i, int(partner[i]))
    return out


def _likely(mixed_rows: DataFrame, sets: DataFrame, joining: bool) -> DataFrame:
    """Pairs (a, b) of `_compare` over all regions. A region of more rows than one comparison holds is split into blocks
    by set size and hash, and every two blocks meet whose sizes are alike enough."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.floor(F.log("n") / math.log(SIZE_STEP)).cast("int")
    whole = mixed_rows.filter(F.col("rows") <= CROWDED).withColumns({"block": F.lit(0), "low": F.lit(0), "high": F.lit(0)}) \
        .join(sets.select("node", "n", "sketch"), "node")
    crowded = mixed_rows.filter(F.col("rows") > CROWDED)
    # Per crowded region: into how many blocks the rows of each size are dealt.
    blocks = crowded.select("region", "node").join(sets.select("node", "n"), "node").groupBy("region", size.alias("size")) \
        .agg(F.ceil(F.count(F.lit(1)) / (CROWDED // 2)).cast("int").alias("blocks")) \
        .groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("size", "blocks"))).alias("blocks"))
    number = lambda size, at: F.shiftleft(size, 24) + at
    split = crowded.join(sets.select("node", "n", "sketch"), "node").withColumn("size", size).join(blocks, "region") \
        .withColumn("block", number(F.col("size"), F.pmod(F.xxhash64("node", "n"), F.col("blocks")[F.col("size")]).cast("int"))) \
        .withColumn("other", F.explode(F.flatten(F.transform(
            F.filter(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1), lambda s: F.map_contains_key("blocks", s)),
            lambda s: F.transform(F.sequence(F.lit(0), F.col("blocks")[s] - 1), lambda at: number(s, at)))))) \
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    names = ["region", "low", "high", "node", "part", "n", "tree", "block", "keys", "sketch"]
    rows = whole.select(*names).union(split.select(*names))

    def run(batches):
        def one(b: pa.RecordBatch) -> tuple:
            number = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            keys = np.asarray(b.column("keys").flatten()).reshape(b.num_rows, -1)
            sketch = np.frombuffer(bytes_of(b.column("sketch"))[0].tobytes(), dtype=np.uint64).reshape(b.num_rows, -1)
            return tuple(number(c) for c in ("region", "low", "high")), [number(c) for c in ("node", "part", "n", "tree", "block")] + [keys, sketch]

        def done(pieces: list) -> pa.RecordBatch:
            rows = [np.concatenate([p[k] for p in pieces]) for k in range(7)]
            found = _compare([*rows[:3], int(rows[3][0]), *rows[4:]], joining) if len(rows[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        held, held_key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            key, cols = one(b)
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            for lo, hi in zip(np.r_[0, change], np.r_[change, b.num_rows]):
                own = tuple(int(k[lo]) for k in key)
                if held and own != held_key:
                    yield done(held)
                    held = []
                held_key = own
                held.append([c[lo:hi] for c in cols])
        if held:
            yield done(held)

    dealt = rows.repartition(parts, "region", "low", "high").sortWithinPartitions("region", "low", "high")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs`.

    Words are stretches without blanks, A-Z in lower case; a set holds the distinct shingles of five words, or the
    whole sequence of fewer. A null or empty text, or one of blanks, has an empty set and is linked with nothing.
    A document without an id takes no part: its component is null and it is kept. Rows that repeat an id count as
    one document with all their links. Other columns are ignored; an empty table gives an empty one.
    """
    texts = texts_of(docs)
    table = written(texts.mapInArrow(_shingled, "doc_id long, n_shingles long, set_a long, set_b long, signature binary"), "near-signatures")
    # One row for each distinct set, under its smallest id; copies meet in partial aggregates.
    classes = written(table.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
                      .agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature")), "near-classes")
    orders = written(_orders(classes), "near-orders")
    sets = _sets(texts.filter("doc_id is not null"), orders.select("node").distinct())

    links = _confirmed(sets, _next_to(orders).union(_first_of(orders)).distinct())
    for joining in (True, False):
        parts = written(components(links).select("node", F.col("component").alias("part")), "near-parts")
        across = written(_mixed(orders, classes, parts), "near-across")
        links = links.union(_confirmed(sets, _likely(across, sets, joining)))
    groups = components(links)

    same = ["set_a", "set_b", "n_shingles"]
    of_class = classes.join(groups, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    # Rows with the same id are one document: its component is the smallest of its rows' components.
    rows = table.drop("signature").join(of_class, same, "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
