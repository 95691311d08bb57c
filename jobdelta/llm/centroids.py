"""Centroid clustering of integer vectors over Hilbert-ordered blocks with min/max boxes.

Vectors are range-partitioned along a Hilbert curve and cut into blocks; each block keeps the smallest box around
its vectors (a zone map). Per round a block compares its box with the centroids: a centroid that is farther than
another one in every point of the box cannot be the nearest of any vector in it. The vectors are compared with the
remaining candidates only, exactly, in integers; a block with one candidate adds its stored sums and compares nothing.
Equal vectors are dealt by a second key, so that a very common vector fills many tasks. Nothing but the centroids,
their sums and the range of each component (parameters times parameters) ever reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobdelta.llm.common import binaries, written

DIMENSIONS = 64  # components of a vector that is kept
CENTROIDS = 16
ROUNDS = 3
SCALE = 64  # a component x becomes floor(SCALE * x)
LARGEST = 1 << 27  # components beyond it become it: squared distances of up to 64 components then fit a long
BLOCK = 256  # vectors in a block
BITS = 4  # of each component in the curve's key

_EXACT = 1 << 20  # components up to it are multiplied exactly in doubles
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


# ---- vectors -----------------------------------------------------------------------------------------------


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: little-endian 32-bit components of every vector of exactly `dimensions` finite numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("embedding")
            fits = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(column), dimensions), False))
            b = b.filter(pa.array(fits))
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)  # a null becomes NaN
            whole = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                v = np.floor(scale * x[whole]).clip(-LARGEST, LARGEST).astype("<i4")
            ids = b.column("vec_id").filter(pa.array(whole))
            yield pa.RecordBatch.from_arrays([ids, binaries(v.tobytes(), np.full(len(v), 4 * dimensions))], names=["vec_id", "v"])

    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.mapInArrow(run, "vec_id long, v binary")


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """The rows of a binary column of vectors."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype="<i4").reshape(-1, dimensions)


def _ranges(vectors: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each component."""

    def run(batches):
        lo, hi = np.full(dimensions, LARGEST), np.full(dimensions, -LARGEST)
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"), dimensions)
                lo, hi = np.minimum(lo, v.min(axis=0)), np.maximum(hi, v.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions)), pa.array(lo), pa.array(hi)], names=["axis", "lo", "hi"])

    found = vectors.select("v").mapInArrow(run, "axis long, lo long, hi long").groupBy("axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = sorted(found.collect())  # a row per component
    return np.array([r.lo for r in rows]), np.array([r.hi for r in rows])


# ---- Hilbert order -----------------------------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (a row of coordinates below 2 ** bits) on the Hilbert curve, as bytes that sort like it.

    Coordinates are turned into the curve's transposed index, bit plane by bit plane, for all rows at once: planes
    are reflected and exchanged from the highest down, then Gray-coded.
    """
    x = np.ascontiguousarray(cells.T, dtype=np.uint32)  # a row per axis
    axes, n = x.shape
    for plane in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << plane), np.uint32((1 << plane) - 1)
        for axis in range(axes):
            on = (x[axis] & bit) != 0
            swap = np.where(on, np.uint32(0), (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(on, below, swap)
            x[axis] ^= swap
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(n, dtype=np.uint32)
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint32(1 << plane)) != 0, np.uint32((1 << plane) - 1), np.uint32(0))
    x ^= flip
    planes = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((x[None] >> planes[:, None, None]) & 1).astype(np.uint8).reshape(bits * axes, n).T, axis=1)


def _keyed(vectors: DataFrame, dimensions: int, bits: int) -> DataFrame:
    lo, hi = _ranges(vectors, dimensions)
    width = np.maximum(1, hi - lo + 1)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cells = ((_matrix(b.column("v"), dimensions) - lo) << bits) // width
            keys = hilbert_keys(cells, bits)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), binaries(keys.tobytes(), np.full(len(keys), keys.shape[1]))], names=["vec_id", "v", "key"])

    return vectors.mapInArrow(run, "vec_id long, v binary, key binary")


def blocks_of(vectors: DataFrame, dimensions: int = DIMENSIONS, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """ids, v, lo, hi, total: Hilbert-ordered runs of at most `block` vectors, their box and their componentwise sum."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v, ids = _matrix(b.column("v"), dimensions), b.column("vec_id")
            out = []
            for start in range(0, b.num_rows, block):
                part = v[start : start + block]
                out.append((ids.slice(start, block).to_pylist(), part.tobytes(), part.min(axis=0).tobytes(), part.max(axis=0).tobytes(), part.sum(axis=0, dtype="<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.list_(pa.int64())] + [pa.binary()] * 4)], names=["ids", "v", "lo", "hi", "total"])

    # The id's hash deals equal vectors to many tasks.
    ordered = _keyed(vectors, dimensions, bits).withColumn("salt", F.xxhash64("vec_id", "v")).repartitionByRange("key", "salt").sortWithinPartitions("key", "salt")
    return ordered.drop("salt").mapInArrow(run, "ids array<long>, v binary, lo binary, hi binary, total binary")


# ---- assignment --------------------------------------------------------------------------------------------


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of a box, ascending.

    First by the box's least and greatest distances; then each rest against the one next to the middle: the
    difference of two squared distances is linear in the point, so its least value over the box is exact.
    """
    lo, hi = lo.astype(np.int64), hi.astype(np.int64)
    outside = np.maximum(0, np.maximum(lo - centroids, centroids - hi))
    far = np.maximum(np.abs(centroids - lo), np.abs(centroids - hi))
    at = np.flatnonzero((outside * outside).sum(axis=1) <= (far * far).sum(axis=1).min())
    if len(at) < 2:
        return at
    twice = centroids[at] * 2 - (lo + hi)
    # In Python's integers: these sums may pass a long.
    c = centroids[at[int(np.argmin((twice.astype(np.float64) ** 2).sum(axis=1)))]]
    step = c - centroids[at]
    least = 2 * (step.astype(object) * np.where(step > 0, lo, hi).astype(object)).sum(axis=1) + (centroids[at].astype(object) ** 2).sum(axis=1) - (c.astype(object) ** 2).sum()
    return at[least.astype(object) <= 0]


def nearest(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of each vector of a block."""
    at = candidates(lo, hi, centroids)
    few = centroids[at]
    if max(np.abs(lo).max(), np.abs(hi).max(), np.abs(few).max()) <= _EXACT:
        x, c = v.astype(np.float64), few.astype(np.float64)
        d = ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        d = np.stack([((v.astype(np.int64) - c) ** 2).sum(axis=1) for c in few], axis=1)
    best = d.argmin(axis=1)
    return at[best], d[np.arange(len(v)), best]


def _block_rows(b: pa.RecordBatch, dimensions: int):
    for ids, v, lo, hi, total in zip(*[b.column(c).to_pylist() for c in ("ids", "v", "lo", "hi", "total")]):
        yield ids, np.frombuffer(v, "<i4").reshape(-1, dimensions), np.frombuffer(lo, "<i4"), np.frombuffer(hi, "<i4"), np.frombuffer(total, "<i8")


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dimensions = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            for _, v, lo, hi, total in _block_rows(b, dimensions):
                one = candidates(lo, hi, centroids)
                if len(one) == 1:
                    sums[one[0]] += total
                    counts[one[0]] += len(v)
                    continue
                found, _ = nearest(v, lo, hi, centroids)
                for c in np.unique(found).tolist():
                    own = v[found == c]
                    sums[c] += own.sum(axis=0, dtype=np.int64)
                    counts[c] += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), dimensions)), pa.array(np.tile(np.arange(dimensions), k)), pa.array(sums.ravel()), pa.array(np.repeat(counts, dimensions))],
                                         names=["cluster", "axis", "s", "n"])

    wide = "decimal(38,0)"
    found = blocks.mapInArrow(run, "cluster long, axis long, s long, n long").groupBy("cluster", "axis").agg(
        F.sum(F.col("s").cast(wide)).alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in found.collect():  # a row per centroid and component
        if r.n:
            out[r.cluster, r.axis] = int(r.s) // int(r.n)
    return out


def cluster_vectors(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
                    block: int = BLOCK, bits: int = BITS, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector of (vec_id, embedding).

    Null vectors, vectors of another length and those with a null or non-finite component are left out. Components
    whose integer passes LARGEST become it. Rows that repeat an id or a vector are vectors of their own; a null id
    hashes as the empty text; of equal hashes the smaller vector (as bytes) starts first. With fewer vectors than
    centroids each starts one. Ties go to the smaller number. An empty table gives an empty one. Sums of distances
    beyond a long become the greatest long. Further columns play no part.
    """
    kept = written(integers(vectors, dimensions, scale), "cluster-vectors")
    seeds = kept.select(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256).alias("h"), "v") \
        .orderBy("h", "v").limit(centroids).collect()  # `centroids` rows
    if not seeds:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    at = np.stack([np.frombuffer(bytes(r.v), "<i4").astype(np.int64) for r in seeds])
    blocks = written(blocks_of(kept, dimensions, block, bits), "cluster-blocks")
    for _ in range(rounds):
        at = _moved(blocks, at)

    def assign(batches):
        for b in batches:
            for ids, v, lo, hi, _ in _block_rows(b, dimensions):
                found, d = nearest(v, lo, hi, at)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    out = written(blocks.mapInArrow(assign, "vec_id long, cluster int, distance long"), "cluster-found")
    most = (1 << 63) - 1
    own = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per centroid
    sums = F.array(*[F.lit(min(most, own.get(c, 0))).cast("long") for c in range(len(at))])
    hashes = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in at])
    place = F.col("cluster") + 1
    return out.select("vec_id", "cluster", "distance", F.element_at(sums, place).alias("cluster_inertia"),
                      F.lit(min(most, sum(own.values()))).cast("long").alias("inertia"), F.element_at(hashes, place).alias("centroid_sha256"))


# ---- SQL twin ----------------------------------------------------------------------------------------------


def _oracle() -> str:
    """Plain assignment of every vector to every centroid, with the same integers."""
    steps = [f"""kept as (
  select vec_id, [floor({SCALE} * x::double)::bigint for x in embedding] as v from embeddings
  where len(embedding) = {DIMENSIONS} and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
c0 as (
  select row_number() over (order by sha256('1:' || vec_id)) - 1 as cluster, v from kept
  qualify row_number() over (order by sha256('1:' || vec_id)) <= {CENTROIDS})"""]
    # max of distance and number as one hugeint: the nearest centroid, ties to the smaller number.
    near = "min(list_sum([(k.v[i] - c.v[i]) * (k.v[i] - c.v[i]) for i in range(1, {d} + 1)])::hugeint * 1000 + c.cluster) as m".format(d=DIMENSIONS)
    for r in range(ROUNDS):
        steps.append(f"""a{r} as (select k.vec_id, any_value(k.v) as v, {near} from kept k, c{r} c group by k.vec_id),
m{r} as (
  select cluster, list(q order by axis) as v from (
    select cluster, axis, ((s - ((s % n) + n) % n) // n)::bigint as q from (
      select (m % 1000)::bigint as cluster, axis, sum(v[axis])::hugeint as s, count(*)::hugeint as n
      from a{r}, (select unnest(range(1, {DIMENSIONS} + 1)) as axis) group by all)) group by cluster),
c{r + 1} as (select c.cluster, coalesce(m.v, c.v) as v from c{r} c left join m{r} m using (cluster))""")
    return "with " + ",\n".join(steps) + f""",
last as (select vec_id, (m % 1000)::int as cluster, (m // 1000)::bigint as distance from (
  select k.vec_id, {near} from kept k, c{ROUNDS} c group by k.vec_id))
select l.vec_id, l.cluster, l.distance, (sum(l.distance) over (partition by l.cluster))::bigint as cluster_inertia, (sum(l.distance) over ())::bigint as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from last l join c{ROUNDS} c using (cluster)"""


ORACLE = _oracle()
