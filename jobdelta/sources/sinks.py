"""Snapshot and change tables on shared storage.

A snapshot is a set of buckets, each in a folder of some version, and a table of contents that says which. A write
adds a version with the buckets it touches and then a new table of contents: readers see the old snapshot or the
new one, never a mixture, and a write that dies leaves the old one as it was.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobdelta.session import materialize

#: Postings that one bucket holds, about; a board of more is spread over several.
BUCKET_ROWS = 250_000


class Layout:
    """Where rows are filed, by linear hashing: of `base` * 2 ** level buckets the first `split` are already halved.

    Growing by one bucket halves the next one in order and touches no other. `big` names the boards that are spread
    by key, and over how many parts.
    """

    def __init__(self, base: int, level: int = 0, split: int = 0, big: dict[str, int] | None = None):
        self.base, self.level, self.split, self.big = base, level, split, big or {}

    @property
    def count(self) -> int:
        return self.base * 2**self.level + self.split

    def grown(self, count: int) -> Layout:
        level, split = self.level, self.split
        while self.base * 2**level + split < count:
            room = self.base * 2**level
            if count >= 2 * room:
                level, split = level + 1, 0
            else:
                split = count - room
        return Layout(self.base, level, split, self.big)

    def parent(self, bucket: int, before: Layout) -> int:
        """The bucket of `before` that held the rows of this one."""
        while bucket >= before.count:
            size = self.base
            while size * 2 <= bucket:
                size *= 2
            bucket -= size
        return bucket

    def bucket(self, part: Column) -> Column:
        h = F.when(part == 0, F.xxhash64("resource_id")).otherwise(F.xxhash64("resource_id", part))
        room = self.base * 2**self.level
        near = F.pmod(h, F.lit(room))
        return F.when(near < self.split, F.pmod(h, F.lit(2 * room))).otherwise(near).cast("int")

    def parts(self) -> Column:
        """Over how many parts a row's board is spread."""
        if not self.big:
            return F.lit(1)
        known = F.create_map(*[x for board, n in self.big.items() for x in (F.lit(board), F.lit(n))])  # a board per BUCKET_ROWS rows at most
        return F.coalesce(F.try_element_at(known, F.col("resource_id")), F.lit(1))


def with_bucket(postings: DataFrame, layout: Layout) -> DataFrame:
    part = F.pmod(F.xxhash64("key"), layout.parts()).cast("int") if layout.big and "key" in postings.columns else F.lit(0)
    return postings.withColumn("resource_bucket", layout.bucket(part))


def stored_number(spark: SparkSession, path: str) -> int | None:
    """The number of the snapshot's latest write."""
    contents = _contents(spark, path)
    return None if contents is None else contents["number"]


def _layout(contents: dict) -> Layout:
    return Layout(contents["count"], contents.get("level", 0), contents.get("split", 0), contents.get("big"))


def _contents(spark: SparkSession, path: str) -> dict | None:
    """The latest table of contents: number, count of buckets, and the version of each bucket that has rows."""
    if not _exists(spark, f"{path}/contents"):
        return None
    fs, p = _fs(spark, f"{path}/contents")
    names = [s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith((".", "_"))]
    if not names:
        return None
    last = max(names, key=int)
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/contents/{last}", wholetext=True).collect()))


def _folders(path: str, contents: dict, buckets: list[int] | None = None) -> list[str]:
    return [f"{path}/versions/{v}/resource_bucket={b}" for b, v in sorted(contents["buckets"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]


def read_snapshot(spark: SparkSession, path: str, boards: DataFrame | None = None) -> DataFrame:
    """The current postings; with `boards` (resource_id), only the buckets that hold theirs are read."""
    contents = _contents(spark, path)
    if contents is None:
        raise FileNotFoundError(f"no snapshot at {path}")
    return _read(spark, path, contents, None if boards is None else _touched(boards, _layout(contents)))


def _read(spark: SparkSession, path: str, contents: dict, buckets: list[int] | None) -> DataFrame:
    folders = _folders(path, contents, buckets)
    if not folders:
        return spark.createDataFrame([], contents["schema"])
    return spark.read.schema(contents["schema"]).parquet(*folders)


def _touched(boards: DataFrame, layout: Layout) -> list[int]:
    """The buckets that may hold rows of the boards."""
    each = boards.select("resource_id", F.explode(F.sequence(F.lit(0), layout.parts() - 1)).alias("part"))
    return [r[0] for r in each.select(layout.bucket(F.col("part")).alias("b")).distinct().collect()]  # at most a number per bucket


def write_snapshot(postings: DataFrame, path: str, boards: DataFrame | None = None, buckets: int | None = None, bucket_rows: int = BUCKET_ROWS) -> None:
    """Replace the current snapshot of the boards in the batch and leave the others as they are.

    `boards` (resource_id) lists the checked boards; one without postings is emptied. Only touched buckets are read
    and rewritten, in one job, and a bucket that becomes empty leaves the table of contents. The number of buckets
    follows the rows: it starts by the first write (or as given) and grows with later ones, bucket by bucket in order,
    so that a bucket keeps about `bucket_rows` rows; a board of more is spread over several by key. Readers of an
    older table of contents are not affected.
    """
    spark = postings.sparkSession
    new = postings.drop("resource_bucket")
    checked = (boards if boards is not None else postings).select("resource_id").distinct()
    contents = _contents(spark, path)
    sizes = new.groupBy("resource_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "board-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = {r["resource_id"]: -(-r["n"] // bucket_rows) for r in sizes.filter(F.col("n") > bucket_rows).collect()} if "key" in new.columns else {}
    if contents is None:
        contents = {"number": -1, "count": buckets or max(1, -(-total // bucket_rows)), "buckets": {}, "rows": {}, "schema": _ddl(new)}
    elif set(contents["schema"].split(",")) != set(_ddl(new).split(",")):
        new = _read(spark, path, contents, []).unionByName(new, allowMissingColumns=True)
        contents["schema"] = _ddl(new)
    number, before = contents["number"] + 1, _layout(contents)
    rows = {int(b): n for b, n in contents.get("rows", {}).items()}
    left = sum(n for b, n in rows.items() if b not in set(_touched(checked, before))) if rows else 0
    # Boards that were big stay spread until they are checked and found small.
    still = _unchecked(before.big, checked)
    after = Layout(before.base, before.level, before.split, still | large).grown(-(-(left + total) // bucket_rows))
    moved = {after.parent(b, before) for b in range(before.count, after.count)}
    old_buckets = set(_touched(checked, before)) | moved | {b for b in _touched(checked, after) if b < before.count}
    old = _read(spark, path, contents, sorted(old_buckets))
    whole = old.join(checked, "resource_id", "left_anti").unionByName(new, allowMissingColumns=True)
    version = f"{path}/versions/{number}"
    # A task per bucket; big buckets become several files of a bounded number of rows.
    filed = with_bucket(whole, after)
    filed.repartition(max(1, min(after.count, 2 * len(old_buckets) + after.count - before.count)), "resource_bucket").write.mode("overwrite") \
        .option("maxRecordsPerFile", bucket_rows).partitionBy("resource_bucket").parquet(version)
    fs, p = _fs(spark, version)
    written = [s.getPath().getName().split("=")[1] for s in fs.listStatus(p) if s.getPath().getName().startswith("resource_bucket=")]
    held = {str(b): v for b, v in contents["buckets"].items() if int(b) not in old_buckets} | {b: number for b in written}
    counted = spark.read.parquet(version).groupBy("resource_bucket").count().collect() if written else []  # a row per bucket, from the files' footers
    kept = {str(b): n for b, n in rows.items() if str(b) in held} | {str(r["resource_bucket"]): r["count"] for r in counted}
    _put(spark, f"{path}/contents/{number}", json.dumps({"number": number, "count": after.base, "level": after.level, "split": after.split, "big": after.big,
                                                         "buckets": held, "rows": kept, "schema": contents["schema"]}))


def _unchecked(big: dict[str, int], checked: DataFrame) -> dict[str, int]:
    if not big:
        return {}
    seen = {r[0] for r in checked.filter(F.col("resource_id").isin(list(big))).collect()}
    return {b: n for b, n in big.items() if b not in seen}


def _ddl(df: DataFrame) -> str:
    return df._jdf.schema().toDDL()


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written aside, then renamed."""
    fs, p = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{path.rsplit('/', 1)[1]}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(aside, p)


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the folders of versions that none of the last `keep` tables of contents names."""
    fs, p = _fs(spark, f"{path}/contents")
    numbers = sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())
    needed: set[str] = set()
    for n in numbers[-keep:]:
        text = "".join(r[0] for r in spark.read.text(f"{path}/contents/{n}", wholetext=True).collect())
        needed |= {str(v) for v in json.loads(text)["buckets"].values()}
    for n in numbers[:-keep]:
        _delete(spark, f"{path}/contents/{n}")
    fs, p = _fs(spark, f"{path}/versions")
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name not in needed and (not name.isdigit() or int(name) <= numbers[-1]):
            _delete(spark, f"{path}/versions/{name}")


def write_changes(changes: DataFrame, path: str, detected_at, mode: str = "append") -> None:
    """Write change events, partitioned by the day they were detected."""
    changes.withColumns({"detected_at": detected_at, "detected_day": F.to_date(detected_at)}) \
        .write.mode(mode).partitionBy("detected_day").parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)
