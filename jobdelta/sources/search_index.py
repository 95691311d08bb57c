"""An inverted index of open postings on shared storage.

An index is a list of immutable segments. A segment has *lists* (anchor, sorted posting numbers, in pieces of
bounded length), *docs* (the postings, in blocks of neighbouring numbers) and *gone* (keys that it takes out of the
segments before it). A search reads the lists of its own anchors, intersects them, and reads the blocks of the
postings that are left; these alone are tested exactly. An update writes one segment; small segments at the end are
merged into one when they outgrow each other, so there are few, and dead postings leave. A table of contents is
switched last, as for snapshots: readers see one state or the other.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobdelta.operators.filters import match_columns, matches, normalize_filters, normalize_values
from jobdelta.operators.numbering import numbered
from jobdelta.operators.percolate import WATCH_COLUMNS, posting_anchors, search_options
from jobdelta.operators.snapshot import KEY
from jobdelta.session import materialize
from jobdelta.sources.sinks import _delete, _exists, _fs, _put

#: Postings of a block, numbers in a piece of a list, folders that anchors are dealt to, and how much a segment must
#: be larger than all after it to stay apart.
BLOCK_DOCS, LIST_PIECE, SLOTS, GROWTH = 32_768, 8192, 64, 4


def _state(spark: SparkSession, path: str) -> dict | None:
    if not _exists(spark, f"{path}/contents"):
        return None
    fs, p = _fs(spark, f"{path}/contents")
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().isdigit()]
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/contents/{max(names, key=int)}", wholetext=True).collect())) if names else None


def _key() -> Column:
    return F.xxhash64(*KEY)


def _write_segment(spark: SparkSession, path: str, name: str, rows: DataFrame, gone: DataFrame, block_docs: int) -> int:
    """Write a segment and say how many postings it holds. Neighbouring numbers are neighbouring keys of a board."""
    docs = numbered(rows, [F.col(c) for c in KEY], "doc")
    docs = docs.withColumn("block", F.floor(F.col("doc") / block_docs))
    # A file per block, in order of number.
    docs.repartition("block").sortWithinPartitions("block", "doc").write.partitionBy("block").parquet(f"{path}/{name}/docs")
    kept = [c for c in rows.columns]
    schema = f"doc bigint, block bigint, {docs.select(*kept)._jdf.schema().toDDL()}"
    written = spark.read.schema(schema).parquet(f"{path}/{name}/docs")
    each = written.withColumns(match_columns(F.col)).select("doc", F.explode(posting_anchors()).alias("anchor"))
    # A list is cut by ranges of numbers: no task and no row holds a common anchor's whole list.
    lists = each.groupBy("anchor", F.floor(F.col("doc") / LIST_PIECE).alias("piece")).agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    lists.withColumns({"slot": F.pmod("anchor", F.lit(SLOTS)).cast("int"), "n": F.size("docs")}).repartitionByRange("slot", "anchor", "piece") \
        .sortWithinPartitions("slot", "anchor", "piece").write.partitionBy("slot").parquet(f"{path}/{name}/lists")
    gone.select("key_hash").distinct().write.parquet(f"{path}/{name}/gone")
    return written.count()  # from the files' footers


def _alive(spark: SparkSession, path: str, segments: list[dict], schema: str, docs: DataFrame | None = None) -> DataFrame:
    """Postings (or those of `docs`: at, and the columns of postings) that no later segment takes out, with `at`, the place of their segment."""
    if docs is None:
        parts = [spark.read.schema(f"doc bigint, block bigint, {schema}").parquet(f"{path}/{s['name']}/docs").drop("block").withColumn("at", F.lit(s["at"])) for s in segments if s["docs"]]
        if not parts:
            return spark.createDataFrame([], f"doc bigint, {schema}, at int")
        docs = parts[0]
        for p in parts[1:]:
            docs = docs.unionByName(p)
    takers = [spark.read.schema("key_hash bigint").parquet(f"{path}/{s['name']}/gone").withColumn("by", F.lit(s["at"])) for s in segments if s["gone"]]
    if not takers:
        return docs
    gone = takers[0]
    for g in takers[1:]:
        gone = gone.union(g)
    last = gone.groupBy("key_hash").agg(F.max("by").alias("by"))
    keyed = docs.withColumn("key_hash", _key()).join(last, "key_hash", "left")
    return keyed.filter("by is null or by <= at").drop("key_hash", "by")


def write_index(postings: DataFrame, path: str, block_docs: int = BLOCK_DOCS) -> None:
    """A new index of these postings (unique in board and key)."""
    update_index(postings.sparkSession, path, postings, postings.limit(0).select(*KEY), block_docs, fresh=True)


def update_index(spark: SparkSession, path: str, come: DataFrame, gone: DataFrame, block_docs: int = BLOCK_DOCS, fresh: bool = False) -> None:
    """Put postings in and take keys out: what `posting_delta` finds, or the rows of change events.

    A posting that is already there is replaced. `gone` (resource_id, key) may name keys that are not there.
    """
    state = None if fresh else _state(spark, path)
    number = (_latest(spark, path) + 1)
    schema = state["schema"] if state else come._jdf.schema().toDDL()
    segments = state["segments"] if state else []
    come = materialize(come, "index-come")
    out = gone.select(_key().alias("key_hash"))
    if segments:
        out = out.union(come.select(_key().alias("key_hash")))
        come = spark.createDataFrame([], schema).unionByName(come, allowMissingColumns=True)
    out = materialize(out.distinct(), "index-gone")
    at = max((s["at"] for s in segments), default=-1) + 1
    one = {"name": f"segments/{number}", "at": at, "gone": 0 if out.isEmpty() else 1, "blocks": block_docs}
    one["docs"] = _write_segment(spark, path, one["name"], come, out, block_docs)
    segments = [*segments, one]
    start = len(segments) - 1
    while start and segments[start - 1]["docs"] < GROWTH * sum(s["docs"] for s in segments[start:]):
        start -= 1
    if start < len(segments) - 1:
        # The last segments become one; what they take out of those before stays.
        run = segments[start:]
        rows = _alive(spark, path, run, schema).drop("doc", "at")
        takers = [spark.read.schema("key_hash bigint").parquet(f"{path}/{s['name']}/gone") for s in run]
        all_gone = takers[0]
        for t in takers[1:]:
            all_gone = all_gone.union(t)
        merged = {"name": f"segments/{number}m", "at": run[-1]["at"], "gone": 1 if start else 0, "blocks": block_docs}
        merged["docs"] = _write_segment(spark, path, merged["name"], rows, all_gone if start else all_gone.limit(0), block_docs)
        segments = [*segments[:start], merged]
    _put(spark, f"{path}/contents/{number}", json.dumps({"schema": schema, "segments": segments}))


def _latest(spark: SparkSession, path: str) -> int:
    if not _exists(spark, f"{path}/contents"):
        return -1
    fs, p = _fs(spark, f"{path}/contents")
    return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=-1)


def drop_segments(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the segments that none of the last `keep` tables of contents names."""
    fs, p = _fs(spark, f"{path}/contents")
    numbers = sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())
    needed: set[str] = set()
    for n in numbers[-keep:]:
        found = json.loads("".join(r[0] for r in spark.read.text(f"{path}/contents/{n}", wholetext=True).collect()))
        needed |= {s["name"] for s in found["segments"]}
    for n in numbers[:-keep]:
        _delete(spark, f"{path}/contents/{n}")
    fs, p = _fs(spark, f"{path}/segments")
    for s in fs.listStatus(p):
        if f"segments/{s.getPath().getName()}" not in needed:
            _delete(spark, f"{path}/segments/{s.getPath().getName()}")


def _conditions(spark: SparkSession, **filters) -> dict[int, dict[int, dict[int, list[int]]]]:
    """kind → part → option → anchors of one search."""
    values = normalize_values(**filters)
    types = {"remote_only": "boolean", "min_salary": "int", "salary_currency": "string", "max_experience_years": "int", "include_unknown": "boolean"}
    names = [c for c in WATCH_COLUMNS if c != "change_types"]
    row = spark.createDataFrame([tuple(values[c] for c in names)], ", ".join(f"{c} {types.get(c, 'array<string>')}" for c in names))
    out: dict = {}
    for o in normalize_filters(row).select(F.explode(search_options()).alias("o")).select("o.*").collect():  # the search's own words
        out.setdefault(o["kind"], {}).setdefault(o["part"], {}).setdefault(o["option"], []).extend(o["anchors"])
    return out


def _lists(spark: SparkSession, path: str, segment: dict, anchors: list[int]) -> DataFrame:
    """The pieces of these anchors' lists: only their folders are listed, only their row groups read."""
    slots = sorted({a % SLOTS for a in anchors})
    return spark.read.schema("anchor bigint, piece bigint, docs array<bigint>, slot int, n int").parquet(f"{path}/{segment['name']}/lists") \
        .filter(F.col("slot").isin(slots) & F.col("anchor").isin(anchors))


def candidates(spark: SparkSession, path: str, segment: dict, conditions: dict) -> DataFrame:
    """doc: numbers that stand in some list of every condition of the search, one segment's."""
    anchors = sorted({a for parts in conditions.values() for options in parts.values() for o in options.values() for a in o})
    often = {r["anchor"]: r["n"] for r in _lists(spark, path, segment, anchors).groupBy("anchor").agg(F.sum("n").alias("n")).collect()}  # the search's own anchors
    of_kind: dict[int, list[int]] = {}
    for kind, parts in conditions.items():
        for options in parts.values():
            # Of each part the option whose lists are shortest together.
            of_kind.setdefault(kind, []).extend(min(options.values(), key=lambda o: sum(often.get(a, 0) for a in o)))
    used = sorted({a for x in of_kind.values() for a in x})
    bits = [F.when(F.col("anchor").isin(x), F.lit(1 << n)).otherwise(0) for n, x in enumerate(of_kind.values())]
    carried = bits[0]
    for b in bits[1:]:
        carried = carried.bitwiseOR(b)
    met = _lists(spark, path, segment, used).select(carried.cast("bigint").alias("bits"), F.explode("docs").alias("doc"))
    return met.groupBy("doc").agg(F.bit_or("bits").alias("bits")).filter(F.col("bits") == (1 << len(of_kind)) - 1).select("doc")


def indexed_matches(spark: SparkSession, path: str, **filters) -> DataFrame:
    """Open postings that pass one search, like `matching` over all of them, from the index.

    A search without any condition reads every posting.
    """
    state = _state(spark, path)
    if state is None:
        raise FileNotFoundError(f"no index at {path}")
    schema, segments = state["schema"], state["segments"]
    columns = spark.createDataFrame([], schema).columns
    conditions = _conditions(spark, **filters)
    found = None
    if conditions:
        for s in segments:
            if not s["docs"]:
                continue
            hits = materialize(candidates(spark, path, s, conditions).withColumn("block", F.floor(F.col("doc") / s["blocks"])), "index-hits")
            blocks = [r[0] for r in hits.select("block").distinct().collect()]  # at most a number per block
            if not blocks:
                continue
            folders = [f"{path}/{s['name']}/docs/block={b}" for b in sorted(blocks)]
            part = spark.read.schema(f"doc bigint, {schema}").parquet(*folders).join(hits.select("doc"), "doc").withColumn("at", F.lit(s["at"]))
            found = part if found is None else found.unionByName(part)
        if found is None:
            return spark.createDataFrame([], schema)
    alive = _alive(spark, path, segments, schema, found)
    tested = alive.withColumns(match_columns(F.col)).filter(matches(normalize_values(**filters).__getitem__))
    return tested.select(*columns)
