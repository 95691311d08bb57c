"""Boilerplate lines by the number of distinct sites that carry them.

Occurrences are added up per line hash and site first, so a line of any number of pages costs one small row per
task and site. Every line hash then gets a HyperLogLog sketch of its sites; sketches merge by aggregation. Where the estimate lies so near the threshold that it might be on the
wrong side, the sites are counted exactly. Lines on enough sites are removed from all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobdelta.llm.common import written

MIN_SITES = 5
SKETCH_BITS = 12
#: Six standard errors of a sketch of 2^12 registers (1.04 / sqrt(4096) each).
MARGIN = 6 * 1.04 / 2 ** (SKETCH_BITS / 2)

#: The blanks that do not count at a line's ends.
BLANKS = " \t\n\x0b\x0c\r"

_KEY = ["line_a", "line_b"]
_DOC = ["id", "text_a", "text_b"]


def _identified(docs: DataFrame, site: str) -> DataFrame:
    """Rows with the same id and text have the same lines: (id, text) names a row, also a repeated one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
                       F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b"))


def _lines(rows: DataFrame, *carry: str) -> DataFrame:
    """Each line that is not blank, by 128 bits of hash and its place."""
    line = F.btrim(F.col("line"), F.lit(BLANKS))
    return rows.select(*carry, F.posexplode(F.split("text", "\n")).alias("place", "line")).filter(line != "") \
        .select(*carry, "place", F.xxhash64(line).alias("line_a"), F.xxhash64(F.lit(1), line).alias("line_b"))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """line_a, line_b (hash) of the lines that stand on at least `min_sites` distinct sites; null is a site of its own."""
    lines = written(_lines(_identified(docs, site), "site").groupBy(*_KEY, "site").agg(F.count(F.lit(1)).alias("n")), "line-sites")
    # A line that occurs fewer times than that cannot be on as many sites: it needs no sketch.
    often = lines.groupBy(*_KEY).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_sites).select(*_KEY)
    candidates = lines.join(often, _KEY, "left_semi")
    spread = candidates.groupBy(*_KEY).agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch")) \
        .select(*_KEY, F.hll_sketch_estimate("sketch").alias("sites"))
    spread = written(spread, "line-spread")
    sure = spread.filter(F.col("sites") > min_sites * (1 + MARGIN)).select(*_KEY)
    near = spread.filter(F.col("sites").between(int(min_sites * (1 - MARGIN)), min_sites * (1 + MARGIN))).select(*_KEY)
    counted = lines.join(near, _KEY, "left_semi").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") >= min_sites).select(*_KEY)
    return written(sure.union(counted), "line-boilerplate")


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every row.

    Lines are compared without blanks (`BLANKS`) at their ends, cut at line feeds only, and read whole; blank lines stay. A null text
    counts as empty, which is one blank line. Repeated rows are all returned; other columns are ignored; an
    empty table gives an empty one.
    """
    rows = _identified(docs, site)
    gone = _lines(rows, *_DOC).join(boilerplate(docs, site, min_sites), _KEY, "left_semi").groupBy(*_DOC).agg(F.collect_set("place").alias("gone"))
    same = F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.text_a") == F.col("g.text_a")) & (F.col("r.text_b") == F.col("g.text_b"))
    joined = rows.drop("site").alias("r").join(gone.alias("g"), same, "left").select("r.id", "r.text", "g.gone")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, n: ~F.array_contains("gone", n))
    return joined.select(F.col("id").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
                         F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


_TRIMMED = "trim(line, ' ' || " + " || ".join(f"chr({ord(c)})" for c in BLANKS[1:]) + ")"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM d),
b AS (SELECT {_TRIMMED} AS line FROM l WHERE {_TRIMMED} <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (SELECT r, count(*) AS n_lines, count(b.line) AS n_removed, string_agg(l.line, chr(10) ORDER BY place) FILTER (WHERE b.line IS NULL) AS text
        FROM l LEFT JOIN b ON {_TRIMMED.replace("line", "l.line")} = b.line GROUP BY r)
SELECT doc_id, n_lines, n_removed, coalesce(text, '') AS text FROM d JOIN k USING (r)
"""
