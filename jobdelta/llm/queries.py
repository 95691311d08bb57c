"""The registered queries of this folder: each applies its operator to a whole table and returns the full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from jobdelta.llm import bpe, centroids, exact_dedup, fingerprints, hmm, language, line_dedup, near_dedup, packing, prefix_trie, quality, token_counts, toxicity
from jobdelta.llm.common import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return fn


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_packing(spark, table):
    pieces = packing.cut_documents(table("documents"), vocabulary()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(written(pieces, "packing-pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_bpe(spark, table):
    decoded = bpe.decode(bpe.encode(table("documents"), vocabulary()), vocabulary())
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_exact_dedup(spark, table):
    return exact_dedup.mark_copies(table("documents"))


ORACLES["op3_exact_dedup"] = exact_dedup.ORACLE


@query
def op4_toxicity(spark, table):
    return toxicity.score_toxicity(table("documents"), table("labels")).select("doc_id", "held_out", "score", "predicted")


@query
def op5_near_dedup(spark, table):
    return near_dedup.near_groups(table("documents"))


@query
def op9_line_dedup(spark, table):
    return line_dedup.remove_boilerplate(table("documents"))


ORACLES["op9_line_dedup"] = line_dedup.ORACLE


@query
def op10_token_counts(spark, table):
    return token_counts.over_limit(token_counts.count_tokens(table("documents"), vocabulary()))


@query
def op7_language(spark, table):
    return language.identify(table("documents"))


@query
def op8_hmm(spark, table):
    return hmm.score_texts(table("documents"))


@query
def op6_fingerprints(spark, table):
    return fingerprints.compare_with_next(table("documents"))


@query
def op11_prefix_trie(spark, table):
    return prefix_trie.prefix_trie(table("conversations"))


ORACLES["op11_prefix_trie"] = prefix_trie.ORACLE


@query
def op12_centroids(spark, table):
    return centroids.cluster_vectors(table("embeddings"))


ORACLES["op12_centroids"] = centroids.ORACLE


@query
def op13_quality(spark, table):
    return quality.score_quality(table("documents"), table("labels"))
