"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

1. One scan writes (id, SHA-256) per row; texts are never shuffled.
2. Misra-Gries counters (``DataFrame.freqItems``) over the digests name every
   digest that holds at least ``support`` of the rows, and perhaps some others:
   at most ``1 / support`` names whatever the input's size.
3. Those candidates are verified: exact count and largest id of each, by an
   aggregation that combines on the map side.
4. Rows of verified winners get their verdict from a broadcast of those at most
   ``1 / support`` rows, where they are read; all remaining rows go through an
   ordinary aggregation, written, and a join with it on the digest, in which no key can
   hold more than ``support`` of the rows and the planner may split those that hold many.

Defined results: a null text counts as the empty text. Rows that repeat an id
and a text share one verdict. A null id never beats another id; a group that
has only null ids keeps none of its rows (``keep_id`` null). An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, load, small_table

#: Share of the rows from which a digest surely counts as frequent.
SUPPORT = 0.005


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of each text's UTF-8 bytes, as 32 bytes."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    return docs.select(F.col(id_col).alias("id"), digest.alias("digest"))


def frequent_digests(digests: DataFrame, support: float = SUPPORT) -> list[str]:
    """Misra-Gries candidates as upper-case hex; at most 1 / support of them."""
    row = digests.select(F.hex("digest").alias("h")).freqItems(["h"], support).first()
    return [h for h in (row[0] or []) if h is not None] if row else []


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, digest, keep_id, group_size, kept."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    digests = ws.table(text_digests(docs, id_col, text_col), "digests")
    frequent = frequent_digests(digests, support)
    verdict = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    candidates = small_table(spark, [(h,) for h in frequent], "h string").select(F.unhex("h").alias("digest"))
    winners = digests.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(*verdict)
    heavy = digests.join(F.broadcast(winners), "digest")
    light = digests.join(F.broadcast(candidates), "digest", "left_anti")
    light = light.join(ws.table(light.groupBy("digest").agg(*verdict), "verdicts"), "digest")
    out = heavy.unionByName(light)
    return out.select("id", "digest", "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_dedup(load(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
}
