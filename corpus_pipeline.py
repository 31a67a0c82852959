"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns of docs.

Defined results, of every stage: a null text counts as empty; where nothing of a text goes, it stays as it was, null or not, and
n_chars too. Empty texts are scored like others, have no lines, shingles or passages to lose, and pack into their end id. Rows with a
null id are scored, keep all lines, are near-duplicates of nothing, and lose passages. Rows that repeat an id are rows of one
document: they share its lines, near-duplicates by ids keep or drop all of them, and passages are judged row by row. Ties go to the smallest id. An
empty table gives an empty result, without labels every document stays, and other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcode.llm import line_dedup, near_dedup, packing, quality_model, substring_dedup
from weftcode.llm.common import Workspace, load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_model.fit_quality(docs, load(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, model, score_col="__score")
    return scored.filter(F.col("__score") >= quality_model.THRESHOLD).drop("__score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; a document left without a word goes too."""
    out = line_dedup.line_dedup(docs)
    return with_text(out.filter((F.col("n_dropped") == 0) | has_word(F.col("text"))), docs.columns, F.col("text"), F.col("n_dropped") > 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    kept = near_dedup.near_dedup(docs).filter("kept").select(F.col("id").alias("__id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept["__id"]), "left_semi")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; other texts stay as they are, and a document left without a word goes."""
    out = substring_dedup.substring_dedup(docs)
    changed = F.col("n_removed") > 0
    return with_text(out.filter(~changed | (F.col("n_removed") < F.col("n_words"))), docs.columns, F.when(changed, F.col("kept_text")).otherwise(F.col("text")), changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, with their ids."""
    out = packing.pack(docs)
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


def has_word(text):
    return text.rlike(r"[^\x20\x09-\x0D]")


def with_text(rows: DataFrame, columns: list[str], text, changed) -> DataFrame:
    """The columns of documents with a new text, whose length n_chars follows."""
    rows = rows.withColumns({"text": text, "__changed": changed})
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__changed"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*columns)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("substring dedup", substrings), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = load(spark, sf_dir, "documents"), Workspace(spark)
    for name, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        ws.keep_only(docs)
    return docs
