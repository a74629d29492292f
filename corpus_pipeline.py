"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them in order,
each stage's rows written as Parquet and read again as the next one's docs.

In every stage a null text counts as empty and stays, rows with a null doc_id are no copies of others, repeated rows are
judged alike, an empty table gives an empty one, and columns beside doc_id and text stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import stored
from offerloom.llm.op03_ngram_join import ngram_join
from offerloom.llm.op05_line_dedup import line_dedup
from offerloom.llm.op07_decontamination import decontaminate
from offerloom.llm.op08_toxicity import fit, score
from offerloom.llm.op10_packing import packed


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns beside doc_id and text under names that no operator gives, and the way back."""
    names = {c: f"kept_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.select(*[F.col(c).alias(names.get(c, c)) for c in docs.columns]), lambda df: df.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine predicts toxic go. It learns from the labels outside the held-out third.

    A null or empty text has the score of a text without terms, and stays. Without labels of both classes all stay.
    """
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    rows, back = _aside(docs)
    scored = score(rows, fit(rows, labels), keep=tuple(c for c in rows.columns if c != "doc_id"))
    return back(scored.where("predicted = 0"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go, and documents of which nothing is left; n_chars, where it is there,
    follows the text. Null texts and texts of fewer than three lines stay."""
    rows, back = _aside(docs)
    cut = back(line_dedup(rows).where("n_removed < n_lines or n_lines = 0"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id stays of each group; documents without words or id are in no group and stay."""
    goes = ngram_join(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(goes, "doc_id", "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; without items all stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in windows of 2048 ids. A null text is one piece of the end id alone."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontamination", benchmark_leaks), ("packing", packing)]

#: A trained model, a similarity join, edit distances and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
