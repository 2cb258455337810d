"""A corpus pipeline of five operators, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs.  All but the last return the columns of docs.

Defined cases, for every stage: null and empty texts are clean documents and stay (the last
stage gives them their end mark); so are wordless texts, of which near-duplicate removal keeps one of those alike; rows alike in doc_id and text are one document repeated, of which near-duplicate
removal keeps one row; a null doc_id is a value like others, the least; of equal candidates the least doc_id stays; an
empty table gives an empty table; columns are carried under whatever names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.llm import decontamination, line_dedup, near_dedup, toxicity_crf
from tabulark.llm.arrow_rows import quoted
from tabulark.llm.queries import packed_documents
from tabulark.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut."""
    model = toxicity_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_crf.score_toxicity(docs, model).filter(F.col("score") < toxicity_crf.CUT).select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three-line windows; n_chars follows the text."""
    cleaned = line_dedup.dedup_lines(docs)
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))}
    return cleaned.select(*[changed.get(c, F.col(f"doc.{quoted(c)}")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least id."""
    return near_dedup.near_duplicates(docs).filter("keep").select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    found = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~decontamination.contaminated(F.col("n_words"), F.col("n_hit"))).select("doc.*")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in training sequences."""
    return packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Trained scores, weighted samples and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
