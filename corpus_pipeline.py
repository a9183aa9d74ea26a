"""From raw documents to token files: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saccade.llm import decontaminate, mixing, ngram_join, quality, token_output
from saccade.llm.common import read, shared_dir
from saccade.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line frequencies reject go; the others lose the lines above the limit."""
    cells = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return quality.score(docs).where("kept").select(*[cells.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that 5-word shingles and a similarity of 0.8 link."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make a twentieth or more go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: by file and by row in it."""
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which the documents are stored (by doc_id where they aren't files),
    read back: doc_id, source, n_tokens, token_ids and start."""
    order = ["doc_id"]
    try:
        docs = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        order = ["_file", "_row"]
    except AnalysisException:
        pass
    path = f"{shared_dir(spark)}/tokens"
    token_output.write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"), order=order, keep=["doc_id", "source"])
    return token_output.read_tokens(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mix),
    ("token-ID output", token_ids),
]

#: SQL can't express the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{base}/stage-{i}")
            docs = spark.read.parquet(f"{base}/stage-{i}")
    return docs
