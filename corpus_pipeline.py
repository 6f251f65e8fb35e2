"""The corpus pipeline: documents in, packed training windows out.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and gives a DataFrame, which is
written and read again as the next one's docs. All but the last give the columns of documents.

Cases that hold for every stage: an empty table gives an empty one; extra columns, whatever their names,
pass through (the last stage reads doc_id, source and text only); repeated rows are treated alike; long
texts are read whole. A null doc_id passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import attention_mil, circulant_minhash, fertility, fm_index, packing
from webloom.llm.common import shared_dir, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention-based classifier rejects go.

    It learns from those of ``labels`` whose documents are there. A null or empty text is scored as an
    empty passage. Without labels of both classes all documents stay."""
    return attention_mil.kept(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules reject go.

    Null and blank texts go ("empty"); texts of few tokens are judged by no band; a null or unknown language
    is judged by its text's script."""
    return fertility.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least doc_id.

    Rows that repeat a doc_id stay or go together; null texts and null doc_ids are in no group and stay;
    blank texts are copies of each other."""
    return circulant_minhash.kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` are cut out of the texts, and n_chars is that of what is left.

    Null and empty texts pass; a document of which only white space is left goes; without a benchmark all
    pass unchanged."""
    return fm_index.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in the packed windows: window_id, position, source, doc_id, doc_start, n_tokens.

    doc_start counts tokens of the text as this stage got it, which run keeps as the table ``decontamination``.
    Null and blank texts have no place; a null source is the queue ""."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture_packing", mixture_packing),
]

#: A learned classifier, tokenisers, min-hashing and suffix arrays: no stage is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows over ``documents``. Each other stage is a Parquet table of its name in ``folder``,
    by default a new one, pipeline-..., under spark.checkpoint.dir; it stays there, as the windows point into
    its decontamination."""
    folder = (folder or shared_dir(spark, "pipeline")).rstrip("/")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
