"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before kept, as a stored table. A lost executor repeats a part of one
stage; a finished stage is never run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import language, line_dedup, ngram_join, packing, rules
from chronotext.llm.common import Scratch
from chronotext.llm.tokens import default_path
from chronotext.registry.base import table

MIN_CONFIDENCE = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or the decision list learned from the labels.

    Null and empty texts go (no words). Rows are judged one by one, so null ids and repeated rows are like others.
    """
    learned = rules.train(docs, table(spark, sf_dir, "labels"))
    judged = rules.judge(docs, learned)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty ones too) and those whose words show no language at all.

    A word's confidence is its largest posterior, so a text that switches between languages stays. The field is fitted
    on the labelled documents themselves; the label of a document is no input of its prediction. Where no document has
    a label, all with a letter stay. Rows are judged one by one, so null ids and repeated rows are like others.
    """
    model = language.train(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    tagged = language.tag(docs, model, confidence=True)
    lang, confidence = tagged.columns[-3], tagged.columns[-1]
    return tagged.where((F.col(lang) != language.NONE) & (F.col(confidence) >= MIN_CONFIDENCE)).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three-line windows; documents of which nothing is left go. n_chars follows."""
    out = line_dedup.drop_repeated_lines(docs)
    removed = F.col(out.columns[-1]) > 0
    out = out.where(~removed | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(removed, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group linked at 0.8 of five-word shingles."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 2048: one row per piece."""
    return packing.pack_documents(docs, default_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", repeated_lines),
    ("ngram_join", near_duplicates),
    ("packing", pack),
]

# learned rules, a learned tagger and a tokenizer can't be said in SQL; the tests check the stages by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
