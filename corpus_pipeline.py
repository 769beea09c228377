"""The corpus pipeline: five stages over ``documents``, each one operator of ``sondage.llm`` on what the last one kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``; more columns, whatever their names, stay as they
are. Null and empty texts have no evidence of quality and go in the first stage, or as too short in the second; texts
of any length are read whole. Rows with a null doc_id are judged by their text, never removed as near copies or as
contaminated. Rows that repeat a doc_id are judged each by its own text in the first two stages, and stay or go together
in the near-duplicate and the decontamination stage. Of equal texts the smallest doc_id stays. Empty tables give empty
results; without labels all documents have the same evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import decontamination, jaccard_join, quality_bayes, quality_rules, sp_tokens
from sondage.llm._common import discard, fresh, settled, small
from sondage.llm.queries import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is below the limit go.

    Null and empty texts have the least evidence and go unless their site is good; repeated rows and null ids are judged
    each by its own text; equal texts of a site have equal verdicts. An empty table stays empty; without labels, or with
    labels of one class, all texts have the same evidence. Columns of any name stay.
    """
    scored = quality_bayes.quality_posterior(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col(fresh(docs, "kept"))).select(*docs.columns)


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above the limit of their host go, and the documents that the rules reject.

    Null, empty and short texts are rejected; each of repeated rows is judged by its text, null hosts are one host. n_chars,
    where there is one that is a number or text, becomes the code points that are left. An empty table stays empty;
    columns of any name stay.
    """
    kept = quality_rules.apply_rules(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, that with the smallest id.

    Of equal texts that is the smallest id; rows that repeat it stay together, null ids stay, texts without words link with
    nothing. Texts of any length are read whole; an empty table stays empty; columns of any name stay.
    """
    gone = settled(lambda: jaccard_join.jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct(), "pipeline-gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows that repeat an id go together, null ids stay; null and empty texts hold nothing. Texts of any length are read whole;
    an empty table, or an empty benchmark, changes nothing; columns of any name stay.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text that is left: doc_id, tokens, n_tokens, parity, round_trip; a null text has none."""
    return sp_tokens.encoded(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination_filter),
    ("SentencePiece encoding and decoding", tokens),
]

#: A trained classifier and a tokenizer: SQL can't express them; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written, and what it needed and its predecessor's rows are deleted then."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda: stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())  # noqa: B023
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
