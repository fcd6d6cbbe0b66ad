"""A corpus from raw documents to packed sequences, in stages that each call one operator of ``plumbline.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, line_templates, packing, simhash, similar
from plumbline.llm.common import fresh_path, table


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns as one, so that none meets a column of an operator."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("others"))


def _together(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, in their order, some of them new."""
    old = {c: F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c) for c in docs.columns}
    return found.select(*[(new[c] if c in new else old[c]).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language stay; those without one ('und': null, empty, or no letter) go."""
    found = langid.identify(_apart(docs), langid.fit(docs))
    return _together(found.where(F.col("lang_pred") != langid.UNKNOWN), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur across documents stay in the first; a document that had nothing else goes.

    ``n_chars`` counts what is left of a text that lost lines.
    """
    left = line_templates.drop_lines(_apart(docs))
    changed = F.col("n_dropped") > 0
    left = left.where(~changed | F.col("text").rlike(r"\S"))
    counted = {"n_chars": F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("others.n_chars"))} if "n_chars" in docs.columns else {}
    return _together(left, docs, **counted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays, once.

    Two documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return simhash.one_of_each(docs, similar.similar(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, with their bins."""
    return packing.pack(docs, packing.words(), packing.same_text())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packed", packed)]

#: No SQL: language models, fingerprints and packing are beyond it; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
