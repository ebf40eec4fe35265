"""A corpus pipeline: documents become packed training windows.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
its result is written as Parquet in the shared folder and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lemmaforge.llm import exact_dedup, ngram_join, packing, pii, quality
from lemmaforge.llm.common import stored, table


def quality_stage(spark, docs, sf_dir):
    """Documents that the ordinal classifier rejects go. Null, empty and blank texts and
    rows with a null identifier are judged like any other: blank ones stay. Repeated
    rows fare alike. Without a labelled document in docs nothing goes; an empty table
    stays empty."""
    model = quality.train(docs, quality.ratings_of(table(spark, sf_dir, "labels")))
    return quality.select_rows(docs, model)


def exact_stage(spark, docs, sf_dir):
    """Of documents with equal texts that with the smallest identifier stays. Rows with
    a null text or identifier all stay; of rows that repeat both one stays; equal empty
    texts are copies of one another; an empty table stays empty."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark, docs, sf_dir):
    """Of each class of near duplicates the document of the least identifier stays. Rows
    with a null identifier, or whose texts are null, empty or blank, all stay; repeated
    rows share one fate; other texts of an identifier are documents of their own; an
    empty table stays empty."""
    return ngram_join.keep_one(docs)


def pii_stage(spark, docs, sf_dir):
    """Personal data is replaced by its kind in brackets; n_chars follows the text. No
    row goes; null texts stay null with a null n_chars, empty ones empty; equal texts
    come out alike; an empty table stays empty."""
    return pii.redact_corpus(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark, docs, sf_dir):
    """Windows of 2,048 words: the pieces of documents with their places and texts.
    Rows without a word (null, empty or blank texts) give no piece; null identifiers
    stay null; repeated rows are packed as often as they occur; an empty table gives
    no rows."""
    return packing.pack(docs, text_col="text")


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The classifier is fitted by iteration, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
