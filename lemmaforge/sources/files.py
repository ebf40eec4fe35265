"""File sources and sinks."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = {"train": "train", "dev": "dev", "test": "test", "ood": "ood", "oov": "oov", "ood_dicta": "ood_Dicta", "ood_geektime": "ood_GeekTime", "ood_bagatz": "ood_Bagatz"}


def text_docs(spark: SparkSession, path: str, recursive: bool = True, files_glob: str = "*.txt") -> DataFrame:
    """(rel_path, path, text) of one file or of the files of a folder, line ends as
    \\n. Paths are told apart from raw text by the caller, never by guessing."""
    reader = spark.read
    single = os.path.isfile(path)
    if not single:
        reader = reader.option("pathGlobFilter", files_glob).option("recursiveFileLookup", recursive)
    root = os.path.abspath(path) if "://" not in path else path
    rows = reader.text(path, wholetext=True).select("value", F.url_decode(F.regexp_replace(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")), "^file:/*", "/")).alias("path"))
    rel = F.element_at(F.split("path", "/"), -1) if single else F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 20)
    return rows.select(rel.alias("rel_path"), "path", F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def raw_docs(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def batch_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows to lemmatize: all columns as strings, nulls as empty strings. Values are
    not guessed at, so NA and 1.0 stay what they are."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def split_names() -> list[str]:
    return sorted(SPLITS)


def load_split(spark: SparkSession, folder: str, split: str = "ood") -> DataFrame:
    """A labelled split by name (any case), or by file name."""
    name = split if split.endswith(".csv") else SPLITS.get(split.lower(), split) + ".csv"
    return batch_csv(spark, f"{folder}/{name}")


def bom_csv(spark: SparkSession, path: str) -> DataFrame:
    """A small curated CSV, with or without a byte order mark."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def lexicon_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def first_existing(*paths: str | None) -> str | None:
    return next((p for p in paths if p and os.path.exists(p)), None)


def npy_embeddings(spark: SparkSession, bank: DataFrame, path: str) -> DataFrame:
    """bank with embedding from a float matrix in the order of lemma_id: a one-off
    import, after which the vectors live in Parquet under their lemma_id."""
    rows = np.load(path, mmap_mode="r")
    table = spark.createDataFrame([(i, r.astype(float).tolist()) for i, r in enumerate(rows)], "lemma_id long, embedding array<float>")
    return bank.join(table, "lemma_id")


def script_inventory(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame(list(enumerate(json.load(f))), "script_id int, script string")


def linear_head_files(weights: str, bias: str) -> tuple[list, list]:
    return np.load(weights).tolist(), np.load(bias).tolist()


def write_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    """CSV with a header; order restores the input order and is not written."""
    out = df.orderBy(order).drop(order) if order else df
    out.coalesce(1).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def write_worklist(worklist: DataFrame, path: str) -> int:
    """The miss worklist as CSV (a header even if it is empty); its number of rows."""
    n = worklist.count()
    write_csv(worklist, path)
    return n


def write_docs(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)
