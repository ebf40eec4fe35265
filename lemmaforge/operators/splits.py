"""Builders of train, development and test sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BLOCK


def _bucket(key: Column, salt: str = "") -> Column:
    """0 .. 99 from the MD5 of the key: the same in every engine and every run."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long"), F.lit(100)).cast("int")


def hash_split(df: DataFrame, key: str, dev: int = 5, test: int = 5) -> DataFrame:
    """df with split: about 100 - dev - test percent train; rows of a key stay together."""
    b = _bucket(F.col(key))
    return df.withColumn("split", F.when(b < test, "test").when(b < test + dev, "dev").otherwise("train"))


def stratified_sample(df: DataFrame, domain: str, length: str, key: str, per_domain: int = 100, strata: int = 4, least: int = 5) -> DataFrame:
    """(domain, stratum, key): per_domain rows of each domain, spread evenly over
    quantiles of length, in the order of a hash; rows shorter than `least` are out."""
    rows = df.where(F.col(length) >= least).select(domain, key, length)
    rows = rows.withColumn("stratum", F.ntile(strata).over(W.partitionBy(domain).orderBy(length, key)))
    pick = F.row_number().over(W.partitionBy(domain, "stratum").orderBy(F.md5(F.col(key).cast("string")), key))
    return rows.withColumn("_n", pick).where(F.col("_n") <= per_domain // strata).select(domain, "stratum", key)


def rare_holdout(df: DataFrame, lemma: str, n_lemmas: int) -> DataFrame:
    """df with held_out: all tokens of the n rarest lemmas, ties by lemma."""
    rare = df.groupBy(F.col(lemma).alias("_l")).agg(F.count("*").alias("_n")).orderBy("_n", "_l").limit(n_lemmas).select("_l")
    return df.join(rare, F.col(lemma) == F.col("_l"), "left").withColumn("held_out", F.col("_l").isNotNull()).drop("_l")


def label_filter(df: DataFrame, form: str) -> DataFrame:
    """Rows whose form has two characters or more, no digit, and a letter."""
    f = F.col(form)
    return df.where((F.char_length(f) > 1) & ~f.rlike("[0-9]") & f.rlike(f"[A-Za-z{BLOCK}]"))
