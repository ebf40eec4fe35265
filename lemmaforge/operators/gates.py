"""Curated look-ups in front of the router: irregular forms and acronyms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space
from ..schema import CLASS_TAGS


def suppletive_rows(df: DataFrame, order: str | None = None) -> DataFrame:
    """(row_id, surface, upos, lemma): each row once for every tag its word class may
    have; blank surfaces or lemmas and unknown classes give none."""
    tags = F.create_map(*[x for k, v in CLASS_TAGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    at = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    rows = df.select(at.alias("row_id"), *[trim_space(F.coalesce(c, F.lit(""))).alias(c) for c in ("surface", "pos", "lemma")]).where("surface <> '' AND lemma <> ''")
    return rows.select("row_id", "surface", F.posexplode(F.coalesce(F.try_element_at(tags, F.col("pos")), F.array().cast("array<string>"))).alias("k", "upos"), "lemma")


def suppletive_table(df: DataFrame, order: str | None = None) -> DataFrame:
    """(surface, upos, lemma, conflicts): the first row of a key wins; conflicts counts
    later rows of the key with another lemma."""
    rows = suppletive_rows(df, order)
    first = rows.groupBy("surface", "upos").agg(F.min_by("lemma", F.struct("row_id", "k")).alias("lemma"), F.collect_list("lemma").alias("all"))
    return first.select("surface", "upos", "lemma", F.size(F.filter("all", lambda x: x != F.col("lemma"))).alias("conflicts"))


def acronym_table(df: DataFrame) -> DataFrame:
    return df.select(trim_space(F.coalesce("surface", F.lit(""))).alias("surface")).where("surface <> ''").distinct()


def add_gates(rows: DataFrame, suppletives: DataFrame | None, acronyms: DataFrame | None, form: str = "form", pos: str = "pos") -> DataFrame:
    """rows with sup_lemma (null without a hit) and is_acronym. Both tables are small
    curated lists; the planner broadcasts them by their size."""
    out = rows
    if suppletives is None:
        out = out.withColumn("sup_lemma", F.lit(None).cast("string"))
    else:
        s = suppletives.select(F.col("surface").alias("_s_form"), F.col("upos").alias("_s_pos"), F.col("lemma").alias("sup_lemma"))
        out = out.join(s, (F.col(form) == F.col("_s_form")) & (F.col(pos) == F.col("_s_pos")), "left").drop("_s_form", "_s_pos")
    if acronyms is None:
        return out.withColumn("is_acronym", F.lit(False))
    a = acronyms.select(F.col("surface").alias("_a_form"))
    return out.join(a, F.col(form) == F.col("_a_form"), "left").withColumn("is_acronym", F.col("_a_form").isNotNull()).drop("_a_form")
