"""Acronym candidates from (title, wikitext) tables of a dictionary dump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_defs, strip_niqqud


def category_titles(members: DataFrame, category: str) -> DataFrame:
    """(title): pages of the category and of its direct subcategories, once each.
    members: (category, title, kind) with kind page or subcat."""
    own = members.where(F.col("category") == category)
    subs = own.where("kind = 'subcat'").select(F.col("title").alias("_c")).distinct()
    below = members.where("kind = 'page'").join(subs, F.col("category") == F.col("_c"), "left_semi")
    return own.where("kind = 'page'").select("title").union(below.select("title")).distinct()


def acronym_candidates(titles: DataFrame, pages: DataFrame, source: str = "wiktionary") -> DataFrame:
    """(surface, expansion, all_defs, ndefs, source) for each title; a title without a
    page or definition has empty texts and 0."""
    p = pages.select(F.col("title").alias("_t"), "wikitext")
    rows = titles.join(p, F.col("title") == F.col("_t"), "left").select("title", extract_defs(F.coalesce("wikitext", F.lit(""))).alias("d"))
    return rows.select(strip_niqqud(F.col("title")).alias("surface"), F.coalesce(F.get("d", F.lit(0)), F.lit("")).alias("expansion"), F.array_join("d", " | ").alias("all_defs"), F.size("d").alias("ndefs"), F.lit(source).alias("source"))


def mining_counts(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count("*").alias("titles"), F.count_if(F.col("ndefs") == 0).alias("without_definition"), F.sum("ndefs").alias("definitions"))
