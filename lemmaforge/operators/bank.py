"""The lemma bank: a dimension table (lemma_id, lemma, pos_tags, source, embedding)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space

TAG_COLUMNS = "pos upos POS UPOS".split()


def treebank_rows(df: DataFrame, order: str | None = None, priority: int = 0) -> DataFrame:
    """Bank rows of a labelled table: its column `lemma`, else its second one; tags
    from the first of pos, upos, POS, UPOS that it has."""
    names = df.columns
    lemma = next((c for c in names if c == "lemma"), names[min(1, len(names) - 1)])
    pos = next(filter(names.__contains__, TAG_COLUMNS), None)
    at = F.col(f"`{order}`").cast("long") if order else F.monotonically_increasing_id()
    tag = F.coalesce(trim_space(F.col(f"`{pos}`").cast("string")), F.lit("")) if pos else F.lit("")
    rows = df.select(F.coalesce(trim_space(F.col(f"`{lemma}`").cast("string")), F.lit("")).alias("lemma"), tag.alias("pos"), F.lit("treebank").alias("source"), F.lit(priority).alias("priority"), at.alias("ord"))
    return rows.where("lemma <> ''")


def lexicon_rows(df: DataFrame, value: str = "value", order: str | None = None, priority: int = 1000) -> DataFrame:
    """Bank rows of a lexicon of one lemma a line; blank lines, section heads in
    brackets and single characters are skipped."""
    at = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    rows = df.select(trim_space(F.coalesce(F.col(value), F.lit(""))).alias("lemma"), F.lit("").alias("pos"), F.lit("lexicon").alias("source"), F.lit(priority).alias("priority"), at.alias("ord"))
    return rows.where((F.char_length("lemma") > 1) & ~F.startswith("lemma", F.lit("[")))


def build_bank(*parts: DataFrame, numbered: bool = True) -> DataFrame:
    """(lemma_id, lemma, pos_tags, source): union of bank rows; the first row by
    (priority, ord) gives a lemma its place and source, tags are collected from the
    treebank rows. lemma_id is dense from 0. Repeated rows are aggregated by their first
    ord alone, and only distinct ones have their tags collected. numbered=False leaves out
    lemma_id."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    once = rows.groupBy("lemma", "pos", "source", "priority").agg(F.min("ord").alias("ord"))
    tags = F.sort_array(F.filter(F.collect_set("pos"), lambda x: x != "")).alias("pos_tags")
    first = F.min(F.struct("priority", "ord", "source")).alias("f")
    merged = once.groupBy("lemma").agg(tags, first)
    out = ["lemma", "pos_tags", F.col("f.source").alias("source")]
    return _numbered(merged).select("lemma_id", *out) if numbered else merged.select(*out)


def _numbered(merged: DataFrame) -> DataFrame:
    """merged (lemma, pos_tags, f) with lemma_id by (f.priority, f.ord, lemma), without a
    window over all: places within 2**20 values of ord, and running sums of the counts of
    such spans within 2**32 values, and of those."""
    at = merged.select("*", F.col("f.priority").alias("_p"), F.shiftright("f.ord", 20).alias("_b"))
    # the counts name all columns, so that both branches read one exchange
    one = F.when((F.size("pos_tags") >= 0) & (F.length("f.source") >= 0), 1)
    counts = at.groupBy("_p", "_b").agg(F.count(one).alias("_n")).withColumn("_w", F.shiftright("_b", 12))
    wide = counts.groupBy("_p", "_w").agg(F.sum("_n").alias("_m"))
    wide = wide.select("_p", "_w", F.expr("sum(_m) OVER (ORDER BY _p, _w) - _m").alias("_before"))
    near = counts.select("_p", "_b", "_w", F.expr("sum(_n) OVER (PARTITION BY _p, _w ORDER BY _b) - _n").alias("_near"))
    starts = near.join(wide, ["_p", "_w"]).select("_p", "_b", (F.col("_before") + F.col("_near")).alias("_start"))
    place = at.withColumn("_k", F.expr("row_number() OVER (PARTITION BY _p, _b ORDER BY f.ord, lemma) - 1"))
    return place.join(starts, ["_p", "_b"]).withColumn("lemma_id", (F.col("_start") + F.col("_k")).cast("long"))


def bank_meta(bank: DataFrame) -> DataFrame:
    """One row: n_lemmas, has_pos, has_embeddings, embedding_dim."""
    has = "embedding" in bank.columns
    dim = F.max(F.size("embedding")) if has else F.lit(None).cast("int")
    return bank.agg(
        F.count("*").alias("n_lemmas"),
        (F.count("*") > 0).alias("has_pos"),
        (F.count("embedding") > 0 if has else F.lit(False)).alias("has_embeddings"),
        dim.alias("embedding_dim"),
    )


def save_bank(bank: DataFrame, path: str) -> None:
    """Parquet for the engine, and a CSV of lemma, pos_tags, source as interchange."""
    bank.write.mode("overwrite").parquet(f"{path}/bank.parquet")
    flat = bank.orderBy("lemma_id").select("lemma", F.concat_ws("|", F.array_sort("pos_tags")).alias("pos_tags"), "source")
    flat.coalesce(1).write.mode("overwrite").csv(f"{path}/lemmas.csv", header=True)
    bank_meta(bank).coalesce(1).write.mode("overwrite").json(f"{path}/bank_meta.json")


def load_bank(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/bank.parquet")


def bank_from_csv(df: DataFrame, order: str | None = None) -> DataFrame:
    """A bank from lemma, pos_tags (joined by |), source rows: blanks and repeats are
    dropped, the first row of a lemma stays."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    rows = df.select(F.coalesce("lemma", F.lit("")).alias("lemma"), F.filter(F.split(F.coalesce("pos_tags", F.lit("")), r"\|"), lambda x: x != "").alias("pos_tags"), F.coalesce("source", F.lit("")).alias("source"), at.cast("long").alias("ord")).where("lemma <> ''")
    first = rows.groupBy("lemma").agg(F.min_by(F.struct("pos_tags", "source", "ord"), "ord").alias("f"))
    return first.select(F.expr("row_number() OVER (ORDER BY f.ord) - 1").cast("long").alias("lemma_id"), "lemma", "f.pos_tags", "f.source")
