"""Evaluation of predicted lemmas against gold, and comparison of two systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edits import coverage


def accuracy(pred: DataFrame, train: DataFrame, form: str = "form", lemma: str = "lemma", gold: str = "gold", split: str = "split") -> DataFrame:
    """(split, seen, n, accuracy) by exact match, with subtotals (null) by rollup; a
    form is seen if it occurs in train. Equal rows are counted before they are joined."""
    known = train.select(F.col(form).alias("_f")).distinct()
    equal = pred.groupBy(split, form, F.col(lemma).eqNullSafe(F.col(gold)).cast("int").alias("ok")).agg(F.count("*").alias("c"))
    rows = equal.join(known.hint("merge"), F.col(form) == F.col("_f"), "left").select(split, F.when(F.col("_f").isNotNull(), "seen").otherwise("unseen").alias("seen"), "ok", "c")
    return rows.rollup(split, "seen").agg(F.sum("c").alias("n"), (F.sum(F.col("ok") * F.col("c")) / F.sum("c")).alias("accuracy"))


def b_cubed(pred: DataFrame, lemma: str = "lemma", gold: str = "gold") -> DataFrame:
    """(precision, recall, f1) over items clustered by predicted and by gold lemma.
    Items of one (predicted, gold) pair have equal figures, so all sums run over the
    distinct pairs."""
    pairs = pred.groupBy(F.col(lemma).alias("p"), F.col(gold).alias("g")).agg(F.count("*").alias("n"))
    by_p = pairs.groupBy(F.col("p").alias("p2")).agg(F.sum("n").alias("np"))
    by_g = pairs.groupBy(F.col("g").alias("g2")).agg(F.sum("n").alias("ng"))
    both = pairs.join(by_p, F.col("p").eqNullSafe(F.col("p2"))).join(by_g, F.col("g").eqNullSafe(F.col("g2")))
    s = both.agg((F.sum(F.col("n") * F.col("n") / F.col("np")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("ng")) / F.sum("n")).alias("recall"))
    return s.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def low_overlap(pred: DataFrame, train: DataFrame, tau: float = 0.5, form: str = "form", lemma: str = "lemma", gold: str = "gold") -> DataFrame:
    """(n, rate): share of unseen forms whose wrong lemma covers less than tau."""
    known = train.select(F.col(form).alias("_f")).distinct()
    rows = pred.join(known, F.col(form) == F.col("_f"), "left_anti")
    rows = rows.withColumn("_c", coverage(F.col(form), F.col(lemma)))
    bad = ~F.col(lemma).eqNullSafe(F.col(gold)) & (F.col("_c") < tau)
    return rows.agg(F.count("*").alias("n"), F.avg(bad.cast("int")).alias("rate"))


def compare_systems(left: DataFrame, right: DataFrame, form: str = "form", lemma: str = "lemma", order: str = "row_id") -> DataFrame:
    """(row_id, form, ours, theirs, diff): for each row of left the last answer of right
    for the form; diff where it is missing or another. Answers are looked at once each."""
    last = right.groupBy(form, lemma).agg(F.max(order).alias(order))
    other = last.groupBy(F.col(form).alias("_f")).agg(F.max_by(lemma, order).alias("theirs"))
    both = left.join(other.hint("merge"), F.col(form) == F.col("_f"), "left")
    return both.select(order, form, F.col(lemma).alias("ours"), "theirs", (~F.col(lemma).eqNullSafe(F.col("theirs"))).alias("diff"))
