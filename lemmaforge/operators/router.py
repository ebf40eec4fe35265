"""From retrieval to lemma: the order of rules, and what counts as a dictionary gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import apply_script
from ..functions.text import is_valid_lemma, strip_lemma_noise
from ..schema import CLOSED_POS, FUNCTION_POS


def route(rows: DataFrame, use_router: bool | Column = True, min_sim: float = 0.0, cov_thresh: float = 0.60, blank_function_words: bool | Column = False, has_edit_head: bool | Column = True, allow_literal: bool = True) -> DataFrame:
    """rows (form, pos, ret_lemma, sim, cov, script, sup_lemma, is_acronym) with lemma,
    source and score. The first rule that holds decides:

    blanked function word ▸ irregular form ▸ acronym ▸ trusted retrieval ▸ edited form.
    Irregular forms and the trust test need the router; acronyms and blanking do not.
    """
    on = lambda x: x if isinstance(x, Column) else F.lit(x)
    router, blank, head = on(use_router), on(blank_function_words), on(has_edit_head)
    trust = (F.col("cov") >= cov_thresh) & (F.col("sim") >= min_sim)
    function = blank & F.col("pos").isin(FUNCTION_POS)
    irregular = router & F.col("sup_lemma").isNotNull()
    edit = router & head & ~F.coalesce(trust, F.lit(False))

    def choose(function_value, irregular_value, acronym_value, edited_value, otherwise):
        return F.when(function, function_value).when(irregular, irregular_value).when(F.col("is_acronym"), acronym_value).when(edit, edited_value).otherwise(otherwise)

    edited = apply_script(F.col("form"), F.col("script"), allow_literal)
    lit = F.lit
    return rows.withColumns(
        {
            "lemma": choose(lit(""), F.col("sup_lemma"), F.col("form"), edited, F.col("ret_lemma")),
            "source": choose(lit("function"), lit("suppletive"), lit("acronym"), lit("transduced"), lit("retrieved")),
            "score": choose(F.col("sim"), lit(1.0), F.col("sim"), F.col("sim"), F.col("sim")),
        }
    )


def with_bank_flag(rows: DataFrame, bank: DataFrame, lemma: str = "lemma") -> DataFrame:
    """rows with in_bank: whether the lemma is a bank lemma."""
    known = bank.select(F.col("lemma").alias("_known")).distinct()
    return rows.join(known.hint("merge"), F.col(lemma) == F.col("_known"), "left").withColumn("in_bank", F.col("_known").isNotNull()).drop("_known")


def worth_annotating(lemma: Column, pos: Column, in_bank: Column) -> Column:
    """A real gap: open class, not in the bank, a valid lemma without clitic noise."""
    return ~pos.isin(CLOSED_POS) & ~in_bank & is_valid_lemma(strip_lemma_noise(lemma))


def miss_log(pred: DataFrame, min_sim: float = 0.0, cov_thresh: float = 0.6) -> DataFrame:
    """Rows of route() and with_bank_flag() that point to a gap in the bank, with the
    reason. Only rows that reached the retrieval branch are looked at."""
    cov_low, sim_low = F.col("cov") < cov_thresh, F.col("sim") < min_sim
    rows = pred.where(F.col("source").isin("retrieved", "transduced")).where(cov_low | sim_low)
    rows = rows.where(worth_annotating(F.col("lemma"), F.col("pos"), F.col("in_bank")))
    reason = F.concat_ws("+", F.when(cov_low, "coverage_low"), F.when(sim_low, "sim_low"), F.when(F.col("lemma") == F.col("form"), "copy_fallback"))
    keep = [c for c in pred.columns if c in ("row_id", "doc_id")]
    return rows.select(*keep, F.col("form").alias("wordform"), F.col("pos").alias("predicted_pos"), F.col("lemma").alias("predicted_lemma"), F.col("ret_lemma").alias("retrieved_lemma"), F.round("cov", 4).alias("coverage"), F.round("sim", 4).alias("sim"), reason.alias("reason"))


def miss_worklist(misses: DataFrame, order: str = "row_id") -> DataFrame:
    """Misses by (wordform, predicted_pos), most frequent first: first lemmas, mean
    figures, most frequent reason (the least of several)."""
    g = misses.groupBy("wordform", "predicted_pos").agg(
        F.count("*").alias("count"),
        F.min_by("predicted_lemma", order).alias("predicted_lemma"),
        F.min_by("retrieved_lemma", order).alias("retrieved_lemma"),
        F.avg("coverage").alias("mean_coverage"),
        F.avg("sim").alias("mean_sim"),
        F.mode("reason", True).alias("reason"),
    )
    return g.orderBy(F.desc("count"), "wordform", "predicted_pos")
