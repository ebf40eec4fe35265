"""Token predictions to document records and search-engine token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .router import worth_annotating


def es_stream(pred: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, start_offset, end_offset, position, type) of non-empty lemmas;
    position counts from 0 in the order of the text."""
    kept = pred.where("lemma <> ''")
    position = F.row_number().over(W.partitionBy(key).orderBy("start", "end")) - 1
    return kept.select(key, F.col("lemma").alias("token"), F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), position.alias("position"), F.lit("lemma").alias("type"))


def analyzed_text(pred: DataFrame, key: str = "doc_id") -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("start", "lemma")))
    return pred.groupBy(key).agg(F.array_join(F.filter(F.transform(items, lambda x: x["lemma"]), lambda x: x != ""), " ").alias("analyzed_text"))


def doc_unknown(pred: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, lemma, pos, count, first_start): edited forms that are gaps, by
    surface token; lemma and tag of the first occurrence."""
    rows = pred.where((F.col("source") == "transduced") & worth_annotating(F.col("lemma"), F.col("pos"), F.col("in_bank")))
    return rows.groupBy(key, "token").agg(F.min_by("lemma", "start").alias("lemma"), F.min_by("pos", "start").alias("pos"), F.count("*").alias("count"), F.min("start").alias("first_start"))


def doc_records(pred: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One record for each document: text, tokens, analyzed_text, es_tokens, unknown.
    The predictions are shuffled once, by document; everything else happens in the
    arrays of a document. Documents without a word token have empty lists."""
    worth = (F.col("source") == "transduced") & worth_annotating(F.col("lemma"), F.col("pos"), F.col("in_bank"))
    item = F.struct("start", "end", "token", "lemma", "pos", "source", "score", "sent_id", worth.alias("gap"))
    grouped = pred.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("ts"))
    full = docs.select(key, text).join(grouped.hint("merge"), key, "left").withColumn("ts", F.coalesce("ts", F.expr("array()")))
    tokens = F.transform("ts", lambda t: F.struct(*[t[c].alias(c) for c in ("token", "start", "end", "lemma", "pos", "source", "score", "sent_id")]))
    shown = F.filter("ts", lambda t: t["lemma"] != "")
    es = F.transform(shown, lambda t, i: F.struct(t["lemma"].alias("token"), t["start"].alias("start_offset"), t["end"].alias("end_offset"), i.alias("position"), F.lit("lemma").alias("type")))
    # gaps by token and place: each token is a run, whose first row and length count
    gap = F.transform(F.filter("ts", lambda t: t["gap"]), lambda t: F.struct(*[t[c].alias(c) for c in ("token", "start", "lemma", "pos")]))
    full = full.withColumn("gaps", F.array_sort(gap))
    begins = F.filter(F.transform("gaps", lambda g, i: i), lambda i: (i == 0) | ~F.get("gaps", i)["token"].eqNullSafe(F.get("gaps", i - 1)["token"]))
    full = full.withColumn("runs", begins)

    def unknown(i, k):
        first = F.get("gaps", i)
        n = F.coalesce(F.get("runs", k + 1), F.size("gaps")) - i
        return F.struct(first["start"].alias("start"), first["token"].alias("token"), first["lemma"].alias("lemma"), first["pos"].alias("pos"), n.cast("long").alias("count"))

    gathered = F.transform(F.array_sort(F.transform("runs", unknown)), lambda u: F.struct(*[u[c].alias(c) for c in ("token", "lemma", "pos", "count")]))
    return full.select(key, text, tokens.alias("tokens"), F.array_join(F.transform(shown, lambda t: t["lemma"]), " ").alias("analyzed_text"), es.alias("es_tokens"), gathered.alias("unknown"))
