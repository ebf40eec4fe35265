"""The lemmatizer as one declarative plan over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.edits import coverage
from ..operators import assemble, gates, retrieve, router, tokens
from ..operators.encode import Encoder, predicted_pos
from ..sources.files import raw_docs, text_docs


EXTRA = ("ret_lemma", "sim", "cov", "in_bank")


def _free(taken, name: str) -> str:
    """name with underscores added until neither it nor it with one more is taken."""
    taken = {c.lower() for c in taken}
    while name in taken or f"{name}_" in taken:
        name += "_"
    return name


def _own(columns, name: str) -> str:
    """The column that _free() named, beside columns of the caller."""
    while f"{name}_" in columns:
        name += "_"
    return name


@dataclass
class Lemmatizer:
    """bank: (lemma_id, lemma, pos_tags, source, embedding). scripts: (script_id,
    script). suppletives: (surface, upos, lemma). acronyms: (surface). Options are
    those of the router; true_offsets pools the mention at its own place instead of
    the first occurrence of the form in its sentence."""

    bank: DataFrame
    encoder: Encoder
    scripts: DataFrame | None = None
    suppletives: DataFrame | None = None
    acronyms: DataFrame | None = None
    use_router: bool = True
    cov_thresh: float = 0.60
    min_sim: float = 0.0
    use_pos_filter: bool = True
    keep_unknown_pos: bool = False
    blank_function_words: bool = False
    allow_literal: bool = True
    true_offsets: bool = False

    def __post_init__(self):
        if "embedding" not in self.bank.columns:
            raise ValueError("the bank has no embeddings: add them with Encoder.encode_lemma")

    @property
    def contextual(self) -> bool:
        return getattr(self.encoder, "contextual", True)

    def lemmatize(self, items: DataFrame, row_id: str | None = None) -> DataFrame:
        """items (form, sentence?, pos?, ...) with form normalized, lemma, pos (the
        predicted tag, instead of the given one), score, source; other columns pass.

        Also ret_lemma, sim, cov, in_bank, for the miss log and the documents, with
        underscores added where items has such columns. Each distinct (form, sentence,
        given tag), or (form, given tag) for an encoder that reads no sentence, is encoded
        and retrieved once, so repeated words cost one join."""
        rest = [c for c in items.columns if c not in ("form", "sentence", "pos", "lemma", "score", "source")]
        key = _free(rest, "_key")
        passed = [F.col(f"`{c}`") for c in rest]
        form = F.col("form").cast("string")
        given = F.col("sentence").cast("string") if self.contextual and "sentence" in items.columns else F.lit(None).cast("string")
        tag = F.col("pos").cast("string") if "pos" in items.columns else F.lit(None).cast("string")
        places = [c for c in ("start", "end") if self.contextual and self.true_offsets and c in rest]
        keys = ["form", "sentence", "pos_in", *places]
        rows = items.select(*passed, F.struct(form.alias("form"), F.nullif(given, F.lit("")).alias("sentence"), F.nullif(tag, F.lit("")).alias("pos_in"), *places).alias(key))
        # 128 bits name a row, so that no two share a name at any size
        once = rows.select(F.col(key).alias("_in")).distinct().withColumn("row", F.md5(F.to_json("_in")))
        once = once.select("_in", "row", *[F.col(f"_in.{c}").alias(c) for c in keys])
        once = once.withColumns({"form": T.normalize_text(F.col("form")), "sentence": T.normalize_text(F.coalesce("sentence", "form"))})
        if "start" in places:
            at = (F.col("start"), F.col("end"))
        else:
            at = T.span(F.col("form"), F.col("sentence"))
        once = once.withColumns({"span_start": at[0], "span_end": at[1]})
        enc = self.encoder.encode_query(once, "form", "sentence", "span_start", "span_end")
        enc = enc.withColumn("pos", predicted_pos(F.col("pos_logits")))
        edit = F.when(F.col("edit_logits").isNotNull(), F.array_position("edit_logits", F.array_max("edit_logits")) - 1).cast("int")
        found = retrieve.top1(enc.withColumnRenamed("pos", "pos_pred"), self.bank, "row", pos="pos_in" if self.use_pos_filter else None, keep_unknown_pos=self.keep_unknown_pos)
        # the planner takes rows from Python for as small as their files and would broadcast
        # them: large joins are merges
        names = self.bank.select("lemma_id", F.col("lemma").alias("ret_lemma"))
        pred = enc.select("_in", "form", "row", "pos", edit.alias("script_id")).join(found.hint("merge"), "row").join(names.hint("merge"), "lemma_id")
        if self.scripts is None:
            pred = pred.withColumn("script", F.lit(None).cast("string"))
        else:
            pred = pred.join(self.scripts.select("script_id", "script"), "script_id", "left")
        pred = gates.add_gates(pred.withColumn("cov", coverage(F.col("form"), F.col("ret_lemma"))), self.suppletives, self.acronyms)
        pred = router.route(pred, self.use_router, self.min_sim, self.cov_thresh, self.blank_function_words, F.col("script").isNotNull(), self.allow_literal)
        pred = router.with_bank_flag(pred, self.bank)
        on = None
        for k in keys:
            c = rows[key][k].eqNullSafe(pred["_in"][k])
            on = c if on is None else on & c
        both = rows.join(pred.hint("merge"), on)
        extra = [pred[c].alias(_free(rest, c)) for c in EXTRA]
        return both.select(*[rows[f"`{c}`"] for c in rest], *[pred[c] for c in ("form", "lemma", "pos", "score", "source")], *extra)

    def annotate(self, sentences: DataFrame, text: str = "text") -> DataFrame:
        """Every word of each sentence in context: normalized first, then tokenized."""
        rest = [c for c in sentences.columns if c != text]
        norm = sentences.select(*rest, T.normalize_text(F.col(text)).alias("sentence"))
        words = norm.select(*rest, "sentence", F.posexplode(T.sentence_tokens(F.col("sentence"))).alias("tok_idx", "form"))
        return self.lemmatize(words)

    def token_predictions(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """One row for each word token of the original text, with its prediction."""
        toks = tokens.tokens(docs, text, key, with_sentence=self.contextual)
        return self.lemmatize(toks.withColumn("form", T.collapse_gender_slash(F.col("token"))))

    def documents(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        return assemble.doc_records(self.token_predictions(docs, key, text), docs, key, text)

    def lemmatize_text(self, spark: SparkSession, source: str, is_path: bool = False, recursive: bool = True, files_glob: str = "*.txt") -> DataFrame:
        """Records of raw text, of one file, or of the files of a folder by rel_path."""
        if not is_path:
            return self.documents(raw_docs(spark, source)).drop("doc_id")
        docs = text_docs(spark, source, recursive, files_glob)
        out = self.documents(docs, "rel_path")
        return out.join(docs.select("rel_path", "path"), "rel_path").orderBy("rel_path")

    def lemma(self, spark: SparkSession, form: str, sentence: str | None = None) -> str:
        row = self.lemmatize(spark.createDataFrame([(form, sentence)], "form string, sentence string")).first()
        return row["lemma"]

    def misses(self, pred: DataFrame) -> DataFrame:
        """The miss log of predictions: a derived table, not state of the object."""
        if not self.use_router or self.scripts is None:
            pred = pred.where("false")
        own = {c: _own(pred.columns, c) for c in EXTRA}
        pred = pred.drop(*[c for c, x in own.items() if x != c]).withColumnsRenamed({x: c for c, x in own.items() if x != c})
        return router.miss_log(pred, self.min_sim, self.cov_thresh)
