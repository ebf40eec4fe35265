"""Text functions as Column expressions. Only Unicode composition needs Python."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import PLAIN_QUOTES, QUOTES

HEB = "א-ת"
BLOCK = "֐-׿"
SPACE = r"[\s\x1c-\x1f]"
#: Where a line may end for Python's str.splitlines.
LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SENTENCE_BREAK = rf"(?U){LINE_END}|(?<=[.!?…]){SPACE}+"
SENTENCE_WORD = rf"[A-Za-z{BLOCK}0-9'\"׳״/\-]+"
TOKEN = rf"(?U)\d+(?:[.,]\d+)+|[A-Za-z{BLOCK}0-9]+(?:[\"'׳״/][A-Za-z{BLOCK}0-9]+)*|[^\s\x1c-\x1f]"
GENDER_SLASH = rf"([{HEB}]{{2,}})/(?:ה|ן|י|ת|ות|ים|ית|יות)(?![{HEB}])"


@F.arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        out.append("" if t is None else t if t.isascii() else unicodedata.normalize("NFC", t))
    return pa.array(out, pa.string())


def normalize_text(col: Column) -> Column:
    """Canonical composition, then quotes and primes as ASCII; null becomes empty."""
    return F.translate(nfc(col), QUOTES, PLAIN_QUOTES)


def collapse_gender_slash(col: Column) -> Column:
    """Drop a slashed gender ending after at least two Hebrew letters, unless more
    letters follow; null becomes empty."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), GENDER_SLASH, "$1")


def sentence_tokens(col: Column) -> Column:
    """Word tokens of a sentence, gender slashes collapsed; hyphens and slashes are
    trimmed from the ends, quotes stay."""
    raw = F.regexp_extract_all(collapse_gender_slash(col), F.lit(SENTENCE_WORD), F.lit(0))
    return F.filter(F.transform(raw, lambda x: F.btrim(x, F.lit("/-"))), lambda x: x != "")


def trim_space(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def sentences(col: Column) -> Column:
    """array<struct<sent_id, start, end, text>> with code-point offsets, so that the
    text from start to end is the sentence."""
    parts = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), SENTENCE_BREAK), trim_space), lambda x: x != "")
    none = F.array().cast("array<struct<sent_id:int,start:int,end:int,text:string>>")
    begin = F.struct(F.lit(1).alias("at"), none.alias("out"))

    return F.aggregate(parts, begin, lambda acc, x: _sentence_step(acc, x, col), lambda acc: acc["out"])


def _sentence_step(acc: Column, x: Column, col: Column) -> Column:
    start = F.call_function("locate", x, col, acc["at"])
    end = start + F.char_length(x)
    one = F.struct(F.size(acc["out"]).alias("sent_id"), (start - 1).alias("start"), (end - 1).alias("end"), x.alias("text"))
    return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))


def doc_tokens(sentence: Column) -> Column:
    """array<struct<token, start, end>> of one sentence, offsets within it. Only white
    space lies between tokens, so a search from the last end finds each at its place."""
    none = F.array().cast("array<struct<token:string,start:int,end:int>>")

    def step(acc, x):
        start = F.call_function("locate", x, sentence, acc["at"])
        end = start + F.char_length(x)
        one = F.struct(x.alias("token"), (start - 1).alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0)), F.struct(F.lit(1).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def has_word_char(col: Column) -> Column:
    return col.rlike(f"[0-9A-Za-z{BLOCK}]")


def is_valid_lemma(col: Column) -> Column:
    """At least two characters, a Hebrew one among them, and no digit."""
    return (F.char_length(col) >= 2) & col.rlike(f"[{BLOCK}]") & ~col.rlike(r"\p{Nd}")


def strip_lemma_noise(col: Column) -> Column:
    return F.translate(col, "־- \t", "")


def span(form: Column, sentence: Column) -> tuple[Column, Column]:
    """Offsets of the first occurrence of form in sentence, or (0, length)."""
    at = F.call_function("locate", form, sentence)
    n = F.char_length(form)
    return F.when(at > 0, at - 1).otherwise(0), F.when(at > 0, at - 1 + n).otherwise(n)


def clean_wikitext(col: Column) -> Column:
    """Markup off: templates, links (their display text stays), tags, emphasis."""
    s = F.regexp_replace(col, r"\{{2}[^}]*\}{2}", "")
    s = F.regexp_replace(s, r"\[{2}(?:[^|\]]*\|)?([^|\]]+)\]{2}", "$1")
    s = F.regexp_replace(s, r"<[^>]+>", "")
    s = F.replace(F.replace(s, F.lit("'''"), F.lit("")), F.lit("''"), F.lit(""))
    return F.btrim(F.regexp_replace(trim_space(s), rf"(?U){SPACE}+", " "), F.lit(" .;:"))


def extract_defs(wikitext: Column) -> Column:
    """Cleaned definitions: the lines that begin with # but not with #:, #* or ##."""
    lines = F.split(F.coalesce(wikitext, F.lit("")), rf"\r\n|{LINE_END}")
    lines = F.filter(lines, lambda x: x.rlike(r"^#(?![:*#])"))
    return F.filter(F.transform(lines, lambda x: clean_wikitext(F.substring(x, 2, 1 << 30))), lambda x: x != "")


def strip_niqqud(col: Column) -> Column:
    return trim_space(F.regexp_replace(col, "[֑-ׇ]", ""))


def join_lemmas(lemmas: Column) -> Column:
    return F.array_join(F.filter(lemmas, lambda x: x != ""), " ")
