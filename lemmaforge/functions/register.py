"""The functions under their SQL names."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..schema import FINALS, MEDIALS, PLAIN_QUOTES, QUOTES, SEP
from .edits import lcs_share, script_of
from .text import GENDER_SLASH

_QUOTES = str.maketrans(QUOTES, PLAIN_QUOTES)
_FINAL = dict(zip(MEDIALS, FINALS))
_SLASH = re.compile(GENDER_SLASH)


def normalize(s: str | None) -> str:
    composed = unicodedata.normalize("NFC", s) if s else ""
    return composed.translate(_QUOTES)


def edit(word: str, script: str) -> str:
    """apply_script() for one pair of strings."""
    parts = script.split(SEP)
    if parts[0] == "R" and len(parts) > 1:
        return script[2:]
    if len(parts) != 4 or not all(p.strip().isascii() and p.strip().isdigit() for p in (parts[0], parts[2])):
        return word
    pre, suf = int(parts[0]), int(parts[2])
    if pre + suf > len(word):
        return word
    out = parts[1] + word[pre : len(word) - suf] + parts[3]
    return out[:-1] + _FINAL.get(out[-1], out[-1]) if out else out


def register(spark: SparkSession) -> None:
    """normalize_text, collapse_gender_slash, coverage, derive_script, apply_script as
    SQL functions (Arrow batches), and the table function tokenize_doc(text)."""
    from ..operators.tokens import token_spans

    def scalar(name, f, kind):
        spark.udf.register(name, F.udf(lambda *a: None if any(x is None for x in a) else f(*a), kind, useArrow=True))

    spark.udf.register("normalize_text", F.udf(normalize, "string", useArrow=True))
    scalar("collapse_gender_slash", lambda s: _SLASH.sub(r"\1", s), "string")
    scalar("coverage", lcs_share, "double")
    scalar("derive_script", script_of, "string")
    scalar("apply_script", edit, "string")

    @F.udtf(returnType="sent_id int, token string, start int, end int, nospace boolean")
    class TokenizeDoc:
        def eval(self, text: str):
            words, starts, ends, sent, nospace = token_spans(text or "")
            for row in zip(sent.tolist(), words, starts.tolist(), ends.tolist(), nospace.tolist()):
                yield row

    spark.udtf.register("tokenize_doc", TokenizeDoc)
