"""Operator 9: personal data by bootstrapped contextual extraction."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, lean, small, small_batches, stored, table

MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.9
MIN_SCORE = 0.9
# a candidate has so many characters or more; its context is sought so far before and after
MIN_LENGTH = 4
BEFORE, AFTER = 80, 60

# every seed has one of these; Cn: digits that Python knows and this Java does not
TRACE = r"[\p{Nd}\p{Cn}@=:]|A[KS]IA"
_TRACE = re.compile(r"[\d@=:]")
_SEEDS = [
    ("EMAIL", re.compile(r"(?<![\w.+%-])[\w.+%-]++@[\w-]++(?:\.[\w-]*\w)+")),
    ("SECRET", re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?([^\s\"',;]{6,})")),
    ("SECRET", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("PHONE", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){3,4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]|\.\d)")),
    ("IP", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")),
    ("CARD", re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\w)")),
    ("SSN", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("IBAN", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
]
# a run is tried once, at its start, so that long ones cost no more than their length
_CANDIDATE = re.compile(r"(?<![^\s=:\"'<>])(?=[^\s=:\"'<>\d@]*+[\d@])[^\s=:\"'<>]++")
_EDGE = ".,;:!?#%$&*()[]{}<>\"'|"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "IP":
        return all(int(x) < 256 for x in found.split("."))
    if kind == "CARD":
        digits = re.sub(r"\D", "", found)
        return digits[0] in "3456" and _luhn(digits)
    if kind == "IBAN":
        plain = found.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return True


def _traced(text: str) -> bool:
    return _TRACE.search(text) is not None or "AKIA" in text or "ASIA" in text


def seeds(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) that a strict recognizer takes by itself; where two
    overlap, the earlier recognizer of the list wins."""
    if not _traced(text):
        return []
    out: list[tuple[int, int, str]] = []
    for kind, pattern in _SEEDS:
        for m in pattern.finditer(text):
            a, b = m.span(1) if kind == "SECRET" and pattern.groups else m.span()
            while b > a and text[b - 1] in _EDGE:
                b -= 1
            if b > a and _valid(kind, text[a:b]):
                out.append((a, b, kind))
    return _disjoint(out)


def _disjoint(spans):
    """Sorted spans without overlaps; of overlapping ones the first given stays."""
    taken, kept = [], []
    for s in sorted(enumerate(spans), key=lambda x: (x[1][0], x[0])):
        taken.append((s[0], *s[1]))
    for order, a, b, kind in taken:
        if kept and a < kept[-1][2]:
            if order < kept[-1][0]:
                kept[-1] = (order, a, b, kind)
            continue
        kept.append((order, a, b, kind))
    return [x[1:] for x in kept]


def shape(value: str) -> str:
    """Runs of character classes with their lengths; long mixtures of letters and
    digits are one class, as their runs are accidental."""
    if len(value) >= 12 and value.isalnum() and not value.isdigit():
        return f"x{len(value)}"
    out, last, n = [], "", 0
    for c in value:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if k == last:
            n += 1
            continue
        if last:
            out.append(f"{last}{n}" if last in "9" else last)
        last, n = k, 1
    return "".join([*out, f"{last}{n}" if last in "9" else last])


def occurrences(text: str) -> list[tuple]:
    """(start, end, kind or None, value, patterns) of seeds and other candidates:
    words of MIN_LENGTH characters or more with a digit or an at sign, without the
    punctuation around them. The context is what stands of words in the BEFORE
    characters before and the AFTER characters after. Time is linear in the text."""
    if not _traced(text):
        return []
    known = seeds(text)
    spans, at = list(known), 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while at < len(known) and known[at][1] <= a:
            at += 1
        if b - a >= MIN_LENGTH and not (at < len(known) and known[at][0] < b):
            spans.append((a, b, None))
    out = []
    for a, b, kind in sorted(spans, key=lambda x: x[:2]):
        value = text[a:b]
        form = shape(value)
        left = text[max(0, a - BEFORE) : a].lower().split()
        right = text[b : b + AFTER].lower().split()
        l1 = left[-1] if left else "^"
        l2 = left[-2] if len(left) > 1 else "^"
        patterns = [f"L1|{l1}|{form}", f"L2|{l2} {l1}|{form}", f"R1|{right[0] if right else '$'}|{form}"]
        out.append((a, b, kind, value, patterns))
    return out


_OCC = pa.schema([("n", pa.int32()), ("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])


def _extract(batches):
    for batch in batches:
        rows = []
        for n, h, text in zip(*(batch.column(c).to_pylist() for c in ("n", "h", "text"))):
            rows += [(n, h, *o) for o in occurrences(text)]
        columns = list(zip(*rows)) or [[]] * len(_OCC)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OCC)], schema=_OCC)


def discover(df: DataFrame, text_col: str = "text", min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """(occurrences, instances): all seeds and candidates of the corpus, by length and
    hash of their text, and the values (value, kind, score) that bootstrapping accepts
    beyond the seeds.

    Seeds have score 1. In each round a pattern (a word or two before, or the word
    after, with the shape of the value) gets for each kind the confidence: sum of the
    scores of its accepted values over the number of its values. Patterns with
    min_support accepted values and min_confidence are used; a value scores one minus
    the product of their misses, and those of min_score are accepted. Rounds end when
    the accepted values, with their kinds and scores, are those of an earlier round.
    Values without a digit or an at sign are found by seeds only. Null and empty texts
    have no occurrence.
    """
    small_batches(df.sparkSession)
    base = df.select(F.col(text_col).alias("text")).where(F.col("text").rlike(TRACE))
    found = stored(base.select(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"), "text").mapInArrow(lean(_extract), "n int, h long, a int, b int, kind string, value string, patterns array<string>"), "pii-occurrences")
    graph = stored(found.select("value", "kind", F.explode("patterns").alias("p")).groupBy("p", "value").agg(F.max("kind").alias("seed")), "pii-graph")
    seeded = graph.where("seed IS NOT NULL").groupBy("value").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0))
    accepted, marks = seeded, set()
    while True:
        held = graph.join(accepted, "value", "left")
        total = held.groupBy("p").agg(F.countDistinct("value").alias("n"))
        hits = held.where("kind IS NOT NULL").groupBy("p", "kind").agg(F.count("*").alias("support"), F.sum("score").alias("mass"))
        good = hits.join(total, "p").withColumn("confidence", F.col("mass") / F.col("n")).where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
        miss = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scored = graph.join(good, "p").groupBy("value", "kind").agg((1 - F.exp(miss)).alias("score")).where(F.col("score") >= min_score)
        best = scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("s")).select("value", "s.kind", "s.score")
        fresh = best.join(seeded.select("value"), "value", "left_anti")
        accepted = stored(seeded.unionByName(fresh), "pii-accepted")
        mark = accepted.agg(F.count("*"), F.sum(F.xxhash64("value", "kind", F.round("score", 6)).cast("decimal(38,0)"))).first()
        if mark in marks:
            break
        marks.add(mark)
    return found, accepted.join(seeded.select("value"), "value", "left_anti")


def redact(text: str, more: list[tuple[int, int, str]] = ()) -> tuple[str, list[str]]:
    """The text with [KIND] for each span, and the kinds in order."""
    spans = _disjoint([*seeds(text), *more])
    if not spans:
        return text, []
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]]), [k for _, _, k in spans]


def redact_corpus(df: DataFrame, text_col: str = "text", kinds_col: str | None = None, **bootstrap) -> DataFrame:
    """df with personal data in text_col replaced by [KIND]; all rows and columns
    kept, and the kinds found in each text, in order, added as kinds_col if named (a
    column of that name is replaced).

    Seeds are found again while the texts stream by. Their values where they stand as
    candidates without a seed's context, and values that bootstrapping found, come as
    spans by length and hash of the text, broadcast if their counted bytes are few,
    else joined by a shuffle.

    Null texts stay null, empty texts empty; texts of any length are read whole. Equal
    texts are treated alike, whatever their identifiers, which are not read; equal
    values are treated alike wherever they stand as candidates. An empty table gives
    no rows. Other columns pass, whatever their names.
    """
    if kinds_col and kinds_col != text_col:
        df = df.drop(kinds_col)
    found, fresh = discover(df, text_col, **bootstrap)
    known = found.where("kind IS NOT NULL").groupBy("value").agg(F.max("kind").alias("kind")).union(fresh.select("value", "kind"))
    spans = found.where("kind IS NULL").drop("kind").join(known, "value")
    n, h, more_col = free_names(df, "_pii_n", "_pii_h", "_pii_spans")
    spans = stored(spans.groupBy(F.col("n").alias(n), F.col("h").alias(h)).agg(F.collect_set(F.struct("a", "b", "kind")).alias(more_col)), "pii-spans")
    at = df.columns.index(text_col)
    total = spans.agg(F.sum(F.size(more_col))).first()[0]
    if total is None:
        wide = df.withColumn(more_col, F.lit(None).cast("array<struct<a:int,b:int,kind:string>>"))
    else:
        here = (F.octet_length(df[text_col]) == spans[n]) & (F.xxhash64(df[text_col]) == spans[h])
        wide = df.join(small(spans, 64 + 48 * total // max(1, spans.count())), here, "left").drop(n, h)
    schema = df.schema
    if kinds_col:
        schema = df.select("*", F.lit(None).cast("array<string>").alias(kinds_col)).schema

    def run(batches):
        for batch in batches:
            texts, kinds = [], []
            for text, more in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                new, seen = (None, []) if text is None else redact(text, [(s["a"], s["b"], s["kind"]) for s in more or []])
                texts.append(new)
                kinds.append(seen)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            if kinds_col:
                columns.append(pa.array(kinds, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return wide.mapInArrow(lean(run), schema)


def op9_pii(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return redact_corpus(documents, kinds_col="kinds").select("doc_id", "text", F.array_join("kinds", ",").alias("kinds"), F.size("kinds").alias("n_pii"))
