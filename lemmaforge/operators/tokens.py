"""Documents to sentences and tokens with offsets into the original text."""

from __future__ import annotations

import re
from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_TOKEN = re.compile(T.TOKEN.removeprefix("(?U)").replace(r"[^\s\x1c-\x1f]", r"\S"))
_PIECE = re.compile(_TOKEN.pattern + r"|\s+")
_BREAK = re.compile(T.LINE_END + r"|(?<=[.!?…])\s")
_CUT = re.compile(T.LINE_END + r"|(?<=[.!?…])\s+")
_WORD = re.compile(f"[0-9A-Za-z{T.BLOCK}]")

_ONE = {chr(c) for c in range(0x590, 0x600)} | set("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Texts that are taken apart at once, and entries of a dictionary of words.
STEP, HELD = 256, 200_000

_SCHEMA = pa.schema([("sent_id", pa.int32()), ("tok_idx", pa.int32()), ("token", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("nospace", pa.bool_())])
TOKEN_COLUMNS = "sent_id int, tok_idx int, token string, start int, end int, nospace boolean"


def token_spans(text: str):
    """(tokens, starts, ends, sentence numbers, nospace flags) of one text.

    Every character that is no white space belongs to a token, so a sentence begins at
    each token with a line end, or white space behind closing punctuation, before it.
    """
    # tokens and runs of white space cover the text: offsets are running lengths
    pieces = _PIECE.findall(text)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int32, len(pieces)), dtype=np.int32)
    kept = ~np.fromiter(map(str.isspace, pieces), bool, len(pieces))
    found = list(compress(pieces, kept))
    starts, ends, n = np.concatenate(([0], ends[:-1])).astype(np.int32)[kept] if pieces else ends, ends[kept], len(found)
    breaks = np.fromiter((m.start() for m in _BREAK.finditer(text)), np.int32)
    if n:
        before = np.searchsorted(breaks, starts)
        sent = np.concatenate(([0], np.cumsum(before[1:] > before[:-1]))).astype(np.int32)
        nospace = np.append(starts[1:] == ends[:-1], False)
    else:
        sent, nospace = np.zeros(0, np.int32), np.zeros(0, bool)
    return found, starts, ends, sent, nospace


def _word_flags(tokens: list[str], lengths: np.ndarray, text: str) -> np.ndarray:
    """Which tokens have a letter or digit: single ones are looked up, and of longer ones
    only numbers in other scripts' digits have none."""
    keep = lengths > 1
    one = np.flatnonzero(~keep)
    keep[one] = np.fromiter((tokens[i] in _ONE for i in one.tolist()), bool, len(one))
    if not text.isascii():
        keep[[i for i, x in enumerate(tokens) if not x.isascii() and _WORD.search(x) is None]] = False
    return keep


def letter_runs(text: str) -> list[str]:
    """The maximal runs of letters of a text."""
    found = _LETTERS.findall(text)
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def first_places(docs: DataFrame) -> DataFrame:
    """docs (tag, base, text): (tag, w, o) for the words of texts, where the n-th word of
    a text has place base + n. Each task gives a word of a tag once for some texts, with
    its first place in them, so a minimum over all remains to be taken."""

    def flat(held):
        for (tag, placed), words in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([tag] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()) if placed else [None] * len(words), pa.int64())], names=["tag", "w", "o"])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 8 * STEP):
                part = batch.slice(lo, 8 * STEP)
                tags, bases, texts = (part.column(c).to_pylist() for c in ("tag", "base", "text"))
                held: dict = {}
                before = None
                # last texts first, so that a first place overwrites later ones
                for i in sorted(range(len(texts)), key=lambda i: (bases[i] is not None, bases[i] or 0), reverse=True):
                    words, base = letter_runs(texts[i] or ""), bases[i]
                    if base is not None and before is not None and base + len(words) > before:
                        yield from flat(held)
                        held = {}
                    own = held.setdefault((tags[i], base is not None), {})
                    words.reverse()
                    own.update(zip(words, range((base or 0) + len(words), base or 0, -1)))
                    before = base
                yield from flat(held)

    return docs.select(F.col("tag").cast("string"), F.col("base").cast("long"), F.lower("text").alias("text")).mapInArrow(run, "tag string, w string, o long")


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, k, w): the words of the lower-case text with their numbers from 1."""
    rows = docs.select(F.col(key).alias("key"), F.lower(text).alias("text"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                found = [letter_runs(t or "") for t in part.column("text").to_pylist()]
                n = np.fromiter(map(len, found), np.int64, len(found))
                k = np.arange(1, n.sum() + 1) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(k, pa.int32()), pa.array([w for f in found for w in f], pa.string())], names=["key", "k", "w"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, k int, w string").withColumnRenamed("key", key)


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(w): the distinct words of the lower-case texts."""

    def run(batches):
        held: set = set()
        flat = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], names=["w"])
        for batch in batches:
            for t in batch.column("text").to_pylist():
                held.update(letter_runs(t or ""))
                if len(held) > HELD:
                    yield flat()
                    held.clear()
        yield flat()

    return docs.select(F.lower(text).alias("text")).mapInArrow(run, "w string").distinct()


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(token, n, docs) of the word tokens, with the number of documents by key. Where no
    key repeats, each task counts by itself; else tokens are counted by document first."""
    seen = docs.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys")).first()
    if seen["n"] != seen["keys"]:
        per_doc = tokens(docs, text, key).groupBy("token", key).agg(F.count("*").alias("n"))
        return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))

    def run(batches):
        n, of = Counter(), Counter()

        def flat():
            words = [w for w in n if _WORD.search(w)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[w] for w in words], pa.int64()), pa.array([of[w] for w in words], pa.int64())], names=["token", "n", "docs"])

        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                for t in batch.column("t").slice(lo, STEP).to_pylist():
                    found = _TOKEN.findall(t or "")
                    n.update(found)
                    of.update(set(found))
                if len(n) > HELD:
                    yield flat()
                    n.clear()
                    of.clear()
        yield flat()

    parts = docs.select(F.col(text).alias("t")).mapInArrow(run, "token string, n long, docs long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of one text, without the white space around."""
    out, at = [], 0
    for m in [*_CUT.finditer(text), None]:
        piece = text[at : m.start() if m else len(text)]
        inner = piece.lstrip()
        start = at + len(piece) - len(inner)
        inner = inner.rstrip()
        if inner:
            out.append((start, start + len(inner)))
        at = m.end() if m else at
    return out


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each sentence: all columns of docs but the text, and sent_id,
    start, end, sentence, in Arrow batches."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).schema
    for name, kind in (("sent_id", "integer"), ("start", "integer"), ("end", "integer"), ("sentence", "string")):
        schema = schema.add(name, kind)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP):
                batch = whole.slice(lo, STEP)
                owner, ids, starts, ends, found = [], [], [], [], []
                for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    for k, (a, b) in enumerate(sentence_spans(t or "")):
                        owner.append(i)
                        ids.append(k)
                        starts.append(a)
                        ends.append(b)
                        found.append(t[a:b])
                take = pa.array(owner, pa.int32())
                new = [pa.array(x, pa.int32()) for x in (ids, starts, ends)] + [pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(len(rest))), *new], names=schema.names)

    return docs.select(*rest, text).mapInArrow(run, schema)


def sentences_native(docs: DataFrame, text: str = "text") -> DataFrame:
    """sentences() without Python."""
    rest = [c for c in docs.columns if c != text]
    out = docs.select(*rest, F.explode(T.sentences(F.col(text))).alias("_s"))
    return out.select(*rest, "_s.sent_id", "_s.start", "_s.end", F.col("_s.text").alias("sentence"))


def tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", words_only: bool = True, with_sentence: bool = False) -> DataFrame:
    """(key, sent_id, tok_idx, token, start, end, nospace), one row for each token, in
    Arrow batches. words_only drops tokens without a letter or digit; tok_idx counts
    what stays. with_sentence adds the text of each token's sentence."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                names, texts = batch.column("k").slice(lo, STEP), batch.column("t").slice(lo, STEP).to_pylist()
                owner, words, parts, held, sentence_of = [], [], [], [], []
                for i in range(len(texts)):
                    if not texts[i]:
                        continue
                    w, starts, ends, sent, nospace = token_spans(texts[i])
                    if words_only:
                        keep = _word_flags(w, ends - starts, texts[i])
                        w = list(compress(w, keep))
                        starts, ends, sent, nospace = starts[keep], ends[keep], sent[keep], nospace[keep]
                    owner.append(np.full(len(w), i, np.int64))
                    words += w
                    if with_sentence:
                        sentence_of.append(sent.astype(np.int64) + len(held))
                        held += [texts[i][a:b] for a, b in sentence_spans(texts[i])]
                    parts.append((sent, np.arange(len(w), dtype=np.int32), starts, ends, nospace))
                if not parts:
                    continue
                sent, idx, starts, ends, nospace = (np.concatenate(x) for x in zip(*parts))
                columns = [names.take(pa.array(np.concatenate(owner))), pa.array(sent), pa.array(idx), pa.array(words, pa.string()), pa.array(starts), pa.array(ends), pa.array(nospace)]
                if not with_sentence:
                    yield pa.RecordBatch.from_arrays(columns, names=["k", *_SCHEMA.names])
                    continue
                # a long sentence is repeated for each of its words: batches of bounded size
                at = np.concatenate(sentence_of)
                size = np.cumsum(np.fromiter(map(len, held), np.int64, len(held))[at]) // (16 << 20)
                whole = pa.RecordBatch.from_arrays(columns, names=["k", *_SCHEMA.names])
                for n in np.unique(size):
                    s, e = np.searchsorted(size, [n, n + 1])
                    part = whole.slice(s, e - s)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([held[j] for j in at[s:e].tolist()], pa.string())], names=["k", *_SCHEMA.names, "sentence"])

    more = ", sentence string" if with_sentence else ""
    return rows.mapInArrow(run, f"k {kind}, {TOKEN_COLUMNS}{more}").withColumnRenamed("k", key)


def tokens_native(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """tokens(words_only=False) without Python, for engines that must stay in the JVM."""
    s = docs.select(key, F.col(text).alias("t"), F.explode(T.sentences(F.col(text))).alias("s"))
    t = s.select(key, "t", "s.sent_id", F.col("s.start").alias("off"), F.explode(T.doc_tokens(F.col("s.text"))).alias("x"))
    t = t.select(key, "sent_id", F.col("x.token").alias("token"), (F.col("off") + F.col("x.start")).alias("start"), (F.col("off") + F.col("x.end")).alias("end"), "t")
    nospace = F.substr(F.col("t"), F.col("end") + 1, F.lit(1)).rlike(r"(?U)[^\s\x1c-\x1f]")
    t = t.withColumn("nospace", nospace).drop("t")
    return t.withColumn("tok_idx", F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY start) - 1")).select(key, "sent_id", "tok_idx", "token", "start", "end", "nospace")
