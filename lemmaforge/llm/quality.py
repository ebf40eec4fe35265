"""Operator 6: quality classifier by ordinal cumulative-link regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, small_batches, table, word_hashes

BITS = 18
MAX_LABELLED = 12_000
EPOCHS = 30
TAIL_GRADE = 2
# of 0.3, 0.4, 0.5 and 0.7 the one that suits the labelled rows of sf0.1 best in four folds
MIN_TAIL = 0.5
L2 = 1e-4

# a marker stands in so many rows of the grade below the best, at such log-odds against
# the best grade, and rows times log-odds reach so much; the scale of the feature
MARK_ROWS, MARK_ODDS, MARK_WEIGHT, MARK_SCALE = 3, 2.0, 12.0, 10.0

# class of each byte for the shape of a word: lower, upper, digit, other marks apart
_CLASS = np.arange(256, dtype=np.uint64) + np.uint64(16)
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 1
_CLASS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 2
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = 3
_CLASS[128:] = 1
_LETTER = np.zeros(256, bool)
_LETTER[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
_LETTER[128:] = True


def _features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed feature, value) of all texts.

    For each word: its letters in lower case, the set-like sum of its runs of
    character classes (its shape), and whether it repeats the word before it. A
    feature's value is log(1 + count) over the norm of the text's values.
    """
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    doc = np.repeat(np.arange(len(texts)), counts)
    raw = b" ".join(" ".join(w).encode("utf-8", "replace") for w in words if w) + b" "
    low = np.frombuffer(raw.lower(), np.uint8)
    if not counts.sum():
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.float32)
    # letters only, spaces kept
    kept = low[_LETTER[low] | (low == 32)]
    plain, _ = word_hashes(kept.tobytes())
    b = np.frombuffer(raw, np.uint8)
    cls = _CLASS[b]
    fresh = np.ones(len(b), bool)
    fresh[1:] = cls[1:] != cls[:-1]
    ends = np.flatnonzero(b == 32)
    total = np.concatenate(([np.uint64(0)], np.cumsum(np.where(fresh, mix(cls), np.uint64(0)))))
    starts = np.concatenate(([0], ends[:-1] + 1))
    shape = mix(total[ends] - total[starts] + np.uint64(77))
    again = np.zeros(len(plain), bool)
    again[1:] = (plain[1:] == plain[:-1]) & (doc[1:] == doc[:-1])
    mask = np.uint64((1 << bits) - 1)
    code = np.concatenate([plain & mask, shape & mask, np.full(int(again.sum()), mix(np.array([5], np.uint64))[0] & mask)]).astype(np.int64)
    of = np.concatenate([doc, doc, doc[again]])
    both, n = np.unique((of << bits) | code, return_counts=True)
    of, code = both >> bits, both & ((1 << bits) - 1)
    value = np.log1p(n).astype(np.float32)
    norm = np.sqrt(np.bincount(of, weights=value * value, minlength=len(texts)))
    return of, code, (value / norm[of]).astype(np.float32)


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(weights . x - thresholds[k]), one weight vector for all
    thresholds, which ascend. The last feature comes from the markers in a text: few
    words can spoil a text of any length, which values over the norm do not tell."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS
    markers: np.ndarray | None = None

    def tails(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.thresholds)))
        for a, b in chunks(texts, 2 << 20):
            of, code, value = _features(texts[a:b], self.bits)
            score = np.bincount(of, weights=self.weights[code] * value, minlength=b - a)
            if self.markers is not None:
                score = score + self.weights[1 << self.bits] * _marked(np.bincount(of, weights=self.markers[code], minlength=b - a))
            out[a:b] = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))
        return out


def _marked(odds: np.ndarray) -> np.ndarray:
    """The marker feature of the sums of log-odds of texts."""
    return MARK_SCALE * np.log1p(odds)


def _odds(low, high, n_low, n_high) -> np.ndarray:
    """Log-odds of features in low of n_low rows of the lower grade and in high of
    n_high rows of the best one; 0 where that does not make a marker."""
    share = (low + high) / max(1, n_low + n_high)
    odds = np.log((low + share + 1e-9) / (n_low + 1)) - np.log((high + share + 1e-9) / (n_high + 1))
    return np.where((low >= MARK_ROWS) & (odds > MARK_ODDS) & (low * odds > MARK_WEIGHT), odds, 0.0)


def fit_marked(codes: list[np.ndarray], values: list[np.ndarray], grades, levels: int, bits: int = BITS, epochs: int = EPOCHS) -> OrdinalModel:
    """fit_ordinal with the marker feature. A row's own words do not count among the
    markers it is fitted with, so that rare words of a single text teach nothing."""
    y = np.asarray(grades, np.int64)
    low, high, n_low, n_high = np.zeros(1 << bits), np.zeros(1 << bits), np.sum(y == levels - 2), np.sum(y == levels - 1)
    for c, g in zip(codes, y):
        if g >= levels - 2:
            (low if g == levels - 2 else high)[c] += 1
    own = []
    for c, g in zip(codes, y):
        a, b = int(g == levels - 2), int(g == levels - 1)
        own.append(_marked(_odds(low[c] - a, high[c] - b, n_low - a, n_high - b).sum()))
    last = np.array([1 << bits], np.int32)
    model = fit_ordinal([np.append(c, last) for c in codes], [np.append(v, np.float32(x)) for v, x in zip(values, own)], y, levels, bits, epochs, L2)
    model.markers = _odds(low, high, n_low, n_high).astype(np.float32)
    return model


def fit_ordinal(codes: list[np.ndarray], values: list[np.ndarray], grades, levels: int, bits: int = BITS, epochs: int = EPOCHS, l2: float = 3e-6, rate: float = 0.3) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by AdaGrad over mini-batches
    in a fixed order. Thresholds are t0 and t0 plus positive gaps, so they ascend."""
    y = np.asarray(grades, np.int64)
    code = np.concatenate([*codes, np.zeros(0, np.int32)]).astype(np.int64)
    value = np.concatenate([*values, np.zeros(0, np.float32)])
    of = np.repeat(np.arange(len(y)), [len(c) for c in codes])
    begin = np.searchsorted(of, np.arange(len(y) + 1))
    # one more than the hashed features
    w, gw = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-8)
    share = [np.clip(np.mean(y > k) if len(y) else 0.5, 1e-3, 1 - 1e-3) for k in range(levels - 1)]
    start = -np.log(np.array(share) / (1 - np.array(share)))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    graw = np.full(levels - 1, 1e-8)
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for s in range(0, len(order), 256):
            rows = order[s : s + 256]
            at = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows])
            of_row = np.repeat(np.arange(len(rows)), begin[rows + 1] - begin[rows])
            score = np.bincount(of_row, weights=w[code[at]] * value[at], minlength=len(rows))
            gaps = np.exp(raw[1:])
            theta = raw[0] + np.concatenate(([0.0], np.cumsum(gaps)))
            cut = np.concatenate(([-np.inf], theta, [np.inf]))
            hi, lo = 1 / (1 + np.exp(np.clip(score - cut[y[rows] + 1], -50, 50))), 1 / (1 + np.exp(np.clip(score - cut[y[rows]], -50, 50)))
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi), lo * (1 - lo)
            # derivative of -log p
            ds = (dhi - dlo) / p
            dtheta = np.zeros(levels - 1)
            k = y[rows]
            inner = k < levels - 1
            np.add.at(dtheta, k[inner], -dhi[inner] / p[inner])
            inner = k > 0
            np.add.at(dtheta, k[inner] - 1, dlo[inner] / p[inner])
            g = np.bincount(code[at], weights=ds[of_row] * value[at], minlength=len(w)) / len(rows)
            used = np.unique(code[at])
            g = g[used] + l2 * w[used]
            gw[used] += g * g
            w[used] -= rate * g / np.sqrt(gw[used])
            draw = np.concatenate(([dtheta.sum()], np.cumsum(dtheta[::-1])[::-1][1:] * gaps)) / len(rows)
            graw += draw * draw
            raw -= 0.1 * draw / np.sqrt(graw)
    theta = raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))
    return OrdinalModel(w.astype(np.float32), theta, bits)


def _read_features(bits: int):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            codes, values = [], []
            for a, b in chunks(texts, 2 << 20):
                of, code, value = _features(texts[a:b], bits)
                cut = np.searchsorted(of, np.arange(b - a + 1))
                codes += [code[s:e].astype(np.int32).tobytes() for s, e in zip(cut, cut[1:])]
                values += [value[s:e].tobytes() for s, e in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.array(codes, pa.binary()), pa.array(values, pa.binary())], names=["id", "grade", "codes", "values"])

    return run


def train(df: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = 3, max_labelled: int = MAX_LABELLED, bits: int = BITS, epochs: int = EPOCHS) -> OrdinalModel | None:
    """Fit on at most max_labelled rated documents, those with the least MD5 of the
    identifier: a sample that depends on no order of rows. ratings: (id, grade),
    grades 0 .. levels - 1; an identifier rated twice counts with its lowest grade;
    null identifiers, null grades and grades outside the range are left out. None if
    no rated document is found. Features are computed on the executors, and what the
    driver gathers is bounded by max_labelled times the distinct words of a text."""
    small_batches(df.sparkSession)
    rated = ratings.where(F.col("id").isNotNull() & F.col("grade").between(0, levels - 1)).groupBy("id").agg(F.min("grade").cast("int").alias("grade"))
    sample = rated.orderBy(F.md5(F.col("id").cast("string")), "id").limit(max_labelled)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "grade", "text")
    found = rows.mapInArrow(_read_features(bits), "id long, grade int, codes binary, values binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.id, bytes(r.codes)))
    codes, values = [np.frombuffer(r.codes, np.int32) for r in found], [np.frombuffer(r["values"], np.float32) for r in found]
    return fit_marked(codes, values, [r.grade for r in found], levels, bits, epochs)


def grade(df: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text", min_tail: float = MIN_TAIL) -> DataFrame:
    """(id_col, expected_grade, tail, selected) for each row: the expected grade, the
    probability of the highest grade, and whether that is at least min_tail.

    A null, empty or blank text has no features, so its figures are those of the
    thresholds alone; it is selected. Without a model both figures are null and every
    row is selected. Null and repeated identifiers give a row each; texts are read
    whole; an empty table gives no rows; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("_q_row"), F.col(text_col).alias("_q_text"))
    if model is None:
        return rows.select(F.col("_q_row").alias(id_col), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail"), F.lit(True).alias("selected"))
    small_batches(df.sparkSession)
    kind = dict(rows.dtypes)["_q_row"]
    scored = rows.mapInArrow(_score(model), f"_q_row {kind}, expected_grade double, tail double, blank boolean")
    return scored.select(F.col("_q_row").alias(id_col), "expected_grade", "tail", ((F.col("tail") >= min_tail) | F.col("blank")).alias("selected"))


def _score(model: OrdinalModel):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("_q_text").to_pylist()]
            tails = model.tails(texts)
            yield pa.RecordBatch.from_arrays([batch.column("_q_row"), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array([not t or t.isspace() for t in texts])], names=["_q_row", "expected_grade", "tail", "blank"])

    return run


def select_rows(df: DataFrame, model: OrdinalModel | None, text_col: str = "text", min_tail: float = MIN_TAIL) -> DataFrame:
    """The rows of df that grade() would select, all columns kept, in one pass."""
    if model is None:
        return df
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep = (model.tails(texts)[:, -1] >= min_tail) | np.array([not t or t.isspace() for t in texts], bool)
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from the label table: 0 for low quality, 1 for good but toxic, 2 for
    good and clean. A null toxic counts as clean; a null quality is no rating."""
    return labels.select(F.col("doc_id").cast("long").alias("id"), F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2)).alias("grade"))


def op6_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = train(documents, ratings_of(table(spark, sf_dir, "labels")))
    return grade(documents, model)
