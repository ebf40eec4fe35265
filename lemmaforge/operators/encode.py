"""Encoders are column producers: DataFrame in, the same rows with q, pos_logits and
edit_logits out. One that reads nothing but the form says so with contextual = False;
then each form is encoded and retrieved once, not once for each sentence. No weights are shipped; HashEncoder stands in for a trained model."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import UPOS


class Encoder(Protocol):
    def encode_query(self, rows: DataFrame, form: str, sentence: str, start: str, end: str) -> DataFrame: ...

    def encode_lemma(self, rows: DataFrame, lemma: str) -> DataFrame: ...


class PrecomputedEncoder:
    """Takes rows that carry q, pos_logits and edit_logits already."""

    def encode_query(self, rows, form="form", sentence="sentence", start="span_start", end="span_end"):
        return rows

    def encode_lemma(self, rows, lemma="lemma"):
        return rows


class HashEncoder:
    """Deterministic vectors from character trigrams of the form, so that forms that
    look alike are near each other; logits come from a digest of the form. Distinct
    forms are encoded once for each Arrow batch."""

    contextual = False

    def __init__(self, dim: int = 32, scripts: int | None = 8):
        self.dim, self.scripts = dim, scripts

    def vector(self, form: str) -> np.ndarray:
        v = np.zeros(self.dim)
        padded = f"^{form}$"
        for i in range(max(1, len(padded) - 2)):
            d = hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest()
            v[int.from_bytes(d[:4], "little") % self.dim] += 1 if d[4] & 1 else -1
        n = np.linalg.norm(v)
        return v / n if n else np.full(self.dim, self.dim**-0.5)

    def logits(self, form: str, n: int, salt: bytes) -> list[float]:
        d = hashlib.blake2b(form.encode(), digest_size=32, person=salt).digest()
        return [float(d[i % 32] ^ (i // 32 * 37 & 255)) for i in range(n)]

    def _columns(self, rows: DataFrame, form: str, heads: bool) -> DataFrame:
        me, at = self, rows.columns.index(form)
        extra = "q array<double>, pos_logits array<double>, edit_logits array<double>" if heads else "embedding array<double>"
        schema = rows.limit(0).schema
        for part in rows.sparkSession.createDataFrame([], extra).schema:
            schema = schema.add(part)

        def run(batches):
            for batch in batches:
                forms = batch.column(at).to_pylist()
                seen = {f: i for i, f in enumerate(dict.fromkeys(f or "" for f in forms))}
                take = pa.array([seen[f or ""] for f in forms], pa.int32())
                kind = pa.list_(pa.float64())
                new = [pa.array([me.vector(f).tolist() for f in seen], kind).take(take)]
                if heads:
                    new.append(pa.array([me.logits(f, len(UPOS), b"pos") for f in seen], kind).take(take))
                    new.append(pa.array([me.logits(f, me.scripts, b"edit") if me.scripts else None for f in seen], kind).take(take))
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

        return rows.mapInArrow(run, schema)

    def encode_query(self, rows, form="form", sentence="sentence", start="span_start", end="span_end"):
        return self._columns(rows, form, True)

    def encode_lemma(self, rows, lemma="lemma"):
        return self._columns(rows, lemma, False)


def encode_distinct(rows: DataFrame, encoder: Encoder, keys: list[str]) -> DataFrame:
    """Encode each distinct combination of keys once and join the vectors back: worth
    its shuffle where a costly model meets repeated sentences."""
    once = encoder.encode_query(rows.select(*keys).distinct(), *keys[:1])
    on = [rows[k].eqNullSafe(once[k]) for k in keys]
    both = rows.join(once, on[0] if len(on) == 1 else _all(on))
    return both.select(*[rows[c] for c in rows.columns], once["q"], once["pos_logits"], once["edit_logits"])


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def predicted_pos(logits) -> F.Column:
    tags = F.array(*map(F.lit, UPOS))
    return F.get(tags, (F.array_position(logits, F.array_max(logits)) - 1).cast("int"))
