"""Operator 7: byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 400_000
LONG = 64


class RankQueue:
    """Buckets of positions by merge rank, with a bitmap of three levels of 64-bit
    words over the ranks: the least rank in use is found by three find-first-sets."""

    def __init__(self):
        self.top = 0
        self.mid: dict[int, int] = {}
        self.low: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position) -> None:
        """position: one place, or an array of places for bulk use."""
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            a, b = rank >> 6, rank >> 12
            self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
            self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
            self.top |= 1 << b
        else:
            bucket.append(position)

    def pop(self):
        """(least rank, its positions), taken out; None if the queue is empty."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        w = self.mid[b]
        a = b << 6 | (w & -w).bit_length() - 1
        v = self.low[a]
        rank = a << 6 | (v & -v).bit_length() - 1
        v &= v - 1
        self.low[a] = v
        if not v:
            w &= ~(1 << (a & 63))
            self.mid[b] = w
            if not w:
                self.top &= ~(1 << b)
        return rank, self.buckets.pop(rank)


class _Codes(dict):
    """Numbers pre-tokens as they come and remembers the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        code = self[piece] = len(self)
        return code


class ByteBPE:
    """ranks: {token bytes: rank}; a token's rank is its identifier and its priority."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.token = {r: t for t, r in ranks.items()}
        self.merge: dict[tuple[int, int], int] = {}
        size = max(self.token, default=0) + 1
        lengths = np.zeros(size + 1, np.int64)
        for r, t in self.token.items():
            lengths[r + 1] = len(t)
        self.at = np.cumsum(lengths)
        self.blob = np.frombuffer(b"".join(self.token.get(r, b"") for r in range(size)), np.uint8)
        # all merges as sorted codes left * size + right, for bulk look-up
        known = {}
        for t, r in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    known[a * size + b] = r
        self.size = size
        self.pair_codes = np.array(sorted(known), np.int64)
        self.pair_ranks = np.array([known[c] for c in sorted(known)] + [-1], np.int32)
        self.byte_ids = np.array(self.byte, np.int64)
        self.forget()

    def forget(self) -> None:
        self.cache = _Codes()
        self.flat = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)

    def pair(self, a: int, b: int) -> int:
        """Rank of the merge of two tokens, -1 if they do not merge."""
        found = self.merge.get((a, b))
        if found is None:
            found = self.ranks.get(self.token[a] + self.token[b], -1)
            if len(self.merge) < 1 << 20:
                self.merge[a, b] = found
        return found

    def encode_bytes(self, data: bytes) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left.

        Tokens are a doubly linked list over the byte positions. The queue holds the
        left position of each pair under its rank; an entry whose pair has changed
        since is stale and skipped, so each of the n - 1 merges costs constant time.
        """
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        ids = [self.byte[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [-1] * n
        queue, pair = RankQueue(), self.pair
        for i in range(n - 1):
            r = pair(ids[i], ids[i + 1])
            if r >= 0:
                rank_at[i] = r
                queue.push(r, i)
        while (least := queue.pop()) is not None:
            rank, positions = least
            positions.sort()
            sooner = False
            for i in positions:
                if rank_at[i] != rank:
                    continue
                if sooner:  # a merge just made came up with a lesser rank: it goes first
                    queue.push(rank, i)
                    continue
                j = after[i]
                k = after[j]
                ids[i], after[i], rank_at[j] = rank, k, -1
                if k < n:
                    before[k] = i
                    rank_at[i] = r = pair(rank, ids[k])
                    if r >= 0:
                        queue.push(r, i)
                        sooner |= r < rank
                else:
                    rank_at[i] = -1
                h = before[i]
                if h >= 0:
                    rank_at[h] = r = pair(ids[h], rank)
                    if r >= 0:
                        queue.push(r, h)
                        sooner |= r < rank
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], -1) if len(self.pair_codes) else np.full(len(code), -1, np.int32)

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, tokens of each): one queue works off many short pieces
        together. They lie in one linked list that is cut between pieces; a bucket
        holds the pairs of its rank in all pieces. Each turn merges the leftmost such
        pair of every piece at once; further ones of a piece go back to the queue, so
        every piece sees its merges in the order it would alone."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        n = int(lengths.sum())
        if not n:
            return np.zeros(0, np.int32), lengths
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        ends = np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        alive = np.ones(n, bool)
        rank_at = np.full(n, -1, np.int32)
        queue = RankQueue()

        def push(at, ranks):
            keep = ranks >= 0
            if not keep.any():
                return
            at, ranks = at[keep], ranks[keep]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cut.tolist(), len(at)]
            for s, e in zip(starts, starts[1:]):
                queue.push(int(ranks[s]), at[s:e])

        at = np.flatnonzero(after >= 0)
        rank_at[at] = self._ranks_of(ids[at], ids[after[at]])
        push(at, rank_at[at])
        while (least := queue.pop()) is not None:
            rank, found = least
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            at = np.unique(at)
            own = owner[at]
            first = np.ones(len(at), bool)
            first[1:] = own[1:] != own[:-1]
            if not first.all():
                queue.push(rank, at[~first])
                at = at[first]
            j = after[at]
            k = after[j]
            ids[at], after[at] = rank, k
            alive[j] = False
            rank_at[j] = -1
            rank_at[at] = -1
            more = k >= 0
            i, k = at[more], k[more]
            before[k] = i
            rank_at[i] = self._ranks_of(ids[i], ids[k])
            h = before[at]
            h = h[h >= 0]
            rank_at[h] = self._ranks_of(ids[h], np.full(len(h), rank))
            push(np.concatenate([i, h]), np.concatenate([rank_at[i], rank_at[h]]))
        return ids[alive].astype(np.int32), np.bincount(owner[alive], minlength=len(pieces))

    def _learn(self) -> None:
        """Encode the pre-tokens that were met for the first time."""
        raw = [p.encode("utf-8", "replace") for p in self.cache.new]
        self.cache.new.clear()
        direct = [self.ranks.get(p) for p in raw]
        out: list = [None if r is None else np.array([r], np.int32) for r in direct]
        long = [i for i, p in enumerate(raw) if out[i] is None and len(p) > LONG]
        for i in long:
            out[i] = np.array(self.encode_bytes(raw[i]), np.int32)
        rest = [i for i in range(len(raw)) if out[i] is None]
        ids, counts = self.encode_many([raw[i] for i in rest])
        cut = np.concatenate(([0], np.cumsum(counts)))
        for x, i in enumerate(rest):
            out[i] = ids[cut[x] : cut[x + 1]]
        if out:
            self.flat = np.concatenate([self.flat, *out])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in out])])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, tokens of each text). Pre-tokens met before are
        looked up; the memory of them is emptied when it is full."""
        if len(self.cache) > CACHE:
            self.forget()
        codes, counts = [], []
        for t in texts:
            found = np.array(list(map(self.cache.__getitem__, self.find(t))), np.int32)
            counts.append(len(found))
            codes.append(found)
        self._learn()
        code = np.concatenate(codes or [np.zeros(0, np.int32)])
        lengths = (self.begin[1:] - self.begin[:-1])[code] if len(code) else np.zeros(0, np.int64)
        ids = self.flat[_spread(self.begin[code], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        cut = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        return ids, np.diff(ends[cut])

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        lengths = (self.at[1:] - self.at[:-1])[ids]
        data = self.blob[_spread(self.at[ids], lengths)].tobytes()
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))]
        return [data[a:b] for a, b in zip(ends, ends[1:])]


def _spread(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... for lengths[i] places, for all i in turn."""
    total = int(lengths.sum())
    out = np.arange(total)
    out += np.repeat(begin - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) if len(lengths) else 0
    return out


@functools.lru_cache(2)
def load(path: str) -> ByteBPE:
    with open(path, "rb") as f:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _encode(path: str):
    def run(batches):
        bpe = load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks([t or "" for t in texts], 4 << 20):
                part = [t or "" for t in texts[a:b]]
                ids, counts = bpe.encode_batch(part)
                back = bpe.decode_batch(ids, counts)
                same = [x == t.encode("utf-8", "replace") for x, t in zip(back, part)]
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                tokens = pa.ListArray.from_arrays(offsets, pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), tokens, pa.array(counts.astype(np.int32)), pa.array(same)], names=["id", "tokens", "n_tokens", "round_trip"])

    return run


def _decode(path: str):
    def run(batches):
        bpe = load(path)
        for batch in batches:
            column = batch.column("tokens")
            rows = [np.asarray(x.values if x.is_valid else [], np.int64) for x in column]
            counts = np.array([len(r) for r in rows])
            back = bpe.decode_batch(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.decode("utf-8", "replace") if column[i].is_valid else None for i, x in enumerate(back)], pa.string())], names=["id", "text"])

    return run


def _file(df: DataFrame, path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, tokens, n_tokens, round_trip) for each row; round_trip says that the
    tokens decode to the bytes of the text. `vocabulary` names a file of base64
    tokens and ranks that every executor can read.

    A null text counts as empty; an empty text has no tokens. Null and repeated
    identifiers give a row each. Pre-tokens of any length are merged whole. An empty
    table gives no rows; other columns are not read.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_encode(_file(df, vocabulary)), f"id {kind}, tokens array<int>, n_tokens int, round_trip boolean").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, text) from token ids; bytes that are no UTF-8 become U+FFFD, null
    tokens give a null text. Identifiers outside the vocabulary are an error."""
    rows = df.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_decode(_file(df, vocabulary)), f"id {kind}, text string").withColumnRenamed("id", id_col)


def op7_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))
