"""Operator 10: dedup of fuzzy lines by MinHash."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, chunks, components, free_names, lean, mix, powers, small, small_batches, stored, table, tasks_for

SHINGLE = 7
THRESHOLD = 0.8
BANDS = 20
ROWS = 6
BINS = 128
FEW, MANY = 64, 128
PIECE = 1 << 16
BITS = 2048
SKETCHED = 4096

_CHARS = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x51ED))
_EMPTY = np.uint64((1 << 64) - 1)
_HASH_A = np.random.Generator(np.random.PCG64(99)).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _windows(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line number, 44-bit hash) of the windows of k characters, in their order."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    high = codes > 0xFFFF
    if high.any():
        value = _CHARS[codes & 0xFFFF]
        value[high] = mix(codes[high].astype(np.uint64) + np.uint64(0x51ED))
    else:
        value = _CHARS[codes]
    up, down = powers(len(codes) + 1)
    value *= up[: len(codes)]
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    h = total[k:] - total[: len(codes) - k + 1]
    # the last k - 1 places of a line begin no window of it
    width = np.maximum(lengths - (k - 1), 0)
    inside = np.repeat(np.tile([True, False], len(lines)), np.stack([width, lengths - width], 1).ravel())[: len(h)]
    h *= down[: len(h)]
    return np.repeat(np.arange(len(lines)), width), mix(h[inside]) >> np.uint64(20)


def shingles(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line number, 44-bit hash) of the distinct windows of k characters. Worked off in
    pieces that the caches hold."""
    parts = []
    for s, e in chunks(lines, PIECE):
        of, h = _windows(lines[s:e], k)
        both = np.sort(of.astype(np.uint64) << np.uint64(44) | h)
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        both = both[new]
        parts.append(((both >> np.uint64(44)).astype(np.int64) + s, both & np.uint64((1 << 44) - 1)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def _keys(signature: np.ndarray, scheme: int) -> np.ndarray:
    """Band keys (lines x BANDS) of signatures (BANDS * ROWS x lines)."""
    key = np.empty((BANDS, signature.shape[1]), np.uint64)
    key[:] = (MULT[10 + scheme] * np.arange(1, BANDS + 1, dtype=np.uint64))[:, None]
    for i in range(ROWS):
        key += signature[i::ROWS] * MULT[i]
    return np.ascontiguousarray(mix(key).T)


def band_keys(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(line number, band key). Lines of at most MANY distinct shingles get a MinHash
    of independent functions; lines of FEW or more get one permutation cut into bins,
    empty bins taking the value of the next full one. Lines between have both. A pair
    of similarity s has counts in a ratio of s at least, so at 0.8 either both have at
    most MANY shingles or both have 0.8 x MANY or more, and they share a scheme; both
    schemes propose such a pair with a probability above 0.99 (measured in the tests).
    Lines shorter than k have no key: equal ones are exact copies anyway."""
    out_line, out_key = [], []
    few: list[tuple[np.ndarray, np.ndarray]] = []  # lines of the first scheme, their windows
    bins: list[tuple[np.ndarray, np.ndarray]] = []  # lines of the second, the least hash of their bins
    # distinct shingles are at most the windows; they are counted where that leaves it open
    width = np.fromiter(map(len, lines), np.int64, len(lines)) - (k - 1)
    for low, high in ((1, FEW - 1), (FEW, MANY), (MANY + 1, 1 << 62)):
        number = np.flatnonzero((width >= low) & (width <= high))
        some = [lines[i] for i in number.tolist()]
        for s, e in chunks(some, PIECE):
            of, h = _windows(some[s:e], k)
            own = number[s:e]
            if high < FEW:
                few.append((own[of], h))
            else:
                place = of * (8 * BINS)
                place += (h >> np.uint64(44 - 10)).astype(np.int64)
                taken = np.zeros((e - s, 8 * BINS), bool)
                taken.reshape(-1)[place] = True
                count = np.count_nonzero(taken, 1)
                open_rows = count < FEW if high == MANY else count <= MANY
                if open_rows.any():
                    look = open_rows[of]
                    both = np.sort(of[look].astype(np.uint64) << np.uint64(44) | h[look])
                    both = both[np.append(True, both[1:] != both[:-1])]
                    count[open_rows] = np.bincount((both >> np.uint64(44)).astype(np.int64), minlength=e - s)[open_rows]
                # not more windows than MANY are not more distinct ones either
                first = count <= MANY if high > MANY else np.ones(e - s, bool)
                if first.all():
                    few.append((own[of], h))
                elif first.any():
                    look = first[of]
                    few.append((own[of[look]], h[look]))
                least = np.full((e - s) * BINS, _EMPTY)
                place >>= 3
                np.minimum.at(least, place, h)
                chosen = count >= FEW
                bins.append((own[chosen], least.reshape(-1, BINS)[chosen]))
            if sum(len(v) for _, v in few) > PIECE // 2:
                _flush(few, _independent, out_line, out_key)
            if sum(len(o) for o, _ in bins) > 1024:
                _flush(bins, _one_permutation, out_line, out_key)
    _flush(few, _independent, out_line, out_key)
    _flush(bins, _one_permutation, out_line, out_key)
    if not out_line:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_line), np.concatenate(out_key)


def _flush(held: list, scheme, out_line: list, out_key: list) -> None:
    """Band keys of what is held, which is then let go."""
    if held:
        line, key = scheme(*(np.concatenate(x) for x in zip(*held)))
        out_line.append(np.repeat(line, BANDS))
        out_key.append(key.ravel())
        held.clear()


def _independent(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines, band keys) by BANDS * ROWS functions of the windows h of lines."""
    at = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1))
    sig = np.empty((BANDS * ROWS, len(at)), np.uint64)
    hashed = np.empty_like(h)
    for i, a in enumerate(_HASH_A):
        np.add(h, MULT[i % 64], out=hashed)
        np.multiply(hashed, a, out=hashed)
        np.minimum.reduceat(hashed, at, out=sig[i])
    return of[at], _keys(sig, 1)


def _one_permutation(line: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines, band keys) by the least hash of each of their bins (lines x BINS). Empty
    bins take the value of the next full one, and count how far away it is: that is the
    value of the bin after them, a step further."""
    least = np.ascontiguousarray(least.T)
    full = least != _EMPTY
    first = full.argmax(0)
    value = least[first, np.arange(len(line))] + (first + 1).astype(np.uint64) * MULT[9]  # of bin 0
    for i in range(BINS - 1, -1, -1):
        value = np.where(full[i], least[i], value)
        value += MULT[9]
        least[i] = value
    return line, _keys(least[: BANDS * ROWS], 2)


_BANDED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("lines", pa.binary())])


def _bands(k: int, bits: int):
    def run(batches):
        for batch in batches:
            ids, lines = batch.column("lh").to_numpy(), batch.column("line").to_pylist()
            _, first = np.unique(ids, return_index=True)
            size = 0
            group: list[int] = []
            groups = [group]
            for i in first.tolist():
                if group and (size > 2 << 20 or len(group) >= 1 << 19):
                    group, size = [], 0
                    groups.append(group)
                group.append(i)
                size += len(lines[i])
            for group in groups:
                of, key = band_keys([lines[i] for i in group], k)
                own = ids[np.array(group, np.int64)][of] if group else ids[:0]
                # narrow numbers sort by radix
                kind = np.uint16 if bits <= 16 else np.int32
                bucket = (key >> np.uint64(64 - bits)).astype(kind) if bits else np.zeros(len(key), kind)
                order = np.argsort(bucket, kind="stable")
                bucket, own, key = bucket[order], own[order], (key[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                cut = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
                spans = list(zip(cut[:-1], cut[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[s]) for s, _ in spans], pa.int32()), pa.array([key[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([own[s:e].tobytes() for s, e in spans], pa.binary())],
                    schema=_BANDED,
                )

    return run


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("group", pa.binary())])


def _stars(t: pa.Table) -> pa.Table:
    """Lines that share a band key: each with the least of them as a pair (a, b), and
    the whole group, once, where it has three lines or more."""
    key, line = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()] or [np.zeros(0, kind)]) for c, kind in (("keys", np.uint32), ("lines", np.int64)))
    # most keys have one line; those go before lines are sorted
    place = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
    new = np.ones(len(place) + 1, bool)
    new[1:-1] = (place[1:] >> np.uint64(32)) != (place[:-1] >> np.uint64(32))
    met = (place[~(new[1:] & new[:-1])] & np.uint64((1 << 32) - 1)).astype(np.int64)
    key, line = key[met], line[met]
    order = np.lexsort((line, key))
    key, line = key[order], line[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    key, line = key[new], line[new]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(starts, len(key)))
    star = np.repeat(line[starts], n)
    pairs = np.stack([star, line], 1)[star != line]
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
    pairs = pairs[new]
    groups = list({line[s : s + m].tobytes() for s, m in zip(starts[n > 2], n[n > 2])})
    none = [None] * len(groups)
    return pa.table([pa.array([*pairs[:, 0].tolist(), *none], pa.int64()), pa.array([*pairs[:, 1].tolist(), *none], pa.int64()), pa.array([None] * len(pairs) + groups, pa.binary())], schema=_MET)


def _members(batches):
    for batch in batches:
        groups = [np.frombuffer(g, np.int64) for g in batch.column("group").to_pylist()]
        own = np.repeat(batch.column("no").to_numpy(), [len(g) for g in groups])
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate([*groups, np.zeros(0, np.int64)]))], names=["no", "lh"])


def _across(threshold: float):
    """Pairs of lines of one group whose components differ, as far as known, and whose
    sketches, where both have one, leave a similarity of the threshold open. Pairs
    within a component need no look: they would not change it. Rows (no, lh, root,
    width, bits) come sorted by no and root; the last group of a batch waits for more.
    A line without a sketch has a width of -1 and takes no room for bits."""

    def pairs(no, lh, root, width, bits):
        ends, root_ends = (np.append(np.flatnonzero(x), len(no)) for x in (no[1:] != no[:-1], (no[1:] != no[:-1]) | (root[1:] != root[:-1])))
        ends[:-1] += 1
        root_ends[:-1] += 1
        at = np.arange(len(no))
        last, first = ends[np.searchsorted(ends, at, "right")], root_ends[np.searchsorted(root_ends, at, "right")]
        total = np.append(0, np.cumsum(last - first))
        has = width >= 0
        sketch, width = np.cumsum(has) - 1, width[has]
        for s in range(0, int(total[-1]), 1 << 13):
            p = np.arange(s, min(s + (1 << 13), int(total[-1])))
            a = np.searchsorted(total, p, "right") - 1
            b = first[a] + p - total[a]
            may = ~(has[a] & has[b])
            look = np.flatnonzero(~may)
            may[look] = _most(width, bits, sketch[a[look]], sketch[b[look]]) >= threshold
            a, b = lh[a[may]], lh[b[may]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            no, lh, root, width = (batch.column(c).to_numpy() for c in ("no", "lh", "root", "width"))
            bits = np.frombuffer(b"".join(batch.column("bits").drop_null().to_pylist()), np.uint64).reshape(-1, BITS // 64)
            now = (no, lh, root, width, bits)
            if held and held[0][0][0] == no[-1]:
                held.append(now)
                continue
            *whole, bits = (np.concatenate(x) for x in zip(*held, now))
            cut = int(np.searchsorted(whole[0], no[-1]))
            shown = np.count_nonzero(whole[3][:cut] >= 0)
            yield from pairs(*(x[:cut] for x in whole), bits[:shown])
            held = [(*(x[cut:] for x in whole), bits[shown:])]
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held)))

    return run


def line_jaccard(x: str, y: str, k: int = SHINGLE) -> float:
    """Exact Jaccard similarity of the sets of windows of k characters."""
    a = {x[i : i + k] for i in range(max(1, len(x) - k + 1))}
    b = {y[i : i + k] for i in range(max(1, len(y) - k + 1))}
    return len(a & b) / len(a | b)


def jaccards(lines: list[str], left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """Jaccard similarities of lines[left] and lines[right] on the hashes of all their
    distinct shingles: each shingle of the smaller set is looked up in the other."""
    of, h = shingles(lines, k)
    both = of.astype(np.uint64) << np.uint64(44) | h
    start = np.searchsorted(of, np.arange(len(lines) + 1))
    n = np.diff(start)
    small_side, large_side = np.where(n[left] <= n[right], left, right), np.where(n[left] <= n[right], right, left)
    lengths = n[small_side]
    row = np.repeat(np.arange(len(left)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    needle = h[start[small_side][row] + place] | large_side[row].astype(np.uint64) << np.uint64(44)
    at = np.minimum(np.searchsorted(both, needle), max(0, len(both) - 1))
    common = np.bincount(row, weights=both[at] == needle if len(both) else None, minlength=len(left))
    return common / np.maximum(n[left] + n[right] - common, 1)


def _sketches(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the number of its windows, and a bit for each of BITS ranges of
    hashes that tells whether a shingle falls there."""
    width, bits = np.zeros(len(lines), np.int64), np.zeros((len(lines), BITS // 64), np.uint64)
    for s, e in chunks(lines, PIECE):
        of, h = _windows(lines[s:e], k)
        width[s:e] = np.bincount(of, minlength=e - s)
        taken = np.zeros((e - s, BITS), bool)
        taken.reshape(-1)[of * BITS + (h >> np.uint64(44 - 11)).astype(np.int64)] = True
        bits[s:e] = np.packbits(taken, 1).view(np.uint64)
    return width, bits


def _most(width: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Upper bounds of Jaccard similarities by sketches."""
    out = np.empty(len(left))
    for s in range(0, len(left), 1024):
        a, b = left[s : s + 1024], right[s : s + 1024]
        x, y = bits[a], bits[b]
        both = x & y
        only_a, only_b = (np.bitwise_count(z ^ both).sum(1, dtype=np.int64) for z in (x, y))
        most = np.maximum(np.minimum(width[a] - only_a, width[b] - only_b), 0)
        out[s : s + 1024] = most / np.maximum(most + only_a + only_b, 1)
    return out


def bounds(lines: list[str], left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """Upper bounds of the Jaccard similarities of lines[left] and lines[right]. A bit
    that only one line's shingles set tells of a shingle the other lacks. Lines of
    several thousand characters set most bits, and their bounds are near 1."""
    return _most(*_sketches(lines, k), left, right)


def _sketched(k: int):
    def run(batches):
        for batch in batches:
            width, bits = _sketches(batch.column("line").to_pylist(), k)
            yield pa.RecordBatch.from_arrays([batch.column("lh"), pa.array(width), pa.array([x.tobytes() for x in bits], pa.binary())], names=["lh", "width", "bits"])

    return run


def _verify(k: int, threshold: float):
    def run(batches):
        for batch in batches:
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            ok = np.zeros(len(xs), bool)
            at = 0
            while at < len(xs):
                # as many pairs as have about a million characters
                number: dict[str, int] = {}
                size, to = 0, at
                pairs = []
                while to < len(xs) and (size < 1 << 20 or to == at):
                    pairs.append((number.setdefault(xs[to], len(number)), number.setdefault(ys[to], len(number))))
                    size += len(xs[to]) + len(ys[to])
                    to += 1
                left, right = np.array(pairs, np.int64).T
                lines = list(number)
                may = np.flatnonzero(bounds(lines, left, right, k) >= threshold)
                used, place = np.unique(np.concatenate([left[may], right[may]]), return_inverse=True)
                similar = jaccards([lines[i] for i in used], place[: len(may)], place[len(may) :], k)
                ok[at + may] = similar >= threshold
                # where equal hashes of different shingles could decide, strings do
                for i in at + may[np.abs(similar - threshold) < 0.01]:
                    ok[i] = line_jaccard(xs[i], ys[i], k) >= threshold
                at = to
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # the hash of a text comes before its lines: beside them it would be made for each
    of = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    at = of.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return at.withColumn("lh", F.xxhash64("line"))


def _decided(df: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """(id, th, line_no, rep_id, rep_line, kept), th being the hash of the text."""
    spark = df.sparkSession
    small_batches(spark)
    lines = _lines(df, id_col, text_col)
    blank = F.ltrim(F.col("line"), F.lit(" \t\n\x0b\f\r")) == ""
    where = stored(lines.select("id", "th", "line_no", "lh", blank.alias("blank")), "line-places")
    bits = min(24, max(3, math.ceil(math.log2(tasks_for(df, 16 << 20, 8, 2.0)))))
    # lines of fewer characters than bytes may come along; they get no key
    worth = lines.where(F.octet_length("line") >= shingle).select("lh", "line", blank.alias("blank"))
    banded = worth.where("NOT blank").select("lh", "line").mapInArrow(lean(_bands(shingle, bits)), "bucket int, keys binary, lines binary")
    met = stored(banded.groupBy("bucket").applyInArrow(lean(_stars), "a long, b long, group binary"), "line-met")
    stars = stored(met.where("a IS NOT NULL").select("a", "b").distinct(), "line-stars")
    needed = stored(stars.select(F.explode(F.array("a", "b")).alias("lh")).distinct(), "line-needed")
    texts = stored(worth.select("lh", "line").join(small(needed, 16), "lh", "left_semi").groupBy("lh").agg(F.min("line").alias("line")), "line-texts")

    def verified(some: DataFrame) -> DataFrame:
        x, y = texts.select(F.col("lh").alias("a"), F.col("line").alias("x")), texts.select(F.col("lh").alias("b"), F.col("line").alias("y"))
        full = some.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y")
        return full.sortWithinPartitions("a", "b").mapInArrow(lean(_verify(shingle, threshold)), "a long, b long")

    first = stored(verified(stars), "line-edges")
    roots = stored(components(first, "line-cc"), "line-roots")
    # groups that the stars did not join as a whole
    groups = met.where("group IS NOT NULL").select("group").distinct().withColumn("no", F.monotonically_increasing_id())
    members = stored(groups.mapInArrow(_members, "no long, lh long"), "line-members")
    rooted = members.join(small(roots.withColumnRenamed("node", "lh"), 16), "lh", "left").select("no", "lh", F.coalesce("root", "lh").alias("root"))
    apart = rooted.groupBy("no").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("no", "n")
    opened = stored(rooted.join(small(stored(apart, "line-apart"), 24), "no"), "line-open")
    # groups of many lines go without sketches, so that their rows stay small
    wanted = stored(opened.where(F.col("n") <= SKETCHED).select("lh").distinct(), "line-wanted")
    sketches = texts.join(small(wanted, 16), "lh", "left_semi").select("lh", "line").mapInArrow(lean(_sketched(shingle)), "lh long, width long, bits binary")
    shown = opened.join(sketches.withColumnRenamed("lh", "lh_"), (F.col("lh") == F.col("lh_")) & (F.col("n") <= SKETCHED), "left").select("no", "lh", "root", F.coalesce("width", F.lit(-1)).alias("width"), "bits")
    parted = shown.repartition("no").sortWithinPartitions("no", "root")
    open_pairs = parted.mapInArrow(lean(_across(threshold)), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
    more = stored(verified(open_pairs), "line-edges")
    if not more.isEmpty():
        roots = stored(components(first.union(more), "line-cc"), "line-roots")
    # lines of several places, by components, and the first place of each component
    place = F.struct("id", "line_no", "th")
    filled = where.where("NOT blank")
    again = filled.groupBy("lh").agg(F.count("*").alias("n")).where("n > 1").select("lh").union(roots.select("node")).distinct()
    several = stored(again.join(small(roots.withColumnRenamed("node", "lh"), 16), "lh", "left").select("lh", F.coalesce("root", "lh").alias("root")), "line-several")
    reps = stored(filled.join(small(several, 16), "lh").groupBy("root").agg(F.min(place).alias("rep")), "line-reps")
    reps = stored(several.join(small(reps, 48), "root").select("lh", "rep"), "line-reps")
    own = where.join(small(reps, 48), "lh", "left").withColumn("rep", F.when(F.col("blank"), None).otherwise(F.col("rep")))
    rep = F.coalesce("rep", place)
    kept = F.expr("id <=> rep.id AND line_no = rep.line_no AND th = rep.th")
    return own.withColumn("rep", rep).select("id", "th", "line_no", F.col("rep.id").alias("rep_id"), F.col("rep.line_no").alias("rep_line"), kept.alias("kept"))


def line_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, line_no, rep_id, rep_line, kept) for every line of every text: the
    first line (by identifier, line number and hash of the text) of its component, and
    whether it is that line. Lines are linked if they are equal or the Jaccard
    similarity of their character shingles is at least threshold.

    Signatures propose pairs by banding (a similarity of 0.8 is found with a
    probability above 0.99). In each band a star of pairs with the least line comes
    first. Its pairs are verified by exact Jaccard similarity, but for those that an
    upper bound puts below the threshold: every shingle of the one line is looked up in
    the other by its 44-bit hash, and where the result is within 0.01 of the threshold
    the sets of strings decide. Components come from distributed
    union-find. Groups that their stars have joined are done; in the others the pairs
    across components are verified too, so that no proposed link is lost, but for those
    that the same bound rules out by sketches of the lines (groups of more than SKETCHED
    lines send all their pairs).

    Blank lines, and those of null or empty texts, are kept as they are. A null
    identifier is taken as one before all others. Rows repeated as a whole share one
    decision, so their lines stay together; different texts of one identifier are told
    apart. Lines shorter than a shingle are linked if equal. An empty table gives no
    rows; lines of any length are read whole; other columns are not read. Lines are
    told apart by a 64-bit hash. Identifiers are whole numbers, or strings of such.
    """
    out = _decided(df, id_col, text_col, shingle, threshold)
    return out.select(F.col("id").alias(id_col), "line_no", "rep_id", "rep_line", "kept")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """df with the dropped lines cut out of its texts, all rows and columns kept. A
    text whose lines all go becomes empty; a null text stays null. A line goes from the
    text it was judged in, not from other texts of the identifier."""
    x_id, x_h, x_gone = free_names(df, "_gone_id", "_gone_h", "_gone")
    gone = _decided(df, id_col, text_col, shingle, threshold).where("NOT kept")
    gone = gone.groupBy(F.col("id").alias(x_id), F.col("th").alias(x_h)).agg(F.collect_set("line_no").alias(x_gone))
    both = df.join(gone, df[id_col].cast("long").eqNullSafe(gone[x_id]) & (F.xxhash64(df[text_col]) == gone[x_h]), "left")
    left = F.array_join(F.transform(F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(x_gone, s["i"])), lambda s: s["x"]), "\n")
    text = F.when(F.col(x_gone).isNull(), F.col(text_col)).otherwise(left)
    return both.withColumn(text_col, text).select(*df.columns)


def op10_line_dedup(spark, sf_dir):
    found = line_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", F.col("rep_id").alias("rep_doc_id"), F.col("rep_line").alias("rep_line_no"), "kept")
