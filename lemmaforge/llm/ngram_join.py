"""Operator 5: n-gram Jaccard self-join by vertical partitioning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, chunks, components, free_names, lean, mix, small, small_batches, stored, table, tasks_for, texts_to_words

N = 4
THRESHOLD = 0.4
PARTS = 4
# sets in a block, a power of two; n-grams of so many sets are counted by matrix products
BLOCK_BITS = 10
HEAVY = 32
# frequencies above this are alike in the order of n-grams
MOST = 255

_BIN = "binary"


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place within the row) of every element of rows with such counts."""
    total = int(counts.sum())
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def grams_of(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct word n-grams of each text, sorted. A text
    of fewer than n words has one gram, of all its words; without words it has none."""
    words, counts = texts_to_words(texts)
    doc, place = _expand(counts)
    acc = np.zeros(len(words), np.uint64)
    for k in range(n):
        inside = place + k < counts[doc]
        acc[inside] += words[np.flatnonzero(inside) + k] * MULT[k]
    lengths = np.minimum(counts, n)
    acc = mix(acc + lengths.astype(np.uint64)[doc])
    keep = place <= np.maximum(counts[doc] - n, 0)
    doc, acc = doc[keep], acc[keep]
    order = np.lexsort((acc, doc))
    doc, acc = doc[order], acc[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], acc[new]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    return starts, np.diff(np.append(starts, len(values)))


def _binaries(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _pack7(gram: np.ndarray) -> bytes:
    """The low 56 bits of each hash; the fragment implies the leading bits."""
    return gram.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack7(data: np.ndarray, frag: int, bits: int) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = data.reshape(-1, 7)
    return out.view(np.uint64).ravel() & np.uint64((1 << (64 - bits)) - 1) | (np.uint64(frag) << np.uint64(64 - bits))


def _narrow(x: np.ndarray) -> bytes:
    """Counts in one byte each if they fit, else in four."""
    return x.astype(np.uint8 if not len(x) or x.max() < 1 << 8 else np.uint32).tobytes()


def _widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else np.uint32).astype(np.int64)


_SEG = pa.schema([("frag", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("counts", pa.binary()), ("grams", pa.binary()), ("marks", pa.binary()), ("ids", pa.binary()), ("hashes", pa.binary()), ("sizes", pa.binary())])


def _segments(n: int, bits: int):
    """Cut the n-grams of every document at the fragments of the hash order; one row
    holds what a chunk of documents has in one fragment: how many n-grams each of its
    documents has there, and these. An n-gram of MOST or more documents of the chunk
    needs no counting: the fragment gets one mark of it, and its occurrences go to a
    group of the chunk's own instead (as fragment 1 << bits and above), so that no
    task holds all occurrences of a frequent n-gram. One more row for each chunk,
    under a negative fragment, has identifiers, hashes and sizes of its documents."""

    def run(batches):
        for batch in batches:
            hashes, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "id"))
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts, 2 << 20, 60_000):
                doc, gram = grams_of(texts[a:b], n)
                m = b - a
                sizes = np.bincount(doc, minlength=m)
                digest = mix(hashes[a:b].view(np.uint64) + MULT[0] * np.arange(m, dtype=np.uint64)).sum(dtype=np.uint64)
                chunk = int(mix(np.array([digest])).view(np.int64)[0])
                rows: dict = {f.name: [] for f in _SEG}

                def add(frag, counts=b"", grams=b"", marks=b"", ids=b"", hashes=b"", sizes=b""):
                    for name, v in zip(_SEG.names, (frag, chunk, m, counts, grams, marks, ids, hashes, sizes)):  # noqa: B023
                        rows[name].append(v)  # noqa: B023

                add(-1 - (chunk & ((1 << bits) - 1)), ids=ids[a:b].astype(np.int64).tobytes(), hashes=hashes[a:b].astype(np.int64).tobytes(), sizes=sizes.astype(np.int32).tobytes())
                marks = np.zeros(0, np.uint64)
                if m >= MOST and len(gram):
                    plain = np.sort(gram)
                    at, k = _runs(plain)
                    marks = plain[at[k >= MOST]]
                    if len(marks):
                        hot = marks[np.minimum(np.searchsorted(marks, gram), len(marks) - 1)] == gram
                        own = doc[hot]
                        add((1 << bits) + (chunk & ((1 << bits) - 1)), counts=_narrow(np.bincount(own, minlength=m)), grams=gram[hot].tobytes())
                        doc, gram = doc[~hot], gram[~hot]
                frag = (gram >> np.uint64(64 - bits)).astype(np.int32)
                order = np.argsort(frag, kind="stable")
                doc, gram, frag = doc[order], gram[order], frag[order]
                marked = (marks >> np.uint64(64 - bits)).astype(np.int64)
                for f in np.union1d(frag, marked).tolist():
                    s, e = np.searchsorted(frag, [f, f + 1])
                    add(f, _narrow(np.bincount(doc[s:e], minlength=m)), _pack7(gram[s:e]), _pack7(marks[marked == f]))
                yield _binaries(rows, _SEG)

    return run


def _joined(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()] or [np.zeros(0, kind)])


_SHARED = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("counts", pa.binary()), ("grams", pa.binary()), ("dfs", pa.binary()), ("ids", pa.binary()), ("hashes", pa.binary()), ("sizes", pa.binary())])


def _shared(bits: int):
    """In one fragment, which holds all occurrences of its n-grams or a mark of them:
    count documents of each n-gram and send those of two or more back to their chunk."""

    def run(t: pa.Table) -> pa.Table:
        frag = t.column("frag")[0].as_py()
        _, first = np.unique(t.column("chunk").to_numpy(), return_index=True)
        t = t.take(pa.array(first))  # a chunk repeated row by row counts once
        chunk, n = t.column("chunk").to_numpy(), t.column("n").to_numpy()
        rows: dict = {f.name: [] for f in _SHARED}
        if frag < 0 or frag >= 1 << bits:
            grams = t.column("grams").to_pylist()
            rows = {"chunk": chunk, "n": n, "dfs": [b"\xff" * (len(g) // 8) for g in grams]} | {c: t.column(c).to_pylist() for c in ("counts", "grams", "ids", "hashes", "sizes")}
            return pa.Table.from_batches([_binaries(rows, _SHARED)])
        held = t.column("counts").to_pylist()
        counts = np.concatenate([_widen(c, k) for c, k in zip(held, n)])
        gram = _unpack7(_joined(t, "grams", np.uint8), frag, bits)
        marks = np.unique(_unpack7(_joined(t, "marks", np.uint8), frag, bits))
        order = np.argsort(gram)
        _, df = _runs(gram[order])
        each = np.zeros(len(gram), np.uint8)
        each[order] = np.repeat(np.minimum(df, MOST).astype(np.uint8), df)
        del order
        if len(marks) and len(gram):
            each[marks[np.minimum(np.searchsorted(marks, gram), len(marks) - 1)] == gram] = MOST
        keep = each > 1
        place = np.repeat(np.arange(len(counts)), counts)[keep]
        gram, each = gram[keep], each[keep]
        left = np.bincount(place, minlength=len(counts))
        docs = np.concatenate(([0], np.cumsum(n)))
        cut = np.concatenate(([0], np.cumsum(left)))[docs]
        for i in range(len(n)):
            s, e = cut[i], cut[i + 1]
            if e > s:
                for name, v in zip(_SHARED.names, (chunk[i], n[i], _narrow(left[docs[i] : docs[i + 1]]), gram[s:e].tobytes(), each[s:e].tobytes(), b"", b"", b"")):
                    rows[name].append(v)
        return pa.Table.from_batches([_binaries(rows, _SHARED)])

    return run


_LIVE = pa.schema([("chunk", pa.int64()), ("no", pa.int32()), ("id", pa.int64()), ("h", pa.int64()), ("size", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("home", pa.int64()), ("prefix", pa.int32()), ("grams", pa.binary())])


def _live(threshold: float):
    """Sum the counts of each document of one chunk. A partner at the threshold shares
    at least threshold x size n-grams, so documents with fewer shared ones have none:
    they get a row without n-grams. The others get their shared n-grams in the order
    (frequency, hash), the length of the prefix in which any partner must meet them,
    two sums that equal sets have alike, and the least mixed hash, which documents of
    similar sets mostly have alike. A document with an n-gram of its own equals no
    other, so its identifier and hash stand for the sums."""

    def run(t: pa.Table) -> pa.Table:
        named = [i for i, x in enumerate(t.column("ids").to_pylist()) if x]
        n = t.column("n")[0].as_py()
        ids, hashes = (np.frombuffer(t.column(c)[named[0]].as_py(), np.int64) for c in ("ids", "hashes"))
        size = np.frombuffer(t.column("sizes")[named[0]].as_py(), np.int32).astype(np.int64)
        chunk = t.column("chunk")[0].as_py()
        held = [_widen(c, n) for c in t.column("counts").to_pylist() if c]
        doc = np.concatenate([np.repeat(np.arange(n), c) for c in held] or [np.zeros(0, np.int64)])
        gram, df = _joined(t, "grams", np.uint64), _joined(t, "dfs", np.uint8)
        shared = np.bincount(doc, minlength=n)
        need = np.maximum(np.ceil(threshold * size - 1e-9).astype(np.int64), 1)
        ok = shared >= need
        keep = ok[doc]
        doc, gram, df = doc[keep], gram[keep], df[keep]
        order = np.lexsort((gram, df, doc))
        doc, gram = doc[order], gram[order]
        at, m = _runs(doc)
        d = doc[at]
        whole = m == size[d]
        mixed = mix(gram)
        rest = np.flatnonzero(~ok)
        none = [None] * len(rest)
        s1 = np.where(whole, np.add.reduceat(gram, at).view(np.int64) if len(at) else 0, ids[d])
        s2 = np.where(whole, np.add.reduceat(mixed, at).view(np.int64) if len(at) else 0, hashes[d])
        home = np.minimum.reduceat(mixed, at).view(np.int64) if len(at) else np.zeros(0, np.int64)
        cut = np.append(at, len(gram))
        columns = {
            "chunk": np.full(n, chunk),
            "no": np.concatenate([d, rest]),
            "id": ids[np.concatenate([d, rest])],
            "h": hashes[np.concatenate([d, rest])],
            # sets with a lone n-gram are told from whole ones by the sign
            "size": np.concatenate([np.where(whole, size[d], -size[d]), size[rest]]),
            "s1": [*s1.tolist(), *none],
            "s2": [*s2.tolist(), *none],
            "home": [*home.tolist(), *none],
            "prefix": [*(m - need[d] + 1).tolist(), *none],
            "grams": [*(gram[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:])), *none],
        }
        return pa.Table.from_batches([_binaries(columns, _LIVE)])

    return run


_PRE = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])


def _prefixes(bits: int):
    def run(batches):
        for batch in batches:
            grams = [np.frombuffer(g, np.uint64)[:p] for g, p in zip(batch.column("grams").to_pylist(), batch.column("prefix").to_pylist())]
            keys, sizes = batch.column("key").to_numpy(zero_copy_only=False), batch.column("size").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(keys)), [len(g) for g in grams])
            gram = np.concatenate(grams or [np.zeros(0, np.uint64)])
            bucket = (gram >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, gram, owner = bucket[order], gram[order], owner[order]
            rows: dict = {f.name: [] for f in _PRE}
            for s, m in zip(*_runs(bucket)):
                at, counts = _runs(owner[s : s + m])
                own = owner[s : s + m][at]
                for name, v in zip(_PRE.names, (int(bucket[s]), keys[own].tobytes(), sizes[own].astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), gram[s : s + m].tobytes())):
                    rows[name].append(v)
            yield _binaries(rows, _PRE)

    return run


_WANT = pa.schema([("key", pa.int64()), ("other", pa.int64())])


def _meets(threshold: float):
    """(set, block): blocks in which a set meets another one in a prefix n-gram, with
    sizes that allow the threshold. Never more rows than pairs that meet, and for many
    sets that all meet only one row for each set and block."""

    def run(t: pa.Table) -> pa.Table:
        keys, size, gram = (_joined(t, c, k) for c, k in (("keys", np.int64), ("sizes", np.int32), ("grams", np.uint64)))
        place = np.repeat(np.arange(len(keys)), _joined(t, "counts", np.int32))
        order = np.lexsort((keys[place], gram))
        place, gram = place[order], gram[order]
        starts, lengths = _runs(gram)
        own, back = np.unique(keys, return_inverse=True)
        block, of = np.unique(own >> BLOCK_BITS, return_inverse=True)
        found = [np.zeros(0, np.int64)]

        def add(a, b):
            found.append(np.unique(back[a].astype(np.int64) * len(block) + of[back[b]]))

        for k in np.unique(lengths[(lengths > 1) & (lengths <= 64)]):
            x, y = np.nonzero(~np.eye(k, dtype=bool))
            every = starts[lengths == k]
            for lo in range(0, len(every), max(1, (1 << 20) // (k * k))):
                group = place[every[lo : lo + max(1, (1 << 20) // (k * k))][:, None] + np.arange(k)]
                a, b = group[:, x].ravel(), group[:, y].ravel()
                near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
                add(a[near], b[near])
        for s, k in zip(starts[lengths > 64], lengths[lengths > 64]):
            group = place[s : s + k]
            blocks, one, number = np.unique(of[back[group]], return_index=True, return_counts=True)
            for i, b, n in zip(one, blocks, number):
                others = group if n > 1 else group[of[back[group]] != b]
                add(others, np.full(len(others), group[i]))
            if len(found) > 256:
                found[:] = [np.unique(np.concatenate(found))]
        code = np.unique(np.concatenate(found))
        return pa.table([own[code // len(block)] if len(code) else code, block[code % len(block)] if len(code) else code], schema=_WANT)

    return run


_CELL = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("fragment", pa.int32()), ("key", pa.int64()), ("size", pa.int32()), ("weight", pa.int64()), ("lengths", pa.binary()), ("grams", pa.binary())])


def _cut(parts: int):
    """Send each set to its cells (a pair of blocks), cut into `parts` vertical
    fragments, which are ranges of the order of mixed hashes."""

    def run(batches):
        for batch in batches:
            rows: dict = {f.name: [] for f in _CELL}
            size = 0
            for key, n, weight, grams, others in zip(*(batch.column(c).to_pylist() for c in ("key", "size", "weight", "grams", "others"))):
                gram = np.sort(mix(np.frombuffer(grams, np.uint64)))
                edges = np.searchsorted(gram, (np.arange(1, parts, dtype=np.float64) * 2.0**64 / parts).astype(np.uint64))
                pieces = np.split(gram, edges)
                lengths = np.array([len(p) for p in pieces], np.int32).tobytes()
                own = key >> BLOCK_BITS
                for o in others:
                    for f, piece in enumerate(pieces):
                        for name, x in zip(_CELL.names, (min(own, o), max(own, o), f, key, n, weight, lengths, piece.tobytes())):
                            rows[name].append(x)
                    size += len(gram)
                if size > 1 << 20 or len(rows["i"]) > 20_000:
                    yield _binaries(rows, _CELL)
                    rows, size = {f.name: [] for f in _CELL}, 0
            yield _binaries(rows, _CELL)

    return run


_PARTIAL = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("weights", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary())])


def _counted(doc: np.ndarray, gram: np.ndarray, total: int) -> np.ndarray:
    """(total, total): common n-grams of each pair x < y of sets. An n-gram of few sets
    lists its pairs; those of HEAVY sets or more are the columns of a 0/1 matrix whose
    square has the counts."""
    order = np.lexsort((doc, gram))
    doc, gram = doc[order], gram[order]
    starts, n = _runs(gram)
    out = np.zeros(total * total, np.int32)
    for k in np.unique(n[(n > 1) & (n < HEAVY)]):
        x, y = np.triu_indices(k, 1)
        every = starts[n == k]
        step = max(1, (1 << 19) // (k * k))
        for lo in range(0, len(every), step):
            group = doc[every[lo : lo + step][:, None] + np.arange(k)]
            code, c = np.unique(group[:, x] * total + group[:, y], return_counts=True)
            out[code] += c.astype(np.int32)
    out = out.reshape(total, total)
    heavy = np.flatnonzero(n >= HEAVY)
    if len(heavy):
        square = np.zeros((total, total), np.float32)
        for lo in range(0, len(heavy), 1024):
            cols = heavy[lo : lo + 1024]
            col, inside = _expand(n[cols])
            x = np.zeros((total, len(cols)), np.float32)
            x[doc[starts[cols][col] + inside], col] = 1
            square += x @ x.T
        out += np.triu(square, 1).astype(np.int32)
    return out


def _partial(threshold: float):
    """The overlaps of all pairs of one cell within one fragment. A pair that cannot
    reach the threshold even if the shorter segment of every other fragment were
    wholly shared is left out."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("key").to_numpy())
        t = t.take(pa.array(order))
        keys, size, weight = (t.column(c).to_numpy() for c in ("key", "size", "weight"))
        i, j, f = (t.column(c)[0].as_py() for c in ("i", "j", "fragment"))
        lengths = np.array([np.frombuffer(x, np.int32) for x in t.column("lengths").to_pylist()])
        grams = [np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()]
        counts = _counted(np.repeat(np.arange(len(keys)), [len(g) for g in grams]), np.concatenate(grams), len(keys))
        a, b = np.nonzero(counts)
        c = counts[a, b]
        if i != j:  # pairs within a block belong to the cell of that block
            block = keys >> BLOCK_BITS
            across = block[a] != block[b]
            a, b, c = a[across], b[across], c[across]
        most = c + np.minimum(lengths[a], lengths[b]).sum(1) - np.minimum(lengths[a, f], lengths[b, f])
        ok = most * (1 + threshold) >= threshold * (size[a].astype(np.int64) + size[b]) - 1e-6
        code = (a[ok] * len(keys) + b[ok]).astype(np.uint32)
        row = (i, j, keys.tobytes(), size.astype(np.int32).tobytes(), weight.tobytes(), code.tobytes(), c[ok].astype(np.int32).tobytes())
        return pa.Table.from_arrays([pa.array([v], x.type) for v, x in zip(row, _PARTIAL)], schema=_PARTIAL)

    return run


def _similar(t: pa.Table, threshold: float):
    """Sum the partial overlaps of each pair of a cell: (keys, weights, x, y, overlap,
    Jaccard) of the pairs at the threshold, x and y as places in keys."""
    keys, size, weight = (np.frombuffer(t.column(c)[0].as_py(), k) for c, k in (("keys", np.int64), ("sizes", np.int32), ("weights", np.int64)))
    code, back = np.unique(_joined(t, "pairs", np.uint32), return_inverse=True)
    c = np.bincount(back, weights=_joined(t, "counts", np.int32), minlength=len(code)).astype(np.int64)
    x, y = code.astype(np.int64) // len(keys), code.astype(np.int64) % len(keys)
    similar = c / (size[x].astype(np.int64) + size[y] - c)
    ok = similar >= threshold
    return keys, weight, x[ok], y[ok], c[ok], similar[ok]


_LINK = pa.schema([("key", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _links(threshold: float):
    """For each set with a partner in the cell: its partners, copies counted, and the
    least set that links within the cell lead to."""

    def run(t: pa.Table) -> pa.Table:
        keys, weight, x, y, _, _ = _similar(t, threshold)
        links = np.bincount(x, weights=weight[y], minlength=len(keys)) + np.bincount(y, weights=weight[x], minlength=len(keys))
        root, before = np.arange(len(keys)), None
        while before is None or (root != before).any():
            before = root.copy()
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            root = root[root]
        linked = links > 0
        return pa.table([keys[linked], links[linked].astype(np.int64), keys[root[linked]]], schema=_LINK)

    return run


_PAIR = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("overlap", pa.int32()), ("jaccard", pa.float64())])


def _pairs(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        keys, _, x, y, c, similar = _similar(t, threshold)
        return pa.table([keys[x], keys[y], c.astype(np.int32), similar], schema=_PAIR)

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): _BIN, pa.float64(): "double"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _sets(df: DataFrame, id_col: str, text_col: str, n: int, threshold: float, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sets, partial counts): documents (id, h, size, s1, s2), once each;
    sets (key, size, s1, s2, weight, least, least_h), once for equal ones that may
    have a partner; partial overlaps by cell and fragment."""
    small_batches(df.sparkSession)
    keyed = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL").select("id", F.xxhash64("id", "text").alias("hash"), "text")
    # the fragment implies the leading 8 bits or more of a hash, and 56 are stored
    tasks = tasks_for(df, 16 << 20, 8, 2.0)
    bits = min(24, max(8, round(math.log2(tasks))))
    segments = keyed.mapInArrow(lean(_segments(n, bits)), _ddl(_SEG))
    shared = segments.groupBy("frag").applyInArrow(lean(_shared(bits)), _ddl(_SHARED))
    # one file for each 32 MB of input, however small the partitions of a shuffle are
    live = stored(shared.repartition(max(1, tasks // 4), "chunk").groupBy("chunk").applyInArrow(lean(_live(threshold)), _ddl(_LIVE)), "jaccard-live", plain=True)
    docs = live.groupBy("id", "h").agg(F.min(F.struct("chunk", "no", "size", "s1", "s2", "home")).alias("d")).select("id", "h", "d.*")
    docs = stored(docs, "jaccard-docs", plain=True)
    able = docs.where("s1 IS NOT NULL").groupBy("s1", "s2", "size")
    sets = stored(able.agg(F.count("*").alias("weight"), F.min(F.struct("id", "h")).alias("least"), F.min(F.struct("chunk", "no")).alias("rep"), F.min("home").alias("home")), "jaccard-sets", plain=True)
    # keys follow the order of homes, so that similar sets are mostly in one block
    order = sets.repartitionByRange("home", "s1", "s2").sortWithinPartitions("home", "s1", "s2")
    sets = stored(order.select(F.monotonically_increasing_id().alias("key"), "size", "s1", "s2", "weight", F.col("least.id").alias("least"), F.col("least.h").alias("least_h"), "rep.chunk", "rep.no"), "jaccard-sets", plain=True)
    reps = live.where("s1 IS NOT NULL").select("chunk", "no", "prefix", "grams").join(small(sets.select("chunk", "no", "key", F.abs("size").alias("size"), "weight"), 48), ["chunk", "no"])
    met = reps.select("key", "size", "prefix", "grams").mapInArrow(lean(_prefixes(bits - 2)), _ddl(_PRE)).groupBy("bucket").applyInArrow(lean(_meets(threshold)), _ddl(_WANT))
    wants = stored(met.groupBy("key").agg(F.collect_set("other").alias("others")), "jaccard-wants", plain=True)
    cells = reps.select("key", "size", "weight", "grams").join(small(wants, 40), "key").mapInArrow(lean(_cut(parts)), _ddl(_CELL))
    return docs, sets, cells.groupBy("i", "j", "fragment").applyInArrow(lean(_partial(threshold)), _ddl(_PARTIAL))


def representative_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, parts: int = PARTS) -> DataFrame:
    """(doc_id_a, doc_id_b, overlap, jaccard): all pairs of different sets of n-grams at
    the threshold, each set under its least identifier; documents() tells the copies.
    Odd rows are handled as there. The number of rows may grow with the square of the
    number of near copies of one text."""
    _, sets, partial = _sets(df, id_col, text_col, n, threshold, parts)
    pairs = partial.groupBy("i", "j").applyInArrow(lean(_pairs(threshold)), _ddl(_PAIR))
    x, y = sets.select(F.col("key").alias("x"), F.col("least").alias("p")), sets.select(F.col("key").alias("y"), F.col("least").alias("q"))
    return pairs.join(x, "x").join(y, "y").select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b"), "overlap", "jaccard")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, parts: int = PARTS) -> DataFrame:
    """(id, h, class_id, class_h, links): every document, which is a distinct pair of
    identifier and text (h: xxhash64 of both), with the least document of its class and
    the number of documents whose sets of word n-grams have a Jaccard similarity of at
    least threshold with its own. Classes are what such links connect.

    The global order of n-grams is cut into fragments by hash range; each fragment
    counts, apart from the others, the documents of its n-grams. The sums per document
    decide exactly which documents can have a partner at all. Equal sets are counted
    as one with a weight. Sets that meet in a prefix of the order (frequency, hash),
    with n-grams that few documents share first, are candidates; similar sets mostly
    lie in one block of 1,024, and a set is sent to the blocks in which it meets
    another. A pair of blocks is counted in `parts` vertical fragments by different
    tasks; their partial overlaps are summed per pair. There is no cap and no sampling:
    the result is exact up to equality of 64-bit hashes of n-grams.

    Words are what white space divides, lower-cased. A text of fewer than n words has
    one n-gram, of all its words; null, empty or blank texts have none and no link.
    Rows with a null identifier are left out. Rows repeated as a whole count once;
    different texts under one identifier are documents of their own. Texts of any
    length are read whole. An empty table gives no rows. Other columns are not read.
    Identifiers are whole numbers, or strings of such.
    """
    docs, sets, partial = _sets(df, id_col, text_col, n, threshold, parts)
    linked = stored(partial.groupBy("i", "j").applyInArrow(lean(_links(threshold)), _ddl(_LINK)), "jaccard-links", plain=True)
    roots = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")), "jaccard-cc", plain=True).select(F.col("node").alias("key"), "root")
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    full = sets.select("key", "size", "s1", "s2", "weight", F.struct("least", "least_h").alias("least")).join(links, "key", "left").join(roots, "key", "left")
    full = stored(full.withColumn("root", F.coalesce("root", "key")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1), "jaccard-full", plain=True)
    classes = full.groupBy("root").agg(F.min("least").alias("c"))
    full = stored(full.where("links > 0").join(small(classes, 32), "root").select("size", "s1", "s2", "links", "c"), "jaccard-classes", plain=True)
    out = docs.join(small(full, 56), ["size", "s1", "s2"], "left")
    return out.select("id", "h", F.coalesce("c.least", "id").alias("class_id"), F.coalesce("c.least_h", "h").alias("class_h"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, parts: int = PARTS) -> DataFrame:
    """(id_col, class_id, n_links) for every document of documents(): class_id is the
    least identifier of the class, its own where there is no link."""
    found = documents(df, id_col, text_col, n, threshold, parts)
    return found.select(F.col("id").alias(id_col), "class_id", F.col("links").alias("n_links"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """df with one document of each class of documents(), that of the least identifier;
    all columns are kept. A document is an identifier with its text, so other texts
    under the identifier of a dropped one stay. Rows that repeat the kept document stay
    too, as do rows with a null identifier or without a word. Clashing column names do
    not matter. An empty table stays empty."""
    away = documents(df, id_col, text_col, n, threshold).where("id <> class_id OR h <> class_h")
    x_id, x_h = free_names(df, "_near_id", "_near_h")
    away = stored(away.select(F.col("id").alias(x_id), F.col("h").alias(x_h)), "near-away", plain=True)
    own = df[id_col].cast("long")
    return df.join(small(away, 32), (own == F.col(x_id)) & (F.xxhash64(own, df[text_col]) == F.col(x_h)), "left_anti")


def op5_ngram_jaccard(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM documents
  WHERE text IS NOT NULL AND doc_id IS NOT NULL),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < {N} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {N} + 2), lambda i: array_to_string(ws[i : i + {N} - 1], ' ')) END) AS gram
  FROM w WHERE len(ws) > 0),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= {THRESHOLD}),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents WHERE doc_id IS NOT NULL UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
k AS (SELECT d, min(c) AS class_id FROM r GROUP BY d)
SELECT d AS doc_id, class_id, (SELECT count(*) FROM e WHERE e.a = k.d) AS n_links FROM k
"""
