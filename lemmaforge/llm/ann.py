"""Operator 2: approximate nearest neighbours in robust-pruned directed graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored, table

K = 10
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 80
ALPHA = 1.2
SHARD_ROWS = 10_000
QUERY_ROWS = 65_536
CELL_BYTES = 64 << 20
EVERY = 50


class Graph:
    """A directed graph over unit vectors (rows of x), searched from its medoid.

    neighbours: (n, degree), -1 where there is none. Distances are 1 - cosine.
    """

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
        self.x, self.degree, self.alpha = np.ascontiguousarray(x, np.float32), degree, alpha
        n = len(x)
        self.neighbours = np.full((n, degree), -1, np.int32)
        if n < 2:
            self.entry = np.zeros(1, np.int64)
            return
        rng = np.random.Generator(np.random.PCG64(3))
        mean = self.x.mean(0)
        self.entry = np.unique(np.concatenate(([int(np.argmax(self.x @ mean))], rng.integers(0, n, 7))))
        self.neighbours[:, : min(degree, 16)] = rng.integers(0, n, (n, min(degree, 16)))
        # two passes as in the published construction: plain pruning, then relaxed
        for relax in (1.0, alpha):
            order = rng.permutation(n)
            for s in range(0, n, 1024):
                self._insert(order[s : s + 1024], beam, relax)

    def _insert(self, rows: np.ndarray, beam: int, alpha: float) -> None:
        ids, sims = self.search(self.x[rows], beam, keep=beam)
        old = self.neighbours[rows]
        ids = np.concatenate([ids, old], 1)
        self.neighbours[rows] = self._prune(rows, ids, alpha)
        # the reverse edges; a node whose list is full is pruned again
        source = np.repeat(rows, self.degree)
        target = self.neighbours[rows].ravel()
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        at = np.concatenate(([0], np.flatnonzero(target[1:] != target[:-1]) + 1)) if len(target) else np.zeros(0, np.int64)
        nodes, counts = target[at], np.diff(np.append(at, len(target)))
        # a node of many reverse edges takes them in turns, so that every one is weighed
        turn = 2 * self.degree
        for lo in range(0, len(nodes), 2048):
            part, c, a = nodes[lo : lo + 2048], counts[lo : lo + 2048], at[lo : lo + 2048]
            for skip in range(0, int(c.max()), turn):
                still = c > skip
                p, left, first = part[still], c[still] - skip, a[still] + skip
                place = np.arange(min(turn, int(left.max())))[None, :]
                extra = np.where(place < left[:, None], source[np.minimum(first[:, None] + place, len(source) - 1)], -1)
                self.neighbours[p] = self._prune(p, np.concatenate([self.neighbours[p], extra.astype(np.int32)], 1), alpha, room=True)

    def _prune(self, rows: np.ndarray, ids: np.ndarray, alpha: float, room: bool = False) -> np.ndarray:
        """Robust pruning of candidate lists: take the nearest candidate, drop those
        that are alpha times nearer to it than to the node, repeat. room: lists that
        fit as they are stay unpruned."""
        out = np.full((len(rows), self.degree), -1, np.int32)
        ids = np.sort(ids, 1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        ids[ids == rows[:, None]] = -1
        for lo in range(0, len(rows), 256):
            r, c = rows[lo : lo + 256], ids[lo : lo + 256]
            v = self.x[np.maximum(c, 0)]
            near = np.einsum("rcd,rd->rc", v, self.x[r])
            near[c < 0] = -np.inf
            order = np.argsort(-near, 1)
            c, near = np.take_along_axis(c, order, 1), np.take_along_axis(near, order, 1)
            most = int((c >= 0).sum(1).max()) if c.size else 0
            c, near = c[:, :most], near[:, :most]
            v = np.take_along_axis(v, order[:, :most, None], 1)
            fits = ((c >= 0).sum(1) <= self.degree) if room else np.zeros(len(r), bool)
            if fits.all():
                w = min(most, self.degree)
                out[lo : lo + len(r), :w] = c[:, :w]
                continue
            apart = 1 - v @ v.transpose(0, 2, 1)
            far = 1 - near
            alive = c >= 0
            taken = np.zeros_like(alive)
            count = np.zeros(len(r), np.int64)
            every = np.arange(len(r))
            for _ in range(self.degree):
                first = alive.argmax(1)
                go = alive[every, first]
                if not go.any():
                    break
                taken[every[go], first[go]] = True
                count += go
                alive[every, first] = False
                alive &= ~(go[:, None] & (alpha * apart[every, first] <= far))
            taken[fits] = c[fits] >= 0
            place = np.cumsum(taken, 1) - 1
            i, j = np.nonzero(taken & (place < self.degree))
            out[lo + i, place[i, j]] = c[i, j]
        return out

    def search(self, queries: np.ndarray, beam: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the `keep` nearest found for each query, nearest first,
        by beam search for all queries side by side; -1 and -inf fill short rows."""
        n, m = len(self.x), len(queries)
        beam = max(beam, keep)
        ids = np.full((m, beam), -1, np.int32)
        sims = np.full((m, beam), -np.inf, np.float32)
        done = np.ones((m, beam), bool)
        e = self.entry[: min(beam, len(self.entry))]
        if n:
            ids[:, : len(e)] = e
            sims[:, : len(e)] = queries @ self.x[e].T
            done[:, : len(e)] = False
        seen = np.zeros((m, (n >> 3) + 1), np.uint8)

        def mark(q, v):
            np.bitwise_or.at(seen, (q, v >> 3), (1 << (v & 7)).astype(np.uint8))

        if n:
            mark(np.repeat(np.arange(m), len(e)), np.tile(e, m))
        active = np.arange(m)
        step = 4  # nodes expanded per query and turn
        while len(active):
            a_sims = np.where(done[active], -np.inf, sims[active])
            top = np.argpartition(-a_sims, step - 1, 1)[:, :step] if beam > step else np.tile(np.arange(beam), (len(active), 1))
            good = np.take_along_axis(a_sims, top, 1) > -np.inf
            some = good.any(1)
            active, top, good = active[some], top[some], good[some]
            if not len(active):
                break
            q, t = np.nonzero(good)
            col = top[q, t]
            done[active[q], col] = True
            new = self.neighbours[ids[active[q], col]]
            owner = np.repeat(active[q], self.degree)
            new = new.ravel()
            ok = new >= 0
            owner, new = owner[ok], new[ok]
            ok = (seen[owner, new >> 3] >> (new & 7).astype(np.uint8)) & 1 == 0
            code = np.unique(owner[ok].astype(np.int64) * n + new[ok])
            owner, new = code // n, (code % n).astype(np.int32)
            if not len(owner):
                continue
            mark(owner, new)
            near = np.einsum("ij,ij->i", queries[owner], self.x[new])
            better = near > sims[owner].min(1)
            owner, new, near = owner[better], new[better], near[better]
            if not len(owner):
                continue
            rows, at, counts = np.unique(owner, return_index=True, return_counts=True)
            width = int(counts.max())
            place = np.arange(len(owner)) - np.repeat(at, counts)
            row = np.repeat(np.arange(len(rows)), counts)
            x_ids, x_sims = np.full((len(rows), width), -1, np.int32), np.full((len(rows), width), -np.inf, np.float32)
            x_ids[row, place], x_sims[row, place] = new, near
            all_sims = np.concatenate([sims[rows], x_sims], 1)
            best = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
            sims[rows] = np.take_along_axis(all_sims, best, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], x_ids], 1), best, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros_like(x_ids, bool) | (x_ids < 0)], 1), best, 1)
        order = np.argsort(-sims, 1, kind="stable")[:, :keep]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _unit(batch_or_table, dim: int | None = None) -> np.ndarray:
    column = batch_or_table.column("v")
    rows = column.to_pylist()
    x = np.array(rows, np.float32).reshape(len(rows), -1) if rows else np.zeros((0, dim or 1), np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


_GRAPH = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("edges", pa.binary()), ("entry", pa.binary())])


def _build(degree: int, beam: int, alpha: float):
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        x = _unit(t)
        g = Graph(x, degree, beam, alpha)
        row = [t.column("shard")[0].as_py(), len(x), x.shape[1], t.column("id").to_numpy().astype(np.int64).tobytes(), g.x.tobytes(), g.neighbours.tobytes(), g.entry.astype(np.int64).tobytes()]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _GRAPH)], schema=_GRAPH)

    return run


def _load(row) -> tuple[Graph, np.ndarray]:
    g = Graph.__new__(Graph)
    n, dim = row["n"], row["dim"]
    g.x = np.frombuffer(row["x"], np.float32).reshape(n, dim)
    g.neighbours = np.frombuffer(row["edges"], np.int32).reshape(n, -1)
    g.degree = g.neighbours.shape[1]
    g.entry = np.frombuffer(row["entry"], np.int64)
    return g, np.frombuffer(row["ids"], np.int64)


_HITS = pa.schema([("q", pa.int64()), ("hits", pa.list_(pa.struct([("sim", pa.float32()), ("id", pa.int64())])))])


def _query(k: int, beam: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The graphs of some shards, one after the other, and one block of queries;
        of all hits of a query the k best leave the task."""
        q, hits = [], []
        if left.num_rows and right.num_rows:
            names, x = right.column("id").to_numpy(), _unit(right)
            best_id, best = np.full((len(x), k), np.iinfo(np.int64).max), np.full((len(x), k), -np.inf, np.float32)
            for i in range(left.num_rows):
                g, ids = _load(left.slice(i, 1).to_pylist()[0])
                for s in range(0, len(x), 1024):
                    found, sims = g.search(x[s : s + 1024], beam, k + 1)
                    own = np.where(found >= 0, ids[np.maximum(found, 0)], np.iinfo(np.int64).max)
                    sims = np.where((found < 0) | (own == names[s : s + 1024, None]), -np.inf, sims)
                    all_ids, all_sims = np.concatenate([best_id[s : s + 1024], own], 1), np.concatenate([best[s : s + 1024], sims], 1)
                    order = np.lexsort((all_ids, -all_sims))[:, :k]
                    best_id[s : s + 1024], best[s : s + 1024] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
            q = names.tolist()
            hits = [[{"sim": b, "id": a} for a, b in zip(i, v) if b > -np.inf] for i, v in zip(best_id.tolist(), best.tolist())]
        return pa.Table.from_arrays([pa.array(q, pa.int64()), pa.array(hits, _HITS.field("hits").type)], schema=_HITS)

    return run


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, degree: int = DEGREE, build_beam: int = BUILD_BEAM, search_beam: int = SEARCH_BEAM, alpha: float = ALPHA, shard_rows: int = SHARD_ROWS, every: int = 1) -> DataFrame:
    """(id, neighbour, rank, similarity): for each query the k rows of greatest cosine
    similarity that beam search finds among all rows; rank counts from 1, ties by
    identifier. Queries are the rows whose identifier is divisible by `every`.

    Every row is indexed. Rows are dealt to shards of about shard_rows by a hash of the
    identifier. Each shard builds its graph in one task: greedy searches propose
    neighbours, relaxed pruning keeps edges in diverse directions, and all reverse
    edges are weighed by the same pruning. The graphs are written once. A task takes
    as many shards as CELL_BYTES of graphs allow and a block of QUERY_ROWS queries,
    loads each graph once, and passes on the k best of its shards; so every query is
    searched in every shard and recall does not depend on how rows are dealt. The
    number of beam searches is queries x rows / shard_rows: larger tables want larger
    shards, as far as one task's memory and time to build allow.

    Rows with a null identifier or vector, with null or non-finite components, or
    with another number of dimensions than the most frequent (of equally frequent
    ones the least) are left out. A zero vector has similarity 0 with all. Repeated
    identifiers count once, with their least vector; equal vectors are neighbours of
    similarity 1. A row is never its own neighbour. An empty table gives no rows;
    other columns are not read. Identifiers are whole numbers, or strings of such.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(3e38))))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    rows = stored(rows, "ann-rows")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).orderBy(F.desc("n"), "d").head()
    schema = f"{id_col} long, neighbour long, rank int, similarity float"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes["d"])
    shards = max(1, round(sizes["n"] / shard_rows))
    part = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    kinds = "shard int, n int, dim int, ids binary, x binary, edges binary, entry binary"
    # as many partitions as shards: a partition of two shards would build both in turn
    apart = part.repartition(shards, "shard") if shards < 1 << 16 else part
    graphs = stored(apart.groupBy("shard").applyInArrow(lean(_build(degree, build_beam, alpha)), kinds), "ann-graphs")
    # a cell is a set of shards and a block of queries; both sides are sent to their cells
    together = max(1, int(CELL_BYTES / (sizes["n"] / shards * (4 * sizes["d"] + 4 * degree + 8))))
    together = max(1, min(together, shards // spark.sparkContext.defaultParallelism))
    sets, blocks = (shards - 1) // together + 1, max(1, round(sizes["q"] / QUERY_ROWS))
    queries = rows.where(F.col("id") % every == 0).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    spread = graphs.withColumn("cell", (F.col("shard") % sets).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hits = spread.groupBy("cell", "block").cogroup(queries.groupBy("cell", "block")).applyInArrow(lean(_query(k, search_beam)), "q long, hits array<struct<sim:float,id:long>>")
    best = hits.groupBy("q").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    best = best.select("q", F.slice(F.array_sort(F.transform("hits", lambda h: F.struct((-h["sim"]).alias("far"), h["id"].alias("id")))), 1, k).alias("hits"))
    return best.select(F.col("q").alias(id_col), F.posexplode("hits").alias("rank", "hit")).select(id_col, F.col("hit.id").alias("neighbour"), (F.col("rank") + 1).alias("rank"), (-F.col("hit.far")).alias("similarity"))


def op2_ann(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), every=EVERY)
