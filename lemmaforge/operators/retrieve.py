"""Top-1 retrieval: the bank lemma of greatest cosine similarity for each row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 64 << 20
#: Rows and lemmas of one matrix product: 4 MB of similarities.
TILE = 256, 2048


def _search(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the first row of e of greatest product, and the product. Tile
    by tile, so that memory does not follow the number of rows times lemmas."""
    place, best = np.zeros(len(q), np.int64), np.full(len(q), -np.inf)
    for lo in range(0, len(q), TILE[0]):
        part = q[lo : lo + TILE[0]]
        at, top = place[lo : lo + TILE[0]], best[lo : lo + TILE[0]]
        for k in range(0, len(e), TILE[1]):
            s = part @ e[k : k + TILE[1]].T
            j = s.argmax(1)
            v = s[np.arange(len(j)), j]
            more = (v > top) | (np.isnan(v) & ~np.isnan(top))
            at[more], top[more] = j[more] + k, v[more]
    return place, best


class _Block:
    """The bank rows of one cell, in the order of their identifiers."""

    def __init__(self, parts: list, keep_unknown_pos: bool):
        ids, vectors, tags = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(ids, kind="stable")
        self.ids, self.e = ids[order], vectors[order]
        by_tag: dict = {}
        bare = []
        for i, found in enumerate(tags[order]):
            for t in set(found) if found else ():
                by_tag.setdefault(t, []).append(i)
            if not found and keep_unknown_pos:
                bare.append(i)
        self.bare = np.array(bare, np.int64)
        self.by_tag = {t: np.union1d(np.array(x, np.int64), self.bare) for t, x in by_tag.items()}
        self.last = None, None

    def fit(self, tag: str | None):
        """(identifiers, vectors) of the lemmas that fit a tag; None without any."""
        at = self.by_tag.get(tag, self.bare) if tag else self.bare[:0]
        if not len(at):
            return None
        if self.last[0] != tag:
            self.last = tag, (self.ids[at], self.e[at])
        return self.last[1]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1)


def _best(keep_unknown_pos: bool):
    """Rows come by cell, the bank's part of the cell first."""

    def run(batches):
        cell, parts, block = None, [], None
        for batch in batches:
            cells, of_bank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "of_bank"))
            edges = np.flatnonzero((cells[1:] != cells[:-1]) | (of_bank[1:] != of_bank[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(cells)]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if cells[lo] != cell:
                    cell, parts, block = cells[lo], [], None
                if of_bank[lo]:
                    tags = np.empty(hi - lo, object)
                    tags[:] = part.column("tags").to_pylist()
                    parts.append((part.column("lemma_id").to_numpy(), _matrix(part.column("v"), hi - lo), tags))
                    continue
                if block is None:
                    if not parts:
                        continue
                    block, parts = _Block(parts, keep_unknown_pos), []
                pos = part.column("pos").to_pylist()
                q = _matrix(part.column("v"), hi - lo)
                ids, sims, filtered = np.zeros(len(q), np.int64), np.zeros(len(q)), np.zeros(len(q), bool)
                whole = []
                for tag in sorted(set(filter(None, pos))):
                    at = np.array([i for i, x in enumerate(pos) if x == tag])
                    found = block.fit(tag)
                    if found is None:
                        whole.append(at)
                        continue
                    j, s = _search(q[at], found[1])
                    ids[at], sims[at], filtered[at] = found[0][j], s, True
                whole.append(np.array([i for i, x in enumerate(pos) if not x], np.int64))
                at = np.concatenate(whole)
                j, s = _search(q[at], block.e)
                ids[at], sims[at] = block.ids[j], s
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(filtered), pa.array(ids), pa.array(sims)], names=["row", "filtered", "lemma_id", "sim"])

    return run


def top1(rows: DataFrame, bank: DataFrame, row_id: str, q: str = "q", pos: str | None = None, keep_unknown_pos: bool = False) -> DataFrame:
    """(row_id, lemma_id, sim): ties go to the least lemma_id.

    With pos, lemmas are those whose tags hold the row's tag; rows without a tag, and
    tags that no lemma has, search the whole bank. A lemma without tags fits no tag
    unless keep_unknown_pos.

    The bank is dealt by hash to blocks of about BLOCK_BYTES, the rows to as many strips
    as keep all cores busy; every pair of strip and block is a cell. A cell's task holds
    its block and reads its rows as a stream, so nothing is broadcast and a task's memory
    depends neither on the number of rows nor on that of lemmas. The work stays rows
    times lemmas.
    """
    kind = dict(rows.dtypes)[row_id]
    sc = rows.sparkSession.sparkContext
    of = bank.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    blocks = max(1, -(-of["n"] * 8 * (of["d"] or 1) // BLOCK_BYTES))
    strips = -(-3 * max(8, sc.defaultParallelism) // blocks)
    vector = "array<float>" if {dict(rows.dtypes)[q], dict(bank.dtypes)["embedding"]} == {"array<float>"} else "array<double>"
    tag, none = F.col(pos) if pos else F.lit(None), F.lit(None)
    tags = F.col("pos_tags") if "pos_tags" in bank.columns else none
    strip = F.pmod(F.xxhash64(row_id), F.lit(strips)).cast("int")
    left = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * strips + strip)).alias("cell"), F.lit(False).alias("of_bank"), F.col(row_id).alias("row"), tag.cast("string").alias("pos"), none.cast("long").alias("lemma_id"), none.cast("array<string>").alias("tags"), F.col(q).cast(vector).alias("v"))
    block = F.pmod(F.xxhash64("lemma_id"), F.lit(blocks)).cast("int")
    right = bank.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(strips - 1)), lambda x: block * strips + x)).alias("cell"), F.lit(True).alias("of_bank"), none.cast(kind).alias("row"), none.cast("string").alias("pos"), F.col("lemma_id").cast("long"), tags.cast("array<string>").alias("tags"), F.col("embedding").cast(vector).alias("v"))
    cells = left.union(right).repartitionById(blocks * strips, F.col("cell")).sortWithinPartitions("cell", F.desc("of_bank"), "pos")
    found = cells.mapInArrow(_best(keep_unknown_pos), f"row {kind}, filtered boolean, lemma_id long, sim double")
    best = found.groupBy("row").agg(F.max(F.struct("filtered", "sim", (-F.col("lemma_id")).alias("neg"))).alias("b"))
    return best.select(F.col("row").alias(row_id), (-F.col("b.neg")).alias("lemma_id"), F.col("b.sim").alias("sim"))


def top1_sql(rows: DataFrame, bank: DataFrame, row_id: str, q: str = "q") -> DataFrame:
    """top1() as a plain cross join and maximum; the slow twin for tests."""
    from ..functions.vectors import dot

    both = rows.select(F.col(row_id), F.col(q).alias("_q")).crossJoin(bank.select("lemma_id", "embedding"))
    sim = dot(F.col("_q"), F.col("embedding"))
    best = both.groupBy(row_id).agg(F.max(F.struct(sim.alias("sim"), (-F.col("lemma_id")).alias("neg"))).alias("b"))
    return best.select(row_id, (-F.col("b.neg")).alias("lemma_id"), F.col("b.sim").alias("sim"))
