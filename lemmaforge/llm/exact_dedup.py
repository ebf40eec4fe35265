"""Operator 8: exact dedup with Patricia tries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, small, stored, table

TRIE_BYTES = 96 << 20


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by comparing halves in C."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Patricia:
    """A radix trie over byte strings whose edges carry whole labels.

    A node is [label, children by first byte, smallest identifier or None].
    """

    def __init__(self, limit: int = TRIE_BYTES):
        self.root = [b"", {}, None]
        self.size, self.limit = 0, limit
        self.spilled: list[bytes] = []

    def insert(self, key: bytes, owner) -> bytes | None:
        """Insert; returns the path of a spilled subtree the key belongs to, if any."""
        for path in self.spilled:
            if key.startswith(path):
                return path
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, owner]
                self.size += len(key) - at + 200
                return None
            label = child[0]
            n = len(label) if key.startswith(label, at) else _common(label, key[at : at + len(label)])
            if n < len(label):
                upper = [label[:n], {label[n]: child}, None]
                child[0] = label[n:]
                node[1][key[at]] = child = upper
                self.size += 200
            node, at = child, at + n
        node[2] = owner if node[2] is None else min(node[2], owner)
        return None

    def find(self, key: bytes):
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None or not key.startswith(child[0], at):
                return None
            node, at = child, at + len(child[0])
        return node[2]

    def spill(self) -> bytes | None:
        """Cut the largest subtree below the first fork; its path is remembered and
        the strings under it are left to a later round. None if there is no fork."""
        path, node = b"", self.root
        while len(node[1]) == 1 and node[2] is None:
            (node,) = node[1].values()
            path += node[0]
        if len(node[1]) < 2:
            return None

        def weight(x):
            todo, total = [x], 0
            while todo:
                y = todo.pop()
                total += len(y[0]) + 200
                todo += y[1].values()
            return total

        first = max(node[1], key=lambda k: weight(node[1][k]))
        child = node[1].pop(first)
        self.size -= weight(child)
        self.spilled.append(path + bytes([first]))
        return self.spilled[-1]


_LOCAL = pa.schema([("id", pa.int64()), ("tid", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("body", pa.binary())])
_LOCAL_SPARK = "id long, tid long, n int, h long, body binary"


def _local(limit: int):
    """Tries of one partition of the input: of each text one string goes on, under a
    number of its own (tid) with its smallest identifier; every row keeps only its
    identifier and that number. So a text that a third of all rows hold moves once for
    each partition. Tries beyond the limit are emptied; a text that comes again then
    moves again."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        tries: dict[tuple, Patricia] = {}
        least: dict[int, int] = {}
        strings: list[tuple] = []

        def emptied():
            rows = [(least[tid], tid, n, h, body) for tid, n, h, body in strings]
            tries.clear(), least.clear(), strings.clear()
            return _batch(rows, _LOCAL)

        for batch in batches:
            rows = []
            for i, n, h, body in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "h", "body"))):
                trie = tries.setdefault((n, h), Patricia())
                tid = trie.find(body)
                if tid is None:
                    tid, number = number, number + 1
                    trie.insert(body, tid)
                    strings.append((tid, n, h, body))
                    least[tid] = i
                least[tid] = min(i, least[tid])
                rows.append((i, tid, None, None, None))
            yield _batch(rows, _LOCAL)
            if sum(t.size for t in tries.values()) > limit:
                yield emptied()
        yield emptied()

    return run


_OUT = pa.schema([("id", pa.int64()), ("tid", pa.int64()), ("owner", pa.int64()), ("left", pa.bool_()), ("n", pa.int32()), ("h", pa.int64()), ("path", pa.binary()), ("body", pa.binary())])
_OUT_SPARK = "id long, tid long, owner long, left boolean, n int, h long, path binary, body binary"


def _tries(limit: int):
    def run(batches):
        """Rows arrive sorted by (n, h, path): one trie at a time is held."""
        key, trie, held, out = None, None, [], []

        def left(i, tid, body, path):
            out.append((i, tid, None, True, key[0], key[1], path, body))

        def close():
            out.extend((i, tid, trie.find(body), False, None, key[1], None, None) for i, tid, body in held)
            held.clear()

        for batch in batches:
            for i, tid, n, h, path, body in zip(*(batch.column(c).to_pylist() for c in ("id", "tid", "n", "h", "path", "body"))):
                if (n, h, path) != key:
                    if trie is not None:
                        close()
                    key, trie = (n, h, path), Patricia(limit)
                away = trie.insert(body, i)
                if away is not None:
                    left(i, tid, body, away)
                else:
                    # equal strings are held once: the list shares the first one's bytes
                    held.append((i, tid, body) if not held or held[-1][2] != body else (i, tid, held[-1][2]))
                while trie.size > limit and (away := trie.spill()) is not None:
                    keep = []
                    for j, t, text in held:
                        left(j, t, text, away) if text.startswith(away) else keep.append((j, t, text))
                    held[:] = keep
                if len(out) >= 5000:
                    yield _batch(out, _OUT)
                    out.clear()
        if trie is not None:
            close()
        yield _batch(out, _OUT)

    return run


def _batch(rows, schema):
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _shaped(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return base.select("id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"), "text")


def _parts(base: DataFrame) -> DataFrame:
    """Length and hash of the texts that more than one row may share."""
    return stored(base.groupBy("n", "h").agg(F.count("*").alias("k"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("k > 1").select("n", "h", F.expr("lo < hi").alias("ids")), "dedup-parts")


def _owners(base: DataFrame, parts: DataFrame, trie_bytes: int) -> DataFrame:
    rows = base.join(small(parts.where("ids"), 32), ["n", "h"], "left_semi").select("id", "n", "h", F.encode("text", "utf-8").alias("body"))
    local = stored(rows.mapInArrow(_local(trie_bytes), _LOCAL_SPARK), "dedup-local")
    rows = local.where("n IS NOT NULL").withColumn("path", F.lit(b""))
    found = None
    while True:
        # equal (n, h, path) meet in one partition, sorted; the sort spills in Spark
        parted = rows.repartition("n", "h", "path").sortWithinPartitions("n", "h", "path")
        done = stored(parted.mapInArrow(_tries(trie_bytes), _OUT_SPARK), "dedup-owners")
        settled = done.where("NOT left").select("tid", "h", "owner")
        found = settled if found is None else found.union(settled)
        rows = done.where("left").select("id", "tid", "n", "h", "path", "body")
        if rows.isEmpty():
            break
    own = local.where("n IS NULL").select("id", "tid").join(small(stored(found, "dedup-strings"), 32), "tid")
    return own.where("id <> owner").select("id", "h", "owner").distinct()


def owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(id, h, owner): each row whose text occurs in a row with a smaller identifier,
    with the smallest identifier of that text; h is the hash of the text.

    Rows are parted by byte length and a 64-bit hash of the content. Parts of one
    row need no text and drop out on the narrow columns; the others insert their
    full byte strings into Patricia tries, so equal hashes of different strings are
    told apart. Each partition of the input does so first and passes one string of
    each text on; these meet in a trie of their length and hash, whose terminal nodes
    hold the smallest identifier. A trie beyond
    trie_bytes cuts off its largest subtree; the strings under it go back to Spark
    under the key of that subtree and take part in another round.

    A null text is never a copy of anything; empty texts are copies of one another.
    Rows with a null identifier are neither owners nor copies. Rows that repeat one
    identifier with one text count once. An empty table gives no rows. Texts of any
    length are compared whole; other columns are not read. Identifiers are whole
    numbers, or strings of such.
    """
    base = _shaped(df, id_col, text_col)
    return _owners(base, _parts(base), trie_bytes)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """df with one row of each text, that of the smallest identifier; all columns are
    kept. Of rows that repeat an identifier and a text one stays, whichever; rows with
    a null text or identifier all stay."""
    base = _shaped(df, id_col, text_col)
    parts = _parts(base)
    x_id, x_n, x_h = free_names(df, "_x_id", "_x_n", "_x_h")
    away = stored(_owners(base, parts, trie_bytes).select(F.col("id").alias(x_id), F.col("h").alias(x_h)), "dedup-away")
    key = parts.select(F.col("n").alias(x_n), F.col("h").alias(x_h))
    shared = (F.octet_length(df[text_col]) == F.col(x_n)) & (F.xxhash64(df[text_col]) == F.col(x_h)) & df[id_col].isNotNull()
    alone = df.join(small(key, 32), shared, "left_anti")
    among = df.join(small(key, 32), shared, "left_semi")
    kept = among.join(small(away, 32), (among[id_col].cast("long") == F.col(x_id)) & (F.xxhash64(among[text_col]) == F.col(x_h)), "left_anti")
    return alone.unionByName(kept.dropDuplicates([id_col, text_col]))


def op8_exact_dedup(spark, sf_dir):
    found = owners(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("owner").alias("owner_id")).distinct()


SQL = """
SELECT doc_id, owner_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS owner_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
WHERE doc_id <> owner_id GROUP BY ALL
"""
