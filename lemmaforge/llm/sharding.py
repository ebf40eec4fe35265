"""Operator 1: sharding by extendible hashing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, small, stored, table

BITS = 60
STEP = 12
SPARE = 3
MAX_BYTES = 32 << 20


def _prefix(hash_col: str, bits) -> F.Column:
    return F.expr(f"shiftright({hash_col}, {BITS} - {bits})")


def _rounds(keyed: DataFrame, max_bytes: int) -> list[tuple[DataFrame, int]]:
    """[(cell, depth, shard_bytes, oversized) of each round, bits of its cells].

    A cell is a number of leading bits of a hash. All rows are counted once into cells
    of SPARE bits more than evenly filled shards need, and sums of cells give the size
    of every bucket above them; a bucket is a leaf where it fits and the bucket above
    it does not. Only cells that are still too large are counted again, STEP bits
    deeper, so later rounds follow the hot keys alone, and a round has about 8 cells
    for each shard, however large the table. A cell of 60 bits holds one key and stays
    whole.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    found, pending, base = [], None, 0
    while True:
        bits = min(BITS, base + STEP if base else math.ceil(math.log2(max(1, total / max_bytes))) + SPARE)
        part = keyed
        if pending is not None:
            part = keyed.withColumn("above", _prefix("hash", base)).join(small(pending, 16), "above", "left_semi")
        cells = stored(part.groupBy(_prefix("hash", bits).alias("cell")).agg(F.sum("size").alias("bytes")), "shard-cells")
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(bits)))).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        buckets = stored(levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes")), "shard-buckets")
        over = buckets.where(F.col("bytes") > max_bytes)
        split = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("half"))
        fits = buckets.where(F.col("bytes") <= max_bytes).withColumn("half", F.shiftright("prefix", 1))
        leaves = fits.join(split, ["depth", "half"], "left_semi")
        if base == 0:
            leaves = leaves.unionByName(fits.where("depth = 0"))
        leaves = leaves.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.lit(False).alias("oversized"))
        last = bits >= BITS
        if last:
            leaves = leaves.union(over.where(F.col("depth") == bits).select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.lit(True).alias("oversized")))
        found.append((stored(levels.select("cell", "depth", "prefix").join(leaves, ["depth", "prefix"]).select("cell", F.col("depth").alias("shard_depth"), "shard_bytes", "oversized"), "shard-leaves"), bits))
        pending = over.where(F.col("depth") == bits).select(F.col("prefix").alias("above"))
        if last or pending.isEmpty():
            return found
        base = bits


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Give every row a shard whose documents have at most max_bytes of text.

    The directory is indexed by the leading bits of a 60-bit hash of the identifier
    (the first 15 hexadecimal digits of its MD5). It starts as one bucket; a bucket
    over the limit is split on the next bit, others stay as they are.

    Returns (id_col, shard, shard_depth, shard_bytes, oversized), one row for each
    input row; shard is the prefix as a string of shard_depth bits ("" for an
    undivided table). A null or empty text has 0 bytes; null identifiers share the
    key "null"; repeated identifiers share a shard. Rows of one key that exceed the
    limit by themselves, such as one very long text, form a shard of full depth
    marked oversized. An empty table gives no rows. Other columns are not read.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    keyed = df.select(
        F.col(id_col).alias("id"),
        F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("long").alias("hash"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("size"),
    )
    # the rows are narrow (24 bytes): stored once, so that texts are read once
    keyed = stored(keyed, "shard-keys")
    out = []
    for leaves, bits in _rounds(keyed, max_bytes):
        at = keyed.withColumn("cell", _prefix("hash", bits)).join(small(leaves, 128), "cell")
        out.append(at.select("id", F.expr(f"substring(lpad(bin(hash), {BITS}, '0'), 1, shard_depth)").alias("shard"), "shard_depth", "shard_bytes", "oversized"))
    first = out[0]
    for more in out[1:]:
        first = first.union(more)
    return first.withColumnRenamed("id", id_col)


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> str:
    """Write df as one folder of Parquet files for each shard of assign_shards(), and
    return the name of the column that has the shard ("s" and its prefix): _shard, with
    underscores added where df has such a column. All rows are written, those with null
    identifiers or texts and repeated ones too; an empty table writes no shard."""
    own, name = free_names(df, "_shard_id", "_shard")
    shards = assign_shards(df, id_col, text_col, max_bytes).select(F.col(id_col).alias(own), F.concat(F.lit("s"), "shard").alias(name)).distinct()
    whole = df.join(shards, df[id_col].eqNullSafe(shards[own])).drop(own)
    whole.repartition(name).write.partitionBy(name).parquet(path)
    return name


def op1_sharding(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))


SQL = f"""
WITH k AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::UBIGINT::BIGINT AS h,
         coalesce(strlen(text), 0) AS b FROM documents),
l AS (SELECT h, b, doc_id, d, h >> ({BITS} - d) AS p FROM k, (SELECT unnest(range(0, {BITS + 1})) AS d)),
s AS (SELECT d, p, sum(b) AS bytes FROM l GROUP BY d, p),
f AS (SELECT l.doc_id, l.h, l.d, s.bytes FROM l JOIN s ON s.d = l.d AND s.p = l.p WHERE s.bytes <= {MAX_BYTES} OR l.d = {BITS}),
g AS (SELECT doc_id, any_value(h) AS h, min(d) AS depth, arg_min(bytes, d) AS bytes FROM f GROUP BY doc_id)
SELECT doc_id, substr(lpad(bin(h), {BITS}, '0'), 1, depth) AS shard, CAST(depth AS INTEGER) AS shard_depth,
       CAST(bytes AS BIGINT) AS shard_bytes, bytes > {MAX_BYTES} AS oversized FROM g
"""
