"""Operator 3: bounded-space online packing."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, small_batches, stored, table

WINDOW = 2048
OPEN = 64
MERGE_ROWS = 200_000

_PIECES = "part long, seq long, full boolean, id long, piece int, start long, len int, at int, text string"
_SCHEMA = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("full", pa.bool_()), ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("len", pa.int32()), ("at", pa.int32()), ("text", pa.string())])
_WORD = re.compile(r"\S+", re.ASCII)


class OpenWindows:
    """At most `most` open windows; best fit by bisection on the space left."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.open: list[tuple[int, int]] = []  # (space left, number), sorted
        self.items: dict[int, list] = {}
        self.next = 0

    def place(self, item, size: int):
        """Put item into the fullest open window with room; without one, open a new
        window, closing the fullest first if all places are taken. Returns the
        closed windows as (number, items)."""
        closed = []
        i = bisect.bisect_left(self.open, (size, -1))
        if i == len(self.open):
            if len(self.open) >= self.most:
                _, number = self.open.pop(0)
                closed.append((number, self.items.pop(number)))
            left, number = self.window, self.next
            self.next += 1
            self.items[number] = []
        else:
            left, number = self.open.pop(i)
        self.items[number].append((item, self.window - left))
        left -= size
        if left:
            bisect.insort(self.open, (left, number))
        else:
            closed.append((number, self.items.pop(number)))
        return closed

    def rest(self):
        return [(n, self.items[n]) for _, n in self.open]


def _pack(window: int, most: int):
    def run(batches):
        from pyspark import TaskContext

        part, state, out = TaskContext.get().partitionId(), OpenWindows(window, most), []

        def emit(number, items, full):
            out.extend((part, number, full, *item[:4], at, item[4]) for item, at in items)

        held = 0
        for batch in batches:
            for i, n, text in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "text"))):
                piece = start = 0
                held += len(text or "")
                for body in _bodies(text, n, window):
                    size = min(window, n - start)
                    for number, items in state.place((i, piece, start, size, body), size):
                        emit(number, items, True)
                    start, piece = start + size, piece + 1
                if len(out) > 50000 or held > 8 << 20:
                    yield _rows(out)
                    out, held = [], 0
        for number, items in state.rest():
            emit(number, items, False)
        yield _rows(out)

    return run


def _bodies(text: str | None, n: int, window: int):
    """The texts of the pieces of a document of n tokens (None where no text is asked
    for): from the first word of a piece to that of the next one."""
    pieces = -(-n // window)
    if text is None or pieces == 1:
        return [text] * pieces
    at = [m.start() for k, m in enumerate(_WORD.finditer(text)) if k % window == 0]
    return [text[a:b] for a, b in zip([0, *at[1:]], [*at[1:], len(text)])]


def _rows(out):
    columns = list(zip(*out)) or [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _merge(window: int, most: int):
    """Leftover windows, fullest first within a task, are packed like items."""

    def run(batches):
        from pyspark import TaskContext

        part, state, out = TaskContext.get().partitionId(), OpenWindows(window, most), []
        for batch in batches:
            for p, s, used in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "used"))):
                for number, items in state.place((p, s), used):
                    out += [(p, s, part, number, at) for (p, s), at in items]
        for number, items in state.rest():
            out += [(p, s, part, number, at) for (p, s), at in items]
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "seq", "to_part", "to_seq", "shift"])

    return run


def token_count(col) -> F.Column:
    """Words between white space, counted without splitting the text into an array."""
    text = F.coalesce(col, F.lit(""))
    return F.regexp_count(text, F.lit(r"\S+"))


def pack(df: DataFrame, id_col: str = "doc_id", length=None, window: int = WINDOW, most_open: int = OPEN, text_col: str | None = None) -> DataFrame:
    """Pack documents into windows of `window` tokens.

    Each partition takes its documents as they come and holds at most most_open
    windows: a piece goes where it leaves the least room, a full window is emitted,
    and where none fits the fullest is emitted to make room. A text longer than a
    window is cut into full windows and a remainder, nothing is dropped. The windows
    still open when a partition ends are merged with those of other partitions in
    the same way, fullest first.

    length: a Column with the tokens of a row; by default the words of `text`.
    Returns (window_id, id_col, piece, start, len, at): tokens start .. start + len
    of the document stand at offset `at` of the window. With text_col, whose words are
    then the tokens, a column text has each piece as it stands in the document.

    Which windows come about follows the order of rows in a partition, as online
    packing does. Leftover windows are merged in tasks of about MERGE_ROWS each. Rows without a token (null,
    empty or blank texts, null or negative lengths) occupy nothing and give no row;
    a null identifier stays null; repeated rows are packed as often as they occur.
    An empty table gives no rows. Other columns are not read. Identifiers are whole
    numbers, or strings of such.
    """
    if length is None:
        length = token_count(F.col(text_col or "text"))
    elif text_col:
        raise ValueError("a length of its own goes without text_col")
    text = F.col(text_col) if text_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), length.cast("long").alias("n"), text.alias("text")).where("n > 0")
    wanted = ["id", "piece", "start", "len", "at", *(["text"] if text_col else [])]
    if text_col:
        small_batches(df.sparkSession)
    # stored once: windows of closed and of leftover rows must come from one run
    pieces = stored(rows.mapInArrow(_pack(window, most_open), _PIECES), "pack")
    done = pieces.where("full").select(F.concat_ws("-", F.lit("w"), "part", "seq").alias("window_id"), *wanted)
    left = pieces.where("NOT full")
    bins = left.groupBy("part", "seq").agg(F.sum("len").cast("long").alias("used"))
    groups = left.select("part", "seq").distinct().count() // MERGE_ROWS + 1
    moved = stored(
        bins.repartition(groups, "part", "seq").sortWithinPartitions(F.desc("used"), "part", "seq").mapInArrow(_merge(window, most_open), "part long, seq long, to_part long, to_seq long, shift long"),
        "pack-merge",
    )
    rest = left.join(small(moved, 64), ["part", "seq"]).withColumn("at", (F.col("at") + F.col("shift")).cast("int"))
    rest = rest.select(F.concat_ws("-", F.lit("m"), "to_part", "to_seq").alias("window_id"), *wanted)
    return done.union(rest).withColumnRenamed("id", id_col)


def op3_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
