"""Edit scripts between a word form and its lemma, and the coverage of a lemma."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from ..schema import FINALS, IDENTITY, MEDIALS, SEP


def longest_common_substring_native(a: Column, b: Column) -> Column:
    """struct<i, j, k>: starts in a and b and length; among the longest the leftmost
    in a, then in b. All zero where nothing is common."""
    n = F.char_length(a)
    spans = F.flatten(
        F.transform(
            F.sequence(n, F.lit(1), F.lit(-1)),
            lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda p: F.struct(k.alias("k"), p.alias("p"))),
        )
    )
    hit = F.get(F.filter(spans, lambda z: F.call_function("locate", F.substr(a, z["p"], z["k"]), b) > 0), F.lit(0))
    j = F.call_function("locate", F.substr(a, hit["p"], hit["k"]), b)
    none = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"))
    found = F.struct((hit["p"] - 1).alias("i"), (j - 1).alias("j"), hit["k"].alias("k"))
    return F.when((n == 0) | hit.isNull(), none).otherwise(found)


def derive_script_native(form: Column, lemma: Column) -> Column:
    """What to delete and add at either end of form to get lemma, anchored at their
    longest common substring; a literal where they share no character."""
    m = longest_common_substring_native(form, lemma)
    i, j, k = m["i"], m["j"], m["k"]
    steps = F.concat_ws(SEP, i.cast("string"), F.substr(lemma, F.lit(1), j), (F.char_length(form) - i - k).cast("string"), F.substr(lemma, j + k + 1, F.char_length(lemma)))
    return F.when(k == 0, F.concat(F.lit("R" + SEP), lemma)).otherwise(steps)


def common_substring(form: str, lemma: str) -> tuple[int, int, int]:
    """Starts and length of the longest common substring, leftmost in form, then in
    lemma. Lengths are bisected first, as every part of a common substring is one."""
    low, high = 0, min(len(form), len(lemma))
    while low < high:
        k = (low + high + 1) // 2
        if any(form[i : i + k] in lemma for i in range(len(form) - k + 1)):
            low = k
        else:
            high = k - 1
    if not low:
        return 0, 0, 0
    i = next(i for i in range(len(form) - low + 1) if form[i : i + low] in lemma)
    return i, lemma.index(form[i : i + low]), low


def script_of(word: str, lemma: str) -> str:
    """The edit script that leads from word to lemma."""
    i, j, k = common_substring(word, lemma)
    if not k:
        return f"R{SEP}{lemma}"
    return SEP.join([str(i), lemma[:j], str(len(word) - i - k), lemma[j + k :]])


_IJK = StructType().add("i", IntegerType()).add("j", IntegerType()).add("k", IntegerType())


@F.arrow_udf(_IJK)
def longest_common_substring(form: pa.Array, lemma: pa.Array) -> pa.Array:
    """longest_common_substring_native() in Arrow batches; null beside a null."""
    rows = [None if a is None or b is None else dict(zip("ijk", common_substring(a, b))) for a, b in zip(form.to_pylist(), lemma.to_pylist())]
    return pa.array(rows, pa.struct([("i", pa.int32()), ("j", pa.int32()), ("k", pa.int32())]))


@F.arrow_udf(StringType())
def derive_script(form: pa.Array, lemma: pa.Array) -> pa.Array:
    """derive_script_native() in Arrow batches; null beside a null."""
    return pa.array([None if a is None or b is None else script_of(a, b) for a, b in zip(form.to_pylist(), lemma.to_pylist())], pa.string())


def apply_script(form: Column, script: Column, allow_literal: bool = True) -> Column:
    """The edited form. A malformed script, a negative count or one that deletes more
    than there is leaves the form; an edited form gets its last letter in final
    shape. allow_literal=False takes literal scripts as malformed."""
    p = F.split(script, SEP, -1)
    pre, suf = F.get(p, F.lit(0)).try_cast("int"), F.get(p, F.lit(2)).try_cast("int")
    n = F.char_length(form)
    bad = (F.size(p) != 4) | pre.isNull() | suf.isNull() | (pre < 0) | (suf < 0) | (pre + suf > n)
    core = F.concat(F.get(p, F.lit(1)), F.substr(form, pre + 1, n - pre - suf), F.get(p, F.lit(3)))
    shaped = F.concat(F.substr(core, F.lit(1), F.char_length(core) - 1), F.translate(F.right(core, F.lit(1)), MEDIALS, FINALS))
    literal = F.startswith(script, F.lit("R" + SEP))
    edited = F.when(F.coalesce(bad, F.lit(True)), form).when(core == "", F.lit("")).otherwise(shaped)
    return F.when(literal, F.substr(script, F.lit(3), F.char_length(script)) if allow_literal else form).otherwise(edited)


def coverage_native(form: Column, lemma: Column) -> Column:
    """coverage() without Python: the rows of the dynamic program by aggregate."""
    chars = lambda c: F.filter(F.split(F.translate(c, FINALS, MEDIALS), ""), lambda x: x != "")
    b = chars(lemma)
    m = F.size(b)
    zero = F.array_repeat(F.lit(0), m + 1)

    def row(prev, c):
        def cell(cur, j):
            best = F.when(F.get(b, j - 1) == c, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.get(cur, j - 1)))
            return F.concat(cur, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), m), F.array(F.lit(0)), cell)

    total = F.get(F.aggregate(chars(form), zero, row), m)
    return F.when(m == 0, F.lit(0.0)).otherwise(total / m)


_FOLD = str.maketrans(FINALS, MEDIALS)


def lcs_share(word: str, lemma: str) -> float:
    """Length of the longest common subsequence over the length of lemma, final
    letters folded, by one machine-word addition for each character of word."""
    word, lemma = word.translate(_FOLD), lemma.translate(_FOLD)
    if not lemma:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(lemma):
        masks[c] = masks.get(c, 0) | 1 << i
    full = v = (1 << len(lemma)) - 1
    for c in word:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return (len(lemma) - v.bit_count()) / len(lemma)


@F.arrow_udf(DoubleType())
def coverage(form: pa.Array, lemma: pa.Array) -> pa.Array:
    """Share of the lemma's characters that occur in order in the form."""
    return pa.array([None if f is None or b is None else lcs_share(f, b) for f, b in zip(form.to_pylist(), lemma.to_pylist())], pa.float64())


def script_vocab(pairs: DataFrame, min_count: int = 1, form: str = "form", lemma: str = "lemma", order: str = "row_id") -> DataFrame:
    """(script_id, script, n) of the scripts of all pairs, most frequent first, ties
    by first occurrence; the identity comes last if it is not among them."""
    scripts = pairs.select(derive_script(F.col(form), F.col(lemma)).alias("script"), F.col(order).alias("o"))
    one = pairs.sparkSession.createDataFrame([(IDENTITY, None, 0)], f"script string, o {dict(scripts.dtypes)['o']}, k int")
    counted = scripts.withColumn("k", F.lit(1)).union(one).groupBy("script").agg(F.sum("k").alias("n"), F.min("o").alias("first"))
    enough = F.col("n") >= max(min_count, 1)
    kept = counted.where(enough | (F.col("script") == IDENTITY))
    both = kept.select("script", F.when(enough, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n"), F.when(enough, F.col("first")).alias("first"))
    ranked = both.withColumn("script_id", F.expr("row_number() OVER (ORDER BY n DESC, first NULLS LAST, script) - 1"))
    return ranked.select("script_id", "script", "n")
