"""Golden values of the scalar rules, and native forms against independent ones."""

import random

import pytest
from pyspark.sql import functions as F

from lemmaforge.functions import edits as E
from lemmaforge.functions import text as T
from lemmaforge.functions.register import edit, register
from lemmaforge.operators.tokens import sentences, sentences_native, token_spans, tokens, tokens_native


def one(spark, expr_of, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(expr_of(*map(F.col, names)).alias("x")).first()["x"]


PAIRS = [
    ("המטענים", "מטען", 1.0, "1¦¦3¦ן", "מטען"),
    ("בספרו", "ספר", 1.0, "1¦¦1¦", "ספר"),
    ("היא", "הוא", 0.6667, "0¦¦2¦וא", "הוא"),
    ("הם", "הוא", 0.3333, "0¦¦1¦וא", "הוא"),
    ("נשים", "איש", 0.3333, "1¦אי¦2¦", "איש"),
    ("הם", "אני", 0.0, "R¦אני", "אני"),
    ("", "אב", 0.0, "R¦אב", "אב"),
    ("אב", "", 0.0, "R¦", ""),
    ("צפו", "צפה", 0.6667, "0¦¦1¦ה", "צפה"),
]


def test_edit_goldens(spark):
    df = spark.createDataFrame([p[:2] for p in PAIRS], "form string, lemma string")
    f, m = F.col("form"), F.col("lemma")
    out = df.select(E.coverage(f, m), E.coverage_native(f, m), E.derive_script(f, m), E.derive_script_native(f, m), E.apply_script(f, E.derive_script(f, m))).collect()
    for p, r in zip(PAIRS, out):
        assert round(r[0], 4) == p[2] and round(r[1], 4) == p[2]
        assert r[2] == r[3] == p[3] and r[4] == p[4]


@pytest.mark.parametrize("form,script,want", [("המטענים", "1¦¦2¦", "מטען"), ("אב", "2¦¦1¦", "אב"), ("אב", "1¦¦1¦", ""), ("אב", "x¦¦0¦", "אב"), ("אב", "0¦¦0", "אב"), ("גרופ", "0¦¦0¦", "גרוף"), ("אב", "R¦נ", "נ")])
def test_apply_edges(spark, form, script, want):
    assert one(spark, E.apply_script, form, script) == want
    assert edit(form, script) == want


def test_native_forms_agree(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("אבגםמכך") for _ in range(rng.randint(0, 7)))
    df = spark.createDataFrame([(word(), word()) for _ in range(400)], "f string, m string")
    f, m = F.col("f"), F.col("m")
    out = df.select((E.longest_common_substring(f, m) == E.longest_common_substring_native(f, m)).alias("a"), (F.abs(E.coverage(f, m) - E.coverage_native(f, m)) < 1e-12).alias("b"), (E.derive_script(f, m) == E.derive_script_native(f, m)).alias("c"))
    assert out.where("NOT (a AND b AND c)").count() == 0


def test_text_goldens(spark):
    assert one(spark, T.normalize_text, "צה״ל") == 'צה"ל'
    assert one(spark, T.normalize_text, "“x” ג׳ é") == "\"x\" ג' é"
    assert one(spark, T.normalize_text, None) == ""
    assert one(spark, T.sentence_tokens, 'כותב/ת "שלום" ב-3.14 א/ב ו/או 12/2020 - תלמידים/ות') == ["כותב", '"שלום"', "ב-3", "14", "א/ב", "ו/או", "12/2020", "תלמידים"]
    assert one(spark, T.collapse_gender_slash, "חבר/ה חבר/הן א/ת") == "חבר חבר/הן א/ת"
    assert one(spark, T.extract_defs, "# [[a|b]] {{t}} '''x'''.\n#: no\n## no\n#* no\n# <i>y</i> ;\n#") == ["b x", "y"]
    assert one(spark, T.strip_niqqud, " אָב ") == "אב"


DOCS = [
    ("הילדים שיחקו בגן. הם בנו ארמון בחול.", [(0, 0, 6), (0, 7, 12), (0, 13, 16), (0, 16, 17), (1, 18, 20), (1, 21, 24), (1, 25, 30), (1, 31, 35), (1, 35, 36)]),
    ('שלום  עולם!\r\nב-12/2020 עלה 3.14, רמטכ"ל אמר: כותב/ת.', [(0, 0, 4), (0, 6, 10), (0, 10, 11), (1, 13, 14), (1, 14, 15), (1, 15, 22), (1, 23, 26), (1, 27, 31), (1, 31, 32), (1, 33, 39), (1, 40, 43), (1, 43, 44), (1, 45, 51), (1, 51, 52)]),
    ("é a. b", [(0, 0, 1), (0, 2, 3), (0, 3, 4), (1, 5, 6)]),
    ("", []),
    (" \n ", []),
]


def test_token_goldens():
    for text, want in DOCS:
        _, s, e, sent, nospace = token_spans(text)
        assert list(zip(sent.tolist(), s.tolist(), e.tolist())) == want
        for b, flag in zip(e.tolist(), nospace.tolist()):
            assert flag == (b < len(text) and not text[b].isspace())


def test_native_tokenizer_agrees(spark):
    rng = random.Random(9)
    letters = "אב ab1.,!?…\n\r \u0085\u000b\u001c 　\"'/-׳é"
    texts = [t for t, _ in DOCS] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cols = ["doc_id", "sent_id", "tok_idx", "token", "start", "end", "nospace"]
    a, b = tokens(df, words_only=False).select(cols), tokens_native(df).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    x, y = sentences(df), sentences_native(df)
    assert x.columns == y.columns and x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0
    for r in a.collect():
        assert texts[r.doc_id][r.start : r.end] == r.token


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT coverage('בספרו', 'ספר') a, derive_script('הם', 'הוא') b, apply_script('המטענים', '1¦¦2¦') c, normalize_text('ג׳') d, collapse_gender_slash('כותב/ת') e").first()
    assert (r.a, r.b, r.c, r.d, r.e) == (1.0, "0¦¦1¦וא", "מטען", "ג'", "כותב")
    assert [t.token for t in spark.sql("SELECT * FROM tokenize_doc('a b. c')").collect()] == ["a", "b", ".", "c"]


def test_token_counts_of_repeated_keys(spark):
    """Counts by task and counts by document agree; a repeated key is one document."""
    from lemmaforge.operators.tokens import token_counts

    rows = [(i, "a b a. ٣.٤ é x1") for i in range(300)]
    found = lambda r: {x.token: (x.n, x.docs) for x in token_counts(spark.createDataFrame(r, "doc_id long, text string")).collect()}
    assert found(rows) == {"a": (600, 300), "b": (300, 300), "x1": (300, 300)}
    assert found([*rows, (7, "b c"), (8, None)]) == {"a": (600, 300), "b": (301, 300), "x1": (300, 300), "c": (1, 1)}


def test_first_places(spark):
    from lemmaforge.operators.tokens import first_places

    docs = spark.createDataFrame([("u", 10, "B a² a b"), ("u", 0, "c" + " d" * 20 + " b"), ("v", 5, "a"), ("v", None, "z"), (None, 3, None)], "tag string, base long, text string").coalesce(1)
    got = first_places(docs).groupBy("tag", "w").agg({"o": "min"}).collect()
    assert {(r.tag, r.w): r[2] for r in got} == {("u", "b"): 11, ("u", "a"): 12, ("u", "c"): 1, ("u", "d"): 2, ("v", "a"): 6, ("v", "z"): None}
