"""Exact dedup, n-gram join, line dedup: against brute force, and odd rows."""

import random

import pytest
from conftest import DATA, same_as_sql
from pyspark.sql import functions as F

from lemmaforge.llm import common, exact_dedup, line_dedup, ngram_join
from lemmaforge.llm.common import components, word_hashes
from lemmaforge.llm.queries import oracle_sql, queries

ODD = "doc_id long, text string, lang string, id string, h int, size int, owner long, key string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def odd_rows(spark):
    rows = [
        (1, "one two three four five six", "a"),
        (2, "one two three four five six", "b"),
        (2, "one two three four five six", "b"),
        (3, None, None),
        (4, "", "x"),
        (5, "", None),
        (None, "one two three four five six", "n"),
        (6, "  \n \t ", "x"),
        (7, LONG, "x"),
        (8, LONG, "x"),
        (9, LONG + " end", "x"),
        (10, "One  TWO three four\nfive six", "x"),
        (2, "another text of the same identifier altogether", "c"),
        (11, "word", "x"),
        (12, "word", "x"),
    ]
    return spark.createDataFrame([(*r, "i", 1, 2, 3, "k") for r in rows], ODD)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_twins(spark, duck, name):
    same_as_sql(spark, duck, queries()[name], oracle_sql()[name])


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_word_hashes_in_pieces():
    data = b"".join(b"w%d " % (i * 7) for i in range(5000))
    a, b = word_hashes(data), word_hashes(data, piece=100)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and len(set(a[0].tolist())) == 5000


def test_exact_hot_text():
    """Copies of one text cost linear time in the tries of a partition and after."""
    import time

    import pyarrow as pa
    from pyspark import TaskContext

    class Context:
        partitionId = staticmethod(lambda: 1)

    body = b"hot text " * 20
    began = time.time()
    get, TaskContext.get = TaskContext.get, staticmethod(lambda: Context)
    try:
        batches = (pa.record_batch([pa.array(range(k, k + 20_000)), pa.array([180] * 20_000, pa.int32()), pa.array([5] * 20_000), pa.array([body] * 20_000)], names=["id", "n", "h", "body"]) for k in range(0, 400_000, 20_000))
        out = pa.Table.from_batches(list(exact_dedup._local(1 << 20)(batches)))
    finally:
        TaskContext.get = get
    strings = out.filter(pa.compute.is_valid(out.column("n"))).to_pylist()
    assert [(r["id"], r["body"]) for r in strings] == [(0, body)] and out.num_rows == 400_001
    many = pa.record_batch([pa.array(range(300_000)), pa.array(range(300_000)), pa.array([180] * 300_000, pa.int32()), pa.array([5] * 300_000), pa.array([b""] * 300_000), pa.array([body] * 300_000)], names=["id", "tid", "n", "h", "path", "body"])
    done = pa.Table.from_batches(list(exact_dedup._tries(1 << 20)(iter(many.slice(k, 10_000) for k in range(0, 300_000, 10_000)))))
    assert set(done.column("owner").to_pylist()) == {0} and done.num_rows == 300_000
    assert time.time() - began < 30


def test_exact_hot_text_in_spark(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('hot', 40) ELSE concat('t', id % 20000) END AS text", "1 AS _x_id", "2 AS _x_h")
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.m for r in df.groupBy("text").agg(F.min("doc_id").alias("m")).collect())


def test_exact_odd_rows(spark):
    df = odd_rows(spark)
    found = {(r.id, r.owner) for r in exact_dedup.owners(df).collect()}
    assert found == {(2, 1), (5, 4), (8, 7), (12, 11)}
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.lang) for r in kept.collect()) == sorted([("1", "a"), ("2", "c"), ("3", None), ("4", "x"), ("None", "n"), ("6", "x"), ("7", "x"), ("9", "x"), ("10", "x"), ("11", "x")])
    assert exact_dedup.drop_copies(df.where("false")).count() == 0


def test_trie_and_spill(spark):
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    trie, least = exact_dedup.Patricia(), {}
    for i, k in enumerate(keys):
        trie.insert(k, i)
        least[k] = min(i, least.get(k, i))
    assert all(trie.find(k) == least[k] for k in keys) and trie.find(b"abc") is None
    # all strings in one part (as if hashes were equal): subtrees go to later rounds
    base = spark.createDataFrame([(i, k.decode()) for i, k in enumerate(keys)], "id long, text string").withColumns({"n": F.lit(1), "h": F.lit(1).cast("long")})
    got = {(r.id, r.owner) for r in exact_dedup._owners(base.select("id", "n", "h", "text"), exact_dedup._parts(base), 3000).collect()}
    assert got == {(i, least[k]) for i, k in enumerate(keys) if least[k] != i}


def brute_pairs(rows, n, t):
    """Similar pairs of different documents; a document is an identifier and a text."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        if i is not None:
            sets[i, text or ""] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    out = {}
    keys = sorted(sets)
    for x in range(len(keys)):
        for y in range(x):
            a, b = keys[y], keys[x]
            if s := len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])):
                if s >= t:
                    out[a, b] = s
    return keys, out


def brute_classes(rows, n, t):
    """{document: (least identifier of its class, links)}"""
    keys, pairs = brute_pairs(rows, n, t)
    parent, links = {k: k for k in keys}, dict.fromkeys(keys, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: (find(k)[0], links[k]) for k in keys}


def near_rows():
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(30))
    texts = []
    for g in range(25):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randint(3, 60))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
            texts.append(" ".join(w) + (" " + common if g % 2 else ""))
    hot = [f"h{i}" for i in range(80)]
    for i in range(70):  # many near copies, counted by matrix products
        w = list(hot)
        w[i % 80] = f"e{i}"
        texts += [" ".join(w)] * (2 if i % 10 == 0 else 1)
    return list(enumerate(texts))


def test_ngram_classes_against_brute_force(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, t in ((4, 0.4), (3, 0.6)):
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.classes(df, n=n, threshold=t).collect()}
        assert got == {k[0]: v for k, v in brute_classes(rows, n, t).items()}
    texts = dict(rows)
    pairs = {(texts[r.doc_id_a], texts[r.doc_id_b]): r.jaccard for r in ngram_join.representative_pairs(df).collect()}
    want = {(a[1], b[1]): s for (a, b), s in brute_pairs(rows, 4, 0.4)[1].items() if a[1] != b[1]}
    assert {tuple(sorted(k)): v for k, v in pairs.items()} == {tuple(sorted(k)): v for k, v in want.items()}


def test_ngram_steps_with_small_blocks(monkeypatch):
    """The cells of pairs of blocks and the marks of frequent n-grams, without Spark."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "BLOCK_BITS", 4)
    monkeypatch.setattr(ngram_join, "MOST", 9)
    rows = near_rows()
    bits, t = 8, 0.4
    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([i * 77 for i, _ in rows]), pa.array([x for _, x in rows])], names=["id", "hash", "text"])

    def grouped(tables, keys, step):
        whole = pa.Table.from_batches(tables) if isinstance(tables[0], pa.RecordBatch) else pa.concat_tables(tables)
        found = {}
        for i, k in enumerate(zip(*(whole.column(c).to_pylist() for c in keys))):
            found.setdefault(k, []).append(i)
        return [step(whole.take(pa.array(v))) for v in found.values()]

    segments = list(ngram_join._segments(4, bits)([batch]))
    assert any(x >= 1 << bits for x in segments[0].column("frag").to_pylist())
    live = pa.concat_tables(grouped(grouped(segments, ["frag"], ngram_join._shared(bits)), ["chunk"], ngram_join._live(t)))
    assert live.num_rows == len(rows)
    reps = [r for r in live.to_pylist() if r["grams"]]
    reps = pa.record_batch([pa.array(range(len(reps))), pa.array([abs(r["size"]) for r in reps], pa.int32()), pa.array([r["prefix"] for r in reps], pa.int32()), pa.array([r["grams"] for r in reps])], names=["key", "size", "prefix", "grams"])
    ids = [r["id"] for r in live.to_pylist() if r["grams"]]
    wants = {}
    for w in grouped(list(ngram_join._prefixes(6)([reps])), ["bucket"], ngram_join._meets(t)):
        for r in w.to_pylist():
            wants.setdefault(r["key"], set()).add(r["other"])
    chosen = [r | {"weight": 1, "others": sorted(wants[r["key"]])} for r in reps.to_pylist() if r["key"] in wants]
    cells = list(ngram_join._cut(3)([pa.RecordBatch.from_pylist(chosen)]))
    partial = grouped(cells, ["i", "j", "fragment"], ngram_join._partial(t))
    assert len({(p.column("i")[0].as_py(), p.column("j")[0].as_py()) for p in partial}) > 10
    got = {tuple(sorted((ids[r["x"]], ids[r["y"]]))): r["jaccard"] for p in grouped(partial, ["i", "j"], ngram_join._pairs(t)) for r in p.to_pylist()}
    assert got == {(a[0], b[0]): s for (a, b), s in brute_pairs(rows, 4, t)[1].items()}
    links = np.zeros(len(ids))
    for p in grouped(partial, ["i", "j"], ngram_join._links(t)):
        for r in p.to_pylist():
            links[r["key"]] += r["links"]
    assert {i: n for i, n in zip(ids, links)} == {i: v[1] for (i, _), v in brute_classes(rows, 4, t).items() if i in set(ids)}


def test_ngram_tables_spawn_few_processes(spark, tmp_path, monkeypatch):
    """Hadoop spawns a chmod for each file it makes in a local folder, and until that
    runs it counts as one more JVM: tables of the join have few files and no twins."""
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    df = spark.createDataFrame(near_rows(), "doc_id long, text string").repartition(24)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "24")
        spark.conf.set(names[1], "false")
        ngram_join.classes(df).collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    made = [p.name for p in tmp_path.rglob("*") if p.is_file()]
    assert made and all(x.startswith("part-") for x in made)
    assert len(list(tmp_path.glob("lemmaforge-jaccard-live-*/part-*"))) <= 3


def test_plain_table_notices_damage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    df = common.stored(spark.range(20_000).selectExpr("xxhash64(id) AS x").coalesce(1), "damage", plain=True)
    assert df.agg(F.count("x")).first()[0] == 20_000
    (file,) = tmp_path.rglob("part-*")
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        df.agg(F.sum(F.col("x").cast("decimal(38,0)"))).collect()


def test_ngram_odd_rows(spark):
    df = odd_rows(spark)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.classes(df).collect())
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute_classes(rows, ngram_join.N, ngram_join.THRESHOLD)
    assert got == sorted((k[0], *v) for k, v in want.items())
    assert (10, 1, 2) in got and (2, 1, 2) in got and (2, 2, 0) in got and (9, 7, 2) in got and (12, 11, 1) in got
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    # another text under the identifier of a dropped document stays
    assert sorted((str(r.doc_id), r.lang) for r in kept.collect()) == sorted([("1", "a"), ("2", "c"), ("3", None), ("4", "x"), ("5", None), ("None", "n"), ("6", "x"), ("7", "x"), ("11", "x")], key=str)
    assert ngram_join.classes(df.where("false")).count() == 0 and ngram_join.keep_one(df.where("false")).count() == 0
    assert ngram_join.classes(df.where("doc_id = 3")).collect() == [(3, 3, 0)]


def test_ngram_keeps_different_text_of_one_identifier(spark):
    t, other = "one two three four five six seven", "a wholly different text under the same identifier"
    df = spark.createDataFrame([(1, t), (2, t), (2, other), (None, t), (None, other)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in ngram_join.keep_one(df).collect()) == sorted([("1", t), ("2", other), ("None", t), ("None", other)])


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    rows, no = [], 0
    for _ in range(30):
        line = "".join(rng.choice("abcdefgh ijkl") for _ in range(rng.choice([12, 30, 55, 70, 150, 600])))
        for _ in range(rng.choice([1, 2, 4])):
            x = list(line)
            for _ in range(rng.choice([0, 0, 1])):
                x[rng.randrange(len(x))] = "#"
            rows.append((no, "".join(x) + "\n\n" + f"own line {rng.random()} of {no}"))
            no += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip()]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if lines[a][2] == lines[b][2] or line_dedup.line_jaccard(lines[a][2], lines[b][2]) >= line_dedup.THRESHOLD:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {(i, k): lines[find(n)][:2] for n, (i, k, _) in enumerate(lines)}
    got = {(r.doc_id, r.line_no): (r.rep_id, r.rep_line) for r in line_dedup.line_groups(df).collect()}
    assert all(got[i, k] == (i, k) for i, t in rows for k, x in enumerate(t.split("\n")) if not x.strip())
    same = sum(got[k] == v for k, v in want.items())
    assert same >= 0.97 * len(want)


def test_lines_odd_rows(spark):
    df = odd_rows(spark)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    texts = {}
    for r in out.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[None] == ["one two three four five six"] and texts[1] == [""]
    assert texts[3] == [None] and texts[4] == [""] and texts[6] == ["  \n \t "]
    assert texts[7] == [LONG] and texts[8] == [""] and texts[9] == [""] and texts[11] == ["word"] and texts[12] == [""]
    assert line_dedup.line_groups(df.where("false")).count() == 0


@pytest.mark.parametrize("size", [30, 45, 70, 90, 120, 140, 400, 900])
def test_line_recall_of_proposals(size):
    """Bands find 99 in 100 pairs of a similarity of 0.80 to 0.85, at every length."""
    rng = random.Random(size)
    pairs = []
    while len(pairs) < 1200:
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(size))
        x = list(a)
        n = rng.randint(1, max(1, size // 8))
        at = rng.randrange(size - n + 1)
        x[at : at + n] = [rng.choice("ABCDEFGHIJKLMNOP") for _ in range(n)]
        b = "".join(x)
        if 0.8 <= line_dedup.line_jaccard(a, b) <= 0.85:
            pairs += [a, b]
    line, key = line_dedup.band_keys(pairs)
    keys: dict[int, set] = {}
    for i, k in zip(line.tolist(), key.tolist()):
        keys.setdefault(i, set()).add(k)
    found = sum(bool(keys[i] & keys[i + 1]) for i in range(0, len(pairs), 2))
    print("size", size, "found", found, "of", len(pairs) // 2)
    assert found >= 0.985 * len(pairs) / 2


def test_stars_of_a_hot_band():
    """A band of a million lines gives a pair for each, not all pairs."""
    import numpy as np
    import pyarrow as pa

    n = 1_000_000
    t = pa.table({"bucket": pa.array([0], pa.int32()), "keys": pa.array([np.full(n, 7, np.uint32).tobytes()], pa.binary()), "lines": pa.array([np.arange(n).tobytes()], pa.binary())})
    out = line_dedup._stars(t)
    assert out.num_rows == n and out.column("group").null_count == n - 1


def test_lines_of_two_texts_under_one_identifier(spark):
    rows = [(1, "own first\nshared line of both the texts here"), (1, "shared line of both the texts here\nprecious line found nowhere else"), (None, "a line of nobody at all\nshared line of both the texts here"), (None, "a wholly other line")]
    df = spark.createDataFrame([(*r, "g", 1) for r in rows], "doc_id long, text string, _gone string, _gone_id int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    # a null identifier comes first, so its shared line is the one that stays
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("1", "own first"), ("1", "precious line found nowhere else"), ("None", rows[2][1]), ("None", rows[3][1])])


def test_lines_linked_across_a_star(spark):
    """Two clusters in one band group: links that do not touch the star are found."""
    base = "".join(random.Random(9).choice("abcdefghijklmnop ") for _ in range(200))
    texts = [base, base[:185] + "x" * 15, base[:170] + "y" * 30, base[:170] + "y" * 28 + "zz", "q" * 14 + base[14:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.rep_id for r in line_dedup.line_groups(df).collect()}
    parent = list(range(5))
    for i in range(5):
        for j in range(i):
            if line_dedup.line_jaccard(texts[i], texts[j]) >= 0.8:
                x, y = parent[i], parent[j]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    assert got == dict(enumerate(parent))


def test_registered_queries_run(spark):
    for name in ("op10_line_dedup", "op5_ngram_jaccard"):
        assert queries()[name](spark, DATA).count() > 0


def test_line_recall_at_the_threshold():
    """Of pairs of short lines at a Jaccard similarity just above 0.8, bands find more
    than 99 in 100."""
    rng = random.Random(17)
    pairs = []
    while len(pairs) < 8000:
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(24, 52)))
        n = rng.randint(1, 5)
        b = "#" * n + a[n:]
        if 0.8 <= line_dedup.line_jaccard(a, b) <= 0.82:
            pairs += [a, b]
    line, key = line_dedup.band_keys(pairs)
    keys: dict[int, set] = {}
    for i, k in zip(line.tolist(), key.tolist()):
        keys.setdefault(i, set()).add(k)
    found = [bool(keys[i] & keys[i + 1]) for i in range(0, len(pairs), 2)]
    print("found", sum(found), "of", len(found))
    assert sum(found) >= 0.995 * len(found)


def test_line_keys_in_small_pieces():
    """Two million characters need little working memory, and the keys of a line are
    the same among others and alone."""
    import tracemalloc

    rng = random.Random(5)
    lines = ["".join(rng.choices("abcdefghijklmnop ", k=rng.choice([20, 66, 100, 131, 140, 300, 2000]))) for _ in range(5000)] + ["ab" * 300, "abcdefgh" * 40]
    line_dedup.band_keys(lines)  # powers are kept
    tracemalloc.start()
    of, key = line_dedup.band_keys(lines)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, lines)) > 1_500_000 and peak < 40 << 20
    for i in [*range(40), len(lines) - 2, len(lines) - 1]:
        assert sorted(key[of == i].tolist()) == sorted(line_dedup.band_keys([lines[i]])[1].tolist())


def test_line_bounds_lose_no_pair():
    """Bounds are never below the similarity, and put most unlike pairs aside; lines of
    thousands of characters set most bits, so their pairs are left to be compared."""
    import numpy as np

    rng = random.Random(6)
    lines = []
    for size in (7, 8, 30, 120, 400, 1500, 3000):
        for _ in range(60):
            x = rng.choices("abcdefghijklmnop ", k=size)
            y = list(x)
            n = rng.randint(0, size // 2)
            y[:n] = rng.choices("ABCDEF", k=n)
            lines += ["".join(x), "".join(y)]
    lines += ["a" * 500, "ab" * 250, "\U0001f600" * 20, "a" * 7]
    left = np.arange(0, len(lines), 2)
    bound = line_dedup.bounds(lines, left, left + 1, line_dedup.SHINGLE)
    true = np.array([line_dedup.line_jaccard(lines[i], lines[i + 1]) for i in left])
    assert (bound >= true).all()
    unlike = (true < 0.6) & np.array([len(lines[i]) < 2000 for i in left])
    assert unlike.sum() > 100 and (bound[unlike] < line_dedup.THRESHOLD).mean() > 0.9


def test_line_stars_sort_only_keys_that_meet():
    """Keys of one line, which most are, cost a fraction of a sort by key and line."""
    import time

    import numpy as np
    import pyarrow as pa

    rng = np.random.Generator(np.random.PCG64(5))
    key, line = rng.integers(0, 1 << 32, 1_000_000, dtype=np.uint32), rng.integers(-(1 << 62), 1 << 62, 1_000_000)
    key[-30:] = np.repeat(key[:10], 3)
    t = pa.table({"bucket": pa.array([0, 0], pa.int32()), "keys": pa.array([key[:7].tobytes(), key[7:].tobytes()], pa.binary()), "lines": pa.array([line[:7].tobytes(), line[7:].tobytes()], pa.binary())})
    cpu = []
    for run in (lambda: np.lexsort((line, key)), lambda: line_dedup._stars(t)):
        began = time.process_time()
        out = run()
        cpu.append(time.process_time() - began)
    assert cpu[1] < cpu[0] / 2
    want, groups = set(), set()
    for k in np.unique(key)[np.unique(key, return_counts=True)[1] > 1]:
        own = np.unique(line[key == k])
        want |= {(int(own[0]), int(x)) for x in own[1:]}
        groups |= {own.tobytes()} if len(own) > 2 else set()
    rows = out.to_pylist()
    assert {(r["a"], r["b"]) for r in rows if r["a"] is not None} == want and len(want) >= 30
    assert {r["group"] for r in rows if r["group"] is not None} == groups and len(groups) >= 10


def test_line_pairs_across_components_by_sketches():
    """Of the pairs of a group across components those that sketches leave open are
    sent, also where a group spans batches; lines without a sketch send all."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    lines, no, root = [], [], []
    for g in range(40):
        base = [rng.choice("abcdefgh ") for _ in range(rng.choice([40, 120, 500]))]
        for i in range(rng.choice([2, 5, 9])):
            x = list(base)
            for _ in range(rng.choice([0, 1, 2, len(x) // 6])):
                x[rng.randrange(len(x))] = rng.choice("xyz")
            lines.append("".join(x))
            no.append(g)
            root.append(i // 2)
    width, bits = line_dedup._sketches(lines, line_dedup.SHINGLE)
    bare = np.array([g % 10 == 0 for g in no])
    t = pa.table({"no": no, "lh": np.arange(len(lines)), "root": root, "width": np.where(bare, -1, width), "bits": pa.array([None if b else x.tobytes() for b, x in zip(bare, bits)], pa.binary())})
    pairs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if no[a] == no[b] and root[a] != root[b]]
    like = {(a, b) for a, b in pairs if bare[a] or line_dedup.line_jaccard(lines[a], lines[b]) >= line_dedup.THRESHOLD}
    for rows in (1, 4, 1000):
        sent = [(a, b) for x in line_dedup._across(line_dedup.THRESHOLD)(iter(t.to_batches(rows))) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist())]
        assert len(sent) == len(set(sent)) and like <= set(sent) <= set(pairs)
        assert len(set(sent) - like) < (len(pairs) - len(like)) / 4
    assert len(like) > 60 and len(pairs) - len(like) > 100


def test_lines_in_groups_without_sketches(spark, monkeypatch):
    """Groups too large for sketches come to the same result."""
    rng = random.Random(13)
    rows = []
    for no in range(30):
        x = [rng.choice("abcdefgh ijkl") for _ in range(90)] if no % 10 == 0 else list(rows[-1][1])
        for _ in range(2):
            x[rng.randrange(90)] = rng.choice("xyz")
        rows.append((no, "".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(str, line_dedup.line_groups(df).collect()))]
    monkeypatch.setattr(line_dedup, "SKETCHED", 2)
    assert sorted(map(str, line_dedup.line_groups(df).collect())) == found[0] and any("kept=False" in x for x in found[0])


def test_text_is_hashed_once_not_for_each_line(spark):
    df = spark.createDataFrame([(1, "one\ntwo")], "doc_id long, text string")
    plan = line_dedup._lines(df, "doc_id", "text").select("id", "th", "lh")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert above.count("xxhash64") == 1 and below.count("xxhash64") == 1
