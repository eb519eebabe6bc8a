import random

from pyspark.sql import functions as F

from tessella.llm import line_dedup as ld


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def changed(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s) + 1)
        op = rng.randrange(3)
        if op == 0:
            s.insert(i, rng.choice("abé"))
        elif s and op == 1:
            del s[min(i, len(s) - 1)]
        elif s:
            s[min(i, len(s) - 1)] = rng.choice("abé")
    return "".join(s)


def test_bit_parallel_distance_equals_the_table(spark):
    rng = random.Random(3)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("é", "è")]
    for _ in range(300):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 40)))
        pairs.append((a, changed(rng, a, rng.randint(0, 5))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (1, 2, 3):
        got = df.select("a", "b", ld.within_edits(F.col("a"), F.col("b"), t).alias("near")).collect()
        assert all(r.near == (edits(r.a, r.b) <= t) for r in got)


def test_parity_changes_four_bits_an_edit_at_most(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        a = "".join(rng.choice("abcdefé ") for _ in range(rng.randint(1, 60)))
        rows.append((a, changed(rng, a, 1)))
    df = spark.createDataFrame(rows, "a string, b string").select(F.bit_count(ld.bigram_parity(F.col("a")).bitwiseXOR(ld.bigram_parity(F.col("b")))).alias("n"))
    assert max(r.n for r in df.collect()) <= 4


def plain_dedup(rows, t=2, least=20):
    places = []
    docs = sorted({(i, x) for i, x in rows if x is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, x in docs:
        places += [(i, x, pos, line) for pos, line in enumerate(x.split("\n")) if line.strip(" \t\n\x0b\x0c\r")]
    lines = sorted({p[3] for p in places})
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= t and edits(a, b) <= t:
                parent[find(a)] = find(b)
    seen, drop = set(), set()
    for i, x, pos, line in places:
        c = find(line)
        if c in seen:
            drop.add((i, x, pos))
        seen.add(c)
    return [(i, x if x is None else "\n".join(y for pos, y in enumerate(x.split("\n")) if (i, x, pos) not in drop)) for i, x in rows]


def line_rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghé ") for _ in range(rng.choice([3, 19, 20, 21, 22, 45, 80]))) for _ in range(60)]
    pool = base + [changed(rng, x, k) for x in base for k in (1, 2, 3)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "\n \n"), (None, base[0] + "\n" + base[1]), (3, rows[3][1])]


def test_dedup_equals_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as drop", "2 as pos", "3 as row_hash").repartition(3)
    out = ld.dedup_lines(docs)
    assert out.columns == docs.columns
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(plain_dedup(rows), key=key)
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_keys_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_KEYS", 0)
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in ld.dedup_lines(docs).collect()), key=key) == sorted(plain_dedup(rows), key=key)


def test_classes_and_links_of_documents(spark):
    a, b, c = "the first line of some length", "the first lime of some length", "an other line that stands alone"
    rows = [(1, a), (2, b + "\n" + c), (3, c), (4, None), (5, a + "\n" + c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n, r.k, r.m) for r in ld.dedup_lines(docs, dropped="n", joined={"first_doc": "k", "links": "m"}).collect()}
    assert got == {1: (a, 0, 1, 1), 2: (c, 1, 1, 1), 3: ("", 1, 2, 0), 4: (None, 0, 4, 0), 5: ("", 2, 1, 1)}


def test_a_very_long_line(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long[:30_000] + "x" + long[30_001:]), (3, long[:59_000])], "doc_id long, text string")
    assert {r.doc_id: len(r.text) for r in ld.dedup_lines(docs).collect()} == {1: 60_000, 2: 0, 3: 59_000}
