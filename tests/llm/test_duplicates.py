import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash

from tessella.llm import imatch, simhash
from tessella.llm.common import Workspace
from tessella.llm.components import connected_components


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chain_star_and_loop(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 400)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in connected_components(Workspace(spark), df).collect()}
    assert got == plain_components({x for l in links for x in l}, links)
    assert connected_components(Workspace(spark), df.limit(0)).count() == 0


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_texts():
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 40, 400]))) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 160):
        words = base[i % 40].split()
        for _ in range(rng.randint(0, 2)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append((i, " ".join(words)))
    return out + [(200, None), (201, ""), (202, "A b\x0bC"), (203, "a B\tc"), (204, "A b C"), (None, base[4]), (5, base[5])]


def test_simhash_groups_match_brute_force(spark):
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as u")
    fps = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    links = [(a, b) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= 2]
    assert links
    root = plain_components(distinct, links)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted(((i is not None, i or 0), f, least.get(root[f])) for (i, _), f in zip(rows, fps))
    got = simhash.group(docs).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = simhash.dedup(docs).collect()
    assert len(kept) == len({root[f] for f in fps}) and sorted(kept[0].asDict()) == ["doc_id", "fp", "text", "u"]
    assert simhash.group(docs.limit(0)).count() == 0


def test_links_in_crowded_keys_equal_pairs(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = plain_components(signed, [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 2])
    for crowd in (1, 8, 10_000):
        work = Workspace(spark)
        roots = {r.node: r.root for r in connected_components(work, simhash.link(work, nodes, crowd=crowd)).collect()}
        assert {n: roots.get(n, n) for n in signed} == want


def plain_imatch(rows):
    import re

    def terms(t):
        return {w for w in re.split(r"[^\w]+|_+", t.lower()) if w}

    df = {}
    for _, t in rows:
        for w in terms(t or ""):
            df[w] = df.get(w, 0) + 1
    lex = {w for w, c in df.items() if c * 100 >= len(rows) and c * 5 <= len(rows)}

    def mark(t):
        own = sorted((terms(t) & lex), key=lambda w: w.encode())
        if not own:
            return hashlib.md5(t.encode()).hexdigest().ljust(8 * len(imatch.SUBSETS), "-")
        parts = [[w for w in own if imatch.in_subset(w, i)] for i in range(len(imatch.SUBSETS))]
        return "".join(hashlib.md5(" ".join(p).encode()).hexdigest()[:8] if p else "--------" for p in parts)

    def near(a, b):
        pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
        pairs = [p for p in pairs if p != ("--------", "--------")]
        return 1.0 if a == b else sum(x == y for x, y in pairs) / len(pairs)

    out, order = [], sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), mark(t), mark(edited), near(mark(t), mark(edited)), near(mark(t), mark(nxt))))
    return out


def test_imatch_equals_brute_force(spark):
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as next_text", "2 as fingerprint").repartition(3)
    got = [tuple(r) for r in imatch.compare_edited(docs).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(plain_imatch(rows), key=key)
    assert imatch.compare_edited(docs.limit(0)).count() == 0
    one = imatch.compare_edited(docs.where("doc_id = 44")).first()
    assert one.near_next == 1.0


def jaccard(a, b, width=5):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_groups_hold_every_similar_pair(spark):
    rng = random.Random(21)
    vocab = ["w%d" % i for i in range(2000)]
    rows = []
    for i in range(12):
        base = [rng.choice(vocab) for _ in range(60)]
        for k in range(6):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(60)] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "one  two"), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sketch", "2 as node")
    names = list(range(len(rows)))
    links = [(i, j) for i in names for j in names if i < j and jaccard(rows[i][1], rows[j][1]) >= 0.8]
    root = plain_components(names, links)
    got = simhash.group_similar(docs).collect()
    text_of = {hash_text: c for hash_text, c in ((r.text_hash, r.component) for r in got)}
    by_row = {}
    for r in got:
        by_row.setdefault(r.doc_id, r.component)
    joined = [(i, j) for i, j in links if rows[i][0] is not None and rows[j][0] is not None and by_row[rows[i][0]] != by_row[rows[j][0]]]
    assert len(joined) <= 0.01 * len(links) and len(text_of) > 12
    assert len({r.component for r in got}) >= len(set(root.values())) - 1
    assert simhash.dedup_similar(docs).count() == len({r.component for r in got})
    crowded = simhash.group_similar(docs, crowd=2).collect()
    assert len({r.component for r in crowded}) <= len({r.component for r in got}) + 2
    assert simhash.group_similar(docs.limit(0)).count() == 0


def same_groups(docs, rows, **options):
    """Whether groups are exactly the components of pairs of similarity 0.8 or fingerprints within two bits."""
    fps = [plain_fingerprint(t, 5) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8 or bin(fps[i] ^ fps[j]).count("1") <= 2]
    root = plain_components(list(range(len(rows))), links)
    got = {r.doc_id: r.component for r in simhash.group_similar(docs, **options).collect()}
    of = lambda names: sorted(sorted(i for i in names if names[i] == c) for c in set(names.values()))
    return of(got) == of(root)


def test_similar_groups_of_crowded_anchors_are_exact(spark):
    rng = random.Random(4)
    shared = ["p%d" % i for i in range(70)]
    texts = [" ".join(shared + ["o%d_%d" % (i, k) for k in range(rng.randint(2, 40))]) for i in range(40)]
    base = ["b%d" % i for i in range(104)]
    for i in range(20):  # 0.8 or so to the original, less to each other
        words = list(base)
        for k in range(2):
            words[(i * 5 + k * 47) % 104] = "x%d_%d" % (i, k)
        words[104 - 1 - i % 3] = "y%d" % i
        texts.append(" ".join(words))
    texts.append(" ".join(base))
    words = ["s%d" % i for i in range(1500)]
    texts += [" ".join(words[i * 10 : i * 10 + 104]) for i in range(120)]  # each is 0.8 or more to the next only
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert same_groups(docs, rows, crowd=2) and same_groups(docs, rows)


def test_similar_links_are_exact_near_the_threshold(spark):
    rows = []
    for i in range(40):
        words = ["d%dw%d" % (i, k) for k in range(1004)]
        m = 100 + i  # a run of m new words at the end: (1000 - m) shared of 1000 + m shingles
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 1004 - m] + ["n%dw%d" % (i, k) for k in range(m)]))]
    assert same_groups(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_similar_sets_with_a_phrase_repeated(spark):
    words = ["r%d" % k for k in range(300)]
    rows = [(0, " ".join(words)), (1, " ".join(words + ["again and again we go"] * 400))]
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8 and bin(plain_fingerprint(rows[0][1], 5) ^ plain_fingerprint(rows[1][1], 5)).count("1") > 22
    assert same_groups(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_pairs_of_long_texts_are_compared_in_turns(spark, monkeypatch):
    rng = random.Random(21)
    base = ["w%d" % rng.randrange(9000) for _ in range(900)]
    texts = [" ".join(base)]
    for k in range(24):  # some within 0.8 of the first text, some not
        own = list(base)
        for at in rng.sample(range(900), 3 + 2 * k):
            own[at] = "new%d" % rng.randrange(9000)
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "TURN", 1)
    monkeypatch.setattr(simhash, "ODD_SHARE", 0.02)
    monkeypatch.setattr(simhash, "SET_SHARE", 0.5)
    written, real = [], simhash.Workspace.keep
    monkeypatch.setattr(simhash.Workspace, "keep", lambda self, df, name="t": (written.append(name), real(self, df, name))[1])
    got = {r.doc_id: r.component_id for r in simhash.group_similar(docs).collect()}
    fps = [plain_fingerprint(t, 5) for t in texts]
    n = range(len(texts))
    links = [(a, b) for a in n for b in n if a < b and (jaccard(texts[a], texts[b]) >= 0.8 or bin(fps[a] ^ fps[b]).count("1") <= 2)]
    root = plain_components(list(n), links)
    assert got == {i: root[i] for i in n} and 1 < len(set(root[i] for i in n)) < len(texts)
    assert written.count("near") > written.count("wanted") and written.count("similar") > written.count("wanted")


def test_marks_of_long_texts_leave_by_parts():
    texts = [" ".join("w%d" % (k * i % 9973) for i in range(60_000)) for k in range(1, 6)] + [None, "", "a b"]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(8), "text_hash": range(8), "text": texts})
    parts = list(simhash._marks_of(batch, np.empty(0, np.int64), 0.8, 5))
    fp, sets = simhash.fingerprints([t or "" for t in texts], 5, sets=True)
    rows = [r for part in parts for r in part.to_pylist()]
    assert len(parts) > 2 and [r["doc_id"] for r in rows] == list(range(8))
    assert [r["fp"] for r in rows] == fp.tolist() and [r["n"] for r in rows] == [len(x) for x in sets]
