import numpy as np
import random

import pytest

from tessella.llm import piece_viterbi as pv
from tessella.llm import quality

pytest.importorskip("public_tokenizers")
ODD = ["", " ", "a", "hello world", "a  b", " lead", "trail ", "x\ny", "\n", "\n\nz \n q", "é ü 🙂", "▁mark ▁", "nul \0 t\tab", "z" * 3000, "the the the", "word.\nNext line"]


def plain_path(p, text):
    """Dynamic programming over every piece at every position, without automaton, memo or cuts."""
    s = pv.MARK + text.replace(pv.MARK, pv._OWN).replace(" ", pv.MARK)
    longest = max(map(len, p.scores))
    best, back = [0.0] + [float("-inf")] * len(s), [None] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - longest), end):
            piece = s[start:end]
            edge = p.scores.get(piece)
            score = edge[1] if edge else p.byte_score if end - start == 1 else None
            if score is not None and best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, edge[0] if edge else -1)
    out, at = [], len(s)
    while at:
        start, i = back[at]
        c = s[start:at]
        out = ([i] if i >= 0 else [p.bytes[b] for b in (pv.MARK if c == pv._OWN else c).encode()]) + out
        at = start
    return out


def test_encoding_equals_brute_force_and_round_trips():
    p = pv.load(pv.model_path())
    rng = random.Random(6)
    texts = ODD[1:] + ["".join(rng.choice("the andof\n é▁🙂 ") for _ in range(50)) for _ in range(150)]
    for _ in range(2):
        for t in texts:
            ids = p.encode(t).tolist()
            assert ids == plain_path(p, t), repr(t)
            assert p.decode(ids) == t
    assert p.encode("").tolist() == []


def test_columns_keep_rows_and_nulls(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*ODD, None, "a"])], "doc_id long, text string, ids string")
    back = pv.decode_column(pv.encode_column(docs, pv.model_path()), pv.model_path())
    assert back.columns == docs.columns and sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    got = pv.encode_digests(docs, pv.model_path()).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got)
    assert pv.encode_digests(docs.limit(0), pv.model_path()).count() == 0


def plain_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated)


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [*ODD, None] + [" ".join(rng.choice(["a", "b", "c\n", "\x1c", "d#", "é\xa0x"]) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as quality", "2 as kept")
    labels = spark.createDataFrame([(0, 1), (1, None), (77777, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = plain_rules(t)
        failed = n < 50 or 100 * repeat > 50 * n
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (n, chars, symbols, dup, repeat, failed, not failed), repr(t)
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_quality_of_labelled_rows(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in quality.op6_quality(spark, d).collect() if r.doc_id in truth]
    good = [r for r in got if truth[r.doc_id] == 1]
    assert sum(r.probability >= quality.KEEP for r in good) > 0.97 * len(good)
    assert not any(r.kept for r in got if truth[r.doc_id] == 0 and r.base_failed)
    bad = [r for r in got if truth[r.doc_id] == 0]
    assert sum(not r.kept for r in bad) > 0.8 * len(bad)


def test_quality_of_rows_that_taught_nothing(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id % 2}
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = [r for r in quality.judge(docs, model).collect() if r.doc_id in truth]
    assert sum(r.kept == bool(truth[r.doc_id]) or r.base_failed for r in got) > 0.9 * len(got)


def test_character_ngrams_count_code_points():
    from tessella.llm.features import ngrams

    texts = ["éa", "", "ab", "\U0001f600"]
    (pairs,), row = ngrams(texts, (2,), 20, chars=True)
    assert np.bincount(row, minlength=5)[:4].tolist() == [2, 0, 2, 1] and len(pairs) == len(row)
    (one,), _ = ngrams(["xab"], (2,), 20, chars=True)
    assert one[1] == pairs[np.flatnonzero(row == 2)[0]]


def test_memo_of_pieces_is_bounded():
    p = pv.load(pv.model_path())
    for k in range(70):
        p.encode(" ".join("w%dx%d" % (k, i) for i in range(10_000)) * 2)
    assert len(p.memo) <= pv._OFTEN + 20_000 and len(p.memo.once) <= pv._ONCE


def test_samples_are_bounded(spark):
    from pyspark.sql import functions as F

    from tessella.llm.common import bounded_sample

    rows = spark.range(5000).select((F.col("id") % 700).alias("doc_id"), F.lit("x" * 50).alias("text")).unionByName(spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("y").alias("text")))
    assert 0 < bounded_sample(rows, ["doc_id"], 400).count() <= 400
    got = bounded_sample(rows, ["doc_id"], 5000, size=F.length("text"), most_size=20_000).collect()
    assert 0 < sum(len(r.text) for r in got) <= 20_000
    assert bounded_sample(rows, ["doc_id"], 8000).count() == 8000
