"""What only larger tables show: far years, many queries against many documents, many different phrases."""

import datetime
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.operators import phrases as H
from tessella.operators import retrieval as R
from tessella.sources.index import build
from tessella.work import Workspace


def test_years_of_five_digits(spark, tmp_path):
    """typed_arguments: event ids count days, and the 2932897th is in the year 10000."""
    rows = [(n, datetime.datetime(2024, 1, 1), 1, "view", 1.0, '{"k": 3}') for n in (0, 2932896, 2932897)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["typed_arguments"](spark, str(tmp_path)).orderBy("event_id").select("at").collect()
    assert [r["at"] for r in got] == ["1970-01-01 00:00:00", "9999-12-31 00:00:00", "10000-01-01 00:00:00"]


def _corpus(spark, n, rng, words, keys=None):
    rows = [(keys[i] if keys else i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, text string"), rows


def _stored(df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}")


def _shuffled(df):
    """Rows that the exchanges of a plan wrote when it ran."""
    df.collect()
    plans, rows = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        for inner in ("executedPlan", "plan"):
            if plan.nodeName() in ("AdaptiveSparkPlan", "ShuffleQueryStage", "BroadcastQueryStage") and hasattr(plan, inner) and (plan.nodeName() == "AdaptiveSparkPlan") == (inner == "executedPlan"):
                plans.append(getattr(plan, inner)())
        if plan.nodeName() == "Exchange":
            rows += plan.metrics().apply("shuffleRecordsWritten").value()
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return rows


def test_keyword_search_shuffles_k_rows_a_query_and_task(spark, tmp_path):
    """60 queries that 3,000 documents all meet: a task sends its 4 best of each, and the best are those of a plain count."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["all"]
    df, rows = _corpus(spark, 3000, rng, words, [i // 2 if i < 40 else i for i in range(3000)])
    corpus = _stored(df.withColumn("text", F.concat("text", F.lit(" all"))).repartition(4), tmp_path, "corpus")
    asked = [(q, " ".join(rng.choices(words, k=5)) + " all") for q in range(60)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = build(corpus, f"{tmp_path}/index")
    found = R.keyword_search(queries, index.lists, index.idf, index.norms, 4)
    got = {(r.query_id, r["rank"]): r.chunk_id for r in found.collect()}

    texts = {}
    for i, text in rows:
        texts[i] = texts.get(i, []) + text.split() + ["all"]
    counts = {i: Counter(t) for i, t in texts.items()}
    df_of = Counter(t for c in counts.values() for t in c)
    weigh = lambda c: {t: n * (math.log(3001 / (1 + df_of[t])) + 1) for t, n in c.items() if t in df_of}
    unit = lambda w: {t: x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    docs = {i: unit(weigh(c)) for i, c in counts.items()}
    for q, text in asked:
        own = unit(weigh(Counter(text.split())))
        best = sorted((-round(sum(x * d.get(t, 0) for t, x in own.items()), 6), i) for i, d in docs.items())[:4]
        assert [got[q, n + 1] for n in range(4)] == [i for _, i in best]
    assert _shuffled(found) < 60 * 4 * 8 * 3  # every query and document: 178,800


def test_boosted_search_of_repeated_ids(spark):
    """Rows of one id are one document; terms count once a field."""
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a", "c"), (2, "a a", "c"), (None, "b", "b")], "chunk_id long, text string, title string")
    queries = spark.createDataFrame([(7, "a b c")], "query_id long, text string")
    got = [(r.chunk_id, r.score) for r in R.boosted_search(queries, docs, {"title": 5, "text": 1}, 3).orderBy("rank").collect()]
    assert got == [(1, 7), (2, 6), (None, 6)]


def test_containing_shuffles_no_text(spark, tmp_path):
    """Queries of few and of many tokens, against every text; no exchange takes the documents."""
    rng = random.Random(6)
    words = ["aa", "b", "ccc", "d1"]
    df, rows = _corpus(spark, 500, rng, words)
    corpus = _stored(df, tmp_path, "corpus")
    asked = [(1, "aa b"), (2, "b ccc d1 aa"), (3, "cc"), (4, "aa zz b"), (5, "a b ccc d")]
    found = R.containing(spark.createDataFrame(asked, "query_id long, text string"), corpus, build(corpus, f"{tmp_path}/index").idf)
    assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == sorted((q, i) for q, t in asked for i, text in rows if t in text)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def _phrases(rows, high, most):
    """Every n-gram of every sentence, counted one by one."""
    counts = Counter()
    for text in rows:
        for sentence in re.split(r"[。！？；，,.!?;:、\n\r]+", text):
            u = re.findall("[A-Za-z]+", sentence)
            counts.update(" ".join(u[i : i + n]) for n in range(2, high + 1) for i in range(len(u) - n + 1))
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]


@pytest.mark.parametrize("first", [3, 2048])
def test_frequent_phrases_count_few(spark, monkeypatch, first):
    """Most phrases are rare and are never counted; the result is that of counting all, with ties, breaks and other letters."""
    rng = random.Random(7)
    head = [f"{a}{b}" for a in "abc" for b in "xyz"]
    rows = []
    for i in range(400):
        u = [rng.choice(head) if rng.random() < 0.7 else "".join(rng.choices("pqrstuv", k=5)) for _ in range(rng.randint(0, 30))]
        rows.append("".join(x + rng.choice([" ", " ", " ", "é", " 7 ", ", ", ".\n"]) for x in u))
    df = spark.createDataFrame([(x,) for x in [*rows, None, "", "\n"]], "t string")
    monkeypatch.setattr(H, "FIRST", first)
    for most in (1, 40, 700):
        got = [(r.phrase, r.freq) for r in H.frequent_phrases(df, F.col("t"), most=most, words=True).orderBy(F.desc("freq"), "phrase").collect()]
        assert got == _phrases(rows, 5, most)
    texts = df.select(F.coalesce("t", F.lit("")).alias("text"))
    few = H._frequent(Workspace(spark), texts, 5, 40, True).count()
    assert few < H._all_phrases(df, F.col("t"), 2, 5, True).count() / 10
    monkeypatch.setattr(H, "MOST_UNITS", 1)
    got = [(r.phrase, r.freq) for r in H.frequent_phrases(df, F.col("t"), most=40, words=True).orderBy(F.desc("freq"), "phrase").collect()]
    assert got == _phrases(rows, 5, 40)
