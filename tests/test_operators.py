import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import metrics as M
from tessella.functions import text as T
from tessella.operators import chunking as C
from tessella.operators import datasets as D
from tessella.operators import knowledge as K
from tessella.operators import phrases as H
from tessella.operators import quality as Q
from tessella.operators import retrieval as R
from tessella.sources import files, store
from tessella.streaming import events as E


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "f, value, want",
    [
        (T.clean_text, "Hé 你好, w0rld!龦", "H你好w0rld"),
        (T.clean_text, None, ""),
        (T.tokens, "你好 abc-12", ["你", "好", "abc", "12"]),
        (T.language, "你 a", "mixed"),
        (T.language, "12", "unknown"),
        (T.is_question, "这是什么", True),
        (T.is_question, "ok", False),
        (T.complexity, "a" * 41, "complex"),
        (T.after_thinking, "<think>a</think> b ", "b"),
        (T.redact, "sk-abc /home/joe/x Bearer t0k", "sk-*** /home/***/x Bearer ***"),
        (T.file_name, ' a/b:c*. ', "a_b_c_"),
        (T.clean_title, "1.2 Title", "Title"),
        (T.is_ui_noise, " 45% ", True),
        (T.cited, "[3] x [1] [3]", [1, 3]),
        (T.url_category, "http://x/规则/1", "规则类"),
        (T.tidy_html, "```html\n<p>a</p>\n\n<p>b</p>```", "<p>a</p><p>b</p>"),
        (T.drop_placeholders, "a {{x placeholder}} b", "a  b"),
    ],
)
def test_text_functions(spark, f, value, want):
    assert one(spark, value, f) == want


def test_truncation_and_sizes(spark):
    text = "\n".join(map(str, range(10)))
    assert one(spark, text, lambda c: T.truncate_lines(c, 4)) == "0\n1\n2\n3"
    assert one(spark, text, lambda c: T.truncate_lines(c, 4, how="tail")) == "6\n7\n8\n9"
    assert one(spark, text, lambda c: T.truncate_lines(c, 4, how="head_tail")) == "0\n1\n...\n8\n9"
    assert [one(spark, n, T.file_size, "long") for n in (512, 1280, 5 * 1024**2)] == ["512.0B", "1.2KB", "5.0MB"]


def test_metrics(spark):
    row = spark.sql("SELECT array(3, 1, 2, 1) AS f, array(1, 9, 9) AS r, array() AS e")
    got = row.select(M.recall_at_k(F.col("f"), F.col("r"), 2), M.precision_at_k(F.col("f"), F.col("r"), 4), M.reciprocal_rank(F.col("f"), F.col("r")), M.ndcg_at_k(F.col("f"), F.col("r"), 2), M.recall_at_k(F.col("f"), F.col("e").cast("array<int>"), 2)).first()
    assert tuple(got) == (0.5, 0.5, 0.5, round((1 / 1.5849625) / (1 + 1 / 1.5849625), 4), 0.0)


def test_chunking():
    assert C.chunk("") == [] and C.chunk("  ab ") == ["ab"] and C.chunk("x" * 12, 5, 0) == ["xxxxx", "xxxxx", "xx"]
    rng = random.Random(1)
    for _ in range(100):
        text = "".join(rng.choice("ab。, \n") for _ in range(rng.randint(0, 200)))
        for lossless in (False, True):
            got = C.chunk(text, 20, 5, lossless)
            assert all(0 < len(c) <= 20 for c in got)
        bare = "".join(C.chunk(text, 20, 0)).replace(" ", "").replace("\n", "")
        assert bare == text.replace(" ", "").replace("\n", "")
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            C.chunk("a", *bad)


def test_engine_packing_equals_kernel(spark):
    words = ["ab", "c", "def", "ghijkl", "m"]
    got = spark.createDataFrame([(words,)], "w array<string>").select(C.pack_words(F.col("w"), 4).alias("c")).first().c
    assert got == ["abc", "def", "ghijkl", "m"]


def test_phrase_filters(spark):
    p = spark.createDataFrame([("ab", 10), ("abc", 9), ("bc", 30), ("zz", 1)], "phrase string, freq long")
    assert {r.phrase for r in H.longest_only(p).collect()} == {"abc", "zz"}
    assert {r.phrase for r in H.frequent_ratio(p).collect()} == {"abc", "bc", "zz"}
    docs = spark.createDataFrame([("你好吗，你好",), (None,)], "t string")
    assert H.frequent_phrases(docs, F.col("t")).first().phrase == "你好"


def test_greedy_budget(spark):
    items = spark.sql("SELECT array(struct(0 AS idx, 50 AS words, 0.1D AS score), struct(1 AS idx, 500 AS words, 0.9D AS score), struct(2 AS idx, 60 AS words, 0.5D AS score), struct(3 AS idx, 30 AS words, 0.4D AS score)) AS i")
    pick = lambda n: items.select(K.greedy_budget(F.col("i"), n).alias("k")).first().k
    assert pick(100) == [1] and pick(550) == [1, 3] and pick(640) == [0, 1, 2, 3]


def test_dedup_keeps_newest(spark):
    rows = [(0, "Hello!", "2024-01-01"), (1, "hello", "2024-03-01"), (2, "...", None), (3, "???", None), (4, "hel lo", "2024-02-01"), (5, "x", None), (6, "X", None)]
    df = spark.createDataFrame(rows, "pos int, text string, time string")
    kept = Q.dedup_latest(df, text=F.col("text"), newest=F.try_to_timestamp("time", F.lit("yyyy-MM-dd")), position=F.col("pos"))
    assert sorted(r.pos for r in kept.collect()) == [1, 2, 3, 5]
    empty = Q.report(df.limit(0), F.col("text")).first()
    assert (empty.total, empty.empty_ratio, empty.passed) == (0, 1.0, False)


def test_fusion(spark):
    rows = [(1, "a", 10, 1, 0.9), (1, "a", 11, 2, 0.5), (1, "b", 11, 1, 7.0), (2, "a", 10, 1, 0.3)]
    ranked = spark.createDataFrame(rows, "query_id long, retriever string, chunk_id long, rank long, score double")
    got = {(r.query_id, r.chunk_id): r.score for r in R.fuse(ranked).collect()}
    assert got[1, 11] == round(1 / 62 + 1 / 61, 8) and got[2, 10] == 0.3
    w = {(r.query_id, r.chunk_id): r.score for r in R.weighted(ranked, {"a": 0.5, "b": 2.0}).collect()}
    assert w == {(1, 10): 0.5, (1, 11): 2.0, (2, 10): 0.5}


def test_vector_search_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, [1.0])]
    df = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    queries = df.withColumnRenamed("chunk_id", "query_id")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in R.vector_search(queries, df, 2, block_rows=7).collect()}
    assert all(got[i, 1] == i for i in range(60)) and (60, 1) not in got and got[61, 1] == 61


def test_dataset_negatives_and_split(spark):
    pool = spark.createDataFrame([(i, f"p{i % 5}") for i in range(400)], "chunk_id long, page_name string")
    shown = spark.createDataFrame([(1, 0), (1, 5)], "query_id long, chunk_id long")
    hard = D.hard_negatives(spark.createDataFrame([(1, "p0")], "query_id long, page_name string"), pool, shown)
    assert sorted(r.chunk_id for r in hard.collect()) == [10, 15]
    drawn = D.random_negatives(spark.createDataFrame([(q,) for q in range(30)], "query_id long"), pool, shown).collect()
    assert len(drawn) == 60 and len({tuple(r) for r in drawn}) == 60
    a, b = D.split_by_hash(pool, "chunk_id")
    assert a.count() + b.count() == 400 and 20 < b.count() < 70


def test_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.HTML").write_text("<time>2024</time><p>hi</p>")
    (tmp_path / "b.json").write_text(json.dumps({"text": "one", "extra": 1}))
    (tmp_path / "c.json").write_text(json.dumps([{"text": "two"}, {"text": "three"}]))
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.txt").write_bytes(b"ok\xff")
    (tmp_path / "f.bin").write_bytes(b"?")
    assert [(r.html, r.folder) for r in files.html_files(spark, str(tmp_path)).collect()] == [("<time>2024</time><p>hi</p>", "x")]
    assert [[b.text for b in r.blocks] for r in files.json_blocks(spark, str(tmp_path)).collect()] == [["one"], ["two", "three"]]
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["e.txt"] == ("ok", None) and got["a.HTML"][0] == "2024\nhi" and got["c.json"][0] == "two\nthree" and got["f.bin"][1]
    files.write_jsonl(spark.sql("SELECT 'q' AS query, 1 AS label"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_corpus_store(spark, tmp_path):
    corpus = store.Corpus(spark, str(tmp_path / "kb"))
    blocks = spark.createDataFrame([(0, "a", "u1"), (1, " ", "u1"), (2, "b", "u2")], "chunk_idx int, text string, page_url string")
    assert corpus.ingest(blocks, "d1") == 2 and corpus.ingest(blocks.where("chunk_idx = 0"), "d2") == 1
    assert sorted(r.global_chunk_idx for r in corpus.blocks.collect()) == [0, 1, 2]
    assert corpus.ingest(blocks.where("chunk_idx = 2"), "d1") == 1
    assert tuple(corpus.stats().first()) == (2, 2) and corpus.versions.count() == 3
    corpus.delete_page("u2")
    assert not corpus.delete("none") and corpus.delete("d2") and corpus.blocks.count() == 0


def test_streams_equal_their_batch_twins(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))

    def run(df, mode="complete"):
        name = f"q{abs(hash(str(df.schema) + mode)) % 10**8}"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    key = lambda df: sorted(map(str, df.collect()))
    assert key(run(E.windows(stream))) == key(E.windows(src))
    assert key(run(E.sessions(stream))) == key(E.sessions(src))
    assert run(E.distinct_events(stream).select("event_id"), "append").count() == src.count()
    tools = lambda df: df.select((F.col("user_id") % 5).alias("tool"), "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    got = run(E.breaker(tools(stream), limit=2), "append").collect()
    want = []
    for tool in range(5):
        fails, opened = 0, None
        for r in sorted(tools(src).where(F.col("tool") == tool).collect(), key=lambda r: (r.ts, r.event_id)):
            if opened and (r.ok or (r.ts - opened) >= dt.timedelta(seconds=300)):
                fails, opened = 0, None
                want.append((tool, "closed"))
            fails = 0 if r.ok else fails + 1
            if not opened and fails >= 2:
                opened = r.ts.replace(microsecond=0)
                want.append((tool, "open"))
    assert sorted((r.tool, r.state) for r in got) == sorted(want)
    q = E.last_n(spark, stream, str(tmp_path / "last"), 50).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "last" / "0")).count() == 50


def test_pruning_and_registry():
    from tessella.operators import pruning as X
    from tessella.operators import registry as G

    assert X.within_budget([50, 500, 60, 30], [0.1, 0.9, 0.5, 0.4], 550) == [1, 3]
    assert X.rebuild([("<p>a</p>", ("div", "h1_domain")), ("<p>b</p>", ("h1_domain",)), ("<p>c</p>", ("isolated_domain",))]) == '<div class="h1_domain">\n<p>a</p>\n<p>b</p>\n</div>\n<p>c</p>'
    assert X.heading_context(("div", "h1_domain", "h2_section")) == "h1 h2"
    page = "".join(f"<div><p>{' '.join(f'{w}{i}' for i in range(40))}</p></div>" for w in ("cat", "dog", "cow"))
    assert "dog7" in X.prune(page, "dog7 dog8", most=60, least=10, budget=60) and "cow7" not in X.prune(page, "dog7 dog8", most=60, least=10, budget=60)
    assert X.prune("", "q") == "" and X.prune(page, "q", lambda q, t: 1 / 0, most=60, least=10).count("<p>") >= 1
    assert G.arithmetic("2 + 3 * (4 - 1) ** 2") == 29 and G.arithmetic("sqrt(16) + max(1, 2)") == 6
    for bad in ("__import__('os')", "x", "2 ** 99999", "'a'"):
        with pytest.raises(Exception):
            G.arithmetic(bad)
    r = G.Registry()
    r.add(lambda a, b=1: a + b, "plus")
    assert r.call("plus", a=2, z=9) == {"status": "success", "data": 3}
    assert r.call("plus")["code"] == "INVALID_PARAM" and r.call("no")["code"] == "NOT_FOUND" and r.call("plus", a="x")["code"] == "EXECUTION_ERROR"
    assert r.schema()[0]["arguments"] == ["a", "b"]


def test_folder_stream_ingests_each_file_once(spark, tmp_path):
    from tessella.streaming.ingest import ingest_folder

    (tmp_path / "in").mkdir()
    corpus = store.Corpus(spark, str(tmp_path / "kb"))
    put = lambda name, texts: (tmp_path / "in" / name).write_text(json.dumps([{"chunk_idx": i, "text": t} for i, t in enumerate(texts)]))

    def run():
        q = ingest_folder(spark, f"file://{tmp_path}/in", corpus).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.awaitTermination(120)

    put("a.json", ["one", "two"])
    put("b.json", ["three", " "])
    run()
    assert tuple(corpus.stats().first()) == (2, 3)
    put("c.json", ["four"])
    run()
    run()
    assert tuple(corpus.stats().first()) == (3, 4) and corpus.versions.count() == 3


def test_conversation_sizes_add_up_over_triggers(spark, sf_dir, tmp_path):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    for i in range(2):
        turns.where(F.col("turn") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = E.conversation_sizes(stream, window_tokens=200).writeStream.format("memory").queryName("sizes").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {r.conv_id: (r.turns, r.tokens) for r in spark.table("sizes").groupBy("conv_id").agg(F.max("turns").alias("turns"), F.max("tokens").alias("tokens")).collect()}
    want = {r.conv_id: (r.n, r.t) for r in turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(T.token_estimate(F.col("text")) + 4).alias("t")).collect()}
    assert got == want and {r.compress for r in spark.table("sizes").collect()} == {True, False}


def test_corpus_touches_only_the_buckets_of_a_change(spark, tmp_path):
    corpus = store.Corpus(spark, str(tmp_path / "kb"))
    many = spark.createDataFrame([(f"d{i}", f"f{i}", k, f"text {i} {k}", f"u{i % 3}") for i in range(30) for k in range(2)] + [("d0", "f0", 9, " ", "u0")], "doc_id string, filename string, chunk_idx int, text string, page_url string")
    assert corpus.ingest_all(many) == 60
    ids = corpus.blocks.orderBy("doc_id", "chunk_idx").collect()
    assert [r.global_chunk_idx for r in ids] == list(range(60)) and corpus.versions.count() == 30
    before = corpus._manifest()["blocks"]
    assert corpus.ingest(spark.createDataFrame([(0, "new")], "chunk_idx int, text string"), "d7", "f7", "2020-01-01 00:00:00") == 1
    after = corpus._manifest()["blocks"]
    assert sum(before.get(b) != after.get(b) for b in before | after) == 1
    assert [(r.global_chunk_idx, r.text) for r in corpus.blocks.where("doc_id = 'd7'").collect()] == [(60, "new")] and corpus.blocks.count() == 59
    assert corpus.versions.where("doc_id = 'd7'").count() == 2
    assert corpus.delete("d7") and not corpus.delete("d7") and corpus.blocks.count() == 58
    corpus.delete_page("u1")
    assert corpus.blocks.where("page_url = 'u1'").count() == 0 and corpus.blocks.count() == 40
    with pytest.raises(ValueError):
        corpus.ingest(spark.range(store.MOST_BLOCKS + 1).selectExpr("cast(id as int) as chunk_idx", "'t' as text"), "big")
    assert corpus.blocks.count() == 40 and corpus.ingest_all(many.limit(0)) == 0 and corpus.blocks.count() == 40


def test_negatives_draw_from_the_whole_pool(spark):
    pool = spark.range(20_000).withColumnRenamed("id", "chunk_id")
    taken = spark.range(19_900).selectExpr("1L as query_id", "id as chunk_id")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = D.random_negatives(queries, pool, taken).collect()
    assert sorted(r.query_id for r in got) == [1, 1, 2, 2] and all(r.query_id == 2 or r.chunk_id >= 19_900 for r in got)
    assert D.random_negatives(queries, pool.limit(1), taken.limit(0)).count() == 2
