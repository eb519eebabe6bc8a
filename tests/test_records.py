"""Records, sessions and folders: nulls, empty tables, ties and refusals."""

import json

from pyspark.sql import functions as F

from tessella.functions import metrics as M
from tessella.functions import text as T
from tessella.operators import records as C
from tessella.operators import registry as G
from tessella.operators import retrieval as R
from tessella.sources.files import write_mirrored
from tessella.sources.sessions import Sessions
from tessella.sources.store import Corpus, open_store


def test_answer_events(spark):
    kind = "key int, citations array<struct<index:int,title:string>>, deltas array<string>, backend string, error string"
    rows = [(1, [(1, 'a"b')], ["x", "", None, "y"], "local", None), (2, None, None, None, "broken"), (3, [], [], "vllm", None)]
    got = C.answer_events(spark.createDataFrame(rows, kind), ["key"]).orderBy("key", "seq").collect()
    assert [(r.key, r.event) for r in got] == [(1, "citations"), (1, "answer"), (1, "answer"), (1, "done"), (2, "error"), (2, "done"), (3, "citations"), (3, "done")]
    data = [json.loads(r.frame.split("data: ", 1)[1]) for r in got]
    assert data[0] == [{"index": 1, "title": 'a"b'}] and data[3] == {"answer": "xy", "backend_used": "local"}
    assert data[4] == {"error_code": "RAG_INTERNAL_ERROR", "message": "broken"} and data[5] == {"backend_used": "error"} and data[6] == []
    assert all(r.frame.startswith(f"event: {r.event}\ndata: ") and r.frame.endswith("\n\n") for r in got)


def test_multi_edit(spark):
    rows = spark.createDataFrame([("one two",), ("one one two",), ("two",), (None,), ("one",)], "t string")
    got = [tuple(r.e) for r in rows.select(C.multi_edit(F.col("t"), [("one", "1"), ("two", "2")]).alias("e")).collect()]
    assert got == [("1 2", None, None), (None, 0, 2), (None, 0, 0), (None, 0, 0), (None, 1, 0)]


def test_todo_report(spark):
    rows = [("a", 0, "x", "in_progress"), ("a", 1, "y", "in_progress"), ("b", 0, None, "pending"), ("c", 0, "z", None), ("d", 0, "p", "completed")]
    rows += [("e", i, f"t{i}", "pending") for i in range(5)] + [(None, 0, "n", "pending")]
    got = {r.list: r for r in C.todo_report(spark.createDataFrame(rows, "list string, place int, content string, status string"), "list").collect()}
    assert [(got[k].fault, got[k].fault_at) for k in "abcde"] == [("in_progress", None), ("content", 0), ("status", 0), (None, None), (None, None)]
    assert got["d"].recap == "✅ [1/1] 所有任务已完成！" and got["e"].recap == "📋 [0/5]. 待处理: t0; t1; t2. 还有 2 个..." and got[None].recap == "📋 [0/1]. 待处理: n"


def test_ids_are_gapless_and_follow_the_registry(spark):
    docs = spark.createDataFrame([(f"d{i}", i % 4) for i in range(300)] + [(None, 2)], "doc string, n long")
    got = C.allocate_ids(docs, "doc", "n", 7)
    spans = sorted((r.first_chunk, r.last_chunk) for r in got.collect() if r.n)
    ids = [i for a, b in spans for i in range(a, b + 1)]
    assert got.count() == 301 and ids == list(range(7, 7 + sum(i % 4 for i in range(300)) + 2))
    assert C.next_id(got).first().next_id == ids[-1] + 1 and C.next_id(got.limit(0)).first().next_id == 0
    assert C.next_id(C.allocate_ids(docs.limit(1).withColumn("n", F.lit(1)), "doc", "n")).first().next_id == 1


def test_locked_update(spark):
    held = spark.createDataFrame([("a", "1", 3), ("b", "2", 0), ("c", "3", 1), (None, "4", 1)], "k string, v string, version int")
    changes = spark.createDataFrame([("a", "x", 3), ("b", "y", 9), ("d", "z", 0), (None, "n", 1)], "k string, v string, seen int")
    got = {tuple(r) for r in C.locked_update(held, changes, "k", "v").collect()}
    assert got == {("a", "x", 4, "updated"), ("b", "2", 0, "CONFLICT"), ("c", "3", 1, "kept"), ("d", None, None, "NOT_FOUND"), (None, "n", 2, "updated")}
    assert C.locked_update(held, changes.limit(0), "k", "v").where("outcome = 'kept'").count() == 4


def test_training_sets(spark):
    kind = "query_id int, place int, doc string, label int, positive boolean"
    rows = [(1, 0, "p", 2, True), (1, 1, "o", 1, False), (1, 2, "h", 0, None), (2, 0, "p", None, True), (2, 1, "q", 1, False), (3, 0, "only", 2, True), (4, 0, "same", 2, True), (4, 1, "same", 0, False)]
    negatives = [(1, "random", 0, "r"), (1, "hard", 1, "h"), (1, "hard", 0, "p"), (1, "hard", 2, "h"), (3, "hard", 0, "x")]
    a, b, c = C.training_sets(spark.createDataFrame(rows, kind), spark.createDataFrame(negatives, "query_id int, part string, place int, doc string"), hard=1)
    assert sorted(map(tuple, a.collect())) == [(1, "h", 0), (1, "o", 1), (1, "p", 2), (2, "p", 2), (2, "q", 0)]
    assert sorted(map(tuple, b.collect())) == [(1, "p", "h"), (1, "p", "o"), (1, "p", "r"), (2, "p", "q")]
    assert sorted(map(tuple, c.collect())) == [(1, "p", "h"), (1, "p", "r"), (2, "p", "q")]


def test_joined_lists_and_value_counts(spark):
    lists = spark.createDataFrame([("v", 1, 10, 0.5, 1), ("v", 1, 11, 0.4, 2), ("k", 1, 11, 9.0, 1), ("k", 1, 12, 8.0, 2), ("z", 1, 13, 1.0, 1)], "retriever string, query_id int, chunk_id int, score double, rank int")
    assert [(r.chunk_id, r.score) for r in R.joined_lists(lists, ["v", "k"]).orderBy("rank").collect()] == [(10, 0.5), (11, 0.4), (12, 8.0)]
    got = {tuple(r) for r in C.value_counts(spark.createDataFrame([("a", None), ("a", 1)], "x string, y int"), ["x", "y"]).collect()}
    assert got == {("x", "a", 2), ("y", None, 1), ("y", "1", 1)}


def test_typed_values(spark):
    rows = [("3", "integer"), (" 4 ", "INT"), ("4.5", "int"), ("x", "number"), ("1e3", "float"), ("YES", "bool"), ("0", "boolean"), ("a", "odd"), ("a", None), (None, "int")]
    got = [tuple(r.c) for r in spark.createDataFrame(rows, "v string, k string").select(T.coerced(F.col("v"), F.col("k")).alias("c")).collect()]
    assert got == [(None, 3, None, None), (None, 4, None, None), (None, None, None, "4.5"), (None, None, None, "x"), (1000.0, None, None, None), (None, None, True, None), (None, None, False, None), (None, None, None, "a"), (None, None, None, "a"), (None, None, None, None)]
    flags = spark.createDataFrame([(" On ",), ("no",), ("",), (None,)], "v string").select(T.setting_flag(F.col("v")).alias("f")).collect()
    assert [r.f for r in flags] == [True, False, None, None]
    replies = ["问题：who?\n编号：2", "x\r\n 问题： a 问题：b \r\n对应段编号: 1)", "问题：\n编号：1", "问题：q\n编号：9", "问题：q", None]
    got = [tuple(r.s) for r in spark.createDataFrame([(t,) for t in replies], "t string").select(T.selected_answer(F.col("t"), 3).alias("s")).collect()]
    assert got == [("who?", 1), ("a 问题：b", 0), (None, None), (None, None), (None, None), (None, None)]


def test_search_body_and_lines_within(spark):
    words = spark.createDataFrame([(["cat", 'q"'],), ([],)], "w array<string>")
    full, none = (json.loads(r.b) for r in words.select(T.search_body(F.col("w"), {"title": (5, False), "text": (1, True)}, {"cat": ["cat", "puss"]}).alias("b")).collect())
    clauses = full["query"]["bool"]["should"]
    assert len(clauses) == 4 and full["query"]["bool"]["minimum_should_match"] == "30%" and none["query"] == {"match_none": {}}
    assert clauses[0]["bool"]["should"] == [{"terms": {"title.keyword": ["cat", "puss"], "boost": 6.0}}] + [{"match_phrase": {"title": {"query": w, "slop": 2, "boost": 4.0}}} for w in ("cat", "puss")]
    assert clauses[3]["bool"]["should"][1] == {"match": {"text": {"query": 'q"', "fuzziness": "AUTO", "boost": 0.5}}}
    texts = ["aaaa\nbbbb\ncccc", "aaaa\n" + "b" * 40 + "\ncc", "", None, "x" * 99]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.lines_within(F.col("t"), 2).alias("t")).collect()]
    assert got == ["aaaa\nbbbb", "aaaa", "", "", ""]


def test_groundedness_and_envelope(spark):
    rows = spark.createDataFrame([("a b c d", ["a x", None, "b"]), ("", ["a"]), ("a", []), ("a", None)], "a string, c array<string>")
    assert [r.g for r in rows.select(M.groundedness_in(F.col("a"), F.col("c")).alias("g")).collect()] == [0.5, 0.0, 0.0, 0.0]
    rows = spark.createDataFrame([("d", None, False), ("d", None, True), ("d", "CONFLICT", False), ("d", "??", True)], "d string, c string, p boolean")
    got = [tuple(r.e) for r in rows.select(G.envelope(F.col("d"), F.col("c"), F.col("p")).alias("e")).collect()]
    assert got == [("success", None, "d"), ("partial", None, "d"), ("error", "CONFLICT", None), ("error", "INTERNAL_ERROR", None)]
    assert len(G.CODES) == 15 and [G.type_name(t) for t in (int, list[str], dict, bytes)] == ["integer", "array", "object", "string"]


def test_sessions(spark, tmp_path):
    s = Sessions(spark, str(tmp_path))
    assert s.load("a") is None and s.list().count() == 0 and not s.delete("a")
    s.save("a", [("user", "hi")], schema_hash="h1", at="2024-01-01 00:00:00")
    s.save("b", [], at="2024-01-02 00:00:00")
    s.save("a", [("user", "hi"), ("assistant", "yes")], config='{"x":1}', schema_hash="h2", at="2024-01-03 00:00:00")
    assert [(r.session, r.messages) for r in s.list().collect()] == [("a", 2), ("b", 0)]
    assert s.load("a").history[1].content == "yes" and s.changed_since("a", "h1") and not s.changed_since("a", "h2") and not s.changed_since("c", "h")
    assert s.delete("a") and not s.delete("a") and s.load("a") is None and [r.session for r in s.list().collect()] == ["b"]
    s.save("a", [("user", "again")])
    assert s.load("a").history[0].content == "again"


def test_ingest_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one two three. " * 20)
    (folder / "b.md").write_text("short")
    (folder / "c.bin").write_bytes(b"x")
    (folder / "empty.txt").write_text("")
    corpus = Corpus(spark, str(tmp_path / "kb"))
    n, refused = corpus.ingest_folder(str(folder), most=100, overlap=10)
    assert n == corpus.blocks.count() and n > 3 and [r.path.rsplit("/", 1)[1] for r in refused.collect()] == ["c.bin"]
    (folder / "a.txt").write_text("new")
    corpus.ingest_folder(str(folder))
    assert sorted(r.text for r in corpus.blocks.collect()) == ["new", "short"] and {r.page_name for r in corpus.blocks.collect()} == {"a.txt", "b.md"}


def test_templates_and_numbered(spark):
    rows = spark.createDataFrame([("{x}", ["a", None, "bcd"]), (None, []), ("q", None)], "q string, d array<string>")
    got = [r.t for r in rows.select(T.from_template("{{Q}}: {q}|{d}", {"q": F.col("q"), "d": T.numbered(F.col("d"), "d", 2)}).alias("t")).collect()]
    assert got == ["{Q}: {x}|d1: a\nd2: \nd3: bc", "{Q}: |", "{Q}: q|"]


def test_write_mirrored(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.html", "één"), ("c.html", ""), ("../up.html", "x"), ("/abs.html", "x"), (None, "x"), ("n.html", None)], "p string, t string")
    for target in (str(tmp_path / "one"), f"file://{tmp_path}/two"):
        for _ in range(2):  # written again, the files are the same
            got = {r.path: (r.bytes, r.error is None) for r in write_mirrored(rows, target, F.col("p"), F.col("t"), suffix=".json").collect()}
        assert got == {"a/b.html": (5, True), "c.html": (0, True), "../up.html": (None, False), "/abs.html": (None, False), None: (None, False), "n.html": (None, False)}
    for folder in ("one", "two"):
        assert (tmp_path / folder / "a" / "b.json").read_text() == "één" and sorted(p.name for p in (tmp_path / folder).rglob("*") if p.is_file()) == ["b.json", "c.json"]
    assert write_mirrored(rows.limit(0), str(tmp_path / "three"), F.col("p"), F.col("t")).count() == 0


def test_corpus_search_and_open_store(spark, tmp_path):
    corpus = open_store(spark, "corpus", str(tmp_path / "kb"))
    assert corpus is open_store(spark, "corpus", str(tmp_path / "kb/")) and open_store(spark, "sessions", str(tmp_path / "s")).list().count() == 0
    blocks = spark.createDataFrame([("d1", 0, "red apple", "fruit"), ("d1", 1, "green pear", "fruit"), ("d2", 0, "blue sky", None)], "doc_id string, chunk_idx int, text string, title string").withColumn("filename", F.lit("f"))
    corpus.ingest_all(blocks)
    queries = spark.createDataFrame([(1, "fruit apple"), (2, "  "), (3, None), (4, "zebra")], "query_id int, text string")
    assert [(r.query_id, r.global_chunk_idx) for r in corpus.search(queries, 5).orderBy("query_id", "rank").collect()] == [(1, 0), (1, 1)]
    try:
        open_store(spark, "odd", "x")
    except ValueError as e:
        assert "corpus" in str(e)
    else:
        raise AssertionError
