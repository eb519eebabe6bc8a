import random
import sys

import corpus_pipeline as cp
from tessella.llm import langid
from tests.llm.test_duplicates import jaccard, plain_components, plain_fingerprint
from tests.llm.test_lines import plain_dedup
from tests.llm.test_models import plain_base
from tests.llm.test_tokens import check_pieces


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def near_kept(inputs, before):
    """The least id of each group of texts that are alike, as they are now or as they were."""
    now, then = set(inputs.values()), {before[i] for i in inputs if i in before}
    fps = {t: plain_fingerprint(t, 5) for t in now | then}
    links = [(a, b) for texts in (now, then) for a in texts for b in texts if a < b and (jaccard(a, b) >= 0.8 or bin(fps[a] ^ fps[b]).count("1") <= 2)]
    root = plain_components(sorted(now | then), links + [(t, before[i]) for i, t in inputs.items() if i in before])
    least = {}
    for i in sorted(inputs):
        least.setdefault(root[inputs[i]], i)
    return set(least.values())


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = cp.language(spark, docs, sf_dir)
    model = langid.fit(docs)
    assert first.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    langs, scores = model.predict(list(texts.values()))
    assert {r.doc_id: r.lang for r in first.collect()} == {i: x for i, x, s in zip(texts, langs, scores) if x != "und" and s >= 0.3}
    assert rows(first) == sorted(((i, t) for (i, t), x, s in zip(texts.items(), langs, scores) if x != "und" and s >= 0.3), key=str)

    small = first.orderBy("doc_id").limit(60)
    second = cp.lines(spark, small, sf_dir)
    before = rows(small)
    after = plain_dedup(before)
    assert second.columns == docs.columns
    assert rows(second) == sorted(((i, b) for (i, a), (_, b) in zip(before, after) if a == b or b.strip()), key=str)
    assert all(r.n_chars == len(r.text) for r in second.collect())

    whole = cp.lines(spark, first, sf_dir)
    third = cp.near_duplicates(spark, whole, sf_dir)
    inputs = {r.doc_id: r.text for r in whole.collect()}
    got = {r.doc_id for r in third.collect()}
    assert third.columns == docs.columns and got == near_kept(inputs, texts)
    assert all(r.text == inputs[r.doc_id] for r in third.collect())

    fourth = cp.secrets(spark, third, sf_dir)
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    assert not any(plain_base(r.text) for r in fourth.collect())

    final = cp.pack(spark, fourth, sf_dir)
    check_pieces(final.collect(), {r.doc_id: r.text for r in fourth.collect()})


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the and of this that", "en", None, 3), (4, "the and of this that", "en", "s", 20), (4, "the and of this that", "en", "s", 20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("odd", odd), ("none", [])):
        spark.createDataFrame(data, schema).selectExpr("*", "1 as row_id", "2 as n_dropped").write.parquet(str(tmp_path / name / "documents.parquet"))
        got = cp.run(spark, str(tmp_path / name))
        assert got.count() == (1 if data else 0)


def test_near_copies_that_line_dedup_has_cut(spark, tmp_path):
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(3000)]
    texts, copies = [], set()
    for i in range(30):
        lines = [[rng.choice(vocab) for _ in range(40)] for _ in range(8)]
        texts.append("\n".join(" ".join(x) for x in lines))
        for _ in range(4):  # a word or two of a few lines is new
            own = [list(x) for x in lines]
            for x in rng.sample(own, 3):
                x[rng.randrange(40)] = rng.choice(vocab) + "new"
            copies.add(len(texts))
            texts.append("\n".join(" ".join(x) for x in own))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    cut = spark.createDataFrame(cp.lines(spark, docs, str(tmp_path)).collect(), docs.schema)
    inputs = {r.doc_id: r.text for r in cut.collect()}
    got = {r.doc_id for r in cp.near_duplicates(spark, cut, str(tmp_path)).collect()}
    before = dict(enumerate(texts))
    alike = {j for i in range(len(texts)) for j in range(i + 1, len(texts)) if i // 5 == j // 5 and jaccard(texts[i], texts[j]) >= 0.8}
    assert got == near_kept(inputs, before) and len(alike - got) >= 0.9 * len(alike) and got >= set(range(0, 150, 5))


def test_the_driver_gives_memory_back_after_many_work_tables(spark, monkeypatch):
    from tessella import work

    calls = []
    real = work.release_driver
    monkeypatch.setattr(work, "release_driver", lambda s: calls.append(real(s)))
    folder = work.Workspace(spark)
    for _ in range(2 * work.EVERY):
        kept = folder.keep(spark.range(3).toDF("x"))
        assert kept.count() == 3
    folder.clear()
    assert len(calls) == 2 and all(x is (sys.platform == "linux") for x in calls)
