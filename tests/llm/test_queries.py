"""The registered queries of the subpackage over the whole small tables, against plain versions."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe, registry
from tests.conftest import SF
from tests.llm.test_duplicates import plain_components, plain_fingerprint, plain_imatch
from tests.llm.test_lines import plain_dedup
from tests.llm.test_models import mod5, plain_base
from tests.llm.test_pieces import plain_rules
from tests.llm.test_tokens import check_pieces


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()))


@pytest.fixture(scope="module")
def ids(texts):
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    return {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def test_op1(spark, ids):
    start, want = 0, []
    for i in sorted(ids):
        want.append((i, start, len(ids[i]), crc(ids[i])))
        start += len(ids[i])
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op1_token_store")) == want


def test_op2(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op2_secret_scan")}
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = plain_base(t or "")
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest() and set(filter(None, written.split(","))) <= set(r.spans.split(","))


def test_op3(spark, texts):
    small = dict(sorted(texts.items(), key=lambda r: len(r[1] or ""))[:70])
    docs = spark.createDataFrame(list(small.items()), "doc_id long, text string")
    from tessella.llm import line_dedup

    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == dict(plain_dedup(list(small.items())))
    rows = run(spark, "op3_line_dedup")
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.class_id <= r.doc_id and r.n_links >= 0 and (r.n_dropped > 0 or r.kept_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


def test_op5(spark, texts):
    rows = run(spark, "op5_pieces")
    assert {r.doc_id for r in rows} == set(texts) and all(r.round_trip for r in rows)


def test_op6_and_op8(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op6_quality")}
    assert set(got) == set(texts)
    for i, t in texts.items():
        r = got[i]
        n, chars, symbols, dup, repeat = plain_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n)
        assert not (r.kept and r.base_failed)
    rows = run(spark, "op8_toxicity")
    assert {r.doc_id for r in rows} == set(texts) and all(r.held_out == mod5(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in rows)


def test_op7(spark, texts):
    check_pieces(run(spark, "op7_packing"), texts)


def test_op9(spark, texts):
    rows = run(spark, "op9_imatch")
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows)
    assert got == sorted(plain_imatch(list(texts.items())))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(con.execute(registry.ORACLE_SQL["op9_imatch"]).fetchall()) == got


def test_op10(spark, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    distinct = sorted(set(fps.values()))
    root = plain_components(distinct, [(a, b) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= 2])
    least = {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    want = sorted((i, f"{f:016x}", least[root[f]]) for i, f in fps.items())
    assert sorted(tuple(r) for r in run(spark, "op10_simhash")) == want
