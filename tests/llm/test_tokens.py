import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import bpe, packing, token_store
from tessella.llm.common import Workspace

pytest.importorskip("public_tokenizers")
ODD = ["", " ", "a", "a  b", " lead", "trail ", "line\n next", "tab\t x", "it 's don't", "x" * 5000, "é  ü", "a \n\n b  c\n", "<|endoftext|> end", "one two three\n", "  wide", "🙂 🙂", "1 2 3", "a,b. c.\n1,000.5 x., \"y\", z's. é, ü.", "nul \0, in, \0x"]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.encode_special_tokens = True
    return t


def plain(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


def test_memo_encoding_equals_whole_text():
    coder = bpe.load(bpe.tokenizer_path())
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice("ab é\n\t .,'s1 ") for _ in range(60)) for _ in range(200)]
    for _ in range(2):
        for t, ids in zip(texts, coder.encode_column(pa.array([*texts, None]))):
            assert ids.tolist() == plain(t), repr(t)


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2**40], list(range(0, 100000, 7)), [2**63, 2**63 + 1]])
def test_elias_fano_round_trip(values):
    ef = token_store.EliasFano.build(np.array(values, dtype=np.uint64))
    back, _ = token_store.EliasFano.from_bytes(memoryview(ef.to_bytes()), 0)
    assert back.values().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1} if values else ():
        assert back.select(i) == values[i]
    with pytest.raises(IndexError):
        back.select(len(values))


def test_store_holds_every_document(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (None, "no id"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as payload", "2 as shard")
    path = f"{Workspace(spark).folder}/store"
    token_store.write_store(docs, path, bpe.tokenizer_path(), segment_tokens=40)
    got = sorted(map(tuple, token_store.read_documents(spark, path).collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (doc_id, text), g in zip(order, got, strict=True):
        ids = np.array([*plain(text or ""), 0], dtype="<u4")
        assert g[:4] == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    seg = token_store.Segment(token_store.segments(spark, path).orderBy("shard", "segment").first()["payload"])
    assert seg.document(0).tolist() == [*plain(order[0][1]), 0]


def test_empty_store(spark):
    path = f"{Workspace(spark).folder}/store"
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), path, bpe.tokenizer_path())
    assert token_store.read_documents(spark, path).count() == 0


def test_differencing_partitions_evenly():
    rng = random.Random(3)
    sizes = [rng.randint(1, 256) for _ in range(600)]
    bins = packing.differencing(sizes, 80)
    assert sorted(i for b in bins for i in b) == list(range(600))
    totals = [sum(sizes[i] for i in b) for b in bins]
    assert max(totals) - min(totals) <= 16
    assert packing.differencing([4, 5, 6, 7, 8], 2) and {sum([4, 5, 6, 7, 8][i] for i in b) for b in packing.differencing([4, 5, 6, 7, 8], 2)} == {14, 16}
    assert len(packing.pack([700] * 4, 1024)) == 4


def check_pieces(rows, texts):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = np.array([*plain(texts[doc_id] or ""), 0], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    return by_seq


def test_packing_keeps_every_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seqs = check_pieces(packing.op7_packing(spark, sf_dir).collect(), texts)
    total = sum(p.length for s in seqs.values() for p in s)
    assert total / (1024 * len(seqs)) > 0.985


def test_packing_odd_rows(spark):
    texts = dict(enumerate(ODD)) | {50: None, None: "x y z"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "7 as offset", "8 as length")
    check_pieces(packing.pack_documents(docs, bpe.tokenizer_path()).collect(), texts)
    assert packing.pack_documents(docs.limit(0), bpe.tokenizer_path()).count() == 0


def test_new_pieces_meet_the_library_many_at_once(monkeypatch):
    coder = bpe.Bpe(bpe.tokenizer_path())
    words = [f"w{i}x{i * i}" for i in range(3000)]
    texts = [" ".join(words), "\n".join(words[::-1]) + ".", "a. b, c\tд é\x85\n\nq " + ". ".join(words[:700])]
    sent = []
    whole = coder._whole
    monkeypatch.setattr(coder, "_whole", lambda some: (sent.append(len(some)), whole(some))[1])
    got = coder.encode_column(pa.array(texts[:1]))
    assert sum(sent) < 100
    for text, ids in zip(texts, got + coder.encode_column(pa.array(texts[1:]))):
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
