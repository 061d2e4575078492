import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cohortforge.llm import bpe, id_store, packing, word_tokens

PATH = word_tokens.public_vocabulary()
DEF = word_tokens.load_definition(PATH)
ODD = ["", "don't Stop <|endoftext|> x", "ÉTÉ Ǆ İstanbul ΟΔΟΣ σ", "á e̸", "x<|startoftext|>,***",
       "tab\tsep\r\n\x0b end q \x1c z \x85y u", "1234 5,6.7", "\x01 a\x01b", "naïve—dash … 'S it'S O'RE", "((,,",
       "日本語 テスト", "fiﬁ ½ ²", "<|ENDOFTEXT|> <|endoftext|>.", "aaaaaaaaaaa !!!!! lolololol", "a" * 5000, None]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def table(spark, lib):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in rows}


def odd_frame(spark):
    return spark.createDataFrame([(i // 2 if i else None, t, "x") for i, t in enumerate(ODD)],
                                 "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize("make", [word_tokens.WordEncoder, bpe.PairIndexBpe])
def test_ids_equal_the_library(make, lib):
    model = make(DEF)
    for _ in range(2):  # the second time from the cache
        offsets, ids = model.encode(pa.array([t or "" for t in ODD], pa.large_string()))
        for i, t in enumerate(ODD):
            assert ids[offsets[i]:offsets[i + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids


def test_decoding(lib):
    model = bpe.PairIndexBpe(DEF)
    offsets, ids = model.encode(pa.array([t or "" for t in ODD], pa.large_string()))
    texts = model.decode(offsets, ids).to_pylist()
    for i in range(len(ODD)):
        assert texts[i] == lib.decode(ids[offsets[i]:offsets[i + 1]].tolist(), skip_special_tokens=False)
    assert model.decoded_sha256(offsets, ids, block=7) == model.decoded_sha256(offsets, ids)


def test_bpe_query(spark, lib, table):
    got = {r.doc_id: r for r in bpe.op9_bpe(spark, SF).collect()}
    assert got.keys() == table.keys()
    for i, ids in table.items():
        raw = np.array(ids, "<u4").tobytes()
        text = lib.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode_digests(odd_frame(spark), DEF).count() == len(ODD)
    assert bpe.encode_digests(odd_frame(spark).limit(0), DEF).count() == 0


def test_store_query(spark, table):
    got = {r.doc_id: r for r in id_store.op8_id_store(spark, SF).collect()}
    start = 0
    for i in sorted(table):
        ids = np.array([*table[i], id_store.END_ID], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_store_edges(spark, lib, tmp_path):
    id_store.write_store(odd_frame(spark), str(tmp_path / "a"), DEF, block_bytes=64)
    rows = sorted(id_store.read_store(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert len(rows) == len(ODD) and [r.start for r in rows][0] == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert rows[0].doc_id is None and sorted(r.doc_id for r in rows[1:]) == [r.doc_id for r in rows[1:]]
    two = sorted(d.tolist() for d in id_store.read_document(spark, str(tmp_path / "a"), 3))
    assert two == sorted(lib.encode(t, add_special_tokens=False).ids + [2] for t in ODD[6:8])
    id_store.write_store(odd_frame(spark).limit(0), str(tmp_path / "b"), DEF)
    assert id_store.read_store(spark, str(tmp_path / "b")).count() == 0


def check_pieces(rows, table, end=packing.END_ID):
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == table.keys()
    for i, ids in table.items():
        own = np.array([*ids, end], "<u4")
        at = 0
        for p in sorted(by[i], key=lambda r: r.start):
            assert p.start == at and p.doc_tokens == len(own)
            assert p.ids_crc32 == zlib.crc32(own[at:at + p.length].tobytes())
            at += p.length
        assert at == len(own)
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.SEQUENCE_TOKENS and len(pieces) <= packing.MAX_SEGMENTS
    return seqs


def test_packing_query(spark, table):
    seqs = check_pieces(packing.op6_packing(spark, SF).collect(), table)
    used = sum(p.length for s in seqs.values() for p in s)
    assert used / (packing.SEQUENCE_TOKENS * len(seqs)) > 0.97


def test_packing_limits_and_edges(spark):
    rng = np.random.default_rng(3)
    p = packing.Packer((64, 4, 40), 5, waiting=16)
    want = {}
    for i in range(300):
        n = int(rng.integers(1, 200))
        ids, loss = rng.integers(0, 9, n).astype(np.uint32), rng.random(n) < 0.6
        want[i] = ids
        p.add(i, ids, loss)
    p.finish()
    seqs = {}
    for doc, start, length, crc, total, seq, off, loss in p.take():
        assert zlib.crc32(want[doc][start:start + length].tobytes()) == crc and total == len(want[doc])
        seqs.setdefault(seq, []).append((length, loss, doc))
    assert sum(x[0] for s in seqs.values() for x in s) == sum(map(len, want.values()))
    assert all(sum(x[0] for x in s) <= 64 and len(s) <= 4 and sum(x[1] for x in s) <= 40 for s in seqs.values())
    frame = odd_frame(spark)
    assert packing.pack_texts(frame.limit(0), DEF).count() == 0
    assert packing.pack_texts(frame, DEF).groupBy("doc_id").count().count() == len(ODD) // 2 + 1


@pytest.mark.parametrize("times", [1, 1.9, 3])
def test_dictionary_sample_covers_every_id_range(spark, monkeypatch, times):
    n = int(200 * times)
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, f"number {i} " * 5) for i in range(n)],
                                 "doc_id long, text string").repartition(4)
    sizes = {}
    monkeypatch.setattr(id_store.zstd, "train_dictionary", lambda size, got: sizes.update(got=got) or (_ for _ in ()).throw(
        id_store.zstd.ZstdError("none")))
    assert id_store.train_dictionary(docs, DEF, 2, sample_docs=200) == b""
    assert abs(len(sizes["got"]) - 200) <= (0 if times == 1 else 60)
    lib_ids = [np.frombuffer(g, "<u2") for g in sizes["got"]]
    assert len({tuple(x[:6]) for x in lib_ids}) > 100


def test_long_documents_give_even_parts():
    ids = np.arange(100_000, dtype="<u2")
    raw = id_store.even_parts(ids)
    got = np.frombuffer(raw, "<u2").reshape(16, -1)
    assert len(raw) == id_store.MOST_BYTES and got[0][0] == 0 and got[-1][-1] == ids[-1]
    assert (np.diff(got[:, 0].astype(int)) % 65536 > 4000).all()
    assert id_store.even_parts(ids[:10]) == ids[:10].tobytes()


def test_examples_with_a_loss_mask(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for i in range(400):
        n = int(rng.integers(0, 90))
        ids, mask = rng.integers(0, 60_000, n).tolist(), (rng.random(n) < 0.7).tolist()
        rows.append((i, ids, mask, "x"))
        want[i] = ids, mask
    rows += [(1000, None, None, "x"), (1001, [5, 6, 7], None, "x"), (1002, [5, 6], [None, True, True], "x"),
             (1003, list(range(300)), [True] * 300, "x"), (None, [1], [True], "x")]
    want |= {1001: ([5, 6, 7], []), 1002: ([5, 6], [False, True]), 1003: (list(range(300)), [True] * 300), None: ([1], [True])}
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss_mask array<boolean>, offset string").repartition(2)
    got = packing.pack_examples(df, tokens=128, max_segments=5, max_loss=50).collect()
    seqs, parts = {}, {}
    for r in got:
        ids, mask = want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
        assert r.loss_tokens == sum(mask[r.start:r.start + r.length])
        seqs.setdefault(r.sequence_id, []).append(r)
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {i: sum(n for _, n in p) for i, p in parts.items()} == {i: len(ids) for i, (ids, _) in want.items() if ids}
    loads = [(sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)) for s in seqs.values()]
    assert all(t <= 128 and n <= 5 and loss <= 50 for t, n, loss in loads)
    assert max(loss for _, _, loss in loads) == 50          # the loss limit binds
    assert len(parts[1003]) == 6 and all(len(p) <= 2 for i, p in parts.items() if i != 1003)
    assert packing.pack_examples(df.limit(0)).count() == 0
    with pytest.raises(Exception):
        packing.pack_examples(df, max_loss=0).count()
