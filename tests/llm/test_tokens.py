"""Records, packing and pieces against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessitura.llm import packing, piecebpe, records, shared, subwords
from tessitura.llm.registry import vocabulary
from tests.llm.conftest import CASES

tokenizers = pytest.importorskip("tokenizers")


def library(name):
    t = tokenizers.Tokenizer.from_file(vocabulary(name))
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts(n, alphabet=" \n\t \x1c\x85ab1'sé́Σ<|>漢🦙\x00"):
    r = random.Random(4)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(n)] + [t or "" for _, t, _ in CASES] + ["<|endoftext|> a <|endoftext|>", "<|startoftext|>x", "<|startoftext|>", "a<|endoftext|>b<|endoftext|><|endoftext|> c", " <|endoftext|>\n<|startoftext|> "]


@pytest.mark.parametrize(("name", "style"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_encode_like_whole_texts(name, style, monkeypatch):
    texts = odd_texts(3000)
    want = library(name)(texts)
    encode = subwords.UnitEncoder(vocabulary(name), style)
    assert [np.frombuffer(x, encode.dtype).tolist() for x in encode.encode(texts)] == want
    monkeypatch.setattr(subwords, "CACHE_UNITS", 50)
    small = subwords.UnitEncoder(vocabulary(name), style)
    got = [np.frombuffer(x, small.dtype).tolist() for i in range(0, len(texts), 100) for x in small.encode(texts[i : i + 100])]
    assert got == want


def test_records_round_trip(spark, docs, empty):
    folder = shared.shared_dir(spark, "records")
    manifest = records.write(docs, folder, vocabulary("byte_bpe_50k.json"))
    rows = sorted(records.read(manifest).collect(), key=lambda r: r.start)
    cases = sorted(((i, t or "") for i, t, _ in CASES), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    encoded = library("byte_bpe_50k.json")([t for _, t in cases])
    at = 0
    for row, (doc_id, _), ids in zip(rows, cases, encoded, strict=True):
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, at, len(ids) + 1)
        assert np.frombuffer(row.ids, "<u4").tolist() == [*ids, 0]
        at += len(ids) + 1
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in records.read(manifest, digests=True).collect()}
    assert digests == {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in rows}
    shard = manifest.first()
    with shared.open_uri(shard.entries, "rb") as f:
        entries = records.read_entries(f)
    with shared.open_uri(shard.records, "rb") as f:  # a shuffled read of the last record
        doc_id, ids = records.read_at(f, int(entries["offset"][-1]))
    assert len(ids) == entries["tokens"][-1]
    assert records.read(records.write(empty, folder + "-empty", vocabulary("byte_bpe_50k.json"))).isEmpty()


def test_damaged_records_are_noticed(tmp_path):
    data = bytearray(records.frame(records.payload(5, b"\x01\x00", 2)))
    path = tmp_path / "x.rec"
    for at in (3, 9, 15, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        path.write_bytes(bad)
        with path.open("rb") as f, pytest.raises(ValueError, match="damaged"):
            list(records.read_frames(f))
    path.write_bytes(data[:-3])
    with path.open("rb") as f, pytest.raises(ValueError, match="damaged"):
        list(records.read_frames(f))


def check_pieces(rows, texts):
    """Every id in exactly one piece; sequences gapless and within their limit."""
    encoded = library("word_bpe_49k.json")(list(texts))
    want = sorted(zlib.crc32(np.array([*ids, 1], "<u4").tobytes()) for ids in encoded)
    documents, at = [], {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.start)):
        at.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in at.values():
        starts = {}
        for r in pieces:
            starts.setdefault(r.start, []).append(r)
        while any(starts.values()):
            body, here = b"", 0
            while here in starts and starts[here]:
                r = starts[here].pop()
                assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
                body += bytes(r.ids)
                here += r.length
            assert here == pieces[0].doc_tokens
            documents.append(zlib.crc32(body))
    assert sorted(documents) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        here = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == here
            here += r.length
        assert here == s[0].sequence_tokens
    return {k: v[0].sequence_tokens for k, v in sequences.items()}


def test_packing(docs, empty, corpus):
    for table in (docs, corpus):
        rows = packing.pack(table, vocabulary("word_bpe_49k.json"), with_ids=True).collect()
        sizes = check_pieces(rows, [r.text or "" for r in table.select("text").collect()])
        assert max(sizes.values()) <= 2048
        padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values())
        assert padding <= 0.01 * sum(sizes.values()) + 8
    assert packing.pack(empty, vocabulary("word_bpe_49k.json")).isEmpty()


def test_packing_of_whole_examples():
    """Limits on tokens, segments and loss-bearing tokens at once, nothing cut."""
    r, bins = random.Random(7), []
    packer = packing.Packer(lambda items, over: bins.append((items, over)), max_tokens=100, max_segments=4, max_loss=40, pool=64, cut=False)
    items = []
    for k in range(500):
        n = r.randrange(1, 60)
        items.append(packing.Item(k, 0, np.arange(n), n, np.arange(n) < r.randrange(0, min(n, 40) + 1)))
    items.append(packing.Item(500, 0, np.arange(300), 300, np.zeros(300, bool)))
    for x in items:
        packer.add(x)
    packer.pack(0)
    assert sorted(x.doc for b, _ in bins for x in b) == list(range(501))
    for b, over in bins:
        total = np.sum([x.demand() for x in b], axis=0)
        assert over == (b[0].doc == 500) and (over or (total <= [100, 4, 40]).all())


def test_pieces_like_sentencepiece(docs, empty, corpus, monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = vocabulary("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), piecebpe.PieceModel(path)
    texts = odd_texts(2000, " \n▁aàéthe  inging漢🦙aaa​<s>xyz0123'.,") + ["a" * 700, " " * 600 + "x", "the" * 300 + " " * 33, "0" * 1000, "ab " * 400, "漢" * 300]
    assert model.encode(texts) == sp.encode(texts)
    assert [model.decode(ids) for ids in sp.encode(texts)] == [sp.decode(ids) for ids in sp.encode(texts)]
    words = [piecebpe.SPACE + t for t in texts if t]
    rounds = model.merge(words)
    monkeypatch.setattr(piecebpe, "LONG", 1)
    assert all(np.array_equal(a, b) for a, b in zip(rounds, model.merge(words), strict=True))
    r = random.Random(1)
    for _ in range(500):  # byte pieces in any order
        ids = [r.randrange(0, 400) for _ in range(6)]
        assert model.decode(ids) == sp.decode(ids)
    for table in (docs, corpus):
        rows = piecebpe.encode_documents(table, path, with_ids=True).collect()
        texts = sorted(r.text or "" for r in table.select("text").collect())
        assert sorted(tuple(x.ids) for x in rows) == sorted(tuple(x) for x in sp.encode(texts))
        for x in rows:
            assert x.n_tokens == len(x.ids) and x.ids_sha256 == hashlib.sha256(",".join(map(str, x.ids)).encode()).hexdigest()
            assert x.decoded == sp.decode(x.ids) and x.decoded_sha256 == hashlib.sha256(x.decoded.encode()).hexdigest()
    assert piecebpe.encode_documents(empty, path).isEmpty()
