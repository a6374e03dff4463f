"""Operators 4 and 7: tokens packed into windows, and written as bit planes."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from ratingloom.llm import bitplane, packing, tokens
from ratingloom.session import collected_scratch, scratch_path


def expected(documents, end):
    whole = Tokenizer.from_file(tokens.vocabulary_path())
    out = []
    for row in documents.select("doc_id", "text").collect():
        ids = whole.encode(row.text or "", add_special_tokens=False).ids + [end]
        out.append((row.doc_id, np.array(ids, "<u4")))
    return out


def check_packed(documents, window=4096, **more):
    rows = packing.pack(documents, window=window, **more).collect()
    wanted = {}
    for doc_id, ids in expected(documents, 2):
        wanted.setdefault(doc_id, []).append(ids)
    seen, windows = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded))
        seen.setdefault(r.doc_id, []).append(r)
    assert set(seen) == set(wanted)
    for doc_id, pieces in seen.items():
        assert sum(p.length for p in pieces) == sum(len(i) for i in wanted[doc_id])
        for p in pieces:
            assert any(
                len(i) == p.doc_tokens and zlib.crc32(i[p.start : p.start + p.length].tobytes()) == p.ids_crc32
                for i in wanted[doc_id]
            )
        if len(wanted[doc_id]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    padding = total = 0
    for pieces in windows.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
        assert at & (at - 1) == 0 or at == window  # nothing is padded
        total += at
    return rows, padding, total


def test_packing_places_every_id_once(documents):
    check_packed(documents, shard_documents=64)


def test_packing_small_windows(documents):
    check_packed(documents.filter("doc_id < 20"), window=64, shard_documents=7)


def test_packing_odd_rows(odd_documents, no_documents):
    check_packed(odd_documents)
    assert packing.pack(no_documents).count() == 0


def test_packing_prefers_neighbours():
    rng = np.random.default_rng(1)
    topics = [rng.integers(100 * t, 100 * t + 60, 30) for t in (1, 2) for _ in range(20)]
    order = rng.permutation(40)
    pieces = list(packing.fill([topics[i] for i in order], 120))
    windows = {}
    for document, _, _, sequence, _ in pieces:
        windows.setdefault(sequence, []).append(order[document] // 20)
    mixed = sum(len(set(w)) > 1 for w in windows.values())
    assert mixed <= 3


def test_packing_brings_neighbours_of_all_shards_together(spark):
    names = ["garden", "engine", "river", "piano", "market", "winter", "doctor", "planet"]
    rng = np.random.default_rng(6)
    rows = []
    for k in range(320):
        words = [f"{names[k % 8]} {w}" for w in rng.choice(["old", "new", "near", "under", "about", "every", "small", "big"], 15)]
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    windows = {}
    for r in packing.pack(df, window=256, shard_documents=40).collect():
        windows.setdefault(r.sequence_id, set()).add(r.doc_id % 8)
    assert len({s >> 32 for s in windows}) == 8
    assert np.mean([len(w) == 1 for w in windows.values()]) >= 0.9


def test_shards_score_with_the_statistics_of_the_corpus(spark, documents):
    tokens = packing._tokens(documents, 2, None).cache()
    corpus = packing.count_terms(tokens)
    ids = [i for _, i in expected(documents, 2)]
    assert corpus.documents == len(ids) and abs(corpus.mean - np.mean([len(i) for i in ids])) < 1e-9
    held = np.bincount(np.concatenate([np.unique(i) for i in ids]))
    assert (corpus.held == held).all()
    whole, part = packing.Index(ids), packing.Index(ids[:20], corpus=corpus)
    assert np.allclose(whole.scores(3)[:20], part.scores(3))


def test_bm25_agrees_with_the_formula():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 30, n) for n in (5, 9, 1, 14)]
    index = packing.Index(docs)
    mean = np.mean([len(d) for d in docs])
    for seed in range(4):
        for d in range(4):
            want = 0.0
            for term in set(docs[seed].tolist()):
                held = sum(term in x for x in docs)
                tf = (docs[d] == term).sum()
                want += np.log1p((4 - held + 0.5) / (held + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
            assert abs(index.scores(seed)[d] - want) < 1e-9


def test_bit_and_byte_planes_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 1000):
        for kind in ("bit", "byte"):
            for top in (2, 50_000, 2**32):
                ids = rng.integers(0, top, n).astype("<u4")
                sizes, payload = bitplane.pack_block(ids, kind)
                assert (bitplane.unpack_block(n, kind, sizes, payload) == ids).all()


def test_crc_of_parts():
    data = np.random.default_rng(4).integers(0, 256, 5000).astype(np.uint8).tobytes()
    cuts = [0, 1, 1, 700, 4096, 5000]
    parts = [(zlib.crc32(data[a:b]), b - a) for a, b in zip(cuts, cuts[1:])]
    assert bitplane.crc_of_parts(parts) == zlib.crc32(data)


def check_written(spark, documents, **how):
    path = scratch_path(spark, "test-ids")
    bitplane.write_ids(documents, path, **how)
    found = [tuple(r) for r in bitplane.read_digests(spark, path).collect()]
    wanted, start = [], 0
    ordered = sorted(expected(documents, 1), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, ids in ordered:
        wanted.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(found, key=lambda r: r[1]) == wanted
    return path


def test_written_ids_come_back(spark, documents):
    path = check_written(spark, documents, block_ids=512, files=5)
    blocks = bitplane.read_ids(spark, path).collect()
    assert sum(len(b.ids) for b in blocks) == sum(len(i) for _, i in expected(documents, 1))


def test_written_odd_rows(spark, odd_documents, no_documents):
    check_written(spark, odd_documents, files=3)
    check_written(spark, odd_documents, kind="byte", block_ids=100)
    check_written(spark, no_documents)


def test_known_words_are_not_taken_apart_again(monkeypatch):
    coder = tokens.Encoder()
    text = "Don't count, it's 2024: \u00c0 la carte\t(x)\r\n"
    want = np.array(coder._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert coder.encode(text) == want
    monkeypatch.setattr(tokens, "_PIECE", None)
    assert coder.encode(text) == want


def test_words_beyond_the_table_keep_their_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 2)
    coder = tokens.Encoder()
    text = "one, two; three. four! five? six 78 n'ts 'tis"
    want = np.array(coder._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert coder.encode(text) == want == coder.encode(text) and len(coder._pieces) <= 5


def test_encoders_can_be_let_go():
    first = tokens.encoder()
    tokens.forget()
    assert not tokens._LOADED and tokens.encoder() is not first


def test_packing_writes_the_keys_of_its_order_once(documents):
    with collected_scratch() as folders:
        packing.pack(documents, shard_documents=64).count()
    assert sum("/pack-keys-" in f for f in folders) == 1


def test_common_and_rare_terms_score_alike(monkeypatch):
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.5, n) % 50 for n in rng.integers(0, 60, 40)]
    index = packing.Index(docs)
    assert 0 < len(index._rows) < len(index._terms)
    monkeypatch.setattr(packing, "OFTEN", 2)
    plain = packing.Index(docs)
    assert not len(plain._rows)
    for seed in range(40):
        assert np.allclose(index.scores(seed), plain.scores(seed))
