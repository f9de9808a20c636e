import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing, tokenfiles
from lodestone.llm.encoder import Encoder
from lodestone.staging import Staging

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a", " a", "a ", "a  b", "a   b c", "x\n y", "x \ny z", "x\n\ny", "Don't  'S it's", "é   x", "a  b", "\x1c \x1d", "<|endoftext|> b", "日本 語\t x", "Σας ΟΔΟΣ é ́x", "12 3456,  7!!", "a\x85 b \x0b c", "İ!", "x İ. y", "hello <|endoftext|> there", "<|startoftext|>a,b", "\u0958! \ufb2a? \u212b.", "H\u0331 t\u0308."]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain(path, text, end):
    return _tokenizer(path).encode(text or "", add_special_tokens=False).ids + [end]


@lru_cache
def _tokenizer(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize(("path", "keeps"), [(WORDS, False), (BYTES, True)])
def test_pieces_give_the_ids_of_whole_texts(path, keeps, rows):
    coder = Encoder(path, keeps, 0)
    texts = [*TEXTS, *(r[1] or "" for r in rows)]
    for some in (texts, texts[::-1], texts[:1]):
        ids, begins = coder.encode(pa.array(some, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == [plain(path, t, 0) for t in some]


@pytest.mark.parametrize(("path", "keeps"), [(WORDS, False), (BYTES, True)])
def test_ids_of_odd_texts(path, keeps):
    r = random.Random(11)
    odd = [chr(c) for c in range(0x250)] + list("ſK\u212b\u0958\ufb2a\ufb01…—’“日本語한ᄀ\u200b\u200d\x85\u2028\u3000 Σςαйё٣①½ªº")
    plain_ones, marks = list("abchijkstwyzABHIJKTWY") + list(" .,;:!?'\"-\n") * 2, [chr(c) for c in range(0x300, 0x340)]
    whole = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "'s", "'LL", "n't", "  ", "İ", "H\u0331"]
    kinds = [(0.75, plain_ones), (0.82, marks), (0.96, odd), (1.0, whole)]
    texts = ["".join(r.choice(next(k for p, k in kinds if x <= p)) for x in (r.random() for _ in range(r.randint(1, 14)))) for _ in range(5000)]
    ids, begins = Encoder(path, keeps, 0).encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == [plain(path, t, 0) for t in texts]


def test_token_files(spark, docs, rows, empty):
    staging = Staging(spark, "t")
    manifest = tokenfiles.write_token_files(docs, WORDS, staging.path("files"), False, 2, staging=staging)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_token_files(manifest).collect()}
    start = 0
    for i, text, *_ in sorted(rows):
        ids = plain(WORDS, text, 2)
        assert got[i] == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(rows)
    assert tokenfiles.read_document(spark, manifest, rows[3][0]) == plain(WORDS, rows[3][1], 2)
    assert tokenfiles.read_document(spark, manifest, -5) is None
    assert tokenfiles.round_trip(empty, WORDS).count() == 0


def test_odd_tables_of_token_files(spark):
    long = "ab, " * 300_000
    rows = [(None, "a b", 1), (None, None, 2), (None, "c", 3), (4, "d", 4), (4, "d", 4), (4, "e", 5), (2**63 - 1, long, 6), (-(2**63), "f", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    got = sorted(tokenfiles.round_trip(frame, WORDS).collect(), key=lambda r: r.start)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(plain(WORDS, t, 2)), crc(plain(WORDS, t, 2))) for i, t, _ in rows)
    assert [r.doc_id for r in got] == [None] * 3 + sorted(r[0] for r in rows if r[0] is not None)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    staging = Staging(spark, "t")
    manifest = tokenfiles.write_token_files(frame.where("doc_id is null"), WORDS, staging.path("files"), False, 2, staging=staging)
    assert manifest.first().without_id > 0 and tokenfiles.read_document(spark, manifest, 4) is None
    with pytest.raises(ValueError, match="bytes"):
        tokenfiles.write_token_files(frame, WORDS, staging.path("files"), False, 2, width=1)


@pytest.mark.parametrize("samples", [[b"\x02\x00"], [bytes([i, 0] * 9) for i in range(5)], [np.random.default_rng(i).integers(0, 99, 100).astype("<u2").tobytes() for i in range(500)]])
def test_small_tables_have_a_dictionary(samples):
    dictionary = tokenfiles.train_dictionary(samples)
    assert dictionary
    codec = tokenfiles.Codec(dictionary)
    assert all(codec.unpack(codec.pack(s)) == s for s in samples)


def test_stretches_cover_long_documents():
    cells = np.arange(100_000, dtype="<u2").tobytes()
    some = np.frombuffer(tokenfiles.stretches(cells, 1 << 14), "<u2")
    assert len(some) <= 1 << 13 and some.min() == 0 and some.max() > 30_000 and tokenfiles.stretches(cells[:100], 1 << 14) == cells[:100]


def test_shards_name_their_dictionary(tmp_path):
    samples = [np.random.default_rng(i).integers(0, 99, 400).astype("<u2").tobytes() for i in range(300)]
    dictionary = tokenfiles.train_dictionary(samples, 4096)
    assert dictionary
    tokenfiles.write_whole(f"file://{tmp_path}/s", tokenfiles.shard_parts(iter([(7, samples[0]), (None, b"")]), dictionary, 2, {}))
    shard = tokenfiles.Shard(f"file://{tmp_path}/s", dictionary)
    assert shard.find(7).tobytes() == samples[0] and shard.document(1).size == 0 and shard.ids == [7, None]
    with pytest.raises(ValueError, match="dictionary"):
        tokenfiles.Shard(f"file://{tmp_path}/s", b"")


def check_pack(rows, got, window):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text, *_ in rows:
        ids, at = plain(BYTES, text, 0), 0
        for start, length, check, total in sorted(pieces.pop(i)):
            assert start == at and length > 0 and total == len(ids) and check == crc(ids[start : start + length])
            at += length
        assert at == len(ids)
    assert not pieces
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


@pytest.mark.parametrize(("window", "quantum"), [(1024, 128), (64, 16), (32, 7)])
def test_packing(docs, rows, window, quantum):
    check_pack(rows, packing.pack(docs, BYTES, window=window, quantum=quantum).collect(), window)


def test_windows_hold_the_sources_in_proportion(spark):
    rows = [(i, f"word{i} " * (40 + i % 7), None, "abc"[min(i % 6, 2)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    source = {r[0]: r[3] for r in rows}
    got = packing.pack(frame, BYTES).collect()
    check_pack(rows, got, 1024)
    held, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in got:
        held[r.sequence_id][source[r.doc_id]] += r.length
        total[source[r.doc_id]] += r.length
    for h in held.values():
        if sum(h.values()) == 1024:
            assert all(abs(h[s] - 1024 * total[s] / sum(total.values())) <= 2 * 128 for s in total)


@pytest.mark.parametrize("weights", [None, {"s1": 5.0, "s3": 1.0}])
def test_many_sources(spark, monkeypatch, weights):
    """Beyond QUEUES sources, a sorted table of quanta gives every source its proportion as well."""
    rows = [(i, f"word{i} " * (30 + i % 90), None, "hot" if i % 3 == 0 else f"s{i % 40}" if i % 41 else None) for i in range(600)]
    rows.append((601, "long text " * 20_000, None, "hot"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    source = {r[0]: r[3] for r in rows}
    monkeypatch.setattr(packing, "QUEUES", 10)
    got = packing.pack(frame, BYTES, weights).collect()
    check_pack(rows, got, 1024)
    held, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in got:
        held[r.sequence_id][source[r.doc_id]] += r.length
        total[source[r.doc_id]] += r.length
    if weights is None:
        for h in held.values():
            if sum(h.values()) == 1024:
                assert all(abs(h[s] - 1024 * total[s] / sum(total.values())) <= (4 if s == "hot" else 2) * 128 for s in total)
    else:
        first = defaultdict(int)
        for number in range(sum(total.values()) // 1024 // 4):  # some ten quanta of the two
            for s, n in held[number].items():
                first[s] += n
        assert first["s1"] > 3 * first["s3"]


def placed(pieces):
    """Where every single id of every document lies."""
    return {(r.doc_id, r.start + i): (r.sequence_id, r.offset + i) for r in pieces for i in range(r.length)}


@pytest.mark.parametrize("weights", [None, {"s1": 5.0, "s3": 1.0}])
def test_both_ways_lay_every_id_in_one_place(spark, monkeypatch, weights):
    rows = [(i, f"word{i} " * (30 + i % 90), "hot" if i % 3 == 0 else f"s{i % 5}" if i % 41 else None) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).cache()
    one = placed(packing.pack(frame, BYTES, weights).collect())
    monkeypatch.setattr(packing, "QUEUES", 2)
    other = placed(packing.pack(frame, BYTES, weights).collect())
    assert one == other and len(one) > 20_000


def test_target_weights_and_odd_tables(spark, rows, docs, empty):
    check_pack(rows, packing.pack(docs, BYTES, weights={"a": 1.0, "b": 3.0, None: 0.5}, window=64, quantum=16).collect(), 64)
    assert packing.pack(empty, BYTES).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "x y", None), (1, "x y", None)], "doc_id long, text string, source string")
    assert sum(r.length for r in packing.pack(odd, BYTES).collect()) == sum(len(plain(BYTES, t, 0)) for t in ("", "x y", "x y"))


@pytest.mark.parametrize("most", [0, 5, 40])
def test_pieces_that_are_forgotten(monkeypatch, rows, most):
    from lodestone.llm import encoder

    monkeypatch.setattr(encoder, "PIECES", most)
    coder = Encoder(BYTES, True, 0)
    for r in rows:
        ids, _ = coder.encode(pa.array([r[1] or "", "the same words"], pa.large_string()))
        assert ids.tolist() == plain(BYTES, r[1], 0) + plain(BYTES, "the same words", 0)
