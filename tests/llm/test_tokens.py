import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import packing, tokens, wavelet

public = pytest.importorskip("public_tokenizers")
HARD = [
    "", "a b", "a  b", "a\n\nb", "don't we'll x's 'S", "foo123bar 4 5,6.7", "Ǆ İstanbul ΑΣ ΑΣ. Σ", "\x1c a \x1d", "é a ́b", "日本 語 　 x",
    "<|endoftext|> <|startoftext|>", "\r\na\r\n\r\nb", " lead", "trail  ", "é  x", "naïve café’s “q”", "word\n", "ſ K", "x" * 5000,
]


def _whole(name):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public.path(name))
    coder.encode_special_tokens = True
    return lambda text: coder.encode(text or "", add_special_tokens=False).ids


def _texts():
    rnd = random.Random(2)
    return HARD + ["".join(rnd.choice("ab é.'\n\t  sS1, 　ü") for _ in range(rnd.randint(0, 40))) for _ in range(1500)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_whole_texts(name):
    whole, coder, got = _whole(name), tokens.Encoder(public.path(name)), []
    for first, last, ids, bounds in coder.batches(pa.array(_texts())):
        got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(last - first)]
    assert got == [whole(t) for t in _texts()]


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(tokens, "hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    whole, coder = _whole("byte_bpe_50k.json"), tokens.Encoder(public.path("byte_bpe_50k.json"))
    texts = ["one two six ten", "a b c d", "one two"]
    ((_, _, ids, bounds),) = coder.batches(pa.array(texts))
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(3)] == [whole(t) for t in texts]


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 512, 513, 4000):
        ids = rng.integers(0, 60, n).astype(np.uint16)
        matrix = wavelet.WaveletMatrix.of(ids)
        payload = matrix.to_bytes(np.arange(3), np.array([True, False, True]), np.array([n, n, n]))
        matrix, docs, known, ends = wavelet.WaveletMatrix.from_bytes(payload)
        assert matrix.ids().tolist() == ids.tolist() and known.tolist() == [True, False, True] and ends.tolist() == [n] * 3
        for place in range(0, n, 97):
            assert matrix.access(place) == ids[place]
            assert matrix.rank(int(ids[place]), place) == int((ids[:place] == ids[place]).sum())
        for symbol in {*ids[:20].tolist(), 61, 70000}:
            places = np.flatnonzero(ids == symbol).tolist()
            assert matrix.count(symbol) == len(places)
            assert [matrix.select(symbol, k) for k in range(len(places))][:50] == places[:50]


def test_token_files_round_trip(spark, documents, tmp_path):
    rows = [(i * 3 % 101, t) for i, t in enumerate(_texts()[:101])] + [(500, None), (600, "long " * 3000), (None, "no id")]
    whole = _whole("byte_bpe_50k.json")
    files = wavelet.written(documents(rows).repartition(3), public.path("byte_bpe_50k.json"), str(tmp_path / "files"), 3, block=200)
    assert files.count() > 3
    found = {r["doc_id"]: r for r in wavelet.documents(files).collect()}
    before = 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(whole(text) + [0], "<u4")
        assert (found[doc]["start"], found[doc]["n_tokens"], found[doc]["ids_crc32"]) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)
    none = wavelet.written(documents([]), public.path("byte_bpe_50k.json"), str(tmp_path / "none"))
    assert wavelet.documents(none).count() == 0


def test_packing_is_whole_and_close(documents, monkeypatch):
    rnd = random.Random(7)
    words = ["the", "cat", "sat", "on", "mat", "mañana", "12", "!"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 20, 60])))) for i in range(900)]
    rows += [(2000, "cat " * 150), (2001, None), (2002, ""), (2003, "cat " * 63), (2004, "cat " * 64), (None, "mat"), (7, "again")]
    whole = _whole("word_bpe_49k.json")
    found = packing.packed(packing.pieces(documents(rows), public.path("word_bpe_49k.json"), 64), 64, group=200).collect()
    by_doc = Counter()
    for r in found:
        by_doc[r["doc_id"]] += r["length"]
    assert by_doc[2000] == 151 and by_doc[2001] == by_doc[2002] == 1 and by_doc[2003] == 64 and by_doc[2004] == 65
    texts = dict(rows[:900])
    for r in found:
        if r["doc_id"] in texts and r["doc_id"] != 7:
            ids = np.array((whole(texts[r["doc_id"]]) + [1])[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["start"] == r["piece"] * 64
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.03 * sum(by_doc.values()) / 64 + 1
    assert packing.packed(packing.pieces(documents([]), public.path("word_bpe_49k.json"))).count() == 0


def test_sum_of_squares_choice():
    # Gaps of 4 and 6 are open; a 4 closes the first, which leaves fewer squares than gap 2.
    bins, offsets = packing.sum_of_squares(np.array([6, 4, 4]), 10)
    assert offsets.tolist() == [0, 6, 0] and bins[0] == bins[1]
    lengths = np.random.default_rng(1).integers(1, 1000, 3000)
    bins, _ = packing.sum_of_squares(lengths, 4096)
    assert np.bincount(bins, weights=lengths).max() <= 4096 and bins.max() + 1 <= 1.01 * lengths.sum() / 4096 + 1


def test_no_group_grows_where_pieces_find_no_partner(spark, monkeypatch):
    real, group = packing._packed, 50

    def bounded(room):
        inner = real(room)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = list(batches)
            assert sum(p.num_rows for p in parts) <= 2 * group, "a group has grown"
            yield from inner(iter(parts))

        return run

    monkeypatch.setattr(packing, "_packed", bounded)
    cut = spark.range(1500).selectExpr("id AS doc_id", "CAST(IF(id % 10 = 0, 200, 400 + id % 5) AS long) AS length")
    found = packing.packed(cut, 640, group=group).collect()
    fill = Counter()
    for r in found:
        fill[r["sequence_id"]] += r["length"]
    assert sorted(r["doc_id"] for r in found) == list(range(1500)) and max(fill.values()) <= 640
    assert len(fill) <= 1.03 * 1350  # a long piece each, small ones beside them


SPECIAL = ["a <|endoftext|> b", "<|endoftext|><|startoftext|>x", "Σ<|endoftext|>\nb  <|endoftext|>  ", "x<|endof", "text|>y", "<|<|endoftext|>|>", "no"]


def _untouched(name):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public.path(name))
    return lambda text: coder.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_encode_like_the_library(name):
    rnd = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "a", "B", " ", "\n", "é", "'s", "1", "."]
    texts = SPECIAL + _texts() + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    whole, coder, got = _untouched(name), tokens.Encoder(public.path(name), added=True), []
    for first, last, ids, bounds in coder.batches(pa.array(texts)):
        got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(last - first)]
    assert got == [whole(t) for t in texts]


def test_queries_read_added_tokens(documents, spark, tmp_path):
    from ledgerloom.llm.queries import LLM_QUERIES

    documents(list(enumerate(SPECIAL))).write.parquet(f"{tmp_path}/documents.parquet")
    for query, name, end in (("op8_token_files", "byte_bpe_50k.json", 0), ("op9_packing", "word_bpe_49k.json", 1)):
        whole = _untouched(name)
        want = {i: zlib.crc32(np.array(whole(t) + [end], "<u4").tobytes()) for i, t in enumerate(SPECIAL)}
        assert {r["doc_id"]: r["ids_crc32"] for r in LLM_QUERIES[query](spark, str(tmp_path)).collect()} == want


def test_a_worker_keeps_little_and_nothing_after_a_partition(monkeypatch):
    texts = pa.array([" ".join(f"{chr(97 + i % 26)}word{i * 7919 + j}x" for i in range(4000)) for j in range(40)])
    whole = tokens.Encoder(public.path("byte_bpe_50k.json"))
    plain = [ids.tobytes() for *_, ids, _ in whole.batches(texts)]
    monkeypatch.setattr(tokens, "CACHE_BYTES", 1 << 20)
    with tokens.Encoder(public.path("byte_bpe_50k.json")) as coder:
        for (*_, ids, _), told in zip(coder.batches(texts), plain, strict=True):
            # What one chunk adds comes on top of the bound.
            assert coder.held < (1 << 20) + 2 * tokens.CHUNK_BYTES * 60 and ids.tobytes() == told
    assert not coder.words and not coder.place and coder.held == 0
    assert tokens.CACHE_BYTES + 2 * tokens.CHUNK_BYTES <= 64 << 20
