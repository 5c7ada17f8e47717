"""Packing, record files and shards: exact round trips and the laws that results obey."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from coordspark.llm import records_io
from coordspark.llm.best_fit import best_fit_pack, best_fit_plan
from coordspark.llm.kd_shards import kd_shards
from coordspark.llm.tokens import Encoder, word_bpe
from coordspark.session import scratch_path


def ids_of(text, end):
    tok = Tokenizer.from_file(word_bpe())
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def best_fit_bins(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(100):
        cap = r.randint(1, 40)
        lengths = [r.randint(1, cap) for _ in range(r.randint(0, 150))]
        plan, fill, placed = best_fit_plan(Counter(lengths), cap), Counter(), set()
        for n, rank, count, first, offset in plan:
            for k in range(count):
                assert fill[first + k] == offset
                fill[first + k] += n
                placed.add((n, rank + k))
        assert len(placed) == len(lengths) and len(fill) == best_fit_bins(lengths, cap) and max(fill.values(), default=0) <= cap


def test_encoder_equals_the_library():
    texts = ["It's the dog's!'s they'll 've ''s 's's don't", "", None, "aİb café ½ x²", "日本語 text <|endoftext|> x", "tab\there\x1cx", "ªº ß ŉ Ǆ", "'S WE'RE", "ΑΣ Σ", "é é", "a\xa0b"]
    enc = Encoder(word_bpe(), most_words=3)
    tok = Tokenizer.from_file(word_bpe())
    for _ in range(2):
        assert [x.tolist() for x in enc.ids(texts)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("ranked_rows", [250_000, 3])
def test_packed_pieces(edge, ranked_rows):
    got = best_fit_pack(edge, word_bpe(), capacity=64, ranked_rows=ranked_rows).collect()
    texts = defaultdict(list)
    for r in edge.select("doc_id", "text").collect():
        texts[r.doc_id].append(ids_of(r.text, 0))
    seqs = defaultdict(list)
    for r in got:
        assert any(r.start == r.piece * 64 and r.length == min(64, len(x) - r.start) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + 64].tobytes()) for x in texts[r.doc_id])
        seqs[r.sequence_id].append((r.offset, r.length))
    assert len(got) == sum(-(-len(x) // 64) for xs in texts.values() for x in xs)
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(seqs) == best_fit_bins([r.length for r in got], 64)


def test_packing_nothing(empty):
    assert best_fit_pack(empty, word_bpe()).count() == 0


def test_record_files_round_trip(spark, edge, empty):
    got = records_io.token_records(edge, word_bpe()).collect()
    rows = sorted(edge.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r.doc_id for r in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, len(x), zlib.crc32(x.tobytes())) for r in rows for x in [ids_of(r.text, 2)])
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    assert records_io.token_records(empty, word_bpe()).count() == 0


def test_shuffled_reads_and_damage(spark, edge):
    path = scratch_path(spark, "records-test")
    records_io.write_records(edge, word_bpe(), path, file_bytes=2000)
    index = records_io.index_records(spark, path).cache()
    some = index.filter("doc_id % 3 = 1")
    read = {r.doc_id: r.ids for r in records_io.read_records(spark, path, some).collect()}
    texts = {r.doc_id: r.text for r in edge.collect()}
    assert set(read) == {1, 4, 7, 10, 13, 16} and all(read[i] == ids_of(texts[i], 2).tolist() for i in read)
    good = records_io.frame(5, np.array([1, 2, 70000], np.uint32)) + b"\n"
    assert records_io.parse(good)[1].tolist() == [1, 2, 70000]
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records_io.parse(bytes(bad))
    with pytest.raises(ValueError):
        records_io.parse(good[:-1])


def test_shards(spark, edge, empty):
    def laws(df, shards):
        rows, got = df.select("doc_id", "text").collect(), kd_shards(df, shards, ranked_rows=10).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len(b) + 16, zlib.crc32(b)) for r in rows for b in [(r.text or "").encode()])
        slots, sizes = defaultdict(list), Counter()
        for r in got:
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
            slots[r.shard].append(r.slot)
            sizes[r.shard] += r.size
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        return sizes

    laws(edge, 5)
    assert kd_shards(empty, 5).count() == 0
    r = random.Random(2)
    many = spark.createDataFrame([(i, "x" * r.randint(0, 400) if i % 3 else "hot " * 20, r.choice(["en", "de"]), f"s{i % 5}") for i in range(4000)], "doc_id long, text string, lang string, source string")
    sizes = laws(many, 7)
    assert len(sizes) == 7 and max(sizes.values()) <= 1.05 * min(sizes.values())


def test_ids_by_piece_equal_the_librarys_for_every_plain_character():
    """Every character that goes by pieces, in words, between digits and marks."""
    import random

    from coordspark.llm import tokens

    enc, r = tokens.Encoder(tokens.word_bpe()), random.Random(7)
    texts = [f"{chr(c)}a{chr(c)}{chr(c)}1 {chr(c)}'s{chr(c)}" for c in range(9, 0x250)]
    texts += ["".join(r.choice("abAB'stredlvLL019.,!_-\t\n ª²µßÉÿŉǅ½<|endoftxt>") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    want = [enc.whole.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in enc.ids(texts)] == want
