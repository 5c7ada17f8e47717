"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

1. Words are counted with DataFrame functions (``word_counts``); the vocabulary is a table in the shared folder.
2. Each length of word has its own blocked Bloom filter, cut by the words' hashes into parts of about ``part``
   words: 16 bits a word, six of them in one block of 512. Parts are built by Spark, one group each. They are broadcast
   in passes of at most ``most_bytes``, so what is shipped at once is bounded however large the vocabulary.
3. Edits are generated as hashes only, from sums over the letters: a word's deletions are looked up in the filter
   of the next shorter length, its replacements by a later letter of the vocabulary's alphabet in its own. An
   insertion is the deletion of the longer word, and a replacement by an earlier letter that of the
   other word, so every pair is generated exactly once.
4. Only edits that a filter holds are spelled out and shuffled to a join with the vocabulary on the word itself,
   which drops the false positives; what is left are the near pairs.
5. Each word's form is its near word of largest count; roots come from pointer jumping over the forms, whose
   counts at least double with every step, so chains are short.

Defined results: a null text has no word; a null doc_id reads as empty text before the colon; repeated rows count
each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import batch, doc_texts, written
from coordspark.llm.words import BYTE, MUL, mix

#: Letters are A-Z, a-z and U+00C0 to U+00FF, so a letter is one byte of Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a filter for each word, of a block, and probes of a word.
BITS, BLOCK, PROBES = 16, 512, 6
#: Hashes of generated edits held at once.
TILE = 1 << 20
_INVERSE = np.uint64(pow(int(MUL[0]), -1, 1 << 64))


def ascii_lower(c: Column) -> Column:
    """Only A-Z in lower case; texts that have no upper case at all skip the letter by letter translation."""
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, UPPER, LOWER))


def word_counts(docs: DataFrame, points: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """(word, n): runs of letters in lower case, one letter of them deleted where ``every`` divides the checksum of
    document and run; only words of at least ``points`` letters and ``least`` occurrences."""
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{points},}}"), F.lit(0))  # shorter runs give no word
    run = doc_texts(docs).select("doc_id", F.explode(found).alias("run")).withColumn("run", ascii_lower(F.col("run")))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    run = run.withColumn("h", F.crc32(key.cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = run.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.filter(F.length("word") >= points).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _terms(letters: np.ndarray) -> np.ndarray:
    """The term of every letter of words of one length; a word's hash is their sum."""
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(letters.shape[1] - 1, MUL[0], np.uint64)]))
    return BYTE[letters] * power


def _letters(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _by_length(col: pa.Array) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(length, rows, words in Latin-1) of each length of a batch of words."""
    words = [w.encode("latin-1") for w in col.to_pylist()]
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield int(n), rows, [words[r] for r in rows]


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, size = np.zeros(len(b), np.uint64), np.zeros(len(b), np.int32)
        for n, rows, words in _by_length(b["word"]):
            h[rows], size[rows] = mix(_terms(_letters(words)).sum(1, dtype=np.uint64)), n
        yield batch(word=b["word"], n=b["n"], size=size, h=h.view(np.int64))


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each mixed hash, and the hash that its bits are taken from."""
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), mix(h)


def _bit(m: np.ndarray, k: int) -> np.ndarray:
    return ((m >> np.uint64(9 * k)) & np.uint64(BLOCK - 1)).astype(np.int64)


def make_filter(h: np.ndarray) -> np.ndarray:
    """The blocked Bloom filter of mixed hashes: one row of eight 64-bit words a block."""
    blocks = max(1, -(-len(h) * BITS // BLOCK))
    out = np.zeros(blocks * 8, np.uint64)
    at, m = _places(h, blocks)
    for k in range(PROBES):
        bit = _bit(m, k)
        np.bitwise_or.at(out, at * 8 + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def holds(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of the hashes that the filter holds, bit after bit on those that are left."""
    left = np.arange(len(h))
    at, m = _places(h, len(bloom) // 8)
    for k in range(PROBES):
        bit = _bit(m, k)
        ok = (bloom[at * 8 + (bit >> 6)] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        left, at, m = left[ok], at[ok], m[ok]
    return left


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)


def _build(t: pa.Table) -> pa.Table:
    return pa.table({"size": t["size"][:1], "part": t["part"][:1], "bloom": pa.array([make_filter(t["h"].to_numpy().view(np.uint64)).tobytes()], pa.binary())})


def _probe(shipped, alphabet: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edits of the words that a filter of this pass holds, spelled out: (edit, word, n)."""
    letter = np.array(alphabet, np.uint8)

    def check(h: np.ndarray, parts: int, blooms: dict[int, np.ndarray]) -> np.ndarray:
        hit, of = [], part_of(h, parts) if parts > 1 else None
        for p, bloom in blooms.items():
            mine = np.arange(len(h)) if of is None else np.flatnonzero(of == p)
            hit.append(mine[holds(bloom, h[mine])])
        return np.concatenate(hit)

    def edits(words: list[bytes], size: int, filters: dict) -> Iterator[tuple[int, bytes]]:
        at = _letters(words)
        t = _terms(at)
        total = t.sum(1, dtype=np.uint64)[:, None]
        if size - 1 in filters:
            upto = np.cumsum(t, axis=1, dtype=np.uint64)
            h = mix((upto - t) + (total - upto) * _INVERSE)
            new = np.ones(at.shape, bool)
            new[:, 1:] = at[:, 1:] != at[:, :-1]  # of equal letters in a row the first is deleted
            r, d = np.nonzero(new)
            hit = check(h[r, d], *filters[size - 1])
            for i, k in zip(r[hit], d[hit], strict=True):
                yield i, words[i][:k] + words[i][k + 1 :]
        if size in filters:
            power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, MUL[0], np.uint64)]))
            for c in letter:
                r, d = np.nonzero(at < c)
                hit = check(mix(total[r, 0] + (BYTE[c] - BYTE[at[r, d]]) * power[d]), *filters[size])
                for i, k in zip(r[hit], d[hit], strict=True):
                    yield i, words[i][:k] + bytes([c]) + words[i][k + 1 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {size: (parts, {p: np.frombuffer(b, np.uint64) for p, b in blooms.items()}) for size, (parts, blooms) in shipped.value.items()}
        for b in batches:
            n = b["n"].to_numpy()
            for size, rows, words in _by_length(b["word"]):
                step = max(1, TILE // size)
                for lo in range(0, len(words), step):
                    some = words[lo : lo + step]
                    out = list(edits(some, size, filters))
                    at = np.array([i for i, _ in out], np.int64)
                    yield batch(edit=pa.array([e.decode("latin-1") for _, e in out], pa.string()), word=pa.array([some[i].decode("latin-1") for i in at], pa.string()), n=n[rows[lo + at]] if len(at) else np.zeros(0, np.int64))

    return run


class Vocabulary:
    """The words of a table (word, n) with the near pairs among them."""

    def __init__(self, counts: DataFrame, part: int = 1 << 16, most_bytes: int = 64 << 20) -> None:
        self.words = written(counts.mapInArrow(_hash, "word string, n long, size int, h long"), "spelling-words")
        self.spark, self.part, self.most_bytes = counts.sparkSession, part, most_bytes

    def filters(self) -> DataFrame:
        """(size, parts, part, bloom): the filters of all lengths, part by part."""
        parts = self.words.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / self.part).alias("parts"))
        parts = F.broadcast(parts)  # distinct lengths: L of them need 3 L^2 / 2 letters of text, so their number grows with its root
        dealt = self.words.join(parts, "size").select("size", "h", "parts", (F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)) % F.col("parts")).alias("part"))
        return dealt.select("size", "h", "part").groupBy("size", "part").applyInArrow(_build, "size int, part long, bloom binary").join(parts, "size")

    def passes(self, filters: DataFrame) -> Iterator[dict]:
        """The filters as {length: (parts, {part: bytes})}, so many at a time as fit ``most_bytes``."""
        now, held = {}, 0
        for r in filters.orderBy("size", "part").toLocalIterator():
            if held and held + len(r["bloom"]) > self.most_bytes:
                yield now
                now, held = {}, 0
            now.setdefault(r["size"], (int(r["parts"]), {}))[1][r["part"]] = bytes(r["bloom"])
            held += len(r["bloom"])
        if held:
            yield now

    def near(self) -> DataFrame:
        """(word, n, near, near_n): every pair of near words, both ways round."""
        letters = self.words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
        alphabet = sorted(ord(r["c"]) for r in letters.collect())  # 90 letters at most
        found = None
        for some in self.passes(written(self.filters(), "spelling-filters")):
            sizes = sorted({s for size in some for s in (size, size + 1)})
            asks = self.words.filter(F.col("size").isin(sizes)).select("word", "n")
            hits = asks.mapInArrow(_probe(self.spark.sparkContext.broadcast(some), alphabet), "edit string, word string, n long")
            pairs = hits.join(self.words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
            pairs = written(pairs, "spelling-pairs")
            found = pairs if found is None else found.union(pairs)
        if found is None:
            found = self.spark.createDataFrame([], "edit string, word string, n long, edit_n long")
        there = found.select("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n"))
        return there.union(found.select(F.col("edit"), F.col("edit_n"), F.col("word"), F.col("n")))

    def groups(self) -> DataFrame:
        """(word, n, n_near, form, form_n, root) of every word."""
        best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("b")
        near = self.near().groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
        likelier = -F.col("b.less") >= 2 * F.col("n")
        near = written(near.select("word", "n_near", F.when(likelier, F.col("b.form")).alias("form"), F.when(likelier, -F.col("b.less")).alias("form_n")), "spelling-forms")
        roots = roots_of(near.filter("form IS NOT NULL").select("word", "form"))
        out = self.words.select("word", "n").join(near, "word", "left").join(roots, "word", "left")
        return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of (word, form), acyclic, to the last, by pointer jumping."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not after.filter("moved").take(1):
            return after.select("word", "root")
        at = after.select("word", "root")


def spelling_groups(docs: DataFrame, **params: int) -> DataFrame:
    """The words of ``docs`` with their forms and roots; ``params`` as in Vocabulary."""
    return Vocabulary(word_counts(docs), **params).groups()
