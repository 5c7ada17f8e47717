"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A suffix array of a batch of texts sorts the places where a string may begin. Only sampled places are kept:
in every ``LENGTH``-byte string the 24-byte word with the smallest hash is its anchor, so equal strings
have equal anchors at the same place in them, and about one byte in 14 is an anchor. A suffix array is
therefore the sorted anchor words of a batch, with the chunk (a group of documents) each one lies in.

The family: every new batch gets its array, which is merge-scanned against the arrays of all levels, and
put in as a level of size 1; two levels of one size are merged into one of twice the size. So an
anchor is merged a logarithmic number of times, and a batch meets a logarithmic number of levels. Arrays
are dealt by ranges of the words, and a range's arrays are merged in one task.

The scan tells each chunk which of its anchors occur in another document. What these stand for is then
compared in full, again by exchanging sorted arrays between chunks and ranges:

1. An anchor's class is everything that the strings it stands for cover, up to 76 bytes. Of the documents
   with a word in one class, those with a larger doc_id than the smallest lose all its strings.
2. Where a word has several classes, as at the ends of a repeated passage, the strings of each class's
   smallest document (and of chunks that hold several classes) are compared one by one.

Chunks send one entry per word, class or string however many of their documents hold it, so a passage
that a third of all documents share costs one entry per chunk, not per document. Strings are told apart by
96 bits of hash or more: those of the whole and of the anchor word.

Defined results: null is an empty text; texts shorter than ``LENGTH`` lose nothing; documents with equal
doc_ids don't take from each other; null doc_ids count as larger than all others (and equal to each other). An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import doc_texts, drop_folder, in_groups, pack, save, text_size, unpack, utf8, written
from coordspark.llm.words import MUL, comb, mix
from coordspark.session import scratch_path

LENGTH, WORD = 50, 24
WINDOW = LENGTH - WORD + 1
_LAST = np.iinfo(np.int64).max
_ARRAY = "range int, chunk int, keys binary, many binary"
_SCAN = "kind int, range int, chunk int, keys binary, chunks binary"
_ENTRY = "kind int, range int, chunk int, a binary, b binary, doc binary"


def _slide(x: np.ndarray, width: int, of) -> np.ndarray:
    """The minimum or maximum of every ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = of(x[:-done], x[done:])
        done *= 2
    return of(x[: -(width - done)], x[width - done :]) if done < width else x


def _hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the ``WORD`` bytes that begin at each place, taken eight at a time; its upper half is mixed best."""
    x = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()
    h = x[:-16] * MUL[0]
    h ^= h >> np.uint64(32)
    h += x[8:-8]
    h *= MUL[1]
    h ^= h >> np.uint64(32)
    h += x[16:]
    h ^= h >> np.uint64(29)
    h *= MUL[2]
    return h


class _Block:
    """Some texts' anchors: hash and place of each, and the hashes of strings."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.h, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.rank = self.low = np.zeros(0, np.uint32)
        if len(data) < LENGTH:
            return
        self.h = _hashes(np.ascontiguousarray(data))
        self.rank = (self.h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # never 0
        self.low = _slide(self.rank, WINDOW, np.minimum)  # of each string, the smallest rank of its words
        last = np.minimum(np.diff(off), LENGTH - 1)  # a text's last places, where strings would cross its end
        cross = np.repeat(off[1:] - np.cumsum(last), last) + np.arange(last.sum())
        self.low[cross[cross < len(self.low)]] = 0
        edge = np.zeros(WINDOW - 1, np.uint32)
        self.at = np.flatnonzero(_slide(np.concatenate([edge, self.low, edge]), WINDOW, np.maximum) == self.rank)

    def strings(self, p: np.ndarray) -> np.ndarray:
        """The hash of the whole string that begins at each place."""
        a = comb(self.h[p], self.h[p + WORD], 4)
        return comb(a, self.h[p + LENGTH - WORD], 5)

    def span(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last of the strings that each anchor stands for."""
        p = at[:, None] - np.arange(WINDOW - 1, -1, -1)[None, :]
        ok = (p >= 0) & (p < len(self.low))
        ok &= self.low[np.clip(p, 0, len(self.low) - 1)] == self.rank[at][:, None]
        first = at - WINDOW + 1 + ok.argmax(1)
        return first, first + ok.sum(1) - 1


class _Chunk:
    """The texts of one chunk, in blocks of about ``most`` bytes."""

    def __init__(self, t: pa.Table, most: int = 1 << 18) -> None:
        self.table, self.most = t, most
        self.data, self.off = utf8(t["text"])
        self.ids = pc.fill_null(t["doc_id"], _LAST).to_numpy().astype(np.int64)

    def blocks(self) -> Iterator[tuple[_Block, np.ndarray, np.ndarray, int]]:
        """(block, word and doc_id at each anchor, the block's place in the chunk). Anchors have small hashes, as
        they are sampled by them; a word goes by its hash mixed again, so that ranges of words are even."""
        i = 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.off, self.off[i] + self.most, "right")) - 1)
            off = self.off[i : j + 1] - self.off[i]
            b = _Block(self.data[self.off[i] : self.off[j]], off)
            yield b, mix(b.h[b.at]), self.ids[i + np.searchsorted(off, b.at, "right") - 1], int(self.off[i])
            i = j

    def classes(self, needed: np.ndarray) -> Iterator[tuple[_Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Of the anchors with a needed word: (block, word, class, doc_id, first and last string, place)."""
        for b, word, doc, base in self.blocks():
            keep = _in(needed, word)
            at = b.at[keep]
            first, last = b.span(at)
            c = comb(b.strings(first), b.strings(last), 1) if len(at) else at.astype(np.uint64)
            c = comb(c, ((last - first) * 64 + (at - first)).astype(np.uint64), 2)
            yield b, word[keep], c, doc[keep], first, last, base


def _in(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _cat(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _least(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first of each (a, b) in sorted order, the smallest doc among its equals for every entry)."""
    if not len(a):
        return np.zeros(0, np.int64), doc
    order = np.lexsort((doc, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.empty_like(doc)
    out[order] = doc[order][new][np.cumsum(new) - 1]
    return order[new], out


def _ranges(sorted_keys: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """The ranges of words that occur, with their slices."""
    r = ((sorted_keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(r)) + 1
    edges = np.concatenate([[0], cut, [len(r)]]) if len(r) else np.zeros(1, np.int64)
    return [(int(r[s]), slice(int(s), int(e))) for s, e in zip(edges[:-1], edges[1:], strict=True)]


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], kinds[t]) for k, (n, t) in enumerate(fields)})


def _array(ranges: int):
    """The suffix array of a chunk: its anchor words, sorted, and whether two of its documents hold them."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        words, docs = [], []
        for _, word, doc, _ in _Chunk(t).blocks():
            words.append(word)
            docs.append(doc)
        w, d = _cat(words), _cat(docs, np.int64)
        order = np.argsort(w, kind="stable")
        w, d = w[order], d[order]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
        many = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) if len(first) else np.zeros(0, bool)
        w, chunk = w[first], int(key[0].as_py())
        return _rows(_ARRAY, [(r, chunk, pack(w[s]), np.packbits(many[s]).tobytes()) for r, s in _ranges(w, ranges)])

    return run


def _merge_scan(merging: frozenset[int]):
    """In one range: scan the batch's array against the levels, and merge it with those of ``merging``."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        for level, chunk, keys, more in zip(*(t[c].to_pylist() for c in ("level", "chunk", "keys", "more")), strict=True):
            w = unpack(keys)
            if level:
                levels.append((level, w, np.frombuffer(more, np.int32)))
            else:
                new.append((w, np.full(len(w), chunk, np.int32), np.unpackbits(np.frombuffer(more, np.uint8), count=len(w)).astype(bool)))
        w, chunk, many = (_cat([x[k] for x in new], kind) for k, kind in enumerate((np.uint64, np.int32, bool)))
        order = np.argsort(w, kind="stable")
        w, chunk, many = w[order], chunk[order], many[order]
        needed = many.copy()
        same = w[1:] == w[:-1]
        needed[1:] |= same
        needed[:-1] |= same
        hits = [(chunk[:0], w[:0])]
        for _, old, old_chunk in levels:
            needed |= _in(old, w)
            met = _in(w, old)
            hits.append((old_chunk[met], old[met]))
        needed |= _in(np.unique(w[many]), w)
        hits.append((chunk[needed], w[needed]))
        c, k = _cat([x[0] for x in hits], np.int32), _cat([x[1] for x in hits])
        order = np.lexsort((k, c))
        c, k = c[order], k[order]
        edges = np.r_[np.flatnonzero(np.r_[True, c[1:] != c[:-1]]), len(c)] if len(c) else np.zeros(1, np.int64)
        out = [(0, None, int(c[s]), pack(np.unique(k[s:e])), None) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        merged = [(w, chunk), *((o, oc) for level, o, oc in levels if level in merging)]
        mw, mc = _cat([x[0] for x in merged]), _cat([x[1] for x in merged], np.int32)
        order = np.argsort(mw, kind="stable")
        out.append((1, int(key[0].as_py()), None, pack(mw[order]), mc[order].tobytes()))
        return _rows(_SCAN, out)

    return run


class SuffixFamily:
    """The levels: their sizes in batches, each with the folder of its array."""

    def __init__(self, spark, ranges: int) -> None:
        self.spark, self.ranges, self.path, self.levels, self.hits, self.n = spark, ranges, scratch_path(spark, "suffix-family"), {}, [], 0

    def add(self, batch: DataFrame) -> None:
        """Make the array of a batch (doc_id, text, chunk), scan it against all levels and take it in."""
        array = batch.groupBy("chunk").applyInArrow(_array(self.ranges), _ARRAY)
        size, merging = 1, set()
        while size in self.levels:
            merging.add(size)
            size *= 2
        rows = array.select("range", F.lit(0).alias("level"), "chunk", "keys", F.col("many").alias("more"))
        for level, path in self.levels.items():
            rows = rows.union(self._read(path, 1).select("range", F.lit(level), F.lit(0), "keys", "chunks"))
        self.n += 1
        path = f"{self.path}/{self.n}"
        save(rows.groupBy("range").applyInArrow(_merge_scan(frozenset(merging)), _SCAN), path, "kind")
        self.hits.append(path)
        for level in merging:  # the merged level holds them; their hits stay
            drop_folder(self.spark, f"{self.levels.pop(level)}/kind=1")
        self.levels[size] = path

    def _read(self, path: str, kind: int) -> DataFrame:
        return self.spark.read.schema(_SCAN).parquet(path).filter(F.col("kind") == kind)

    def found(self) -> DataFrame:
        """(chunk, keys): the words of each chunk that another document has too."""
        out = None
        for path in self.hits:
            got = self._read(path, 0).select("chunk", "keys")
            out = got if out is None else out.union(got)
        return out


def _needed(replies: pa.Table) -> np.ndarray:
    return np.unique(_cat([unpack(k) for kind, k in zip(replies["kind"].to_pylist(), replies["a"].to_pylist(), strict=True) if kind == 0]))


def _got(replies: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, doc_id) of the entries of a kind."""
    mine = [(a, b, d) for k, a, b, d in zip(*(replies[c].to_pylist() for c in ("kind", "a", "b", "doc")), strict=True) if k == kind]
    return _cat([unpack(a) for a, _, _ in mine]), _cat([np.frombuffer(b, "<u4") for _, b, _ in mine], np.uint32), _cat([np.frombuffer(d, "<i8") for _, _, d in mine], np.int64)


def _send_classes(ranges: int):
    """Kind 1: a word with its class and the smallest doc_id. Kind 2: a word that has several classes here."""

    def run(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        got = [x[1:4] for x in _Chunk(docs).classes(_needed(replies))]
        w, c, d = (_cat([x[k] for x in got], kind) for k, kind in enumerate((np.uint64, np.uint64, np.int64)))
        chunk, out = int(key[0].as_py()), []
        if len(w):
            order = np.argsort(w, kind="stable")
            w, c, d = w[order], c[order], d[order]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            one = np.minimum.reduceat(c, first) == np.maximum.reduceat(c, first)
            low = np.minimum.reduceat(d, first)[one]
            out = [(1, r, chunk, pack(w[first][one][s]), c[first][one][s].tobytes(), low[s].tobytes()) for r, s in _ranges(w[first][one], ranges)]
            out += [(2, r, chunk, pack(w[first][~one][s]), b"", b"") for r, s in _ranges(w[first][~one], ranges)]
        return _rows(_ENTRY, out)

    return run


def _send_strings(ranges: int):
    """Kind 3: a string and its word, of the words with several classes, with the smallest doc_id."""

    def run(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        mixed, parts = np.unique(_got(replies, 2)[0]), []
        if len(mixed):
            for b, w, _, d, first, last, _ in _Chunk(docs).classes(mixed):
                p, of = _every(first, last)
                parts.append((b.strings(p), (w >> np.uint64(32)).astype(np.uint32)[of], d[of]))
        a, w, d = (_cat([x[k] for x in parts], kind) for k, kind in enumerate((np.uint64, np.uint32, np.int64)))
        first, _ = _least(a, w, d)
        a, w, d = a[first], w[first], d[first]
        return _rows(_ENTRY, [(3, r, int(key[0].as_py()), pack(a[s]), w[s].tobytes(), d[s].tobytes()) for r, s in _ranges(a, ranges)])

    return run


def _every(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place from first to last of each anchor, and the anchor it is of."""
    n = last - first + 1
    of = np.repeat(np.arange(len(n)), n)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def _tell(kind: int, chunks: list[int], sizes: list[int], tell: np.ndarray, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> list[tuple]:
    """Back to each chunk, of the entries it sent, those to be told."""
    out, at = [], 0
    for chunk, n in zip(chunks, sizes, strict=True):
        s = slice(at, at + n)
        at += n
        if (mine := tell[s]).any():
            out.append((kind, None, chunk, pack(a[s][mine]), b[s][mine].tobytes(), doc[s][mine].tobytes()))
    return out


def _resolve_classes(t: pa.Table) -> pa.Table:
    """In one range: who is not the smallest of a word's class, and who must compare strings."""
    chunks, kinds = t["chunk"].to_pylist(), t["kind"].to_pylist()
    words = [unpack(x) for x in t["a"].to_pylist()]
    sizes = [len(x) for x in words]
    w, several = _cat(words), np.repeat(np.array(kinds) == 2, sizes)
    c, d = np.zeros(len(w), np.uint64), np.full(len(w), _LAST)
    c[~several] = _cat([np.frombuffer(x, "<u8") for x in t["b"].to_pylist()])
    d[~several] = _cat([np.frombuffer(x, "<i8") for x in t["doc"].to_pylist()], np.int64)
    if not len(w):
        return _rows(_ENTRY, [])
    order = np.argsort(w, kind="stable")
    new = np.r_[True, w[order][1:] != w[order][:-1]]
    first = np.flatnonzero(new)
    mixed = np.logical_or.reduceat(several[order], first) | (np.minimum.reduceat(c[order], first) != np.maximum.reduceat(c[order], first))
    group = np.empty(len(w), np.int64)
    group[order] = np.cumsum(new) - 1
    mixed, one = mixed[group], np.flatnonzero(~several)
    least = d.copy()
    least[one] = _least(w[one], c[one], d[one])[1]
    # Who isn't the smallest of a class loses all its strings; who is, or has several classes, compares strings.
    none = np.zeros(len(w), np.uint32)
    return _rows(_ENTRY, _tell(1, chunks, sizes, ~several & (least < d), w, none, least) + _tell(2, chunks, sizes, mixed & (several | (least == d)), w, none, least))


def _resolve_strings(t: pa.Table) -> pa.Table:
    """In one range: for every string a chunk sent, the smaller doc_id that another has."""
    strings = [unpack(x) for x in t["a"].to_pylist()]
    a, b, d = _cat(strings), _cat([np.frombuffer(x, "<u4") for x in t["b"].to_pylist()], np.uint32), _cat([np.frombuffer(x, "<i8") for x in t["doc"].to_pylist()], np.int64)
    _, least = _least(a, b, d)
    return _rows(_ENTRY, _tell(3, t["chunk"].to_pylist(), [len(x) for x in strings], least < d, a, b, least))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
    """The chunk's documents without the strings that smaller doc_ids have."""
    chunk = _Chunk(docs)
    data, off = chunk.data, chunk.off
    mark = np.zeros(len(data) + 1, np.int32)
    needed, mixed = _needed(replies), np.unique(_got(replies, 2)[0])
    whole, strings = [], []
    for b, w, _, d, first, last, base in chunk.classes(needed) if len(needed) else ():
        some = _in(mixed, w)
        whole.append((w[~some], d[~some], first[~some] + base, last[~some] + base))
        p, of = _every(first[some], last[some])
        strings.append((b.strings(p), (w[some] >> np.uint64(32)).astype(np.uint32)[of], d[some][of], p + base))
    a, _, d = _got(replies, 1)
    w, own, first, last = (_cat([x[k] for x in whole], kind) for k, kind in enumerate((np.uint64, np.int64, np.int64, np.int64)))
    _, least = _least(np.concatenate([w, a]), np.zeros(len(w) + len(a), np.uint32), np.concatenate([own, d]))
    gone = least[: len(w)] < own
    np.add.at(mark, first[gone], 1)
    np.add.at(mark, last[gone] + LENGTH, -1)
    a, b, d = _got(replies, 3)
    s, w, own, p = (_cat([x[k] for x in strings], kind) for k, kind in enumerate((np.uint64, np.uint32, np.int64, np.int64)))
    _, least = _least(np.concatenate([s, a]), np.concatenate([w, b]), np.concatenate([own, d]))
    gone = least[: len(p)] < own
    np.add.at(mark, p[gone], 1)
    np.add.at(mark, p[gone] + LENGTH, -1)
    removed = np.cumsum(mark)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(removed)])
    begin = removed.copy()
    begin[1:] &= ~removed[:-1]
    heads = off[:-1][(np.diff(off) > 0)]
    begin[heads] |= removed[heads]
    spans = np.concatenate([[0], np.cumsum(begin)])
    sha = []
    for i, j in zip(off[:-1], off[1:], strict=True):
        own = data[i:j]
        sha.append(hashlib.sha256((own[~removed[i:j]] if total[j] > total[i] else own).tobytes()).hexdigest())
    return pa.table({"doc_id": docs["doc_id"], "n_bytes": np.diff(off), "n_removed": total[off[1:]] - total[off[:-1]], "n_spans": spans[off[1:]] - spans[off[:-1]], "kept_sha256": pa.array(sha, pa.string())})


def remove_repeats(docs: DataFrame, batches: int = 4, chunk_bytes: int = 4 << 20, range_words: int = 1 << 17) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): every document without each byte that is covered by a
    ``LENGTH``-byte string which also starts in a document with a smaller doc_id.

    The family takes the documents in ``batches``; a task holds a chunk of about ``chunk_bytes`` (or one
    longer text), or a range of about ``range_words`` words of each array.
    """
    spark, rows = docs.sparkSession, doc_texts(docs)
    _, size = text_size(rows)
    chunks, ranges = size // chunk_bytes + 1, size // 14 // range_words + 1
    rows = rows.withColumn("chunk", in_groups("doc_id", chunks).cast("int"))
    family = SuffixFamily(spark, ranges)
    for k in range(batches):
        family.add(rows.filter(F.col("chunk") % batches == k))
    none = F.lit(None).cast("binary")
    known = family.found().select(F.lit(0).alias("kind"), F.lit(None).cast("int").alias("range"), "chunk", F.col("keys").alias("a"), none.alias("b"), none.alias("doc"))

    def exchange(replies: DataFrame, send, resolve) -> DataFrame:
        sent = rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(send, _ENTRY)
        return written(sent.groupBy("range").applyInArrow(resolve, _ENTRY), "suffix-replies")

    classes = exchange(known, _send_classes(ranges), _resolve_classes)
    strings = exchange(classes, _send_strings(ranges), _resolve_strings)
    return rows.groupBy("chunk").cogroup(known.union(classes).union(strings).groupBy("chunk")).applyInArrow(_remove, _RESULT)
