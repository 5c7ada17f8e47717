"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Every training text is cut into overlapping passages (windows of twice the longest item's words, moved on by
that item's length, so that a copy of an item lies whole in some passage). Each passage is a query:

Words are compared in lower case.

1. An item's score is BM25 over the distinct words that it shares with the passage, divided by the score
   that the item's own text would have; so one threshold serves items of any length.
2. The index keeps, for each word and each block of ``per_block`` items, the largest contribution to any
   item of the block. A passage whose sum of these bounds stays below the threshold skips the whole block;
   only passages that can reach it have the block's postings read and scored.
3. Pairs above the threshold are verified on 5-word shingles: the passage must hold at least ``percent``
   hundredths of the shingles of the item's question part and of its answer part. The answer part is
   what follows the last question mark, or else the second half of the words.

The index goes to the tasks in slabs of at most ``slab`` items (the bound of what is shipped); a larger
benchmark takes several passes over the texts.

Defined results: null or empty texts and items match nothing; equal items each match; repeated doc_ids
give the best match of any of their rows; null doc_ids are reported as null. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import batch, blocks, doc_texts, utf8, written
from coordspark.llm.words import ALNUM, comb, mix, words

SHINGLE = 5


def _shingles(h: np.ndarray) -> np.ndarray:
    """The shingles of a row of word hashes, in order; with fewer words the whole row is one."""
    if not len(h):
        return h
    n = min(SHINGLE, len(h))
    a = h[: len(h) - n + 1]
    for k in range(1, n):
        a = comb(a, h[k : len(h) - n + 1 + k], k)
    return mix(a)


class ItemIndex:
    """The inverted index of some items, with block maxima. ``counts`` and ``stats`` tell of all items where this
    index holds some of them: {word hash: items with it}, and (items with a word, their mean length, the greatest)."""

    def __init__(self, ids: list[int | None], texts: list[str | None], counts: dict[int, int] | None = None, stats: tuple[int, float, int] | None = None,
                 per_block: int = 8, k1: float = 1.2, b: float = 0.75) -> None:
        data, off = utf8(pa.array(texts, pa.string()))
        h, row, start, _ = words(data, off, ALNUM)
        n = np.bincount(row, minlength=len(ids))
        order = np.argsort(n, kind="stable")  # items of like length lie in one block
        order = order[n[order] > 0]
        total, mean, longest = stats or (len(order), n[order].mean() if len(order) else 1.0, int(n.max(initial=0)))
        self.ids, self.parts, self.longest = [ids[i] for i in order], [], longest
        self.terms, term = np.unique(h, return_inverse=True)
        df = np.bincount(np.unique(term * len(ids) + row) // max(1, len(ids)), minlength=len(self.terms))
        df = df if counts is None else np.array([counts[t] for t in self.terms.view(np.int64).tolist()], float)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        self.blocks = []
        for lo in range(0, len(order), per_block):
            weight = np.zeros((len(self.terms), min(per_block, len(order) - lo)), np.float32)
            for k, i in enumerate(order[lo : lo + per_block]):
                mine = row == i
                t, tf = np.unique(term[mine], return_counts=True)
                w = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[i] / mean))
                weight[t, k] = w / w.sum()
                mark = data[off[i] : off[i + 1]].tobytes().rfind(b"?")
                cut = int(np.searchsorted(start[mine] - off[i], mark)) if mark >= 0 else n[i] // 2
                cut = cut if 0 < cut < n[i] else n[i] // 2
                hs = h[mine]
                self.parts.append(tuple(np.unique(_shingles(x)) for x in (hs[:cut], hs[cut:])))
            used = np.flatnonzero(weight.any(1))
            self.blocks.append((lo, used, weight[used], weight[used].max(1)))

    def search(self, term: np.ndarray, passage: np.ndarray, passages: int, least: float) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) of all pairs of at least ``least``, for distinct (term, passage) pairs in passage order."""
        place = np.full(len(self.terms), -1)
        for lo, used, weight, top in self.blocks:
            place[used] = np.arange(len(used))
            at = place[term]
            place[used] = -1
            mine = at >= 0
            t, p = at[mine], passage[mine]
            bound = np.bincount(p, weights=top[t], minlength=passages)
            open_ = bound >= least - 1e-6
            if not open_.any():
                continue
            keep = open_[p]
            t, p = t[keep], p[keep]
            first = np.flatnonzero(np.diff(p, prepend=-1))
            score = np.add.reduceat(weight[t], first, axis=0)
            for r, k in zip(*np.nonzero(score >= least - 1e-6), strict=True):
                yield int(p[first[r]]), lo + int(k), float(score[r, k])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slab, item, n, h): the distinct words of each item, with a number of its own and its length."""
    for b in batches:
        data, off = utf8(b["text"])
        h, row, _, _ = words(data, off, ALNUM)
        n = np.bincount(row, minlength=len(b))
        pairs = np.unique(np.stack([row.astype(np.uint64), h], 1), axis=0)
        r = pairs[:, 0].astype(np.int64)
        yield batch(slab=b["slab"].take(pa.array(r)), item=b["number"].take(pa.array(r)), n=n[r].astype(np.int32), h=np.ascontiguousarray(pairs[:, 1]).view(np.int64))


def _match(index: ItemIndex, least: float, percent: int):
    step = max(1, index.longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b["text"])
            for i, j in blocks(off):
                h, row, _, _ = words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)
                if not len(h) or not len(index.terms):
                    continue
                begin = np.searchsorted(row, np.arange(j - i + 1))
                nth = np.arange(len(h)) - begin[row]
                of_row = -(-np.diff(begin) // step)
                base = np.cumsum(of_row) - of_row
                k = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
                known = np.flatnonzero(index.terms[k] == h)
                p = base[row[known]] + nth[known] // step
                again = nth[known] >= step  # a word lies in its own window and in the one before
                key = np.unique(np.concatenate([p, p[again] - 1]) * len(index.terms) + np.concatenate([k[known], k[known][again]]))
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for passage, item, score in index.search(key % len(index.terms), key // len(index.terms), int(of_row.sum()), least):
                    r = int(np.searchsorted(base, passage, "right")) - 1
                    while of_row[r] == 0:
                        r -= 1
                    at = begin[r] + (passage - base[r]) * step
                    held = h[at : min(at + 2 * step, begin[r + 1])]
                    # an item of one word has no question; a part without words is held by all
                    part = [np.isin(x, _part_shingles(held, x), assume_unique=False).mean() if len(x) else 1.0 for x in index.parts[item]]
                    if min(part) * 100 >= percent and (score, *part) > best.get((r, item), (0.0,)):
                        best[r, item] = (score, *map(float, part))
                if best:
                    docs = b["doc_id"].slice(i, j - i)
                    yield batch(
                        doc_id=docs.take(pa.array([r for r, _ in best])), item_id=pa.array([index.ids[x] for _, x in best], pa.int64()),
                        score=[v[0] for v in best.values()], question_overlap=[v[1] for v in best.values()], answer_overlap=[v[2] for v in best.values()],
                    )

    return run


def _part_shingles(held: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The passage's shingles; a part of under five words is one shorter shingle, looked for at each length."""
    found = [_shingles(held)]
    if len(part) == 1:
        for n in range(1, min(SHINGLE, len(held) + 1)):
            a = held[: len(held) - n + 1]
            for k in range(1, n):
                a = comb(a, held[k : len(held) - n + 1 + k], k)
            found.append(mix(a))
    return np.concatenate(found)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, percent: int = 75, slab: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every document and item that it holds."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found, texts, slabs = None, doc_texts(docs).withColumn("text", F.lower("text")), items.count() // slab + 1
    items = items.withColumn("slab", F.pmod(F.xxhash64("item_id", "text"), F.lit(slabs)))
    # Frequencies and lengths are those of all items, so scores don't depend on the slabs.
    terms = written(items.withColumn("number", F.monotonically_increasing_id()).mapInArrow(_item_terms, "slab long, item long, n int, h long"), "bm25-terms")
    counts = written(terms.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "bm25-counts")
    of = terms.select("slab", "item", "n").distinct().agg(F.count(F.lit(1)).alias("c"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    stats = (int(of["c"]), float(of["mean"] or 1.0), int(of["longest"] or 0))
    for k in range(slabs):
        rows = items.filter(F.col("slab") == k).orderBy("item_id", "text").collect()  # about ``slab`` items
        df = counts.join(terms.filter(F.col("slab") == k).select("h").distinct(), "h").toArrow()  # their words
        own = dict(zip(df["h"].to_pylist(), df["df"].to_pylist(), strict=True))
        got = texts.mapInArrow(_match(ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], own, stats), least, percent), schema)
        found = got if found is None else found.union(got)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"))
