"""Toxicity by class-conditional Kneser-Ney models of word pairs.

For each class c (ordinary, toxic) of the labelled training documents, with the discount D:

    p_c(w | v) = max(n_c(v w) - D, 0) / n_c(v) + left_c(v) * p_c(w)
    p_c(w)     = max(cont_c(w) - D, 0) / conts_c + left_c * p_c(stem of w) * shared(w) / shared(stem of w)
    p_c(stem)  = max(cont_c(stem) - D, 0) / conts_c + left_c' * shared(stem)

cont_c(w) is the number of different words before w in class c, left is what the discounts leave over, and
shared(w) is w's share of the whole corpus, labelled or not; a stem is a word's first ``STEM`` bytes, so
that words of one family are known by each other. D is estimated for each level and class from how many
things have a count of 1 and of 2 there, n1 / (n1 + 2 n2), so that it lies between 0 and 1 and whatever
was seen once is evidence. A pair counts once for each document that holds it, however often it is repeated there.

Pairs are counted in every training document, however long (with ``most``: in that many of either class);
shared(w) is counted in every document. All counts are kept under the full 64-bit hashes of words, pairs and stems, with no slots to fill up.
The model is a table in the shared folder, dealt into buckets by those hashes; no task and no driver holds all of it. Documents
are gathered into blocks, a block asks each bucket once for what its texts hold, and the answers meet the texts again.
A word that neither class has seen has the same shared(w) in both, which cancels out.

Each word's log likelihood ratio, toxic to ordinary, given the word before it, is averaged over the text,
and over windows of ``window`` words, of which the largest counts, so that one toxic line in a long text
is seen; the same is done with p_c(w) alone, which copies of one passage don't sway, as they add no new
neighbours. A logistic curve fitted on training documents, both classes at equal weight, turns these into a score.

Defined results: null and empty texts have a ratio of 0 throughout; documents without a label, or with null
for one, aren't learned from; with labels of one class only, that class gets all. Repeated rows are scored
alike. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.llm.common import batch, blocks, doc_texts, drop_folder, pack, save, text_size, unpack, utf8, written
from coordspark.llm.learning import curve, fold, logistic, training_rows
from coordspark.llm.words import ALNUM, comb, mix, words
from coordspark.session import scratch_path

STEM = 4
#: What the model keeps, each kind in its own buckets: counts of pairs; of words what was seen after them, its cuts, their own
#: shares and shared(w); of stems their shares. Each kind's columns are all of 4 bytes.
PAIRS, WORDS, STEMS = range(3)
WIDTH, TYPE = (2, 7, 2), (np.uint32, np.float32, np.float32)
#: Bytes of text in a block; pairs of the model in a bucket, and bytes of the text that asks one.
BLOCK, BUCKET_PAIRS, BUCKET_TEXT = 1 << 21, 1_000_000, 1 << 24
#: Tables are scored in parts of this many bytes of text, in so many at most, so that only a part's questions lie on disk at a time.
PASS, MOST_PASSES = 1 << 26, 6


def _lower(docs: DataFrame) -> DataFrame:
    return doc_texts(docs).withColumn("text", F.lower("text"))


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash stands in the sorted keys; len(keys) if it isn't there."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    k[keys[k] != h] = len(keys)
    return k


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different hashes, sorted."""
    x = np.sort(x)
    return x[np.diff(x, prepend=~x[:1]) != 0]


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes, sorted; a place of each; and the number of each place's hash."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.diff(ordered, prepend=~ordered[:1]) != 0
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def _edges(ordered: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes, and the end; buckets are equal ranges of the hashes."""
    first = [-(-(b << 64) // buckets) for b in range(buckets)]
    return np.append(np.searchsorted(ordered, np.array(first, np.uint64)), len(ordered))


def _pairs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word with the one before it; the first word of a text follows 0."""
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    before[np.diff(row, prepend=-1) != 0] = 0
    return before, mix(comb(before, h))


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, stem) of the words of the rows, split in pieces that stay in the cache."""
    parts = [(*words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM, STEM), i) for i, j in blocks(off)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] + x[5] for x in parts]), np.concatenate([x[4] for x in parts])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, s, n): each word, its stem and how often it stands there; a task's words are summed before they leave."""

    def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        u, first, at = np.unique(np.concatenate([x[0] for x in parts]), return_index=True, return_inverse=True)
        return u, np.concatenate([x[1] for x in parts])[first], np.bincount(at, np.concatenate([x[2] for x in parts]), len(u)).astype(np.int64)

    def rows(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, s, n = summed(parts)
        for k in range(0, len(h), 1 << 16):
            to = slice(k, k + (1 << 16))
            yield batch(h=h[to].view(np.int64), s=s[to].view(np.int64), n=n[to])

    held, size = [], 0
    for b in batches:
        data, off = utf8(b["text"])
        for i, j in blocks(off):
            h, _, _, _, stem = words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM, STEM)
            held.append(summed([(h, stem, np.ones(len(h), np.int64))]))
            size += len(held[-1][0])
            if size > 1 << 20:
                held = [summed(held)]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield from rows(held)
                    held, size = [], 0
    if held:
        yield from rows(held)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, w, n0, n1): each pair, and how many documents of either class hold it."""
    for b in batches:
        data, off = utf8(b["text"])
        y = b["y"].to_numpy()
        for i, j in blocks(off, 1 << 22):
            h, row, _ = _tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            v, pair = _pairs(h, row)
            kinds, first, number = _numbered(pair)
            once = _distinct(number.astype(np.uint64) << np.uint64(32) | row.astype(np.uint64))  # pairs of each document
            at = (once >> np.uint64(32)).astype(np.int64)
            n1 = np.bincount(at, y[i:j][once & np.uint64(0xFFFFFFFF)], len(kinds)).astype(np.int64)
            n0 = np.bincount(at, minlength=len(kinds)) - n1
            v, w = v[first], h[first]
            o = np.argsort(v)
            for k in range(0, len(o), 1 << 16):
                to = o[k : k + (1 << 16)]
                yield batch(v=v[to].view(np.int64), w=w[to].view(np.int64), n0=n0[to], n1=n1[to])


def estimated(n1: float, n2: float) -> float:
    """The discount for a level where ``n1`` things have a count of 1 and ``n2`` one of 2."""
    return min(max(n1 / max(n1 + 2 * n2, 1), 0.05), 0.95)


def _planes(a: np.ndarray) -> bytes:
    """Rows of 4-byte values, byte plane by byte plane: what compresses lies together."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), 4 * a.shape[1]).T.tobytes()


def _unplanes(b: bytes, kind: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4 * WIDTH[kind], -1).T).view(TYPE[kind])


class KneserNey:
    """The two models, or as much of them as some texts need: sorted hashes of pairs, words and stems, and their
    values (one column more: of those not found)."""

    def __init__(self, fixed: dict, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """tables: of each kind, hashes in any order and a row of values for each."""
        self.cuts, self.word_left, self.window = fixed["cuts"], fixed["word_left"], fixed["window"]
        self.pairs, self.pair = self._table(*tables[PAIRS], [0, 0])
        self.words, word = self._table(*tables[WORDS], [0, 0, 0, 0, 0, 0, 1])  # of an unknown word any share will do
        self.seen, self.cut, self.word, self.shared = word[:2], word[2:4], word[4:6], word[6]
        self.stems, self.stem = self._table(*tables[STEMS], fixed["no_stem"])

    @staticmethod
    def _table(h: np.ndarray, values: np.ndarray, unknown: list) -> tuple[np.ndarray, np.ndarray]:
        if (h[1:] < h[:-1]).any():
            order = np.argsort(h)
            h, values = h[order], values[order]
        return h, np.ascontiguousarray(np.concatenate([values, np.array([unknown], values.dtype)]).T)

    def ratios(self, h: np.ndarray, row: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log p_toxic - log p_ordinary of each word: after the word before it, and by itself."""
        before, pair = _pairs(h, row)
        w = _find(self.words, h)
        below = self.below(w, _find(self.stems, stem))
        return self.after(_find(self.pairs, pair), _find(self.words, before), below), self.alone(below)

    def below(self, w: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
        """p_c(w) of words with these places in the tables."""
        return [self.word[c][w] + self.word_left[c] * self.stem[c][s] * self.shared[w] for c in (0, 1)]

    def after(self, p: np.ndarray, v: np.ndarray, below: list[np.ndarray]) -> np.ndarray:
        """The ratio of pairs with these places in the tables."""
        out = []
        for c in (0, 1):
            n = self.seen[c][v]
            some = n > 0
            n = np.where(some, n, 1)
            left = np.where(some, self.cut[c][v] / n, 1)
            out.append(np.log(np.where(some, np.maximum(self.pair[c][p].astype(np.float32) - self.cuts[c], 0) / n, 0) + left * below[c]))
        return out[1] - out[0]

    @staticmethod
    def alone(below: list[np.ndarray]) -> np.ndarray:
        return np.log(below[1]) - np.log(below[0])

    def features(self, row: np.ndarray, ratios: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
        """Of each text, after the words before and of words alone: the mean ratio, and the largest mean of a window."""
        out = np.zeros((rows, 4))
        if len(row):
            n = np.bincount(row, minlength=rows)
            some = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[some]
            end = np.minimum(np.arange(len(row)) + self.window, np.cumsum(n)[row])
            for k, r in enumerate(ratios):
                out[some, 2 * k] = np.add.reduceat(r.astype(np.float64), first) / n[some]
                total = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
                out[some, 2 * k + 1] = np.maximum.reduceat((total[end] - total[:-1]) / self.window, first)
        return out


def _stored(kind: int, buckets: int, *names: str):
    """Rows (h, or a pair's v and w; values) to (bucket, keys, vals): each bucket's hashes and values as they come, packed."""

    def packed(h: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        o = np.argsort(h)
        cut = _edges(h[o], buckets)
        some = [k for k in range(buckets) if cut[k] < cut[k + 1]]
        for x in range(0, len(some), 64):
            ours = [(k, o[cut[k] : cut[k + 1]]) for k in some[x : x + 64]]
            yield batch(bucket=np.array([kind * buckets + k for k, _ in ours], np.int32), keys=pa.array([pack(h[m]) for _, m in ours], pa.binary()), vals=pa.array([_planes(values[m]) for _, m in ours], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            h = b["h"].to_numpy().view(np.uint64) if kind != PAIRS else mix(comb(b["v"].to_numpy().view(np.uint64), b["w"].to_numpy().view(np.uint64)))
            held.append((h, np.stack([b[x].to_numpy() for x in names], 1).astype(TYPE[kind])))
            size += len(h)
            if size > 1 << 20:
                yield from packed(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield from packed(*map(np.concatenate, zip(*held)))

    return run


def _keys(distinct: list[np.ndarray], buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, where its part lies in the sorted hashes of its kind): what texts need of the model. The same for the same
    texts, as answers go by position."""
    for kind, x in enumerate(distinct):
        cut = _edges(x, buckets).tolist()
        for k in range(buckets):
            if cut[k] < cut[k + 1]:
                yield kind * buckets + k, slice(cut[k], cut[k + 1])


def _passes(size: int) -> int:
    return min(MOST_PASSES, size // PASS + 1)


class Model:
    """Where the models lie: a table (bucket, keys, vals) in the shared folder, and the few numbers that all words share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, fixed: dict) -> None:
        self.spark, self.path, self.buckets, self.fixed = spark, path, buckets, fixed

    def table(self) -> DataFrame:
        return self.spark.read.schema("bucket int, keys binary, vals binary").parquet(f"{self.path}/*")

    @property
    def value(self) -> KneserNey:
        """All of it in this process: to look at small models only."""
        rows = self.table().collect()
        return KneserNey(self.fixed, [_joined([(r["keys"], r["vals"]) for r in rows if r["bucket"] // self.buckets == kind], kind) for kind in range(3)])

    def features(self, docs: DataFrame, size: int, *carry: str) -> DataFrame:
        """The carried columns (doc_id among them) and f, the four features of ``text``; size: bytes of all the texts."""
        passes = _passes(size)
        count = max(1, -(-size // (passes * BLOCK)))
        texts = docs.select(*carry, "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).alias("_block"))
        to = scratch_path(self.spark, "toxic-features")
        schema = ", ".join(f"{x} {t}" for x, t in texts.select(*carry).dtypes)
        for k in range(passes):
            part = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(passes)) == k)
            asked = part.groupBy("_block").applyInArrow(_ask(self.buckets), "bucket int, block long, keys binary")
            answers = self.table().groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_answer(self.buckets), "block long, bucket int, found binary, vals binary")
            got = part.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(_features(self.fixed, self.buckets, carry), f"{schema}, f array<double>")
            save(got, f"{to}/part-{k}")
        return self.spark.read.schema(f"{schema}, f array<double>").parquet(f"{to}/*")


def _joined(rows: list[tuple[bytes, bytes]], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and values of packed rows."""
    keys = [unpack(k) for k, _ in rows]
    vals = [_unplanes(v, kind) for _, v in rows]
    return np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*vals, np.zeros((0, WIDTH[kind]), TYPE[kind])])


def _ask(buckets: int):
    """A block's texts to what it asks of each bucket."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        h, row, stem = _tokens(*utf8(texts["text"]))
        before, pair = _pairs(h, row)
        distinct = [_distinct(x) for x in (pair, np.append(h, before[:1]), stem)]
        asked = [(b, distinct[b // buckets][at]) for b, at in _keys(distinct, buckets)]
        return pa.table({"bucket": pa.array([b for b, _ in asked], pa.int32()), "block": pa.array([key[0].as_py()] * len(asked), pa.int64()), "keys": pa.array([pack(k) for _, k in asked], pa.binary())})

    return run


def _answer(buckets: int):
    """A bucket of the model, and what blocks ask of it, to which of the hashes are there (bits) and their values."""

    def run(key: tuple[pa.Scalar, ...], model: pa.Table, asked: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        h, values = _joined([*zip(model["keys"].to_pylist(), model["vals"].to_pylist())], bucket // buckets)
        order = np.argsort(h)
        h, values = h[order], values[order]
        found, vals = [], []
        for x in asked["keys"]:
            at = _find(h, unpack(x.as_py()))
            there = at < len(h)
            found.append(np.packbits(there).tobytes())
            vals.append(_planes(values[at[there]]))
        return pa.table({"block": asked["block"], "bucket": pa.array([bucket] * len(found), pa.int32()), "found": pa.array(found, pa.binary()), "vals": pa.array(vals, pa.binary())})

    return run


def _features(fixed: dict, buckets: int, carry: tuple[str, ...]):
    """A block's texts, and the answers to it, to the features of each text."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        h, row, stem = _tokens(*utf8(texts["text"]))
        before, pair = _pairs(h, row)
        pairs, at, number = _numbered(pair)  # ratios are worked out once for each of the block's pairs and words
        words, word_at, word_number = _numbered(np.append(h, before[:1]))
        stems, _, stem_number = _numbered(stem)
        distinct, got = [pairs, words, stems], {b: (f, v) for b, f, v in zip(*(answers[x].to_pylist() for x in ("bucket", "found", "vals")))}
        there, vals = [np.zeros(len(x), bool) for x in distinct], [[np.zeros((0, WIDTH[k]), TYPE[k])] for k in range(3)]
        for b, part in _keys(distinct, buckets):
            if b in got:
                there[b // buckets][part] = np.unpackbits(np.frombuffer(got[b][0], np.uint8), count=part.stop - part.start).astype(bool)
                vals[b // buckets].append(_unplanes(got[b][1], b // buckets))
        model = KneserNey(fixed, [(x[t], np.concatenate(v)) for x, t, v in zip(distinct, there, vals)])
        p, w, s = (np.where(t, np.cumsum(t) - 1, t.sum()) for t in there)
        f = np.zeros((len(texts), 4))
        if len(h):
            # a word's stem is that of any of its places; the start of a text (the last of the words asked) has none, and needs none
            below = model.below(w, s[np.append(stem_number, 0)[word_at]])
            before_number = np.append(word_number[-1:], word_number[: len(h) - 1])
            before_number[before == 0] = word_number[-1]
            after = model.after(p, w[before_number[at]], [x[word_number[at]] for x in below])
            f = model.features(row, (after[number], model.alone(below)[word_number[: len(h)]]), len(texts))
        return pa.table({**{c: texts[c] for c in carry}, "f": pa.FixedSizeListArray.from_arrays(pa.array(f.reshape(-1)), f.shape[1]).cast(pa.list_(pa.float64()))})

    return run


def _level(rows: DataFrame, discount: float | None) -> tuple[list[float], list[float], list[float]]:
    """For each class: the discount of cont, its sum, and what the discounts leave over."""
    r = rows.agg(*[f(F.col(f"cont{c}")).alias(f"{x}{c}") for c in (0, 1) for x, f in (("one", lambda n: F.count_if(n == 1)), ("two", lambda n: F.count_if(n == 2)), ("all", F.sum))]).first()
    cut = [estimated(r[f"one{c}"], r[f"two{c}"]) if discount is None else float(discount) for c in (0, 1)]
    total = [max(r[f"all{c}"] or 0, 1) for c in (0, 1)]
    kept = rows.agg(*[F.sum(F.greatest(F.col(f"cont{c}") - F.lit(cut[c]), F.lit(0.0))).alias(f"kept{c}") for c in (0, 1)]).first()
    return cut, total, [1 - (kept[f"kept{c}"] or 0) / total[c] for c in (0, 1)]


def train(docs: DataFrame, labels: DataFrame, held: Column, most: int | None, discount: float | None, window: int) -> tuple[Model, np.ndarray]:
    """The models, and the curve's weights. A quarter of the training documents is kept out of the pair
    counts; on these the curve is fitted, as on texts that the models don't know."""
    spark, both, made = docs.sparkSession, (0, 1), []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(scratch_path(spark, name))
        save(df, made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    rows = kept(training_rows(_lower(docs), labels, "toxic", most, held).withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0), "toxic-train")
    pairs = kept(rows.filter("NOT fit").mapInArrow(_count_pairs, "v long, w long, n0 long, n1 long").groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-pairs")
    few = pairs.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"n{c}") == n).alias(f"{x}{c}") for c in both for x, n in (("one", 1), ("two", 2))], *[F.count_if(F.col(f"n{c}") > 0).alias(f"any{c}") for c in both]).first()
    cuts = [float(discount) if discount is not None else estimated(few[f"one{c}"], few[f"two{c}"]) if few[f"any{c}"] else 0.5 for c in both]

    befores = pairs.groupBy(F.col("v").alias("h")).agg(*[F.sum(f"n{c}").alias(f"seen{c}") for c in both], *[F.sum(F.least(F.col(f"n{c}").cast("double"), F.lit(cuts[c]))).alias(f"cut{c}") for c in both])
    afters = pairs.groupBy(F.col("w").alias("h")).agg(*[F.count_if(F.col(f"n{c}") > 0).alias(f"cont{c}") for c in both])
    corpus = kept(_lower(docs).mapInArrow(_count_words, "h long, s long, n long").groupBy("h").agg(F.min("s").alias("s"), F.sum("n").alias("n")), "toxic-corpus")
    total = max(1, corpus.agg(F.sum("n")).first()[0] or 0)
    counts = [*[f"seen{c}" for c in both], *[f"cut{c}" for c in both], *[f"cont{c}" for c in both]]
    known = befores.join(afters, "h", "full_outer").join(corpus, "h", "left")
    known = kept(known.select("h", "s", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(F.col(x), F.lit(0)).cast("float").alias(x) for x in counts]), "toxic-words")
    d, sums, left = _level(known, discount)
    own = known.select("h", *counts[:4], *[(F.greatest(F.col(f"cont{c}") - F.lit(d[c]), F.lit(0.0)) / F.lit(float(sums[c]))).alias(f"word{c}") for c in both], (F.col("n") / F.lit(float(total))).alias("shared"))

    # a stem is followed by what its words follow; its share of the corpus is that of all words with it
    stems = known.filter("s IS NOT NULL").groupBy(F.col("s").alias("h")).agg(*[F.sum(f"cont{c}").cast("float").alias(f"cont{c}") for c in both])
    stems = kept(stems.join(corpus.groupBy(F.col("s").alias("h")).agg(F.sum("n").alias("n")), "h"), "toxic-stems")
    d, sums, stem_left = _level(stems, discount)
    stems = stems.select("h", *[(F.greatest(F.col(f"cont{c}") - F.lit(d[c]), F.lit(0.0)) / F.lit(float(sums[c])) / (F.col("n") / F.lit(float(total))) + F.lit(stem_left[c])).alias(f"stem{c}") for c in both])

    size = text_size(docs)[1]
    buckets = max(1, -(-few["n"] // BUCKET_PAIRS), -(-size // (_passes(size) * BUCKET_TEXT)))
    model = Model(spark, scratch_path(spark, "toxic-model"), buckets, {"cuts": np.float32(cuts), "word_left": np.float32(left), "no_stem": stem_left, "window": window})
    for kind, t, names in ((PAIRS, pairs, ("n0", "n1")), (WORDS, own, (*counts[:4], "word0", "word1", "shared")), (STEMS, stems, ("stem0", "stem1"))):
        save(t.mapInArrow(_stored(kind, buckets, *names), "bucket int, keys binary, vals binary"), f"{model.path}/kind-{kind}")
    for path in made[1:]:
        drop_folder(spark, path)
    fit = rows.filter("fit")
    got = model.features(fit, text_size(fit)[1], "doc_id", "y").select("y", "f").toArrow()  # five numbers a row
    drop_folder(spark, made[0])
    y = got["y"].to_numpy().astype(float)
    alike = np.where(y == 1, (y == 0).sum() / max(1, (y == 1).sum()), 1.0)  # both classes weigh the same, as in the ratios
    return model, logistic(_matrix(got["f"].combine_chunks()), y, alike)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, 4)


def _scored(features: DataFrame, weights: np.ndarray, key: str) -> DataFrame:
    """(key, score)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(**{key: b[key]}, score=curve(_matrix(b["f"]), weights))

    return features.mapInArrow(run, f"{key} {dict(features.dtypes)[key]}, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, most: int | None = None, discount: float | None = None, window: int = 6, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns. A score follows from the lower-cased text
    alone, so what goes is told by its hash."""
    model, weights = train(docs, labels, fold(folds) == held_fold, most, discount, window)

    def sha(text: Column) -> Column:
        return F.unhex(F.sha2(F.coalesce(F.lower(text.cast("string")), F.lit("")).cast("binary"), 256))

    found = model.features(_lower(docs).withColumn("gone_sha", sha(F.col("text"))), text_size(docs)[1], "doc_id", "gone_sha")
    gone = _scored(found, weights, "gone_sha").filter(F.col("score") >= limit).select("gone_sha").distinct()
    return docs.join(written(gone, "toxic-gone"), sha(docs["text"]) == F.col("gone_sha"), "left_anti")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, most: int | None = None, discount: float | None = None, window: int = 6, limit: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; documents of fold ``held_fold`` aren't learned from."""
    held = fold(folds) == held_fold
    model, weights = train(docs, labels, held, most, discount, window)
    scored = _scored(model.features(_lower(docs), text_size(docs)[1], "doc_id"), weights, "doc_id")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
