"""Language identification by cross-parsing entropy.

For every language a suffix automaton holds sample texts of that language. A text is parsed against each of
them: from where the last phrase ended, the next phrase is the longest match that the automaton knows (or one
unknown symbol). The language that needs the fewest phrases per symbol wins; equal numbers go to the
language first in the alphabet. Letters are folded to a small alphabet, everything else to one space.

The automata are fitted on a bounded sample: per language ``docs_each`` labelled documents, none of them held
out, those of ``shortest`` to ``longest`` bytes first, then by a hash of doc_id; of a longer one its first
``longest`` bytes. Where these are short, more follow (to 20 times as many) until there are ``docs_each`` times
``shortest`` bytes, so every language with a text outside the held-out fold is learned. Every text is parsed whole: it is
cut into pieces of ``piece`` symbols that are parsed side by side, one numpy step per symbol for all pieces of
a batch; a cut ends a phrase early, alike for all languages.

score: by how much of the runner-up's phrases the winner needs fewer, 1 if there is no other language.

Defined results: ``und`` with score 0 if a text is null, empty or without a letter (or if no language is
learned); repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coordspark.llm.common import batch, blocks, doc_texts, utf8
from coordspark.llm.learning import fold

#: Bytes to symbols: 0 space, 1 to 26 letters, and the bytes of other characters by their low five bits.
SYMBOLS = 59
_b = np.arange(256)
_CODE = np.zeros(256, np.uint8)
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 27 + (_b[128:] & 31)


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each row, runs of spaces as one, none at a row's start; and their offsets."""
    code = _CODE[data]
    first = np.zeros(len(code) + 1, bool)
    first[off] = True
    space = code == 0
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1] & ~first[1:-1]
    return code[keep], np.concatenate([[0], np.cumsum(keep)])[off]


class Automaton:
    """Suffix automaton of some texts: from state 1, every substring of any of them can be read."""

    def __init__(self, texts: list[bytes]) -> None:
        nxt: list[dict[int, int]] = [{}, {}]
        link, length = [0, 0], [0, 0]
        for text in texts:
            last = 1
            for c in text:
                if (q := nxt[last].get(c)) is not None and length[q] == length[last] + 1:
                    last = q
                    continue
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(1)
                p = last
                while p and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p:
                    q = nxt[p][c]
                    if length[q] == length[p] + 1:
                        link[cur] = q
                    else:
                        clone = len(nxt)
                        nxt.append(dict(nxt[q]))
                        length.append(length[p] + 1)
                        link.append(link[q])
                        while p and nxt[p].get(c) == q:
                            nxt[p][c] = clone
                            p = link[p]
                        link[q] = link[cur] = clone
                last = cur
        self.table = np.zeros((len(nxt), SYMBOLS), np.int32)
        for s, to in enumerate(nxt):
            if to:
                self.table[s, list(to)] = list(to.values())


def phrases(table: np.ndarray, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of phrases of each piece of ``code`` (from start to end), all parsed side by side."""
    order = np.argsort(start - end, kind="stable")  # longest first: the pieces still open are a prefix
    at, size = start[order], (end - start)[order]
    flat, root = table.reshape(-1), table[1]
    state, count = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
    for step in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -step, "left"))
        c = code[at[:n] + step]
        s = state[:n]
        to = flat[s * SYMBOLS + c]
        lost = np.flatnonzero(to == 0)
        again = root[c[lost]]
        count[lost] += (s[lost] != 1).astype(np.int64) + (again == 0)
        to[lost] = np.maximum(again, 1)
        state[:n] = to
    out = np.empty(len(at), np.int64)
    out[order] = count + (state != 1)
    return out


_BUILT: dict[tuple, list[np.ndarray]] = {}


def _predict(samples: dict[str, list[bytes]], piece: int):
    langs = sorted(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple((x, hash(tuple(samples[x]))) for x in langs)
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = [Automaton(samples[x]).table for x in langs]
        tables = _BUILT[key]
        for b in batches:
            data, off = utf8(b["text"])
            for i, j in blocks(off, 8 << 20):
                code, at = symbols(data[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.diff(at)
                row = np.repeat(np.arange(j - i), -(-n // piece))
                nth = np.arange(len(row)) - np.repeat(np.cumsum(-(-n // piece)) - -(-n // piece), -(-n // piece))
                start = at[row] + nth * piece
                end = np.minimum(start + piece, at[row + 1])
                letters = b["letter"].slice(i, j - i).to_numpy(zero_copy_only=False)
                parsed = np.stack([np.bincount(row, weights=phrases(t, code, start, end), minlength=j - i) for t in tables]) if tables else np.zeros((1, j - i))
                best = parsed.argmin(0)
                low = np.partition(parsed, min(1, len(parsed) - 1), axis=0)
                gain = 1 - low[0] / np.maximum(low[1], 1) if len(parsed) > 1 else np.ones(j - i)
                known = letters & bool(tables)
                yield batch(doc_id=b["doc_id"].slice(i, j - i), lang_pred=[langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)], score=np.where(known, gain, 0.0))

    return run


def language_id(docs: DataFrame, folds: int = 4, held_fold: int = 2, docs_each: int = 24, shortest: int = 500, longest: int = 3000, piece: int = 512) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; documents of fold ``held_fold`` aren't learned from."""
    held = fold(folds) == held_fold
    rows = doc_texts(docs, F.col("lang").cast("string").alias("lang")).filter(~held & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    size = F.octet_length("text")
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), (~size.between(shortest, longest)).alias("odd"), F.least(size, F.lit(longest)).alias("size"))
    order = W.partitionBy("lang").orderBy("odd", "h", "doc_id")
    ids = ids.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= 20 * docs_each)  # Spark keeps the first rows of each group only
    so_far = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    picked = ids.withColumn("so_far", so_far).filter((F.col("nth") <= docs_each) | (F.col("so_far") < docs_each * shortest)).select("doc_id", "lang")
    samples: dict[str, list[bytes]] = {}
    sample = rows.withColumn("text", F.substring("text", 1, longest)).join(F.broadcast(picked), ["doc_id", "lang"])
    for r in sample.orderBy("doc_id").collect():  # at most 20 * docs_each a language
        code, _ = symbols(*utf8(pa.array([r["text"].encode()[:longest]], pa.binary())))
        samples.setdefault(r["lang"], []).append(code.tobytes())
    schema = "doc_id long, lang_pred string, score double"
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))  # of any script
    found = doc_texts(docs).withColumn("letter", letter).mapInArrow(_predict(samples, piece), schema)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
