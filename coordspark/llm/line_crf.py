"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's features are shares of kinds of characters, word lengths and repetitions, and
those of the lines before and after it; the chain's transition weights tie neighbouring lines. Forward and
backward messages of two states are one number each (the log ratio of good to bad), so the marginals of all
texts of a batch are found side by side, one numpy step per line number. A document's quality is the mean
marginal of its lines, weighted with their length; a logistic curve turns it into a score.

The field is fitted by gradient steps on the likelihood of the lines of at most ``most`` labelled documents
of either label (of up to 16 KB and 128 lines, none held out), whose lines all carry the document's label; the
curve on a quarter of them that the field didn't see. Every text is scored whole.

Defined results: a null or empty text is one empty line; documents without a label aren't learned from; with
labels of one class only, every score leans to that class; repeated rows are scored alike; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import batch, blocks, doc_texts, utf8, written
from coordspark.llm.learning import curve, fold, logistic, training_rows
from coordspark.llm.words import comb, mix, words

_b = np.arange(256)
_KINDS = {
    "upper": (_b >= 65) & (_b <= 90), "lower": (_b >= 97) & (_b <= 122), "digit": (_b >= 48) & (_b <= 57), "wide": _b >= 128, "space": (_b == 32) | (_b == 9),
    "stop": np.isin(_b, [ord(c) for c in ".,;:?'\"()-"]), "bang": _b == 33, "bar": _b == 124, "sign": np.isin(_b, [ord(c) for c in "#$%&*+=<>@[]\\^_`{}~/"]),
}
_KIND = np.zeros(256, np.uint8)
for _k, _of in enumerate(_KINDS.values()):
    _KIND[_of] = _k + 1
FEATURES = 24
Params = tuple[np.ndarray, np.ndarray]


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each line; a row has one more than it has line breaks."""
    br = np.flatnonzero(data == 10)
    at = np.searchsorted(off, br, "right") - 1
    n = np.bincount(at, minlength=len(off) - 1) + 1
    row = np.repeat(np.arange(len(off) - 1), n)
    start = np.empty(len(row), np.int64)
    head = np.cumsum(n) - n
    mask = np.ones(len(row), bool)
    mask[head] = False
    start[head], start[mask] = off[:-1], br + 1
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    tail = head + n - 1
    end[tail] = off[1:]
    return row, start, end


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, features) of each line, its neighbours' features beside its own."""
    row, start, end = lines(data, off)
    size = end - start
    kind = _KIND[data]
    share = {}
    for k, name in enumerate(_KINDS):
        c = np.concatenate([[0], np.cumsum(kind == k + 1)])
        share[name] = (c[end] - c[start]).astype(np.float64)
    f = np.zeros((len(row), FEATURES))
    letters = share["upper"] + share["lower"] + share["wide"] / 2
    some = np.maximum(size, 1)
    f[:, 0] = np.log1p(size) / 8
    f[:, 1] = share["upper"] / np.maximum(letters, 1)
    for k, name in enumerate(("digit", "stop", "bang", "bar", "sign", "wide", "space")):
        f[:, 2 + k] = share[name] / some
    f[:, 9] = letters / some
    # Words by line: a line is a row here.
    edges = np.concatenate([start, [len(data)]])
    h, line, _, _ = words(data, edges)
    n = np.bincount(line, minlength=len(row)).astype(np.float64)
    if len(h):
        doc = row[line]
        at_line = np.unique(comb(h, line.astype(np.uint64)), return_index=True)[1]
        at_doc = np.unique(comb(h, doc.astype(np.uint64)), return_index=True)[1]
        same = np.flatnonzero((h[1:] == h[:-1]) & (line[1:] == line[:-1])) + 1
        w = np.maximum(n, 1)
        f[:, 10] = np.bincount(line[at_line], minlength=len(row)) / w
        f[:, 11] = np.bincount(line[at_doc], minlength=len(row)) / w
        f[:, 12] = np.bincount(line[same], minlength=len(row)) / w
        f[:, 13] = np.minimum((size - share["space"]) / w / 10, 3)
        nth = np.arange(len(h)) - (np.cumsum(n) - n).astype(np.int64)[line]
        whole = np.zeros(len(row), np.uint64)
        np.add.at(whole, line, mix(h + nth.astype(np.uint64)))
        _, inv, copies = np.unique(comb(whole, row.astype(np.uint64)), return_inverse=True, return_counts=True)
        f[:, 14] = (copies[inv] > 1) & (n > 0)
    f[:, 15] = np.log1p(n) / 6
    f[:, 16] = size == 0
    last = np.where(size > 0, data[np.maximum(end - 1, 0)] if len(data) else 0, 0)
    f[:, 17] = np.isin(last, (46, 33, 63))
    for k, (c, limit) in enumerate(((1, 0.5), (4, 0.02), (5, 0.02), (6, 0.05), (12, 0.1))):
        f[:, 18 + k] = f[:, c] > limit
    f[:, 23] = f[:, 11] < 0.5
    x = np.zeros((len(row), 3 * FEATURES + 1))
    x[:, :FEATURES], x[:, -1] = f, 1
    inner = row[1:] == row[:-1]
    x[1:, FEATURES : 2 * FEATURES] = f[:-1] * inner[:, None]
    x[:-1, 2 * FEATURES : -1] = f[1:] * inner[:, None]
    return row, size, x


def messages(u: np.ndarray, row: np.ndarray, rows: int, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the line's own weight) and backward log ratios of good to bad, for every line."""
    n = np.bincount(row, minlength=rows)
    head = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    fwd, back = u.copy(), np.zeros_like(u)
    (bb, bg), (gb, gg) = np.exp(trans)
    active = [int(np.searchsorted(-n[order], -t, "left")) for t in range(int(n.max(initial=0)))]
    for t in range(1, len(active)):
        at = head[order[: active[t]]] + t
        r = np.exp(np.clip(fwd[at - 1], -50, 50))
        fwd[at] = u[at] + np.log((bg + r * gg) / (bb + r * gb))
    for t in range(len(active) - 2, -1, -1):
        at = head[order[: active[t + 1]]] + t
        r = np.exp(np.clip(u[at + 1] + back[at + 1], -50, 50))
        back[at] = np.log((gb + r * gg) / (bb + r * bg))
    return fwd, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(x: np.ndarray, row: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.05, ridge: float = 1e-4) -> Params:
    """Line weights and transition weights [from][to] (0 bad, 1 good) by Adam. ``y`` is each row's label."""
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    if not len(x):
        return w, trans
    rows = len(y)
    n = np.bincount(row, minlength=rows)
    weight = (1 / np.sqrt(np.maximum(n, 1)))[row]  # long documents shouldn't outweigh the others
    weight /= weight.sum()
    good = y[row].astype(float)
    pair = np.flatnonzero(row[1:] == row[:-1])
    moment, square = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, steps + 1):
        u = x @ w
        fwd, back = messages(u, row, rows, trans)
        grad_w = x.T @ (weight * (good - _sigmoid(fwd + back))) - ridge * w
        to = u[pair + 1] + back[pair + 1]
        logs = np.stack([np.zeros(len(pair)) + trans[0, 0], trans[0, 1] + to, fwd[pair] + trans[1, 0], fwd[pair] + trans[1, 1] + to], 1)
        p = np.exp(logs - logs.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        seen = np.zeros_like(p)
        seen[np.arange(len(pair)), np.where(good[pair] > 0, 3, 0)] = 1
        grad_t = ((seen - p) * weight[pair + 1][:, None]).sum(0) - ridge * trans.reshape(-1)
        g = np.r_[grad_w, grad_t]
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        step = rate * (moment / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        w, trans = w + step[:-4], np.clip(trans + step[-4:].reshape(2, 2), -3, 3)
    return w, trans


def document_quality(data: np.ndarray, off: np.ndarray, params: Params) -> np.ndarray:
    """Two numbers per row: the log odds of the mean marginal, and the mean of the marginals' bounded log odds,
    both weighted with the lines' lengths."""
    row, size, x = line_features(data, off)
    w, trans = params
    odds = np.add(*messages(x @ w, row, len(off) - 1, trans))
    total = np.bincount(row, weights=size + 1.0, minlength=len(off) - 1)
    p = np.clip(np.bincount(row, weights=(size + 1.0) * _sigmoid(odds), minlength=len(off) - 1) / total, 1e-6, 1 - 1e-6)
    return np.stack([np.log(p / (1 - p)), np.bincount(row, weights=(size + 1.0) * np.clip(odds, -20, 20), minlength=len(off) - 1) / total], 1)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, most: int = 1500, limit: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; documents of fold ``held_fold`` aren't learned from."""
    held: Column = fold(folds) == held_fold
    rows = written(training_rows(docs, labels, "quality", most, held, 1 << 14), "quality-train")
    got = rows.orderBy("doc_id").select("doc_id", "text", "y").toArrow()  # at most 2 * most short texts
    data, off = utf8(got["text"])
    y = got["y"].to_numpy()
    row, _, x = line_features(data, off)
    seen = (np.arange(len(y)) % 4 != 0) & (np.bincount(row, minlength=len(y)) <= 128)
    number = np.cumsum(seen) - 1
    params = fit(x[seen[row]], number[row[seen[row]]], y[seen])
    rest = ~seen if (~seen).any() else seen
    weights = logistic(document_quality(data, off, params)[rest], y[rest].astype(float))
    if len(y) and 0 < y.mean() < 1 and len(set(y[rest].tolist())) < 2:
        weights = np.array([1.0, 0.0, 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, at = utf8(b["text"])
            for i, j in blocks(at, 4 << 20):
                q = document_quality(own[at[i] : at[j]], at[i : j + 1] - at[i], params)
                yield batch(doc_id=b["doc_id"].slice(i, j - i), score=curve(q, weights))

    scored = doc_texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
