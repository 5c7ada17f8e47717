"""What the scoring operators share: training rows, and a logistic curve fitted to a few features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import doc_texts
from coordspark.operators.common import checked_broadcast

#: Labels that are sent to every task (16 bytes each and their hash map); above it the texts are shuffled to meet them.
MAX_SENT_IDS = 4_000_000


def fold(parts: int) -> Column:
    """crc32 of doc_id's decimal text, modulo ``parts`` (null: as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int | None, held: Column, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, y): the labelled documents with a text, none of them held out. Labels other than 0 and 1 aren't used. With
    ``most`` only that many of either label, chosen by a hash of doc_id; with ``most_bytes`` longer ones are passed over."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(~held)
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).filter(F.col("y").isin(0, 1))
    rows = doc_texts(docs).filter(~held & F.col("text").isNotNull())
    if most_bytes is not None:
        rows = rows.filter(F.octet_length("text") <= most_bytes)
    if most is None:  # no text is shuffled to meet its label, unless there are too many labels to send to every task
        return rows.join(checked_broadcast(y, MAX_SENT_IDS), "doc_id")
    # picked from ids alone: no text is shuffled to meet its label
    ids = rows.select("doc_id").join(y, "doc_id").select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    picked = None
    for c in (0, 1):
        mine = ids.filter(F.col("y") == c).orderBy("h", "doc_id").limit(most).select("doc_id", "y")
        picked = mine if picked is None else picked.union(mine)
    return rows.join(F.broadcast(picked.distinct()), "doc_id")  # at most 2 * most ids


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the constant last, by Newton's method on standardised features."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1] + 1) if not len(y) else np.r_[np.zeros(x.shape[1]), 4.0 if y[0] else -4.0]
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / dev, np.ones(len(x))]
    w, own = np.zeros(z.shape[1]), np.ones(len(y)) if weight is None else weight
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (own * (p - y)) + ridge * len(y) * w
        hess = (z * (own * p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    a = w[:-1] / dev
    return np.r_[a, w[-1] - (a * mean).sum()]


def curve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
