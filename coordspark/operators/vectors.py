"""Vector operators: exact cosine top-k for one query (V1, V2, V4, T1), batch
top-k for many queries (V3, J9, W3), int8 quantized search with exact
rescore (V6), LSH approximate search (V5), text embedders (V7) and the
search-quality check (A17).

One query: the query vector is a literal array and the score a native
higher-order expression; ``orderBy(desc).limit(k)`` becomes a
TakeOrderedAndProject, so only k rows per partition travel.

Many queries: the points are dealt by a hash of their id into slots of
bounded bytes, and every query goes to every slot, by a shuffle: no vector
passes the driver. A task holds the points of one slot and streams the queries
past them (numpy matrix products, tile by tile), so queries x slots x k
candidates are shuffled, never all pairs. A window then keeps the global top-k
per query. Equal scores are cut by id in the task and in the window alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default minimum similarity of a search (tool default).
DEFAULT_MIN_SCORE = 0.35
#: Bytes of point vectors (float64) in a slot, of which a task holds one.
MAX_SLOT_BYTES = 8 * 1024 * 1024
#: Scores of one tile (queries x points) in a task; a tile takes a few times 8 bytes each.
TILE_SCORES = 1 << 21
#: Decimals up to which scores count as equal (a matrix product rounds equal vectors unequally).
SCORE_DECIMALS = 12
#: Candidates fetched per hit before the exact rescore (int8 search).
OVERSAMPLING = 2.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(vec: Column, query: list[float]) -> Column:
    """Cosine similarity of a vector column to one literal query vector
    (0 if either is all zeros, NULL for a NULL vector)."""
    q = np.asarray(query, dtype=np.float64)
    qn = float(np.linalg.norm(q))
    qlit = F.array(*[F.lit(float(x)) for x in q])

    def score(both: Column) -> Column:
        return F.when(both == 0, F.lit(0.0)).otherwise(F.try_divide(dot(vec, qlit), both))

    # a lambda over one value: the vector's norm is taken once, not once for each use
    return F.get(F.transform(F.array(norm(vec) * F.lit(qn)), score), F.lit(0))


def knn_search(points: DataFrame, query: list[float], k: int = 10, min_score: float = DEFAULT_MIN_SCORE,
               pred: Column | None = None, vector_col: str = "vector") -> DataFrame:
    """V1/V2: exact cosine top-k of one query, optional pre-filter, min score.

    T1: order + limit first, then the score threshold (same rows, the score
    is computed once).
    """
    df = points if pred is None else points.filter(pred)
    scored = df.withColumn("score", cosine(F.col(vector_col), query)).drop(vector_col)
    return scored.orderBy(F.desc("score"), "id").limit(k).filter(F.col("score") >= min_score)


def _best_columns(s: np.ndarray, k: int) -> np.ndarray:
    """Per row the ``k`` columns of the highest scores; of equal scores the first columns."""
    if s.shape[1] <= k:
        return np.broadcast_to(np.arange(s.shape[1]), s.shape)
    cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    above, tied = s > cut, s == cut
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (tied & (np.cumsum(tied, axis=1) <= room)))[1].reshape(len(s), k)


class _Held:
    """The points of one slot in id order, with unit vectors."""

    def __init__(self, rows: pd.DataFrame, keep: list[str], vector_col: str) -> None:
        rows = rows.sort_values("id", kind="stable")
        self.rows, self.mat = rows[keep].reset_index(drop=True), _unit_rows(rows[vector_col])

    def best(self, qids: np.ndarray, qmat: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
        """The k best rows of each query (equal scores by id), tile by tile."""
        step = max(1, TILE_SCORES // len(self.mat))
        for t in range(0, len(qids), step):
            s = np.round(qmat[t:t + step] @ self.mat.T, SCORE_DECIMALS)
            col = _best_columns(s, k)
            out = self.rows.iloc[col.reshape(-1)].reset_index(drop=True)
            out.insert(0, "score", np.take_along_axis(s, col, axis=1).reshape(-1))
            out.insert(0, "query_id", np.repeat(qids[t:t + step], col.shape[1]))
            yield out


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors.to_numpy()])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _scan_slots(k: int, keep: list[str], vector_col: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by slot, its points first: hold the points of a slot, stream the queries past them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, points, held = None, [], None
        for pdf in batches:
            for slot, part in pdf.groupby("_slot", sort=True):
                if slot != at:
                    at, points, held = slot, [], None
                asks = part["_asks"].to_numpy(dtype=bool)
                if not asks.all():
                    points.append(part[~asks])
                if asks.any() and held is None and points:
                    held, points = _Held(pd.concat(points, ignore_index=True), keep, vector_col), []
                if asks.any() and held is not None:
                    yield from held.best(part["_query_id"].to_numpy(dtype=np.int64)[asks], _unit_rows(part[vector_col][asks]), k)

    return run


def knn_batch(points: DataFrame, queries: DataFrame, k: int = 10, min_score: float = DEFAULT_MIN_SCORE,
              pred: Column | None = None, keep: list[str] | None = None, exclude_self: bool = False,
              vector_col: str = "vector", block_bytes: int = MAX_SLOT_BYTES) -> DataFrame:
    """Exact cosine top-k for every query in ``queries(query_id, vector)``.

    With ``exclude_self`` a point whose id equals the query id is not a hit.
    Rows with a NULL vector are left out on both sides; an all-zero vector
    scores 0. ``keep`` must hold ``id``. A slot of points takes about
    ``block_bytes`` of vectors.
    """
    keep = keep or ["id"]
    df = points if pred is None else points.filter(pred)
    df = df.select(*keep, vector_col).filter(F.col(vector_col).isNotNull())
    kk = k + 1 if exclude_self else k
    size = df.agg(F.sum(F.size(vector_col).cast("long")).alias("n")).first()["n"] or 0
    slots = max(1, -(-8 * size // block_bytes))
    dealt = df.withColumns({"_slot": F.pmod(F.xxhash64("id"), F.lit(slots)), "_asks": F.lit(False), "_query_id": F.lit(None).cast("long")})
    asked = queries.filter(F.col("vector").isNotNull()).select(
        F.col("vector").cast(df.schema[vector_col].dataType).alias(vector_col), F.col("query_id").cast("long").alias("_query_id"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("_slot"), F.lit(True).alias("_asks"))
    both = dealt.unionByName(asked, allowMissingColumns=True).repartition("_slot").sortWithinPartitions("_slot", "_asks")
    fields = [f for f in df.schema.fields if f.name in keep]
    out_schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("score", T.DoubleType()),
                               *fields])
    cands = both.mapInPandas(_scan_slots(kk, keep, vector_col), out_schema)
    if exclude_self:
        cands = cands.filter(F.col("query_id") != F.col("id"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .filter(F.col("score") >= min_score))


# --- int8 quantization (V6) ---------------------------------------------------------

def quantile_bound(points: DataFrame, q: float = 0.99, vector_col: str = "vector") -> float:
    """Clip bound: the q-quantile of |x| over all vector elements (partial + final sketch)."""
    b = (points.select(F.explode(F.col(vector_col)).alias("x"))
         .agg(F.percentile_approx(F.abs("x"), q, 10000).alias("b")).collect()[0]["b"])
    return float(b) if b else 1.0


def quantize(vec: Column, bound: float) -> Column:
    """int8 codes: clip to [-bound, bound], scale to [-127, 127], round half away from zero."""
    return F.transform(vec, lambda x: F.round(F.greatest(F.lit(-bound), F.least(F.lit(bound), x.cast("double")))
                                              / F.lit(bound) * 127, 0).cast("tinyint"))


def with_int8(points: DataFrame, bound: float, vector_col: str = "vector") -> DataFrame:
    return points.withColumn("qvector", quantize(F.col(vector_col), bound))


def knn_int8(points_q: DataFrame, query: list[float], bound: float, k: int = 10,
             min_score: float = DEFAULT_MIN_SCORE, pred: Column | None = None,
             oversampling: float = OVERSAMPLING) -> DataFrame:
    """V6: integer dot product on int8 codes picks ``oversampling * k`` candidates,
    which are rescored exactly on the float vectors."""
    q = np.clip(np.asarray(query, dtype=np.float64), -bound, bound) / bound * 127
    qcodes = np.sign(q) * np.floor(np.abs(q) + 0.5)
    qlit = F.array(*[F.lit(int(x)) for x in qcodes])
    df = points_q if pred is None else points_q.filter(pred)
    approx = F.aggregate(F.zip_with(F.col("qvector"), qlit, lambda x, y: x.cast("int") * y),
                         F.lit(0).cast("long"), lambda s, x: s + x)
    n_cand = max(k, int(np.ceil(k * oversampling)))
    cands = df.withColumn("approx", approx).orderBy(F.desc("approx"), "id").limit(n_cand)
    return knn_search(cands.drop("approx", "qvector"), query, k, min_score)


# --- LSH approximate search (V5) ----------------------------------------------------

def lsh_model(points: DataFrame, bucket_length: float = 0.5, num_tables: int = 4, seed: int = 7,
              vector_col: str = "vector"):
    """Bucketed random projection LSH on unit vectors (Euclid order = cosine order)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    feats = points.withColumn("features", array_to_vector(F.col(vector_col)))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length,
                                      numHashTables=num_tables, seed=seed)
    return lsh.fit(feats), feats


def knn_lsh(points: DataFrame, query: list[float], k: int = 10, min_score: float = DEFAULT_MIN_SCORE,
            vector_col: str = "vector", **kw) -> DataFrame:
    """V5: approximate neighbours from the LSH index, rescored exactly."""
    from pyspark.ml.linalg import Vectors

    model, feats = lsh_model(points, vector_col=vector_col, **kw)
    q = np.asarray(query, dtype=np.float64)
    q = q / max(np.linalg.norm(q), 1e-300)
    near = model.approxNearestNeighbors(feats, Vectors.dense(q), max(k * 4, k))
    return knn_search(near.drop("features", "hashes", "distCol"), list(q), k, min_score, vector_col=vector_col)


# --- embedders (V7) -------------------------------------------------------------------

def hashing_embed(df: DataFrame, text_col: str, dim: int = 64, out: str = "vector") -> DataFrame:
    """V7 (c): deterministic feature hashing of word tokens, L2-normalised.

    JVM-only (RegexTokenizer + HashingTF + Normalizer). Good for offline
    change-detection and plumbing tests; it has no semantic quality.
    """
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[^\p{L}\p{N}_]+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    nz = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0)
    res = nz.transform(tf.transform(tok.transform(df)))
    return res.withColumn(out, vector_to_array(F.col("_nv"), "float32")).drop("_tok", "_tf", "_nv")


def udf_embedder(fn: Callable[[list[str]], np.ndarray], dim: int):
    """V7 (b): wrap a user batch embedding function as an iterator pandas UDF.

    ``fn`` gets a list of texts (an Arrow batch; set
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` to the service's batch
    size) and returns an array of shape (n, dim).
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vecs = np.asarray(fn(s.fillna("").tolist()), dtype=np.float32).reshape(len(s), dim)
            yield pd.Series(list(vecs))

    return embed


def search_quality(points: DataFrame, k: int = 5, min_score: float = 0.3) -> DataFrame:
    """Every point is a query; a hit if a top-k neighbour (not itself,
    score >= min) has the same label (``model_name``). Pass rate per label."""
    queries = points.select(F.col("id").alias("query_id"), "vector")
    hits = knn_batch(points, queries, k=k, min_score=min_score, keep=["id", "model_name"], exclude_self=True)
    labels = points.select(F.col("id").alias("query_id"), F.col("model_name").alias("query_label"))
    per_query = (labels.join(hits, "query_id", "left")
                 .groupBy("query_id", "query_label")
                 .agg(F.max(F.coalesce(F.col("model_name") == F.col("query_label"), F.lit(False)).cast("int"))
                      .alias("hit")))
    return (per_query.groupBy(F.col("query_label").alias("label"))
            .agg(F.count(F.lit(1)).alias("n_queries"), F.sum("hit").alias("n_hits"))
            .withColumn("pass_rate", F.round(F.col("n_hits") / F.col("n_queries"), 6)))
