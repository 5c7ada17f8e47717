"""Vector operators against brute force on the embeddings table."""

import numpy as np
from pyspark.sql import functions as F

from coordspark.operators import vectors as vec
from coordspark.plans.queries import doc_points

SF = "/root/testdata/sf0.001"


def _brute(spark):
    rows = doc_points(spark, SF).select("id", "vector").orderBy("id").collect()
    ids = np.array([r["id"] for r in rows])
    m = np.array([np.asarray(r["vector"], dtype=np.float64) for r in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return ids, m


def test_knn_search_matches_brute_force(spark):
    ids, m = _brute(spark)
    q = m[0]
    s = m @ q
    order = np.lexsort((ids, -s))[:10]
    got = vec.knn_search(doc_points(spark, SF), list(q), k=10, min_score=-1.0).collect()
    assert [r["id"] for r in got] == list(ids[order])
    assert np.allclose([r["score"] for r in got], s[order], atol=1e-9)


def test_knn_batch_matches_brute_force(spark):
    ids, m = _brute(spark)
    p = doc_points(spark, SF).repartition(4)          # several tasks, partial top-k each
    qs = p.select(F.col("id").alias("query_id"), "vector")
    got = vec.knn_batch(p, qs, k=5, min_score=-1.0).collect()
    by_q = {}
    for r in got:
        by_q.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    s = m @ m.T
    for qi, qid in enumerate(ids[:50]):
        want = list(ids[np.lexsort((ids, -s[qi]))[:5]])
        assert [i for _, i in sorted(by_q[qid])] == want


def test_knn_batch_exclude_self(spark):
    p = doc_points(spark, SF)
    qs = p.select(F.col("id").alias("query_id"), "vector")
    got = vec.knn_batch(p, qs, k=3, min_score=-1.0, exclude_self=True)
    assert got.filter("query_id = id").count() == 0
    assert got.groupBy("query_id").count().filter("count <> 3").count() == 0


def test_int8_recall(spark):
    ids, m = _brute(spark)
    p = doc_points(spark, SF)
    bound = vec.quantile_bound(p)
    pq = vec.with_int8(p, bound)
    hits = 0
    for qi in range(20):
        want = set(ids[np.argsort(-(m @ m[qi]))[:10]])
        got = {r["id"] for r in vec.knn_int8(pq, list(m[qi]), bound, k=10, min_score=-1.0).collect()}
        hits += len(want & got)
    assert hits / 200 >= 0.95


def test_lsh_returns_exact_scores(spark):
    ids, m = _brute(spark)
    got = vec.knn_lsh(doc_points(spark, SF), list(m[0]), k=5, min_score=-1.0).collect()
    assert got and got[0]["id"] == ids[0]          # the query point itself is found
    for r in got:
        j = int(np.where(ids == r["id"])[0][0])
        assert abs(r["score"] - float(m[j] @ m[0])) < 1e-9


def test_hashing_embedder_unit_length(spark):
    df = spark.createDataFrame([("customer account balance",), ("",)], "t string")
    rows = vec.hashing_embed(df, "t", dim=32).collect()
    assert abs(np.linalg.norm(rows[0]["vector"]) - 1.0) < 1e-6 and len(rows[0]["vector"]) == 32


def test_cosine_takes_the_norm_once(spark):
    """The norm of each vector was taken twice, over copies of it."""
    rows = [(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, [-3.0, 0.5])]
    df = spark.createDataFrame(rows, "id int, v array<float>").select("id", vec.cosine(F.col("v"), [2.0, 1.0]).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().upper().count("SQRT(") == 1
    got = {r["id"]: r["s"] for r in df.collect()}
    assert got[2] == 0.0 and got[3] is got[4] is got[5] is got[6] is None
    assert got[1] == 4.0 / (5.0**0.5 * 5.0**0.5) and got[7] == (-6.0 + 0.5) / (9.25**0.5 * 5.0**0.5)
