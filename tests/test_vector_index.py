"""Stored inverted file (V5) and int8 codes (V6): recall, pruning, ties and odd vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from coordspark.operators import vector_index as vix
from coordspark.operators import vectors as vec
from coordspark.plans.queries import doc_points
from coordspark.session import scratch_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def points(spark):
    p = doc_points(spark, SF).select("id", "model_name", "vector")
    odd = spark.createDataFrame([(-1, "odd", None), (-2, "odd", [0.0] * 64)], "id long, model_name string, vector array<float>")
    return p.union(odd).cache()


@pytest.fixture(scope="module")
def matrix(points):
    rows = points.filter("id >= 0").orderBy("id").collect()
    m = np.array([r["vector"] for r in rows], float)
    return np.array([r["id"] for r in rows]), m / np.linalg.norm(m, axis=1, keepdims=True)


def _recall(search, matrix, n=6, k=10):
    ids, m = matrix
    hit = 0
    for i in range(0, len(m), len(m) // n)[:n]:
        best = set(ids[np.lexsort((ids, -np.round(m @ m[i], 12)))[:k]])
        hit += len(best & {r["id"] for r in search(list(m[i])).collect()})
    return hit / (n * k)


def test_inverted_file_reads_less_and_recalls(spark, points, matrix):
    path = vix.write_inverted_file(points, scratch_path(spark, "inv"), lists=16)
    assert spark.read.parquet(path + "/points").count() == points.filter("vector IS NOT NULL").count()
    q = list(matrix[1][0])
    files = [vix.probed_points(spark, path, q, n).select(F.input_file_name()).distinct().count() for n in (1, 4, 16)]
    assert files[0] < files[1] < files[2]
    plan = vix.probed_points(spark, path, q, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[list#\d+ IN", plan)
    assert _recall(lambda v: vix.knn_inverted_file(spark, path, v, 10, 13, -1.0), matrix) >= 0.9
    exact = [(r["id"], round(r["score"], 9)) for r in vec.knn_search(points, q, 20, -1.0).collect()]
    assert [(r["id"], round(r["score"], 9)) for r in vix.knn_inverted_file(spark, path, q, 20, 16, -1.0).collect()] == exact


def test_codes_are_scanned_without_vectors_and_recall(spark, points, matrix):
    path = vix.write_codes(points, scratch_path(spark, "codes"))
    q = list(matrix[1][0])
    plan = vix.code_candidates(spark, path, q, 20)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,code:array<tinyint>>" in plan and "TakeOrderedAndProject" in plan
    assert _recall(lambda v: vix.knn_codes(spark, path, v, 10, -1.0), matrix) >= 0.95
    only = vix.knn_codes(spark, path, q, 5, -1.0, F.col("model_name") == "label_3").collect()
    assert len(only) == 5 and {r["model_name"] for r in only} == {"label_3"}


def test_empty_points(spark, points):
    none = points.filter("false")
    path = vix.write_inverted_file(none, scratch_path(spark, "inv"), lists=4)
    assert vix.knn_inverted_file(spark, path, [1.0] * 64).collect() == []
    assert vix.knn_codes(spark, vix.write_codes(none, scratch_path(spark, "codes")), [1.0] * 64).collect() == []


def test_sign_bits_pack_scan_and_recall(spark, points, matrix):
    path = vix.write_sign_bits(points, scratch_path(spark, "bits"), dim=64)
    row = spark.read.parquet(path).orderBy("id").filter("id >= 0").first()
    word = int("".join("1" if x > 0 else "0" for x in row["vector"]), 2)
    assert row["bits"] == [word - (1 << 64) if word >= 1 << 63 else word]
    assert _recall(lambda v: vix.knn_sign_bits(spark, path, v, 10, -1.0, oversampling=20.0), matrix) >= 0.9
    wide = spark.createDataFrame([(1, [1.0] * 70), (2, [-1.0] * 70), (3, [1.0, -1.0] * 35)], "id long, vector array<float>")
    path = vix.write_sign_bits(wide, scratch_path(spark, "bits"), dim=70)
    assert [r["id"] for r in vix.knn_sign_bits(spark, path, [1.0] * 70, 3, -1.0).collect()] == [1, 3, 2]
