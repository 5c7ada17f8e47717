"""Hybrid search and quarantine of segments against brute force."""

import math

from pyspark.sql import functions as F

from coordspark.operators import codec, hybrid


def test_bm25_and_fusion_equal_brute_force(spark):
    texts = {1: "red apple red", 2: "green apple pie", 3: None, 4: "", 5: "pie pie pie pie", 6: "Red car", 7: "red apple red"}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "id long, text string")
    path = hybrid.text_index(df)
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)

    def score(i, q):
        s = 0.0
        for t in q:
            n = sum(t in w for w in words.values())
            tf = words[i].count(t)
            s += math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) if tf else 0
        return s

    q = ["red", "pie", "absent"]
    want = sorted((-round(score(i, q), 9), i) for i in texts if score(i, q) > 0)
    got = hybrid.bm25(spark, path, [*q, "red", ""], 10).orderBy("rank").collect()
    assert [(-r["score"], r["id"]) for r in got] == want
    assert hybrid.bm25(spark, path, ["nowhere"], 5).collect() == [] and hybrid.bm25(spark, path, [], 5).collect() == []
    plan = hybrid.bm25(spark, path, ["red"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    near = hybrid.ranked(spark.createDataFrame([(6, 0.9), (4, 0.8), (5, 0.8)], "id long, score double"), 2)
    fused = {r["id"]: (r["word_rank"], r["vector_rank"], r["score"]) for r in hybrid.fuse(hybrid.ranked(
        spark.createDataFrame([(5, 2.0), (6, 1.0)], "id long, score double"), 5), near, 10).collect()}
    assert fused == {6: (2, 1, 1 / 62 + 1 / 61), 5: (1, None, 1 / 61), 4: (None, 2, 1 / 62)}


def test_quarantine_keeps_every_segment_once(spark, tmp_path):
    rows = [(1, "m", "1^2*ok|junk|^*x|a^1*v|1^b*v| |1^2*multi\nline"), (2, "m", None), (3, "m", "")]
    enc = spark.createDataFrame(rows, "record_id long, model_name string, encoded_string string")
    good, bad, counts = codec.quarantine_segments(enc, str(tmp_path / "q"))
    assert counts == {"good": 2, "malformed": 4}
    assert [(r["pos"], r["seg"]) for r in good.orderBy("pos").collect()] == [(0, "1^2*ok"), (6, "1^2*multi\nline")]
    assert [(r["pos"], r["reason"]) for r in bad.orderBy("pos").collect()] == [
        (1, "no value separator"), (2, "model id is not a number"), (3, "model id is not a number"), (4, "field id is not a number")]
    fine = enc.select("record_id", "model_name", F.lit("1^2*a").alias("encoded_string"))
    assert codec.quarantine_segments(fine, str(tmp_path / "fine"))[1].collect() == []
