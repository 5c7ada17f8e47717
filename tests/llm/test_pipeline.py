"""The pipeline's stages, one after the other, each against what its operator says of its own input."""

import corpus_pipeline
from coordspark.llm.common import written
from coordspark.session import table_path

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(table_path(SF, "documents"))
    columns, seen = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, SF), f"test-{name}")
        assert after.columns == columns and after.exceptAll(docs).count() == 0
        if name == "exact_dedup":
            best = {}
            for r in docs.collect():
                best[r.text] = max(best.get(r.text, -1), r.doc_id)
            assert sorted(r.doc_id for r in after.collect()) == sorted(best.values())
        docs = after
        seen.append(docs.count())
    assert all(a >= b for a, b in zip(seen, seen[1:])) and seen[-1] > 0.7 * seen[0]
    packed = written(corpus_pipeline.pack(spark, docs, SF), "test-pack")
    assert packed.select("doc_id").distinct().count() == seen[-1]


def test_nulls_and_clashing_columns(spark, edge, empty, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for start in (edge, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf), f"edge-{name}")
            if name != "pack":
                assert docs.columns == start.columns
        if start is empty:
            assert docs.count() == 0
