import pytest
from pyspark.sql import functions as F

CLASHING = ("h", "g", "chunk", "id", "sig", "n", "shard", "score", "rid", "keep", "kept", "piece", "size", "row", "y", "fit", "bucket", "node", "w", "post", "range", "grp", "rank", "lang_pred")


def frame(spark, rows):
    """documents with (doc_id, text, lang), and columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")} | {c: F.lit("x") for c in CLASHING})


def edge_rows():
    words = [f"w{i * 7919 % 5003}" for i in range(20_000)]
    base = " ".join(words[:40])
    long = " ".join(words)
    return [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, base.replace("w7919", "other") if "w7919" in base else base + " tail", None), (4, None, "en"), (5, "", "fr"), (6, " \t\n ", "fr"),
        (7, long, "en"), (8, long, "de"), (9, long + " end", "de"), (10, "one two", "en"), (11, "ONE two", "en"), (12, "été à côté", "fr"), (13, "\n".join(["same line"] * 30), "en"),
        (None, base, "en"), (None, None, None), (14, "日本語 text <|endoftext|> x", None), (15, "A" * 3000, "xx"), (16, "A" * 3000, "xx"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, edge_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(edge):
    return edge.filter("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2 if i != 7 else None) for i in range(1, 17)] + [(None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
