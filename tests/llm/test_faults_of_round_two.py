"""Cases that lost or misplaced rows: slabs of items, items of one word, file names beyond five digits."""

from pyspark.sql import functions as F

from coordspark.llm.decontaminate import contaminated
from coordspark.llm.records_io import placed


def test_scores_do_not_depend_on_the_slabs(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(words[i:i + 8]) + "? " + " ".join(words[i + 8:i + 12 + i % 4])) for i in range(12)] + [(50, "xylophone"), (51, None), (52, "")]
    docs = [(100 + i, "start " + t + " end") for i, t in items[:12]] + [(200, "a xylophone here"), (201, "nothing"), (202, None)]
    items, docs = (spark.createDataFrame(r, s) for r, s in ((items, "item_id long, text string"), (docs, "doc_id long, text string")))
    found = lambda **kw: {(r[0], r[1], *(round(x, 5) for x in r[2:])) for r in contaminated(docs, items, least=0.1, percent=20, **kw).collect()}
    one = found()
    assert one == found(slab=2) == found(slab=5)  # weights are single-precision numbers
    assert {r[0] for r in one if r[1] == 50} == {200}
    assert {(100 + i, i) for i in range(12)} <= {r[:2] for r in one}
    assert contaminated(docs, items.filter("item_id > 50")).collect() == []


def test_starts_follow_the_documents_not_the_file_names(spark):
    rows = [("part-100000", 3, 0, 5), ("part-99999", 1, 0, 2), ("part-99999", 2, 2, 4), ("part-100001", 9, 0, 1), ("part-00000", None, 0, 7)]
    index = spark.createDataFrame(rows, "file string, doc_id long, local_start long, n_tokens long").withColumns(
        {"ids_crc32": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "size": F.lit(0).cast("long")})
    got = {r["doc_id"]: r["start"] for r in placed(index).collect()}
    assert got == {None: 0, 1: 7, 2: 9, 3: 13, 9: 18}
