"""Scores against brute force and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from coordspark.llm import line_crf
from coordspark.llm.common import utf8
from coordspark.llm.cross_parse import Automaton, language_id, phrases
from coordspark.llm.decontaminate import ItemIndex, contaminated
from coordspark.llm.learning import fold
from coordspark.llm.line_crf import quality
from coordspark.llm.toxicity_kn import STEM, toxicity, train, without_toxic
from coordspark.llm.words import ALNUM
from coordspark.llm.words import words as hashed
from coordspark.session import table_path

SF = "/root/testdata/sf0.1"


def tables(spark):
    return spark.read.parquet(table_path(SF, "documents")), spark.read.parquet(table_path(SF, "labels"))


def auc(rows, label):
    pos, neg = ([r["score"] for r in rows if r[label] == c] for c in (1, 0))
    return np.mean([[(a > b) + (a == b) / 2 for b in neg] for a in pos])


def test_fold_is_crc32_of_the_decimal_text(spark):
    import zlib

    got = spark.range(-5, 200).select(F.col("id").alias("doc_id")).select("doc_id", fold(3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 3 for r in got)


def check_scores(df, n):
    rows = df.collect()
    assert len(rows) == n
    for r in rows:
        assert r.held_out is not None and 0 <= r.score <= 1 and r.predicted in (0, 1)
    return rows


def test_toxicity_held_out(spark):
    docs, labels = tables(spark)
    rows = toxicity(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert auc(rows, "toxic") > 0.9
    wrong = [r for r in rows if r.toxic == 0 and r.predicted == 1]
    assert len(wrong) < 0.04 * len(rows)


def test_quality_held_out(spark):
    docs, labels = tables(spark)
    rows = quality(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert auc(rows, "quality") > 0.99
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98


def test_scores_of_edges(edge, empty, labels):
    for f in (toxicity, quality):
        rows = check_scores(f(edge, labels), edge.count())
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, set()).add(round(r.score, 9))
        assert len(by[2]) == 1 and len(by[15] | by[16]) == 1
        check_scores(f(edge, labels.filter("false")), edge.count())
        assert f(empty, labels).count() == 0
    kept = without_toxic(edge, labels)
    assert kept.columns == edge.columns


def test_crf_messages_equal_enumeration():
    r = np.random.default_rng(1)
    for n in (1, 2, 5):
        u, trans = r.normal(size=n), r.normal(size=(2, 2))
        fwd, back = line_crf.messages(u, np.zeros(n, np.int64), 1, trans)
        weight = np.zeros((n, 2))
        for path in np.ndindex(*[2] * n):
            p = np.exp(sum(u[k] * y for k, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            for k, y in enumerate(path):
                weight[k, y] += p
        assert np.allclose(fwd + back, np.log(weight[:, 1] / weight[:, 0]))


def test_lines():
    texts = ["a\nb", "", "\n", "x", "end\n"]
    row, start, end = line_crf.lines(*utf8(pa.array(texts)))
    data = "".join(texts)
    assert [(int(k), data[s:e]) for k, s, e in zip(row, start, end)] == [(k, x) for k, t in enumerate(texts) for x in t.split("\n")]


def test_phrases_equal_brute_force():
    def brute(texts, x):
        i = n = 0
        while i < len(x):
            k = 1
            while i + k <= len(x) and any(x[i : i + k] in t for t in texts):
                k += 1
            i, n = i + max(1, k - 1), n + 1
        return n

    r = random.Random(1)
    for _ in range(100):
        texts = [bytes(r.choice([0, 1, 2, 3]) for _ in range(r.randint(0, 30))) for _ in range(3)]
        xs = [bytes(r.choice([0, 1, 2, 3, 4]) for _ in range(r.randint(0, 40))) for _ in range(5)]
        at = np.cumsum([0] + [len(x) for x in xs])
        assert phrases(Automaton(texts).table, np.frombuffer(b"".join(xs), np.uint8), at[:-1], at[1:]).tolist() == [brute(texts, x) for x in xs]


def test_language_held_out(spark):
    docs, _ = tables(spark)
    rows = language_id(docs).filter("held_out").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("n_chars >= 100").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_language_edges(edge, empty):
    rows = language_id(edge, shortest=1).collect()
    assert len(rows) == edge.count()
    pred = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert pred[4] == pred[5] == pred[6] == ("und", 0.0) and all(0 <= s <= 1 for _, s in pred.values())
    assert all(r.lang_pred == "und" for r in language_id(edge.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert language_id(empty).count() == 0


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_leaks_equal_containment(spark):
    docs, _ = tables(spark)
    items = spark.read.parquet(table_path(SF, "benchmark"))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    texts = [(r.item_id, f" {' '.join(words(r.text))} ") for r in items.collect()]
    want = set()
    for r in docs.select("doc_id", "text").collect():
        own = f" {' '.join(words(r.text))} "
        want |= {(r.doc_id, i) for i, t in texts if t in own}
    assert got == want


def test_leaks_edges(spark, edge, empty):
    item = [f"w{i * 7919 % 5003}" for i in range(20_000)]
    items = spark.createDataFrame([(1, " ".join(item[:30])), (2, None), (3, ""), (4, "ONE  two"), (5, " ".join(item[15_000:15_060])), (5, " ".join(item[15_000:15_060])), (6, "nothing like it at all here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(edge, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1), (7, 1), (8, 1), (9, 1), (10, 4), (11, 4), (7, 5), (8, 5), (9, 5)}
    assert {(r.doc_id, r.item_id) for r in contaminated(edge, items, slab=2).collect()} == got
    assert contaminated(empty, items).count() == 0 and contaminated(edge, items.filter("false")).count() == 0


def test_block_maxima_lose_nothing():
    r = random.Random(4)
    texts = [" ".join(f"t{r.randrange(40)}" for _ in range(r.randint(1, 12))) for _ in range(60)]
    index = ItemIndex(list(range(60)), texts)
    term = np.array(sorted({r.randrange(len(index.terms)) for _ in range(25)}))
    got = {(i, round(s, 4)) for _, i, s in index.search(term, np.zeros(len(term), np.int64), 1, 0.5)}
    full = {}
    for lo, used, weight, _ in index.blocks:
        for t, row in zip(used, weight):
            if t in term:
                for k, x in enumerate(row):
                    full[lo + k] = full.get(lo + k, 0) + float(x)
    assert got == {(i, round(s, 4)) for i, s in full.items() if s >= 0.5}


def test_toxicity_counts_are_exact_in_a_large_vocabulary(spark):
    """Words that no training document has are all alike, and the counts are those of a dictionary, however many words there are."""
    r = random.Random(3)
    texts = [" ".join(f"{r.randrange(16**5):05x}" for _ in range(800)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, " ".join(f"q{i}z{k}" for k in range(4000))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = train(docs, labels, F.lit(False), 3000, 3.0, 6)[0].value
    probe = " ".join(f"_{i:x}_Z{i * 7919}Y" for i in range(1, 20_000, 2)).replace("_", "X")
    h, row, _, _, stem = hashed(*utf8(pa.array([probe])), ALNUM, STEM)
    for ratio in model.ratios(h, row, stem):
        assert np.ptp(ratio[1:]) < 1e-6
    fit = {x.doc_id for x in docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).collect()}
    own = [Counter(p for i, t in enumerate(texts) if i % 2 == c and i not in fit for p in {*zip(["", *t.split()], t.split())}) for c in (0, 1)]
    pairs = {*own[0], *own[1]}
    every = Counter(w for _, t in rows for w in t.split())
    total, known = sum(every.values()), {w for _, w in pairs}
    assert len(model.pairs) == len(pairs) and len(model.words) == len(known) + 1  # the start of a text
    assert np.allclose(np.sort(model.shared[:-1]), np.sort([0.0, *(every[w] / total for w in known)]))
    assert [int(x.sum()) for x in model.pair] == [sum(x.values()) for x in own]


def test_toxic_line_of_words_used_before(spark):
    """A line near the end of a long text counts, though each of its words stood there before, harmlessly."""
    r = random.Random(5)

    def clean(n):
        return " ".join(f"w{(k * 7 + j) % 40}" for k in r.sample(range(400), n) for j in range(5))

    line = "w3 w17 w30 w8 w22 w11 w35"
    rows = [(i, clean(8) + (f" {line} " + clean(4) if i % 2 else "")) for i in range(200)]
    long = clean(300)
    rows += [(1000, long), (1001, f"{long} {line} {clean(2)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity(docs, labels).collect()}
    assert (got[1000], got[1001]) == (0, 1)


def test_rare_toxic_pairs_are_evidence(spark):
    """Discounts lie between 0 and 1: a pair that two toxic training documents hold speaks for itself."""
    r = random.Random(6)
    docs = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(60))) for i in range(400)]
    docs = spark.createDataFrame(docs + [(1000 + i, f"w1 rare{i // 2}x odd{i // 2}y w2") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1000 + i, 1) for i in range(40)], "doc_id long, toxic int")
    fit = {x.doc_id for x in docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).collect()}
    k = next(i // 2 for i in range(0, 40, 2) if not {1000 + i, 1001 + i} & fit)
    h, row, _, _, stem = hashed(*utf8(pa.array([f"rare{k}x odd{k}y", f"odd{k}y rare{k}x"])), ALNUM, STEM)
    model = train(docs, labels, F.lit(False), 3000, None, 6)[0].value
    assert ((0 < model.cuts) & (model.cuts < 1)).all()
    after, alone = model.ratios(h, row, stem)
    assert after[1] > alone[1] + 0.5 and after[1] > after[3] + 0.5


def test_toxicity_recall_by_language(spark):
    docs, labels = tables(spark)
    rows = toxicity(docs, labels).filter("held_out").join(labels.filter("toxic = 1"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        assert np.mean([r.predicted for r in rows if r.lang == lang]) > 0.4


def test_languages_of_short_or_long_documents_are_learned(spark):
    r = random.Random(7)

    def text(letters, n):
        return " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))

    kinds = {"ab": ("abcdef", 10), "gh": ("ghijkl", 200), "mn": ("mnopqr", 1500)}  # under 500, 500 to 3,000, over 3,000 bytes
    rows = [(100 * k + i, text(*kinds[lang]), lang) for k, lang in enumerate(kinds) for i in range(40)]
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {x.doc_id: x.lang_pred for x in got} == {i: lang for i, _, lang in rows}


def test_texts_without_a_letter_are_und(spark):
    odd = ["\U0001f600 \U0001f389", "\u201c\u2026\u201d \u2013 \u2014", "\u3001\u3002\u300c\u300d", "\u00a0\u00a0", "\u0661\u0662\u0663", "123 456", "?!"]
    real = ["\u65e5\u672c", "\u00e9", "\U00020000"]
    rows = [(i, x, None) for i, x in enumerate(odd + real)] + [(100 + i, "some words to learn from " * 30, "en") for i in range(20)]
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(len(odd)))
    assert all(got[i][0] == "en" for i in range(len(odd), len(odd + real)))


def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch):
    """pairs were counted in 3000 documents of a label at most, and in none of more than 64 KB."""
    from coordspark.llm import toxicity_kn

    taken = []

    def spy(*args):
        rows = training_rows(*args)
        taken.append({(r["doc_id"], r["y"]) for r in rows.select("doc_id", "y").collect()})
        return rows

    training_rows = toxicity_kn.training_rows
    monkeypatch.setattr(toxicity_kn, "training_rows", spy)
    texts = [(i, f"calm w{i} talk") for i in range(3100)] + [(i, "vile " * 20000) for i in range(3100, 3110)] + [(9000, "no label"), (9002, None)]
    marks = [(i, int(i >= 3100)) for i in range(3110)] + [(9001, 1), (9000, None), (9002, 1)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity(docs, labels, folds=1, held_fold=1).collect()}
    assert taken == [{(i, int(i >= 3100)) for i in range(3110)}]
    assert len(scores) == 3112 and min(scores[i] for i in range(3100, 3110)) > max(scores[i] for i in range(3100))


def test_toxicity_asks_a_model_dealt_into_buckets(spark, monkeypatch):
    """The model went whole through the driver to every task. Many buckets, blocks and parts give the scores of one."""
    from coordspark.llm import toxicity_kn

    r = random.Random(8)
    rows = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(40)) + (" vile line here" if i % 2 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows + [(None, "w1 w2 vile line here"), (500, None), (501, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")

    def scores():
        return {x.doc_id: x.score for x in toxicity(docs, labels).collect()}

    one = scores()
    monkeypatch.setattr(toxicity_kn.Model, "value", None)
    for name, small in (("BLOCK", 2000), ("BUCKET_PAIRS", 900), ("PASS", 14_000)):
        monkeypatch.setattr(toxicity_kn, name, small)
    many, kept = scores(), {x.doc_id for x in without_toxic(docs, labels).collect()}
    assert many.keys() == one.keys() and len(one) == 123 and all(abs(many[i] - one[i]) < 1e-9 for i in one)
    assert kept == {i for i, x in one.items() if x < 0.7}
