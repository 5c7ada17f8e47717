"""Operators 11 to 13 against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coordspark.llm import midstate_tree as mt
from coordspark.llm import one_bit_search as ob
from coordspark.llm import spelling_bloom as sb


# --- spelling variants ---

def brute_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n):
    form, near_n = {}, {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        near_n[w] = len(near)
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], near_n[w], n[form[w]] if form[w] else None) for w in n}


def spelled(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def variants():
    rng = np.random.default_rng(5)
    base = ["colour", "color", "analyse", "analyze", "été", "naïve", "naive", "aaaaa", "aaaaaa", "aaaaaaa", "Straße", "ÀÉÎÕÜ×", "hello", "hallo", "hullo"]
    rows = []
    for i in range(300):
        picked = [base[k] for k in rng.integers(0, len(base), 12)]
        w = picked[0]
        picked.append(w[: i % len(w)] + "xé"[i % 2] + w[i % len(w) + 1 :])
        rows.append((i, ", ".join(picked) if i % 3 else " ".join(picked).upper()))
    rows += [(1000 + i, "kalender " * 40 + "kalendar " * (12 * (i % 2)) + "kolendar " * (3 * (i % 4 == 0))) for i in range(8)]
    return rows + [(None, "colours Colours COLOURS colours"), (7, None), (8, ""), (9, "q" * 3000), (9, "q" * 3000), (10, "q" * 3000), (11, "q" * 3001 + " " + " ".join(["q" * 3001] * 3))]


def test_spelling_groups_equal_brute_force(spark):
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).repartition(3)
    want = brute_groups(brute_counts(rows))
    assert len(want) > 50 and any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want)
    assert spelled(sb.spelling_groups(df)) == want
    # many parts and passes give the same
    assert spelled(sb.spelling_groups(df, part=4, most_bytes=150)) == want


def test_spelling_edges(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert spelled(sb.spelling_groups(edge)) == brute_groups(brute_counts(rows))
    assert sb.spelling_groups(empty).collect() == []


def test_bloom_filter_holds_its_words_and_few_others():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64 - 1, 50_000, dtype=np.uint64)
    bloom = sb.make_filter(h)
    assert len(sb.holds(bloom, h)) == len(h)
    assert len(sb.holds(bloom, rng.integers(0, 2**64 - 1, 200_000, dtype=np.uint64))) < 2_000


# --- nearest neighbours ---

def brute_nearest(rows, every, k):
    v = {}
    for i, x in rows:
        ok = i is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)
        if ok and (i not in v or list(x) < v[i]):
            v[i] = list(x)
    out = []
    for q in sorted(i for i in v if i % every == 0):
        others = [i for i in v if i != q and len(v[i]) == len(v[q])]
        if others:
            s = ob.cosines(np.array([v[q]] * len(others), float), np.array([v[i] for i in others], float))
            out += [(q, r, i, x) for r, (x, i) in enumerate(sorted(zip(-s, others, strict=True))[:k], 1) for x in [-x]]
    return out


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("dim", [64, 100])
def test_nearest_equal_brute_force_on_random_vectors(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(dim)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got, want = found(ob.nearest(df, 50, 5, block=700)), brute_nearest(rows, 50, 5)
    assert len({x[:3] for x in got} & {x[:3] for x in want}) >= 0.99 * len(want)
    score = {(r[0], r[2]): r[3] for r in want}
    assert all(score.get((r[0], r[2]), r[3]) == r[3] for r in got)


def test_error_bound_chooses_few_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((4000, 256))
    q = v[:20] + 0.3 * rng.standard_normal((20, 256))
    code, scale, spread = ob.encode(v)
    assert code.shape == (4000, 4) and (scale > 1).all()
    est = ob.Queries(q).estimates(0, 20, code, np.bitwise_count(code).sum(1, dtype=np.int64), scale)
    real = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    assert (np.abs(est - real) <= 3 * spread + 0.05).mean() > 0.99
    assert (est + 3 * spread >= real.max(1, keepdims=True)).mean() < 0.01


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (9, [inf, 0.0]),
            (10, [1.0, 2.0, 3.0]), (100, [3.0, 2.0, 1.0]), (None, [1.0, 0.0]), (2, [2.0, 2.0]), (3, [0.5, 0.1]), (-50, [-1.0, 0.0]), (150, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows]
    assert found(ob.nearest(df.withColumn("slot", F.lit("x")), 50, 3)) == brute_nearest(rows, 50, 3)
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(200)], "vec_id long, embedding array<float>")
    assert [r[2] for r in found(ob.nearest(same, 50, 5, block=30)) if r[0] == 50] == [0, 1, 2, 3, 4]
    assert found(ob.nearest(df.filter("false"))) == []


# --- manifest ---

def test_compress_is_sha256():
    import secrets

    texts = [secrets.token_hex(32) for _ in range(9)]
    digest = np.frombuffer(b"".join(bytes.fromhex(t) for t in texts), ">u4").reshape(-1, 8).T.astype(np.uint32)
    state = mt.start(9)
    for k in range(4):
        assert [x.hex() for x in mt._to_bytes(mt.finish(state, k))] == [hashlib.sha256((t * k).encode()).hexdigest() for t in texts]
        state = mt.compress(state, mt.hex_block(digest))


def brute_manifest(rows):
    H = lambda *p: hashlib.sha256("".join(p).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(field(r[0]), field(r[1]), field(r[2]), field(r[3]), field(text))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def fold(tree, at, x):
        passed = []
        for level in tree[:-1]:
            first = at // 8 * 8
            run = level[first : first + 8]
            k = at - first
            passed += run[:k] + run[k + 1 :]
            x, at = H(*run[:k], x, *run[k + 1 :]), at // 8
        return x, passed

    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    langs = sorted({r[2] for r in rows}, key=lambda s: b"" if s is None else b"=" + s.encode())
    docs = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for g in langs}
    trees = {g: levels([leaf(r, r[4]) for r in docs[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(docs[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            x, passed = fold(trees[g], i, leaf(r, lower(r[4]) if hit else r[4]))
            x, more = fold(top, k, x)
            out.append((r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], H(*passed, *more), x, x == top[-1][0]))
    return sorted(out, key=str)


def manifest(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in mt.merkle_manifest(df).collect()), key=str)


def test_manifest_equals_brute_force_over_more_than_one_page(spark):
    # one group above 8^4 leaves, so two rounds; eleven groups, so two levels above them
    rows = [(i * 7 % 9001, "s", "en" if i < 4700 else f"l{i % 10}" if i % 3 else "é", i, f"Text {i} É") for i in range(5300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifest(df) == brute_manifest(rows)


def test_manifest_edges(spark, edge, empty):
    rows = [tuple(r) for r in edge.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert manifest(edge) == brute_manifest(rows)
    assert manifest(empty) == []
    one = edge.filter("doc_id = 12")
    assert manifest(one) == brute_manifest([tuple(r) for r in one.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert manifest(one)[0][4] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name", ["op11_spelling_bloom", "op12_one_bit_search", "op13_midstate_manifest"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from coordspark.llm.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]}) AS q").fetchall()
    assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect())
