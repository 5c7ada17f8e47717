"""Suffix family, Grace dedup and the MinHash join against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coordspark.llm import minhash_join, suffix_family
from coordspark.llm.common import pack, unpack, utf8
from coordspark.llm.grace_dedup import OpenTable, grace_dedup
from coordspark.llm.suffix_family import remove_repeats
from coordspark.llm.words import shingles

LAST = 2**63 - 1


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        b, k = (t or "").encode(), LAST if i is None else i
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, LAST), k)
    out = []
    for i, t in rows:
        b, k = (t or "").encode(), LAST if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for q in range(len(b)) if gone[q] and (not q or not gone[q - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def random_passages(seed, n=120):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcé ") for _ in range(r.randint(20, 300))) for _ in range(8)] + ["a" * 120, "ab" * 80, ""]

    def piece():
        s = r.choice(pool)
        return s[r.randint(0, len(s) // 2) :][: r.randint(1, 300)]

    return [(None if r.random() < 0.03 else i // (1 + (r.random() < 0.05)), None if r.random() < 0.05 else "".join(piece() for _ in range(r.randint(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("seed,params", [(1, {}), (2, {"chunk_bytes": 4000, "range_words": 300, "batches": 7})])
def test_repeats_equal_brute_force(spark, seed, params):
    rows = random_passages(seed)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **params).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows)


def test_repeats_edges(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert sorted(map(tuple, remove_repeats(edge).collect()), key=repr) == brute_repeats(rows)
    assert remove_repeats(empty).count() == 0


def test_family_merges_equal_sizes(spark, monkeypatch):
    sizes = []
    add = suffix_family.SuffixFamily.add
    monkeypatch.setattr(suffix_family.SuffixFamily, "add", lambda self, b: (add(self, b), sizes.append(sorted(self.levels)))[0])
    remove_repeats(spark.createDataFrame(random_passages(3, 40), "doc_id long, text string"), batches=5).count()
    assert sizes == [[1], [2], [1, 2], [4], [1, 4]]


def test_packed_arrays_round_trip():
    a = np.sort(np.random.default_rng(1).integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    assert (unpack(pack(a)) == a).all() and len(unpack(pack(a[:0]))) == 0


def check_exact(df):
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = []
    for i, t in rows:
        keep = max((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    for params in ({}, {"bucket_bytes": 40}):
        assert sorted(map(tuple, grace_dedup(df, **params).collect()), key=repr) == sorted(want, key=repr)


def test_grace_dedup_equals_brute_force(edge, empty):
    check_exact(edge)
    assert grace_dedup(empty).count() == 0


def test_grace_dedup_splits_buckets_and_hot_texts(spark):
    check_exact(spark.createDataFrame([(i, f"text {i % 200}" if i % 3 else "hot") for i in range(1500)], "doc_id long, text string").repartition(6))


def test_open_table_compares_contents():
    t = OpenTable(4)
    assert [t.entry(5, "a"), t.entry(5, "b"), t.entry(5, "a"), t.entry(21, "a")] == [0, 1, 0, 2]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def set_of(text):
    w = words_of(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: set_of(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_near(df, **params):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute_components([x for x in rows if x[0] is not None])
    got = minhash_join.minhash_dedup(df, **params).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_copies_of_one_text(spark):
    """A large group whose members are linked by chains: each copy changes some words of the base."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"common line of many words here {' '.join(f'y{i}_{k}' for k in range(30))}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check_near(df)
    check_near(df, rounds=0, block=16 * 2500)  # about 16 members


def test_near_edges(edge, empty):
    check_near(edge)
    assert minhash_join.minhash_dedup(empty).count() == 0


def test_intersections_as_matrix_products():
    r = np.random.default_rng(2)
    xs, ys = ([np.unique(r.integers(0, 60, n)).astype("<u8") for n in r.integers(0, 40, 9)] for _ in range(2))
    got = minhash_join._common(xs, ys, width=7)
    assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(xs) for j, y in enumerate(ys))
    got = minhash_join._common(xs, None, width=7)
    assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(xs) for j, y in enumerate(xs) if i != j)


def test_members_of_many_hot_lists_meet_in_one(spark):
    """Unlinked members that share 40 lists are compared in the longest; the other lists add those of other homes only."""
    join = object.__new__(minhash_join.MinHashJoin)
    join.block, n = 8 << 20, 300
    lists = [(p, i, i) for p in range(40) for i in range(n)] + [(0, n, n), (1, n + 1, n + 1)]
    at = spark.createDataFrame(lists, "post long, id long, comp long")
    sets = spark.createDataFrame([(i, 60) for i in range(n + 2)], "id long, n long")
    homes = join.homes(at)
    assert {r["id"] for r in homes.collect()} == set(range(n + 2))
    mine = at.join(homes, "id").filter("post = home").withColumn("same", F.col("comp"))
    assert join.blocks(mine.drop("home"), sets).count() <= 2 * (n + 2)
    rest = join.blocks(at.join(homes.withColumnRenamed("home", "same"), "id"), sets)
    assert rest.select("post").distinct().count() <= 2 and rest.count() <= 2 * 2 * (n + 1)


def test_shingles_of_short_and_mixed_texts():
    r = random.Random(5)
    texts = ["".join(r.choice("aB c\n.é") for _ in range(r.randint(0, 14))) for _ in range(300)]
    row, _ = shingles(*utf8(pa.array(texts)))
    assert all((row == k).sum() == len(set_of(t)) for k, t in enumerate(texts))
