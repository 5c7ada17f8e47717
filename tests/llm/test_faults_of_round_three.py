"""What the driver's check of round three named: op1's and op3's CPU seconds."""

import random

import numpy as np
import pyarrow as pa

from coordspark.llm import suffix_family, toxicity_kn
from coordspark.llm.common import utf8
from coordspark.llm.words import ALNUM, BYTE, LOWER, MUL, mix, words


def test_words_equal_a_loop():
    r = random.Random(5)
    texts = ["".join(r.choice("abCD9é ._\n\0") for _ in range(r.randrange(60))) for _ in range(50)] + ["", "x" * 70_000]
    data, off = utf8(pa.array(texts))
    want = []
    for row, t in enumerate(texts):
        b = t.encode()
        s = 0
        while s < len(b):
            e = s
            while e < len(b) and ALNUM[b[e]]:
                e += 1
            if e > s:
                h = [sum(int(BYTE[LOWER[c]]) * pow(int(MUL[0]), k + 1, 1 << 64) for k, c in enumerate(b[s : min(e, s + n)])) % (1 << 64) for n in (1 << 30, 4)]
                h = mix(np.array(h, np.uint64))
                want.append((int(h[0]), row, s + int(off[row]), e + int(off[row]), int(h[1])))
            s = e + 1
    assert [*zip(*(x.tolist() for x in words(data, off, ALNUM, 4)))] == want


def test_ratios_are_worked_out_once_for_each_pair_of_a_block(monkeypatch):
    """op3: every word of every text was looked up and its ratio worked out anew, however often a block has it."""
    r, buckets = random.Random(4), 3
    texts = pa.table({"doc_id": pa.array(range(42), pa.int64()), "text": ["", None, *[" ".join(f"w{r.randrange(30)}" for _ in range(400)) for _ in range(40)]]})
    data, off = utf8(texts["text"])
    h, row, stem = toxicity_kn._tokens(data, off)
    before, pair = toxicity_kn._pairs(h, row)
    tables = []
    for kind, x in enumerate((pair, np.append(h, np.uint64(0)), stem)):
        x = np.unique(x)[::2]  # half of what the texts ask for is known
        values = np.array([[r.random() + 0.1 for _ in range(toxicity_kn.WIDTH[kind])] for _ in x])
        tables.append((x, (values * (4 if kind == toxicity_kn.PAIRS else 1)).astype(toxicity_kn.TYPE[kind])))
    fixed = {"cuts": np.float32([0.6, 0.7]), "word_left": np.float32([0.3, 0.4]), "no_stem": [0.5, 0.6], "window": 6}
    asked = toxicity_kn._ask(buckets)((pa.scalar(0),), texts)
    answers = []
    for k, bucket in enumerate(asked["bucket"].to_pylist()):
        known, values = tables[bucket // buckets]
        model = pa.table({"keys": [toxicity_kn.pack(known)], "vals": [toxicity_kn._planes(values)]})
        answers.append(toxicity_kn._answer(buckets)((pa.scalar(bucket),), model, asked.slice(k, 1)))
    counted, after = [], toxicity_kn.KneserNey.after
    monkeypatch.setattr(toxicity_kn.KneserNey, "after", lambda self, p, *more: counted.append(len(p)) or after(self, p, *more))
    got = toxicity_kn._features(fixed, buckets, ("doc_id",))((pa.scalar(0),), texts, pa.concat_tables(answers))
    assert counted == [len(np.unique(pair))] and counted[0] < len(h) / 10
    each = toxicity_kn.KneserNey(fixed, tables).ratios(h, row, stem)  # word by word
    want = np.zeros((len(texts), 4))
    for k, x in enumerate(each):
        for d in range(2, len(texts)):
            mine = x[row == d].astype(float)
            want[d, 2 * k] = mine.mean()
            want[d, 2 * k + 1] = max(mine[i : i + 6].sum() / 6 for i in range(len(mine)))
    assert got["doc_id"].to_pylist() == list(range(42))
    assert np.allclose(np.array(got["f"].to_pylist()), want, rtol=1e-5, atol=1e-6)


def test_anchors_are_found_without_a_pass_for_every_doubling(monkeypatch):
    """op1: each of four passes over the texts hashed its words in five rounds. Every string has its anchors, as by a loop."""
    rounds, comb = [], suffix_family.comb
    monkeypatch.setattr(suffix_family, "comb", lambda a, b, step=0: rounds.append(len(a)) or comb(a, b, step))
    r = random.Random(6)
    texts = ["".join(r.choice("abcé ") for _ in range(n)) for n in (300, 0, 49, 50, 51, 7, 700)] + ["ab" * 90, "\0" * 120, "\0" * 49, ""]
    data, off = utf8(pa.array(texts))
    b = suffix_family._Block(data, off)
    assert not [n for n in rounds if n > len(data) / 2]
    raw, rank, want, strings = data.tobytes(), {}, set(), {}
    for p, x in enumerate(b.rank.tolist()):
        assert rank.setdefault(raw[p : p + 24], x) == x and x  # equal words rank alike
    for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
        for p in range(i, j - 49):
            ranks = [rank[raw[q : q + 24]] for q in range(p, p + 27)]
            mine = [p + k for k, x in enumerate(ranks) if x == min(ranks)]
            want.update(mine)
            for q in mine:
                strings.setdefault(q, []).append(p)
    assert b.at.tolist() == sorted(want) and want
    first, last = b.span(b.at)
    assert [*zip(first.tolist(), last.tolist())] == [(strings[q][0], strings[q][-1]) for q in sorted(want)]
