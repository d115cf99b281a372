import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import ngrams
from tidemark.llm.ngrams import discounts, pack, score, train, unpack


def toks(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), None]


def brute(train_texts, text):
    uni, bi = Counter(), Counter()
    for t in train_texts:
        x = toks(t)
        uni.update(x)
        bi.update(zip(["<s>", *x], x))
    n, v = sum(uni.values()), len(uni)
    before, after, total = Counter(), defaultdict(Counter), Counter()
    for (a, b), c in bi.items():
        before[b] += 1
        after[a][min(c, 3)] += 1
        total[a] += c
    d = discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)])
    e = discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    cut = lambda c, d: 0 if c == 0 else d[min(c, 3) - 1]
    spare = sum(cut(c, e) for c in before.values()) / len(bi) if bi else 0
    base = s = 0.0
    x = toks(text)
    for a, b in zip(["<s>", *x], x):
        base += math.log10((uni[b] + 0.5) / (n + 0.5 * (v + 1)))
        p = (before[b] - cut(before[b], e)) / len(bi) + spare / (v + 1) if bi else 1 / (v + 1)
        if total[a]:
            p = (bi[a, b] - cut(bi[a, b], d)) / total[a] + sum(d[k - 1] * after[a][k] for k in (1, 2, 3)) / total[a] * p
        s += math.log10(p)
    return len(x), sum(uni[b] > 0 for b in x), base, s


@pytest.mark.parametrize("flush", [4_000_000, 50])
def test_against_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(ngrams, "FLUSH", flush)
    r = random.Random(2)
    voc = ["a", "B", "b", "Éa", "éa", "c,", "x" * 300] + [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(r.choices(voc, [1 / (i + 1) for i in range(len(voc))], k=n))
    known = [None, "", " \t", *[say(r.randint(1, 60)) for _ in range(60)], "a a a " * 2000]
    other = [None, "", "unseen words only", "w1 unseen a", *[say(20) for _ in range(10)]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(known)], "doc_id long, text string, n int").repartition(3)
    model = train(df)
    assert model.total == sum(len(toks(t)) for t in known)
    got = {x.row.doc_id: x for x in score(spark.createDataFrame(list(enumerate(other)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(other):
        n, k, base, s = brute(known, t)
        assert (got[i].n_tokens, got[i].n_known) == (n, k)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score == pytest.approx(s, rel=1e-9)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("a b c a b d",), ("b a c",), ("a b",)], "text string")
    m = train(df)
    end = int(m.numbers(np.array([ngrams.END]))[0])  # nothing follows an end
    for v in sorted({*range(m.size + 1), -1} - {end}):
        w = np.array([*range(m.size), -1])
        assert m.probabilities(np.full(len(w), v), w).sum() == pytest.approx(1)


def test_no_training_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    m = train(empty)
    got = score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), m).collect()[0]
    assert (got.n_tokens, got.n_known, m.total) == (3, 0, 0) and got.score == 0 and got.base_score == 0
    assert score(empty, m).collect() == []


def test_pack():
    for a in (np.arange(1000, dtype=np.uint32), np.zeros(0, np.int64), np.array([2**63], np.uint64)):
        assert (unpack(pack(a)) == a).all()
