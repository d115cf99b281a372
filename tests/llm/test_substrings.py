import hashlib
import random
import re
import time
from collections import defaultdict

import pytest

from tidemark.llm.substrings import remove_repeated_windows


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(texts, n):
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        w = words(t)
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].append((d, i))
    gone = defaultdict(set)
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + n))
    out = []
    for d, t in enumerate(texts):
        w = words(t)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone[d])
        out.append((d, len(w), len(gone[d]), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, window):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(400)] + ["é", "straße", "a"]
    say = lambda n: [r.choice(voc) for _ in range(n)]
    passage, texts = say(window + 20), [None, "", "  \n\t ", "one two"]
    for _ in range(40):
        w = say(r.randint(1, 150))
        if r.random() < 0.5:
            i, a = r.randint(0, len(w)), r.randint(0, 15)
            w[i:i] = passage[a : a + r.randint(window - 3, window + 8)]
        texts.append(" ".join(w) if r.random() < 0.7 else "\n\t ".join(w))
    texts += [texts[10], texts[10], "x " * 300, "x " * (window - 1), "x " * window, "a b " * 100, " ".join(say(20000))]
    return texts


@pytest.mark.parametrize("window", [35, 2, 1, 8, 64])
def test_against_brute_force(spark, window):
    texts = corpus(window, window)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, rk string").repartition(3)
    out = remove_repeated_windows(df, window)
    got = sorted((r.row.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect())
    assert got == brute(texts, window)
    one = {r.row.doc_id: r for r in out.collect()}[10]
    if one.n_removed:
        w = words(texts[10])
        cut = {i for a, b in one.removed for i in range(a, b)}
        assert " ".join(x for i, x in enumerate(w) if i not in cut) == one.kept_text


def test_equal_rows_and_null_ids_and_empty(spark):
    t = " ".join(f"v{i}" for i in range(50))
    df = spark.createDataFrame([(None, t, None), (None, t, None), (1, t + " z", "q")], "doc_id long, text string, s string")
    got = sorted((r.n_words, r.n_removed) for r in remove_repeated_windows(df).collect())
    assert got == [(50, 50), (50, 50), (51, 50)]
    assert remove_repeated_windows(df.limit(0)).collect() == []


@pytest.mark.parametrize("base", [1, 4, 16, 32])
def test_any_first_level_gives_the_same(spark, base):
    texts = corpus(35, 35)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted((r.row.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_windows(df, 35, base=base).collect())
    assert got == brute(texts, 35)


def test_equal_rows_cost_as_much_as_different_ones(spark):
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(120)) for _ in range(8000)]

    def run(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        began = time.time()
        got = remove_repeated_windows(df).selectExpr("sum(n_words) AS w", "sum(n_removed) AS r").first()
        return got, time.time() - began

    run(list(enumerate(texts[:50])))
    (w, removed), apart = run(list(enumerate(texts)))
    assert (w, removed) == (960_000, 0)
    (w, removed), equal = run([(1, texts[0])] * 8000)
    assert (w, removed) == (960_000, 960_000) and equal < 2 * apart + 3


def test_clashing_names(spark):
    t = " ".join(f"v{i}" for i in range(50))
    df = spark.createDataFrame([(1, t, "a", 1, 2, t), (2, t, None, 1, 2, None)], "rk long, `my text` string, row string, n_words int, hits int, text string")
    got = remove_repeated_windows(df, text="my text").collect()
    assert [(x.row["rk"], x.row["row"], x.n_words, x.n_removed) for x in sorted(got, key=lambda x: x.row["rk"])] == [(1, "a", 50, 50), (2, None, 50, 50)]
