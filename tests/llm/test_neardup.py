import random
from collections import Counter

import numpy as np

from tidemark.llm.components import components
from tidemark.llm.neardup import near_duplicates, shingles, signatures
from tidemark.llm.words import Words

from .test_substrings import words


def bag(t, n=5):
    w = words(t)
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def sim(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(rows, threshold=0.8):
    label = {i: i for i, _ in rows}
    bags = {i: bag(t) for i, t in rows}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in bags.items():
        for j, b in bags.items():
            if i < j and a and b and sim(a, b) >= threshold:
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return {i: top(i) for i in label}


def test_classes_against_brute_force(spark):
    r = random.Random(5)
    voc = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "one two"), (5, "one  two"), (6, "x " * 100), (7, "x " * 110), (8, "x " * 150)]
    for _ in range(12):
        base = [r.choice(voc) for _ in range(r.randint(60, 200))]
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = r.choice(voc)
            rows.append((len(rows), " ".join(w)))
            if r.random() < 0.5:
                base = w
    rows.append((len(rows), " ".join(r.choice(voc) for _ in range(20000))))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, k int").repartition(3)
    got = {x.doc_id: x.class_id for x in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_group_around_the_threshold_against_brute_force(spark):
    r = random.Random(11)
    base = [f"b{i % 130}" for i in range(140)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5, 6])):
            w[r.randrange(len(w))] = r.choice([f"o{i}", "same", "other"])
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and 10 < len(set(want.values())) < 140


def test_repeated_rows_null_ids_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "q r"), (None, None)], "doc_id long, text string")
    got = sorted(((x.doc_id, x.class_id) for x in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (None, None)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_signatures_are_unbiased():
    r, errors = random.Random(1), []
    for case in range(12):
        a = Counter({f"s{i}": r.choice([1, 1, 2, 7, 40]) for i in range(60)})
        b = Counter({k: max(1, c + r.choice([0, 0, 1, -1, 9])) for k, c in a.items() if r.random() < 0.9})
        names = sorted(set(a) | set(b))
        h = Words(np.frombuffer(" ".join(names).encode(), np.uint8), np.array([0, len(" ".join(names))])).hashes
        d = np.array([0] * len(names) + [1] * len(names))
        c = np.array([a[k] for k in names] + [b[k] for k in names])
        keep = c > 0
        s = signatures(d[keep], np.concatenate([h, h])[keep], c[keep], 2, 2000)
        errors.append((s[0] == s[1]).mean() - sim(a, b))
    assert abs(np.mean(errors)) < 0.01 and max(map(abs, errors)) < 0.05


def test_shingle_counts():
    t = [b"a b c d e a b c d e a", b"", b"x y", b"p q r s t"]
    w = Words(np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)]))
    d, _, c = shingles(w)
    assert Counter(np.repeat(d, c).tolist()) == {0: 7, 2: 1, 3: 1} and sorted(c[d == 0]) == [1, 1, 1, 2, 2]


def test_components_of_a_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (200, 201)]
    got = {r.node: r.label for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
