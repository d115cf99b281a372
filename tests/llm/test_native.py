"""Rules, licences, mixing and the pipeline against plain versions."""

import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.hostrules import host_rules
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.mixing import capped_targets, flow, mix, mix_by_weight, with_sizes

from .test_substrings import words


def rules(t):
    t, w = t or "", words(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_rules_against_brute_force(spark):
    r = random.Random(6)
    rows = [(None, None, "a"), (1, "", "a"), (2, "a b c d e " * 4000, None), (3, "é#\n\n \t\né#\nx\x0b\x0cy", "b"), (3, "é#\n\n \t\né#\nx\x0b\x0cy", "b")]
    for i in range(60):
        n = r.choice([3, 12, 60])
        rows.append((10 + i, r.choice([" ", "\n"]).join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(n)), r.choice(["a", "bad"]) if n > 3 else "bad"))
    rows += [(1000 + i, "x", "bad") for i in range(300)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, n_words int")
    for carry in (None, ["doc_id", "text", "source"]):
        got = host_rules(df, carry=carry).collect()
        assert len(got) == len(rows)
        for g in got:
            n, *_, repeat = want = rules(g.row.text)
            assert tuple(g.rule) == want
            assert g.base_failed == (n < 10 or 100 * repeat > 20 * n)
            assert g.kept == (not g.base_failed and g.row.source != "bad")
    assert host_rules(df.limit(0)).collect() == []


def test_a_host_somewhat_worse_than_the_rest_fails(spark):
    good, bad = " ".join(f"w{i}" for i in range(12)), "x"
    rows = [(good if i % 100 >= share else bad, f"h{h}") for h, (n, share) in enumerate([(2000, 8), (2000, 9), (2000, 10), (1500, 20), (1500, 12), (5, 2), (6000, 9)]) for i in range(n)]
    df = spark.createDataFrame([(i, t, s, "x") for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string, kept string")
    got = host_rules(df).groupBy("row.source").agg(F.first("host_failed").alias("failed"), F.count_if("kept").alias("kept"), F.count_if("base_failed").alias("base"), F.count("*").alias("n")).collect()
    # h3 fails at twice the rate and takes 1200 good rows with it; h4 is worse but not enough, h5 too small to tell
    assert {x.source for x in got if x.failed} == {"h3"}
    assert all(x.kept == (0 if x.failed else x.n - x.base) for x in got) and sum(x.n - x.base for x in got if x.failed) == 1200


def test_licences_and_inheritance(spark):
    rows = [
        ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "MIT", "MIT"),
        ("a/b/x.txt", "plain words\nno notice", None, "MIT"),
        ("a/b/y.txt", "Intro words here. Licensed under the Apache License, Version 2.0. " + "More. " * 30, "Apache-2.0", "Apache-2.0"),
        ("a/c/COPYING", "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", "GPL-3.0"),
        ("a/c/d/e.txt", None, None, "GPL-3.0"), ("z/q.txt", "", None, None), (None, "x", None, None), ("top.txt", "w " * 60000 + "\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", "CC-BY-NC-4.0"),
        ("ab/x.txt", "copyright is a word of its own", None, None), ("z/q.txt", "", None, None),
    ]
    df = spark.createDataFrame([(p, t, "x") for p, t, _, _ in rows], "path string, text string, license string")
    got = Counter((g.path, g.own_license, g.license) for g in scan_licenses(df).collect())
    assert got == Counter((p, o, f) for p, _, o, f in rows)
    assert scan_licenses(df.limit(0)).collect() == []


def test_licence_headers_over_lines(spark):
    gnu = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\nimport os\n"
    name = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    end = "\n\n" + "Terms go here. " * 50 + "\n\nEND OF TERMS AND CONDITIONS\n"
    rows = [(f"s/{i}.py", f"// SPDX-License-Identifier: {x}\ncode()", want) for i, (x, want) in enumerate([("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-or-later", "GPL-3.0"), ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"), ("EPL-2.0", "EPL-2.0"), ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0"), ("(mit OR Apache-2.0)", "Apache-2.0")])]
    rows += [("g3/a.py", gnu.format(3), "GPL-3.0"), ("g2/a.py", gnu.format(2), "GPL-2.0"), ("l3/a.py", gnu.format(3).replace("GNU General", "GNU Lesser General"), "LGPL-3.0")]
    rows += [("b/a.txt", name, "BSD-3-Clause"), ("m/a.txt", "MIT License\n\nCopyright (c) 2020 A B\n\n" + grant, "MIT")]
    rows += [("t/COPYING", "   GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", "GPL-3.0"), ("t/u/x", "words", None), ("v/COPYING", "GNU GENERAL PUBLIC LICENSE\n\nVersion 3, 29 June 2007" + end, "GPL-3.0")]
    rows += [("w/terms.txt", "Apache License\nVersion 2.0, January 2004" + end, "Apache-2.0"), ("w/x", "words", None), ("p/a.txt", "The licence of a poet is\nto bend words as one\nlikes, copyright or not.", None)]
    got = {g.path: (g.own_license, g.license) for g in scan_licenses(spark.createDataFrame([(p, t) for p, t, _ in rows], "path string, text string")).collect()}
    assert {p: o for p, (o, _) in got.items()} == {p: o for p, _, o in rows}
    assert got["t/u/x"][1] == "GPL-3.0" and got["w/x"][1] == "Apache-2.0"


def test_targets_and_flow():
    assert capped_targets({"a": 10, "b": 100}, {"a": 3, "b": 1}, 165, 2) == {"a": 20.0, "b": 145.0}
    sent = flow({("x",): 10, ("x", "y"): 10, ("y",): 5}, {"x": 18, "y": 12}, 2)
    assert sum(n for (_, s), n in sent.items() if s == "x") == 18 and sum(n for (_, s), n in sent.items() if s == "y") == 12
    use = Counter()
    for (p, _), n in sent.items():
        use[p] += n
    assert sum(max(0, n - {("x",): 10, ("x", "y"): 10, ("y",): 5}[p]) for p, n in use.items()) == 5  # 30 wanted of 25


def best_flow(patterns, quotas, epochs):
    """(most words, least repetition cost) over all flows, by trying them."""
    names, sources = sorted(patterns), sorted(quotas)
    edges = [(p, s) for p in names for s in p]
    best = (0, 0)

    def go(i, sent, left):
        nonlocal best
        if i == len(edges):
            use = Counter()
            for (p, _), n in sent.items():
                use[p] += n
            cost = sum(sum(max(0, n - e * patterns[p]) for e in range(1, epochs)) for p, n in use.items())
            best = max(best, (sum(use.values()), -cost))
            return
        p, s = edges[i]
        used = sum(n for (q, _), n in sent.items() if q == p)
        for n in range(min(left[s], epochs * patterns[p] - used) + 1):
            go(i + 1, {**sent, (p, s): n}, {**left, s: left[s] - n})

    go(0, {}, {s: quotas[s] for s in sources})
    return best


def test_flow_is_the_cheapest_of_the_largest():
    r = random.Random(12)
    for _ in range(40):
        kinds = r.sample([("x",), ("y",), ("z",), ("x", "y"), ("y", "z"), ("x", "y", "z")], 3)
        patterns = {k: r.randint(0, 3) for k in kinds}
        quotas = {s: r.randint(0, 4) for s in "xyz"}
        sent, use = flow(patterns, quotas, 3), Counter()
        for (p, s), n in sent.items():
            assert n > 0 and s in p
            use[p] += n
        assert all(sum(n for (_, s), n in sent.items() if s == q) <= quotas[q] for q in quotas) and all(use[p] <= 3 * n for p, n in patterns.items())
        cost = sum(sum(max(0, n - e * patterns[p]) for e in (1, 2)) for p, n in use.items())
        assert (sum(use.values()), -cost) == best_flow(patterns, quotas, 3)
    began = time.time()
    many = {(f"s{i}",): 10 for i in range(100_000)}
    assert sum(flow(many, {s: 15 for (s,) in many}, 2).values()) == 1_500_000 and time.time() - began < 20


def test_mix_of_null_ids_and_ties(spark):
    rows = [(None, f"w{i % 9} " * (i % 4), "a") for i in range(60)] + [(5, f"t{i} t", "a") for i in range(6)] + [(5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = lambda d: sorted((x.row.doc_id or 0, x.row.text or "", x.taken) for x in mix_by_weight(d).collect())
    assert told(df) == told(df.repartition(7)) and len(told(df)) == 67


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randint(0, 50), r.choice(["a", "b", "c", "d", None]), 0) for i in range(300)] + [(7, "w " * 9, "a", 0), (None, None, "b", 0), (5000, "w " * 20000, "c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)
    got = mix_by_weight(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix_by_weight(df.repartition(2)).collect()))
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for g in got:
        s = g.row.source
        assert g.size == len(words(g.row.text)) and 0 <= g.taken <= 2 * g.size
        size[s] += g.size
        taken[s] += g.taken
        target[s] = g.target
    w = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    want = capped_targets(size, w, 1.5 * sum(size.values()), 2)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    assert mix_by_weight(df.limit(0)).collect() == []


def test_mix_with_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, (["x"], ["x", "y"], ["y"], [])[i % 4]) for i in range(80)], "doc_id long, text string, of array<string>")
    rows = with_sizes(df).withColumn("members", F.col("row.of"))
    got = mix(rows, "members", lambda sizes: {"x": 350, "y": 240}).collect()
    sums = Counter()
    for g in got:
        assert g.taken == sum(x.taken for x in g.routes) and {x.source for x in g.routes} <= set(g.row["of"])
        for x in g.routes:
            sums[x.source] += x.taken
    assert sums == {"x": 350, "y": 240}


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(9)
    voc = [f"v{i}" for i in range(900)]
    say = lambda n: [r.choice(voc) for _ in range(n)]
    item, passage = say(30), say(60)
    clean = {i: say(r.randint(40, 120)) for i in range(40)}
    rows = [(i, " ".join(w), "en", f"s{i % 3}") for i, w in clean.items()]
    rows += [(100, rows[3][1], "en", "s0"), (101, " ".join([*clean[4][:-1], "other"]), "en", "s1"), (102, "a b", "en", "s0"), (103, " ".join(say(20) + item + say(20)), "en", "s0")]
    rows += [(104, " ".join(say(50) + passage + say(50)), "en", "s1"), (105, " ".join(say(50) + passage + say(50)), "en", "s2"), (106, None, "en", "s0"), (107, "z " * 50, "en", "s0")]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({x.doc_id: x for x in docs.collect()})
    kept = set(clean)
    assert set(seen[0]) == kept | {100, 101, 103, 104, 105}
    assert set(seen[1]) == kept | {103, 104, 105}
    assert set(seen[2]) == set(seen[1]) and all(len(words(seen[2][i].text)) == 100 for i in (104, 105))
    assert all(seen[2][i].text == " ".join(w) for i, w in clean.items())
    assert set(seen[3]) == kept | {104, 105}
    assert set(seen[4]) <= set(seen[3]) and all(x.taken <= 2 * x.size for x in seen[4].values())
    assert re.search("taken", str(docs.columns))
    assert {x.doc_id: x.taken for x in pipeline.run(spark, str(tmp_path)).collect()} == {i: x.taken for i, x in seen[4].items()}
