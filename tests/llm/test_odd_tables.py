"""Every operator and stage on string ids, nulls, repeated rows, clashing names and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import shared
from tidemark.llm.bytecnn import fit_quality, score_quality
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.hostrules import host_rules
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.mixing import mix_by_weight
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.ngrams import score, train
from tidemark.llm.substrings import remove_repeated_windows
from tidemark.llm.tokencounts import token_counts
from tidemark.llm.warczip import through_archives

R = random.Random(3)
SAY = " ".join(f"w{R.randrange(500)}" for _ in range(60))
#: names that operators use inside, as columns of the table
NAMES = ["row", "node", "rk", "key", "size", "n_words", "taken", "leaks", "label", "score", "host", "rule", "path", "url", "k", "class", "hits", "digest", "of", "bucket"]
ROWS = [("a", SAY, "s"), ("a", SAY, "s"), ("b", SAY + " z", None), (None, SAY, "s"), ("c", None, "s"), (None, None, None), ("d", "", "s"), ("e", "Released under the MIT License.", "s")]


@pytest.fixture(scope="module")
def odd(spark):
    kinds = "doc_id string, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *(f"{n}{i // 2}" if i != 4 else None for n in NAMES)) for i, r in enumerate(ROWS)], kinds)


def ids(rows):
    return Counter((x.row["doc_id"], x.row["node"]) for x in rows)


def test_every_operator(spark, odd):
    all_rows = Counter((r.doc_id, r.node) for r in odd.collect())
    bench = spark.createDataFrame([("i", SAY), (None, SAY), ("j", None)], "item_id string, text string")
    found = find_leaks(odd, bench).collect()
    assert ids(found) == all_rows and all(sorted(str(k.item_id) for k in x.leaks) == (["None", "i"] if x.row.text and SAY in x.row.text else []) for x in found)
    found = scan_licenses(odd).collect()
    assert ids(found) == all_rows and {x.own_license for x in found if x.row.doc_id == "e"} == {"MIT"}
    found = near_duplicates(odd, carry=["node"]).collect()
    assert Counter((x.doc_id, x.row.node) for x in found) == all_rows
    assert {x.class_id for x in found if x.doc_id in ("a", "b")} == {"a"} and sum(x["class"] is None for x in found) == 3
    assert ids(mix_by_weight(odd).collect()) == ids(host_rules(odd).collect()) == ids(remove_repeated_windows(odd).collect()) == all_rows
    assert ids(token_counts(odd, {"w": -1.0}).collect()) == ids(score(odd, train(odd)).collect()) == all_rows
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), (None, 1)], "doc_id string, quality int")
    net = fit_quality(odd, labels)
    assert ids(score_quality(odd, net).collect()) == all_rows
    pages = odd.select(F.col("doc_id").alias("page_id"), "url", F.col("text").alias("html"), "node")
    got = Counter((x.page_id, x.record_type, x.refers_to) for x in through_archives(pages).collect())
    # equal payloads: SAY of a, a and null; empty ones of c, d and null
    assert got == Counter([("a", "response", None), ("a", "response", None), ("b", "response", None), (None, "revisit", "a"), ("c", "response", None), (None, "revisit", "c"), ("d", "revisit", "c"), ("e", "response", None)])


def test_a_repeated_id_does_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(2, "x")], "doc_id long, text string")
    seen = []
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    from tidemark.llm import bytecnn

    class Told(bytecnn.Network):
        def fit(self, pieces, labels, **kw):
            seen.append(len(pieces))
            return super().fit(pieces, labels, **kw)

    before, bytecnn.Network = bytecnn.Network, Told
    try:
        fit_quality(docs, labels, sample=10)
    finally:
        bytecnn.Network = before
    assert seen == [2]


def test_every_stage(spark, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", "none of these words stand there at all anywhere")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, n = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
        out = stage(spark, docs, str(tmp_path))
        if name != "mix_sources":
            assert out.columns == docs.columns
            n.append(out.count())
        else:
            assert out.columns == [*docs.columns, "size_mixed", "source_size", "target", "taken_mixed"]
    # rules: the four long texts; duplicates: one of those, and each other row; the rest keep all
    assert n == [4, 5, 8, 8]
    kept = pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in kept) == Counter(["a", "c", None, "d", "e"])


def test_repeated_ids_in_near_dedup(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    other = " ".join(f"u{i}" for i in range(60))
    docs = spark.createDataFrame([(3, SAY), (5, SAY + " z"), (5, other), (None, other), (None, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == sorted([(3, SAY), (5, other)])


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        get = dict.get

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("X", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Fake())
