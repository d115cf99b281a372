import random

import numpy as np
import pytest

from tidemark.llm.bytecnn import BLOCK, CHUNK, STEP, Network, fit_quality, score_quality


def brute(net, text):
    """Chunk by chunk, byte by byte."""
    blocks = -(-(len(text) + net.width - 1) // BLOCK) * BLOCK
    padded, logits, lo = text + bytes(blocks - len(text) + net.width), [], 0
    while True:
        hi = min(lo + CHUNK, blocks)
        z = [sum(net.p["table"][k][padded[p + k]] for k in range(net.width)) for p in range(lo, hi) if p < max(1, len(text))]
        logits.append(net.logits(np.max(z, 0)[None])[0])
        if hi == blocks:
            break
        lo += STEP
    return 1 / (1 + np.exp(-np.mean(logits)))


def test_scores_cover_the_whole_text():
    r, net = random.Random(1), Network()
    texts = [bytes(r.randrange(1, 256) for _ in range(n)) for n in (0, 1, 63, 64, 65, 511, 512, 513, 960, 961, 3000)]
    offs = np.cumsum([0, *map(len, texts)])
    got = net.scores(np.frombuffer(b"".join(texts), np.uint8), offs)
    assert got == pytest.approx([brute(net, t) for t in texts], rel=1e-3)
    assert len(net.scores(np.empty(0, np.uint8), np.zeros(1, np.int64))) == 0


def test_gradient_fit_separates_held_out_texts(spark):
    r = random.Random(2)
    voc = [f"{a}{b}o" for a in "bcdfgh" for b in "aeiu"]

    def text(good):
        w = [r.choice(voc) for _ in range(r.randint(5, 400))]
        return " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)

    rows = [(i, text(i % 4 > 0), int(i % 4 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:200]] + [(None, 1), (5, None), (7, 1), (7, 1)], "doc_id long, quality int")
    net = fit_quality(docs.filter("doc_id < 200"), labels, sample=150)
    got = {x.row.doc_id: x.score for x in score_quality(docs, net).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 302
    assert np.mean([(got[i] >= 0.5) == bool(q) for i, _, q in rows[200:]]) > 0.97
    again = fit_quality(docs.filter("doc_id < 200").repartition(5), labels, sample=150)
    assert all((again.p[k] == net.p[k]).all() for k in net.p)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert score_quality(docs, fit_quality(docs, none)).collect()[0].score == 0.5
    assert score_quality(docs.limit(0), fit_quality(docs, none)).collect() == []
