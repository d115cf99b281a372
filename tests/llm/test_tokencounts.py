import itertools
import random

from tidemark.llm.tokencounts import MARK, Trie, load_pieces, token_counts

from .test_substrings import words

PIECES = {MARK: -3.0, MARK + "a": -2.0, "a": -2.5, "b": -2.6, "ab": -3.1, "ba": -3.0, "aba": -4.0, "é": -4.0, MARK + "ab": -3.0}


def brute(word, trie):
    """Best over all cuts, as (score, -tokens)."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        score = tokens = 0
        for a, b in itertools.pairwise(at):
            x = word[a:b]
            if x in trie.pieces:
                score, tokens = score + trie.pieces[x], tokens + 1
            elif len(x) == 1:
                n = len(x.encode())
                score, tokens = score + n * trie.byte, tokens + n
            else:
                break
        else:
            best = max(best, (round(score, 9), -tokens)) if best else (round(score, 9), -tokens)
    return -best[1]


def test_trie_against_all_segmentations():
    r, trie = random.Random(3), Trie(PIECES)
    for _ in range(300):
        w = MARK + "".join(r.choice("aabbécü") for _ in range(r.randint(1, 8)))
        assert trie.count(w) == brute(w, trie), w


def test_counts(spark, monkeypatch):
    import tidemark.llm.tokencounts as m

    monkeypatch.setattr(m, "KEEP", 3)
    texts = [None, "", " \n", "a ab aba", "a  ab\taba", "b" * 50_000, "é c abab abab " * 500]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.row.doc_id: (r.n_words, r.n_tokens, r.row.n_tokens) for r in token_counts(df, PIECES).collect()}
    trie = Trie(PIECES)
    for i, t in enumerate(texts):
        assert got[i] == (len(words(t)), sum(trie.count(MARK + x) for x in words(t)), 9)
    assert token_counts(df.limit(0), PIECES).collect() == []


def test_public_vocabulary():
    pieces = load_pieces("/opt/tokenizers/piece_bpe_32k.model")
    assert 30_000 < len(pieces) < 32_000 and abs(sum(2.718281828459045**x for x in pieces.values()) - 1) < 1e-6
    assert Trie(pieces).count(MARK + "the") == 1
