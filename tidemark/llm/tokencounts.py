"""Token counts of a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the word mark before it. The pre-tokens that a task meets are put in
order and walked as the trie they form: the forward scores of a prefix are computed once and
shared by all pre-tokens below it, and the count of the best segmentation stands at the end of
each pre-token. Counts are kept for the task, in a table that is emptied when it is full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import U, chunks

MARK = "▁"
KEEP = 2_000_000


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model with log probabilities by Zipf's law of their rank: tokenizers
    are not trained here, and the public vocabularies at hand have ranks and no unigram scores.

    The model's byte pieces stand in for characters that no piece has.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    norm = math.log(sum(1 / (i + 2.7) for i in range(len(names))))
    return {x: -math.log(i + 2.7) - norm for i, x in enumerate(names)}


class Trie:
    """Best segmentations of pre-tokens in sorted order; ends[i] is (score, tokens) of the prefix
    of i characters. A higher score wins, then fewer tokens."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        worst = min(pieces.values(), default=0.0)
        self.byte = worst - 10.0  # a byte piece; a character costs one for each of its bytes
        self.word, self.ends = "", [(0.0, 0)]

    def count(self, word: str) -> int:
        """Tokens of a pre-token; only characters beyond the prefix shared with the last are new."""
        shared, most = 0, min(len(word), len(self.word))
        last = self.word
        while shared < most and word[shared] == last[shared]:
            shared += 1
        ends, pieces, longest = self.ends, self.pieces, self.longest
        del ends[shared + 1 :]
        for i in range(shared + 1, len(word) + 1):
            n = len(word[i - 1].encode("utf-8", "surrogatepass"))
            s, k = ends[i - 1]
            best, tokens = s + n * self.byte, k + n
            for j in range(max(0, i - longest), i):
                p = pieces.get(word[j:i])
                if p is not None:
                    s, k = ends[j]
                    s += p
                    if s > best or (s == best and k + 1 < tokens):
                        best, tokens = s, k + 1
            ends.append((best, tokens))
        self.word = word
        return ends[len(word)][1]


def _count(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(pieces.value)
        known, tokens = np.empty(0, U), np.empty(0, np.int64)
        for b in batches:
            outs = []
            for _, _, w in chunks(b.column("text")):
                h, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
                at = np.searchsorted(known, h)
                new = np.ones(len(h), bool)
                inside = at < len(known)
                new[inside] = known[at[inside]] != h[inside]
                if new.any():
                    i = first[new]
                    names = [MARK + w.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(w.starts[i], w.ends[i], strict=True)]
                    found = np.empty(len(names), np.int64)
                    for k in sorted(range(len(names)), key=names.__getitem__):
                        found[k] = trie.count(names[k])
                    if len(known) + len(found) > KEEP:
                        known, tokens = h, np.where(new, 0, tokens[np.minimum(at, max(len(known) - 1, 0))] if len(known) else 0)
                        tokens[new] = found
                    else:
                        at_new = at[new]
                        known, tokens = np.insert(known, at_new, h[new]), np.insert(tokens, at_new, found)
                n = tokens[np.searchsorted(known, h)][back]
                sums = np.concatenate(([0], np.cumsum(n)))
                outs.append((w.counts, np.diff(sums[w.at])))
            words, total = (np.concatenate(x) for x in zip(*outs, strict=True)) if outs else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(words, pa.int64()), pa.array(total, pa.int64())], ["row", "n_words", "n_tokens"])

    return run


def token_counts(df: DataFrame, pieces: dict[str, float], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, n_words, n_tokens) for each row of df; row has the columns to carry, all by default.

    pieces (a fixed vocabulary, whose size does not follow the data) is broadcast. Null and empty
    texts have 0 tokens; equal rows count each; an empty table gives an empty one; the columns of
    df stand in the struct row, whatever their names; a text is counted whole, by one worker.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    kinds = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_count(shared), kinds)
