"""Operator 9: token counts by dynamic programming over a trie of pre-tokens.

Pre-tokens are words, each with the mark of a word's start. Distinct pre-tokens are visited in sorted order, which
walks their trie: what two neighbours share is computed once. At each node of the trie stands the best unigram
score of the prefix that ends there (forward score) and its number of pieces; those at a word's last node are what
is stored. Documents then add up the numbers of their words.

A unigram model needs log-probabilities of pieces. Vocabulary files of sentencepiece's BPE kind have ranks instead;
their log-probabilities are taken by Zipf's law, -log(rank + SHIFT). How often the best segmentation then has as
many tokens as BPE gives is measured in the tests and stated in the README. A code point that is no piece becomes
its UTF-8 bytes.

Each document is counted where it is read, without a shuffle; the words that a worker remembers are bounded (CACHE).

Cases: a null text, or one without words, has no tokens; a text without white space is one word, of any length:
the trie's path is then as long as it, and each node holds only the pieces that are still open; of equally good
segmentations the one of fewer tokens counts; equal rows have equal counts; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

START = "▁"
SHIFT = 100.0
#: A byte of a code point that is no piece.
BYTE_SCORE = -40.0
CACHE = 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unigram(path: str) -> dict[str, float]:
    """The pieces of a file of sentencepiece, without control, byte and user-defined ones, and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks = {}
    for i in range(model.get_piece_size()):
        score = model.get_score(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and score > -1e8:
            ranks[model.id_to_piece(i)] = -score
    return {piece: -math.log(rank + SHIFT) for piece, rank in ranks.items()}


class Counter:
    """Forward scores over a trie of words. pieces: score of each."""

    def __init__(self, pieces: dict[str, float]):
        #: The pieces as a trie: a node is (score or None, children).
        self.root: list = [None, {}]
        for piece, score in pieces.items():
            node = self.root
            for c in piece:
                node = node[1].setdefault(c, [None, {}])
            node[0] = score
        self.nodes = 0  # of the words' trie, over all calls

    def count(self, words: list[str]) -> list[int]:
        """The number of tokens of each distinct word, in the order given."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out = [0] * len(words)
        root = self.root
        # Of each node on the path: its best score, its tokens, and the open pieces (node, score and tokens before).
        path: list[tuple[float, int, list]] = [(0.0, 0, [])]
        last = ""
        for k in order:
            word = words[k]
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            for c in word[shared:]:
                before, tokens, open_pieces = path[-1]
                n = 1 if c < "\x80" else len(c.encode())
                best, count, still = before + n * BYTE_SCORE, tokens + n, []
                for node, score, used in [*open_pieces, (root, before, tokens)]:
                    child = node[1].get(c)
                    if child is None:
                        continue
                    still.append((child, score, used))
                    if child[0] is not None:
                        got = score + child[0]
                        if got > best or got == best and used + 1 < count:
                            best, count = got, used + 1
                path.append((best, count, still))
            self.nodes += len(word) - shared
            out[k] = path[-1][1]
            last = word
        return out


@lru_cache(2)
def load(path: str) -> Counter:
    return Counter(unigram(path))


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        memory = K.Recent(CACHE)
        for batch in batches:
            totals, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, w in K.batches_of(batch.column(1)):
                keys, raw, which = K.distinct(w)
                hashes = keys.tolist()
                got = memory.get_all(hashes)
                new = [i for i, x in enumerate(got) if x is None]
                for i, n in zip(new, counter.count([START + raw[i].decode("utf-8", "replace") for i in new]), strict=True):
                    got[i] = n
                memory.put_all({hashes[i]: got[i] for i in new})
                each = np.array(got, np.int64)
                sums = np.zeros(len(which) + 1, np.int64)
                np.cumsum(each[which], out=sums[1:])
                totals.append(np.diff(sums[w.first]))
                numbers.append(np.diff(w.first))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(numbers)), pa.array(np.concatenate(totals))], names=["doc_id", "n_words", "n_tokens"])
        K.trim()

    return run


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens), a row for each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(_counts(path or default_path()), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(C.table(spark, sf_dir, "documents"))
