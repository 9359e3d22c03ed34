"""Operator 6: language identification of mixed text.

A model has, for each language, log-probabilities of byte trigrams within words (blanks at both ends, hashed into
BUCKETS), and the scripts that its training texts use. Of a text, a word's script narrows the candidates to the
languages that have it; the word's trigrams give each candidate a score; Viterbi with a SWITCH penalty between
words labels spans. Before that, documents in which no run of words can outweigh the penalty are told apart by
running sums: for these the best path is the language with the best sum, and no step by step pass is needed.

The model is fitted on at most about SAMPLE documents that have a language, chosen by a hash of doc_id and text; counting
is distributed, the counts (of a language and bucket that occur, so no more than the sample has bytes) are what comes to
the driver.

Cases: null texts, and texts without a letter, are ``und`` with score 0; a text of one word is one span, a very long one
is scored whole; words of scripts that no language has are open to all; of languages with equal scores the first by name
is taken; repeated rows and equal texts get equal labels; an empty table, or one without a language, labels everything
``und``; a null doc_id is never held out; other columns, whatever their names, are not read. Neither lang, source nor
doc_id is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

BUCKETS = 1 << 15
SWITCH = 12.0
#: Bound of the documents that a model is fitted on.
SAMPLE = 20_000
#: Differences of log-probability that one trigram can make, at most: a few odd strings decide nothing.
CLIP = 4.0
UNKNOWN = "und"

#: Scripts by first code point: fixed values, blocks of Unicode.
SCRIPTS = [
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"), (0x00C0, "latin"),
    (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0x4DC0, "other"),
    (0x4E00, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
_FROM = np.array([x for x, _ in SCRIPTS])
NAMES = sorted({name for _, name in SCRIPTS} - {"other"})
_BIT = np.array([0 if name == "other" else 1 << NAMES.index(name) for _, name in SCRIPTS], np.int32)


def scripts_of(w: K.Words) -> np.ndarray:
    """For each word a bit for each script of its letters."""
    data = w.data
    if not len(data):
        return np.zeros(0, np.int32)
    point = data.astype(np.int32)
    after = [np.concatenate([data[i:], np.zeros(i, np.uint8)]).astype(np.int32) & 0x3F for i in (1, 2, 3)]
    point = np.where(data >= 0xF0, (point & 7) << 18 | after[0] << 12 | after[1] << 6 | after[2], np.where(data >= 0xE0, (point & 15) << 12 | after[0] << 6 | after[1], np.where(data >= 0xC0, (point & 31) << 6 | after[0], point)))
    bits = _BIT[np.searchsorted(_FROM, point, "right") - 1]
    bits[(data & 0xC0) == 0x80] = 0
    return np.bitwise_or.reduceat(bits, w.start) if len(w.start) else np.zeros(0, np.int32)


def trigrams(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams, a word's one after the other, and where each word's begin. A-Z are lower-cased."""
    data = w.data.astype(np.uint32)
    data += ((data >= 65) & (data <= 90)).astype(np.uint32) * 32
    size = w.end - w.start
    begin = np.cumsum(size) - size
    at = np.repeat(w.start - begin, size) + np.arange(int(size.sum()))
    mid = data[at]
    left, right = np.full(len(at), 32, np.uint32), np.full(len(at), 32, np.uint32)
    left[1:] = mid[:-1]
    right[:-1] = mid[1:]
    left[begin] = 32
    right[begin + size - 1] = 32
    code = (left << np.uint32(16) | mid << np.uint32(8) | right) * np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - 15)).astype(np.int32), begin


@dataclass
class Model:
    """languages; scores: of each bucket and language; scripts: of each language, as bits."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray

    def word_scores(self, w: K.Words) -> np.ndarray:
        """A row for each word, a column for each language; -inf where the script rules a language out."""
        bucket, begin = trigrams(w)
        if not len(begin):
            return np.zeros((0, len(self.languages)))
        out = np.stack([np.add.reduceat(self.scores[:, i][bucket], begin) for i in range(len(self.languages))], 1).astype(np.float64)
        script = scripts_of(w)
        open_to = (script[:, None] & self.scripts[None, :] != 0) | (script[:, None] == 0)
        open_to |= ~open_to.any(1, keepdims=True)
        out[~open_to] = -1e9
        return out


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word: the sum of their scores, less the penalty for each change. Of equal paths the
    one that stays, then the first language."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int32)
    best = scores[0].copy()
    stay = np.arange(k)
    for t in range(1, n):
        top = int(np.argmax(best))
        change = best[top] - penalty > best
        back[t] = np.where(change, top, stay)
        best = np.where(change, best[top] - penalty, best) + scores[t]
    path = np.empty(n, np.int32)
    path[-1] = int(np.argmax(best))
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label(w: K.Words, scores: np.ndarray, penalty: float) -> np.ndarray:
    """viterbi() of each document."""
    first = w.first
    out = np.zeros(len(scores), np.int32)
    has = np.flatnonzero(np.diff(first) > 0)
    if not len(has):
        return out
    totals = np.add.reduceat(scores, first[has], axis=0)
    top = np.argmax(totals, 1)
    size = np.diff(first)[has]
    of_word = np.repeat(np.arange(len(has)), size)
    out[:] = top[of_word]
    own = scores[np.arange(len(scores)), out]
    others = scores.copy()
    others[np.arange(len(scores)), out] = -np.inf
    gain = np.maximum(others.max(1), -1e6) - own if scores.shape[1] > 1 else np.full(len(scores), -1.0)
    # The most that any run of words in a document could gain: running sum less the least before it.
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    shift = (np.abs(sums).max() + 1.0) * 2.0
    apart = np.repeat(np.arange(len(has)), size) * shift
    before = np.minimum.accumulate(sums[:-1] - apart)
    most = np.maximum.reduceat(sums[1:] - apart - before, first[has])
    for d in np.flatnonzero(most > penalty).tolist():
        a, b = int(first[has[d]]), int(first[has[d] + 1])
        out[a:b] = viterbi(scores[a:b], penalty)
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """The model of rows with a language. Where there are more than ``sample`` of them, of those with a hash under
    the bound that 95 % of ``sample`` are expected to be under."""
    rows = labelled.where(F.col(lang).isNotNull())
    n = rows.count()
    if n > sample:
        rows = rows.where(F.call_function("shiftrightunsigned", F.xxhash64(F.lit("sample"), F.col(doc_id), F.col(text)), F.lit(1)) < F.lit(int(0.95 * sample / n * (1 << 63))))
    some = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for a, _, w in K.batches_of(batch["text"]):
                bucket, begin = trigrams(w)
                of = np.repeat(w.doc, w.end - w.start)
                seen = scripts_of(w)
                for x in set(langs[a : a + len(w)]):
                    mine = langs[a : a + len(w)] == x
                    counts[x] = counts.get(x, 0) + np.bincount(bucket[mine[of]], minlength=BUCKETS)
                    scripts[x] = scripts.get(x, 0) + np.array([int((seen[mine[w.doc]] >> i & 1).sum()) for i in range(len(NAMES))])
        yield pa.record_batch(
            [pa.array(list(counts), pa.string()), pa.array([c.tolist() for c in counts.values()], pa.list_(pa.int64())), pa.array([s.tolist() for s in scripts.values()], pa.list_(pa.int64()))],
            names=["lang", "counts", "scripts"],
        )

    parts = some.mapInArrow(count, "lang string, counts array<long>, scripts array<long>")
    summed = parts.select("lang", F.posexplode(F.concat("counts", "scripts")).alias("i", "n")).where("n > 0").groupBy("lang", "i").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(summed["lang"].unique())
    counts = np.zeros((BUCKETS + len(NAMES), max(1, len(languages))))
    for i, x in enumerate(languages):
        mine = summed[summed["lang"] == x]
        counts[mine["i"], i] = mine["n"]
    grams, used = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    logs = np.log(grams / grams.sum(0))
    logs -= logs.mean(1, keepdims=True)
    share = used / np.maximum(1.0, used.sum(0))
    bits = (share >= 0.01).astype(np.int64).T @ (1 << np.arange(len(NAMES), dtype=np.int64))
    return Model(languages, np.clip(logs, -CLIP, CLIP).astype(np.float32), bits.astype(np.int32))


def _predict(model: Model, penalty: float, spans: bool):
    k = len(model.languages)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch["lettered"].to_numpy(zero_copy_only=False)
            langs, scores, found = [], [], []
            for a, b, w in K.batches_of(batch["text"]):
                if not k:
                    langs += [UNKNOWN] * (b - a)
                    scores += [0.0] * (b - a)
                    found += [[]] * (b - a)
                    continue
                s = model.word_scores(w)
                path = label(w, s, penalty)
                weight = (w.end - w.start).astype(np.float64)
                share = np.zeros((b - a, k))
                np.add.at(share, (w.doc, path), weight)
                top = np.argmax(share, 1)
                # Of the words in the leading language, the odds against the next best; times its share of the text.
                mine = path == top[w.doc] if len(path) else np.zeros(0, bool)
                total = np.zeros((b - a, k))
                np.add.at(total, w.doc[mine], s[mine])
                own = total[np.arange(b - a), top]
                total[np.arange(b - a), top] = -np.inf
                sure = 1 / (1 + np.exp(-np.clip(own - total.max(1), -30, 30))) if k > 1 else np.ones(b - a)
                part = share[np.arange(b - a), top] / np.maximum(1.0, share.sum(1))
                for i in range(b - a):
                    ok = bool(lettered[a + i]) and w.first[i + 1] > w.first[i]
                    langs.append(model.languages[top[i]] if ok else UNKNOWN)
                    scores.append(float(sure[i] * part[i]) if ok else 0.0)
                    if spans:
                        p = path[w.first[i] : w.first[i + 1]]
                        edge = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) and ok else np.zeros(0, int)
                        found.append([{"start": int(x), "len": int(y - x), "lang": model.languages[p[x]]} for x, y in zip(edge, np.r_[edge[1:], len(p)])])
            columns = [batch["_row"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())] + ([pa.array(found, kind)] if spans else [])
            yield pa.record_batch(columns, names=["_row", "lang_pred", "score"] + ["spans"] * spans)
        K.trim()

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", row: str = "doc_id", penalty: float = SWITCH, spans: bool = True) -> DataFrame:
    """(_row, lang_pred, score, spans) for each row; _row: the column ``row``. spans: (start, len, lang), in words.
    lang_pred is the language with most bytes; score its share, times how sure its own words are."""
    rows = docs.select(F.col(row).alias("_row"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    kind = rows.schema["_row"].dataType.simpleString()
    extra = ", spans array<struct<start:int,len:int,lang:string>>" if spans else ""
    return rows.mapInArrow(_predict(model, penalty, spans), f"_row {kind}, lang_pred string, score double{extra}")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select(F.col("_row").alias("doc_id"), held_out("_row").alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
