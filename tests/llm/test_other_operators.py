"""Operators 4, 5, 6, 8, 9 and 10, and the pipeline: against plain Python, libraries and held-out labels."""

import glob
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandwork.llm import bpe, chat_format, kernels, language_id, ngram_join, registry, substring_dedup, token_counts
from test_native_operators import SCHEMA, clashing, drop_lines, measures, odd_documents, water_levels, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- kernels


def test_kernels():
    texts = ["a b  c\n d e f g", "", "  x", "a b c d é f", None, "  \x85"]
    all_words = [w for t in texts for w in words(t)]
    data, offsets = kernels.buffers(pa.array(["skip", *texts]).slice(1))
    w = kernels.words(data, offsets)
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)] == all_words
    for n in (1, 2, 3, 5, 8, 13, 40):
        want = [tuple(all_words[i : i + n]) for i in range(max(0, len(all_words) - n + 1))]
        got = kernels.grams(w.hash, n).tolist()
        assert len(got) == len(want) and len(set(zip(got, want))) == len(set(got)) == len(set(want))
    x = np.array([5, 1, 4, 2, 8, 3], np.uint64)
    for n in (1, 2, 3, 5, 6):
        assert kernels.sliding(x, n).tolist() == [min(x[i : i + n]) for i in range(7 - n)]
        assert kernels.sliding(x, n, False).tolist() == [max(x[i : i + n]) for i in range(7 - n)]


# -- 4


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def classes(rows):
    """doc index -> the least doc_id of its class, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    shared = Counter((a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append((d is None, d or 0))
    return [None if (m := min(least[find(i)]))[0] else m[1] for i in range(len(rows))]


def copies(seed, groups=6, size=25, edits=(0, 1, 2, 3, 4, 5)):
    """Groups around a base, each text with some words replaced, so that many pairs lie near the threshold."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(140)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice(edits)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(30)}"
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("make", [lambda: [(r[0], r[1]) for r in odd_documents()], lambda: copies(3)], ids=["odd", "copies"])
def test_similarity_classes(spark, tmp_path, make):
    rows = make()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = ngram_join.query(spark, str(tmp_path)).collect()
    want = Counter(zip((d for d, _ in rows), classes(rows), strict=True))
    assert Counter((r.doc_id, r.class_id) for r in got) == want


def jaccards(rows):
    """(a, b) -> Jaccard, of different sets of shingles, and the set of each row."""
    sets = [shingles(t) for _, t in rows]
    kinds = [s for s in dict.fromkeys(sets) if s]
    return {(a, b): len(a & b) / len(a | b) for i, a in enumerate(kinds) for b in kinds[:i]}, sets


@pytest.mark.parametrize("most", [128, 16], ids=["one block", "blocks"])
def test_all_links_are_counted(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "PAIRED", most)
    monkeypatch.setattr(ngram_join, "COLUMNS", 100)
    rows = copies(3, groups=3, size=60)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_links for r in ngram_join.query(spark, str(tmp_path)).collect()}
    pairs, sets = jaccards(rows)
    n = Counter(s for pair, j in pairs.items() if j >= 0.8 for s in pair)
    assert got == {d: n[s] for (d, _), s in zip(rows, sets, strict=True)}
    assert max(got.values()) > 24


@pytest.mark.parametrize("n", [150, 600])
def test_pages_of_a_template_do_not_meet(spark, monkeypatch, n):
    """Pages of 46 words that differ in one are 0.787 similar: no links, and nothing to verify but one for each page and
    group. The same pages with a second copy of each, one word longer, have their links."""
    template = [f"t{i}" for i in range(46)]
    rows = [(i, " ".join(template[:20] + [f"own{i}"] + template[21:])) for i in range(n)]
    sent = []
    own = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: sent.append(pairs.select("a", "b").distinct().count()) or own(pairs, *rest))
    for more in ([], [(n + i, f"{t} end") for i, t in rows]):
        sent.clear()
        df = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(4)
        got = {r.doc: (r.class_id, r.n_links) for r in ngram_join.similarity_classes(df).collect()}
        pairs, sets = jaccards(rows[:3] + more[:3])
        assert all((j >= 0.8) == bool(more) for (a, b), j in pairs.items() if sets.index(a) % 3 == sets.index(b) % 3)
        assert got == {i: (i % n, len(more) and 1) for i in range(n + len(more))}
        assert sent[-1] <= n and sum(sent) <= 24 * 2 * len(df.columns) * n


def test_links_at_other_thresholds(spark):
    rows = copies(11, groups=4, size=15, edits=(2, 4, 6, 8))
    for t in (0.6, 0.7, 0.9):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc: r.n_links for r in ngram_join.similarity_classes(df, threshold=t).collect()}
        pairs, sets = jaccards(rows)
        n = Counter(s for pair, j in pairs.items() if j >= t for s in pair)
        assert got == {d: n[s] for (d, _), s in zip(rows, sets, strict=True)}


def test_one_of_each(spark, docs, empty):
    df = clashing(docs)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    rows = [(r[0], r[1]) for r in odd_documents() if words(r[1])]
    with_words = [r for r in kept.collect() if words(r.text)]
    # Two rows of id 904 are first of a class each.
    assert len(with_words) == len(set(classes(rows))) + 1
    assert ngram_join.one_of_each(empty).columns == empty.columns and ngram_join.one_of_each(empty).count() == 0


def test_one_of_each_text_without_words(spark):
    texts = ["", "\n\n", "", None, " ", "\n\n", "", None, "a word", "a word"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, ""), (2, "")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, kept)) == Counter([(0, ""), (1, "\n\n"), (3, None), (4, " "), (8, "a word")])


def test_depths():
    assert ngram_join.depths(least=0.5) == [6] and ngram_join.depths() == [6, 4]
    rng = np.random.default_rng(0)
    for depth in (4, 6):
        shared = (rng.random((20_000, ngram_join.TREES, depth)) < 0.8).all(2).sum(1)
        assert (shared >= ngram_join.SHARED).mean() == pytest.approx(ngram_join.recall(0.8, depth), abs=0.005)
    assert ngram_join.recall(0.8, ngram_join.depths()[-1]) >= ngram_join.RECALL


# -- 5


HOSTILE = ["<|", "<\\|", "\\", "\\\\<|", "<", "a\n<|im_end|>\n", "<<|||\\", "<|im_end|><|im_start|>assistant ok", "", None, "😀\r\n", "w " * 5000]


@pytest.mark.parametrize("budget", [20, 1024])
def test_chat_format(spark, budget):
    rng = random.Random(budget)
    rows = [(-1, 0, "user", HOSTILE[7]), (-1, 1, "assistant", HOSTILE[7]), (None, 1, "assistant", "no id"), (5, None, "user", "last"), (5, 0, "system", "be brief"), (6, 0, None, "x")]
    for conv in range(20, 40):
        for turn in range(rng.randrange(1, 30)):
            rows.append((conv, turn, "system" if not turn and conv % 2 else rng.choice(["user", "assistant", "as\nsis\\t"]), rng.choice(HOSTILE)))
    rows.append((39, 0, "user", "again"))
    rows += [(50, 0, "assistant", "twice")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("clash"))
    windows = chat_format.format_chats(df, budget=budget, history=8)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{t}\n" for *_, x, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    if budget == 20:
        assert max(r.n_windows for r in got.values()) > 5
        for r in windows.where("window > 0 AND conv_id % 2 = 1 AND conv_id > 20").collect():
            assert r.repeated and chat_format.parse(r.formatted)[0][0] == "system"
    assert chat_format.read_back(chat_format.format_chats(df.limit(0))).count() == 0


def test_escapes():
    for x in HOSTILE:
        if x is not None:
            assert chat_format.unescape(chat_format.escape(x)) == x and "<|" not in chat_format.escape(x)


# -- 6


def test_language_of_held_out_documents(spark):
    got = language_id.query(spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id").dropna(subset=["lang"])
    both = both[both["held_out"]]
    assert len(both) > 20 and (both["lang"] == both["lang_pred"]).mean() >= 0.97
    assert got["score"].between(0, 1).all()


def test_language_spans_and_odd_texts(spark, docs, empty):
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(truth)
    pick = {r.lang: r.text.split()[:60] for r in truth.where("length(text) > 2000").dropDuplicates(["lang"]).collect()}
    mixed = " ".join(pick["de"] + pick["fr"])
    rows = [(1, mixed), (2, None), (3, ""), (4, "123 456 !!"), (5, " \t"), (6, "Привет мир"), (7, "das")]
    got = {r._row: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [s.lang for s in got[1].spans] == ["de", "fr"] and abs(got[1].spans[0].len - 60) <= 3
    assert {got[i].lang_pred for i in (2, 3, 4, 5)} == {"und"} and got[4].score == 0
    assert got[6].lang_pred in model.languages
    assert language_id.identify(clashing(docs).withColumns({"lettered": F.lit(1), "spans": F.lit(2)}), model).count() == docs.count()
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_viterbi_shortcut():
    """Documents that are told apart by running sums have the path that the step by step pass finds."""
    rng = np.random.default_rng(0)
    first = np.cumsum([0, 3, 0, 40, 1, 200, 17])
    w = kernels.Words(None, None, None, None, None, first, None)
    for scale in (0.5, 3, 10):
        scores = rng.normal(size=(first[-1], 3)) * scale
        scores[50:120, 1] += scale
        got = language_id.label(w, scores, 5.0)
        for a, b in zip(first, first[1:]):
            if b > a:
                want = language_id.viterbi(scores[a:b], 5.0)
                value = lambda p: scores[a:b][np.arange(b - a), p].sum() - 5.0 * (p[1:] != p[:-1]).sum()
                assert value(got[a:b]) == pytest.approx(value(want))


# -- 8


def test_bpe_is_the_librarys(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(2)
    letters = "abcdefghinorst'ABC éüñ0129.,!-_"
    texts = [t for _, t, *_ in odd_documents()] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["a<|endoftext|>b  <|startoftext|>", "ΑΣ ΟΔΟΣ İstanbul ﬁ é", "don't I'LL we'Ve '' ''s", "日本語😀👍🏽 ½ ² ٣", "a" * 500, " ́abc", "ǅ ẞ ß", "x\x1cy\x85z"]
    for text, (ids, decoded) in zip(texts, bpe.encode_texts(bpe.default_path(), pa.array(texts, pa.string())), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.digests(docs).count() == len(odd_documents())
    assert bpe.digests(empty).count() == 0
    row = bpe.encode(docs.where("doc_id = 903")).first()
    assert row.ids == library.encode("same row", add_special_tokens=False).ids


def plain_merge(t, parts):
    """Merging by rank, one pair at a time."""
    ranks = dict(zip(t.ranks.keys.tolist(), t.ranks.values.tolist()))
    while True:
        found = [(ranks[p] >> 20, i, ranks[p]) for i, p in enumerate(a << 20 | b for a, b in zip(parts, parts[1:])) if ranks.get(p, -1) >= 0]
        if not found:
            return parts
        _, i, both = min(found)
        parts = [*parts[:i], both & ((1 << 20) - 1), *parts[i + 2 :]]


def test_merging_of_arrays_and_by_queue():
    t = bpe.load(bpe.default_path())
    rng = random.Random(5)
    made = ["internationalization", "aaaaaaaaaa", "zzqx", "thetheth", "a", "a" * 90] + ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    data = np.frombuffer("".join(made).encode(), np.uint8)
    edge = np.r_[0, np.cumsum([len(w) for w in made])]
    flat, first = t._symbols_of(data, edge[:-1], edge[1:])
    got, begin = t.merge_all(flat, first)
    learned, learned_first = t.learn(data, edge[:-1], edge[1:])
    for i in range(len(made)):
        parts = flat[first[i] : first[i + 1]].tolist()
        want = plain_merge(t, parts)
        assert got[begin[i] : begin[i + 1]].tolist() == t.merge_long(list(parts)) == want == learned[learned_first[i] : learned_first[i + 1]].tolist()


def test_bpe_of_every_code_point():
    """Classes, case and normal forms are the library's: every code point within a word, 64 words to a text."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}B" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    want = library.encode_batch(texts, add_special_tokens=False)
    for w, (ids, _) in zip(want, bpe.encode_texts(bpe.default_path(), pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids


def test_bpe_in_parts_and_with_a_small_memory(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(3000)}x{rng.choice(['', 'é', '!', 'Ω', '<|endoftext|>'])}" for _ in range(rng.randrange(600))) for _ in range(30)] + ["z" * 5000, "", None]
    bpe.load.cache_clear()
    want = list(bpe.encode_texts(bpe.default_path(), pa.array(texts)))
    monkeypatch.setattr(bpe, "CHUNK", 500)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    bpe.load.cache_clear()
    assert list(bpe.encode_texts(bpe.default_path(), pa.array(texts), cache=40)) == want
    assert len(bpe.load(bpe.default_path()).known.keys) < 400
    bpe.load.cache_clear()


def test_bpe_with_clashing_names(docs):
    got = bpe.encode(clashing(docs).withColumns({"ids": F.lit(1), "decoded": F.lit("x")}))
    assert got.columns == ["doc_id", "ids", "decoded"] and Counter(map(str, got.collect())) == Counter(map(str, bpe.encode(docs).collect()))


# -- 9


def brute(pieces, word):
    best = [(0.0, 0)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        n = len(word[j - 1].encode())
        options = [(best[j - 1][0] + n * token_counts.BYTE_SCORE, -(best[j - 1][1] + n))]
        options += [(best[i][0] + pieces[word[i:j]], -(best[i][1] + 1)) for i in range(max(0, j - 20), j) if word[i:j] in pieces]
        score, count = max(options)
        best[j] = (score, -count)
    return best[-1][1]


def test_token_counts(docs, empty):
    pieces = token_counts.unigram(token_counts.default_path())
    assert max(map(len, pieces)) <= 20
    want = {}
    for doc_id, t, *_ in odd_documents():
        c = Counter(words(t))
        want[doc_id, t] = sum(n * brute(pieces, token_counts.START + w) for w, n in c.items())
    got = token_counts.token_counts(clashing(docs)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, want[d, t]) for d, t, *_ in odd_documents())
    counter = token_counts.Counter(pieces)
    counter.count(["abcde", "abcdx", "abcd"])
    assert counter.nodes == 6  # what is shared is computed once
    assert token_counts.token_counts(empty).count() == 0


# -- 10


def remove_windows(rows, n=13):
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g not in first or order(d) < first[g]:
                first[g] = order(d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {i + j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < order(d) for j in range(n)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("per_batch", [3, 10_000])
def test_substring_dedup(spark, tmp_path, per_batch):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(30)]
    rows = [(r[0], r[1]) for r in odd_documents()]
    for i in range(60):
        own = [f"o{rng.randrange(9)}" for _ in range(rng.randrange(80))]
        at, a = rng.randrange(len(own) + 1), rng.randrange(18)
        rows.append((1000 + i, rng.choice([" ", "\n", "  "]).join(own[:at] + passage[a : a + rng.randrange(10, 31)] + own[at:])))
    rows += [(2000, "k " * 50), (2001, "k " * 50), (2001, "k " * 14 + "other"), (None, "k " * 20)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
        got = substring_dedup.query(spark, str(tmp_path)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == remove_windows(rows)
        spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
        assert substring_dedup.query(spark, str(tmp_path / "none")).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_factors():
    pos, ref, at = np.array([0, 1, 2, 10, 11, 12, 13]), np.array([7, 7, 7, 7, 7, 5, 5]), np.array([4, 5, 6, 0, 1, 2, 9])
    assert substring_dedup.factors(pos, ref, at, 13) == [(0, 15, 7, 4), (10, 14, 7, 0), (12, 13, 5, 2), (13, 13, 5, 9)]


def test_factors_stand_in_their_documents(spark):
    rng = random.Random(8)
    rows = [(0, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 y x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 x14"), (1, " ".join(f"x{i}" for i in range(1, 15)))]
    cuts = lambda: [(a, a + rng.randrange(5, 30)) for a in rng.choices(range(60), k=4)]
    rows += [(i, " ".join(f"p{j}" for a, b in cuts() for j in range(a, b))) for i in range(2, 60)]
    text = {d: words(t) for d, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = substring_dedup.duplicate_spans(clashing(df)).collect()
    assert {(s.start, s.len, s.ref, s.ref_start) for r in found if r.doc == 1 for s in r.spans} == {(0, 13, 0, 0), (1, 13, 0, 14)}
    for r in found:
        for s in r.spans:
            assert s.ref < r.doc and text[r.doc][s.start : s.start + s.len] == text[s.ref][s.ref_start : s.ref_start + s.len]


def test_many_documents_of_equal_and_null_ids(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, passage)]
    for i in range(3000):
        for d in (None, 7):
            own = " ".join(f"{'n' if d else 'm'}{i}w{j}" for j in range(i % 11))
            rows.append((d, f"{own} {passage if i % 3 else 'nothing'} {i}"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    got = substring_dedup.query(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == remove_windows(rows)


# -- pipeline


def passes_rules(text):
    """The policy of the pipeline, in plain Python."""
    n, chars, symbols, dup, rep = measures(text)
    lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    capitals = sum("A" <= c <= "Z" for c in text or "")
    return n >= 50 and 2 * rep <= n and 20 * symbols <= chars and 2 * dup <= lines and 2 * n <= chars <= 15 * n and 2 * capitals <= chars


def test_pipeline_stage_by_stage(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = spark.createDataFrame(stage(spark, now, SF).collect(), stage(spark, now.limit(0), SF).schema)
        after = now.collect()
        if name == "quality rules":
            assert Counter(after) == Counter(r for r in before if passes_rules(r.text))
        elif name == "line dedup":
            want = dict(zip((r.doc_id for r in before), drop_lines([r.text for r in before], 10), strict=True))
            assert {r.doc_id: (r.text, r.n_chars) for r in after} == {d: (t, len(t)) for d, (_, _, t) in want.items()}
        elif name == "n-gram Jaccard join":
            ids = classes([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {r.doc_id for r, c in zip(before, ids, strict=True) if r.doc_id == c}
        elif name == "mixing":
            sources = sorted({r.source for r in before}, key=lambda x: (x is None, x or ""))
            sizes = [sum(len(words(r.text)) for r in before if r.source == x) for x in sources]
            for x, size, target in zip(sources, sizes, water_levels(sizes, (5, 2, 1), 1.5, 2.0), strict=True):
                mine = {r: n for r, n in Counter(after).items() if r.source == x}
                low = int(target / size)
                assert set(mine) <= {r for r in before if words(r.text)} and set(mine.values()) <= {low, low + 1}
                assert low == 0 or set(mine) == {r for r in before if r.source == x and words(r.text)}
                assert abs(sum(n * len(words(r.text)) for r, n in mine.items()) - target) <= max(len(words(r.text)) for r in before if r.source == x)
        else:
            ids = [e.ids for e in library.encode_batch([r.text for r in before], add_special_tokens=False)]
            want = Counter((r.doc_id, len(i), tuple(i), library.decode(i, skip_special_tokens=False)) for r, i in zip(before, ids, strict=True))
            assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in after) == want
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def test_odd_documents_pass_all_stages(spark, docs, empty):
    for df in (docs, empty, clashing(docs)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, "")
            rows = out.collect()
            assert out.columns == (df.columns if name != "BPE" else ["doc_id", "n_tokens", "ids", "decoded"])
            if name == "quality rules":
                assert len(rows) == (df is not empty and sum(passes_rules(r[1]) for r in odd_documents()))
            else:
                assert bool(rows) == (df is not empty)
            if "a.b" in out.columns:
                assert {r["a.b"] for r in rows} <= {"a.b"}


# -- queries and SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {re.search(r'(\w+).parquet$', p)[1]} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall())


def test_an_operation_for_each_number():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 11))
