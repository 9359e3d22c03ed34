"""Operators 1, 2, 3 and 7: small tables of odd cases against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwork.llm import common as C
from strandwork.llm import fingerprints, line_dedup, mixing, quality_rules

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall(t or "")


def odd_documents(seed=0, n=60):
    """Nulls in every column, empty and long texts, repeated rows, blanks of all kinds, code points beyond the BMP."""
    rng = random.Random(seed)
    pool = ["the", "of", "Ünïcode", "a b", "x", "😀", "#$%", "|", " y", "END"]
    rows = [(i, rng.choice("\n ").join(rng.choice(pool) for _ in range(rng.randrange(1, 90))), "en", rng.choice(["b", "a", "z", "é", None]), 0) for i in range(n)]
    same = "shared line\nOther LINE \r\n  tail"
    rows += [(n + i, f"own {i}\n{same}", None, "a", None) for i in range(12)]
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, " \n\t\x0b\x0c\r ", "en", "a", 0), (None, "no id here\nshared line", "en", "a", 1)]
    rows += [(903, "same row", "en", "a", 8)] * 2 + [(904, "one text", "en", "a", 8), (904, "another text", "en", "a", 12)]
    rows += [(905, "long " * 30_000, "en", "z", 0), (906, "y" * 50_000, "en", "z", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns with the names that operators use inside."""
    extra = ["_row", "_text", "_doc", "_tk", "size", "copies", "n_words", "fail_bits", "keep", "n_lines", "_words", "dropped", "a.b"]
    return df.withColumns({c: F.lit(c) for c in extra})


# -- 1


def water_levels(sizes, weights, share, most):
    todo, out = dict(enumerate(sizes)), {}
    left = share * sum(sizes)
    while todo:
        total = sum(weights[i % 3] for i in todo)
        full = [i for i in todo if left * weights[i % 3] / total >= most * todo[i]]
        if not full:
            return [out[i] if i in out else left * weights[i % 3] / total for i in range(len(sizes))]
        for i in full:
            out[i] = most * todo.pop(i)
        left -= sum(out[i] for i in full)
    return [out[i] for i in range(len(sizes))]


def test_mixing(docs):
    got = mixing.mix(docs).toPandas()
    rows = odd_documents()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    sources = sorted((s for s in sizes if s is not None)) + [None]
    want = water_levels([sizes[s] for s in sources], (5, 2, 1), 1.5, 2.0)
    for s, target in zip(sources, want, strict=True):
        mine = got[got["source"].isna() if s is None else got["source"] == s]
        assert (mine["source_size"] == sizes[s]).all()
        assert mine["target"].iloc[0] == pytest.approx(target)
        taken = (mine["copies"] * mine["size"]).sum()
        assert abs(taken - target) <= mine["size"].max()
    assert got["copies"].max() <= 2
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = lambda x: sorted(map(str, x.itertuples(index=False)))
    assert key(got) == key(again)


def test_mixing_is_unbiased(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "s" if i % 2 else "t", 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = Counter()
    for seed in range(12):
        got = mixing.mix(df, seed=seed).toPandas()
        for r in got[got["source"] == "t"].itertuples():
            seen[r.size] += r.copies
        rate = (got["target"] / got["source_size"])[got["source"] == "t"].iloc[0]
    n = Counter(1 + i % 7 for i in range(0, 40, 2))
    for size, k in n.items():
        assert seen[size] / (12 * k) == pytest.approx(rate, abs=0.35)


def test_mixing_many_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = [(i, "w " * (1 + i % 50), "en", "st"[i % 3 == 0], 0) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 300
    for _, mine in got.groupby("source"):
        assert abs((mine["copies"] * mine["size"]).sum() - mine["target"].iloc[0]) <= 50


def test_mixing_takes_no_text_without_words(spark):
    rows = [(i, "w " * 9, "en", "s", 0) for i in range(20)] + [(50 + i, t, "en", "s", 0) for i, t in enumerate(["", "\n\n", None, ""])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).toPandas()
    assert len(got) == 24 and (got[got["size"] == 0]["copies"] == 0).all() and (got[got["size"] > 0]["copies"] > 0).all()
    assert {r.doc_id for r in mixing.mixed(df).collect()} == set(range(20))


def test_mixed_rows_and_clashing_names(docs, empty):
    df = clashing(docs)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    plan = mixing.mix(docs).toPandas()
    assert out.count() == plan["copies"].sum()
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).columns == empty.columns


# -- 2


def measures(text):
    t = text or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, empty):
    rows = odd_documents()
    got = quality_rules.ledger(docs).select("_row.doc_id", "_row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits").collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, dup, rep = measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert bool(r.fail_bits & quality_rules.BASE) == (n < 50 or 100 * rep > 50 * n)
    assert quality_rules.ledger(empty).count() == 0
    df = clashing(docs)
    assert quality_rules.ledger(df).where(quality_rules.passes()).select(*C.unpacked("_row", df.columns)).columns == df.columns


def test_quality_of_a_very_long_text(spark):
    """Exact at any length: distinct words repeat no window, and one that repeats at the ends is found."""
    n = 5_000_000
    made = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("string")), " ")
    df = spark.range(1).select(F.explode(F.array(made, F.concat(made, F.lit(" 7 8 9")))).alias("text"))
    got = quality_rules.ledger(df).select("n_words", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == [(n, 0), (n + 3, 6)]


def test_quality_of_equal_hash_bits(spark, monkeypatch):
    """With few bits of hash left, windows that aren't equal share them; the words decide."""
    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.pmod(F.crc32(F.concat(*cols)), F.lit(5)).cast("long") * (1 << 60))
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(40)))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in quality_rules.ledger(df).select("_row.text", "n_repeat_words").collect():
        assert r.n_repeat_words == measures(r.text)[4]


def test_ablations(docs):
    bits = [r.fail_bits for r in quality_rules.ledger(docs).select("fail_bits").collect()]
    for r in quality_rules.ablations(quality_rules.ledger(docs)).collect():
        mask = quality_rules.POLICIES[quality_rules.POLICY]
        assert r.n_failed == sum(bool(b & r.bit) for b in bits)
        assert r.n_failed_alone == sum(b & mask == r.bit for b in bits)
        assert r.n_kept_without == sum(not b & mask & ~r.bit for b in bits)


# -- 3


def test_fingerprints(spark, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = fingerprints.query(spark, str(tmp_path)).collect()
    rows = sorted(odd_documents(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, (doc_id, t, *_) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        want.append((doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), edited == t))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(w[:3] for w in want)
    by_text = {}
    for r in fingerprints.fingerprints(docs).select("text", "fingerprint").collect():
        assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    texts = {(w[0], w[1], w[2]): w[3] for w in want}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if texts[r.doc_id, r.n_chars, r.edited_sha256]:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0
    empty.write.parquet(str(tmp_path / "none/documents.parquet"))
    assert fingerprints.query(spark, str(tmp_path / "none")).count() == 0
    docs.limit(1).write.parquet(str(tmp_path / "one/documents.parquet"))
    assert fingerprints.query(spark, str(tmp_path / "one")).first().near_next == 1.0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_hash(values):
    """The engine's 64-bit hash of strings (as UTF-8) and integers, from its definition: XXH64 chained by seed 42."""
    import xxhash

    seed = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little") if isinstance(v, int) else v
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def plain_anchors(text, k=5, s=2):
    w = words(text)
    if len(w) < k:
        return [(0, plain_hash([" ".join(w)]))] if w else []
    inner = [plain_hash(w[i : i + s]) for i in range(len(w) - s + 1)]
    out = []
    for i in range(len(w) - k + 1):
        mine = inner[i : i + k - s + 1]
        if min(mine) in (mine[0], mine[-1]):
            out.append((i, plain_hash([mine[0], mine[2], mine[3]])))
    return out


def test_anchors_and_likeness_by_brute_force(spark, tmp_path):
    rng = random.Random(6)
    base = [f"w{rng.randrange(300)}" for _ in range(4000)]
    texts = [t for _, t, *_ in odd_documents(n=40)][:60]
    texts += [" ".join(base), " ".join(base[2000:] + base[:2000]), " ".join(base[:1500] + ["new"] * 7 + base[1500:]), "a a a a a a a a", "a b c d e", "a b", None, ""]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fingerprints.query(spark, str(tmp_path)).collect()}

    def links(a):
        return {plain_hash([h, a[i + 1][1], (a[i + 1][0] - p).to_bytes(4, "little")]) if i + 1 < len(a) else plain_hash([h]) for i, (p, h) in enumerate(a)}

    def near(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, t in rows:
        t, following = t or "", rows[i - 1][1] or ""
        half = len(t) // 2
        own, edited, after = (plain_anchors(x) for x in (t, t[: len(t) - half] + following[:half], following))
        hashes = lambda a: {h for _, h in a}
        r = got[i]
        assert r.fingerprint == "".join(f"{x:08x}" for x in sorted((h % (1 << 64)) >> 32 for h in hashes(own))[:96])
        assert r.edited_fingerprint == "".join(f"{x:08x}" for x in sorted((h % (1 << 64)) >> 32 for h in hashes(edited))[:96])
        assert r.near_edited == pytest.approx(near(hashes(own), hashes(edited))) and r.near_next == pytest.approx(near(hashes(own), hashes(after)))
        assert r.aligned_edited == pytest.approx(near(links(own), links(edited))) and r.aligned_next == pytest.approx(near(links(own), links(after)))
    moved = got[61]  # the same passages in another order: nearly all anchors, and nearly all links
    assert moved.near_next > 0.99 and moved.aligned_next > 0.99


def test_fingerprints_keep_other_columns(docs):
    df = clashing(docs).drop("_text")
    got = fingerprints.fingerprints(df)
    assert set(got.columns) == {*df.columns, "anchors", "fingerprint"} and got.count() == len(odd_documents())


def test_syncmers_do_not_depend_on_context(spark):
    rng = random.Random(1)
    body = [f"w{rng.randrange(50)}" for _ in range(200)]
    texts = [" ".join(body), " ".join(["new", "words", "first", *body]), " ".join(body[:100] + ["inserted"] + body[100:])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    sets = {r.i: [(a.pos, a.hash) for a in r.x] for r in fingerprints.with_anchors(df, "t", "x").collect()}
    assert {(p + 3, h) for p, h in sets[0]} <= set(sets[1])
    gone = {p for p, h in sets[0]} - {p if p < 100 else p - 1 for p, h in sets[2]}
    assert all(96 <= p < 100 for p in gone)
    chosen = [p for p, _ in sets[0]]
    assert max(b - a for a, b in zip(chosen, chosen[1:])) <= fingerprints.SYMBOLS - fingerprints.INNER
    chars = fingerprints.with_anchors(df, "t", "x", unit="char").first()
    assert len(chars.x) > len(sets[0])


def test_next_document_over_many_ranges(spark):
    df = spark.createDataFrame([(i * i, f"text {i}") for i in range(500)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, ranges=150).where("_again = 0").collect()}
    assert got == {i * i: f"text {(i - 1) % 500}" for i in range(500)}


# -- 7


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def drop_lines(texts, least, chars=1):
    held = Counter(k for t in texts for k in {key_of(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < chars or held[key_of(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("limit", [0, 20, 100_000])
@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(docs, empty, least, limit, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", limit)
    rows = odd_documents()
    once = list(dict.fromkeys((r[0], r[1]) for r in rows))  # equal rows count once
    want = dict(zip(once, drop_lines([t for _, t in once], least), strict=True))
    found = line_dedup.line_dedup(docs, min_docs=least)
    got = found.select("_row.doc_id", "_row.text", "n_lines", "n_dropped", line_dedup.kept_text(F.col("_row.text"), F.col("keep")).alias("kept")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_dropped, r.kept) == want[r.doc_id, r.text]
    assert line_dedup.line_dedup(empty).count() == 0
    assert set(line_dedup.line_dedup(clashing(docs)).columns) == {"_row", "n_lines", "n_dropped", "keep"}


def test_lines_are_streamed_in_order(docs):
    """The sort within ranges is in the plan, and no exchange stands between it and the window."""
    _, keys = line_dedup.line_occurrences(docs)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    before = plan[: plan.index("rangepartitioning")]
    assert "Sort [_h0" in before and "Window" in before and before.count("Exchange") == 2, plan


def test_first_lines_stay(spark):
    df = spark.createDataFrame([(2, "a\nb\na"), (1, "b\nc"), (3, "c\na")], "doc_id long, text string")
    found = line_dedup.line_dedup(df, min_docs=1, keep_first=True)
    got = {r.doc_id: r.t for r in found.select("_row.doc_id", line_dedup.kept_text(F.col("_row.text"), F.col("keep")).alias("t")).collect()}
    assert got == {1: "b\nc", 2: "a", 3: ""}
    assert math.isfinite(len(got))
