"""Operator 2: quality rules as a ledger of bitmasks.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule
(bit i: RULES[i]); policies are versioned masks over those bits, so that another policy, or the effect of leaving
a rule out, is bit arithmetic over the ledger and never touches a text again. No shuffle: each document is
measured where it is read.

Cases: a null text has no words and fails ``few_words``; an empty table gives an empty ledger; rows that
repeat, or share a doc_id, are measured one by one; there are no ties; all input columns ride along in one struct,
whatever their names. Texts of any length are measured exactly: sorted hashes only say which three-word windows may be
equal, and those are compared word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "#*$%&|<>"

#: (name, fails). Columns: those of measure().
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 5 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_text_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("capitals", "100 * n_capitals > 50 * word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: a document goes if it fails a rule of the mask.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": reduce(lambda a, b: a | b, BIT.values()),
}
POLICY = "v1"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """_row (all columns of the document) and its measurements, all long."""
    t = C.text_of(F.col(text))
    a = docs.select(C.packed(docs), t.alias("_text"), C.words_of(t).alias("_words"))
    count = lambda c, chars: F.char_length(c) - F.char_length(F.translate(c, chars, ""))
    a = a.select(
        "_row",
        "_text",
        "_words",
        F.size("_words").alias("_n"),
        F.length(F.bin(F.size("_words"))).alias("_bits"),
        F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(C.BLANKS)) != "").alias("_lines"),
    )
    # A window's hash with its last bits replaced by the position: sorting one array of longs brings together windows
    # that may be equal. The longer the text, the fewer bits of hash are left, so neighbours are compared by their words.
    window = lambda i: F.xxhash64(F.col("_words")[i], F.col("_words")[i + 1], F.col("_words")[i + 2])
    high = lambda x: F.call_function("shiftleft", F.call_function("shiftright", x, F.col("_bits")), F.col("_bits"))
    a = a.withColumn("_windows", F.when(F.col("_n") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: high(window(i)) + i))))
    w, words = F.col("_windows"), F.col("_words")
    near = lambda x, y: F.call_function("shiftright", x.bitwiseXOR(y), F.col("_bits")) == 0
    at = lambda x: (x - high(x)).cast("int")
    equal = lambda x, y: near(x, y) & (words[at(x)] == words[at(y)]) & (words[at(x) + 1] == words[at(y) + 1]) & (words[at(x) + 2] == words[at(y) + 2])

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get(w, i - 1), F.get(w, i + 1)
        either = lambda test: F.coalesce(test(x, before), F.lit(False)) | F.coalesce(test(x, after), F.lit(False))
        # Neighbours with equal bits and other words are so rare that all windows can be looked through for them.
        return F.when(~either(near), False).when(either(equal), True).otherwise(F.exists(w, lambda y: (y != x) & equal(x, y)))

    a = a.withColumn("_places", F.sort_array(F.transform(F.filter(w, twice), at)))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last")),
        lambda s: s["n"],
    )
    return a.select(
        "_row",
        F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.translate("_text", C.BLANKS, "")).cast("long").alias("word_chars"),
        count(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_text_lines"),
        count(F.col("_text"), C.UPPER).cast("long").alias("n_capitals"),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """measure(), with fail_bits. An entry is the one element of an exploded array: that keeps Catalyst from
    copying all of the measuring into a filter on the bits, where it would run again for each use."""
    m = measure(docs, text)
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(fails), F.lit(BIT[name])).otherwise(0) for name, fails in RULES])
    entry = F.struct(*[c for c in m.columns if c != "_row"], bits.alias("fail_bits"))
    return m.select("_row", F.explode(F.array(entry)).alias("_entry")).select("_row", "_entry.*")


def passes(policy: str = POLICY, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """One row per rule of the policy: how many documents fail it, fail it alone, and stay when it is left out.
    One pass: documents are first counted by their bits, of which there are few kinds."""
    mask = POLICIES[policy]
    kinds = entries.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BIT.items() if bit & mask]))
    each = kinds.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    held = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(held, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return ledger(docs).select(
        F.col("_row.doc_id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines", "n_capitals", "fail_bits",
        (~passes("base")).alias("base_failed"),
        passes().alias("kept"),
    )


def ablation_query(spark, sf_dir: str) -> DataFrame:
    return ablations(ledger(C.table(spark, sf_dir, "documents").select("text")))


_LEDGER_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM places
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n >= 2) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_text_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_text_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 50 * word_chars THEN 32 ELSE 0 END)::INTEGER AS fail_bits FROM m
)
"""
ORACLE_SQL = _LEDGER_SQL + "SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM f"
ABLATION_SQL = (
    _LEDGER_SQL
    + """SELECT rule, bit, count(*) FILTER (WHERE fail_bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE fail_bits = bit) AS n_failed_alone,
  count(*) FILTER (WHERE fail_bits IN (0, bit)) AS n_kept_without
FROM f, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16), ('capitals', 32)) AS r(rule, bit) GROUP BY rule, bit"""
)
