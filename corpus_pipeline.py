"""From raw documents to token ids: quality rules, line dedup, near duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows it gets; all but the last return the columns of
documents, and others that docs has, whatever their names. n_chars follows the text.

Cases, of every stage: an empty table gives an empty one; a null doc_id, lang, source or n_chars is a value like others
(a null source is the last source of the mix, a null doc_id comes after all others where documents are put in order); a
null or empty text has no words. Of single stages:
- quality: such texts go, for they have too few words; rows that repeat are judged one by one; texts of any length are
  measured whole.
- lines: a line is dropped from all documents or none, so there are no ties; rows equal in doc_id and text count as one
  document and get equal texts. Copies in groups of ten or more lose their whole text.
- near_duplicates: one document of each class stays, the least by doc_id, then by hash of the text; of rows equal in both
  the least in all columns; of equal texts without a word one stays.
- mixture: rows equal in doc_id, source and text are repeated alike; a text without words isn't taken.
- tokens: a row for each row; a text without words has no ids and decodes to an empty one; a long one is encoded in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm import bpe, common, line_dedup, mixing, ngram_join, quality_rules

#: Mixing draws on random hashes, which SQL on other engines has not; tests hold run() against a brute-force version.
ORACLE_SQL = None


#: Distinct words that a worker of the last stage remembers: it shares an executor with what earlier stages left.
CACHE = 30_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy."""
    passed = quality_rules.ledger(docs).where(quality_rules.passes())
    return common.few_files(passed.select(*common.unpacked("_row", docs.columns)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go from all of them."""
    found = line_dedup.line_dedup(docs, min_docs=10, min_chars=1)
    row = F.col("_row")
    text = F.when(F.col("n_dropped") == 0, row["text"]).otherwise(line_dedup.kept_text(row["text"], F.col("keep")))
    found = found.select(row, text.alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return common.few_files(found.select(*[new.get(c, row[c]).alias(c) for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return common.few_files(ngram_join.one_of_each(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return common.few_files(mixing.mixed(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded)."""
    found = bpe.encode(docs, cache=CACHE)
    return common.few_files(found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixture),
    ("BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, common.cut(stage(spark, docs, sf_dir), free=True)
        if before is not given:
            common.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
