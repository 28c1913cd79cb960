"""From raw documents to token sequences: five stages, each an operator of ``tessera.llm`` over all that the one before it kept.

Every stage but the last returns the columns of ``documents``. Stages are rows-in, rows-out functions of (spark, docs, sf_dir);
``run`` writes what a stage returns to the shared folder and reads it back, so a lost executor costs one stage at most.
Empty tables pass through as empty tables, texts may be of any length, columns beside those of ``documents`` are kept whatever
their names; what becomes of nulls and repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, minhash, mixing, pii
from tessera.llm.common import free, stored, table


#: Languages whose documents stay, or None for all that were learned.
LANGUAGES: tuple[str, ...] | None = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go, and with ``LANGUAGES`` texts that are predicted to be in another language; a document
    without a ``lang`` gets the predicted one. All else stays as it is.

    Learned from the labelled documents that are not held out. Where there is nothing to learn from, nothing is predicted, and no
    document goes for its language. Repeated rows stay as often as they are there.
    """
    lettered, predicted, score = (free(n, docs.columns) for n in ("lettered", "lang_pred", "score"))
    found = langid.identify(docs, docs.filter(~langid.held_out(F.col("doc_id"))), lettered=lettered, predicted=predicted, score=score)
    known = F.col(predicted) != langid.UNDETERMINED
    stays = F.col(lettered) if LANGUAGES is None else F.col(lettered) & (~known | F.col(predicted).isin(*LANGUAGES))
    told = F.coalesce("lang", F.when(known, F.col(predicted)))
    return found.filter(stays).withColumn("lang", told).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the row with the smallest doc_id stays.

    Every row takes part by a number of its own: rows without a doc_id come last in their group, and of rows that share one the
    least by hash of the whole row stays. Rows without words are linked with nothing and stay.
    """
    # written once, so that a row has the same number in every pass
    number = free("row", docs.columns)
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = minhash.near_duplicates(rows, number).select(F.col(number).alias("row"), "component_id")
    content = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    named = stored(found.join(rows.select(F.col(number).alias("row"), "doc_id", content.alias("h")), "row"), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h", "row")).alias("x")
    groups = named.groupBy("component_id").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id", F.col("x.row").alias("best"))
    gone = named.join(groups, "component_id").filter("row != best").select("row")
    return rows.join(gone.withColumnRenamed("row", number), number, "left_anti").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; no document goes. Null texts stay null, repeated rows stay."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents repeat by epoch, and where a source's budget ends its last document is cut.

    A null source is a source of its own. Documents without words take no part; repeated rows are documents each.
    """
    return mixing.sampled(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: the token identifiers of every row; null and empty texts have none."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language", identified),
    ("near_duplicates", distinct),
    ("personal_data", redacted),
    ("mix", mixed),
    ("encode", encoded),
]

#: SQL can express neither the parses nor the token merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
