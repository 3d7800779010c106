"""From documents to a training mix: toxicity, exact and near duplicates, benchmark decontamination, source weights.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of documents.
Filters decide on rows, which they number for that: rows with a null doc_id and rows that share one have each a decision of
their own. Of copies the exact stage keeps the one with the largest doc_id, the near stage that with the smallest; rows
without one give way to others. The choice within a group is made on numbers alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import delete, noted, shared_folder, written
from barflow.llm.decontaminate import contaminated
from barflow.llm.exact import exact_duplicates
from barflow.llm.mixing import mixture
from barflow.llm.neardup import near_duplicates
from barflow.llm.queries import CATEGORIES, toxicity_labels
from barflow.llm.records import news_of, posts_of, table
from barflow.llm.toxicity import fit, score


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose tables of its own are deleted when the next one in this thread begins; its result has to be written by then."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with noted(docs):
            return work(spark, docs, sf_dir)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, ``row_no``, written with it, so that it is the same wherever it is read."""
    return written(docs.withColumn("row_no", F.monotonically_increasing_id()))


def _by_number(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("row_no"))


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose number is not among ``ids`` (one column, id)."""
    return rows.join(ids, rows["row_no"] == ids["id"], "left_anti").drop("row_no")


def _all_but_one(rows: DataFrame, groups: DataFrame, pick, *order) -> DataFrame:
    """Numbers (id) of the rows of each group (id, of) but the one that ``pick`` takes by ``order``; rows in no group are left out."""
    members = groups.where("of is not null").join(rows.select(F.col("row_no").alias("id"), "doc_id"), "id")
    stays = members.groupBy("of").agg(pick("id", F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.col("id"))).alias("stays"))
    return members.join(stays, "of").where("id <> stays").select("id")


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    chain = fit(posts_of(rows), toxicity_labels(table(spark, sf_dir, "labels")), CATEGORIES)
    return _without(rows, score(posts_of(_by_number(rows)), chain).where("rejected").select("id"))


@stage
def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    found = written(exact_duplicates(news_of(_by_number(rows))).where("group_size > 1").select("id", F.col("keep_id").alias("of")))
    return _without(rows, _all_but_one(rows, found, F.max_by, "doc_id"))


@stage
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    found = written(near_duplicates(news_of(_by_number(rows)), shingle=5, percent=80).select("id", F.col("component_id").alias("of")))
    return _without(rows, _all_but_one(rows, found, F.min_by, F.col("doc_id").isNull().alias("none"), "doc_id"))


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    return _without(rows, contaminated(news_of(_by_number(rows)), table(spark, sf_dir, "benchmark")).select("id"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(news_of(docs)).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic), ("exact dedup", drop_exact), ("near dedup", drop_near), ("decontamination", drop_contaminated), ("source mix", mix_sources),
]
#: A fitted chain has no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage wrote for itself goes when it is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, work in STAGES:
        path = shared_folder(spark)
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    with noted(docs):
        return docs
