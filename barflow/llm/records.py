"""The text records the operators read, and the mapping from the given tables to them.

``news``: id, title, summary, source, ticker (an article's text is its title, a line break and its summary).
``vectors``: id, vector (whole numbers), label (a training set's rows with their features as one vector).
``posts``: id, text_snippet (a social post's whole text). ``entries``: id, link, summary (a feed entry's html).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def article_text(news: DataFrame) -> Column:
    """The whole text of a news row; without title and summary it is empty."""
    return F.concat_ws("\n", news["title"], news["summary"])


def news_of(documents: DataFrame) -> DataFrame:
    """Documents as news: the first line is the title, the rest the summary, ``source`` names the feed.

    A null text has neither, so ``article_text`` gives back every text unchanged (null as empty).
    """
    text, cut = F.col("text"), F.instr("text", "\n")
    return documents.select(
        F.col("doc_id").alias("id"),
        F.when(cut > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(text).alias("title"),
        F.when(cut > 0, F.expr("substring(text, instr(text, '\n') + 1)")).alias("summary"),
        F.col("source"),
    )


def posts_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), F.col("text").alias("text_snippet"))


def entries_of(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("id"), F.col("url").alias("link"), F.col("html").alias("summary"))


def vectors_of(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """Embeddings as labelled vectors of whole numbers, ``floor(scale * x)``; a component that is not finite becomes null."""
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(scale * x))
    return embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: finite(x.cast("double"))).alias("vector"), "label")
