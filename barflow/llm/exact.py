"""Exact duplicates of articles by content-defined chunk recipes, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .records import article_text

#: A chunk ends at the first line end or full stop after SHORTEST characters, or at LONGEST.
SHORTEST, LONGEST = 1024, 4096
_CHUNK = r"(?s).{%d,%d}?[\n.]|.{1,%d}" % (SHORTEST, LONGEST - 1, LONGEST)


def chunks(text: Column) -> Column:
    """The text cut where its own content says so: an edit moves no boundary beyond the next one, and the chunks joined give the text."""
    return F.regexp_extract_all(text, F.lit(_CHUNK), F.lit(0))


def digest(chunk: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), chunk).alias("a"), F.xxhash64(chunk, F.lit(2 * seed + 1)).alias("b"))


def identifies(texts: DataFrame, seed: int) -> bool:
    """Whether no two distinct chunks share a digest; every distinct chunk moves once, to be compared by its characters."""
    pieces = texts.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(digest(F.col("chunk"), seed).alias("digest"), "chunk")
    return pieces.distinct().groupBy("digest").count().where("count > 1").isEmpty()


def exact_duplicates(news: DataFrame, id_col: str = "id") -> DataFrame:
    """Groups of articles whose whole text (title, line break, summary) is identical.

    news: ``id``, ``title``, ``summary``; more columns are ignored. Returns one row per input row: ``id``, ``keep_id``
    (largest id of the group), ``group_size``, ``kept`` and ``text_sha256``.

    Texts are cut into content-defined chunks. The distinct chunks are gathered under their 128-bit digest and compared
    by their characters; should two share a digest, the next seed is tried, so the digests in use are verified
    identifiers. A document then is its ordered list of identifiers: only these lists, a hundredth of the text, are
    grouped, and joined with the groups of several rows. Groups of any size are summed before the shuffle; the join back
    is a sort-merge join whose hot keys Spark splits.

    Null title and summary make the empty text, which is a text like others. Rows with a null id are counted, and stay
    only if no row of the group has an id. Repeated rows with one id count as rows and share their ``kept``. No rows give no rows.
    """
    texts = news.select(F.col(id_col).alias("id"), article_text(news).alias("text"))
    seed = 0
    while not identifies(texts, seed):
        seed += 1
    recipes = texts.select("id", F.sha2("text", 256).alias("text_sha256"), F.transform(chunks(F.col("text")), lambda c: digest(c, seed)).alias("recipe"))
    # Written, so that both sides of the join are plain shuffles, which Spark can split at a hot recipe.
    groups = written(recipes.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return recipes.join(groups, "recipe", "left").select(
        "id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), keep_id.eqNullSafe(F.col("id")).alias("kept"), "text_sha256"
    )
