"""The registered queries of the operators: each maps the given tables to an operator's records and its results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .exact import exact_duplicates
from .extraction import extract
from .mixing import mixture
from .neardup import near_duplicates
from .negatives import hard_negatives
from .passages import repeated_passages
from .pieces import piece_ids
from .pseudonyms import KINDS, pseudonyms
from .quality import quality_votes
from .records import entries_of, news_of, posts_of, table, vectors_of
from .runs import word_runs
from .tokencount import token_counts
from .toxicity import toxicity

#: Stands for a secret in the registered query; a deployment passes its own.
EXAMPLE_KEY = b"an example key of thirty-two byt"
CATEGORIES = ("toxic", "toxic_prose", "toxic_junk")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(news_of(table(spark, sf_dir, "documents")), EXAMPLE_KEY).select(F.col("id").alias("doc_id"), "text", *(f"n_{k}" for k in KINDS))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(news_of(table(spark, sf_dir, "documents")), vocabulary(), 512).withColumnRenamed("id", "doc_id")


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(news_of(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(news_of(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "start_word", "end_word", F.col("first_id").alias("first_doc_id"), "first_start", "first_end", "similarity")


def toxicity_labels(labels: DataFrame) -> DataFrame:
    """Marks of the label table as categories: toxic at all, toxic in prose, toxic in junk."""
    toxic, prose = F.coalesce("toxic", F.lit(0)) == 1, F.coalesce("quality", F.lit(1)) == 1
    return labels.select(F.col("doc_id").alias("id"), *(c.cast("int").alias(n) for n, c in zip(CATEGORIES, (toxic, toxic & prose, toxic & ~prose), strict=True)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(posts_of(table(spark, sf_dir, "documents")), toxicity_labels(table(spark, sf_dir, "labels")), CATEGORIES)
    return scored.withColumnRenamed("id", "doc_id").withColumnRenamed("rejected", "toxic")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    scored = quality_votes(news_of(table(spark, sf_dir, "documents")), labels)
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(news_of(table(spark, sf_dir, "documents")), shingle=2, percent=80).withColumnRenamed("id", "doc_id")


def op8_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(news_of(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(news_of(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(entries_of(table(spark, sf_dir, "pages"))).select(F.col("id").alias("page_id"), F.col("link").alias("url"), "text", "n_chars")


def op11_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_ids(news_of(table(spark, sf_dir, "documents")), vocabulary("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def looped(documents: DataFrame) -> DataFrame:
    """Documents of which every tenth, by its hash, repeats its own words from one place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = documents.withColumns({"h": h, "words": F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))}).withColumn("n", F.size("words"))
    placed = words.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    loop = F.expr("array_join(transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, loop).otherwise(F.col("text")).alias("text"), "source")


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(news_of(looped(table(spark, sf_dir, "documents"))), exponent=4, least=6)
    # greatest length / period: a pair of whole numbers is compared by the product across
    better = "y.length * x.period > x.length * y.period or (y.length * x.period = x.length * y.period and (y.start, y.period) < (x.start, x.period))"
    best = F.expr(f"if(size(runs) > 0, aggregate(runs, runs[0], (x, y) -> if({better}, y, x)), null)")
    listed = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    rows = found.withColumn("best", best)
    return rows.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vectors_of(table(spark, sf_dir, "embeddings")).withColumn("label", F.expr("if(id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives(vectors, F.col("id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pseudonyms, op2_token_counts, op3_mixture, op4_repeated_passages, op5_toxicity, op6_quality_votes, op7_near_duplicates, op8_contaminated,
        op9_exact_duplicates, op10_main_text, op11_piece_ids, op12_word_runs, op13_hard_negatives,
    )
}

#: Shares by water level: sources in the order of cap by weight, the level at which the rest is shared, and who is capped by it.
MIXTURE_SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
n AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM s GROUP BY source),
o AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS words FROM n),
l AS (SELECT *, words - CAST(coalesce(sum(3 * source_size) OVER w, 0) AS BIGINT) AS rest, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS weights
  FROM o WINDOW w AS (ORDER BY cap, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT coalesce((SELECT CAST(rest AS DOUBLE) / weights FROM l WHERE 3 * source_size > CAST(rest AS DOUBLE) / weights * weight ORDER BY cap, encode(source) NULLS LAST LIMIT 1), 1e300) AS level),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target, CAST(floor(least(CAST(3 * source_size AS DOUBLE), level * weight) + 0.5) AS BIGINT) AS quota FROM o, v),
b AS (SELECT doc_id, s.source, size, source_size, target, quota, CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE quota // source_size * size + greatest(least(quota % source_size - start, size), 0) END AS taken FROM b
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]] ELSE list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) END AS items FROM w),
n AS (SELECT doc_id, len(items) AS n FROM g),
x AS (SELECT doc_id, unnest(items) AS item FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * i >= 80 * (u.n + v.n - i)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, d.b FROM r JOIN d ON r.reach = d.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach) AS component_id, min(reach) = n.doc_id AS kept FROM n JOIN r ON n.doc_id = r.node GROUP BY n.doc_id, n.n
"""

NEGATIVES_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3
"""

ORACLES: dict[str, str] = {
    "op13_hard_negatives": NEGATIVES_SQL,
    "op3_mixture": MIXTURE_SQL,
    "op7_near_duplicates": NEAR_SQL,
    "op9_exact_duplicates": """
WITH g AS (SELECT coalesce(text, '') AS text, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY coalesce(text, ''))
SELECT doc_id, keep_id, group_size, keep_id IS NOT DISTINCT FROM doc_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256 FROM documents d JOIN g ON coalesce(d.text, '') = g.text""",
}
