"""The pipeline against brute force, stage by stage, and the registered queries on the small tables."""

import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from barflow.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, duck

from .conftest import prose
from .test_duplicates import brute_near
from .test_kernels import plain_words

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, key):
    status, _ = compare(spark, duck(SMALL), SMALL, QUERIES[key], ORACLES[key])
    assert status.startswith("ok"), status


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", ["op1_pseudonyms", "op2_token_counts", "op5_toxicity", "op6_quality_votes"])
def test_one_row_for_each_document(spark, key):
    ids = sorted(r.doc_id for r in QUERIES[key](spark, SMALL).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())


def test_extracted_text_is_that_of_the_article(spark):
    import html

    got = {r.page_id: r for r in QUERIES["op10_main_text"](spark, SMALL).collect()}
    for p in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[p.page_id].text == text and got[p.page_id].n_chars == len(text) and got[p.page_id].url == p.url


def test_each_stage_keeps_what_brute_force_keeps(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scores = {r.doc_id: r.toxic for r in QUERIES["op5_toxicity"](spark, SMALL).collect()}
    items = [plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SMALL).write.parquet(path := str(tmp_path / str(n)))
        docs = spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            want = {i for i in before if not scores[i]}
        elif name == "exact dedup":
            last = {r.text: i for i, r in sorted(before.items())}
            want = set(last.values())
        elif name == "near dedup":
            want = {i for i, (_, low) in brute_near([(i, r.text) for i, r in before.items()], 5).items() if i == low}
        elif name == "decontamination":
            want = {i for i, r in before.items() if not any(x in plain(r.text) for x in items)}
        else:
            size = defaultdict(int)
            for r in before.values():
                size[r.source] += len(plain_words(r.text))
            assert set(after) == set(before) and all(r.source_size == size[r.source] and r.taken <= 3 * r.size for r in after.values())
            assert all(abs(sum(r.taken for r in after.values() if r.source == s) - next(r.target for r in after.values() if r.source == s)) <= 1 for s in size)
            continue
        assert set(after) == want and docs.columns == columns, name
        assert all(after[i] == before[i] for i in after)


def test_null_and_repeated_ids_have_decisions_of_their_own(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scores = {r.doc_id for r in QUERIES["op5_toxicity"](spark, SMALL).collect() if r.toxic}
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    kept = sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect())
    toxic = docs.where(F.col("doc_id").isin(sorted(scores))).limit(1).cache()
    clean, other = (docs.where(F.col("doc_id") == i).cache() for i in kept[:2])
    bad, text, second = (f.first().text for f in (toxic, clean, other))
    add = lambda i, t: docs.limit(1).withColumn("doc_id", F.lit(i).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit(t))
    words = lambda n: " ".join(prose(n, 90))
    shared = kept[2]
    rows = [(None, bad), (None, text), (kept[1], second), (None, f"{words(1)} {item} {words(2)}"), (shared, bad), (None, words(3)), (None, words(3) + " more")]
    more = docs
    for i, t in rows:
        more = more.unionByName(add(i, t))
    more.write.parquet(str(tmp_path / "in/documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"in/{name}.parquet"))
    d, now = str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in/documents.parquet"))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, d).write.parquet(str(tmp_path / str(n)))
        now = spark.read.parquet(str(tmp_path / str(n)))
    texts = [(r.doc_id, r.text) for r in now.collect()]
    assert not any(t == bad for _, t in texts) and sum(t == text for _, t in texts) == 1 and (kept[0], text) in texts
    assert texts.count((kept[1], second)) == 1 and not any(item in t for _, t in texts) and shared in {i for i, _ in texts}
    assert sum(words(3) in t for _, t in texts) == 1
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.run(spark, d).collect()) == sorted(i or -1 for i, _ in texts)


def plain(text):
    return " ".join(re.findall(r"\w+", text.lower()))


def test_pipeline_of_no_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
