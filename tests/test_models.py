"""Validation without look-ahead and the store of models."""

import datetime

import pytest
from pyspark.sql import functions as F

from barflow.operators import ml

from .oracle_check import compare, duck


@pytest.fixture(scope="module")
def rows(spark):
    """A label of the sign of x, known five days later; every fourth x is noise."""
    day = F.date_add(F.lit(datetime.date(2020, 1, 1)), (F.col("id") / 3).cast("int"))
    x = F.pmod(F.xxhash64("id"), F.lit(2001)) / 1000 - 1
    label = F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3))).when(x > 0.3, 2).when(x < -0.3, 0).otherwise(1)
    return spark.range(900).select(F.col("id"), day.alias("ts"), F.date_add(day, 5).alias("label_until"), x.alias("x"), label.alias("label"), F.lit(0.0).alias("flat"))


def test_no_training_label_sees_its_test_stretch(rows):
    starts = ml.stretches(rows, 5)
    assert len(starts) == 6
    for a, b in zip(starts, starts[1:]):
        past, test = ml.split(rows, a, b)
        assert past.agg(F.max("label_until")).first()[0] < a
        got = test.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        assert got.lo == a and got.hi < b and got.n > 0
        # what is kept out is just what reaches into the stretch
        assert rows.where(F.col("ts") < F.lit(a)).count() - past.count() == rows.where((F.col("ts") < F.lit(a)) & (F.col("label_until") >= F.lit(a))).count() > 0


def test_every_row_behind_the_first_stretch_has_one_prediction(rows):
    seen = ml.out_of_fold(rows, ["x", "flat"], "positional")
    starts = ml.stretches(rows, ml.FOLDS["positional"])
    assert sorted(r.id for r in seen.select("id").collect()) == sorted(r.id for r in rows.where(F.col("ts") >= F.lit(starts[0])).collect())
    scores = ml.fold_scores(seen).orderBy("fold").collect()
    assert [r.fold for r in scores] == [1, 2, 3, 4, 5] and all(a.n_train < b.n_train for a, b in zip(scores, scores[1:]))
    assert all(r.accuracy > 0.7 for r in scores)
    assert ml.out_of_fold(rows.limit(0), ["x"], "swing").collect() == []


def test_a_worse_model_is_refused_and_a_broken_write_leaves_the_old_one(spark, rows, tmp_path, monkeypatch):
    store = ml.ModelStore(spark, str(tmp_path / "store"))
    model = ml.train(rows, ["x", "flat"], "positional")
    assert store.current() is None and store.load() is None
    assert store.offer(model, 0.60) and store.current()["version"] == 1
    assert not store.offer(model, 0.58) and store.offer(model, 0.595)
    assert (store.current()["version"], store.current()["score"]) == (2, 0.595)

    class Broken:
        def write(self):
            return self

        def save(self, path):
            (tmp_path / "store" / path.rsplit("/", 1)[1]).mkdir()
            raise OSError("no space")

    with pytest.raises(OSError):
        store.offer(Broken(), 0.9)
    assert store.current()["version"] == 2 and store.load().transform(rows.limit(3)).count() == 3
    assert store.offer(model, 0.7) and store.current()["version"] == 4  # the broken number is not used again
    store.forget(1)
    assert store._numbers("model") == store._numbers("current") == [4] and store.load() is not None


def test_fold_sizes_equal_sql(spark, sf_dir):
    from barflow.plans import registry

    assert compare(spark, duck(sf_dir), sf_dir, registry.queries()["fold_sizes"], registry.oracles()["fold_sizes"])[0] == "ok"
