import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ratingloom.functions import basket, numeric
from ratingloom.operators import cells, index, sampling
from ratingloom.operators.rank import top_items
from ratingloom.sources import tables


def test_duplicates_and_zeros(spark):
    rows = [(0, 1, 1.0, 0), (0, 1, 4.0, 1), (0, 2, 0.0, 2), (1, 1, 3.0, 3)]
    df = spark.createDataFrame(rows, "user long, item long, rating double, pos int")
    averaged = {(r["user"], r["item"]): r["rating"] for r in cells.rating_cells(df).collect()}
    assert averaged == {(0, 1): 2.5, (1, 1): 3.0}
    last = cells.rating_cells(df, "last", "pos", drop_zero=False)
    assert {(r["user"], r["item"]): r["rating"] for r in last.collect()} == {(0, 1): 4.0, (0, 2): 0.0, (1, 1): 3.0}
    assert cells.matrix_width(df).first()["width"] == 3
    assert tuple(cells.rating_profile(df).first()) == (4, 2, 2)


def test_dense_index_is_a_bijection(spark, sf):
    lines = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    numbered = index.dense_index(lines, ["l_orderkey", "l_linenumber", "l_partkey"]).orderBy("idx").collect()
    assert [r["idx"] for r in numbered] == list(range(6000))
    assert [tuple(r)[:3] for r in numbered] == sorted(tuple(r) for r in lines.collect())


def test_ids(spark):
    df = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3), ("a", 4)], "raw string, at int")
    assert {r["raw"]: r["idx"] for r in index.ids_by_first_seen(df, "raw", ["at"]).collect()} == {"b": 0, "a": 1, "c": 2}
    by_value = index.ids_by_value(df, "raw")
    assert {r["raw"]: r["idx"] for r in by_value.collect()} == {"a": 0, "b": 1, "c": 2}
    assert sorted(r["id"] for r in index.encode(df, "raw", by_value, "id").collect()) == [0, 0, 1, 1, 2]


def test_split(spark, sf):
    whole = tables.ratings_part(spark, sf)
    training, test = sampling.split_ratings(whole, 80)
    a, b = ({tuple(r) for r in x.collect()} for x in (training, test))
    assert a | b == {tuple(r) for r in whole.collect()} and not a & b
    assert 0.75 < len(a) / (len(a) + len(b)) < 0.85
    assert spark.range(1).select(numeric.hash_percent(F.lit(1), F.lit(2), seed=42)).first()[0] == 74


@pytest.mark.parametrize("n", [0, 1, 17, 499, 500])
def test_sample(spark, n):
    rows = spark.range(1000).withColumnRenamed("id", "pos")
    picked = [r["pos"] for r in sampling.in_order(sampling.sample_rows(rows, "pos", 500, n), "pos").collect()]
    assert len(picked) == len(set(picked)) == n
    assert picked == sorted(picked) and all(p < 500 for p in picked)
    again = sampling.sample_rows(rows.repartition(7), "pos", 500, n)
    assert sorted(r["pos"] for r in again.collect()) == picked


def test_sample_can_check(spark):
    rows = spark.range(10).withColumnRenamed("id", "pos")
    with pytest.raises(ValueError):
        sampling.sample_rows(rows, "pos", 11, 3, check=True)
    assert sampling.sample_rows(rows, "pos", 11, 30).count() == 10


def test_ties_go_by_item(spark):
    rows = [(0, 3, 1.0), (0, 2, 1.0 + 1e-9), (0, 1, 1.0 - 1e-9), (0, 4, 2.0)]
    df = spark.createDataFrame(rows, "user long, item long, score double")
    assert [r["item"] for r in top_items(df, 3).orderBy("rank").collect()] == [4, 1, 2]


def test_expressions(spark):
    row = spark.range(1).select(
        numeric.half_scale(F.lit(-1.0)).alias("low"),
        numeric.ratio(F.lit(1.0), F.lit(0.0)).alias("none"),
        numeric.implicit_confidence(F.lit(5.0)).alias("confident"),
        numeric.implicit_truth(F.lit(-0.5)).alias("no"),
        numeric.clamp_unit(F.lit(1.5)).alias("one"),
        numeric.stable_round(F.lit(0.0015625)).alias("up"),
        numeric.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("dot"),
        numeric.scale_by(F.array(F.lit(1.0), F.lit(2.0)), [2, 3]).alias("scaled"),
        basket.covers(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(3), F.lit(1))).alias("covers"),
        basket.covers(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("lacks"),
        basket.without(F.array(F.lit(1), F.lit(2)), F.lit(1)).alias("without"),
        basket.bracketed(F.array(F.lit(1), F.lit(2))).alias("bracketed"),
        basket.parse_items(F.lit("1, 2,3")).alias("parsed"),
    ).first().asDict()
    assert row == {
        "low": 0.0, "none": None, "confident": 2.5, "no": 0.0, "one": 1.0, "up": 0.001563, "dot": 11.0,
        "scaled": [2.0, 6.0], "covers": True, "lacks": False, "without": [2], "bracketed": "[1, 2]",
        "parsed": [1, 2, 3],
    }
    with pytest.raises(PySparkException):
        spark.range(1).select(basket.parse_items(F.lit("1,x"))).collect()
