import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabwright.functions import convert
from tabwright.operators import cleaning as C
from tabwright.session import cut_lineage

NAN = float("nan")


@pytest.fixture(scope="module")
def gaps(spark):
    values = [None, 1.0, None, None, 4.0, None]
    return spark.createDataFrame([(i, g, v) for g in "ab" for i, v in enumerate(values)], "id long, g string, x double")


def column(df, name, *order):
    return [r[name] for r in (df.orderBy(*order) if order else df).collect()]


def test_null_is_not_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (3, None), (4, -0.0), (5, 0.0)], "id long, x double")
    kept = C.clean_one(df, C.DropMissing())
    assert kept.count() == 4
    filled = column(C.clean_one(df, C.FillMissing("x", "constant", fill_value=9)), "x", "id")
    assert math.isnan(filled[1]) and filled[2] == 9.0
    assert C.clean_one(df.select(F.col("x") + 0).filter("not isnan(x + 0)").toDF("x"), C.DropDuplicates()).count() == 3


@pytest.mark.parametrize(
    "strategy,want",
    [
        ("forward", [None, 1, 1, 1, 4, 4]),
        ("backward", [1, 1, 4, 4, 4, None]),
        ("interpolate", [None, 1, 2, 3, 4, None]),
    ],
)
def test_ordered_fills(gaps, strategy, want):
    op = C.FillMissing("x", strategy, order_by=("id",), partition_by=("g",))
    out = C.clean_one(gaps.repartition(3), op)
    assert out.columns == gaps.columns
    assert column(out, "x", "g", "id") == want * 2


def test_ordered_fill_over_the_whole_table(gaps):
    out = C.clean_one(gaps, C.FillMissing("x", "forward", order_by=("g", "id")))
    assert column(out, "x", "g", "id") == [None, 1, 1, 1, 4, 4, 4, 1, 1, 1, 4, 4]


def test_statistics_fills(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "x long")
    assert sorted(column(C.clean_one(df, C.FillMissing("x", "mean")), "x")) == [1, 2, 3, 4, 10]
    assert 2.5 in column(C.clean_one(df, C.FillMissing("x", "median")), "x")
    text = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), (None,)], "c string")
    assert sorted(column(C.clean_one(text, C.FillMissing("c", "mode")), "c")) == ["a", "a", "a", "b", "b"]


def test_constant_column(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(4)], "id long, x double")
    assert set(column(C.clean_one(df, C.Standardize("x")), "x")) == {None}
    assert set(column(C.clean_one(df, C.Normalize("x")), "x")) == {None}
    assert C.clean_one(df, C.RemoveOutliers("x", "zscore")).count() == 0
    assert C.clean_one(df, C.RemoveOutliers("x", "iqr")).count() == 4


@pytest.mark.parametrize("op", [C.FillMissing("x", "mean"), C.Standardize("x"), C.Normalize("x"), C.RemoveOutliers("x")])
def test_empty_and_single_row(spark, op):
    df = spark.createDataFrame([(1, 2.0)], "id long, x double")
    C.clean_one(df.filter("false"), op).collect()
    C.clean_one(df, op).collect()


def test_drop_missing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, 1.0, "b"), (4, 2.0, "c")], "a int, b double, c string")
    assert C.clean_one(df, C.DropMissing("columns")).columns == ["a"]
    assert C.clean_one(df, C.DropMissing("columns", 0.25)).columns == ["a", "c"]
    assert C.clean_one(df.filter("false"), C.DropMissing("columns")).columns == df.columns


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, None, 2), (4, None, 2), (5, "b", 3)], "id long, k string, v int")
    first = C.clean_one(df, C.DropDuplicates(("k",), "first", ("id",)))
    assert column(first, "id", "id") == [1, 3, 5]
    assert column(C.clean_one(df, C.DropDuplicates(("k",), "last", ("id",))), "id", "id") == [2, 4, 5]
    assert column(C.clean_one(df, C.DropDuplicates(("k", "v"), "none")), "id", "id") == [5]
    assert C.clean_one(df.drop("id"), C.DropDuplicates(keep="none")).count() == 1
    with pytest.raises(C.CleaningError):
        C.DropDuplicates(("k",), "first")


def test_casts(spark):
    texts = ["1", "1.7", "x", " 2", "true", "yes", "2024-01-02", "NA", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")

    def cast(target, **kw):
        return column(C.clean_one(df, C.CastType("s", target, on_error="null", **kw)), "s", "id")

    assert cast("int") == [1, None, None, 2, None, None, None, None, None]
    assert cast("float")[:4] == [1.0, 1.7, None, 2.0]
    assert cast("boolean")[4:6] == [True, None]
    assert str(cast("datetime", date_format="%Y-%m-%d")[6]).startswith("2024-01-02")
    for target in ("int", "boolean", "datetime"):
        with pytest.raises(PySparkException):
            C.clean_one(df, C.CastType("s", target)).collect()
    number = spark.createDataFrame([(1.9,), (-1.9,)], "x double")
    assert sorted(column(C.clean_one(number, C.CastType("x", "int")), "x")) == [-1, 1]


def test_date_pattern():
    assert convert.datetime_pattern("%d/%m/%Y at %H:%M:%S") == "dd/MM/yyyy 'a''t' HH:mm:ss"
    with pytest.raises(ValueError):
        convert.datetime_pattern("%Q")


def test_unicode_text(spark):
    df = spark.createDataFrame([(1, "\t É٢ x!  y "), (2, ""), (3, None)], "id long, s string")
    clean = lambda *ops: column(C.clean_one(df, C.StringClean("s", ops)), "s", "id")
    assert clean("strip") == ["É٢ x!  y", "", None]
    assert clean("remove_numbers")[0] == "\t É x!  y "
    assert clean("remove_special")[0] == "\t  x  y "
    assert clean("strip", "lowercase", "remove_whitespace") == ["é٢ x! y", "", None]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id long, c string")
    assert column(C.clean_one(df, C.EncodeCategorical("c")), "c", "id") == [2, 0, 1, 2]
    hot = C.clean_one(df, C.EncodeCategorical("c", "onehot"))
    assert hot.columns == ["id", "c_null", "c_a", "c_b"]
    assert [tuple(r) for r in hot.orderBy("id").collect()] == [(1, 0, 0, 1), (2, 1, 0, 0), (3, 0, 1, 0), (4, 0, 0, 1)]
    wide = spark.range(51).select(F.col("id").cast("string").alias("c"))
    assert len(C.clean_one(wide, C.EncodeCategorical("c", "onehot")).columns) == 51
    assert len(C.clean_one(wide, C.EncodeCategorical("c", "onehot", 51)).columns) == 51
    with pytest.raises(C.CleaningError):
        C.clean_one(wide, C.EncodeCategorical("c", "onehot", 50))


def test_whitelist_and_validation():
    assert C.op_from_record({"operation": "exec"}) is None
    op = C.op_from_record({"operation": "fill_missing", "column": "x", "confidence": 7, "parameters": {"strategy": "median"}})
    assert op.confidence == 1.0 and op.strategy == "median"
    for bad in (
        lambda: C.FillMissing("x", "constant"),
        lambda: C.FillMissing("x", "forward"),
        lambda: C.DropMissing("diagonal"),
        lambda: C.RemoveOutliers("x", "guess"),
        lambda: C.FilterRows("x", "like", 1),
        lambda: C.StringClean("x", ("eval",)),
    ):
        with pytest.raises(ValueError):
            bad()


def test_chain_result_and_errors(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 100.0)], "id long, x double")
    good = [
        {"operation": "drop_missing", "description": "d"},
        {"operation": "shell", "description": "no"},
        {"operation": "rename_column", "column": "x", "parameters": {"new_name": "y"}},
    ]
    result = C.apply_records(df, good)
    assert result.success and result.skipped == ["shell"] and result.applied == ["drop_missing: d", "rename_column: No description"]
    assert result.df.collect() and result.rows() == (3, 2)
    broken = C.apply_records(df, [*good, {"operation": "drop_column", "column": "gone"}])
    assert not broken.success and broken.df is df and "gone" in broken.error
    skipping = C.preprocess_records(df, [{"op": "drop_columns", "columns": ["gone"]}, {"op": "drop_nulls"}, {"op": "filter", "column": "x", "condition": "lt", "value": 50}])
    assert skipping.success and len(skipping.errors) == 1 and skipping.df.count() == 1


def test_preview_is_head_of_the_result(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    records = [{"operation": "filter_rows", "column": "x", "parameters": {"condition": "gt", "value": 3}}]
    result = C.apply_records(df, records, preview=20)
    assert result.df.count() == 20 and result.columns_after == 2


def test_fitted_chain_runs_on_new_data(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    new = spark.createDataFrame([(None,), (5.0,)], "x double")
    fitted = C.fit(train, [C.FillMissing("x", "mean"), C.Normalize("x")])
    assert sorted(column(fitted.apply(new), "x")) == [0.5, 2.0]


def test_shared_statistics_see_the_right_input(spark):
    df = spark.createDataFrame([(float(v), float(v)) for v in (1, 2, 3, 100)], "a double, b double")
    ops = [C.Normalize("a"), C.RemoveOutliers("b", "iqr", 1.5), C.Normalize("b")]
    step = df
    for op in ops:
        step = C.clean_one(step, op)
    assert sorted(C.clean(df, ops).collect()) == sorted(step.collect())


def test_result_does_not_depend_on_partitioning(spark, gaps):
    ops = [C.FillMissing("x", "forward", order_by=("g", "id")), C.FillMissing("x", "median"), C.Standardize("x")]
    one = C.clean(gaps.coalesce(1), ops).orderBy("g", "id").collect()
    many = C.clean(gaps.repartition(6), ops).orderBy("g", "id").collect()
    assert one == many


def test_range_midpoint(spark):
    texts = ["0-10", "5+", "7", "-5.0--1.0", "-3-4", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    got = column(df.select("id", convert.range_midpoint(F.col("s")).alias("m")), "m", "id")
    assert got == [5.0, 5.0, 7.0, -3.0, 0.5, None]


def test_type_inference(spark):
    rows = [("1", "1", "true", "2024-01-02", "x", "1d"), ("NA", "2.5", "False", ".", "1", "2"), ("007", "", "null", "2024-01-02 10:00:00", "", "3")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    out = convert.infer_types(convert.null_markers(df))
    assert [t for _, t in out.dtypes] == ["bigint", "double", "boolean", "timestamp_ntz", "string", "string"]


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(10).withColumn("t", F.lit("x"))
    assert cut_lineage(df).count() == 10
