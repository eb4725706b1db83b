from pyspark.sql import functions as F

from loomspark.operators import validate as v


def errors(df, *rules, **options):
    return v.validate(df, list(rules), **options).first().errors


def test_shape_looks_at_every_array_and_axis(spark):
    ragged = spark.createDataFrame([([[1], [1, 2, 3]],)], "x array<array<int>>")
    assert errors(ragged, v.shape("x", ["*", "*", 2])) == ["x: Dimension 2: expected 2, got 1"]
    assert errors(ragged, v.shape("x", ["*", 2, "*"])) == []
    assert errors(ragged, v.shape("x", ["*", 2])) == ["x: Expected 2 dimensions, got 3"]
    deep = spark.createDataFrame([([[[1, 2], [3, 4]]],)], "x array<array<array<int>>>")
    assert errors(deep, v.shape("x", [1, 1, 2, 2])) == []
    assert errors(deep, v.shape("x", [1, 1, 2, 3])) == ["x: Dimension 3: expected 3, got 2"]
    assert errors(deep, v.shape("x", [2, 1, 2, "*"])) == ["x: Dimension 0: expected 2, got 1"]
    flat = spark.createDataFrame([(1.0,)], "x double")
    assert errors(flat, v.shape("x", ["*"])) == [] and errors(flat, v.shape("x", ["*", 3])) == ["x: Expected 2 dimensions, got 1"]
    nulls = spark.createDataFrame([(None,), ([None, [1, 2]],)], "x array<array<int>>")
    assert errors(nulls, v.shape("x", ["*", 2, 2])) == []
    assert errors(ragged.limit(0), v.shape("x", ["*", 5, 5])) == []


def test_custom_rules_as_functions(spark):
    df = spark.createDataFrame([(1,), (5,)], "x int")
    assert errors(df, v.custom("x", lambda c: c < 9)) == []
    assert errors(df, v.custom("x", lambda c: c < 3, "too large")) == ["x: too large"]

    def broken(c):
        raise KeyError("no such thing")

    assert errors(df, v.custom("x", broken)) == ["x: Validation error: 'no such thing'"]
    assert errors(df, v.custom("x", lambda c: F.col("y") > c))[0].startswith("x: Validation error: ")


def test_shifts_are_part_of_a_validation(spark):
    df = spark.createDataFrame([(b, float(b % 2 + i) + (50 if b == 12 else 0)) for b in range(13) for i in range(4)], "b int, x double")
    out = v.validate_batches(df, [v.in_range("x", 0, 100)], "b", ["x"]).first()
    assert not out.ok and out.errors == ["x: Significant mean shift detected", "x: Significant range shift detected"]
    assert v.validate_batches(df.filter("b < 12"), [], "b", ["x"]).first().ok
