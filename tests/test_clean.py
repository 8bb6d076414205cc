import math

import pytest
from pyspark.sql import functions as F

from riskloom import config
from riskloom.operators import clean as cl
from riskloom.operators import codes
from riskloom.operators.score import with_defaults


def test_duplicates_treat_missing_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (1, 2.0)], "a int, b double")
    assert cl.deduplicate(df).count() == 2


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "a double")
    assert cl.missing_counts(df).first().asDict() == {"n_rows": 3, "a": 2}
    assert cl.deduplicate(df).count() == 2


def test_threshold_is_strict(spark):
    rows = [(float(i), None if i < 20 else 1.0, None if i < 21 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, kept double, gone double")
    assert cl.select_by_missingness(df, ["a", "kept", "gone", "absent"], ["kept", "gone", "absent"]) == ["a", "kept"]
    labelled = df.withColumn("y", (F.col("a") > 50).cast("int"))
    assert cl.clean(labelled, "y", ["a", "kept", "gone"], candidates=["kept", "gone"]).features == ["a", "kept"]


def test_fill_values(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (1, 2.0), (2, 3.0), (2, 10.0), (None, None)], "code int, x double"
    )
    assert cl.fill_values(df, {"code": "mode", "x": "median"}) == {"code": 1, "x": 2.5}
    filled = cl.impute(df, {"code": "mode", "x": "median"})
    assert filled.where("code IS NULL OR x IS NULL").count() == 0
    assert cl.fill_values(df, {"x": "median"}, exact=False)["x"] in (2.0, 3.0)


def test_all_missing_column_is_named(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, code int")
    with pytest.raises(ValueError, match="code"):
        cl.impute(df, {"code": "mode"})
    with pytest.raises(ValueError, match="strategy"):
        cl.impute(df, {"code": "mean"})


def test_bad_text_is_dropped_not_filled(spark):
    df = spark.createDataFrame(
        [("1", 0), ("abc", 1), ("5d", 0), (" 7 ", 1), (None, 0), ("1e2", 1)], "x string, y int"
    )
    assert [r.x for r in cl.coerce_numeric(df, ["x"]).collect()] == [1.0, None, None, 7.0, None, 100.0]
    done = cl.clean(df, "y", ["x"])
    assert sorted(r.x for r in done.df.collect()) == [1.0, 7.0, 7.0, 100.0]


def test_missing_target(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (3, 0)], "a int, y int")
    assert [r.y for r in cl.binarise(df, "y").orderBy("a").collect()] == [0, 1, 0]
    assert cl.binarise(df, "y", drop_missing_target=True).count() == 2


def test_guarded_binarise_leaves_two_values(spark):
    two = spark.createDataFrame([(1,), (2,), (None,)], "y int")
    assert {r.y for r in cl.binarise(two, "y", only_if_multiclass=True).collect()} == {1, 2, None}
    three = spark.createDataFrame([(0,), (1,), (2,)], "y int")
    assert {r.y for r in cl.binarise(three, "y", only_if_multiclass=True).collect()} == {0, 1}


def test_clean_of_empty_table(spark):
    df = spark.createDataFrame([], "a double, ca double, y int")
    done = cl.clean(df, "y", ["a", "ca"], candidates=["ca"])
    assert done.df.count() == 0


def test_domain(spark):
    df = spark.createDataFrame(
        [(1, 50.0, 0, 1.0), (2, 19.0, 4, 1.04), (3, 101.0, None, 10.1), (4, 50.5, 3, 0.3)],
        "id int, age double, cp int, oldpeak double",
    )
    found = {(r.id, r.feature): r.rule for r in cl.validate_domain(df, "id", config.DOMAINS).collect()}
    assert found == {
        (2, "age"): "below", (2, "cp"): "option", (2, "oldpeak"): "step", (3, "age"): "above",
        (3, "cp"): "missing", (3, "oldpeak"): "above", (4, "age"): "step",
    }


def test_defaults_are_counted(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, age double")
    row = with_defaults(df, ["age", "ca", "thal"], {"thal": 3}).first()
    assert (row.ca, row.thal, row.n_defaulted) == (0.0, 3.0, 2)


def test_unmapped_codes(spark):
    df = spark.createDataFrame([(0, 1), (4, 1), (4, 0), (None, 1)], "cp int, target int")
    maps = {k: config.CODE_LABELS[k] for k in ("cp", "target")}
    assert [tuple(r) for r in codes.count_by(df, ["cp", "target"], maps).collect()] == [("Typical Angina", "Disease", 1)]
    kept = codes.count_by(df, ["cp", "target"], maps, keep_unmapped=True)
    assert kept.agg(F.sum("count")).first()[0] == 4


def test_code_between_two_codes_has_no_label(spark):
    df = spark.createDataFrame([(1.0,), (0.5,), (0.0,), (-0.0,)], "sex double")
    got = [r.word for r in codes.map_codes(df, "sex", config.CODE_LABELS["sex"], "word").collect()]
    assert got == ["Male", None, "Female", "Female"]


def test_names(spark):
    assert codes.raw_name("Cholesterol", config.DISPLAY_NAMES) == "chol"
    assert codes.raw_name("other", config.DISPLAY_NAMES) == "other"
    from riskloom.functions.columns import fixed, title_case

    row = spark.range(1).select(
        title_case(F.lit("st_slope x")).alias("t"), fixed(F.lit(34.55), 1).alias("a"),
        fixed(F.lit(-1234.5678), 3, signed=True).alias("b"), fixed(F.lit(0.5), 3, signed=True).alias("c"),
    ).first()
    assert tuple(row) == ("st_slope x".title(), f"{34.55:.1f}", f"{-1234.5678:+.3f}", f"{0.5:+.3f}")


def test_missing_column_is_named(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="nope"):
        cl.coerce_numeric(df, ["nope"])
    assert math.isclose(cl.missing_fraction(df).first().a, 0.0)
