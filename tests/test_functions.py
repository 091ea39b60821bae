"""Column functions on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hirelake.functions import dates, money, values
from hirelake.operators import projection


def one_column(spark, data, type_, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, c {type_}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_coerced_numbers(spark):
    texts = ["abc", "12.7", None, "12d", " 8 ", "-3.9", "NaN", "1e3", "9007199254740993"]
    expected = [0, 12, 0, 0, 8, -3, 0, 1000, 9007199254740993]
    assert one_column(spark, texts, "string", values.cast_numeric_coerce("c")) == expected
    assert one_column(spark, [4.9, float("nan"), None, 1e30], "double", values.cast_numeric_coerce("c")) == [4, 0, 0, 0]


def test_nonzero_is_true(spark):
    data = [0.0, None, 0.5, 2.0, float("nan")]
    assert one_column(spark, data, "double", values.cast_bool_nonzero("c")) == [False, False, True, True, False]
    assert one_column(spark, [True, False, None], "boolean", values.cast_bool_nonzero("c")) == [True, False, False]


def test_zip_codes(spark):
    numbers = one_column(spark, [94105.0, 12345678.0, None], "double", values.zip_to_string("c"))
    assert numbers == ["94105.0", "12345678.0", None]
    assert one_column(spark, ["1E5", "E1 6AN"], "string", values.zip_to_string("c")) == ["1E5", "E1 6AN"]


def test_missing_tokens(spark):
    assert one_column(spark, ["nan", None, "x"], "string", values.replace_missing_token("c")) == [
        "No specified", "No specified", "x",
    ]


def test_company_key_spells_out_nulls(spark):
    df = spark.createDataFrame([(1, "Acme"), (2, None), (3, "Io")], "id bigint, name string")
    assert [r[0] for r in df.select(values.prefix_key("id", "name")).collect()] == ["1_Acm", "2_Non", "3_Io"]


def test_location_key_of_null_country(spark):
    df = spark.createDataFrame([(None, "CA")], "country string, state string")
    df = df.withColumns({c: values.cast_string_nulltoken(c) for c in df.columns})
    assert df.select(values.concat_key_fallback(df, ["country", "state"])).first()[0] == "NoneCA"


def test_epoch_bounds(spark):
    data = [1.7e12, None, 1e14, 1e20, float("nan"), -1.5]
    expected = [
        dt.datetime(2023, 11, 14, 22, 13, 20), None, None, None, None,
        dt.datetime(1969, 12, 31, 23, 59, 59, 998500),
    ]
    assert one_column(spark, data, "double", dates.epoch_ms_to_ts("c")) == expected


def test_epoch_text(spark):
    data = ["1700000000000", "2024-01-05", "2024-01-05 10:00:00", "soon", "100000000000000", None]
    assert one_column(spark, data, "string", dates.epoch_fallback_parse("c")) == [
        dt.datetime(2023, 11, 14, 22, 13, 20), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5, 10), None, None, None,
    ]


def test_epoch_seconds(spark):
    assert one_column(spark, [0, -1, 1700000000, 10**12, None], "bigint", dates.epoch_s_to_date("c")) == [
        dt.date(1970, 1, 1), dt.date(1969, 12, 31), dt.date(2023, 11, 14), None, None,
    ]


@pytest.mark.parametrize("zone", ["UTC", "Pacific/Auckland", "America/Los_Angeles"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        key = dates.format_date_key(dates.epoch_ms_to_ts("c"))
        assert one_column(spark, [1.7e12, 0.0], "double", key) == ["20231114", "19700101"]
        assert one_column(spark, [86399], "bigint", dates.epoch_s_to_date("c")) == [dt.date(1970, 1, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_date_keys_that_are_no_date(spark):
    assert one_column(spark, ["20240229", "20230229", "x", None], "string", dates.parse_date_key("c")) == [
        dt.date(2024, 2, 29), None, None, None,
    ]


def salary(spark, data, expr):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "i int, s double, code string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_currency(spark):
    data = [(100.0, "EUR"), (100.0, None), (100.0, "eur"), (None, "EUR"), (100.0, "XYZ")]
    assert salary(spark, data, money.currency_to_usd("s", "code")) == [pytest.approx(109), 100, 100, None, 100]


def test_guarded_currency(spark):
    data = [(100.0, "EUR"), (-5.0, "EUR"), (100.0, "USD"), (100.0, "XYZ"), (None, "EUR")]
    expected = [pytest.approx(110), -5, 100, 100, None]
    assert salary(spark, data, money.currency_to_usd("s", "code", guarded=True)) == expected


def test_pay_period(spark):
    data = [(10.0, "hourly"), (10.0, "ONCE"), (10.0, None), (-10.0, "MONTHLY")]
    assert salary(spark, data, money.annualize_salary("s", "code")) == [20800, 10, 10, -120]
    assert salary(spark, data, money.annualize_salary("s", "code", guarded=True)) == [20800, 10, 10, -10]


def test_currency_and_period_commute(spark):
    df = spark.range(1, 400).select(
        (F.col("id") * 1.37).alias("s"),
        F.element_at(F.array(*map(F.lit, ["EUR", "GBP", "CAD"])), (F.col("id") % 3 + 1).cast("int")).alias("cur"),
        F.element_at(F.array(*map(F.lit, ["HOURLY", "weekly"])), (F.col("id") % 2 + 1).cast("int")).alias("per"),
    )
    a = money.annualize_salary(money.currency_to_usd("s", "cur"), "per")
    b = money.currency_to_usd(money.annualize_salary("s", "per"), "cur")
    assert df.filter(F.abs(a - b) > 1e-6).isEmpty()


def test_unified_salary(spark):
    data = [(5.0, 1.0, 2.0), (None, 1.0, 2.0), (None, 1.0, None), (None, None, 2.0), (None, None, None)]
    df = spark.createDataFrame(data, "med double, lo double, hi double")
    assert [r[0] for r in df.select(money.unify_salary("med", "lo", "hi")).collect()] == [5.0, 1.5, 1.0, 2.0, None]


def test_cap_keeps_nulls(spark):
    data = [None, float("nan"), 5.0, 200.0]
    assert one_column(spark, data, "double", money.clip_upper_const("c", 100.0)) == [None, None, 5.0, 100.0]
    assert one_column(spark, data[2:], "double", money.clip_upper_const("c", None)) == [5.0, 200.0]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2)], "`x` int, `y` int").toDF(' "Job ID" ', "Pay Period")
    assert projection.normalize_columns(df).columns == ["job_id", "pay_period"]
    with pytest.raises(ValueError):
        projection.normalize_columns(df.toDF("a b", "A_B"))


def test_absent_columns_are_skipped(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert projection.select_existing(df, ["b", "views"]).columns == ["b"]
    assert projection.drop_columns_if_exist(df, ["views", "b"]).columns == ["a"]
    assert projection.fill_per_column(df, {"b": "x", "views": 0}).first() == (1, "x")
    assert projection.resolve_column(df, ["c", "d"], "out").columns == ["a", "b"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), float("nan"), "nan")], "a double, b float, c string")
    assert projection.nan_to_null(df).first() == (None, None, "nan")
