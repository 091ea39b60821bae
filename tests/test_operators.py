"""Operators on small fixtures, against brute force, and under skew."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hirelake.operators import ordering, profile, quantiles, skew

LAYOUTS = (1, 17)


def doubles(spark, values):
    return spark.createDataFrame([(x,) for x in values], "x double")


# Quantiles


def test_quartiles_ignore_nulls(spark):
    df = doubles(spark, [1.0, 2.0, 3.0, 4.0, None, float("nan")])
    assert quantiles.exact_quantiles(df, ["x"], (0.25, 0.75)) == {"x": [1.75, 3.25]}


def test_no_values_no_quantile(spark):
    df = doubles(spark, [None, None])
    assert quantiles.exact_quantiles(df, ["x"], (0.5,)) == {"x": [None]}
    assert [r[0] for r in quantiles.iqr_cap(df, ["x"]).collect()] == [None, None]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e9, 1e9)), min_size=1, max_size=60),
    sort_limit=st.sampled_from([0, 1, 5]),
)
def test_narrowing_is_exact_whatever_the_sketch_says(spark, values, sort_limit):
    qs = (0.0, 0.25, 0.5, 0.9, 1.0)
    found = quantiles.exact_quantiles(doubles(spark, values), ["x"], qs, sort_limit=sort_limit, accuracy=3)["x"]
    assert found == pytest.approx([float(np.quantile(values, q)) for q in qs], rel=1e-12, abs=1e-9)


def test_narrowing_on_many_rows_with_one_frequent_value(spark):
    df = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**6)) / 7).alias("x"),
        (F.col("id") * 1.0).alias("y"),
    )
    values = np.array(df.collect())
    found = quantiles.exact_quantiles(df, ["x", "y"], (0.1, 0.25, 0.5, 0.75), sort_limit=1000, accuracy=100)
    for i, name in enumerate("xy"):
        assert found[name] == [float(np.quantile(values[:, i], q)) for q in (0.1, 0.25, 0.5, 0.75)]


def test_cap_never_raises_a_value_and_keeps_nulls(spark):
    df = spark.range(1000).select(
        F.col("id").alias("i"), F.when(F.col("id") % 7 > 0, F.exp(F.col("id") / 50.0)).alias("x")
    )
    capped = quantiles.iqr_cap(df, ["x"]).withColumnRenamed("x", "y").join(df, "i")
    assert capped.filter("y > x OR (x IS NULL) <> (y IS NULL)").isEmpty()
    assert capped.agg(F.max("y")).first()[0] < df.agg(F.max("x")).first()[0]


def test_approximate_caps(spark):
    df = spark.range(1, 10001).select(F.col("id").cast("double").alias("x"))
    assert quantiles.upper_caps(df, ["x"], approx=1000)["x"] == pytest.approx(15000, rel=0.01)


def test_even_median_is_cut(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 5.0), (3, None)], "i int, size double")
    assert sorted(quantiles.median_impute(df, "size").collect()) == [(1, 4), (2, 5), (3, 4)]
    assert quantiles.median_impute(df.filter("i = 3"), "size").first() == (3, 0)


def test_cap_gives_doubles_with_and_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "x bigint, y bigint")
    capped = quantiles.iqr_cap(df, ["x", "y"])
    assert dict(capped.dtypes) == {"x": "double", "y": "double"} and capped.count() == 2


@pytest.mark.parametrize("kind", ["decimal(10,2)", "tinyint", "float"])
def test_other_numbers_are_imputed(spark, kind):
    df = spark.createDataFrame([(4.0,), (7.0,), (None,)], "v double").select(F.col("v").cast(kind).alias("v"))
    assert sorted(r[0] for r in quantiles.median_impute(df, "v").collect()) == [4, 5, 7]


def test_many_columns_share_one_budget(spark, monkeypatch):
    df = spark.range(2000).select(*[(F.xxhash64("id", F.lit(i)) / 1e9).alias(f"c{i}") for i in range(200)])
    held = []
    lists = quantiles.F.collect_list
    monkeypatch.setattr(quantiles.F, "collect_list", lambda c: held.append(c) or lists(c))
    found = quantiles.exact_quantiles(df, df.columns, (0.5,), sort_limit=4000, accuracy=200)
    values = np.array(df.collect())
    assert [found[c][0] for c in df.columns] == [float(np.quantile(values[:, i], 0.5)) for i in range(200)]
    monkeypatch.undo()
    sizes = df.agg(F.lit(0), *[F.size(F.collect_list(c)).alias(f"s{i}") for i, c in enumerate(held)]).first()
    assert sum(sizes) <= 4000


def test_text_sizes_become_unknown(spark):
    df = spark.createDataFrame([("big",), (None,)], "size string")
    assert [r[0] for r in quantiles.median_impute(df, "size").collect()] == ["big", "Unknown"]


# Order-dependent operators


@pytest.mark.parametrize("keep, expected", [("first", ("a", 1)), ("last", (None, 3))])
@pytest.mark.parametrize("partitions", LAYOUTS)
def test_dedupe(spark, keep, expected, partitions):
    data = [(1, "a", 1), (1, "b", 2), (1, None, 3), (None, "n", 1)]
    df = spark.createDataFrame(data, "k int, v string, _seq int").repartition(partitions)
    kept = {r.k: (r.v, r._seq) for r in ordering.dedupe(df, ["k"], ["_seq"], keep).collect()}
    assert kept == {1: expected, None: ("n", 1)}


@pytest.mark.parametrize("keep", ["first", "last"])
def test_dedupe_of_fixed_width_columns_keeps_nulls(spark, keep):
    df = spark.createDataFrame([(1, None, 1), (1, 5, 2), (1, None, 3)], "k int, v bigint, _seq bigint")
    assert ordering.dedupe(df, ["k"], ["_seq"], keep).first() == (1, None, 1 if keep == "first" else 3)


def test_dedupe_aggregates_before_the_shuffle(spark, capsys):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.col("id").alias("_seq"))
    ordering.dedupe(df, ["k"], ["_seq"]).explain()
    plan = capsys.readouterr().out
    assert "partial_min_by" in plan and "Window" not in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("partitions", LAYOUTS)
def test_row_numbers(spark, partitions):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("v"))
    numbered = ordering.sequential_id(df.repartition(partitions), ["k"], ["n", "m"]).orderBy("k").collect()
    assert [r.n for r in numbered] == [r.m for r in numbered] == list(range(1, 5001))


def test_row_numbers_when_one_key_leads_most_rows(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("a"), F.col("id").alias("b"))
    numbered = ordering.sequential_id(df.repartition(5), ["a", "b"], ["n"]).orderBy("a", "b").collect()
    assert [r.n for r in numbered] == list(range(1, 6001))


def test_row_numbers_of_nothing(spark):
    assert ordering.sequential_id(spark.range(0), ["id"], ["n"]).collect() == []


@pytest.mark.parametrize("partitions", LAYOUTS)
def test_lists_keep_nulls_and_drop_null_keys(spark, partitions):
    data = [(1, "a", 1), (1, None, 2), (None, "c", 3), (2, "d", 4), (3, None, 5)]
    df = spark.createDataFrame(data, "k int, v string, o int").repartition(partitions)
    lists = ordering.collect_list_by_key(df, "k", "v", ["o"])
    assert sorted(lists.collect()) == [(1, ["a", None], 0), (2, ["d"], 0), (3, [None], 0)]


@pytest.mark.parametrize("partitions", LAYOUTS)
def test_long_lists_go_on_in_further_rows(spark, partitions):
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("v"),
        (-F.col("id")).alias("o"),
    )
    lists = ordering.collect_list_by_key(df.repartition(partitions), "k", "v", ["o"], max_items=64).collect()
    assert max(len(r.v) for r in lists) == 64
    whole = [x for r in sorted((r for r in lists if r.k == 0), key=lambda r: r._part) for x in r.v]
    assert whole == sorted((i for i in range(900) if i % 3 == 0), reverse=True)
    assert sum(len(r.v) for r in lists) == 900
    counts = profile.benefits_count(spark.createDataFrame(lists), "k", "v")
    assert counts.filter("k = 0").first().benefits_count == 300


def test_only_long_keys_are_numbered(spark, monkeypatch):
    numbered = []
    original = ordering.sequential_id
    monkeypatch.setattr(ordering, "sequential_id", lambda df, *a: numbered.append(df.count()) or original(df, *a))
    df = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lists = ordering.collect_list_by_key(df, "k", "v", ["v"], max_items=64)
    assert numbered == [300] and lists.count() == 600 + 5
    assert ordering.collect_list_by_key(df.filter("k > 0"), "k", "v", ["v"], max_items=64).count() == 600
    assert numbered == [300]


def test_lists_a_sketch_misses_have_the_same_grain(spark, monkeypatch):
    df = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    monkeypatch.setattr(ordering, "heavy_keys", lambda *a, **b: {"key": skew.HeavyKeys()})
    parts = {r._part: list(r.v) for r in ordering.collect_list_by_key(df, "k", "v", ["v"], max_items=64).collect()}
    assert [parts[i] for i in range(4)] == [list(range(i * 64, min(200, i * 64 + 64))) for i in range(4)]


# Joins


@pytest.mark.parametrize("kind", ["double", "float", "decimal(12,1)", "bigint"])
def test_hot_keys_of_any_number_type(spark, rows, kind):
    left = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast(kind).alias("k"), "id")
    heavy = skew.heavy_keys(left, {"k": ["k"]}, share=0.2)["k"]
    assert heavy.tiers
    right = spark.createDataFrame([(7, "seven"), (9, "nine")], "k bigint, v string")
    salted = skew.left_join_default(left, right, ["k"], heavy=heavy)
    assert rows(salted) == rows(skew.left_join_default(left, right, ["k"]))
    assert salted.filter("v = 'seven'").count() == 1001


def join_fixture(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
        F.col("id").alias("row"),
    )
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 30)] + [(None, "none")], "k bigint, v string")
    return left, right


def test_heavy_keys_are_found_and_light_ones_are_not(spark):
    left, _ = join_fixture(spark)
    heavy = skew.heavy_keys(left, {"k": ["k"], "row": ["row"]}, share=0.2)
    (hash_of_7,) = spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint"))).first()
    assert heavy["k"].tiers == {4: (hash_of_7,)}
    assert heavy["row"] == skew.HeavyKeys()


@pytest.mark.parametrize("null_safe", [True, False])
def test_salted_join_equals_plain_join(spark, rows, null_safe):
    left, right = join_fixture(spark)
    right = right.unionByName(right.filter("k = 7").withColumn("v", F.lit("twice")))
    heavy = skew.heavy_keys(left, {"k": ["k"]}, share=0.01)["k"]
    assert len(heavy.tiers) >= 2
    plain = skew.left_join_default(left, right, ["k"], {"v": "?"}, null_safe)
    salted = skew.left_join_default(left, right, ["k"], {"v": "?"}, null_safe, heavy)
    assert rows(salted) == rows(plain)
    assert plain.filter("k IS NULL").select("v").distinct().collect() == [("none" if null_safe else "?",)]


def test_salting_spreads_a_heavy_key(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    settings_ = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in settings_.items():
        spark.conf.set(name, value)
    try:
        left, right = join_fixture(spark)

        def largest(heavy):
            joined = skew.left_join_default(left, right, ["k"], heavy=heavy)
            return joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        (hashes,) = skew.heavy_keys(left, {"k": ["k"]}, share=0.2)["k"].tiers.values()
        heavy = skew.HeavyKeys({64: hashes})
        assert largest(heavy) < 0.75 * largest(None)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_join_refuses_columns_of_both_sides(spark):
    left, right = join_fixture(spark)
    with pytest.raises(ValueError):
        skew.left_join_default(left.withColumn("v", F.lit(1)), right, ["k"])


# Profile


def test_benefit_modes(spark, rows):
    lists = spark.createDataFrame([(1, ["a", None]), (2, []), (None, ["x"])], "job_id int, type array<string>")
    texts = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "job_id int, type string")
    assert rows(profile.benefits_count(lists)) == [(1, 2), (2, 0)]
    assert rows(profile.benefits_count(texts)) == [(1, 1)]
    assert rows(profile.benefits_count(lists, mode="presence")) == [(1, 1), (2, 1)]


def test_describe_agrees_with_numpy(spark):
    values = [random.Random(3).gauss(10, 4) for _ in range(500)]
    found = profile.describe(doubles(spark, [*values, None])).first()
    expected = [
        500, np.mean(values), np.std(values, ddof=1), min(values), *np.quantile(values, (0.25, 0.5, 0.75)), max(values)
    ]
    assert list(found)[1:] == pytest.approx(expected)


def test_profile_counts_nan_as_null(spark):
    row = profile.profile_table(doubles(spark, [1.0, float("nan"), None])).first()
    assert (row.row_count, row.nulls, row["mean"]) == (3, 2, 1.0)


def test_two_passes_describe_any_number_of_columns(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(20_000, 12)).round(3)
    df = spark.createDataFrame(values.tolist(), ", ".join(f"c{i} double" for i in range(12)))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("two-passes", "describe")
    found = {r.column_name: r for r in profile.describe(df).collect()}
    context.setLocalProperty("spark.jobGroup.id", None)
    # A sketch, its merge, the bracketed counts and the rows of the result.
    assert len(tracker.getJobIdsForGroup("two-passes")) <= 5
    for i in range(12):
        row = found[f"c{i}"]
        assert [row.q25, row.median, row.q75] == [float(np.quantile(values[:, i], q)) for q in (0.25, 0.5, 0.75)]
        assert row.mean == pytest.approx(values[:, i].mean()) and row["max"] == values[:, i].max()


def test_sketches_meet_in_groups_on_larger_clusters(spark):
    values = [float(v) for v in np.random.default_rng(5).integers(0, 900, 5000)]
    df = doubles(spark, values).repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", "65")
    try:
        found = quantiles.exact_quantiles(df, ["x"], (0.0, 0.3, 1.0), accuracy=50)["x"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found == [float(np.quantile(values, q)) for q in (0.0, 0.3, 1.0)]


def test_ranks_that_a_bracket_misses_are_found(spark, monkeypatch):
    values = [float(v) for v in np.random.default_rng(4).integers(0, 5000, 8000)]
    df = doubles(spark, values)
    monkeypatch.setattr(quantiles, "_sketches", lambda df, cols, qs, k: {c: (8000, {q: (1.0, 2.0) for q in qs}) for c in cols})
    found = quantiles.exact_quantiles(df, ["x"], (0.1, 0.5))["x"]
    assert found == [float(np.quantile(values, q)) for q in (0.1, 0.5)]


@pytest.mark.parametrize("equal", ["in the order columns", "in all columns"])
def test_a_third_of_equal_rows_spans_several_blocks(spark, equal, monkeypatch):
    other = F.lit(0) if equal == "in all columns" else F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0)
    df = spark.range(0, 24_000, 1, 8).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), other.alias("v"))
    sizes, real = [], ordering.stage

    def watched(rows, label):
        staged = real(rows, label)
        sizes.extend(r["count"] for r in staged.groupBy("_block").count().collect())
        return staged

    monkeypatch.setattr(ordering, "stage", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    numbered = ordering.sequential_id(df, ["k"], ["n"]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.n for r in numbered) == list(range(1, 24_001))
    assert [r.k for r in sorted(numbered, key=lambda r: r.n)] == sorted(r.k for r in numbered)
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]
