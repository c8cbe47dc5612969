"""NULL rules, labels, categories, row ids, sources."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from symptra.functions import columns as C
from symptra.functions import frames
from symptra.operators import cohort, prevalence, survey
from symptra.schema import AGE_GROUPS, ILI_SYMPTOMS, MODELLED_SYMPTOMS, REGIONS
from symptra.sources import read_latest_snapshot, read_samples, read_search_trends, write_samples, write_snapshot


def flags(spark, rows):
    schema = "id int, " + ", ".join(f"symptoms_new_{s} boolean" for s in ILI_SYMPTOMS)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def test_flags_are_three_valued(spark):
    f = [False] * 8
    one_true_one_null = [True, None, *f[2:]]
    one_null = [None, *f[1:]]
    df = flags(spark, [f, one_true_one_null, one_null, [True] * 8])
    out = df.transform(survey.add_any_flag).transform(survey.add_ili_count).orderBy("id").collect()
    assert [r["symptoms_new_any"] for r in out] == [False, True, None, True]
    assert [r["symptoms_count_new_ili"] for r in out] == [0, None, None, 8]


def test_age_groups_and_unknown_age(spark):
    df = spark.createDataFrame([(a,) for a in (3, 17, 18, 34, 35, 64, 65, 74, 75, None)], "age int")
    got = [r["age_group"] for r in survey.with_age_group(df).collect()]
    a = AGE_GROUPS
    assert got == [a[0], a[0], a[1], a[1], a[2], a[4], a[5], a[5], a[6], a[6]]
    assert survey.with_age_group(df, null_age=None).filter("age is null").first()["age_group"] is None


def test_study_filter_drops_null_predicates(spark):
    d = dt.date
    df = spark.createDataFrame(
        [
            ("London", d(2023, 11, 14)),
            ("London", d(2024, 3, 7)),
            ("Scotland", d(2023, 12, 1)),
            (None, d(2023, 12, 1)),
            ("London", None),
        ],
        "rgn21nm string, submitted_at date",
    )
    assert survey.filter_study(df).count() == 1


def test_category_rank_nulls_unknown(spark):
    df = spark.createDataFrame([("London",), ("Atlantis",), (None,)], "region_name string")
    out = survey.with_category_rank(df, "region_name", REGIONS).collect()
    assert [(r["region_name"], r["region_name_rank"]) for r in out] == [("London", 7), (None, None), (None, None)]


def test_labels_replace_first_underscore_only(spark):
    df = spark.createDataFrame([("symptoms_new_a_b_c",)], "v string")
    row = survey.clean_labels(df, "v").withColumn("all", survey.underscores_to_spaces("v")).first()
    assert row["label"] == "A b_c" and row["all"] == "symptoms new a b c"


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_row_ids_are_dense_under_skew(spark, buckets):
    df = spark.range(500).select("id", F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    ids = survey.add_row_id(df.repartition(7), "id", buckets=buckets).orderBy("id").collect()
    assert [r["row_id"] for r in ids] == list(range(1, 501))
    per_key = survey.add_row_id(df, "id", ["k"], buckets=buckets).filter("k = 'hot'").orderBy("id").collect()
    assert [r["row_id"] for r in per_key] == list(range(1, 401))


def test_strict_sum_and_null_safe_joins(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "k string, v int")
    out = {r["k"]: r["s"] for r in df.groupBy("k").agg(C.strict_sum("v").alias("s")).collect()}
    assert out == {"a": None, None: 3}
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, w int")
    got = {(r["k"], r["v"]): r["w"] for r in frames.null_safe_join(df, right, ["k"], "left").collect()}
    assert got == {("a", 1): 20, ("a", None): 20, (None, 3): 10}


def test_no_job_or_cache_for_a_joined_statistic(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = frames.attach_group_stats(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], F.max("id").alias("top"))
    assert out.filter("top < 97").count() == 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_shared_folder_is_asked_for_beyond_one_machine(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        frames.shared_dir(Session())


def test_ids_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("v")).unionByName(spark.createDataFrame([(None,)], "v long"))
    got = []
    for n in (1, 7, 31):
        rows = survey.add_row_id(df.repartition(n), "v", buckets=16).collect()
        got.append({r["v"]: r["row_id"] for r in rows})
    assert got[0] == got[1] == got[2]
    assert sorted(got[0].values()) == list(range(1, 5002)) and got[0][None] == 5001


def test_ratio_of_zeros(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(C.ratio("a", "b")).collect()]
    assert got[:3] == [0.5, float("inf"), float("-inf")] and got[3] != got[3] and got[4:] == [None, None]


def test_participants_and_waves_count_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)] + [(7,)] * 5, "participant_id long")
    assert cohort.count_participants(df).first()[0] == 4
    waves = {r["waves"]: r["n"] for r in cohort.waves_table(df).collect()}
    assert waves == {1: 2, 2: 1, None: 1}


def test_cells_keep_null_keys_and_null_outcomes(spark):
    names = ", ".join(f"symptoms_new_{s} boolean" for s in MODELLED_SYMPTOMS)
    day = dt.date(2024, 1, 2)
    rows = [
        ("3 to 17 years", "London", None, day, True, None, False, False, False),
        ("3 to 17 years", "London", None, day, False, True, False, False, False),
    ]
    df = spark.createDataFrame(rows, f"age_group string, region_name string, window_submission int, submitted_at date, {names}")
    cells = {r["symptom"]: r for r in prevalence.prevalence_cells(df).collect()}
    assert (cells["cough"]["n_trials"], cells["cough"]["n_outcome"], cells["cough"]["t"]) == (2, 1, 1)
    assert cells["fever"]["n_outcome"] is None
    weights = prevalence.window_weights(prevalence.prevalence_cells(df))
    assert {r["window_weight"] for r in weights.collect()} == {1.0}
    grid = prevalence.prediction_grid(prevalence.prevalence_cells(df))
    assert [r["window_submission"] for r in grid.collect()] == [None]


def test_assert_complete(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert frames.assert_complete(df.filter("a = 1"), ["a"]).count() == 1
    with pytest.raises(Exception, match="NULL in one of"):
        frames.assert_complete(df, ["a"]).collect()


def test_latest_snapshot_and_partitioned_samples(spark, tmp_path):
    for i in (1, 2):
        spark.range(i).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    import os

    files = sorted(str(p) for i in (1, 2) for p in (tmp_path / f"part{i}").glob("*.parquet"))
    for age, f in enumerate(sorted(files, key=lambda x: "part1" not in x)):
        os.utime(f, (1_700_000_000 - age * 1000,) * 2)
    assert read_latest_snapshot(spark, f"{tmp_path}/part*/*.parquet").count() == 1
    spark.range(2000).repartition(4).write.parquet(str(tmp_path / "snap_b"))
    spark.range(3).write.parquet(str(tmp_path / "snap_a"))
    for f in (tmp_path / "snap_a").glob("*"):
        os.utime(f, (1_600_000_000,) * 2)
    assert read_latest_snapshot(spark, f"{tmp_path}/snap_*").count() == 2000
    df = spark.createDataFrame([("cough", 1), ("fever", 2)], "symptom string, draw int")
    write_samples(df, str(tmp_path / "s"))
    plan = read_samples(spark, str(tmp_path / "s")).filter("symptom = 'cough'")
    assert plan.count() == 1
    assert "PartitionFilters: [isnotnull(symptom" in plan._jdf.queryExecution().toString()


def test_only_finished_snapshots_are_read(spark, tmp_path):
    import pytest

    first, second = str(tmp_path / "s_2"), str(tmp_path / "s_1")
    rows = spark.range(100).withColumn("part", F.col("id") % 3)
    write_snapshot(rows, first, ["part"])
    latest = lambda: read_latest_snapshot(spark, f"{tmp_path}/s_*")
    assert sorted(map(tuple, latest().select("id", "part").collect())) == [(i, i % 3) for i in range(100)]
    write_snapshot(spark.range(7).withColumn("part", F.lit(0)), second)
    assert latest().count() == 7
    # a stray file of a failed attempt is not part of a snapshot
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "stray"))
    stray = next((tmp_path / "stray").glob("*.parquet"))
    (tmp_path / "s_1" / "part-stray.parquet").write_bytes(stray.read_bytes())
    assert latest().count() == 7
    # written last, but not committed
    spark.range(9).write.parquet(str(tmp_path / "s_3"))
    assert latest().count() == 7
    # a listed file is cut short: the one before counts
    next(f for f in (tmp_path / "s_1").glob("part-0*.parquet")).write_bytes(b"")
    assert latest().count() == 100
    with pytest.raises(Exception, match="already exists"):
        write_snapshot(rows, first)


def test_a_folder_in_progress_is_no_snapshot(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "p_a"))
    spark.range(6).write.parquet(str(tmp_path / "p_b"))
    (tmp_path / "p_b" / "_temporary").mkdir()
    assert read_latest_snapshot(spark, f"{tmp_path}/p_*").count() == 4


def test_search_trend_filter_reaches_the_files(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "cough", 1.0, "x")], "date date, symptom string, value double, z string")
    df.write.parquet(str(tmp_path / "t"))
    plan = read_search_trends(spark, str(tmp_path / "t"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(date,2023-11-14)" in plan and "z" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_ranked_quantiles_equal_percentiles_under_ties_and_skew(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.when(F.col("id") < 1500, "hot").otherwise("cold")).alias("k"),
        F.when(F.col("id") % 2 == 0, 7.0).when(F.col("id") % 97 == 1, None).otherwise((F.col("id") * 37 % 1009).cast("double")).alias("v"),
    )
    key = lambda d: sorted((tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in d.collect()))
    assert key(frames.ranked_quantiles(df, "v", ["k"])) == key(frames.quantile_bands(df, "v", ["k"]))
