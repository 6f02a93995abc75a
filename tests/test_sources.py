"""Sink -> source round trips and reshaping identities."""

import pytest
from pyspark.sql import functions as F

from sigspark.operators import reshape
from sigspark.plans.views import v_expr, v_scores
from sigspark.sources import io

SF001 = "/root/testdata/sf0.001"


NAMES = ["APM-2", "COX_IS", "CYT (a+b)", "TIS"]


def _cohort_files(folder, orders):
    """One CSV per study, each with its columns in an order of its own."""
    for k, (study, order) in enumerate(orders.items()):
        with open(folder / f"train_set_{study}_filtered.csv", "w") as f:
            f.write(",".join(f'"{c}"' for c in order) + "\n")
            for i in range(5):
                value = {c: str(round(100 * k + 10 * i + j / 8, 3)) for j, c in enumerate(NAMES)} | {"response": "R" if i % 2 else "NR", "extra": "x"}
                f.write(",".join(value[c] for c in order) + "\n")


ORDERS = {"ICB_A__Lung__PD-(L)1": [*NAMES, "response"], "ICB_B__Skin__CTLA4": ["response", *reversed(NAMES)], "ICB_C__Lung__IO": [*NAMES[2:], "extra", *NAMES[:2], "response"]}


def test_train_csv_matches_columns_by_header(spark, tmp_path):
    _cohort_files(tmp_path, ORDERS)
    rows = io.read_train(spark, str(tmp_path), NAMES).collect()
    assert len(rows) == 15 and {r.study for r in rows} == set(ORDERS)
    for r in rows:
        base = r["APM-2"]
        assert [r[c] - base for c in NAMES] == [0, 0.125, 0.25, 0.375] and r.response == ("R" if base // 10 % 2 else "NR")


def test_train_csv_fails_on_a_missing_column(spark, tmp_path):
    _cohort_files(tmp_path, {**ORDERS, "ICB_D__Lung__IO": [*NAMES[1:], "response"]})
    with pytest.raises(ValueError, match="APM-2"):
        io.read_train(spark, str(tmp_path), NAMES)
    with pytest.raises(ValueError):
        io.read_train(spark, str(tmp_path), NAMES, glob="*.none")


def test_train_csv_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _cohort_files(tmp_path / "in", ORDERS)
    df = io.read_train(spark, str(tmp_path / "in"), NAMES)
    io.write_train(df, str(tmp_path / "train"), NAMES)
    back = io.read_train(spark, str(tmp_path / "train"), NAMES)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, back.select(*[F.col(f"`{c}`") for c in df.columns]).collect()))


def test_cohort_table_round_trip_prunes(spark, tmp_path):
    e = v_expr(spark, SF001)
    io.write_table(e, str(tmp_path / "c" / "expression"))
    back = io.read_cohort(spark, str(tmp_path / "c"), ["expression"])["expression"]
    assert back.count() == e.count()
    one = back.where(F.col("study") == 1)
    assert one.count() == e.where("study = 1").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(study" in plan
    with pytest.raises(Exception, match="clinical"):
        io.read_cohort(spark, str(tmp_path / "c"))


def _tables(spark, tmp_path):
    """(name, writer of {study: values}, reader of the same) for each sink by study."""
    from sigspark.operators import trees as TR

    def train(data):
        rows = [(k, float(v), "R") for k, vs in data.items() for v in vs]
        io.write_train(spark.createDataFrame(rows, "study string, f double, response string"), str(tmp_path / "train"), ["f"])

    def table(data):
        io.write_table(spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "study string, f double"), str(tmp_path / "table"))

    def models(data):
        TR.write_models(spark.createDataFrame([(k, str(v)) for k, vs in data.items() for v in vs], "model string, json string"), str(tmp_path / "models"))

    def read(df, key, value):
        out = {}
        for r in df.collect():
            out.setdefault(r[key], []).append(int(float(r[value])))
        return {k: sorted(v) for k, v in out.items()}

    yield train, lambda: read(io.read_train(spark, str(tmp_path / "train"), ["f"]), "study", "f")
    yield table, lambda: read(spark.read.parquet(str(tmp_path / "table")), "study", "f")
    yield models, lambda: read(spark.read.text(str(tmp_path / "models")), "model", "value")


def test_writing_a_study_leaves_the_others(spark, tmp_path):
    for write, read in _tables(spark, tmp_path):
        write({"A": [1, 2], "B": [3], "C+(x)": [4]})
        write({"B": [5, 6]})
        assert read() == {"A": [1, 2], "B": [5, 6], "C+(x)": [4]}
        write({"D": [7]})
        assert read() == {"A": [1, 2], "B": [5, 6], "C+(x)": [4], "D": [7]}


def test_a_failed_write_leaves_the_old_data(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_table(spark.createDataFrame([("A", 1.0), ("B", 2.0)], "study string, f double"), path)
    bad = spark.range(0, 2000, 1, 4).selectExpr("case when id < 1000 then 'A' else 'B' end as study", "if(id = 1999, double(raise_error('late')), 9D) as f")
    with pytest.raises(Exception, match="late"):
        io.write_table(bad, path)
    assert sorted(map(tuple, spark.read.parquet(path).select("study", "f").collect())) == [("A", 1.0), ("B", 2.0)]


def test_headers_of_many_files_are_one_job(spark, tmp_path):
    _cohort_files(tmp_path, {f"S{k}": order for k in range(12) for order in [[*NAMES, "response"] if k % 2 else ["response", *NAMES]]})
    got = io._header_lines(spark, str(tmp_path), "*.csv")
    assert [len(r.files) for r in got] == [6, 6] and all(r.files == sorted(r.files) for r in got)
    assert io.read_train(spark, str(tmp_path), NAMES).select("study").distinct().count() == 12


def test_bucketed_cohort_tables_join_without_a_shuffle(spark, tmp_path):
    expr = spark.range(4000).selectExpr("id % 3 as study", "id % 50 as patientid", "concat('g', id % 20) as gene", "cast(id as double) as value")
    clin = spark.range(150).selectExpr("id % 3 as study", "id div 3 as patientid", "if(id % 2 = 0, 'R', 'NR') as response")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = io.write_bucketed(expr, "t_expression", str(tmp_path / "e"), buckets=4)
        c = io.write_bucketed(clin, "t_clinical", str(tmp_path / "c"), buckets=4)
        joined = e.join(c, ["study", "patientid"])
        per = joined.groupBy("study", "patientid").agg(F.avg("value").alias("mean"), F.first("response").alias("response"))
        for df in (joined, per):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = expr.join(clin, ["study", "patientid"])
        assert sorted(map(tuple, joined.select("study", "patientid", "gene", "value", "response").collect())) == sorted(map(tuple, want.select("study", "patientid", "gene", "value", "response").collect()))
        assert "Exchange" in want._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table if exists t_expression")
        spark.sql("drop table if exists t_clinical")


def test_a_list_of_studies_prunes_partitions_at_run_time(spark, tmp_path):
    expr = spark.range(4000).selectExpr("id % 8 as study", "id % 50 as patientid", "cast(id as double) as value")
    io.write_table(expr, str(tmp_path / "c" / "expression"))
    studies = spark.createDataFrame([(1, "IO"), (2, "IO"), (3, "PD")], "study long, treatment string")
    studies.write.parquet(str(tmp_path / "studies"))
    wanted = spark.read.parquet(str(tmp_path / "studies")).where("treatment = 'IO'")
    got = io.read_cohort(spark, str(tmp_path / "c"), ["expression"])["expression"].join(wanted, "study")
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 1000


def test_wide_long_identity(spark):
    names = ["click", "error", "purchase", "signup", "view"]
    s = v_scores(spark, SF001)
    back = reshape.to_long(reshape.to_wide(s, names), names).where(F.col("score").isNotNull())
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, back.select(*s.columns).collect()))


def test_zero_fill_idempotent(spark):
    names = ["click", "error", "purchase", "signup", "view", "extra"]
    s = v_scores(spark, SF001)
    once = reshape.zero_fill(s, names)
    twice = reshape.zero_fill(once, names)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.where("signature = 'extra'").count() == s.select("study", "patientid").distinct().count()
