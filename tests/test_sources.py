"""Reading yearly files, ingest, refresh and the shared folder."""

from __future__ import annotations


import pytest
from pyspark.sql import functions as F

from checks import ledgers, star
from checks.star import by_goal, by_row_order, by_year, in_no_order, star_ledger
from fiscal_ledger import ledger_ingest, open_ledger, plans, read_ledger, scan_files
from fiscal_ledger import schema as s
from fiscal_ledger import settings
from fiscal_ledger.sources import normalise
from tests.conftest import SF_DIR
from tests.micro import ledger, raw_ledger, rows


def _files(spark, folder):
    """One-row files: the whole contract, one with a column missing, one with other types and an extra column."""
    full = raw_ledger(spark, {s.YEAR: 2026, s.CUI: "1", s.PIM: "1_000", s.FUNDING_CODE: "09"})
    missing = raw_ledger(spark, {s.YEAR: 2025, s.CUI: "2", s.PIM: "2"}).drop(s.GOAL, s.PAID)
    other = (
        raw_ledger(spark, {s.YEAR: 2024, s.CUI: "3", s.PIM: "3", s.FUNDING_CODE: "9"})
        .withColumns(
            {
                s.YEAR: F.lit(2024).cast("bigint"),
                s.CUI: F.col(s.CUI).cast("int"),
                s.PIM: F.col(s.PIM).cast("double"),
                s.FUNDING_CODE: F.col(s.FUNDING_CODE).cast("int"),
            }
        )
        .withColumn("EXTRA", F.lit("x"))
    )
    paths = []
    for name, frame in (("full", full), ("missing", missing), ("other", other)):
        frame.coalesce(1).write.parquet(f"{folder}/{name}")
        paths.append(f"{folder}/{name}")
    return paths


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_files_of_different_shape(spark, tmp_path, order):
    paths = _files(spark, tmp_path)
    result = read_ledger(spark, [paths[i] for i in order])
    assert [(f.name, f.dataType) for f in result.schema] == [(f.name, f.dataType) for f in s.LEDGER_SCHEMA]
    by_cui = {row[s.CUI]: row for row in result.collect()}
    assert sorted(by_cui) == ["1", "2", "3"]
    assert [by_cui[c][s.PIM] for c in "123"] == [1000.0, 2.0, 3.0]
    assert [by_cui[c][s.YEAR] for c in "123"] == [2026, 2025, 2024]
    assert [by_cui[c][s.GOAL] for c in "123"] == ["META 1", None, "META 1"]
    assert by_cui["2"][s.PAID] is None
    assert by_cui["3"][s.FUNDING_CODE] == "09"


def test_no_paths(spark):
    with pytest.raises(ValueError):
        scan_files(spark, [])


def test_ingest_refreshes_only_the_years_given(spark, tmp_path):
    path = str(tmp_path / "table")
    ledger_ingest(raw_ledger(spark, {s.YEAR: 2024, s.PIM: 1}, {s.YEAR: 2025, s.PIM: 2}, {s.YEAR: None, s.PIM: 4}), path)
    table = ledger_ingest(raw_ledger(spark, {s.YEAR: 2025, s.PIM: 30}, {s.YEAR: 2025, s.PIM: 5}), path, rebalance=True)
    assert table.schema == open_ledger(spark, path).schema
    assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in s.LEDGER_SCHEMA]
    totals = table.groupBy(s.YEAR).agg(F.sum(s.PIM)).orderBy(F.asc_nulls_first(s.YEAR))
    assert rows(totals) == [(None, 4.0), (2024, 1.0), (2025, 35.0)]


def test_ingest_keeps_every_row(spark, tmp_path):
    raw = star_ledger(spark, SF_DIR)
    table = ledger_ingest(raw, str(tmp_path / "table"), rebalance=True)
    expected = normalise(raw)
    assert table.exceptAll(expected).isEmpty() and expected.exceptAll(table).isEmpty()


def test_fixture_checksums(spark):
    """Totals of the derived ledger at sf0.01, as documented with the fixture."""
    frame = ledgers.typed_ledger(spark, SF_DIR)
    totals = frame.agg(
        F.count("*"),
        F.countDistinct(s.YEAR),
        F.countDistinct(s.ENTITY),
        F.countDistinct(s.UNIT_CODE),
        F.countDistinct(s.PROGRAMME),
        F.countDistinct(s.CUI),
        F.countDistinct(s.FUNDING_CODE),
        F.count(s.MONTH),
        F.count(s.CUI),
        F.count(s.PROJECT),
        F.count(s.FUNDING),
    )
    assert rows(totals) == [(120000, 7, 56, 100, 24, 1951, 7, 118828, 119372, 116636, 102756)]
    assert rows(plans.kpi_summary(frame)) == [
        (2726931089.0, 3550927321.0, 2982718813.0, 2386154883.0, 1789611176.0, 1093635127.0, 1028021463.0)
    ]
    assert rows(frame.agg(F.count(s.PIM), F.count(s.PAID))) == [(59412, 59405)]


def test_shared_folder_is_the_one_the_session_names(spark, monkeypatch):
    class Session:
        def __init__(self, **conf):
            self.conf = {name.replace("_", "."): value for name, value in conf.items()}
            self.sparkContext = spark.sparkContext

    named = Session(spark_checkpoint_dir="hdfs://shared/dir/")
    assert settings.shared_folder(named) == "hdfs://shared/dir"
    application = spark.sparkContext.applicationId
    assert settings.new_table_path(named, "typed").startswith(f"hdfs://shared/dir/fiscal_ledger/{application}/typed-")
    for master in ("yarn", "local[2]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            settings.new_table_path(Session(spark_master=master), "typed")


def test_column_names_in_any_case(spark, tmp_path):
    full = raw_ledger(spark, {s.YEAR: 2026, s.PIM: 5}).toDF(*(c.lower() for c in s.COLUMNS))
    mixed = raw_ledger(spark, {s.YEAR: 2025, s.PIM: 7}).withColumnRenamed(s.PIM, s.PIM.title())
    for name, frame in (("lower", full), ("mixed", mixed)):
        frame.write.parquet(str(tmp_path / name))
    found = normalise(scan_files(spark, [str(tmp_path / "lower"), str(tmp_path / "mixed")]))
    assert found.columns == list(s.COLUMNS)
    assert rows(found, s.YEAR, s.PIM) == [(2026, 5.0), (2025, 7.0)]
    assert rows(normalise(full), s.PIM) == [5.0]


def test_absent_and_doubled_columns_raise(spark, tmp_path):
    raw = raw_ledger(spark, {s.YEAR: 2026})
    raw.drop(s.PIM, s.GOAL).write.parquet(str(tmp_path / "absent"))
    with pytest.raises(ValueError, match=f"{s.PIM}, {s.GOAL}|{s.GOAL}, {s.PIM}"):
        scan_files(spark, [str(tmp_path / "absent")])
    with pytest.raises(ValueError, match=s.PIM):
        normalise(raw.drop(s.PIM))
    raw.write.parquet(str(tmp_path / "full"))  # one file has them: NULL where they are missing
    assert scan_files(spark, [str(tmp_path / "full"), str(tmp_path / "absent")]).count() == 2
    doubled = raw.select("*", F.lit("1").alias(s.PIM.lower()))
    with pytest.raises(ValueError, match="differ only in case"):
        normalise(doubled)


def test_lines_without_a_year_are_scanned(spark, tmp_path):
    raw = raw_ledger(spark, {s.YEAR: 2025, s.PIM: 1}, {s.YEAR: None, s.PIM: 2})
    found = ledgers._write_yearly_files(raw, str(tmp_path / "years"))
    assert sorted(rows(found, s.PIM)) == ["1", "2"]


def test_null_amounts_survive_the_table(spark, tmp_path):
    frame = ledger(spark, {s.PIM: "NaN", s.PIA: "inf", s.ACCRUED: None, s.CUI: None})
    table = ledger_ingest(frame, str(tmp_path / "table"))
    row = table.first()
    assert row[s.PIM] != row[s.PIM] and row[s.PIA] == float("inf")
    assert row[s.ACCRUED] is None and row[s.CUI] is None


def test_a_part_with_a_third_of_the_lines(spark, tmp_path):
    """A hot join key is split by AQE when the join shuffles, and no row is lost."""
    tables = "/root/testdata/sf0.001"
    for table in ("region", "nation", "supplier", "part"):
        spark.read.parquet(f"{tables}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    lines = spark.read.parquet(f"{tables}/lineitem.parquet")
    hot = F.when(F.col("l_orderkey") % 3 == 0, F.lit(12).cast("bigint")).otherwise(F.col("l_partkey"))
    lines.withColumn("l_partkey", hot).repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
    expected = star_ledger(spark, str(tmp_path))
    count = expected.count()
    assert count == 2 * lines.count()

    settings_ = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {name: spark.conf.get(name, None) for name in settings_}
    for name, value in settings_.items():
        spark.conf.set(name, value)
    try:
        shuffled = star_ledger(spark, str(tmp_path))
        path = str(tmp_path / "out")
        ledger_ingest(shuffled, path, rebalance=True)
        rows_ = shuffled.collect()
        final_plan = shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert "SortMergeJoin(skew=true)" in final_plan
    assert sorted(map(repr, rows_)) == sorted(map(repr, expected.collect()))
    table = open_ledger(spark, path)
    assert table.exceptAll(normalise(expected)).isEmpty() and table.count() == count


@pytest.mark.parametrize("deal", [by_row_order, by_year, by_goal, in_no_order])
def test_only_order_lines_are_shuffled(spark, monkeypatch, deal):
    """The dealt ledger is the same, its texts and second halves are made behind all shuffles, and tasks are as many as the lines need."""
    monkeypatch.setattr(star, "ORDER_LINES_PER_TASK", 500)
    folder = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        dealt = star_ledger(spark, folder, deal)
        rows_ = dealt.collect()
        explained = dealt._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(repr, rows_)) == sorted(map(repr, star_ledger(spark, folder).collect()))
    # Seen from the result, the doubling comes before the first shuffle, and so do the sectors' joins.
    final = explained.split("== Initial Plan ==")[0]
    assert final.index("Generate explode") < final.index(" Exchange ")
    assert final.index("n_nationkey") < final.index(" Exchange ")
    assert dealt.rdd.getNumPartitions() >= -(-lines // 500)


def test_small_row_groups_have_small_filters(spark, tmp_path):
    """Filters are sized for what a group can hold; 200,000 CUIs a group took 256 KB each, in a file of groups of 32 KB."""
    number = F.col("id")
    constant = raw_ledger(spark, {}).drop(s.YEAR, s.CUI)
    raw = spark.range(20_000).select(F.lit(2025).alias(s.YEAR), F.sha2(number.cast("string"), 256).alias(s.CUI)).crossJoin(constant)
    ledger_ingest(raw.coalesce(1), str(tmp_path / "out"), sort=False, row_group_bytes=32 << 10)
    size = sum(file.stat().st_size for file in (tmp_path / "out").rglob("*.parquet"))
    assert size < 4 << 20
