"""Very many files: one plan branch per schema, the same rows as file by file."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from fiscal_ledger import read_ledger, scan_files
from fiscal_ledger import schema as s
from fiscal_ledger.sources import file_manifest, files
from tests.micro import raw_ledger
from tests.test_plans import tree


@pytest.fixture(scope="module")
def shapes(spark, tmp_path_factory):
    """One file each: text, other types and an extra column, lower-case names and a column missing."""
    folder = tmp_path_factory.mktemp("shapes")
    text = raw_ledger(spark, {s.YEAR: 2026, s.CUI: "1", s.PIM: "1_000"}, {s.YEAR: 2026, s.CUI: "4", s.PIM: None})
    typed = raw_ledger(spark, {s.YEAR: 2024, s.CUI: "3", s.PIM: "3"}).withColumns(
        {s.YEAR: F.lit(2024).cast("bigint"), s.PIM: F.col(s.PIM).cast("double"), s.CUI: F.col(s.CUI).cast("int"), "EXTRA": F.lit("x")}
    )
    lower = raw_ledger(spark, {s.YEAR: 2025, s.CUI: "2", s.PIM: "2"}).drop(s.GOAL).toDF(*(c.lower() for c in s.COLUMNS if c != s.GOAL))
    made = []
    for name, frame in (("text", text), ("typed", typed), ("lower", lower)):
        frame.coalesce(1).write.parquet(str(folder / name))
        made.append(next(str(f) for f in (folder / name).iterdir() if f.name.startswith("part-")))
    return made


def linked(shapes, folder, count) -> list[str]:
    paths = []
    for i in range(count):
        path = f"{folder}/{i:05d}.parquet"
        os.link(shapes[i % 3], path)
        paths.append(path)
    return paths


def branches(frame) -> int:
    return len(re.findall(r"\bScan parquet\b", tree(frame)))


def test_ten_thousand_paths_make_three_branches(spark, shapes, tmp_path):
    assert branches(read_ledger(spark, linked(shapes, tmp_path, 10_000))) == 3


def test_rows_of_many_paths(spark, shapes, tmp_path):
    ledger = read_ledger(spark, linked(shapes, tmp_path, 1000))
    counted = {r[0]: (r[1], r[2]) for r in ledger.groupBy(s.CUI).agg(F.count("*"), F.sum(s.PIM)).collect()}
    assert counted == {"1": (334, 334000.0), "4": (334, None), "3": (333, 999.0), "2": (333, 666.0)}


def test_same_rows_as_one_by_one(spark, shapes, tmp_path, monkeypatch):
    paths = linked(shapes, tmp_path, 30)
    grouped = scan_files(spark, paths)
    monkeypatch.setattr(files, "FEW_PATHS", 100)
    single = scan_files(spark, paths)
    assert branches(grouped) == 3 and branches(single) == 30
    assert dict(grouped.dtypes) == dict(single.dtypes)
    assert sorted(map(repr, grouped.collect())) == sorted(map(repr, single.collect()))


def test_manifest(spark, shapes, tmp_path):
    paths = linked(shapes, tmp_path, 6)
    rows = file_manifest(spark, [str(tmp_path)]).collect()
    assert sorted(os.path.basename(r.path) for r in rows) == [os.path.basename(p) for p in paths]
    assert len({r.layout for r in rows}) == 3 and all(r.bytes == os.path.getsize(r.path.removeprefix("file:")) for r in rows)
    assert sorted(r.lines for r in rows) == [1, 1, 1, 1, 2, 2]


def test_folders_files_and_partitions(spark, shapes, tmp_path):
    """Folders, single files, and a folder whose sub-folders hold the year."""
    plain = tmp_path / "plain"
    plain.mkdir()
    linked(shapes, plain, 3)
    parted = raw_ledger(spark, {s.YEAR: 2020, s.CUI: "7"}, {s.YEAR: 2021, s.CUI: "8"})
    parted.write.partitionBy(s.YEAR).parquet(str(tmp_path / "parted"))
    paths = [str(plain), str(tmp_path / "parted"), *(str(tmp_path / f"copy{i}.parquet") for i in range(8))]
    for path in paths[2:]:
        os.link(shapes[0], path)
    ledger = read_ledger(spark, paths)
    years = {r[0]: sorted(r[1]) for r in ledger.groupBy(s.YEAR).agg(F.collect_list(s.CUI)).collect()}
    assert years == {2026: ["1"] * 9 + ["4"] * 9, 2024: ["3"], 2025: ["2"], 2020: ["7"], 2021: ["8"]}
    assert branches(ledger) == 4


def test_empty_folder_among_many(spark, shapes, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="empty"):
        scan_files(spark, [*linked(shapes, tmp_path, 9), str(tmp_path / "empty")])
    with pytest.raises(Exception, match="(?i)path"):
        scan_files(spark, [*(str(tmp_path / f"{i:05d}.parquet") for i in range(9)), str(tmp_path / "missing")])
