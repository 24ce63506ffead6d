"""Reading yearly Parquet files as one ledger."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscal_ledger import schema as s
from fiscal_ledger.functions.coercion import to_double, to_int
from fiscal_ledger.sources.manifest import scan_groups

# Up to so many paths are opened one by one, which is quicker than a job that reads their footers.
FEW_PATHS = 8


def _contract(frame: DataFrame) -> dict[str, T.StructField]:
    """The fields of a frame that are contract columns, whatever their case."""
    names = {c.lower(): c for c in s.COLUMNS}
    found: dict[str, T.StructField] = {}
    for field in frame.schema.fields:
        column = names.get(field.name.lower())
        if column in found:
            raise ValueError(f"columns {found[column].name} and {field.name} differ only in case")
        if column is not None:
            found[column] = field
    return found


def _require(present: set[str]) -> None:
    absent = [c for c in s.COLUMNS if c not in present]
    if absent:
        raise ValueError(f"no file has the columns {', '.join(absent)}")


def _source(field: T.StructField) -> Column:
    return F.col(f"`{field.name}`")


def _as_text(column: str, field: T.StructField) -> Column:
    """A code or name as text; funding codes stored as numbers get their leading zero back."""
    text, source = _source(field).cast("string"), field.dataType
    if column == s.FUNDING_CODE and isinstance(source, T.IntegralType):
        return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
    return text


def scan_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The raw contract columns of several Parquet files or folders, unchanged where they agree.

    Files written in different years may lack a column, carry extra ones,
    spell one in another case or store one under another type. Each is
    projected to the contract on its own: a missing column is NULL, an extra one is dropped, codes and names
    are text, and a measure whose type differs between files is text as well
    (coercion reads it back). Each projection is pushed into its file's scan.
    A column that no file has is an error, as are two that differ only in case.

    Many paths are first sorted by what their footers say, which tasks read: files with the same columns and types become one
    scan, so the plan has a branch per schema and not one per path, and the driver opens one file of each.
    """
    if not paths:
        raise ValueError("no ledger paths given")
    files = [spark.read.parquet(path) for path in paths] if len(paths) <= FEW_PATHS else _grouped(spark, paths)
    contracts = [_contract(file) for file in files]
    _require({column for present in contracts for column in present})

    def common(column: str) -> T.DataType:
        types = [present[column].dataType for present in contracts if column in present]
        found = {kind.simpleString(): kind for kind in types}
        return next(iter(found.values())) if len(found) == 1 else T.StringType()

    target = {c: common(c) for c in s.COERCED}
    target[s.YEAR] = T.IntegerType()

    def project(file: DataFrame, present: dict[str, T.StructField]) -> DataFrame:
        columns = []
        for c in s.COLUMNS:
            if c not in present:
                columns.append(F.lit(None).cast(target.get(c, T.StringType())).alias(c))
            elif c == s.YEAR:
                columns.append(to_int(_source(present[c]), present[c].dataType).alias(c))
            elif c in target:
                columns.append(_source(present[c]).cast(target[c]).alias(c))
            else:
                columns.append(_as_text(c, present[c]).alias(c))
        return file.select(*columns)

    return reduce(DataFrame.unionByName, map(project, files, contracts))


def _grouped(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """One frame per schema of the files at the paths."""
    frames = []
    for base, files in scan_groups(spark, paths):
        reader = spark.read if base is None else spark.read.option("basePath", base)
        frames.append(reader.schema(reader.parquet(files[0]).schema).parquet(*files))
    return frames


def typed_columns(raw: DataFrame) -> dict[str, Column]:
    """The coercion of each contract column, given the names and types a raw ledger has."""
    fields = _contract(raw)
    _require(set(fields))

    def typed(column: str) -> Column:
        field = fields[column]
        if column in s.MEASURES:
            return to_double(_source(field), field.dataType)
        if column in s.WHOLE_NUMBERS or column == s.YEAR:
            return to_int(_source(field), field.dataType)
        return _as_text(column, field)

    return {c: typed(c) for c in s.COLUMNS}


def normalise(raw: DataFrame) -> DataFrame:
    """Coerce the numeric columns and select the contract columns in order."""
    return raw.select(*[column.alias(name) for name, column in typed_columns(raw).items()])


def read_ledger(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several yearly Parquet files as one normalised ledger."""
    return normalise(scan_files(spark, paths))
