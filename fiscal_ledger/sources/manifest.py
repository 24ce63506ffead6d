"""What is in very many Parquet files: their footers, read by tasks.

Spark can read files of one schema as one scan, but first it has to know which these are. Opening each file from the driver takes as
long as there are files; here Spark lists the paths and its tasks read the footers, and only a short row per file comes back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from fiscal_ledger import schema as s

MANIFEST = "path string, layout string, lines bigint, bytes bigint"
# Footers that a task reads.
FILES_PER_TASK = 200


def _uri(path: str) -> str:
    """A path as Spark lists it, as a URI: Hadoop writes local ones with a single slash."""
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def layout(metadata: pq.FileMetaData) -> str:
    """Names and stored types of a file's contract columns; files that agree in it can share a scan."""
    wanted = {c.lower() for c in s.COLUMNS}
    columns = [metadata.schema.column(i) for i in range(metadata.num_columns)]
    return ", ".join(
        sorted(f"{c.path} {c.physical_type} {c.logical_type}" for c in columns if c.path.lower() in wanted)
    )


def file_manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, layout, lines, bytes) of every Parquet file at or below some paths.

    The layout is null where tasks have no file system of their own for the path's scheme; Spark's reader may
    still have one.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length")
    files = listed.count()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                try:
                    filesystem, name = fs.FileSystem.from_uri(_uri(path))
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
                    found.append((path, None, None, length))
                    continue
                with filesystem.open_input_file(name) as file:
                    metadata = pq.read_metadata(file)
                found.append((path, layout(metadata), metadata.num_rows, length))
            names = ["path", "layout", "lines", "bytes"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return listed.repartition(max(1, -(-files // FILES_PER_TASK))).mapInArrow(read, MANIFEST)


def scan_groups(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str | None, list[str]]]:
    """The files at some paths, grouped so that each group can be one scan: (base folder or None, files).

    A group has one layout. Files below a folder whose sub-folders name partitions keep that folder as their base,
    so the partition columns are read with them. Files whose footers tasks could not read are groups of their own.
    """
    roots = _qualified_roots(spark, paths)
    groups: dict[tuple, list[str]] = {}
    used: set[str] = set()
    for row in file_manifest(spark, paths).collect():
        root = _root_of(_uri(row["path"]), roots)
        used.add(root)
        folders = _uri(row["path"])[len(root) :].strip("/").split("/")[:-1]
        base = root if any("=" in folder for folder in folders) else None
        key = (base, row["layout"]) if row["layout"] is not None else (base, None, row["path"])
        groups.setdefault(key, []).append(row["path"])
    if without := [path for root, path in roots.items() if root not in used]:
        raise ValueError(f"no Parquet files at {', '.join(without)}")
    return [(key[0], sorted(files)) for key, files in sorted(groups.items(), key=lambda item: min(item[1]))]


def _qualified_roots(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """The given paths by their names with scheme and host, as Spark lists them; the JVM is asked once per folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders: dict[str, str] = {}
    roots: dict[str, str] = {}
    for path in paths:
        folder, slash, name = path.rstrip("/").rpartition("/")
        if not slash or not folder or folder.endswith("/"):  # a name alone, or one right below a root
            folder, name = path, ""
        if folder not in folders:
            at = hadoop(folder)
            folders[folder] = _uri(at.getFileSystem(conf).makeQualified(at).toString()).rstrip("/")
        roots[f"{folders[folder]}/{name}".rstrip("/")] = path
    return roots


def _root_of(file: str, roots: dict[str, str]) -> str:
    """The longest given path that the file is at or below."""
    at = file
    while at not in roots:
        at, slash, _ = at.rpartition("/")
        if not slash:
            raise ValueError(f"{file} is at none of the given paths")
    return at
