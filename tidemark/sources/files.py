"""Sources and sinks: CSV with line breaks, JSON documents, fragments, pinned
snapshots, sealed archives."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.integrity import expect_columns, valid_member


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, RFC quoting and line breaks inside cells. Blank cells
    are empty text, never NULL; a byte order mark is dropped by the reader. The
    header must have the schema's columns."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", nullValue="\0", emptyValue="", inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    expect_columns(raw, schema.fieldNames())
    blank = lambda f: F.col(f.name) if isinstance(f.dataType, T.StringType) else F.when(F.trim(f.name) != "", F.col(f.name))
    return raw.select(*[F.coalesce(blank(f), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else blank(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """Fails if there is something already; Spark's commit makes it whole or
    nothing."""
    df.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_documents(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    r = spark.read.option("multiLine", multi_line)
    return (r.schema(schema) if schema else r).json(path)


def read_fragments(spark: SparkSession, folder: str, key: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """One row per JSON file of a folder, or with multi_line off per line; a
    repeated key is an error, raised when the rows are read."""
    df = read_documents(spark, f"{folder}/*.json", schema, multi_line)
    n = df.groupBy(key).agg(F.count("*").alias("tm_n"))
    bad = F.raise_error(F.concat(F.lit("repeated fragment "), F.col(key).cast("string")))
    return df.join(n, key).where(F.when(F.col("tm_n") > 1, bad.cast("boolean")).otherwise(True)).drop("tm_n")


def write_json(summary: dict, path: str) -> None:
    """Sorted keys, LF, written beside and then moved."""
    tmp = f"{path}.tmp"
    Path(tmp).write_text(json.dumps(summary, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8", newline="\n")
    os.replace(tmp, path)


def write_documents(df: DataFrame, folder: str, *, name: str) -> None:
    """One JSON document per row, with sorted keys over many lines, as files of
    the folder named by a column (each value once). Tasks write them beside
    their final place and move them, so a task that runs twice leaves one."""
    out = folder.removeprefix("file:").replace("//", "/", 1) if folder.startswith("file:") else folder

    def write(rows):
        os.makedirs(out, exist_ok=True)
        for r in rows:
            write_json(r.asDict(recursive=True), os.path.join(out, f"{r[name]}.json"))

    df.foreachPartition(write)


def vectors_to_bytes(df: DataFrame, vector: str, blob: str) -> DataFrame:
    """df with its vectors as little-endian 4-byte floats; NULL elements are
    NaN, a NULL vector is NULL."""
    kept = [c for c in df.columns if c != vector]

    def run(batches):
        for b in batches:
            v = b.column(b.schema.names.index(vector))
            cells = [None if x is None else np.array([np.nan if y is None else y for y in x], "<f4").tobytes() for x in v.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in kept], pa.array(cells, pa.binary())], [*kept, blob])

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], T.StructField(blob, T.BinaryType())]))


def vectors_from_bytes(df: DataFrame, blob: str, vector: str) -> DataFrame:
    """The way back, for a whole batch of equally or unequally long blobs at
    once; a blob whose length is no multiple of four is an error."""
    kept = [c for c in df.columns if c != blob]

    def run(batches):
        for b in batches:
            v = b.column(b.schema.names.index(blob))
            sizes = np.array([len(x) if x is not None else 0 for x in v.to_pylist()], np.int64)
            if (sizes % 4).any():
                raise ValueError("a blob that isn't made of 4-byte floats")
            flat = np.frombuffer(b"".join(x for x in v.to_pylist() if x is not None), "<f4")
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes // 4)].astype(np.int32)), pa.array(flat), mask=v.is_null())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in kept], lists], [*kept, vector])

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], T.StructField(vector, T.ArrayType(T.FloatType()))]))


def publish(df: DataFrame, root: str) -> int:
    """Write the next version of a table; versions never change. A reader that
    has pinned one isn't touched."""
    v = latest(df.sparkSession, root) + 1
    df.write.mode("errorifexists").parquet(f"{root}/v={v}")
    return v


def latest(spark: SparkSession, root: str) -> int:
    """The newest version, 0 if there is none: a cheap test for change."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return 0
    names = [s.getPath() for s in fs.listStatus(p)]
    done = [int(n.getName()[2:]) for n in names if n.getName().startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
    return max(done, default=0)


def pinned(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version or latest(spark, root)}")


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the parquet tables of a folder, in order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def catalog(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """table_name, column_name, data_type of the parquet tables of a folder, or
    of those named; only their footers are read."""
    rows = [(n, f.name, f.dataType.simpleString()) for n in (list_tables(spark, folder) if names is None else names) for f in spark.read.parquet(f"{folder}/{n}.parquet").schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def pack(folder: str, archive: str) -> dict[str, str]:
    """Zip of a folder's files in order with fixed times; returns their hashes."""
    out = {}
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(x for x in Path(folder).rglob("*") if x.is_file()):
            name, data = p.relative_to(folder).as_posix(), p.read_bytes()
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
            out[name] = hashlib.sha256(data).hexdigest()
    return out


def verify_pack(archive: str, expected: dict[str, str]) -> None:
    with zipfile.ZipFile(archive) as z:
        names = z.namelist()
        if sorted(names) != sorted(expected) or len(set(names)) != len(names):
            raise ValueError("the archive's members aren't the expected ones")
        for n in names:
            if not valid_member(n):
                raise ValueError(f"unsafe member {n}")
            if hashlib.sha256(z.read(n)).hexdigest() != expected[n]:
                raise ValueError(f"changed member {n}")


def install_pack(archive: str, expected: dict[str, str], target: str) -> None:
    """Unpack a verified archive where nothing is yet; whole or not at all."""
    if os.path.exists(target):
        raise FileExistsError(target)
    verify_pack(archive, expected)
    tmp = f"{target}.tmp"
    with zipfile.ZipFile(archive) as z:
        z.extractall(tmp)
    os.replace(tmp, target)


def pack_roundtrip(members: DataFrame, folder: str) -> DataFrame:
    """member, hash, whole: writes (member, content) as files, packs them, checks
    and installs the archive, and sees that a changed and an incomplete copy are
    refused. Archives are single files made in one place: meant for a release
    of few members, which are collected."""
    base = Path(folder.removeprefix("file://"))
    (base / "in").mkdir(parents=True)
    for r in members.collect():
        if not valid_member(r["member"]):
            raise ValueError(f"unsafe member {r['member']}")
        (base / "in" / r["member"]).write_text(r["content"], encoding="utf-8", newline="\n")
    hashes = pack(str(base / "in"), str(base / "a.zip"))
    install_pack(str(base / "a.zip"), hashes, str(base / "out"))
    refused = 0
    for wrong in ({k: "0" * 64 for k in hashes}, dict(list(hashes.items())[1:]), hashes | {"../x": "0" * 64}):
        try:
            verify_pack(str(base / "a.zip"), wrong)
        except ValueError:
            refused += 1
    rows = [(k, v, refused == 3 and hashlib.sha256((base / "out" / k).read_bytes()).hexdigest() == v) for k, v in sorted(hashes.items())]
    return members.sparkSession.createDataFrame(rows, "member string, hash string, whole boolean")
