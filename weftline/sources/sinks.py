"""Validated, atomic publication of tables, and their manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame

from weftline.operators.quality import TableContract, table_metrics


def _fs(df: DataFrame, path: str):
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, contract: TableContract, *, partition_by: tuple[str, ...] = (), order_by: tuple[str, ...] = ()) -> dict:
    """Write beside ``path``, check the contract on what was written, then rename; returns the manifest.

    If the check fails nothing at ``path`` changes and the written files are removed. The key must
    be unique and free of nulls. ``order_by`` sorts inside partitions, which serves later scans
    without a global sort.
    """
    spark, tmp = df.sparkSession, f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex[:8]}"
    fs, at = _fs(df, tmp)
    try:
        w = (df.sortWithinPartitions(*order_by) if order_by else df).write.option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(tmp)
        m = table_metrics(spark.read.schema(df.schema).parquet(tmp), contract).first().asDict()
        if not m["key_is_unique"] or any(m[f"null_{k}"] for k in (*contract.primary_key, *contract.required)):
            raise ValueError(f"{contract.name} breaks its contract: {m}")
        _, to = _fs(df, path)
        old = _fs(df, f"{tmp}.old")[1]
        had = fs.exists(to)
        if had and not fs.rename(to, old):
            raise OSError(f"{path} cannot be moved")
        if not fs.rename(at, to):
            if had:
                fs.rename(old, to)
            raise OSError(f"{tmp} cannot be renamed")
        if had:
            fs.delete(old, True)
    except BaseException:
        fs.delete(at, True)
        raise
    manifest = {"name": contract.name, "primary_key": list(contract.primary_key), "schema": json.loads(df.schema.json()), **m}
    write_text(df, f"{path.rstrip('/')}.manifest.json", json.dumps(manifest, sort_keys=True, indent=1))
    return manifest


def write_text(df: DataFrame, path: str, text: str) -> None:
    """A small text file on the table's file system, replaced as a whole."""
    fs, p = _fs(df, path)
    tmp = _fs(df, f"{path}.tmp")[1]
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(tmp, p)


def changed(df: DataFrame, manifest: dict, contract: TableContract) -> bool:
    """Whether content differs from a manifest's: row count and order-free content hash."""
    m = table_metrics(df, contract).first()
    return (m["row_count"], m["content_hash"]) != (manifest["row_count"], manifest["content_hash"])


def write_csv(df: DataFrame, path: str, limit: int = 1_000_000) -> int:
    """A registry or annotation sheet as one CSV file; larger tables than ``limit`` rows are refused. Returns the rows."""
    n = df.count()
    if n > limit:
        raise ValueError(f"{n} rows are too many for one sheet")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    back = df.sparkSession.read.option("header", True).csv(path).count()
    if back != n:
        raise OSError(f"{back} rows were written of {n}")
    return n
