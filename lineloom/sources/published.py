"""Tables that are replaced as a whole (U7, K2, K5): readers see the old ones until every new one is written.

A run writes its tables into a folder of its own. The manifest, which names that folder and its tables, is written last and
takes the old manifest's place by one rename. A run that fails leaves files that nothing points to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

#: A table of a run: its name, its format, and what makes it from the tables that the run has written before it.
Step = tuple[str, str, Callable[[dict[str, DataFrame]], DataFrame]]
MANIFEST = "manifest.json"


def publish(spark: SparkSession, root: str, steps: Sequence[Step], keep: int = 1) -> dict:
    """Write the tables of ``steps`` and make them those of ``root``; returns the manifest.

    Each step reads what earlier ones have written, so a shared table is computed once. ``keep`` older runs stay for readers
    that have begun; the folders of others, failed runs too, are deleted. Runs of one root must not overlap. The file system's rename must replace a file in one step.
    """
    root, version = root.rstrip("/"), uuid.uuid4().hex
    before = manifest(spark, root)
    tables, listed = {}, []
    for name, kind, make in steps:
        path = f"{root}/runs/{version}/{name}"
        make(tables).write.format(kind).save(path)
        tables[name] = spark.read.format(kind).load(path) if kind != "json" else spark.read.json(path)
        listed.append({"name": name, "format": kind, "rows": tables[name].count()})
    older = [before["version"], *before["older"]][:keep] if before else []
    new = {"version": version, "older": older, "tables": listed, "total": sum(t["rows"] for t in listed)}
    _swap(spark, root, json.dumps(new, sort_keys=True))
    _sweep(spark, root, {version, *older})
    return new


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What the last whole run has written; None before the first."""
    fs, path = _fs(spark, f"{root.rstrip('/')}/{MANIFEST}")
    if not fs.exists(path):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(path.toString()).collect()))


def published(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of the last whole run."""
    now = manifest(spark, root)
    found = next((t for t in now["tables"] if t["name"] == name), None) if now else None
    if found is None:
        raise LookupError(f"{root}: no table {name} is published")
    reader = spark.read.format(found["format"])
    return (reader.schema(schema) if schema else reader).load(f"{root.rstrip('/')}/runs/{now['version']}/{name}")


def replace_table(df: DataFrame, root: str, kind: str = "parquet") -> None:
    """One table in the place of what ``root`` has; ``df`` may be made from that."""
    publish(df.sparkSession, root, [("table", kind, lambda _: df)])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _swap(spark: SparkSession, root: str, text: str) -> None:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    fs, target = _fs(spark, f"{root}/{MANIFEST}")
    staged = hadoop.Path(f"{root}/.{MANIFEST}.{uuid.uuid4().hex}")
    out = fs.create(staged)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(target), how)


def _sweep(spark: SparkSession, root: str, kept: set[str]) -> None:
    fs, runs = _fs(spark, f"{root}/runs")
    for status in fs.listStatus(runs):
        if status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)
