"""Export of evidence bundles as files, and reading them back as tables for verification."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.ids import sha256


def artifact_refs(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, role, path, sha256, bytes of artifacts (keys, role, path, body)."""
    return artifacts.select(*keys, "role", "path", sha256(F.col("body")).alias("sha256"), F.octet_length("body").cast("long").alias("bytes"))


def _value(name: str) -> Column:
    """A field's value as JSON."""
    return F.expr(f"substring(to_json(named_struct('v', `{name}`), map('ignoreNullFields', 'false')), 6, length(to_json(named_struct('v', `{name}`), map('ignoreNullFields', 'false'))) - 6)")


def json_lines(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, body: each key's rows as JSON lines with sorted fields, in order; nested values stand without blanks."""
    fields = sorted(c for c in rows.columns if c not in keys)
    line = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), _value(c)) for c in fields]), F.lit("}\n"))
    lines = rows.select(*keys, F.struct(*order).alias("_o"), line.alias("_j"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_j"))), lambda x: x["_j"]), "").alias("body"))


def publish(files: list[tuple[str, bytes]], folder: str) -> None:
    """Write one bundle's files into a new folder, all or nothing: a hidden sibling is filled and then renamed.

    For the command line's single bundles; tables of bundles are published by `write_bundles`.
    """
    target = Path(folder)
    if target.is_symlink() or (target.exists() and (not target.is_dir() or any(target.iterdir()))):
        raise ValueError(f"invalid_input: output is not a new or empty folder: {folder}")
    target.parent.mkdir(parents=True, exist_ok=True)
    hidden = Path(tempfile.mkdtemp(prefix=f".{target.name}.", dir=target.parent))
    try:
        for name, body in files:
            if not name or PurePosixPath(name).is_absolute() or ".." in PurePosixPath(name).parts:
                raise ValueError(f"invalid_input: unsafe artifact path: {name}")
            (hidden / name).write_bytes(body)
        if target.exists():
            target.rmdir()
        hidden.rename(target)
    except BaseException:
        shutil.rmtree(hidden, ignore_errors=True)
        raise


def read_bundle(folder: str) -> list[tuple[str, bytes]]:
    """Name and content of each file of one bundle's folder; links and folders within it are refused."""
    root = Path(folder)
    if root.is_symlink() or not root.is_dir():
        raise ValueError(f"invalid_input: not a bundle folder: {folder}")
    out = []
    for entry in sorted(root.iterdir()):
        if entry.is_symlink() or not entry.is_file():
            raise ValueError(f"verification_failed: unsafe artifact target: {entry.name}")
        out.append((entry.name, entry.read_bytes()))
    return out


def write_bundles(artifacts: DataFrame, folder: str) -> None:
    """Publish artifacts (bundle, role, path, body) as one table per job: all of it or nothing, never over another."""
    artifacts.write.partitionBy("role").mode("errorifexists").parquet(folder)


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
