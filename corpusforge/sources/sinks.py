"""Writers: JSON lines with fingerprints, split outputs, manifests and small reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: str, files: int | None = None) -> DataFrame:
    """Write JSON lines sorted by ``order`` and return ``rows, fingerprint`` (K1). The fingerprint is a sum
    of row hashes, so it doesn't depend on how rows are dealt; with one file the bytes are fixed as well."""
    x = df.repartitionByRange(files, order) if files else df.repartitionByRange(order)
    x.sortWithinPartitions(order).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return fingerprint(df)


def fingerprint(df: DataFrame) -> DataFrame:
    row = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("fingerprint"))


def write_split(df: DataFrame, path: str, by: str) -> None:
    """One folder for each value of ``by``: valid and quarantine, or train, val and test (K3, K4). Rows are
    dealt by a hash of all columns, so a value that most rows have is many tasks' work."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, F.xxhash64(*df.columns)).write.mode("errorifexists").partitionBy(by).json(path)


def save_index(df: DataFrame, path: str, key: str) -> None:
    """An index as sorted parquet (K5): readers prune by the key's ranges."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def artifact_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``name, sha256, bytes, lines`` of the files of a run (K8)."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    lines = F.length(F.col("content").cast("string")) - F.length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")))
    return x.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), lines.alias("lines"))


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table (K6); more than ``limit`` rows are an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has {limit} rows at most")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def json_report(df: DataFrame) -> tuple[str, str]:
    """A one-row result as JSON and its SHA-256 (K2)."""
    text = json.dumps(df.first().asDict(recursive=True), indent=2, ensure_ascii=False, default=str)
    return text, hashlib.sha256(text.encode()).hexdigest()


def inject(template: str, data: object, mark: str = "/*DATA*/") -> str:
    """JSON data put into an HTML page at a mark, safe inside a script (K7)."""
    return template.replace(mark, json.dumps(data, ensure_ascii=False).replace("</", "<\\/"))
