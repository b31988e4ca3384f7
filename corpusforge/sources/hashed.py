"""JSON lines with SHA-256, counts and a manifest, committed all or not at all.

A task writes its files under temporary names and takes digest, lines and bytes as they pass. Its commit
message names them; when all tasks are done the driver renames the files and writes the manifest, last.
A task that fails deletes what it wrote, one that is killed leaves only temporary names, which the
end of the job clears; so files with final names are whole, and those of the manifest are the output.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "manifest.json"
_ENTRY = "path string, part string, lines long, bytes long, sha256 string"


def _open(uri: str):
    """(file system, path): of whatever store the uri names, on the driver and in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: temporary and final names, part, lines, bytes and digest."""

    files: list[tuple[str, str, str | None, int, int, str]]


def _named(part: str | None) -> str:
    """The beginning of the names of a part's files; other characters than plain ones are told apart by a digest."""
    if part is None:
        return ""
    plain = re.sub(r"[^A-Za-z0-9.]", "_", part)[:60]
    return plain + ("-" if plain == part else f"_{hashlib.sha256(part.encode()).hexdigest()[:12]}-")


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex[:12]
        files, base = _open(self.folder)
        if files.get_file_info(f"{base}/{MANIFEST}").is_file:
            raise ValueError(f"{folder} has an output already")
        files.create_dir(self._temporary(base))

    def _temporary(self, base: str) -> str:
        return f"{base}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = _open(self.folder)
        task = TaskContext.get()
        done, out, part, names = [], None, None, {}

        def close() -> None:
            nonlocal out
            out[0].close()
            done.append((out[1], out[2], part, out[3], out[4], out[5].hexdigest()))
            out = None

        try:
            for batch in iterator:
                lines, parts = batch.column(0), batch.column(1).to_pylist()
                cuts = [i for i in range(1, len(parts)) if parts[i] != parts[i - 1]]
                for lo, hi in zip([0, *cuts], [*cuts, len(parts)], strict=True):
                    if lo == hi:
                        continue
                    if out is None or parts[lo] != part:
                        if out is not None:
                            close()
                        part = parts[lo]
                        no = names[part] = names.get(part, -1) + 1
                        final = _named(part) + f"{task.partitionId():05d}" + (f"-{no}" if no else "") + ".jsonl"
                        temporary = f"{self._temporary(base)}/{len(done):05d}-{task.taskAttemptId()}"
                        out = [files.open_output_stream(temporary, compression=None), temporary, final, 0, 0, hashlib.sha256()]
                    data = ("\n".join(lines.slice(lo, hi - lo).to_pylist()) + "\n").encode()
                    out[0].write(data)
                    out[3], out[4] = out[3] + hi - lo, out[4] + len(data)
                    out[5].update(data)
            if out is not None:
                close()
        except BaseException:
            if out is not None:
                out[0].close()
            for f in [*(d[0] for d in done), *([out[1]] if out else [])]:
                files.delete_file(f)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _open(self.folder)
        entries = []
        for temporary, final, part, lines, size, digest in (f for m in messages if m is not None for f in m.files):
            files.move(temporary, f"{base}/{final}")
            entries.append({"path": final, "part": part, "lines": lines, "bytes": size, "sha256": digest})
        with files.open_output_stream(f"{self._temporary(base)}/{MANIFEST}", compression=None) as s:
            s.write("".join(json.dumps(e) + "\n" for e in sorted(entries, key=lambda e: e["path"])).encode())
        files.move(f"{self._temporary(base)}/{MANIFEST}", f"{base}/{MANIFEST}")
        files.delete_dir(self._temporary(base))

    def abort(self, messages: list[Written | None]) -> None:
        files, base = _open(self.folder)
        files.delete_dir(self._temporary(base))


class HashedLines(DataSource):
    """``df.write.format("hashed_lines")`` of ``line string, part string``, rows of a part together."""

    @classmethod
    def name(cls) -> str:
        return "hashed_lines"

    def schema(self) -> str:
        return "line string, part string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("an output is written once")
        return _Writer(self.options["path"])


def write_lines(df: DataFrame, path: str, order: str, by: str | None = None, one_file: bool = False) -> DataFrame:
    """Write the rows of ``df`` as JSON lines to a new folder and return its ``manifest`` (K1 to K4, K8).

    Rows are sorted by ``order``. With ``by`` each of its values has files of its own (valid and quarantine, or train,
    val and test); ``one_file`` then gives each value one file, whose digest depends on the rows alone, and without ``by`` makes the
    whole output one. Otherwise large values are cut by ranges of ``order``. Nulls are written; a null value of ``by`` is a file
    without a name. Rows that are equal in ``order`` are in the order of their lines."""
    df.sparkSession.dataSource.register(HashedLines)
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    x = df.select(line.alias("line"), (F.col(by).cast("string") if by else F.lit(None).cast("string")).alias("part"), F.col(order).alias("_order"))
    if one_file:
        x = x.repartition("part") if by else x.coalesce(1)
    else:
        x = x.repartitionByRange("part", "_order") if by else x.repartitionByRange("_order")
    x.sortWithinPartitions("part", "_order", "line").select("line", "part").write.format("hashed_lines").mode("append").save(path)
    return manifest(df.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, part, lines, bytes, sha256`` of a committed output; one without a manifest is an error."""
    return spark.read.schema(_ENTRY).json(f"{path.rstrip('/')}/{MANIFEST}")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with ``sound``: whether each file has its digest, lines and bytes still."""
    content = F.col("content").cast("string")
    got = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path)
    got = got.select(F.element_at(F.split("path", "/"), -1).alias("found"), F.sha2("content", 256).alias("now"), (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))).alias("n"), F.col("length").alias("size"))
    m = manifest(spark, path).withColumn("found", F.col("path"))
    x = m.join(got, "found", "left")
    return x.select("path", "part", "lines", "bytes", "sha256", F.coalesce((F.col("now") == F.col("sha256")) & (F.col("n") == F.col("lines")) & (F.col("size") == F.col("bytes")), F.lit(False)).alias("sound"))
