"""Readers for the record formats: JSON lines, documents, CSV, templates, triples, DBF, logs."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators._stored import store
from . import archives

PAIR = "natural_language string, ads_query string, category string, operator string, llm_score int"
CHAT = "messages array<struct<role:string,content:string>>"
TOPIC = "id string, label string, aliases array<string>, parents array<string>, children array<string>, source_id string, domain_tags array<string>, source_vocabulary string"
ENTITY = TOPIC + ", metadata map<string,string>, entity_subtype string"
RECORD = "id string, text string, text_type string, spans array<struct<surface:string,start:int,end:int,type:string,canonical_id:string,source_vocabulary:string,confidence:double>>"
ABSTRACT = "bibcode string, title string, abstract string, database array<string>, keywords array<string>, year int, doctype string, citation_count int, domain_category string"


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped (S1). Not ``strict``: bad lines
    are left out (S2); strict: the first one fails the read."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``line`` of what a tolerant scan leaves out."""
    kind = T.StructType.fromDDL(schema + ", _corrupt string")
    parsed = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).where(F.trim("value") != "").withColumn("r", parsed).where("r._corrupt is not null").select(F.col("value").alias("line"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One array or object a file (S3); a missing path is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """``query`` of a CSV log: the first column under a header."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(F.col(f"`{df.columns[0]}`").alias("query")).where("query is not null")


def templates(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(templates, errors)`` of a folder of YAML files, a list or one template each.

    The files are read by Spark and parsed on the driver: they are configuration. A file that can't be parsed, a template
    without id or intent, with an undefined slot (S6) or a repeated id is an error."""
    import yaml

    good, bad, seen = [], [], set()
    for name, text in sorted((r[0], r[1]) for r in spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name"), "value").collect()):
        try:
            loaded = yaml.safe_load(text)
            for t in loaded if isinstance(loaded, list) else [loaded]:
                slots = t.get("slots") or {}
                missing = [k for k in ("id", "intent", "nl_templates", "ads_query_template") if not t.get(k)]
                texts = [*(t.get("nl_templates") or []), t.get("ads_query_template") or ""]
                unknown = sorted({m for x in texts for m in _slots(x)} - set(slots))
                if missing or unknown or t["id"] in seen:
                    raise ValueError(f"missing {missing}, undefined slots {unknown}, repeated {t.get('id') in seen}")
                seen.add(t["id"])
                good.append((t["id"], t["intent"], t["nl_templates"], t["ads_query_template"], list(slots), {k: json.dumps(v) for k, v in slots.items()}))
        except Exception as e:  # noqa: BLE001
            if strict:
                raise
            bad.append((name, str(e)))
    kind = "id string, intent string, nl_templates array<string>, ads_query_template string, slot_order array<string>, slots map<string,string>"
    return spark.createDataFrame(good, kind), spark.createDataFrame(bad, "file string, error string")


def _slots(text: str) -> list[str]:
    import re

    return re.findall(r"\{(\w+)\}", text)


def undefined_slots(template, names):
    """Slots that a template text uses and nobody defines (S6, U2), as a Column."""
    return F.array_except(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)), names)


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o`` of N-Triples lines (S11); for Turtle see ``archives.turtle``."""
    x = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    pattern = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"\S*)\s*\.\s*$'
    part = lambda i: F.regexp_extract("value", pattern, i)
    return x.where(F.col("value").rlike(pattern)).select(part(1).alias("s"), part(2).alias("p"), F.concat(part(3), part(4)).alias("o"))


def dbf(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``fields map<string,string>`` of each row of dBase attribute tables (S12); deleted rows go."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([list(r.items()) for r in parse_dbf(content, encoding)], pa.map_(pa.string(), pa.string()))], names=["fields"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "fields map<string,string>")


def parse_dbf(content: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    count, start, size = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode(encoding), content[at + 16]))
        at += 32
    out = []
    for i in range(count):
        row = content[start + i * size : start + (i + 1) * size]
        if len(row) < size or row[:1] == b"*":
            continue
        at, values = 1, {}
        for name, width in fields:
            values[name] = row[at : at + width].decode(encoding, "replace").strip()
            at += width
        out.append(values)
    return out


def variant_tree(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``key, parent, name, depth`` of JSON lists of nested ``{kind: name, children: [...]}`` (S8, S10), in files, folders or
    archives: each level is one explode, to the last one."""
    x = store(archives.texts(spark, path, ".json"), "tree-files")
    level = x.select(F.explode(F.from_json("value", "array<string>")).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    out = None
    while True:
        named = level.select(F.get_json_object("node", f"$.{kind}").alias("name"), "parent", "depth", "node").withColumn("key", F.concat_ws("/", "parent", "name"))
        rows = named.select("key", "parent", "name", "depth")
        out = rows if out is None else out.unionByName(rows)
        level = named.select(F.explode(F.from_json(F.get_json_object("node", "$.children"), "array<string>")).alias("node"), F.col("key").alias("parent"), (F.col("depth") + 1).alias("depth"))
        level = store(level, "tree-level")
        if level.isEmpty():
            break
    return out


def chat_examples(spark: SparkSession, path: str) -> DataFrame:
    """``input, expected`` of chat JSON lines (S20): the user's text, and the assistant's query if its message is JSON, else the message."""
    x = jsonl(spark, path, CHAT)
    said = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]
    user = F.regexp_replace(said("user"), r"^(?s)Query:\s*(.*?)\s*(?:\nDate:.*)?$", "$1")
    return x.select(user.alias("input"), F.coalesce(F.get_json_object(said("assistant"), "$.query"), said("assistant")).alias("expected"))


def runs(spark: SparkSession, folder: str, limit: int = 10) -> DataFrame:
    """Evaluation runs of a folder, newest first (S21); files that can't be parsed are left out."""
    kind = "id string, timestamp string, model string, summary struct<total:int,valid:int,exact:int>, _bad string"
    x = spark.read.schema(kind).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/*.json").select("*", F.col("_metadata.file_name").alias("file"))
    return x.where("id is not null").drop("_bad").orderBy(F.desc("timestamp"), F.desc("file")).limit(limit)


def benchmark_cases(spark: SparkSession, path: str) -> DataFrame:
    """``category, subcategory, case`` of a nested benchmark file."""
    kind = "map<string,map<string,array<struct<id:string,natural_language:string,expected_query:string,difficulty:string,forbidden_patterns:array<string>>>>>"
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("category", "subs"))
    return x.select("category", F.explode("subs").alias("subcategory", "cases")).select("category", "subcategory", F.explode("cases").alias("c")).select("category", "subcategory", "c.*")
