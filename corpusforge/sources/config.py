"""Source configuration, catalog scans, registry records of either schema, downloads and clones, metrics."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import archives

KINDS = ("http", "git")


@dataclass(frozen=True)
class Source:
    id: str
    kind: str
    url: str
    license: str = ""
    checksum: str | None = None


def load_sources(path: str) -> list[Source]:
    """The sources of a YAML file (S7); all mistakes are reported together."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = (yaml.safe_load(f) or {}).get("sources") or []
    errors, out, seen = [], [], set()
    for i, r in enumerate(rows):
        missing = [k for k in ("id", "type", "url") if not r.get(k)]
        if missing:
            errors.append(f"source {i}: missing {', '.join(missing)}")
        elif r["type"] not in KINDS:
            errors.append(f"source {r['id']}: unknown type {r['type']}")
        elif r["id"] in seen:
            errors.append(f"source {r['id']}: repeated")
        else:
            seen.add(r["id"])
            out.append(Source(r["id"], r["type"], r["url"], r.get("license", ""), r.get("checksum")))
    if errors:
        raise ValueError("; ".join(errors))
    return out


#: (url, headers) → (status, headers, chunks): how a source is asked for over the network.
Transport = Callable[[str, dict[str, str]], tuple[int, dict[str, str], Iterable[bytes]]]


def http(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], Iterable[bytes]]:
    """A GET in chunks; an answer that nothing changed is an answer and no error."""
    try:
        r = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60)
    except urllib.error.HTTPError as e:
        if e.code != 304:
            raise
        return 304, dict(e.headers), ()
    return r.status, dict(r.headers), iter(lambda: r.read(1 << 20), b"")


def _download(source: Source, folder: str, state: dict | None, transport: Transport) -> dict:
    target = os.path.join(folder, f"{source.id}{os.path.splitext(urllib.parse.urlparse(source.url).path)[1]}")
    known = state["mark"] if state and os.path.exists(target) else {}
    ask = {h: known[k] for h, k in (("If-None-Match", "etag"), ("If-Modified-Since", "last-modified")) if known.get(k)}
    status, headers, chunks = transport(source.url, ask)
    if status == 304:
        return {**state, "cached": True}
    if status != 200:
        raise ValueError(f"{source.id}: status {status}")
    digest = _write(source, target, chunks)
    low = {k.lower(): v for k, v in headers.items()}
    return {"id": source.id, "path": target, "sha256": digest, "mark": {k: low.get(k) for k in ("etag", "last-modified")}, "cached": False}


def _write(source: Source, target: str, chunks: Iterable[bytes]) -> str:
    """Write under another name, hash on the way, check, rename."""
    digest, temp = hashlib.sha256(), f"{target}.part"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(temp, "wb") as out:
        for chunk in chunks:
            digest.update(chunk)
            out.write(chunk)
    if source.checksum and source.checksum != digest.hexdigest():
        os.remove(temp)
        raise ValueError(f"{source.id}: checksum is {digest.hexdigest()}")
    os.replace(temp, target)
    return digest.hexdigest()


def checkout(source: Source, folder: str, revision: str | None = None) -> dict:
    """A clone of a git source at a revision, or at the newest one, with the commit it stands at (S15). A clone that is there is
    fetched; a revision that it has already isn't asked for."""
    target = os.path.join(folder, source.id)

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", target, *args], check=True, capture_output=True, text=True).stdout.strip()

    if not os.path.isdir(os.path.join(target, ".git")):
        os.makedirs(folder, exist_ok=True)
        subprocess.run(["git", "clone", "--quiet", source.url, target], check=True, capture_output=True)
    elif not revision or subprocess.run(["git", "-C", target, "cat-file", "-e", f"{revision}^{{commit}}"], capture_output=True).returncode:
        git("fetch", "--quiet", "--tags", "origin")
    git("checkout", "--quiet", "--detach", revision or "origin/HEAD")
    return {"id": source.id, "path": target, "commit": git("rev-parse", "HEAD"), "pinned": revision}


def fetch(source: Source, folder: str, state: dict | None = None, transport: Transport = http) -> dict:
    """Copy a source into ``folder`` and hash it on the way.

    ``state`` is what an earlier call returned. A ``file://`` source of the same size and time, and one over
    the network that answers a conditional request with 304, isn't copied if the copy is still there."""
    if source.url.startswith(("http://", "https://")):
        return _download(source, folder, state, transport)
    if not source.url.startswith("file://"):
        raise ValueError(f"{source.id}: neither file:// nor http")
    path = source.url.removeprefix("file://")
    mark = [os.stat(path).st_size, os.stat(path).st_mtime_ns]
    target = os.path.join(folder, f"{source.id}{os.path.splitext(path)[1]}")
    if state and state["mark"] == mark and os.path.exists(target):
        return {**state, "cached": True}
    with open(path, "rb") as src:
        digest = _write(source, target, iter(lambda: src.read(1 << 20), b""))
    return {"id": source.id, "path": target, "sha256": digest, "mark": mark, "cached": False}


def catalog_entries(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Catalog lines of all paths, with the ``entry_type`` of each."""
    out = None
    for kind, path in paths.items():
        x = spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("entry_type", F.lit(kind))
        out = x if out is None else out.unionByName(x)
    return out


_REGISTRY = (
    "id string, status string, name string, aliases array<string>, acronyms array<string>, labels array<struct<label:string,iso639:string>>, country struct<country_name:string>, "
    "names array<struct<value:string,types:array<string>>>, locations array<struct<geonames_details:struct<country_name:string>>>"
)


def registry_records(spark: SparkSession, path: str) -> DataFrame:
    """``id, status, names, locations, country`` of organization records of either schema (S9, P13, Z10), JSON in files or
    archives: the older one's name, labels, acronyms and aliases become typed names."""
    one = T.StructType.fromDDL(_REGISTRY)
    x = archives.texts(spark, path, ".json").select(F.explode(F.from_json("value", T.ArrayType(one))).alias("r")).select("r.*")
    typed = lambda values, kind: F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), lambda v: F.struct(v.alias("value"), F.array(F.lit(kind)).alias("types")))
    old = F.concat(F.when(F.col("name").isNotNull(), F.array(F.struct(F.col("name").alias("value"), F.array(F.lit("ror_display"), F.lit("label")).alias("types")))).otherwise(typed(F.lit(None).cast("array<string>"), "x")), typed(F.transform("labels", lambda v: v["label"]), "label"), typed(F.col("acronyms"), "acronym"), typed(F.col("aliases"), "alias"))
    places = F.transform(F.coalesce("locations", F.expr("cast(array() as array<struct<geonames_details:struct<country_name:string>>>)")), lambda p: F.struct(p["geonames_details"]["country_name"].alias("country_name")))
    return x.select("id", "status", F.coalesce("names", old).alias("names"), places.alias("locations"), F.col("country.country_name").alias("country"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """``name, labels, value`` of a metrics page."""
    pattern = r"^([a-zA-Z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+\d+)?$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    x = spark.read.text(path).where(F.col("value").rlike(pattern) & ~F.col("value").startswith("#"))
    return x.select(part(1).alias("name"), part(2).alias("labels"), part(3).try_cast("double").alias("value"))


def append_example(df: DataFrame, path: str) -> None:
    """Add examples to a stored set (K9)."""
    df.write.mode("append").parquet(path)


def run_summary(runs: DataFrame) -> DataFrame:
    """Percentages and a verdict for evaluation runs ``(id, summary)``."""
    pct = lambda c: F.round(F.coalesce(F.try_divide(100.0 * F.col(f"summary.{c}"), F.col("summary.total")), F.lit(0.0)), 1)
    x = runs.select("id", F.col("summary.total").alias("total"), pct("valid").alias("valid_pct"), pct("exact").alias("exact_pct"))
    return x.withColumn("status", F.when(F.col("valid_pct") >= 95, "pass").when(F.col("valid_pct") >= 80, "needs_improvement").otherwise("fail"))


def dump_state(state: dict, path: str) -> None:
    """A fetch's state as JSON, by rename."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(state, f, sort_keys=True)
    os.replace(f"{path}.tmp", path)
