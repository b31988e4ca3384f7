"""Files inside archives, and Turtle: vocabularies as they are published."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT = "file string, value string"


def _members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the files in an archive, or of the file itself."""
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for inner in sorted(z.namelist()):
                if not inner.endswith("/"):
                    yield inner, z.read(inner)
    elif name.endswith((".tar.gz", ".tgz", ".tar")):
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
            for m in sorted(t.getmembers(), key=lambda m: m.name):
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
    else:
        yield name, content


def texts(spark: SparkSession, path: str, *endings: str) -> DataFrame:
    """``file, value`` of the text files with one of the ``endings`` at ``path``: a file, a folder, a zip, a tar or a tar.gz
    (S8 to S11). Spark finds and reads the files; each archive is opened where it is read and
    held whole there. Members of a folder that are no files of interest are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for inner, data in _members(name, content):
                    if inner.lower().endswith(endings):
                        yield pa.RecordBatch.from_arrays([pa.array([inner]), pa.array([data.decode("utf-8")])], names=["file", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, _TEXT)


_TOKEN = re.compile(
    r'(?P<comment>#[^\n]*)|<(?P<iri>[^<>\s]*)>|"""(?P<long>(?:[^"\\]|\\.|"(?!""))*)"""|"(?P<text>(?:[^"\\\n]|\\.)*)"'
    r"|(?P<at>@[A-Za-z][\w-]*)|(?P<kind>\^\^)|(?P<sign>[;,.\[\]()](?!\d))|(?P<blank>_:\w+)|(?P<name>[\w-]*:(?:[\w%-]|\.(?=[\w%-]))*)|(?P<word>[^\s;,\[\]()]+?(?=[\s;,\[\]()]|\.?\s|\.?$))",
    re.S,
)
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


def parse_turtle(text: str) -> Iterator[tuple[str, str, str]]:
    """(subject, predicate, object) of Turtle: prefixes, ``a``, lists with ``;`` and ``,``, literals without their language
    or type. Blank nodes have numbers; collections aren't read."""
    prefixes: dict[str, str] = {}
    base, blanks = "", 0
    tokens = [m for m in _TOKEN.finditer(text) if m.lastgroup != "comment"]
    stack: list[tuple[str | None, str | None]] = []
    subject = predicate = None
    i = 0
    while i < len(tokens):
        m, kind = tokens[i], tokens[i].lastgroup
        i += 1
        if (kind == "at" and m["at"] in ("@prefix", "@base")) or (kind == "word" and m["word"].upper() in ("PREFIX", "BASE")):
            if "base" in m[0].lower():
                base = tokens[i]["iri"]
                i += 1
            else:
                prefixes[tokens[i]["name"].rstrip(":")] = tokens[i + 1]["iri"]
                i += 2
            if m[0].startswith("@"):
                i += 1  # the point
            continue
        if kind == "sign" and m["sign"] in ";,.]":
            if m["sign"] == ".":
                subject = predicate = None
            elif m["sign"] == ";":
                predicate = None
            elif m["sign"] == "]":
                subject, predicate = stack.pop()
            continue
        if kind in ("at", "kind"):
            i += kind == "kind"  # a literal's language or type
            continue
        if kind == "iri":
            term = m["iri"] if re.match(r"[a-z][\w+.-]*:", m["iri"], re.I) else base + m["iri"]
        elif kind == "name":
            short, _, local = m["name"].partition(":")
            if short not in prefixes:
                raise ValueError(f"unknown prefix {short!r}")
            term = prefixes[short] + local
        elif kind in ("long", "text"):
            term = _unescaped(m[kind])
        elif kind == "word":
            term = _TYPE if m["word"] == "a" and subject is not None and predicate is None else m["word"]
        elif kind == "blank":
            term = m["blank"]
        elif m["sign"] == "[":
            blanks += 1
            term = f"_:b{blanks}"
        else:
            raise ValueError("collections aren't read")
        if subject is None:
            subject = term
        elif predicate is None:
            predicate = term
        else:
            yield subject, predicate, term
        if kind == "sign":
            stack.append((subject, predicate))
            subject, predicate = term, None


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o`` of the Turtle files at ``path``, archives included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = list(parse_turtle(text))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["s", "p", "o"])

    return texts(spark, path, ".ttl", ".turtle").select(F.col("value")).mapInArrow(run, "s string, p string, o string")
