"""RDF/XML, element by element: no tree is built, only the open elements are held."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import archives

_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_XML = "http://www.w3.org/XML/1998/namespace"
#: What namespace and name are told apart by in the parser's names.
_CUT = " "
#: Bytes that the parser gets, and triples that go on, at once.
CHUNK, ROWS = 1 << 16, 10_000
#: Attributes that say what an element is and aren't properties.
_OWN = {_RDF + n for n in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "bagID", "aboutEach", "type")}


class _Open:
    """An element that hasn't ended: the root, a node or a property."""

    __slots__ = ("kind", "base", "term", "text", "items", "mode", "members")

    def __init__(self, kind: str, base: str, term: str | None = None, mode: str = ""):
        self.kind, self.base, self.term, self.mode = kind, base, term, mode
        self.text: list[str] = []
        self.items: list[str] = []
        self.members = 0


class _Reader:
    def __init__(self, base: str = ""):
        self.out: list[tuple[str, str, str]] = []
        self.stack: list[_Open] = [_Open("root", base)]
        self.blanks = 0
        self.inside = 0  # open elements within an XML literal
        self.parser = expat.ParserCreate(namespace_separator=_CUT)
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.text

    def blank(self) -> str:
        self.blanks += 1
        return f"_:b{self.blanks}"

    def iri(self, base: str, given: str) -> str:
        return urljoin(base, given) if base else given

    def start(self, name: str, attributes: dict[str, str]) -> None:
        top = self.stack[-1]
        if self.inside:
            self.inside += 1
            top.text.append("<" + name.rpartition(_CUT)[2] + "".join(f" {k.rpartition(_CUT)[2]}={quoteattr(v)}" for k, v in attributes.items()) + ">")
            return
        name, a = name.replace(_CUT, ""), {k.replace(_CUT, "", 1): v for k, v in attributes.items()}
        base = self.iri(top.base, a[_XML + "base"]) if _XML + "base" in a else top.base
        if name == _RDF + "RDF" and top.kind == "root":
            self.stack.append(_Open("root", base))
        elif top.kind in ("root", "property"):
            self.node(name, a, base, top)
        else:
            self.property(name, a, base, top)

    def attributes(self, subject: str, a: dict[str, str], base: str) -> None:
        """Properties that are written as attributes."""
        if _RDF + "type" in a:
            self.out.append((subject, _RDF + "type", self.iri(base, a[_RDF + "type"])))
        for k, v in a.items():
            if k not in _OWN and not k.startswith(_XML) and "://" in k:
                self.out.append((subject, k, v))

    def subject(self, a: dict[str, str], base: str) -> str:
        if _RDF + "about" in a:
            return self.iri(base, a[_RDF + "about"])
        if _RDF + "ID" in a:
            return self.iri(base, "#" + a[_RDF + "ID"])
        return "_:" + a[_RDF + "nodeID"] if _RDF + "nodeID" in a else self.blank()

    def node(self, name: str, a: dict[str, str], base: str, top: _Open) -> None:
        term = self.subject(a, base)
        self.stack.append(_Open("node", base, term))
        if name != _RDF + "Description":
            self.out.append((term, _RDF + "type", name))
        self.attributes(term, a, base)
        if top.kind == "property":
            top.items.append(term)
            if top.mode != "Collection":
                self.out.append((self.stack[-3].term, top.term, term))

    def property(self, name: str, a: dict[str, str], base: str, top: _Open) -> None:
        if name == _RDF + "li":
            top.members += 1
            name = f"{_RDF}_{top.members}"
        mode = a.get(_RDF + "parseType", "")
        own = [k for k in a if k not in _OWN and not k.startswith(_XML) and "://" in k]
        if mode == "Resource":
            # The property's content are properties of a node that isn't written.
            term = self.blank()
            self.out.append((top.term, name, term))
            self.stack.append(_Open("node", base, term, "Resource"))
            return
        self.stack.append(_Open("property", base, name, mode))
        if mode in ("Collection", "Literal"):
            self.inside = int(mode == "Literal")
            return
        if _RDF + "resource" in a or _RDF + "nodeID" in a or own or _RDF + "type" in a:
            term = self.iri(base, a[_RDF + "resource"]) if _RDF + "resource" in a else self.subject(a, base) if _RDF + "nodeID" in a else self.blank()
            self.out.append((top.term, name, term))
            self.stack[-1].items.append(term)
            self.attributes(term, a, base)

    def text(self, data: str) -> None:
        if self.stack[-1].kind == "property":
            self.stack[-1].text.append(escape(data) if self.inside else data)

    def end(self, name: str) -> None:
        if self.inside > 1:
            self.inside -= 1
            self.stack[-1].text.append(f"</{name.rpartition(_CUT)[2]}>")
            return
        self.inside = 0
        top = self.stack.pop()
        if top.kind != "property":
            return
        subject = self.stack[-1].term
        if top.mode == "Collection":
            rest = _RDF + "nil"
            for item in reversed(top.items):
                cell = self.blank()
                self.out += [(cell, _RDF + "first", item), (cell, _RDF + "rest", rest)]
                rest = cell
            self.out.append((subject, top.term, rest))
        elif not top.items:
            self.out.append((subject, top.term, "".join(top.text)))


def parse(content: bytes, base: str = "") -> Iterator[list[tuple[str, str, str]]]:
    """(subject, predicate, object) of RDF/XML in lists of about ``ROWS``, as its elements end.

    Nodes by ``rdf:about``, ``rdf:ID``, ``rdf:nodeID`` or none (blank, numbered), nested or typed; properties as elements or attributes,
    with ``rdf:resource``, nested nodes, ``rdf:li``, and all three values of ``rdf:parseType``; ``xml:base`` and entities. Literals come without
    language or type, as from Turtle; statements about statements (``rdf:ID`` on a property) aren't made. What is not XML is an error."""
    r = _Reader(base)
    for at in range(0, max(len(content), 1), CHUNK):
        r.parser.Parse(content[at : at + CHUNK], at + CHUNK >= len(content))
        if len(r.out) >= ROWS:
            yield r.out
            r.out = []
    if r.out:
        yield r.out


def triples(texts: DataFrame, column: str = "value", base: str = "") -> DataFrame:
    """``s, p, o`` of the RDF/XML documents in a column of texts or bytes; nulls have none. Blank nodes are numbered in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for rows in parse(content, base) if content is not None else ():
                    yield _rows(rows)

    return texts.select(texts[column].cast("binary")).mapInArrow(run, _TRIPLES)


_TRIPLES = "s string, p string, o string"


def _rows(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["s", "p", "o"])


def rdfxml(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """``s, p, o`` of the RDF/XML files (``.rdf``, ``.owl``, ``.xml``) at ``path``, a file, folder or archive (S11). A file's
    bytes are in one task, its triples are passed on as they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for inner, data in archives._members(name, content):
                    if inner.lower().endswith((".rdf", ".owl", ".xml")):
                        for rows in parse(data, base):
                            yield _rows(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, _TRIPLES)
