"""RDF graphs as triples of names: N-Triples by Spark's text reader, RDF/XML a file at a time.

Names are IRIs without their brackets, the lexical values of literals (language and datatype say nothing about
which entity it is) and blank nodes with their file's mark, as a label means another node in another file.
``local`` shortens IRIs to what stands behind the last ``#``. A line or file that is no RDF ends the job with
what is wrong.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from io import BytesIO
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLES = "a string, p string, b string"
RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
XML_BASE = "{http://www.w3.org/XML/1998/namespace}base"

_IRI, _BLANK, _TEXT = r"<[^<>\"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>\"{}|^`\\\x00-\x20]*)*>", r"_:[^\s<>\".]+(?:\.+[^\s<>\".]+)*", r"\"(?:[^\"\\\n\r]|\\.)*\""
#: A line of N-Triples.
LINE = rf"^[ \t]*({_IRI}|{_BLANK})[ \t]*({_IRI})[ \t]*({_IRI}|{_BLANK}|{_TEXT})(?:\^\^{_IRI}|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?[ \t]*\.[ \t]*(?:#.*)?$"
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
# The escapes of one letter.
LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            if m[3] not in LETTERS:
                raise ValueError(f"not an escape: {m[0]}")
            return LETTERS[m[3]]
        return chr(int(m[1] or m[2], 16))

    return _ESCAPE.sub(one, text)


def _unescape(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(unescaped)

    return run(text)


def local_name(name: Column) -> Column:
    return F.regexp_extract(name, r"([^#]*)$", 1)


def read_ntriples(spark: SparkSession, path: str, local: bool = False) -> DataFrame:
    """a, p, b of N-Triples files; blank lines and comments are skipped."""
    lines = spark.read.text(path).select("value", F.hex(F.xxhash64("_metadata.file_path")).alias("file")).where(r"value rlike '^[ \t]*[^# \t]'")
    good = F.when(F.col("value").rlike(LINE), True).otherwise(F.raise_error(F.concat(F.lit("not a line of N-Triples: "), "value")))
    raw = lines.where(good).select("file", *(F.regexp_extract("value", LINE, i).alias(c) for i, c in enumerate(("a", "p", "b"), 1)))

    def name(c: str) -> Column:
        kind, inner = F.substring(c, 1, 1), F.substring(c, F.lit(2), F.length(c) - 2)
        text = F.when(inner.contains("\\"), _unescape(inner)).otherwise(inner)
        blank = F.concat(F.lit("_:"), "file", F.lit("."), F.substring(c, F.lit(3), F.length(c)))
        return F.when(kind == "_", blank).when(kind == "<", local_name(text) if local else text).otherwise(text)

    return raw.select(*(name(c).alias(c) for c in ("a", "p", "b")))


def parse_xml(data: bytes, mark: str) -> Iterator[tuple[str, str, str]]:
    """The triples of an RDF/XML document. Parts of it that are XML literals, lists or reified are not read."""
    count = 0
    base = [""]

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:{mark}.{count}"

    def iri(text: str) -> str:
        return urljoin(base[-1], text) if base[-1] else text

    def plain(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def subject(e) -> str:
        if RDF + "about" in e.attrib:
            return iri(e.get(RDF + "about"))
        if RDF + "ID" in e.attrib:
            return iri("#" + e.get(RDF + "ID"))
        return f"_:{mark}.n.{e.get(RDF + 'nodeID')}" if RDF + "nodeID" in e.attrib else fresh()

    def attributes(e, s: str) -> Iterator[tuple[str, str, str]]:
        for k, v in e.attrib.items():
            if not k.startswith(("{http://www.w3.org/XML/", RDF)):
                yield s, plain(k), v
            elif k == RDF + "type":
                yield s, plain(k), iri(v)

    def node(e) -> Iterator:
        s = subject(e)
        if e.tag != RDF + "Description":
            yield s, plain(RDF + "type"), plain(e.tag)
        yield from attributes(e, s)
        yield from properties(e, s)
        return s

    def properties(e, s: str) -> Iterator:
        items = 0
        for p in e:
            base.append(p.get(XML_BASE, base[-1]))
            if p.tag == RDF + "li":
                items += 1
            name = plain(p.tag) if p.tag != RDF + "li" else plain(f"{RDF}_{items}")
            way = p.get(RDF + "parseType")
            if way not in (None, "Resource") or RDF + "ID" in p.attrib:
                raise ValueError(f"RDF/XML that is not read: {way or 'a reified statement'}")
            more = [*attributes(p, "")]
            if way == "Resource":
                o = fresh()
                yield s, name, o
                yield from properties(p, o)
            elif RDF + "resource" in p.attrib or RDF + "nodeID" in p.attrib or more:
                o = iri(p.get(RDF + "resource")) if RDF + "resource" in p.attrib else f"_:{mark}.n.{p.get(RDF + 'nodeID')}" if RDF + "nodeID" in p.attrib else fresh()
                yield s, name, o
                yield from ((o, k, v) for _, k, v in more)
            elif len(p):
                for child in p:
                    o = yield from node(child)
                    yield s, name, o
            else:
                yield s, name, p.text or ""
            base.pop()

    depth, root = 0, None
    for event, e in ElementTree.iterparse(BytesIO(data), ("start", "end")):
        if event == "start":
            if depth == 0:
                root = e
                base[0] = e.get(XML_BASE, "")
            depth += 1
            continue
        depth -= 1
        if root.tag == RDF + "RDF" and depth == 1 or root.tag != RDF + "RDF" and depth == 0:
            base.append(e.get(XML_BASE, base[-1]))
            yield from node(e)
            base.pop()
            root.clear()  # what is read goes


def read_rdf_xml(spark: SparkSession, path: str, local: bool = False) -> DataFrame:
    """a, p, b of RDF/XML files. XML cannot be cut, so a file is one task's."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple[str, str, str]] = []
                try:
                    for t in parse_xml(data.as_py(), format(hash_of(name), "x")):
                        rows.append(t)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                except ElementTree.ParseError as e:
                    raise ValueError(f"{name} is no XML: {e}") from e
                yield _batch(rows)

    got = files.mapInArrow(run, TRIPLES)
    return got.select(*(F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(local_name(F.col(c))).alias(c) for c in ("a", "p", "b"))) if local else got


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("a", "p", "b"))})


def hash_of(name: str) -> int:
    from zlib import crc32

    return crc32(name.encode()) | len(name) << 32
