"""Strict markup: text runs by node number, and rendering by node number.

A document is read by an incremental XML parser, piece by piece. It must be well-formed; a document type with declarations of its own and any
entity beyond XML's five and HTML's named characters is refused. Every start tag, end tag, text, comment and instruction is a node, and nodes
are numbered in document order; these numbers do not depend on what is translated. A document that does not parse is set aside with its line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint
from typing import NamedTuple
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.sources.books import BLOCKS, SKIPPED

XHTML = "http://www.w3.org/1999/xhtml"
XML = "http://www.w3.org/XML/1998/namespace"
#: Bytes that the parser is fed at a time.
PIECE = 1 << 16
#: Documents that leave a worker at once.
SLICE = 16


class Refused(ValueError):
    """Markup that is malformed or not allowed, with the line where that shows."""

    def __init__(self, reason: str, line: int) -> None:
        super().__init__(f"line {line}: {reason}")
        self.reason, self.line = reason, line


class Run(NamedTuple):
    """A readable text: its node, its place in the bytes, and where it stands."""

    node: int
    start: int
    stop: int
    style: str
    block: int
    text: str


class _Open(NamedTuple):
    name: str
    hidden: bool
    lang: str | None


class _Nodes:
    """Handlers of the parser. A text ends where the next other node begins."""

    def __init__(self, data: bytes) -> None:
        self.runs: list[Run] = []
        self._open: list[_Open] = []
        self._node = self._block = 0
        self._text: list[str] = []
        self._from = 0
        self._parser = p = expat.ParserCreate("utf-8", namespace_separator=" ")
        p.buffer_text = False
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._data
        p.CommentHandler = p.ProcessingInstructionHandler = self._other
        p.StartCdataSectionHandler = p.EndCdataSectionHandler = self._other
        p.StartDoctypeDeclHandler = self._doctype
        p.EntityDeclHandler = p.SkippedEntityHandler = self._entity
        p.UseForeignDTD(True)  # names known from HTML come to the handler below instead of ending the parse
        p.ExternalEntityRefHandler = lambda *_: 1
        p.DefaultHandler = self._default
        try:
            for at in range(0, len(data), PIECE):
                p.Parse(data[at : at + PIECE], False)
            p.Parse(b"", True)
        except expat.ExpatError as e:
            raise Refused(expat.errors.messages.get(e.code, "malformed"), e.lineno) from None

    def _close_text(self) -> None:
        if self._text:
            text, self._text = "".join(self._text), []
            lang = next((e.lang for e in reversed(self._open) if e.lang), None)
            readable = not any(e.hidden for e in self._open) and (lang is None or re.fullmatch("en(?:[-_].*)?", lang.strip(), re.I))
            if readable and re.search("[A-Za-z]", text):
                style = "/".join(e.name for e in self._open if e.name not in ("html", "body"))
                self.runs.append(Run(self._node, self._from, self._parser.CurrentByteIndex, style, self._block, text))
            self._node += 1

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        self._close_text()
        space, _, local = name.rpartition(" ")
        local = local.lower() if space in ("", XHTML) else name
        self._block += local in BLOCKS
        hidden = local in SKIPPED or space not in ("", XHTML) or attributes.get("translate", "").lower() == "no" or "notranslate" in attributes.get("class", "").split()
        self._open.append(_Open(local, hidden, attributes.get(f"{XML} lang") or attributes.get("lang")))
        self._node += 1

    def _end(self, name: str) -> None:
        self._close_text()
        self._block += self._open.pop().name in BLOCKS
        self._node += 1

    def _data(self, text: str) -> None:
        if not self._text:
            self._from = self._parser.CurrentByteIndex
        self._text.append(text)

    def _other(self, *_: object) -> None:
        self._close_text()
        self._node += 1

    def _doctype(self, name: str, system: str | None, public: str | None, declares: int) -> None:
        if declares:
            raise Refused("declarations are not allowed", self._parser.CurrentLineNumber)

    def _entity(self, name: str, *_: object) -> None:
        if name not in name2codepoint:
            raise Refused(f"unknown entity {name}", self._parser.CurrentLineNumber)
        self._data(chr(name2codepoint[name]))

    def _default(self, data: str) -> None:
        """Whatever no other handler takes; of that, only references to named characters are text."""
        if data.startswith("&") and data.endswith(";"):
            self._entity(data[1:-1])


def runs_of(html: str) -> list[Run]:
    """The readable texts of a document; raises ``Refused``."""
    return _Nodes(html.encode("utf-8", "surrogatepass")).runs


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def replaced(html: str, targets: dict[int, str]) -> str:
    """The document with the texts of some nodes replaced (as text: markup in a target is escaped); all other bytes stay."""
    data, parts, at = html.encode("utf-8", "surrogatepass"), [], 0
    for run in runs_of(html):
        if run.node in targets:
            parts += [data[at : run.start], escaped(targets[run.node]).encode()]
            at = run.stop
    return b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")


def _documents(batches: Iterator[pa.RecordBatch], rows: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in slices: of a batch, few documents are made Python objects at a time (texts and nodes take many times their bytes)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def node_slots(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, node, style, block, text, fault, line``: a row per readable text; of a document that is refused, one row with its ``fault`` and ``line``.

    ``text`` has its references resolved. Null and empty documents have no rows.
    """
    names = [key, "node", "style", "block", "text", "fault", "line"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _documents(batches):
            text = part.column(1)[0].as_py()
            if not text:
                continue
            try:
                rows = [(r.node, r.style, r.block, r.text, None, None) for r in runs_of(text)]
            except Refused as e:
                rows = [(None, None, None, None, e.reason, e.line)]
            if rows:
                own = pa.repeat(part.column(0)[0], len(rows))
                yield pa.record_batch([own, *[pa.array(x, k) for x, k in zip(zip(*rows), kinds)]], names)

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(read, f"`{key}` {kind}, node long, style string, block long, text string, fault string, line long")


def rendered_by_node(pages: DataFrame, targets: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, html, fault``: documents with the texts of nodes replaced by ``targets`` (``key, node, target``).

    Nodes without a target keep their bytes. A fault, and null in place of the document, where it is refused, where a target is null, or names a node that is no
    readable text or has two.
    """
    own = targets.groupBy(key).agg(F.collect_list(F.struct(F.col("node").cast("long").alias("node"), "target")).alias("_targets"))

    def one(text: str | None, rows: list[dict] | None) -> tuple[str | None, str | None]:
        if text is None or not rows:
            return text, None
        named = {r["node"]: r["target"] for r in rows}
        if len(named) < len(rows):
            return None, "node given twice"
        if any(t is None for t in named.values()):
            return None, "target missing"
        try:
            if not named.keys() <= {r.node for r in runs_of(text)}:
                return None, "no such node"
            return replaced(text, named), None
        except Refused as e:
            return None, str(e)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _documents(batches, SLICE):
            done = [one(text.as_py(), rows.as_py()) for text, rows in zip(part.column(1), part.column(2))]
            yield pa.record_batch([part.column(0), *[pa.array(x, pa.string()) for x in zip(*done)]], [key, html, "fault"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).join(own, key, "left").select(key, html, "_targets").mapInArrow(put, f"`{key}` {kind}, `{html}` string, fault string")
