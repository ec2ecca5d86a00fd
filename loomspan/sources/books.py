"""E-books as tables: archives are scanned to members, manifest, slots and links, and rendered back.

Archives come from the ``binaryFile`` source; each is parsed inside one Arrow task. Markup is read tolerantly
by an event parser that keeps every character outside the changed slots byte for byte.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from posixpath import dirname, join, normpath
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ARCHIVE, MAX_TOTAL, MAX_MEMBER, MAX_MEMBERS = 150 << 20, 300 << 20, 32 << 20, 10_000
#: Elements whose text is never read.
SKIPPED = frozenset("script style code pre kbd samp var svg math".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 td th dd dt blockquote title caption figcaption".split())
FONT_ALGORITHMS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def resolve(base: str, href: str) -> tuple[str, str] | None:
    """Archive path and fragment of a reference; null for other schemes, absolute paths and escapes."""
    try:
        url = urlsplit(href)
    except ValueError:
        return None
    if url.scheme or url.netloc or url.path.startswith("/"):
        return None
    path = normpath(join(dirname(base), unquote(url.path))) if url.path else base
    return None if path.startswith("..") or "\\" in path else (path, unquote(url.fragment))


def member_fault(info: zipfile.ZipInfo, seen: set[str]) -> str | None:
    """Why an archive member is not acceptable."""
    name = info.filename
    if name in seen:
        return "duplicate"
    if name.startswith("/") or "\\" in name or "\0" in name or ":" in name.split("/")[0] or ".." in name.split("/"):
        return "path"
    if info.file_size > MAX_MEMBER:
        return "size"
    if info.flag_bits & 1:
        return "encrypted"
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return "method"
    if (info.external_attr >> 16) & 0o170000 == 0o120000:
        return "link"
    return None


def members(books: DataFrame) -> DataFrame:
    """``path, ord, name, size, crc, fault``; an archive beyond a bound has one row with the fault ``archive``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                except zipfile.BadZipFile:
                    infos = None
                if infos is None or len(content) > MAX_ARCHIVE or len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_TOTAL:
                    rows.append((path, -1, None, None, None, "archive"))
                    continue
                seen: set[str] = set()
                for no, info in enumerate(infos):
                    rows.append((path, no, info.filename, info.file_size, info.CRC, member_fault(info, seen)))
                    seen.add(info.filename)
            yield pd.DataFrame(rows, columns=["path", "ord", "name", "size", "crc", "fault"])

    return books.select("path", "content").mapInPandas(read, "path string, ord int, name string, size long, crc long, fault string")


def parse_xml(data: bytes) -> ElementTree.Element:
    """XML without entity declarations; names known from HTML are replaced first."""
    from html.entities import name2codepoint

    if re.search(rb"<!ENTITY", data, re.I):
        raise ValueError("entity declarations are not allowed")
    text = re.sub(rb"&(?!amp;|lt;|gt;|quot;|apos;)([A-Za-z]+);", lambda m: b"&#%d;" % name2codepoint[m[1].decode()] if m[1].decode() in name2codepoint else m[0], data)
    return ElementTree.fromstring(text)


def reading_order(archive: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    """``name, media type, kind`` of all documents: those of the spine in its order, then the manifest's others."""
    def local(e: ElementTree.Element) -> str:
        return e.tag.rpartition("}")[2]

    roots = [e.get("full-path") for e in parse_xml(archive.read("META-INF/container.xml")).iter() if local(e) == "rootfile"]
    if len(roots) != 1:
        raise ValueError("exactly one root file is needed")
    package = parse_xml(archive.read(roots[0]))
    if not (package.get("version") or "").startswith(("2.", "3.")):
        raise ValueError("unknown package version")
    items: dict[str, tuple[str, str]] = {}
    for e in package.iter():
        if local(e) == "item":
            target = resolve(roots[0], e.get("href") or "")
            if e.get("id") in items or target is None:
                raise ValueError("manifest ids must be unique and stay inside the archive")
            items[e.get("id")] = (target[0], e.get("media-type") or "")
    spine = [e.get("idref") for e in package.iter() if local(e) == "itemref"]
    order = list(dict.fromkeys([i for i in spine if i in items] + list(items)))
    kinds = {"application/xhtml+xml": "xhtml", "application/x-dtbncx+xml": "ncx"}
    return [(*items[i], kinds[items[i][1]]) for i in order if items[i][1] in kinds]


def decoded_text(data: bytes) -> str:
    """Markup as text: by its byte order mark, its XML declaration or its meta element, else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    stated = re.match(rb"""\s*<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)""", data) or re.search(rb"""<meta[^>]*charset=["']?([A-Za-z0-9._-]+)""", data[:2048], re.I)
    try:
        return data.decode(stated[1].decode() if stated else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def opened(content: bytes) -> zipfile.ZipFile:
    """An archive whose members all pass the guards and whose only encrypted ones are obfuscated fonts; raises otherwise."""
    if len(content) > MAX_ARCHIVE:
        raise ValueError("archive: size")
    archive = zipfile.ZipFile(io.BytesIO(content))
    infos = archive.infolist()
    if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_TOTAL:
        raise ValueError("archive: members")
    seen: set[str] = set()
    for info in infos:
        if fault := member_fault(info, seen):
            raise ValueError(f"member: {fault}")
        seen.add(info.filename)
    if "META-INF/encryption.xml" in seen and any(a not in FONT_ALGORITHMS for _, a in encrypted_entries(archive.read("META-INF/encryption.xml"))):
        raise ValueError("encrypted")
    return archive


def encrypted_entries(data: bytes) -> list[tuple[str, str]]:
    """``name, algorithm`` of each entry of an encryption file."""
    out = []
    for e in parse_xml(data).iter():
        if e.tag.endswith("}EncryptedData") or e.tag == "EncryptedData":
            kind = next((x.get("Algorithm") or "" for x in e.iter() if x.tag.endswith("EncryptionMethod")), "")
            name = next((x.get("URI") or "" for x in e.iter() if x.tag.endswith("CipherReference")), "")
            out.append((name, kind))
    return out


def documents(books: DataFrame) -> DataFrame:
    """``path, doc_ord, name, kind, html, fault``: the documents of each archive in reading order.

    No member is read before the archive has passed the guards. An archive that does not, or that is malformed, is set aside: one row with
    its ``fault`` and nothing else. Sound archives have no fault.
    """
    names = ["path", "doc_ord", "name", "kind", "html", "fault"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    archive = opened(content)
                    rows = [(path, no, name, kind, decoded_text(archive.read(name)), None) for no, (name, _, kind) in enumerate(reading_order(archive))]
                except (ValueError, KeyError, zipfile.BadZipFile, zlib.error, ElementTree.ParseError) as e:
                    rows = [(path, -1, None, None, None, str(e)[:200] or type(e).__name__)]
                yield pd.DataFrame(rows, columns=names)

    return books.select("path", "content").mapInPandas(read, "path string, doc_ord int, name string, kind string, html string, fault string")


class _Slots(HTMLParser):
    """Text runs with their place in the source, their style path and their block."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[tuple[int, int, str, int]] = []
        self.links: list[str] = []
        self.anchors: list[str] = []
        self.open: list[tuple[str, bool, str | None]] = []
        self.block = 0
        starts = [0]
        for line in text.splitlines(keepends=True):
            starts.append(starts[-1] + len(line))
        self._starts = starts
        self._pending: list[int] = []
        self._text = text
        self.feed(text)
        self.close()
        self._flush(len(text))

    def _at(self) -> int:
        line, col = self.getpos()
        return self._starts[line - 1] + col

    def _flush(self, stop: int) -> None:
        if self._pending:
            start = self._pending[0]
            self._pending = []
            if not any(skip for _, skip, _ in self.open) and self._english():
                if re.search("[A-Za-z]", self._text[start:stop]):
                    style = "/".join(t for t, _, _ in self.open if t not in ("html", "body"))
                    self.out.append((start, stop, style, self.block))

    def _english(self) -> bool:
        lang = next((x for _, _, x in reversed(self.open) if x), None)
        return not lang or bool(re.fullmatch("en(?:[-_].*)?", lang.strip(), re.I))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush(self._at())
        own = dict(attrs)
        if tag in BLOCKS:
            self.block += 1
        if tag == "a" and own.get("href"):
            self.links.append(own["href"])
        self.anchors += [own[k] for k in ("id", "name") if own.get(k)]
        if tag not in VOID:
            hidden = tag in SKIPPED or (own.get("translate") or "").lower() == "no" or "notranslate" in (own.get("class") or "").split()
            if tag == "p":
                self._close("p")
            self.open.append((tag, hidden, own.get("xml:lang") or own.get("lang")))

    def _close(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_endtag(self, tag: str) -> None:
        self._flush(self._at())
        if tag in BLOCKS:
            self.block += 1
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self._pending = self._pending or [self._at()]

    def handle_entityref(self, name: str) -> None:
        self.handle_data(name)

    def handle_charref(self, name: str) -> None:
        self.handle_data(name)

    def handle_comment(self, data: str) -> None:
        self._flush(self._at())

    def handle_decl(self, decl: str) -> None:
        self._flush(self._at())

    def handle_pi(self, data: str) -> None:
        self._flush(self._at())


def slots(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, run_ord, start, stop, style, block, text``: the readable text runs of markup, with places in the source."""

    @F.pandas_udf("array<struct<start:int,stop:int,style:string,block:int,text:string>>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "stop": b, "style": s, "block": k, "text": t[a:b]} for a, b, s, k in _Slots(t).out] if t else [])

    return pages.select(key, F.posexplode(read(html)).alias("run_ord", "r")).select(key, "run_ord", "r.*")


def rendered(pages: DataFrame, targets: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, html``: each run replaced by its target (``key, run_ord, target``); a page with a run missing keeps null."""
    runs = slots(pages, key, html)
    own = runs.join(targets, [key, "run_ord"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("run_ord", "start", "stop", "target"))).alias("runs"))

    @F.pandas_udf("string")
    def put(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, runs):
            if text is None or own is not None and any(r["target"] is None for r in own):
                out.append(None)
                continue
            parts, at = [], 0
            for r in own if own is not None else ():
                parts += [text[at : r["start"]], r["target"]]
                at = r["stop"]
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    return pages.join(own, key, "left").select(key, put(F.col(html), F.col("runs")).alias("html"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """``key, href`` of all links and ``key, anchor`` of all named places."""

    @F.pandas_udf("struct<links:array<string>,anchors:array<string>>")
    def read(texts: pd.Series) -> pd.DataFrame:
        seen = [_Slots(t or "") for t in texts]
        return pd.DataFrame({"links": [s.links for s in seen], "anchors": [s.anchors for s in seen]})

    got = pages.select(key, read(html).alias("r"))
    return got.select(key, F.explode("r.links").alias("href")), got.select(key, F.explode("r.anchors").alias("anchor"))


def broken_links(refs: DataFrame, entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct sorted ``base, href`` whose ``target`` is no entry (``name``) or whose ``fragment`` no anchor (``name, anchor``)."""
    no_entry = refs.join(entries.select(F.col("name").alias("target")).distinct(), "target", "left_anti")
    named = refs.where("coalesce(fragment, '') <> ''").join(entries.select(F.col("name").alias("target")).distinct(), "target", "left_semi")
    no_anchor = named.join(anchors.select(F.col("name").alias("target"), F.col("anchor").alias("fragment")).distinct(), ["target", "fragment"], "left_anti")
    return no_entry.select("base", "href").union(no_anchor.select("base", "href")).distinct().orderBy("base", "href")


def block_texts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, block_ord, text``: titles, paragraphs and headings by pattern, tags stripped, blanks collapsed."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:title|p|h[1-3])(?:\s[^>]*)?>(.*?)</(?:title|p|h[1-3])>"), 1)
    opened = pages.select(key, F.posexplode(found).alias("block_ord", "text"))
    return opened.select(key, "block_ord", F.trim(F.regexp_replace(F.regexp_replace("text", "<[^>]+>", ""), r"\s+", " ")).alias("text")).where("text <> ''")


def encryption_faults(entries: DataFrame) -> DataFrame:
    """Encrypted entries (``name, algorithm``) other than obfuscated fonts."""
    return entries.where(~F.coalesce(F.col("algorithm").isin(*FONT_ALGORITHMS), F.lit(False)))


def write_archive(original: bytes, changed: dict[str, bytes]) -> bytes:
    """The archive with some members replaced: the type entry first and stored, all others in their order."""
    source = zipfile.ZipFile(io.BytesIO(original))
    if not set(changed) <= set(source.namelist()):
        raise ValueError("only members that exist can be replaced")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as target:
        for info in sorted(source.infolist(), key=lambda i: i.filename != "mimetype"):
            kind = zipfile.ZIP_STORED if info.filename == "mimetype" else info.compress_type
            target.writestr(zipfile.ZipInfo(info.filename, info.date_time), changed.get(info.filename, source.read(info.filename)), kind)
    return out.getvalue()


def archive_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """``name, change`` between two member tables (``name, crc``): missing, extra or changed."""
    both = before.select("name", F.col("crc").alias("a")).join(after.select("name", F.col("crc").alias("b")), "name", "full_outer")
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return both.select("name", change.alias("change")).where("change is not null")


def written_faults(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """``path, name, fault`` of written archives against their sources (tables of ``members`` and, for ``changed``, of ``path, name``).

    ``mimetype`` if that entry is not the first; ``missing`` and ``extra`` members; ``touched`` where a member differs that no one changed.
    """
    a, b = (df.where("fault is null").select("path", "name", F.col("crc").alias(c), F.col("ord").alias(f"{c}_ord")) for df, c in ((before, "a"), (after, "b")))
    both = a.join(b, ["path", "name"], "full_outer").join(changed.select("path", "name", F.lit(True).alias("asked")).distinct(), ["path", "name"], "left")
    fault = (
        F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra")
        .when((F.col("name") == "mimetype") & (F.col("b_ord") != 0), "mimetype")
        .when((F.col("a") != F.col("b")) & F.col("asked").isNull(), "touched")
    )
    broken = after.where("fault is not null").select("path", "name", "fault")
    return both.select("path", "name", fault.alias("fault")).where("fault is not null").unionByName(broken)


def skeleton_faults(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("path", "name"), html: str = "html") -> DataFrame:
    """Keys of documents whose markup without its texts is not the same on both sides, or that only one side has."""
    def bare(df: DataFrame, name: str) -> DataFrame:
        tags = F.array_join(F.regexp_extract_all(F.col(html), F.lit("(<[^>]*>)"), 1), "")
        return df.select(*keys, F.sha2(tags, 256).alias(name))

    met = bare(before, "_a").join(bare(after, "_b"), list(keys), "full_outer")
    return met.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)
