import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loomspan.sources import archive_format, files, strict

HTML = (
    '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="en"><head><title>T &amp; U</title><style>p{}</style></head>\n'
    "<body><p>It was a <b>novel</b> poison&nbsp;&mdash; é🙂 more.</p><!-- c --><p translate=\"no\">Not this</p><p xml:lang=\"fr\">Ni cela</p><svg xmlns=\"s\"><text>x</text></svg><p>a<![CDATA[ < raw]]>b<br/>end</p></body></html>"
)


def test_runs_by_node():
    runs = strict.runs_of(HTML)
    assert [(r.text, r.style) for r in runs] == [("T & U", "head/title"), ("It was a ", "p"), ("novel", "p/b"), (" poison — é🙂 more.", "p"), ("a", "p"), (" < raw", "p"), ("b", "p"), ("end", "p")]
    data = HTML.encode()
    assert data[runs[0].start : runs[0].stop] == b"T &amp; U" and data[runs[3].start : runs[3].stop].decode() == " poison&nbsp;&mdash; é🙂 more."
    assert len({r.block for r in runs[1:4]}) == 1 and runs[4].block > runs[1].block
    assert [r.node for r in runs] == sorted({r.node for r in runs})


def test_only_named_nodes_change(monkeypatch):
    runs = strict.runs_of(HTML)
    assert strict.replaced(HTML, {}) == HTML
    out = strict.replaced(HTML, {runs[2].node: "a<b> & c", runs[7].node: "fin"})
    assert out == HTML.replace("<b>novel</b>", "<b>a&lt;b&gt; &amp; c</b>").replace("<br/>end", "<br/>fin")
    again = strict.runs_of(out)
    assert [r.node for r in again if r.node != runs[7].node] == [r.node for r in runs if r.node != runs[7].node] and again[2].text == "a<b> & c"
    for piece in (1, 3, 7):  # the pieces do not matter
        monkeypatch.setattr(strict, "PIECE", piece)
        assert strict.runs_of(HTML) == runs


def test_generated_documents_round_trip():
    rng = random.Random(5)

    def grown(depth):
        out = []
        for _ in range(rng.randint(0, 4)):
            out.append(rng.choice(["word ", "é&amp;", "&nbsp;x", "<br/>", "<!--n-->", "🙂", "\n"]))
            if depth:
                tag = rng.choice(["p", "i", "div", "code"])
                out.append(f"<{tag}>{grown(depth - 1)}</{tag}>")
        return "".join(out)

    for _ in range(200):
        html = f"<html>{grown(4)}</html>"
        runs = strict.runs_of(html)
        same = {r.node: r.text for r in runs}
        # what is put back is the same text, so the same runs are read again
        assert [(r.node, r.text, r.style) for r in strict.runs_of(strict.replaced(html, same))] == [(r.node, r.text, r.style) for r in runs]
        for r in runs[:3]:
            out = strict.replaced(html, {r.node: "ZZ"})
            data = html.encode()
            assert out.encode() == data[: r.start] + b"ZZ" + data[r.stop :]


@pytest.mark.parametrize("html, reason, line", [
    ("<p>a\n<b>x</p>", "mismatched tag", 2), ("<p>a", "no element found", 1), ("<!DOCTYPE p [<!ENTITY e 'x'>]><p>&e;</p>", "declarations are not allowed", 1),
    ("<p>\n\n&nope;</p>", "unknown entity nope", 3), ("<p a='1' a='2'/>", "duplicate attribute", 1), ("plain", "syntax error", 1),
])
def test_refused(html, reason, line):
    with pytest.raises(strict.Refused) as e:
        strict.runs_of(html)
    assert (e.value.reason, e.value.line) == (reason, line)


def test_rendering_of_tables(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "<p>open"), (5, "<p>one</p>"), (6, "<p>two</p>"), (7, "<p>three</p>")], "page_id long, html string")
    slots = strict.node_slots(pages)
    assert [(r["page_id"], r["fault"], r["line"]) for r in slots.where("fault is not null").collect()] == [(4, "no element found", 1)]
    node = slots.where("page_id = 5").first()["node"]
    targets = slots.where("page_id = 1 and fault is null").select("page_id", "node", F.concat(F.lit("«"), "text", F.lit("»")).alias("target"))
    more = spark.createDataFrame([(4, 0, "x"), (5, node, None), (6, 99, "x"), (7, node, "x"), (7, node, "y")], "page_id long, node long, target string")
    got = {r["page_id"]: (r["html"], r["fault"]) for r in strict.rendered_by_node(pages, targets.union(more)).collect()}
    assert got[2] == (None, None) and got[3] == ("", None)
    assert {k: got[k] for k in (4, 5, 6, 7)} == {4: (None, "line 1: no element found"), 5: (None, "target missing"), 6: (None, "no such node"), 7: (None, "node given twice")}
    assert [r.text for r in strict.runs_of(got[1][0])][:2] == ["«T & U»", "«It was a »"]


MEMBERS = [("mimetype", b"application/epub+zip"), ("META-INF/container.xml", b"<c/>"), ("a.xhtml", b"<p>A</p>" * 50), ("img/x.png", bytes(range(256)))]


def rows_of(*names):
    return [(name, no, member, content) for name in names for no, (member, content) in enumerate(reversed(MEMBERS))]


def test_archives_written_and_read_back(spark, tmp_path):
    members = spark.createDataFrame(rows_of("one.epub", "two.epub", "three.epub"), "path string, ord int, name string, content binary")
    folder = str(tmp_path / "books")
    archive_format.write_archives(members, folder)
    assert sorted(p.name for p in (tmp_path / "books").iterdir()) == ["one.epub", "three.epub", "two.epub"]
    first = zipfile.ZipFile(tmp_path / "books" / "one.epub").infolist()[0]
    assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED
    read = spark.read.format(archive_format.NAME).load(folder)
    got = {(r["path"], r["name"]): bytes(r["content"]) for r in read.collect()}
    assert got == {(p, n): bytes(c) for p, _, n, c in rows_of("one.epub", "two.epub", "three.epub")}
    assert read.where("fault is not null").count() == 0
    names = spark.read.format(archive_format.NAME).option("columns", "path,name,size").load(folder)
    assert names.columns == ["path", "name", "size"] and names.where("size = 256").count() == 3
    # existing archives are never replaced, and a failed commit leaves nothing behind
    before = (tmp_path / "books" / "one.epub").read_bytes()
    with pytest.raises(Exception, match="never replaced"):
        archive_format.write_archives(members.where("path = 'one.epub'").withColumn("content", F.lit(b"x")), folder)
    assert (tmp_path / "books" / "one.epub").read_bytes() == before and len(list((tmp_path / "books").iterdir())) == 3


def test_aborted_write_leaves_nothing(spark, tmp_path):
    rows = rows_of("one.epub", "two.epub") + [("up/three.epub", 0, "mimetype", b"x")]
    with pytest.raises(Exception, match="no name of an archive"):
        archive_format.write_archives(spark.createDataFrame(rows, "path string, ord int, name string, content binary"), str(tmp_path / "books"))
    assert not (tmp_path / "books").exists() or list((tmp_path / "books").iterdir()) == []


def test_bad_archives_are_set_aside(spark, tmp_path, monkeypatch):
    archive_format.register(spark)
    assert spark.read.format(archive_format.NAME).load(str(tmp_path / "none")).count() == 0
    archive_format.write_archives(spark.createDataFrame(rows_of("good.epub"), "path string, ord int, name string, content binary"), str(tmp_path))
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    (tmp_path / ".staged-1-late.epub").write_bytes(b"half")
    with zipfile.ZipFile(tmp_path / "up.epub", "w") as z:
        z.writestr("../up", "x")
    read = spark.read.format(archive_format.NAME).load(str(tmp_path))
    faults = {r["path"]: r["fault"] for r in read.where("fault is not null").collect()}
    assert set(faults) == {"bad.epub", "up.epub"} and faults["up.epub"] == "member: path"
    assert read.where("fault is null").count() == len(MEMBERS)
    monkeypatch.setattr(archive_format, "PARTITION_BYTES", 1)
    source = archive_format.ArchiveReader(str(tmp_path), read.schema)
    assert [len(p.files) for p in source.partitions()] == [1, 1, 1]


def test_failure_lines_of_all_versions(spark, tmp_path):
    fresh = spark.createDataFrame([(1.5, "j", "error", "e" * 400, [str(i) for i in range(9)], '{"kind": "no", "title": "no", "n": {"a": [1, null]}}'), (2.0, None, "x", None, None, None), (3.0, "j", "y", "", [], "[1]")], "ts double, job string, kind string, error string, sample_ids array<string>, e string")
    path = str(tmp_path / "log")
    files.append_failures(fresh.withColumn("extra", F.try_parse_json("e")).drop("e"), path, "extra")
    files.append_failures(fresh.limit(1).drop("e"), path)
    (tmp_path / "log" / "old.txt").write_text('{"ts": "late", "kind": "old", "units": 3, "by": "v0"}\nbroken\n[1]\n\n{}\n')
    rows = files.read_failures(spark.read.text(path)).withColumn("extra", F.to_json("extra")).collect()
    got = sorted((r["kind"] or "", r["extra"], len(r["error"] or ""), len(r["sample_ids"] or ()), r["title"]) for r in rows)
    # extras never take the place of an event's key, not even of one that this log does not write
    assert got == [("", "{}", 0, 0, None), ("error", '{"n":{"a":[1,null]}}', 300, 5, None), ("error", "{}", 300, 5, None), ("old", '{"by":"v0"}', 0, 0, None), ("x", "{}", 0, 0, None), ("y", "{}", 0, 0, None)]
    old = next(r for r in rows if r["kind"] == "old")
    assert old["ts"] is None and old["units"] == 3
    (tmp_path / "m.json").write_text('{"book_id": "b", "title": "T", "odd": {"x": 1}}')
    (tmp_path / "n.json").write_text("{broken")
    kept = files.memory_extras(spark, str(tmp_path / "*.json")).select("book_id", F.to_json("extra")).collect()
    assert [tuple(r) for r in kept] == [("b", '{"odd":{"x":1}}')]


def test_discovery_text_is_cut_at_an_empty_line(spark):
    from loomspan.operators import review

    texts = [(1, " a \n\n\n\n b\n\nccc\n\ndd"), (2, "x" * 30), (3, ""), (4, None), (5, "a\n\n" + "b" * 30)]
    got = {r["chapter"]: r["paragraphs"] for r in review.discovery_text(spark.createDataFrame(texts, "chapter long, text string"), most=15).collect()}
    assert got[1] == "[P1] a\n\n[P2] b" and got[2] == "[P1] " + "x" * 15 and not got[3] and not got[4] and got[5] == "[P1] a"
