import io
import random
import zipfile

import pytest

from pyspark.sql import functions as F

from loomspan.operators import units as u
from loomspan.sources import books, files


def cut_by_hand(text, limit):
    out = []
    while len(text) > limit:
        blanks = [k for k in range(limit + 1) if text[k] in " \n" and k >= limit // 3]
        n = blanks[-1] + 1 if blanks else limit
        out.append(text[:n])
        text = text[n:]
    return out + [text] * bool(text)


def test_cut_loses_nothing(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab🙂é \n\r", [5, 5, 1, 1, blanks, 1, 0.2], k=rng.randint(0, 300))) for blanks in (0.1, 1, 4) for _ in range(60)] + [None, "", " ", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for limit in (3, 17, 40):
        got = {i: [] for i in range(len(texts))}
        for r in u.exact_parts(df, limit=limit).orderBy("id", "part_ord").collect():
            got[r["id"]].append(r["part"])
        assert got == {i: cut_by_hand(t or "", limit) for i, t in enumerate(texts)}


def test_affixes_and_groups(spark):
    got = u.affixes(spark.createDataFrame([("  a\nb \n",), ("",), (" ",)], "text string")).collect()
    assert [(r["prefix"], r["core"], r["suffix"]) for r in got][0] == ("  ", "a\nb", " \n") and all(r["prefix"] + r["core"] + r["suffix"] == r["text"] for r in got)
    runs = spark.createDataFrame([(0, i, "x" * n) for i, n in enumerate([1000, 1000, 1000, 2500, 1])] + [(1, i, "y") for i in range(41)], "block long, run_ord long, text string")
    rows = u.grouped_units(runs).orderBy("block", "run_ord").collect()
    assert [r["unit_no"] for r in rows][:5] == [0, 0, 1, 2, 3] and rows[-1]["unit_no"] == 1


def test_chapter_numbers_may_skip(spark):
    docs = spark.createDataFrame([(1, "a", "en", "b"), (2, "", "en", "b"), (3, "c", "en", "b")], "doc_id long, text string, lang string, source string")
    assert sorted(r["chapter"] for r in u.chapters(docs).collect()) == [1, 3]


def test_prefix_sums(spark, monkeypatch):
    from loomspan.operators import ranges

    rows = [("abc"[i % 3], (i * 37) % 101, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k int, v long")
    for n in (1, 7, 50):
        monkeypatch.setattr(ranges, "range_count", lambda _: n)
        got = sorted(tuple(r) for r in ranges.prefix_sums(df, [F.col("g"), F.col("k"), F.col("v")], {"v": "before"}, ["g"]).select("g", "k", "v", "before").collect())
        assert got == [(g, k, v, sum(x for h, j, x in rows if h == g and (j, x) < (k, v))) for g, k, v in sorted(rows)]


def test_numbers_across_ranges(spark):
    docs = spark.createDataFrame([(i // 2, f"t{i % 5}\nu{i % 3}", "en", [None, "", "b"][i % 3]) for i in range(60)] + [(None, "z", "en", "b")], "doc_id long, text string, lang string, source string")
    want = {}
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"])):
        want.setdefault(r["source"], []).append((r["doc_id"], r["text"]))
    got = {}
    for r in u.chapters(docs).orderBy("chapter").collect():
        got.setdefault(r["book"], []).append((r["doc_id"], r["text"]))
        assert r["chapter"] == len(got[r["book"]])
    assert got == want
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    seen, last = {}, {}
    rows = {(r["source"], r["doc_id"], r["unit_ord"]): r for r in u.first_marks(u.units(named)).collect()}
    for key in sorted(rows, key=lambda k: (str(k[0]), k[1], k[2])):
        r, own = rows[key], seen.setdefault(key[0], {})
        assert r["context_no"] == own.setdefault(r["text"], len(own)) and r["names_document"] == (last.get(key[0]) != key[1])
        last[key[0]] = key[1]


HTML = '<html lang="en"><head><title>T</title><style>p{}</style></head><body><p>It was a <b>novel</b> poison &amp; more.</p><p translate="no">Not this</p><p lang="fr">Ni cela</p><p><a href="x.html#n">link</a> after<p>open'


def test_slots_and_render(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id long, html string")
    got = books.slots(pages).orderBy("run_ord").collect()
    assert [(r["text"], r["style"]) for r in got] == [("T", "head/title"), ("It was a ", "p"), ("novel", "p/b"), (" poison &amp; more.", "p"), ("link", "p/a"), (" after", "p"), ("open", "p")]
    same = books.rendered(pages, books.slots(pages).selectExpr("page_id", "run_ord", "text as target"))
    assert {r["page_id"]: r["html"] for r in same.collect()} == {1: HTML, 2: None, 3: ""}
    short = books.rendered(pages, books.slots(pages).where("run_ord > 0").selectExpr("page_id", "run_ord", "text as target"))
    assert short.where("page_id = 1").first()["html"] is None
    hrefs, anchors = books.links(pages)
    assert hrefs.first()["href"] == "x.html#n" and anchors.count() == 0


def archive(extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", '<package xmlns="o" version="3.0"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/a.xhtml", "<p>A</p>")
        z.writestr("OEBPS/b.xhtml", "<p>B</p>")
        for name in extra:
            z.writestr(name, "x")
    return out.getvalue()


def test_archive_scan_and_write(spark, tmp_path):
    (tmp_path / "one.epub").write_bytes(archive())
    (tmp_path / "two.epub").write_bytes(archive(["../up", "c:/x"]))
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    found = books.archives(spark, str(tmp_path))
    faults = {r["name"]: r["fault"] for r in books.members(found).where("fault is not null").collect()}
    assert faults == {"../up": "path", "c:/x": "path", None: "archive"}
    docs = books.documents(found.where("path like '%one.epub'")).orderBy("doc_ord").collect()
    assert [r["name"] for r in docs] == ["OEBPS/b.xhtml", "OEBPS/a.xhtml"]
    changed = books.write_archive(archive(), {"OEBPS/a.xhtml": b"<p>Z</p>"})
    (tmp_path / "three.epub").write_bytes(changed)
    assert zipfile.ZipFile(io.BytesIO(changed)).infolist()[0].filename == "mimetype"
    members = books.members(books.archives(spark, str(tmp_path)))
    diff = books.archive_differences(members.where("path like '%one.epub'"), members.where("path like '%three.epub'")).collect()
    assert [tuple(r) for r in diff] == [("OEBPS/a.xhtml", "changed")]
    with pytest.raises(ValueError):
        books.parse_xml(b'<!DOCTYPE x [<!ENTITY a "b">]><x/>')


@pytest.mark.parametrize("base, href, want", [("a/b.html", "c.html#x%20y", ("a/c.html", "x y")), ("a/b.html", "#n", ("a/b.html", "n")), ("b.html", "../x", None), ("b.html", "http://x", None), ("b.html", "/x", None)])
def test_resolve(base, href, want):
    assert books.resolve(base, href) == want


def test_broken_links(spark):
    refs = spark.createDataFrame([("a", "b#1", "b", "1"), ("a", "b#2", "b", "2"), ("a", "c", "c", ""), ("a", "c", "c", "")], "base string, href string, target string, fragment string")
    got = books.broken_links(refs, spark.createDataFrame([("b",)], "name string"), spark.createDataFrame([("b", "1")], "name string, anchor string"))
    assert [tuple(r) for r in got.collect()] == [("a", "b#2"), ("a", "c")]


def test_files(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# c\na = b\n\nc => d\n")
    assert [(r["line_no"], r["term"]) for r in files.glossary_text(spark, str(tmp_path / "g.txt")).orderBy("line_no").collect()] == [(2, "a"), (4, "c")]
    (tmp_path / "g.json").write_text('{"terms": [{"term": "x", "translation": "y"}]}')
    assert [tuple(r) for r in files.glossary_json(spark, str(tmp_path / "g.json")).collect()] == [(0, "x", "y")]
    (tmp_path / "m1.json").write_text('{"book_id": "bm_1", "title": "T", "odd": 1, "terms": [{"term": "x", "translation": "y", "approved": true}]}')
    (tmp_path / "m2.json").write_text("{broken")
    (tmp_path / "m3.json").write_text('{"book_id": "bm_0"}')
    memory = files.book_memory(spark, str(tmp_path / "m*.json"))
    assert [(r["book_id"], r["n_terms"]) for r in files.catalog(memory).collect()] == [("bm_0", 0), ("bm_1", 1)]
    assert files.terms_of(memory).first()["term"] == "x"
    files.write_glossary(spark.createDataFrame([(1, "b", "y"), (0, "a", "x")], "ord long, term string, translation string"), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a = x", "b = y"]
    assert files.report(spark.range(1).selectExpr("1 as b", "cast(null as int) as a")).first()[0] == '{"a":null,"b":1}'


def test_progress(spark):
    runs = spark.createDataFrame([("one two", True), ("three", False)], "text string, done boolean")
    row = u.outlook(u.progress(runs), 1, 60.0, 1000, remaining_quota=0).first()
    assert (row["total_words"], row["done_words"], row["requests_remaining"], row["quota_short"]) == (3, 2, 1, True)
    assert u.progress(runs.limit(0)).first()["total_chars"] == 0
    assert F is not None


def test_bad_books_are_set_aside(spark, tmp_path):
    locked = io.BytesIO()
    with zipfile.ZipFile(locked, "w") as z:
        z.writestr("META-INF/encryption.xml", '<encryption xmlns="e"><EncryptedData><EncryptionMethod Algorithm="urn:secret"/><CipherData><CipherReference URI="a.xhtml"/></CipherData></EncryptedData></encryption>')
    (tmp_path / "one.epub").write_bytes(archive())
    (tmp_path / "two.epub").write_bytes(archive(["../up"]))
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    (tmp_path / "none.epub").write_bytes(archive()[:200])
    (tmp_path / "locked.epub").write_bytes(locked.getvalue())
    rows = books.documents(books.archives(spark, str(tmp_path))).collect()
    faults = {r["path"].rsplit("/", 1)[1]: r["fault"] for r in rows if r["fault"]}
    assert set(faults) == {"two.epub", "bad.epub", "none.epub", "locked.epub"} and faults["two.epub"] == "member: path" and faults["locked.epub"] == "encrypted"
    assert sum(r["fault"] is None for r in rows) == 2


def test_text_by_its_stated_encoding():
    assert books.decoded_text("é".encode("utf-16")) == "é" and books.decoded_text(b"\xef\xbb\xbfa") == "a"
    assert books.decoded_text(b'<?xml version="1.0" encoding="iso-8859-1"?><p>\xe9</p>').endswith("<p>é</p>")
    assert books.decoded_text(b'<html><meta charset="latin-1"><p>\xe9').endswith("é") and books.decoded_text(b'<meta charset="nope">\xc3\xa9').endswith("é")
    assert books.encrypted_entries(b'<e><EncryptedData><EncryptionMethod Algorithm="x"/><CipherReference URI="f"/></EncryptedData></e>') == [("f", "x")]


def test_written_archives_are_verified(spark, tmp_path):
    one = archive()
    good = books.write_archive(one, {"OEBPS/a.xhtml": b"<p>Z</p>"})
    bad = books.write_archive(one, {"OEBPS/a.xhtml": b"<p><b>Z</b></p>", "OEBPS/b.xhtml": b"<p>Y</p>"})
    for folder, data in (("s", one), ("g", good), ("b", bad)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.epub").write_bytes(data)
    read = {k: books.archives(spark, str(tmp_path / k)).withColumn("path", F.lit("x")) for k in "sgb"}
    asked = spark.createDataFrame([("x", "OEBPS/a.xhtml")], "path string, name string")
    source = books.members(read["s"])
    assert books.written_faults(source, books.members(read["g"]), asked).count() == 0
    assert [tuple(r) for r in books.written_faults(source, books.members(read["b"]), asked).collect()] == [("x", "OEBPS/b.xhtml", "touched")]
    docs = {k: books.documents(df) for k, df in read.items()}
    assert books.skeleton_faults(docs["s"], docs["g"]).count() == 0
    assert [tuple(r) for r in books.skeleton_faults(docs["s"], docs["b"]).collect()] == [("x", "OEBPS/a.xhtml")]


def test_context_of_slots(spark):
    long = "x " * 2000 + "the slot text" + " y" * 2000
    slots = spark.createDataFrame([(1, "the  slot text"), (2, "same text"), (3, "alone")], "owner long, text string")
    owners = spark.createDataFrame([(1, long), (2, " same\n text ")], "owner long, owner_text string")
    got = {r["owner"]: r["context"] for r in u.with_context(slots, owners).collect()}
    assert len(got[1]) == 5000 - (5000 - min(5000, len(got[1]))) and "the slot text" in got[1] and got[2] is None and got[3] is None


def test_settings_files_and_numbers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"model": "m", "rpm": 5}')
    (tmp_path / "q.json").write_text("[1]")
    got = [r["settings"] for r in files.preferences(spark, str(tmp_path)).collect()]
    assert sorted(map(len, got)) == [0, 2] and {"model": "m", "rpm": "5"} in got
    lines = files.numbered(spark.createDataFrame([(k * 7 % 31,) for k in range(31)], "k int"), "k")
    assert all(r["ord"] == r["k"] for r in lines.collect())
    from loomspan.functions import text as T

    row = spark.createDataFrame([(1234567, 999, 1500, 90.0)], "a long, b long, c long, d double").select(T.grouped_number("a"), T.compact_number("b"), T.compact_number("c"), T.compact_number(F.lit(2000)), T.minutes_text("d"), T.grouped_number(F.lit(None).cast("long"))).first()
    assert tuple(row) == ("1,234,567", "999", "1.5K", "2K", "1.5", "—")
