import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomspan.operators import glossary as g

FIELDS = "ord long, term string, translation string, approved boolean, status string, source_chapter int"


def terms(spark, *rows):
    return spark.createDataFrame([(i, t, x, *rest, *[True, "verified", None][len(rest) :]) for i, (t, x, *rest) in enumerate(rows)], FIELDS)


def names(df):
    return sorted(r["term"] for r in df.collect())


def test_conflicts_of_each_kind(spark):
    df = terms(spark, ("Nobility", "bangsawan"), ("nobility ", "bangsawan"), ("Frontier", "a"), ("Northern Frontier", "b"), ("bead", "manik"), ("Bead", "butiran"))
    assert sorted(tuple(r) for r in g.conflicts(df).collect()) == [("duplicate", "Nobility", "nobility "), ("overlap", "Frontier", "Northern Frontier"), ("translation_mismatch", "bead", "Bead")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a b", "b", "A", "b c", "a b c", "c-a", " b", "", "é b"]), st.sampled_from(["x", "y"])), max_size=9))
def test_conflicts_like_all_pairs(spark, rows):
    want, seen = [], {}
    for t, x in rows:
        key = " ".join(t.split()).lower()
        if not key:
            continue
        if key in seen:
            want.append(("duplicate" if seen[key][1] == x else "translation_mismatch", seen[key][0], t))
        else:
            seen[key] = (t, x)
    keys = list(seen)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            short, long = sorted((a, b), key=len)
            if re.search(r"(?<!\w)" + re.escape(short) + r"(?!\w)", long):
                want.append(("overlap", seen[a][0], seen[b][0]))
    assert sorted(tuple(r) for r in g.conflicts(terms(spark, *rows)).collect()) == sorted(want)


def test_difference(spark):
    old = terms(spark, ("Nobility", "n"), ("bead", "manik"), ("gone", "x"), ("flag", "f", False))
    new = terms(spark, ("Nobility", " N "), ("bead", "manik-manik"), ("Hunter", "h"), ("flag", "f", True))
    assert sorted((r["change"], r["term"]) for r in g.difference(old, new).collect()) == [("added", "Hunter"), ("changed", "bead"), ("changed", "flag"), ("removed", "gone")]


def test_as_of_sees_no_later_term(spark):
    df = terms(spark, ("Manual", "m"), ("Wu-Lin", "w", True, "verified", 1), ("Frontier", "f", True, "verified", 2))
    chapters = spark.createDataFrame([(1,), (2,), (3,)], "chapter int")
    got = {}
    for r in g.as_of(chapters, df).collect():
        got.setdefault(r["chapter"], set()).add(r["term"])
    assert got == {1: {"Manual"}, 2: {"Manual", "Wu-Lin"}, 3: {"Manual", "Wu-Lin", "Frontier"}}


def test_visibility_and_pending(spark):
    df = terms(spark, ("A", "a", True, "verified", 1), ("B", "b", True, "verified", 5), ("C", "c"), ("D", "d", False, "provisional", 1))
    assert names(g.visible(df, 2)) == ["A", "C", "D"] and names(g.visible(df)) == ["A", "C", "D"] and len(names(g.visible(df, show_all=True))) == 4
    assert names(g.pending(df, spark.createDataFrame([], "key string"))) == ["D"]
    assert [r["line"] for r in g.spoiler_safe_export(df, 2).orderBy("ord").collect()] == ["A = a", "C = c"]


def test_parse_lines(spark):
    rows = [(1, "# c"), (2, ""), (3, " a = b "), (4, "c => d = e"), (5, "no mark"), (6, "= x"), (7, "a = z")]
    got = g.parse_lines(spark.createDataFrame(rows, "line_no long, value string")).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == [(3, "a", "b", None), (4, "c", "d = e", None), (5, None, None, "form"), (6, "", "x", "empty"), (7, "a", "z", "duplicate")]


def test_notes(spark):
    rows = [(0, "x", [], "", "", "", ""), (1, "y", ["Y1"], "Sir", "", "", "odd"), (2, "z", [], "", "", "", "chapter 3")]
    notes = spark.createDataFrame(rows, "ord long, name string, aliases array<string>, title string, relationships string, register_note string, known_from string")
    assert sorted((r["name"], r["warning"]) for r in g.notes_for_chapter(notes, 2).collect()) == [("x", False), ("y", True)]
    assert g.notes_for_chapter(notes, None).count() == 3
    assert g.character_block(notes, "Notes:").first()["block"] == "Notes:\n- x\n- y; alias: Y1; title: Sir\n- z"
    assert len(g.character_block(notes, "Notes:", most=20).first()["block"]) <= 20 + len("\n…(cut)")
    assert g.character_block(notes.limit(0), "Notes:").first()["block"] == ""


def test_merges_and_review(spark):
    auto, manual = terms(spark, ("Toto", "t"), ("Wu-Lin", "w")), terms(spark, ("toto", "manual"))
    assert names(g.manual_wins(auto, manual)) == ["Wu-Lin", "toto"]
    full = auto.selectExpr("*", "'fix' as suggested_fix", "cast(null as array<struct<translation:string,approved:boolean,status:string,at:string,by:string>>) as history")
    got = {r["term"]: r for r in g.reviewed(full, spark.createDataFrame([("Toto", "suggest"), ("Wu-Lin", "reject")], "term string, action string"), "now").collect()}
    assert got["Toto"]["translation"] == "fix" and got["Toto"]["history"][0]["translation"] == "t" and not got["Wu-Lin"]["approved"] and got["Wu-Lin"]["status"] == "rejected"
    assert g.fingerprint(auto).first() == g.fingerprint(auto.orderBy("term", ascending=False)).first() != g.fingerprint(manual).first()


@pytest.mark.parametrize("make", [g.conflicts, g.usable, g.fingerprint, lambda d: g.difference(d, d)])
def test_empty(spark, make):
    make(spark.createDataFrame([], FIELDS)).collect()


def test_keys_with_one_first_word_form_no_pairs(spark):
    import re
    import time

    words = ["the", "lord", "old", "c++", "c", "x-ray", "ray", "naïve", "d.e"]
    terms = [(i, f"{a} {b}".strip(), f"t{i}") for i, (a, b) in enumerate((a, b) for a in words for b in [*words, ""])]
    got = {(r["term_a"], r["term_b"]) for r in g.conflicts(spark.createDataFrame(terms, "ord long, term string, translation string")).where("kind = 'overlap'").collect()}
    want = set()
    for i, s, _ in terms:
        for j, l, _ in terms:
            if s != l and len(s) <= len(l) and re.search(rf"(?<!\w){re.escape(s)}(?!\w)", l):
                want.add((s, l) if i < j else (l, s))
    assert got == want
    many = spark.range(4_000).selectExpr("id as ord", "concat('the lord ', id) as term", "concat('t', id) as translation")
    began = time.time()
    assert g.conflicts(many).count() == 0
    assert time.time() - began < 30  # pairs of all keys would take minutes
