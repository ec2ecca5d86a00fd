import random
import re

from loomspan.operators import matching as m

TERMS = "ord long, term string, translation string"


def test_word_borders(spark):
    units = spark.createDataFrame([("1", "the Vampire\n Hunter D"), ("2", "the Hunters asked"), ("3", "a Noble's blade"), ("4", "the Nobility"), ("5", "D.A. (x) é"), ("6", None)], "unit_id string, text string")
    terms = spark.createDataFrame([(0, "Vampire  Hunter", "x"), (1, "hunter", "x"), (2, "Noble", "x"), (3, "D.A.", "x"), (4, "(x)", "x"), (5, "***", "x"), (6, "É", "x")], TERMS)
    want = set()
    for u in units.collect():
        for t in terms.collect():
            if re.search(r"(?<!\w)" + r"\s+".join(map(re.escape, t["term"].split())) + r"(?!\w)", u["text"] or "", re.I):
                want.add((u["unit_id"], t["term"]))
    assert {tuple(r) for r in m.matches(units, terms).collect()} == want


def test_violations_and_longest_first(spark):
    units = spark.createDataFrame([("u1", "The Vampire Hunter met a Hunter."), ("u2", "A quiet evening.")], "unit_id string, text string")
    terms = spark.createDataFrame([(0, "Hunter", "Pemburu"), (1, "Vampire Hunter", "Pemburu Vampir")], TERMS)
    good = spark.createDataFrame([("u1", "Pemburu Vampir bertemu Pemburu"), ("u2", "Malam")], "unit_id string, target string")
    bad = spark.createDataFrame([("u1", "Sang Hunter"), ("u2", "")], "unit_id string, target string")
    assert m.violations(units, good, terms).count() == 0
    assert sorted((r["term"], r["src_count"], r["tgt_count"]) for r in m.violations(units, bad, terms).collect()) == [("Hunter", 1, 0), ("Vampire Hunter", 1, 0)]


def test_inheritance(spark):
    units = spark.createDataFrame([("u1", "The Hunter took the bead."), ("u2", "Nothing."), ("u3", "A bead of sweat.")], "unit_id string, text string")
    runs = units.selectExpr("concat(unit_id, '-r') as run_id", "unit_id")
    affected = m.affected_units(units, spark.createDataFrame([("bead",), ("Hunter",)], "term string"))
    kept, redo = m.inheritance(runs.selectExpr("run_id", "'t' as target"), runs, affected)
    assert [r["run_id"] for r in kept.collect()] == ["u2-r"] and sorted(r["run_id"] for r in redo.collect()) == ["u1-r", "u3-r"]


def test_audit_needs_alignment(spark):
    fields = "unit_ord long, document string, text string"
    source = spark.createDataFrame([(0, "a", "Hunter"), (1, "a", "x")], fields)
    terms = spark.createDataFrame([(0, "Hunter", "Pemburu")], TERMS)
    status, found = m.audit_pair(source, source, terms)
    assert status.first()["status"] == "verified" and found.count() == 1
    status, found = m.audit_pair(source, source.where("unit_ord = 0"), terms)
    assert status.first()["status"] == "unverifiable" and found.count() == 0


def test_large_glossaries_are_shuffled_alike(spark):
    rng = random.Random(5)
    words = ["a", "b", "c-d", "é", "x", "(y)", "z."]
    units = spark.createDataFrame([(str(i), " ".join(rng.choice(words) for _ in range(30))) for i in range(30)], "unit_id string, text string")
    terms = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))),) for _ in range(60)], "term string")
    known = m.phrases(terms)
    small, large = (sorted(map(tuple, m.occurrences(units, known, broadcast_terms=n).collect())) for n in (1000, 0))
    assert small == large
    want = set()
    for u in units.collect():
        for t in {r["term"] for r in terms.collect()}:
            if re.search(r"(?<!\w)" + r"\s+".join(map(re.escape, t.split())) + r"(?!\w)", u["text"]):
                want.add((u["unit_id"], t))
    assert {(u, p) for u, p, *_ in small} == want


def test_a_term_does_not_overlap_itself(spark):
    units = spark.createDataFrame([("u", "go go go go go, GO  go")], "unit_id string, text string")
    assert m.occurrence_counts(units, spark.createDataFrame([("go go",)], "term string")).first()["n"] == 3


def test_audit_summary(spark):
    fields = "unit_ord long, document string, text string"
    source = spark.createDataFrame([(0, "a", "Hunter Hunter"), (1, "a", "a Hunter")], fields)
    terms = spark.createDataFrame([(0, "Hunter", "Pemburu")], TERMS)
    output = spark.createDataFrame([(0, "a", "Pemburu x"), (1, "a", "Pemburu")], fields)
    status, found = m.audit_pair(source, output, terms)
    row = m.audit_summary(status, found, source.selectExpr("cast(unit_ord as string) as unit_id", "text"), terms).first()
    assert (row["status"], row["occurrences"], row["missed"], row["units_at_fault"]) == ("verified", 3, 1, 1) and abs(row["compliance"] - 2 / 3) < 1e-9


def test_constant_patterns_agree_with_places(spark, monkeypatch):
    rng = random.Random(7)
    words = ["go", "GO", "c-d", "é", "É", "(y)", "z.", "İ", "_a", "\n", "  ", "\u00a0", "''", "\\E"]
    units = spark.createDataFrame([(str(i), "".join(rng.choice(words) + rng.choice([" ", ""]) for _ in range(40))) for i in range(40)] + [("none", None), ("empty", "")], "unit_id string, text string")
    terms = spark.createDataFrame([("".join(rng.choice(words) + rng.choice([" ", ""]) for _ in range(rng.randint(1, 3))),) for _ in range(50)], "term string")
    for keep in (False, True):
        known = m.phrases(terms, keep_blanks=keep)
        few, many = (sorted(map(tuple, m.phrase_counts(units, known, keep_blanks=keep, most=n).collect())) for n in (1000, 0))
        assert few == many and len(few) > 50
    few = sorted(map(tuple, m.matches(units, terms).collect()))
    monkeypatch.setattr(m, "CONSTANT_TERMS", 0)
    assert few == sorted(map(tuple, m.matches(units, terms).collect())) and few
