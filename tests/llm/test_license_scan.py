import random
import re
import string

import duckdb
import pytest

from loomspan.llm.license_scan import PHRASES, license_spans, op3_license_scan, oracle_sql, parse_rules, scan_rules

TEXTS = [
    "Licensed under the Apache License, Version 2.0. mit license MIT License",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.\nCC  by / cc-by",
    "SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: GPL-2.0-or-later",
    "Permission is hereby granted, free of\n * charge, to any person obtaining a copy",
    "gnu general public licenses; mitlicense; 0mit license; émit license; mit licenseé",
    "Released under the MIT License. " * 150,
    "https://creativecommons.org/licenses/by-sa/4.0/ Copyright (c) 2020 X. All rights reserved.",
    None,
    "",
    "no words about that 🙂 漢字 mit \x00 license",
]


def scan_by_hand(text):
    t = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    hits = [(m.start(), m.end(), p, no, label) for no, (p, k, label, r) in enumerate(parse_rules()) if k in t for m in re.finditer(r, t)]

    def beats(e, d):
        return e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3]))

    kept = [d for d in hits if not any(beats(e, d) for e in hits)]
    base = {label for _, label in places}
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[4] for d in kept})), sorted((d[0], d[1], d[3]) for d in kept))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, TEXTS[1], 1)], "doc_id long, text string, labels int")


def test_matches_scan_by_hand(table):
    for r in license_spans(table).collect():
        text = TEXTS[1] if r["doc_id"] is None else TEXTS[r["doc_id"]]
        mine = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], sorted((s["start"], s["stop"], s["rule"]) for s in r["spans"]))
        assert mine == scan_by_hand(text), text


def test_sql_agrees(table):
    documents = table.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})
    assert len(documents)
    con = duckdb.connect()
    con.register("documents", documents)
    cols = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
    want = con.sql(f"SELECT {cols} FROM ({oracle_sql()})").fetchall()
    mine = [tuple(r) for r in op3_license_scan(table).collect()]
    assert sorted(map(str, mine)) == sorted(map(str, want))


def test_native_plan(table):
    plan = op3_license_scan(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rules_are_many_and_gated():
    rules = parse_rules()
    assert len(rules) > 200 and all(k and label for _, k, label, _ in rules)


def test_empty(no_documents):
    assert op3_license_scan(no_documents).count() == 0


def sample(rng, parsed):
    """A text that the parsed regex may match; runs of blanks are wrapped, commented and long."""
    out = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out.append(chr(arg))
        elif op == "IN":
            kinds = [(str(k), v) for k, v in arg]
            chars = [chr(v) for k, v in kinds if k == "LITERAL"]
            chars += [chr(rng.randint(*v)) for k, v in kinds if k == "RANGE"] + ["1" for k, v in kinds if k == "CATEGORY"]
            out.append("~" if kinds[0][0] == "NEGATE" else rng.choice(chars))
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            wrap = len(inner) == 1 and str(inner[0][0]) == "IN" and {chr(v) for k, v in inner[0][1] if str(k) == "LITERAL"} >= set(" *#/\n")
            out.append(rng.choice([" ", "\n", "\n * ", "\n# ", "\n          // "]) if wrap else "".join(sample(rng, inner) for _ in range(rng.randint(low, min(high, low + 2)))))
        elif op == "BRANCH":
            out.append(sample(rng, rng.choice(arg[1])))
        elif op == "SUBPATTERN":
            out.append(sample(rng, arg[3]))
        elif op in ("ANY", "NOT_LITERAL"):
            out.append("~")
    return "".join(out)


def test_no_keyword_hides_a_match(spark):
    rng = random.Random(2)
    rules = scan_rules()
    texts = [x for _, _, _, r in rules for x in (sample(rng, re._parser.parse(r)) for _ in range(12)) if re.search(r, x)]
    texts += ["permission is\n * hereby granted, free of charge", "redistribution\n# and use in source and binary forms", "the beer-ware license"]
    assert len(texts) > 10 * len(rules)
    got = license_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()

    def beats(e, d):
        return e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3]))

    for r in got:
        t = texts[r["doc_id"]].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        hits = [(m.start(), m.end(), p, no) for no, (p, _, _, regex) in enumerate(rules) for m in re.finditer(regex, t)]
        assert sorted((s["start"], s["stop"], s["priority"], s["rule"]) for s in r["spans"]) == sorted(d for d in hits if not any(beats(e, d) for e in hits)), t
