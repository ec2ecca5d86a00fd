import math
import random
import re
import zlib

import numpy as np
import pytest

from loomspan.llm.toxicity import GRADES, HASH_BITS, REJECT_AT, SURE, fit_ordinal, fit_toxicity, grades_of, op2_toxicity, with_severity, without_toxic
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 8 == 0
        text = prose(rng, 5)
        if toxic:
            own = text.split(" ")
            for _ in range(rng.randint(2, 6)):
                own.insert(rng.randrange(len(own)), rng.choice(["vileword", "nastyword", "grimword"]))
            text = " ".join(own)
        rows.append((i, text, "x"))
        if i % 5:
            labels.append((i, None if i == 7 else int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, severity string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_separates_unlabelled_rows(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in op2_toxicity(docs, labels).collect()}
    assert len(got) == 500
    unseen = [i for i in got if i % 5 == 0]
    assert all(got[i]["rejected"] == (i % 8 == 0) for i in unseen)
    assert all(0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 for r in got.values())


def test_expected_severity_is_the_sum_over_thresholds(labelled):
    docs, labels = labelled
    model = fit_toxicity(docs, labels)
    assert (np.diff(model.cuts) > 0).all()
    row = with_severity(docs.drop("severity").where("doc_id = 8"), model).first()
    above = model.above(row["text"])
    assert row["severity"] == pytest.approx(above.sum()) and (np.diff(above) <= 0).all()


def test_gradient_descends_to_the_base_rates():
    grades = np.array([0] * 70 + [1] * 20 + [2] * 10)
    _, cuts = fit_ordinal(np.empty(0, int), np.empty(0, int), grades, 0, steps=400)
    above = 1 / (1 + np.exp(cuts))
    assert above == pytest.approx([0.3, 0.1], abs=0.01)


def test_same_model_on_rerun(labelled):
    docs, labels = labelled
    a, b = fit_toxicity(docs, labels), fit_toxicity(docs.repartition(5), labels)
    assert (a.weights == b.weights).all() and (a.cuts == b.cuts).all() and (a.marks == b.marks).all()


def test_odd_rows_and_missing_classes(spark, documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert op2_toxicity(documents, none).where("rejected").count() == 0
    assert op2_toxicity(documents, none).count() == documents.count()
    one = spark.createDataFrame([(0, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    assert op2_toxicity(documents, one).where("rejected").count() == 0
    assert op2_toxicity(no_documents, one).count() == 0


def features_by_hand(text):
    out = set()
    for word in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
        for kind, part in (("w", word), ("p", word[:5] if len(word) > 5 else None), ("p", word[:7] if len(word) > 7 else None)):
            if part:
                out.add(zlib.crc32((kind + part).encode()) % (1 << HASH_BITS))
    return out


def test_scores_and_marks_by_hand(labelled):
    """Marks from counts, scores from the weights of the marks, without any of the operator's code."""
    docs, labels = labelled
    model = fit_toxicity(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    held = {i: features_by_hand(texts[i]) for i in known}
    n = [sum(1 for v in known.values() if v == k) for k in (0, 1)]
    want = set()
    for f in set().union(*held.values()):
        neg, pos = (sum(f in held[i] for i, v in known.items() if v == k) + 0.5 for k in (0, 1))
        if (math.log(pos / (n[1] + 1)) - math.log(neg / (n[0] + 1))) / math.sqrt(1 / pos + 1 / neg) >= SURE:
            want.add(f)
    assert set(np.flatnonzero(model.marks).tolist()) == want
    for r in op2_toxicity(docs, labels).collect():
        z = sum(model.weights[f] for f in features_by_hand(texts[r["doc_id"]]) & want)
        above = [1 / (1 + math.exp(c - z)) for c in model.cuts]
        mass = [a - b for a, b in zip([1, *above], [*above, 0])]
        assert r["severity"] == pytest.approx(sum(above)) and r["p_toxic"] == pytest.approx(above[0])
        assert r["grade"] == mass.index(max(mass)) and r["rejected"] == (above[0] >= REJECT_AT)


def test_fit_rests_at_the_optimum():
    """The penalised likelihood, written out, rises in no direction from the fitted weights and cuts."""
    rng = np.random.default_rng(5)
    x = rng.random((300, 6)) < 0.3
    grades = np.clip((x[:, :3].sum(axis=1) + rng.random(300) * 1.2).astype(int), 0, 3)
    rows, cols = np.nonzero(x)
    w, cuts = fit_ordinal(rows, cols, grades, 6, steps=3000, l2=1e-2)

    def loss(w, cuts):
        total = 0.0
        for own, g in zip(x, grades):
            above = [1.0, *[1 / (1 + math.exp(c - own @ w)) for c in cuts], 0.0]
            total -= math.log(above[g] - above[g + 1])
        return total / len(x) + 1e-2 * (w**2).sum() / 2

    best = loss(w, cuts)
    for k in range(6):
        for step in (-0.05, 0.05):
            assert loss(w + step * np.eye(6)[k], cuts) > best - 1e-4
    for k in range(len(cuts)):
        for step in (-0.05, 0.05):
            assert loss(w, cuts + step * np.eye(len(cuts))[k]) > best - 1e-4


def test_grades_are_terciles_of_toxic_rows():
    toxic = np.array([False] * 3 + [True] * 9)
    grades = grades_of(toxic, np.array([9.0, 0, 1] + [0.1 * k for k in range(9)]))
    assert grades.tolist() == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 3
    assert set(grades_of(toxic, np.ones(12)).tolist()) == {0, 1} and GRADES == 3


def test_clashing_columns_keep_their_values(labelled):
    docs, labels = labelled
    model = fit_toxicity(docs, labels)
    out = with_severity(docs, model)
    assert out.columns == ["doc_id", "text", "severity", "_severity", "p_toxic", "grade", "rejected"]
    assert {r["severity"] for r in out.collect()} == {"x"}
    kept = without_toxic(docs, model)
    assert kept.columns == docs.columns and {r["severity"] for r in kept.collect()} == {"x"} and kept.count() < docs.count()


def test_one_id_brings_one_row(spark, labelled):
    docs, labels = labelled
    many = docs.union(spark.createDataFrame([(9, f"zz copy {i}", "x") for i in range(300)], docs.schema))
    assert (fit_toxicity(many, labels).weights == fit_toxicity(docs, labels).weights).all()
