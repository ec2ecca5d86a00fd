import random
import zlib

import numpy as np
import pytest

from loomspan.llm.quality_knn import SHAPES, TERMS, WORD_PART, fit_votes, op5_quality, term_counts
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        text = prose(rng, 6)
        good = i % 4 != 0
        if not good:
            text = " | ".join(text.split()) if i % 8 else " ".join(w + "$$$" for w in text.split())
        rows.append((i, text, "x"))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(graded):
    docs, labels = graded
    got = op5_quality(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_held_out_labels_are_never_read(graded):
    docs, labels = graded
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    a, b = fit_votes(docs, labels), fit_votes(docs, flipped)
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all()


def test_votes_match_brute_force(graded):
    docs, labels = graded
    model = fit_votes(docs, labels, rows=60)
    texts = [r["text"] for r in docs.limit(30).collect()] + [None, ""]
    for text, score in zip(texts, model.score(texts)):
        at, counts = term_counts(text)
        x = np.zeros(TERMS)
        x[at] = np.log1p(counts) * model.weight[at]
        for part, length in ((slice(0, SHAPES), 1.0), (slice(SHAPES, TERMS), WORD_PART)):
            if x[part].any():
                x[part] *= length / np.linalg.norm(x[part])
        x = x @ model.basis
        x /= np.linalg.norm(x) or 1
        sims = sorted(((-round(float(x @ v), 9), i) for i, v in enumerate(model.vectors)))[:25]
        w = [max(-s, 0) ** 4 for s, _ in sims]
        assert score == pytest.approx((sum(a * model.labels[i] for a, (_, i) in zip(w, sims)) + model.prior) / (sum(w) + 1), abs=1e-6)


def test_scores_do_not_depend_on_the_rows_around(graded):
    docs, labels = graded
    model = fit_votes(docs, labels)
    texts = [r["text"] for r in docs.limit(200).collect()]
    whole = model.score(texts)
    assert (whole == np.concatenate([model.score([t]) for t in texts])).all()
    assert (whole[::-1] == model.score(texts[::-1])).all()
    one = docs.repartition(1).collect()[0]["doc_id"]
    a, b = ({r["doc_id"]: r["score"] for r in op5_quality(docs.repartition(n), labels).collect()} for n in (1, 5))
    assert a == b and one in a


def test_words_count(spark):
    """Texts of equal shapes that differ by their words alone."""
    rng = random.Random(8)
    good, bad = ("amber ember umber".split(), "limes dimes mimes".split())
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(40)) + ".") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    held = [r for r in op5_quality(docs, labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) >= 0.97


def test_one_id_brings_one_row(spark, graded):
    docs, labels = graded
    many = docs.union(spark.createDataFrame([(3, f"copy {i}", "x") for i in range(500)], docs.schema))
    assert len(fit_votes(many, labels).labels) == len(fit_votes(docs, labels).labels)


def test_odd_rows(spark, documents, no_documents, graded):
    _, labels = graded
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in op5_quality(documents, none).collect()} == {0.5}
    got = op5_quality(documents, labels).collect()
    assert len(got) == documents.count()
    assert op5_quality(no_documents, labels).count() == 0
    assert len(term_counts(None)[0]) == 0 and term_counts("a")[1].sum() > 0
