import re
from collections import Counter

import corpus_pipeline
import pytest
from loomspan.llm.bpe_codec import load_codec
from loomspan.llm.queries import ORACLES, QUERIES
from loomspan.llm.simhash_trie import fingerprint
from tests.llm.test_near_copies import by_words, closure
from tests.llm.test_sentence_spans import by_hand as spans_by_hand
from tests.llm.test_source_mixing import targets_by_hand

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def kept(spark):
    """Each stage's input and result over the smallest tables, as rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert done.columns == docs.columns and done.schema.simpleString() == docs.schema.simpleString(), name
        docs = corpus_pipeline.materialize(done)
        out[name] = docs.collect()
    return out


def test_stages_take_effect(kept):
    n = [len(kept[k]) for k in ("documents", "toxicity", "simhash_near_dedup", "substring_dedup", "source_mixing", "byte_bpe")]
    assert n[1] < n[0] and n[2] < n[1] and n[3] == n[2] and n[5] == n[4]


def test_near_dedup_like_all_pairs(kept):
    """SimHash groups at three bits, then groups of near copies among their first members, from all pairs."""
    rows = sorted(kept["toxicity"], key=lambda r: r["doc_id"])
    prints = [fingerprint(r["text"]) for r in rows]
    group = closure(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    first = [rows[i] for i in sorted({g: i for i, g in reversed(list(enumerate(group)))}.values())]
    near = closure(len(first), lambda i, j: by_words(first[i]["text"], first[j]["text"]) >= 0.8)
    want = [first[i]["doc_id"] for i in sorted({g: i for i, g in reversed(list(enumerate(near)))}.values())]
    assert sorted(r["doc_id"] for r in kept["simhash_near_dedup"]) == want


def test_substring_dedup_like_all_windows(kept):
    want = spans_by_hand([(r["doc_id"], r["text"]) for r in kept["simhash_near_dedup"]])
    assert {r["doc_id"]: r["text"] for r in kept["substring_dedup"]} == {i: t for (_, i, _), t in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept["substring_dedup"] if r["text"] is not None)


def test_mix_keeps_its_budgets(kept):
    sizes, taken = Counter(), Counter()
    for r in kept["substring_dedup"]:
        sizes[r["source"]] += words(r["text"])
    for r in kept["source_mixing"]:
        taken[r["source"]] += words(r["text"])
    targets = targets_by_hand(sizes)
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_last_stage_encodes_the_mix(kept):
    codec = load_codec()
    want = Counter((r["doc_id"], len(codec.encode(r["text"]))) for r in kept["source_mixing"])
    assert Counter((r["doc_id"], r["n_tokens"]) for r in kept["byte_bpe"]) == want


def test_run_is_the_stages_in_order(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, kept["byte_bpe"]))


def test_empty_null_and_clashing_columns(spark, no_documents, documents):
    cols = ["doc_id", "text", "lang", "source", "n_chars", "severity", "rejected", "n_removed", "k1", "taken"]
    for docs in (no_documents, documents):
        docs = docs.selectExpr("*", "lang as severity", "lang as rejected", "lang as n_removed", "lang as k1", "lang as taken").select(cols)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "byte_bpe":
                assert docs.columns == cols
                assert docs.where("severity is distinct from lang or rejected is distinct from lang or n_removed is distinct from lang or k1 is distinct from lang or taken is distinct from lang").count() == 0
        docs.count()


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert list(STAGES) == ["toxicity", "simhash_near_dedup", "substring_dedup", "source_mixing", "byte_bpe"]
