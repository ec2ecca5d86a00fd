import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm.sentence_spans import op10_sentence_spans, remove_repeated_spans, sentences
from tests.llm.conftest import prose


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.!?\n 。é", max_size=60))
def test_sentences_lose_nothing(text):
    assert "".join(sentences(text)) == text


def by_hand(rows, window=3, pair=20, alone=50):
    """Every window of three sentences, and of all runs of two and one the long ones; no floor on a window."""
    docs = {(i is None, i, t): sentences(t) for i, t in rows}
    seen = {}
    for key, pieces in docs.items():
        at = [k for k, p in enumerate(pieces) if any(c.isalnum() or c == "_" for c in p)]
        plain = [b" ".join(pieces[k].encode().lower().split()) for k in at]
        n = [len(p.split()) for p in plain]
        for k in range(len(at)):
            if k + window <= len(at):
                seen.setdefault(b" ".join(plain[k : k + window]), []).append((key, at[k], at[k + window - 1] + 1))
            if k + 2 <= len(at) and n[k] + n[k + 1] >= pair:
                seen.setdefault(b" ".join(plain[k : k + 2]), []).append((key, at[k], at[k + 1] + 1))
            if n[k] >= alone:
                seen.setdefault(plain[k], []).append((key, at[k], at[k] + 1))
    gone = {k: set() for k in docs}
    for places in seen.values():
        places.sort(key=lambda x: (x[0][0], x[0][1] or 0, x[1], x[2]))
        for key, a, b in places[1:]:
            gone[key].update(range(a, b))
    return {k: "".join(p for i, p in enumerate(v) if i not in gone[k]) for k, v in docs.items()}


def test_matches_brute_force(spark):
    rng = random.Random(6)
    passages = [prose(rng, 8) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randint(1, 5))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts += [p, prose(rng, 2)]
        rows.append((i, "\n".join(parts)))
    rows += [(40, rows[0][1]), (41, " ".join(["w%d" % k for k in range(60)]) + "."), (42, "Start here. " + " ".join(["w%d" % k for k in range(60)]) + ".")]
    want = by_hand(rows)
    got = {r["doc_id"]: r for r in op10_sentence_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (_, i, _), text in want.items():
        assert got[i]["text"] == text
    assert got[40]["text"] == "" and got[40]["n_removed"] == got[40]["n_sentences"]
    assert got[0]["n_removed"] == 0 or got[0]["doc_id"] == 0
    for p in passages:  # one copy of a passage stays
        holders = [i for i, t in rows if p in t]
        if len(holders) > 1:
            assert sum(p in got[i]["text"] for i in holders) <= 1 and p.split()[0] in got[min(holders)]["text"]


def test_odd_rows(documents, no_documents):
    rows = documents.collect()
    out = remove_repeated_spans(documents)
    assert out.columns == [*documents.columns, "n_sentences", "n_removed", "words_removed"]
    got = out.collect()
    assert len(got) == len(rows)
    assert any(r["text"] is None for r in got) and any(r["text"] == "" for r in got)
    twins = [r["text"] for r in got if r["doc_id"] == 4]
    assert len(twins) == 3 and len(set(twins)) == 1 and twins[0]  # one document in three equal rows
    assert remove_repeated_spans(no_documents).count() == 0


def test_a_passage_in_running_text_goes_to_its_end(spark):
    rng = random.Random(9)
    own = iter(range(10**6))

    def line(words):
        return " ".join(f"w{next(own)}" for _ in range(words)).capitalize() + ". "

    rows = []
    for i in range(0, 20, 2):
        passage = "".join(line(rng.choice([3, 5, 8, 11])) for _ in range(rng.randint(7, 12)))
        rows += [(i, line(9) + passage + line(9)), (i + 1, line(7) + passage + line(7))]
    short = line(12) + line(11)  # two sentences of 23 words
    rows += [(20, line(9) + short + line(9)), (21, line(7) + short + line(7))]
    got = {r["doc_id"]: r["text"] for r in op10_sentence_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(0, 21, 2):
        assert got[i] == rows[i][1]
        pieces = sentences(rows[i + 1][1])
        assert got[i + 1] == pieces[0] + pieces[-1]


def test_runs_of_any_length_go(spark):
    rows = [(1, "Of. It. Was. Alpha here."), (2, "Beta there. Of. It. Was."), (3, "Gamma. Of. It. Delta."), (4, "One two three. " * 3)]
    got = {r["doc_id"]: r["text"] for r in op10_sentence_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Beta there. ", 3: rows[2][1], 4: rows[3][1]}
    three = "".join(" ".join(f"w{k}x{j}" for j in range(6)) + ". " for k in range(3))
    rows = [(1, three + "Mine."), (2, "Own words stand here. " + three + "Yours.")]
    got = {r["doc_id"]: r["text"] for r in op10_sentence_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Own words stand here. Yours."}


def test_scripts_without_blanks(spark):
    long = "".join(chr(0x4E00 + k) for k in range(60)) + "。"
    rows = [(1, long + "甲乙丙。"), (2, "丁戊。" + long)]
    got = {r["doc_id"]: r["text"] for r in op10_sentence_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "丁戊。"}


def test_clashing_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "A. B. C.", "mine", 7, "k"), (2, "A. B. C.", "yours", 8, "l")], "doc_id long, text string, n_removed string, Cuts int, k1 string")
    out = remove_repeated_spans(docs)
    assert out.columns == [*docs.columns, "n_sentences", "_n_removed", "words_removed"]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "A. B. C.", "mine", 7, "k", 3, 0, 0), (2, "", "yours", 8, "l", 3, 3, 3)]
