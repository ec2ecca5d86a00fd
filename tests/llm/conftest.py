import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size int"

WORDS = "stone river lamp window garden letter quiet copper meadow signal harbour winter paper orchard engine market silver valley thunder kettle".split()


def prose(rng: random.Random, sentences: int) -> str:
    out = []
    for _ in range(sentences):
        own = [rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(4, 12))]
        out.append(" ".join(own).capitalize() + rng.choice([".", "!", ".\n"]))
    return " ".join(out)


@pytest.fixture(scope="session")
def documents(spark):
    """Prose with copies, near copies, a shared passage, nulls, blanks, odd characters, a long text and repeated rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 14)) for _ in range(60)]
    passage = prose(rng, 8)
    for i in (3, 9, 21, 33):
        texts[i] = texts[i] + "\n" + passage + "\n" + prose(rng, 2)
    texts += [texts[0]] * 5 + [texts[1] + " tail", texts[2].upper(), None, "", "  \n\t ", "word", "two words", "naïve Ünïcode 漢字 🙂 ١٢", "x" * 5000, " ".join(texts[:20]), "a\x0bb\x0cc\x1cd e f"]
    rows = [(i, t, "en", ["web", "books", "code", None][min(3, i % 7)], len(t or ""), 1, 2) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[5], None, "web", 1, 1, 2), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
