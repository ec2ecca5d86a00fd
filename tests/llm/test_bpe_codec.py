import base64
import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm.bpe_codec import BpeCodec, PerfectVocabulary, encode_documents, load_codec, op6_bpe

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def codec():
    return load_codec()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_like_the_library(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)
    assert codec.decode_packed(codec.encode_packed(text)) == text.encode()


def test_odd_spaces_and_long_tokens(codec, library):
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab é1٣'sD\n\t \r　 \x1c\x85漢🙂|_") for _ in range(40))
        assert codec.encode(text) == library.encode_ordinary(text)
    text = "ab" * 20_000 + " " * 3000 + "é" * 5000
    assert codec.decode_packed(codec.encode_packed(text)) == text.encode()
    assert codec.encode("<|endoftext|>") == library.encode_ordinary("<|endoftext|>")


def test_perfect_hash_is_minimal_and_exact():
    ranks = {bytes([i, j]): i * 256 + j for i in range(40) for j in range(50)}
    v = PerfectVocabulary(ranks)
    assert sorted(v.keys) == sorted(ranks) and all(v.get(k) == r for k, r in ranks.items())
    assert v.get(b"zz") == v.get(b"") == -1 and PerfectVocabulary({}).get(b"a") == -1


def test_every_row(documents, no_documents, library):
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in documents.collect())
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op6_bpe(documents).collect())
    want = []
    for i, t in texts:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    assert op6_bpe(no_documents).count() == 0
    assert sum(len(r["ids"]) for r in encode_documents(documents).collect()) == sum(w[1] for w in want)


def test_other_rank_file(tmp_path):
    path = tmp_path / "tiny"
    path.write_bytes(b"\n".join(base64.b64encode(k) + b" " + str(i).encode() for i, k in enumerate([bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc"])))
    own = BpeCodec.from_file(str(path), public.PATTERN)
    assert own.encode("abc xabcbc") == [257, 32, 120, 257, 258]
