import numpy as np
import pytest

import loomspan.llm.separator_scan as m
from loomspan.llm.bpe_codec import BpeCodec, load_codec
from loomspan.llm.separator_scan import count_tokens, file_lengths, listed, op9_separator_scan, token_blocks, write_token_files

END = 50_256


def lengths(ids, end=END):
    out, run = [], 0
    for x in ids:
        if x == end:
            out.append(run)
            run = 0
        else:
            run += 1
    return out, run


@pytest.mark.parametrize(("block", "stretch", "width"), [(1, 5, 2), (2, 3, 4), (7, 1, 2), (64, 2, 2), (10_000, 1024, 4)])
def test_counts_across_blocks(spark, tmp_path, monkeypatch, block, stretch, width):
    monkeypatch.setattr(m, "STRETCH", stretch)
    rng = np.random.default_rng(block)
    files = {}
    for name, n in (("a", 0), ("b", 1), ("c", 300), ("d", 57)):
        ids = np.where(rng.random(n) < 0.1, END, rng.integers(0, 50_000, n)).astype(f"<u{width}")
        if name == "c":
            ids[40:200] = 7  # a document over many blocks
            ids[200:204] = END  # empty documents
        (tmp_path / name).write_bytes(ids.tobytes())
        files[name] = ids
    got = {}
    for r in count_tokens(token_blocks(listed(spark, str(tmp_path), width), block)).orderBy("file", "doc_no").collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["doc_no"], r["n_tokens"], r["complete"]))
    for name, ids in files.items():
        done, rest = lengths(ids)
        want = [(i, n, True) for i, n in enumerate(done)] + ([(len(done), rest, False)] if rest else [])
        assert got.get(name, []) == want


def test_every_row(documents, no_documents):
    codec = load_codec()
    want = sorted((str(r["doc_id"]), len(codec.encode(r["text"]))) for r in documents.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in op9_separator_scan(documents).collect()) == want
    manifest = write_token_files(documents)
    counted = count_tokens(token_blocks(file_lengths(manifest), 50)).join(manifest, ["file", "doc_no"])
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in counted.collect()) == want
    assert op9_separator_scan(no_documents).count() == 0


def test_files_hold_the_ids(spark, documents):
    codec = load_codec()
    manifest = write_token_files(documents.where("doc_id is not null and text is not null").dropDuplicates(["doc_id"]))
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for file in {r["file"] for r in manifest.collect()}:
        want = []
        for r in manifest.where(manifest.file == file).orderBy("doc_no").collect():
            want += [*codec.encode(texts[r["doc_id"]]), END]
        assert np.fromfile(file, "<u2").tolist() == want


def test_width_and_reserved_ids():
    small = BpeCodec({bytes([b]): b for b in range(256)}, r"\S+|\s+")
    assert m.width_of(small, END) == 2 and m.width_of(small, 1 << 16) == 4
    assert m.width_of(BpeCodec({b"a": 70_000}, r"\S+"), END) == 4
    for ids in ([5, END], [5, 115_792]):
        with pytest.raises(ValueError):
            m.packed_ids(np.array(ids, np.uint32), END, 2)
    assert m.packed_ids(np.array([5, 115_792], np.uint32), END, 4) == np.array([5, 115_792], "<u4").tobytes()
