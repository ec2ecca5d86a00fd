import hashlib
import random
import struct
import zlib
from dataclasses import replace

import pytest

from loomspan.llm.ogg_media import OggError, _page_bytes, demultiplex, media_columns, ogg_crc, op7_ogg, payload_of, read_ogg, read_pages, stream_pages, write_ogg


def crc_by_bit(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 5, 300):
        data = rng.randbytes(n)
        assert ogg_crc(data) == crc_by_bit(data)


@pytest.mark.parametrize("n", [64, 128, 255 * 64, 8000 * 8, 64 * 5003])
@pytest.mark.parametrize("packet", [255, 4000, 70_000])
def test_round_trip(n, packet):
    payload = random.Random(n).randbytes(n)
    media = write_ogg(payload, packet=packet)
    back, info = read_ogg(media)
    assert back == payload
    assert info["seconds"] == pytest.approx((n // 2) / 8000)
    assert all(a <= b for t in info["page_times"] for a, b in zip(t, t[1:]))
    pages = read_pages(media)
    assert len({p.serial for p in pages}) == 2 and all(len(p.lacing) <= 255 for p in pages)
    if packet == 70_000 and n > 255 * 255 * 2:
        assert any(p.flags & 1 for p in pages) and any(p.granule == -1 for p in pages)


def test_packets_of_multiples_of_255_end_with_a_zero_lacing_value():
    streams = demultiplex(read_pages(write_ogg(b"x" * 1020, packet=255)))
    assert all([len(p) for p in s.packets[1:]] == [255, 255] for s in streams.values())


def test_damage_is_found():
    media = write_ogg(random.Random(2).randbytes(64 * 3000))
    for at in (0, 30, len(media) // 2, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(OggError):
            read_ogg(bytes(broken))
    with pytest.raises(OggError):
        read_ogg(media[: len(media) // 2])
    pages = read_pages(media)
    with pytest.raises(OggError):
        demultiplex(pages[:2] + pages[4:])
    assert struct.unpack_from("<4s", media)[0] == b"OggS"
    ended = stream_pages(1, [b"short"], [0])
    without = [replace(ended[0], lacing=b"", body=b"", granule=-1)]
    for pages in (ended, without):  # streams that end before a first packet of their kind
        with pytest.raises(OggError):
            read_ogg(b"".join(map(_page_bytes, pages)))


def test_every_row(documents, no_documents):
    texts = documents.select("doc_id", "text").collect()
    got = op7_ogg(documents).collect()
    assert len(got) == len(texts)
    want = sorted((str(r["doc_id"]), len(p := payload_of(r["text"])[0]), payload_of(r["text"])[1], hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for r in texts)
    assert sorted((str(r["doc_id"]), r["payload_bytes"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0 for r in got)
    kept = media_columns(documents, keep_bytes=True).collect()
    assert all(hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"] for r in kept)
    assert op7_ogg(no_documents).count() == 0


def feature_by_hand(text):
    """From the payload alone: pages hold 255 lacing values, a packet of 4000 samples takes 16 of them."""
    data = (text or "").encode()
    payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    half = len(payload) // 2
    crossings = sum((a < 128) != (b < 128) for a, b in zip(payload, payload[1:]))
    power = sum((b - 128) ** 2 for b in payload) // len(payload)
    mean = 1000 * sum(payload) // len(payload)
    return {"streams": "2", "packets": str(2 * (1 + -(-half // 4000))), "ms": str(round(half / 8000 * 1000)), "mean": str(mean), "power": str(power), "crossings": str(crossings), "peak": str(max(payload))}


def test_features_by_hand(documents):
    by_hash = {hashlib.sha256(payload_of(r["text"])[0]).hexdigest(): feature_by_hand(r["text"]) for r in documents.collect()}
    for r in media_columns(documents, keep_bytes=True).collect():
        own = dict(x.split("=") for x in r["feature"].split(";"))
        assert own.pop("pages") == str(len(read_pages(r["media"])))
        assert own == by_hash[r["payload_sha256"]]
