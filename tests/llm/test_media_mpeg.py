import hashlib
import os
import struct
import zlib

import numpy as np
import pytest

from strandwell.llm import media_mpeg as M


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000])
def test_round_trip(n):
    text = os.urandom(n)
    payload = M.payload_of(text)
    media = M.store_payload(payload, n)
    found = M.parse(media)
    assert M.carried(media, found) == payload
    assert (found["crc_bad"], found["skipped"], found["hz"]) == (0, 0, 48000)
    assert found["vbr"]["frames"] == len(payload) // 576 == len(found["offsets"])
    assert found["samples"] == 1152 * len(found["offsets"])
    assert found["tags"]["TXXX:bytes"] == str(n)


def test_resynchronises_and_sees_damage():
    payload = M.payload_of(os.urandom(3000))
    media = M.store_payload(payload, 3000)
    assert len(M.parse(b"\xff\x00\xff\xe1junk" + media)["offsets"]) >= 6
    found = M.parse(media)
    first = found["offsets"][0]
    hurt = bytearray(media)
    hurt[first + 20] ^= 1  # side information, under the checksum
    assert M.parse(bytes(hurt))["crc_bad"] == 1
    cut = media[: found["offsets"][2]] + b"\x00garbage" + media[found["offsets"][2] :]
    again = M.parse(cut)
    assert len(again["offsets"]) == len(found["offsets"]) and again["skipped"] == 8


def test_header_and_crc_by_hand():
    h = M.header(b"\xff\xfb\x90\x00")  # 128 kbit/s, 44.1 kHz
    assert (h.version, h.layer, h.kbps, h.hz, h.size, h.samples) == (1, 3, 128, 44100, 417, 1152)
    assert M.header(b"\xff\xff\xff\xff") is None and M.header(b"RIFF") is None

    def slow(data):
        value = 0xFFFF
        for byte in data:
            for bit in range(7, -1, -1):
                top = value >> 15 ^ (byte >> bit & 1)
                value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
        return value

    import numpy as np

    rows = np.frombuffer(os.urandom(34 * 5), dtype=np.uint8).reshape(5, 34)
    assert [slow(bytes(r)) for r in rows] == M.crc16(rows).tolist()


def test_tags_at_the_end_and_other_tables():
    body = M.store_payload(M.payload_of(b"abc"), 3)
    assert M.parse(body + b"TAG" + b"A title".ljust(125, b"\x00"))["tags"]["TIT2"] == "A title"
    assert M.parse(b"no audio here")["offsets"] == []


def test_columns(odd_docs, odd_rows, no_docs):
    rows = M.read_streams(M.store_column(odd_docs)).collect()
    assert len(rows) == len(odd_rows)
    wanted = sorted((len((t or "").encode()), zlib.crc32(M.payload_of((t or "").encode())[-32:])) for _, t, *_ in odd_rows)
    assert sorted((r["n_bytes"], r["tail_crc32"]) for r in rows) == wanted
    assert all(r["crc_bad"] == 0 and r["payload_bytes"] % 576 == 0 and r["payload_bytes"] > 0 and len(r["seek_offsets"]) == r["n_frames"] for r in rows)
    assert M.read_streams(M.store_column(no_docs)).count() == 0


@pytest.mark.parametrize("units", [1, 3])
def test_tag_letters_inside_the_last_frame_are_content(units):
    text = b"x" * (576 * (units - 1)) + b"y" * 506 + b"TAG" + b"z" * 67
    media = M.store_payload(M.payload_of(text), len(text))
    assert media[-128:-125] == b"TAG"
    found = M.parse(media)
    assert M.carried(media, found) == text and found["skipped"] == 0 and "TIT2" not in found["tags"]
    tagged = media + b"TAG" + b"A title".ljust(125, b"\x00")
    again = M.parse(tagged)
    assert M.carried(tagged, again) == text and again["skipped"] == 0 and again["tags"]["TIT2"] == "A title"


def _frame(head: bytes, body: bytes = b"") -> bytes:
    return (head + body).ljust(M.header(head).size, b"\x00")


def test_short_frame_with_a_mark_does_not_fail():
    head = b"\xff\xf3\x14\xc0"  # MPEG-2 Layer III, mono, 8 kbit/s, 24 kHz: 24 bytes
    data = _frame(head, bytes(9) + b"Xing") * 3
    assert M.header(head).size == 24
    found = M.parse(data)
    assert found["vbr"] == {"kind": "Xing", "frames": None, "bytes": None, "toc": None, "delay": None, "padding": None} and len(found["offsets"]) == 2
    assert M.features(data[:24])[6] == 0 and M.features(data + b"\xff\xf3\x14\xc0" + bytes(9) + b"Xing\x00")[6] == 2


def test_mixed_rates_add_up_exactly():
    one, two = b"\xff\xfb\x90\x00", b"\xff\xfb\x98\x00"  # 44.1 and 32 kHz
    found = M.parse(_frame(one) * 10 + _frame(two) * 10)
    assert len(found["offsets"]) == 20 and found["micros"] == 621_224 == (11520 * 1_000_000 * 32000 + 11520 * 1_000_000 * 44100) // (44100 * 32000)


def test_vbri_seek_table_and_encoder_delay():
    head = b"\xff\xfb\x90\x00"
    table = struct.pack(">4sHHHIIHHHH", b"VBRI", 1, 1105, 75, 4000, 7, 3, 2, 2, 100) + struct.pack(">HHH", 10, 20, 300)
    found = M.parse(_frame(head, bytes(32) + table) + _frame(head) * 7)
    assert found["vbr"] == {"kind": "VBRI", "frames": 7, "bytes": 4000, "toc": (20, 40, 600), "delay": 1105, "padding": None} and len(found["offsets"]) == 7
    info = b"Info" + struct.pack(">III", 15, 7, 4000) + bytes(range(100)) + bytes(4) + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    vbr = M.parse(_frame(head, bytes(32) + info) + _frame(head) * 7)["vbr"]
    assert (vbr["kind"], vbr["toc"], vbr["delay"], vbr["padding"]) == ("Info", tuple(range(100)), 576, 1000)


def test_tags_of_all_versions():
    audio = _frame(b"\xff\xfb\x90\x00") * 3

    def tag(version, body, flags=0):
        return b"ID3" + bytes([version, 0, flags]) + M._syncsafe(len(body)) + body

    two = b"TT2" + (6).to_bytes(3, "big") + b"\x00Title"
    three = b"TIT2" + struct.pack(">IH", 6, 0) + b"\x00A\xff\x00\xe0B"
    four = b"TXXX" + M._syncsafe(9) + b"\x00\x00" + b"\x01" + "k\x00v".encode("utf-16")
    for data, wanted in ((tag(2, two), ("TT2", "Title")), (tag(3, three.replace(b"\x00\x06", b"\x00\x05"), 0x80), ("TIT2", "A\xff\xe0B")), (tag(4, four), ("TXXX:k", "v"))):
        found = M.parse(data + audio)
        assert found["tags"][wanted[0]] == wanted[1] and len(found["offsets"]) == 3 and found["skipped"] == 0
    last = b"TAG" + b"Song".ljust(30, b"\x00") + b"Who".ljust(30, b" ") + b"Album".ljust(30, b"\x00") + b"1999" + b"note".ljust(29, b"\x00") + b"\x07" + b"\x01"
    assert M.parse(audio + last)["tags"] == {"TIT2": "Song", "TPE1": "Who", "TALB": "Album", "TYER": "1999", "COMM": "note", "TRCK": "7"}


def test_checksums_of_layer_one():
    head = b"\xff\xfe\x70\x00"  # MPEG-1 Layer I with checksum, stereo
    h = M.header(head)
    assert (h.layer, h.protected, h.allocation) == (1, True, 32) and M.header(b"\xff\xfe\x70\x50").allocation == 20
    allocation = os.urandom(32)
    crc = int(M.crc16(np.frombuffer(head[2:] + allocation, dtype=np.uint8)[None, :])[0])
    good, bad = (_frame(head, c.to_bytes(2, "big") + allocation) for c in (crc, crc ^ 1))
    found = M.parse(good * 3 + bad)
    assert (found["crc_checked"], found["crc_bad"]) == (4, 1)


def test_digests_of_the_columns_are_those_of_the_bytes(spark):
    texts = ["", "a", "é" * 900, "x" * 576]
    stored = M.store_column(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    media = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for r in M.read_streams(stored).collect():
        payload = M.payload_of(texts[r["doc_id"]].encode())
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media[r["doc_id"]]).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(texts[r["doc_id"]].encode()), len(payload), len(media[r["doc_id"]]))
        units = len(payload) // 576
        assert r["duration_us"] == units * 1152 * 1_000_000 // 48000 and r["n_frames"] == units
        assert all(media[r["doc_id"]][o : o + 4] == M.CARRIER for o in r["seek_offsets"])
