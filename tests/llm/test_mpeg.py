import random

from foliant.llm.mpeg import crc16, header, parse, read_mpeg, to_mpeg, write

from .helpers import clashing, documents


def test_round_trip_and_facts():
    rng = random.Random(1)
    for n in (64, 128, 935, 936, 5_000, 64 * 1_000):
        payload = rng.randbytes(n)
        media = write(payload, {"n_bytes": str(n), "TIT2": "tïtle"})
        s = parse(media)
        assert s.payload == payload and s.tags == {"n_bytes": str(n), "TIT2": "tïtle"}
        assert s.table["frames"] == len(s.offsets) and s.samples == 1152 * len(s.offsets)
        assert s.checked == len(s.offsets) + 1 and not (s.broken or s.skipped or s.resyncs)
        assert all(media[o : o + 2] == b"\xff\xfa" for o in s.offsets)
        assert s.table["bytes"] == len(media) - (s.offsets[0] - 192)


def test_damage_is_skipped_and_reported():
    payload = bytes(range(256)) * 30
    media = bytearray(write(payload))
    starts = parse(bytes(media)).offsets
    junk = media[: starts[2]] + b"\xff\xfb junk \xff" + media[starts[2] :]
    s = parse(bytes(junk))
    assert s.payload == payload and s.resyncs == 1 and s.skipped == 9
    media[starts[1] + 10] ^= 1
    assert parse(bytes(media)).broken == 1
    cut = parse(bytes(media[: starts[3] + 5]))
    assert len(cut.offsets) == 3 and cut.skipped == 5
    tagged = bytes(write(payload)) + b"TAG" + b"A title".ljust(30, b"\0") + bytes(95)
    assert parse(tagged).tags["TIT2"] == "A title" and parse(tagged).skipped == 0
    assert parse(b"").payload is None and parse(b"no audio at all").first is None
    foreign = write(payload)[starts[0] - 192 :]
    assert parse(foreign).payload is None and len(parse(foreign).offsets) == len(starts)


def tagged(version, flags, body):
    n = len(body)
    return b"ID3" + bytes([version, 0, flags, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def test_tags_of_all_versions():
    two = tagged(2, 0, b"TT2" + (6).to_bytes(3, "big") + b"\0title" + b"TXX" + (6).to_bytes(3, "big") + b"\0a\0b c")
    assert parse(two).tags == {"TT2": "title", "a": "b c"}
    frame = lambda name, value, bits=0: name + len(value).to_bytes(4, "big") + bytes([0, bits]) + value
    three = tagged(3, 0xC0, (6).to_bytes(4, "big") + bytes(6) + frame(b"TPE1", b"\1\xff\x00\xfeA\0").replace((6).to_bytes(4, "big"), (5).to_bytes(4, "big")))
    assert parse(three).tags == {"TPE1": "A"}
    four = tagged(4, 0x40, bytes([0, 0, 0, 6, 1, 0]) + frame(b"TALB", bytes([0, 0, 0, 3]) + b"\3\xc3\xa9", 1) + frame(b"TIT2", b"\0x\xff\x00y", 2))
    assert parse(four).tags == {"TALB": "é", "TIT2": "xÿy"}
    assert parse(tagged(2, 0x40, b"TT2" + (6).to_bytes(3, "big") + b"\0title")).tags == {} and parse(tagged(9, 0, b"TIT2")).tags == {}


def test_checksums_of_other_layers():
    for word, n in ((b"\xff\xfe\x40\xc0", 16), (b"\xff\xfe\x40\x00", 32), (b"\xff\xfe\x40\x50", 20)):  # mono, stereo, joint from subband 8 on
        size = header(word).size
        body = bytes(range(1, size - 5))
        good = word + crc16(word[2:] + body[:n]).to_bytes(2, "big") + body
        s = parse(good * 3)
        assert (s.checked, s.broken, s.unchecked) == (3, 0, 0)
        bad = good[: 6 + n - 1] + bytes([good[6 + n - 1] ^ 1]) + good[6 + n :]
        assert parse(good + bad).broken == 1
    two = b"\xff\xfc\x10\xc0"
    assert parse((two + bytes(header(two).size - 4)) * 2).unchecked == 2


def test_headers():
    assert header(b"\xff\xfb\x90\x00").size == 417 and header(b"\xff\xfb\x92\x00").size == 418
    assert header(b"\xff\xf3\x80\xc0").samples == 576 and header(b"\xff\xff\x10\x00").layer == 1
    for bad in (b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xff\xe9\x90\x00", b"\x00\xfb\x90\x00", b"\xff"):
        assert header(bad) is None
    assert crc16(b"") == 0xFFFF and crc16(b"123456789") == 0xAEE7


def test_table(spark):
    rows = [(1, "abc"), (2, "abc"), (3, None), (4, ""), (None, "é" * 100_000), (5, "x" * 64)]
    got = {r["doc_id"]: r for r in read_mpeg(to_mpeg(clashing(documents(spark, rows)))).collect()}
    for i, text in rows:
        data = (text or "").encode()
        assert got[i]["payload"] == data.ljust(max(64, -(-len(data) // 64) * 64), b"\0") and got[i]["n_bytes"] == len(data)
        assert got[i]["seconds"] == got[i]["n_samples"] / 48_000 and got[i]["tags"] == {"n_bytes": str(len(data))}
    assert got[1]["media"] == got[2]["media"]
    assert read_mpeg(to_mpeg(documents(spark, []))).collect() == []


def test_the_query(spark, tmp_path):
    import hashlib
    import zlib

    from foliant.llm import queries

    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 5_000), (5, "abc"), (6, "x" * 64)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_mpeg_audio"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        data = (text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r, media = got[i], write(payload, {"n_bytes": str(len(data))})
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        frames = -(-len(payload) // 935)
        assert r["seconds"] == frames * 1152 / 48_000 and len(r["seek_offsets"]) == frames and all(media[o : o + 2] == b"\xff\xfa" for o in r["seek_offsets"])
        assert f"frames={frames},samples={frames * 1152}" in r["feature"]
    assert got[1]["feature"] == got[5]["feature"]
