import hashlib
import zlib

import numpy as np
import pytest

from tidesignal.llm import media

TEXTS = [None, "", "a", "x" * 64, "y" * 65, "é日本 " * 900, "word " * 30_000, "\x00" * 10]


@pytest.mark.parametrize("size", [64, 1024, 1088, 70_016])
def test_round_trip_of_any_bytes(size):
    raw = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    got, samples, fps = media.read_payload(media.encode(raw))
    assert got == raw and fps == media.FPS and samples.shape[1] == media.GRID**2


def test_contract(make_docs):
    rows = {r["doc_id"]: r for r in media.digest(media.store(make_docs(TEXTS))).collect()}
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = media.pad(raw)
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.encode(payload)), hashlib.sha256(media.encode(payload)).hexdigest())
    assert tuple(rows[0])[1:] == tuple(rows[1])[1:]
    assert media.digest(media.store(make_docs([]))).count() == 0


def test_fast_path_equals_bit_reader_and_pixels():
    raw = np.random.default_rng(1).integers(0, 256, 1024, np.uint8).tobytes()
    frame = media._Frame(media.parse(media.encode(raw))[0][0])
    assert frame.samples().tobytes() == raw
    picture = frame.pixels()
    assert picture.shape == (256, 256) and (picture[::8, ::8].ravel() == np.frombuffer(raw, np.uint8)).all()


def test_file_without_index_and_not_an_avi():
    raw = bytes(range(64)) * 20
    file = media.encode(raw)
    cut = file[: file.rfind(b"idx1")]
    assert media.read_payload(cut)[0] == raw
    with pytest.raises(ValueError):
        media.parse(b"RIFF0000WAVE")


def test_shots_lie_where_the_histogram_jumps(make_docs):
    a, b = "a" * 1024 * 20, "".join(chr(48 + k % 70) for k in range(1024 * 20))
    clips = media.clips(media.encode((a + b).encode()))
    assert [(c[1], c[2], c[3]) for c in clips] == [(0.0, 0.8, 20), (0.8, 1.6, 20)]
    rows = media.clip_rows(media.store(make_docs([a + b, ""]))).orderBy("doc_id", "clip").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0.0, 0.8, 20), (0, 1, 0.8, 1.6, 20), (1, 0, 0.0, 0.04, 1)]


def test_null_and_broken_files(spark):
    good = media.encode(media.pad(b"some text " * 300))
    index = good.rfind(b"idx1")
    lost = good[: index + 8] + b"00dc" + b"\xff" * 12 + good[index + 24 :]  # an entry that points outside the file
    files = [None, b"", b"RIFF0000AVI ", b"no media", good, good[:300], good.replace(b"\xff\xd8\xff\xdb", b"\xff\xd8\xff\xc2"), lost]
    stored = spark.createDataFrame(list(enumerate(map(lambda f: f and bytearray(f), files))), "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in media.digest(stored).collect()}
    assert rows[0]["feature"] is None and all(rows[k]["feature"] == "broken" for k in (2, 3, 5, 6)) and rows[1]["media_bytes"] in (0, None)
    assert rows[4]["payload_sha256"] == rows[7]["payload_sha256"] == hashlib.sha256(media.pad(b"some text " * 300)).hexdigest()
    assert {r["doc_id"] for r in media.clip_rows(stored).collect()} == {4, 7}


def picture(spark, w, h, colour, quality=0.8):
    """A JPEG by Java's writer, and its luminance as Java's reader has it."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(w, h, 1 if colour else 10)
    r = np.random.default_rng(w)
    for y in range(h):
        for x in range(w):
            a, b, c = (int(v) for v in (120 + 90 * np.sin(x / 9), 120 + 90 * np.cos(y / 7), r.integers(90, 140)))
            image.setRGB(x, y, a << 16 | (b if colour else a) << 8 | (c if colour else a))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    jpeg = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(jpeg))).getData()
    rgb = np.array(list(back.getPixels(0, 0, w, h, jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Integer.TYPE, w * h * (3 if colour else 1)))), float).reshape(h, w, -1)
    return jpeg, rgb @ np.array([0.299, 0.587, 0.114]) if colour else rgb[..., 0]


@pytest.mark.parametrize("w,h,colour", [(40, 24, False), (37, 21, False), (64, 48, True), (45, 35, True)])
def test_frames_of_another_writer(spark, w, h, colour):
    jpeg, want = picture(spark, w, h, colour)
    got = media._Frame(jpeg).pixels()
    assert got.shape == (h, w) and np.abs(got - want).max() <= 3
    tables = [k for k in range(len(jpeg) - 1) if jpeg[k : k + 2] == b"\xff\xc4"]
    bare = jpeg
    for k in reversed(tables):  # without Huffman tables, as motion-JPEG has it: the writer uses the usual ones
        size = int.from_bytes(jpeg[k + 2 : k + 4], "big")
        bare = bare[:k] + bare[k + 2 + size :]
    assert len(bare) < len(jpeg) and (media._Frame(bare).pixels() == got).all()


def test_restart_marks_and_repeated_frames():
    """A grey frame of two blocks, each after a mark of its own: the prediction starts anew."""
    head = media._HEADER
    size = np.frombuffer(head, np.uint8)
    at = head.index(b"\xff\xc0")
    head = head[: at + 5] + (8).to_bytes(2, "big") + (16).to_bytes(2, "big") + head[at + 9 :]
    head = head[: head.index(b"\xff\xda")] + b"\xff\xdd\x00\x04\x00\x01" + head[head.index(b"\xff\xda") :]
    block = lambda v: (int(media._CODES[v - 128 + 255]) << 6 | 63).to_bytes(2, "big").replace(b"\xff", b"\xff\x00")
    frame = head + block(200) + b"\xff\xd0" + block(77) + b"\xff\xd9"
    assert len(size) and media._Frame(frame).samples().tolist() == [200, 77]
    assert [x.tolist() for x in media._samples([b"", frame, b"", frame])] == [[200, 77]] * 3
