"""Media columns: payloads as motion-JPEG in AVI, read back frame by frame and cut into shots.

A payload is stored losslessly as grey frames of ``GRID x GRID`` samples. Each sample is the flat value of one 8x8 block: with a
DC quantiser of 8 its quantised coefficient is the sample less 128, so baseline JPEG keeps it exactly. The Huffman table gives
category s a code of 9 - s bits, so each block takes 9 bits and a one-bit end mark, and whole streams are coded by array
operations. The last frame is filled up with zeros; an INFO comment holds the payload's length.

Reading follows the file, not the writer: RIFF chunks, the idx1 index, then each frame's own quantiser and Huffman tables, or the usual
ones where a frame has none. Other baseline frames, grey or colour with any sampling, with or without restart marks, are decoded bit by
bit; their luminance counts. Not read: progressive frames, and frames in several scans (both are "broken").

Shots: a cut lies where the histograms of neighbouring frames differ by more than the mean plus ``SIGMAS`` deviations of the
last ``TRAIL`` differences, and by ``LEAST`` at all. Clips are rows with start and end times.

Edge cases: a null payload counts as empty; an empty one is 64 zero bytes and one frame; equal payloads give equal files. A null file
gives null features and no clips, a broken one (or one that is no AVI) the feature "broken" and no clips; an index that points outside
the file is passed over, and the chunks are read in order; a frame of no bytes repeats the one before it. Very long texts become as many
frames as they need; a task holds the files of at most 500 rows. Repeated rows are returned as often as they come; extra columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, slices, text_batches

GRID, FPS, UNIT = 32, 25, 64
BINS, TRAIL, SIGMAS, LEAST = 16, 8, 2.0, 0.05

# fixed values of the JPEG format: scan order of the coefficients of a block
ZIGZAG = [i * 8 + j for s in range(15) for i, j in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), key=lambda p: p[1 - s % 2])]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header() -> bytes:
    side = GRID * 8
    dc = bytes([0, *([1] * 9), *([0] * 7), *range(8, -1, -1)])  # code lengths 1 to 9 for categories 8 to 0
    ac = bytes([0x10, 1, *([0] * 15), 0])  # the end mark only
    return b"\xff\xd8" + _segment(0xDB, bytes([0] + [8] * 64)) + _segment(0xC0, struct.pack(">BHHB", 8, side, side, 1) + bytes([1, 0x11, 0])) + _segment(0xC4, dc) + _segment(0xC4, ac) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _codes() -> np.ndarray:
    """Ten bits for each difference from -255 to 255: category code, value bits, end mark."""
    out = []
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1
        out.append(((prefix << s | (d if d > 0 else d + (1 << s) - 1 if d else 0)) << 1))
    return np.array(out, np.uint64)


_HEADER, _CODES = _header(), _codes()


def pad(raw: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def encode(payload: bytes) -> bytes:
    """An AVI file that holds the payload."""
    size = GRID * GRID
    frames = max(1, -(-len(payload) // size))
    x = np.zeros(frames * size, np.int16)
    x[: len(payload)] = np.frombuffer(payload, np.uint8)
    x = x.reshape(frames, size) - 128
    d = np.diff(x, axis=1, prepend=np.int16(0))
    v = _CODES[d + 255].reshape(frames, -1, 4)
    packed = v[..., 0] << np.uint64(30) | v[..., 1] << np.uint64(20) | v[..., 2] << np.uint64(10) | v[..., 3]
    raw = packed.astype(">u8").view(np.uint8).reshape(frames, -1, 8)[..., 3:].reshape(frames, -1)
    movi, index, at = [b"movi"], [], 4
    for row in raw:
        jpeg = _HEADER + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        chunk = struct.pack("<4sI", b"00dc", len(jpeg)) + jpeg + bytes(len(jpeg) % 2)
        movi.append(chunk)
        at += len(chunk)
    side = GRID * 8
    chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body + bytes(len(body) % 2)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, 0, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"payload=%d\x00" % len(payload)))
    body = b"AVI " + hdrl + info + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        yield bytes(name), at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def parse(media: bytes) -> tuple[list[bytes], float, str]:
    """The frames that the index names, frames a second, and the comment."""
    data = memoryview(media)
    if len(media) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, micros, comment = None, None, 40_000, ""
    todo = [(12, len(media))]
    while todo:
        for name, a, b in _chunks(data, *todo.pop()):
            if name == b"LIST":
                kind = bytes(data[a : a + 4])
                if kind == b"movi":
                    movi = (a, b)
                else:
                    todo.append((a + 4, b))
            elif name == b"avih":
                micros = struct.unpack_from("<I", data, a)[0] or micros
            elif name == b"idx1":
                index = (a, b)
            elif name == b"ICMT":
                comment = bytes(data[a:b]).split(b"\x00")[0].decode("latin-1")
    if movi is None:
        raise ValueError("no frames")
    whole = index is not None and all(struct.unpack_from("<I", data, k + 8)[0] + struct.unpack_from("<I", data, k + 12)[0] + 8 <= len(media) for k in range(index[0], index[1] - 15, 16))
    if not whole:
        return [bytes(data[a:b]) for name, a, b in _chunks(data, movi[0] + 4, movi[1]) if name.endswith((b"dc", b"db"))], 1e6 / micros, comment
    frames = []
    for k in range(index[0], index[1] - 15, 16):
        name, _, offset, size = struct.unpack_from("<4sIII", data, k)
        a = movi[0] + offset
        if bytes(data[a : a + 4]) != name:  # some writers count from the start of the file
            a = offset
        if name.endswith((b"dc", b"db")):
            frames.append(bytes(data[a + 8 : a + 8 + size]))
    return frames, 1e6 / micros, comment


# fixed values of the JPEG format: the usual Huffman tables, for files that hold none. Codes by length, and the symbols that don't
# follow in rising order; all other (run, size) symbols come after these, rising
USUAL = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1], range(12)),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1], range(12)),
    0x10: ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")),
    0x11: ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1")),
}


def _table(lengths, symbols) -> dict[tuple[int, int], int]:
    """Symbol of each (code length, code)."""
    out, code, left = {}, 0, iter(symbols)
    for n, many in enumerate(lengths, 1):
        for _ in range(many):
            out[n, code] = next(left)
            code += 1
        code <<= 1
    return out


def _usual(which: int) -> dict[tuple[int, int], int]:
    lengths, first = USUAL[which]
    rest = [r << 4 | s for r in range(16) for s in range(1, 11) if r << 4 | s not in first] if which & 0x10 else []
    return _table(lengths, [*first, *rest])


class _Frame:
    """Tables and scan of one baseline JPEG, grey or with chroma; only the first component (the luminance) is given out."""

    def __init__(self, jpeg: bytes):
        self.huffman: dict[int, dict[tuple[int, int], int]] = {}
        self.values: np.ndarray | None = None
        self.restart = 0
        at, quantisers = jpeg.index(b"\xff\xd8") + 2, {}
        parts: list[tuple[int, int, int, int]] = []  # component, its blocks across and down in a unit, its quantiser
        while True:
            while jpeg[at + 1] == 0xFF:  # fill bytes
                at += 1
            marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
            body = jpeg[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    many = sum(body[1:17])
                    self.huffman[body[0]] = _table(body[1:17], body[17 : 17 + many])
                    body = body[17 + many :]
            elif marker == 0xDD:
                self.restart = struct.unpack_from(">H", body)[0]
            elif marker == 0xC0 or marker == 0xC1:
                self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
                parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif marker == 0xDA:
                tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                break
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("only baseline frames are read")
        if len(tables) != len(parts) or not self.height or not self.width:
            raise ValueError("only frames in one scan are read")
        if len(parts) == 1:
            parts = [(parts[0][0], 1, 1, parts[0][3])]
        self.parts = [(h, v, tables[c] >> 4, 0x10 | tables[c] & 15) for c, h, v, _ in parts]
        for _, _, dc, ac in self.parts:
            for which in (dc, ac):
                if which not in self.huffman:
                    self.huffman[which] = _usual(which)
        self.quantiser = quantisers[parts[0][3]]
        self.head = jpeg[:at]
        self.scan = self.scan_of(jpeg)
        self.blocks = -(-self.height // 8), -(-self.width // 8)

    def scan_of(self, jpeg: bytes) -> bytes:
        end = jpeg.rfind(b"\xff\xd9")
        return jpeg[len(self.head) : end if end > 0 else len(jpeg)]

    def flat(self, scans: list[bytes]) -> np.ndarray | None:
        """DC differences of frames with these tables by array operations, if every block takes one width and has an end mark only."""
        dc, ac = self.huffman[self.parts[0][2]], self.huffman[self.parts[0][3]]
        widths = {n + s for (n, _), s in dc.items()}
        count = self.blocks[0] * self.blocks[1]
        if len(self.parts) > 1 or self.restart or list(ac.values()) != [0] or len(widths) != 1 or widths.pop() + next(iter(ac))[0] != 10 or count % 4:
            return None
        size = count * 10 // 8
        scans = [x.replace(b"\xff\x00", b"\xff")[:size] for x in scans]
        if any(len(x) < size for x in scans):
            raise ValueError("a frame ends early")
        raw = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 3:] = raw
        v = wide.view(">u8").ravel().astype(np.uint64)
        codes = np.stack([v >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], 1).ravel().astype(np.int64) >> 1
        if self.values is None:
            self.values = np.zeros(512, np.int64)
            for (_, code), s in dc.items():
                for k in range(1 << s):
                    self.values[code << s | k] = (k if k >> (s - 1) else k - (1 << s) + 1) if s else 0
        return self.values[codes].reshape(len(scans), count)

    def coefficients(self) -> np.ndarray:
        """All coefficients of the first component, decoded bit by bit: blocks x 64."""
        across, down = max(p[0] for p in self.parts), max(p[1] for p in self.parts)
        wide, high = -(-self.width // (8 * across)), -(-self.height // (8 * down))
        h, v = self.parts[0][:2]
        out = np.zeros((high * v, wide * h, 64), np.int64)
        pieces = re.split(rb"\xff+[\xd0-\xd7]", self.scan) if self.restart else [self.scan]
        units = [(y, x) for y in range(high) for x in range(wide)]
        step = self.restart or len(units)
        for n, piece in enumerate(pieces):
            self._decode(piece.replace(b"\xff\x00", b"\xff"), units[n * step : (n + 1) * step], out)
        return out[: self.blocks[0], : self.blocks[1]].reshape(-1, 64)

    def _decode(self, raw: bytes, units: list[tuple[int, int]], out: np.ndarray) -> None:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).tolist()
        at, last = 0, [0] * len(self.parts)

        def symbol(tree: dict) -> int:
            nonlocal at
            n = code = 0
            while (n, code) not in tree:
                if n > 16:
                    raise ValueError("no such code")
                code, n, at = code << 1 | bits[at], n + 1, at + 1
            return tree[n, code]

        def value(s: int) -> int:
            nonlocal at
            if not s:
                return 0
            v = int("".join(map(str, bits[at : at + s])), 2)
            at += s
            return v if v >> (s - 1) else v - (1 << s) + 1

        for y, x in units:
            for k, (h, v, dc, ac) in enumerate(self.parts):
                for n in range(h * v):
                    block = out[y * v + n // h, x * h + n % h] if k == 0 else np.zeros(64, np.int64)
                    last[k] += value(symbol(self.huffman[dc]))
                    block[0] = last[k]
                    c = 1
                    while c < 64:
                        rs = symbol(self.huffman[ac])
                        if rs == 0:
                            break
                        c += rs >> 4
                        if rs != 0xF0:
                            block[ZIGZAG[c]] = value(rs & 15)
                        c += 1

    def samples(self, dc: np.ndarray | None = None) -> np.ndarray:
        """Mean level of each 8x8 block, row by row, as 8-bit samples."""
        dc = self.coefficients()[:, 0] if dc is None else dc
        return np.clip(dc * self.quantiser[0] // 8 + 128, 0, 255).astype(np.uint8)

    def pixels(self) -> np.ndarray:
        """The whole picture; of a colour frame its luminance."""
        c = self.coefficients()
        q = np.zeros(64, np.int64)
        q[ZIGZAG] = self.quantiser
        k = np.arange(8)
        basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
        blocks = np.einsum("xu,nuv,yv->nxy", basis, (c * q).reshape(-1, 8, 8), basis)
        rows, cols = self.blocks
        picture = blocks.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
        return np.clip(np.rint(picture + 128), 0, 255).astype(np.uint8)[: self.height, : self.width]


_heads: list[_Frame] = []


def _samples(frames: list[bytes]) -> list[np.ndarray] | np.ndarray:
    """Samples of all frames of a file. A frame of no bytes repeats the one before it."""
    full = [f for f in frames if f]
    if not full:
        raise ValueError("no frames")
    head = _heads[0] if _heads and full[0].startswith(_heads[0].head) else _Frame(full[0])
    _heads[:] = [head]  # files of one writer have one header
    if len(full) == len(frames) and all(f.startswith(head.head) for f in frames):
        steps = head.flat([head.scan_of(f) for f in frames])
        if steps is not None:
            return head.samples(steps.cumsum(1))
    out: list[np.ndarray] = []
    for f in frames:
        if f or out:
            out.append(_Frame(f).samples() if f else out[-1])
    return out


def read_payload(media: bytes) -> tuple[bytes, list[np.ndarray] | np.ndarray, float]:
    """The stored payload, the frames' samples, frames a second. ValueError for what is no such file, or is broken."""
    try:
        frames, fps, comment = parse(media)
        samples = _samples(frames)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("broken file") from e
    size = re.match(r"payload=(\d+)", comment)
    raw = b"".join(x.tobytes() for x in samples)
    return raw[: int(size[1])] if size else raw, samples, fps


def shots(samples: list[np.ndarray] | np.ndarray) -> list[int]:
    """First frames of the shots."""
    hist = np.stack([np.bincount(x >> 4, minlength=BINS) / len(x) for x in samples])
    step = np.abs(np.diff(hist, axis=0)).sum(1) / 2.0
    starts = [0]
    for k, d in enumerate(step.tolist()):
        past = step[max(0, k - TRAIL) : k]
        limit = past.mean() + SIGMAS * past.std() if len(past) else LEAST
        if d > max(limit, LEAST):
            starts.append(k + 1)
    return starts


def clips(media: bytes) -> list[tuple[int, float, float, int]]:
    """clip, start and end in seconds, frames."""
    _, samples, fps = read_payload(media)
    return _clips(samples, fps)


def _clips(samples: list[np.ndarray] | np.ndarray, fps: float) -> list[tuple[int, float, float, int]]:
    starts = shots(samples)
    ends = [*starts[1:], len(samples)]
    return [(k, a / fps, b / fps, b - a) for k, (a, b) in enumerate(zip(starts, ends))]


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` and ``media``, the AVI file of the padded text. Narrow: no shuffle."""
    text_batches(docs.sparkSession)
    kind = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):  # files are larger than texts
                part = b.slice(a, 500)
                raws = [r or b"" for r in column(part, "_r")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([encode(pad(r)) for r in raws], pa.binary())], [key, "n_bytes", "media"])

    schema = T.StructType([kind, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(F.col(key), F.col(text).cast("binary").alias("_r")).mapInArrow(run, schema)


CLIP = "clip int, start_s double, end_s double, frames int"


def clip_rows(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each shot of each file: ``key, clip, start_s, end_s, frames``; none for null and broken files."""
    return digest(stored, key).select(key, F.inline("clips"))


def digest(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is read back from ``media``: payload size and hash, tail checksum, file size and hash, and the shots.

    A null file gives nulls; of a broken one only size and hash are given, and ``feature`` is "broken".
    """
    kind = stored.schema[key]

    def of(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * 7
        about = len(m), hashlib.sha256(m).hexdigest()
        try:
            payload, samples, fps = read_payload(m)
        except ValueError:
            return None, None, None, *about, "broken", None
        cut = _clips(samples, fps)
        feature = f"frames={len(samples)};clips=" + ",".join(f"{a:.2f}-{e:.2f}" for _, a, e, _ in cut)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *about, feature, [dict(zip(("clip", "start_s", "end_s", "frames"), c)) for c in cut]

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    clip = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())]))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = list(zip(*map(of, column(b, "media")))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], [key, "n_bytes", *names])

    added = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<{CLIP.replace(' ', ': ').replace(',:', ',')}>>"
    schema = T.StructType([kind, *T._parse_datatype_string(added).fields])
    return stored.select(key, F.col("n_bytes") if "n_bytes" in stored.columns else F.lit(None).cast("long").alias("n_bytes"), "media").mapInArrow(run, schema)
