"""SentencePiece encoding and decoding by a streaming lattice search.

The search walks the text once. For each boundary it keeps one back pointer (the piece that ends there and where that piece
starts), in a window of the length of the longest piece: as far as a new arc can reach. Once more boundaries than that wait, and then at
every boundary until it succeeds, the surviving paths are followed back to where they meet; the ids before are final, are given out
and forgotten. The window grows only while paths don't meet.

* unigram model: the arc into a boundary is the one with the highest sum of scores (Viterbi).
* BPE model: an arc is allowed only if the piece may follow the piece that ends at its start, that is, if merging their joint
  string gives just these two pieces. By the prefix property of BPE exactly one arc into each boundary is allowed, and the
  surviving path is the merge result, so ids equal those of the original library.

Boundaries that no piece of the vocabulary can reach over are commit points known in advance; the text is cut there, every segment
goes through the search, and ids of short segments are kept in a bounded memo as a cache for it. A model with a normaliser has its
text normalised by the original library first.

Edge cases: null text gives null ids and 0 tokens; empty text gives no ids; characters outside the vocabulary become byte pieces
(or the unknown id without byte fallback); U+2581 in a text is read as a space, as the original library does; very long texts are
searched whole, in the same window; repeated rows are returned as often as they come; extra columns are ignored; an empty table gives
an empty result. Ties between unigram paths go to the piece that starts first.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, slices, text_batches

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: Segments kept in a worker's memo, and the longest one that is kept.
MEMO_ENTRIES, MEMO_CHARS = 500_000, 48

_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_models: dict[bytes, "PieceModel"] = {}


class PieceModel:
    """Vocabulary of a SentencePiece model file."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        self.normalizer = None
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            import sentencepiece

            self.normalizer = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.prefix = " " if spec.add_dummy_prefix else ""
        self.size = len(proto.pieces)
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), 0)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER) else " ⁇ ".encode() if p.type == UNKNOWN else b"" for p in proto.pieces]
        self.window = max(map(len, self.ids))
        self.floor = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.follows: dict[int, bool] = {}
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.segments = self._commit_points()
        self.memo = _Memo(self)

    def _commit_points(self) -> re.Pattern:
        """A pattern that cuts texts only at boundaries that no piece of this vocabulary reaches over.

        Cuts before a run of spaces, at line feeds, and, if no piece has an ASCII letter before a point or comma, there too.
        """
        if any(b == SPACE != a for a, b in self.pairs) or any("\n" in p for p in self.ids):
            return re.compile(r"(?s).+")
        stop = any(a in _LETTERS and b in ".," for a, b in self.pairs)
        return re.compile(r" *+[^ \n]++|\n| +" if stop else r" *+[A-Za-z]++(?=[.,])| *+[^ \n]++|\n| +")

    def merge(self, s: str) -> list[int]:
        """Plain BPE of a short string: merge the best-scored adjacent pair, leftmost first."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, -1) for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return True
        key = a * self.size + b
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            known = self.follows[key] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return known

    def search(self, s: str) -> list[int]:
        """Piece ids of a segment, spaces as U+2581; -1 - code point for a character outside the vocabulary."""
        parts = list(self.stream(s))
        return parts[0] if len(parts) == 1 else [i for part in parts for i in part]

    def stream(self, s: str, watch: Callable[[int, int, int], None] | None = None) -> Iterator[list[int]]:
        """The lattice search: gives out ids as they become final.

        As soon as more boundaries than the longest piece has characters wait, the paths into the boundaries that can still be reached
        or left are followed back to where they meet; what lies before is given out and dropped. ``watch`` gets the place, the last
        committed boundary and the number of boundaries held.
        """
        n, window, unigram = len(s), self.window, self.kind == UNIGRAM
        trie, follows, size, score, may_follow = self.trie, self.follows, self.size, self.score, self.may_follow
        done = 0  # the last committed boundary; place 0 of the lists
        held = min(n, 2 * window) + 1
        piece, start = [None] * held, [0] * held  # by boundary: the piece that ends there, and where it starts
        total = [0.0] * held if unigram else None
        piece[0] = -1
        for j in range(n):
            at = j - done
            last = piece[at]
            if last is None:
                continue
            if at > window:
                meet = self._meeting(piece, start, at) 
                if meet:
                    yield self._path(piece, start, meet)
                    del piece[:meet], start[:meet]
                    start = [max(x - meet, 0) for x in start]
                    if unigram:
                        del total[:meet]
                        total += [0.0] * meet
                    piece += [None] * meet
                    start += [0] * meet
                    done += meet
                    at -= meet
            if at + window >= len(piece):  # paths that haven't met for long
                piece += [None] * len(piece)
                start += [0] * len(start)
                if unigram:
                    total += [0.0] * len(total)
            node, i, key = trie.get(s[j]), at + 1, last * size
            if node is None or "" not in node:
                if unigram:
                    sum_ = total[at] + self.floor
                    if piece[i] is None or sum_ > total[i]:
                        piece[i], start[i], total[i] = -1 - ord(s[j]), at, sum_
                else:
                    piece[i], start[i] = -1 - ord(s[j]), at
            end = n - done
            while node is not None:
                if unigram:
                    if (found := node.get("")) is not None:
                        sum_ = total[at] + score[found]
                        if piece[i] is None or sum_ > total[i]:
                            piece[i], start[i], total[i] = found, at, sum_
                elif piece[i] is None and (found := node.get("")) is not None:
                    if last < 0 or (ok := follows.get(key + found)) or (ok is None and may_follow(last, found)):
                        piece[i], start[i] = found, at
                if i == end:
                    break
                node = node.get(s[i + done])
                i += 1
            if watch:
                watch(j, done, sum(x is not None for x in piece))
        yield self._path(piece, start, n - done)

    def _meeting(self, piece: list, start: list, at: int) -> int:
        """The last boundary that all paths into the boundaries from ``at`` on go through."""
        ends = {k for k in range(at, min(at + self.window + 1, len(piece))) if piece[k] is not None}
        while len(ends) > 1:
            top = max(ends)
            ends.discard(top)
            ends.add(start[top])
        return ends.pop()

    @staticmethod
    def _path(piece: list, start: list, end: int) -> list[int]:
        ids = []
        while end > 0:
            ids.append(piece[end])
            end = start[end]
        return ids[::-1]

    def segment_ids(self, segment: str) -> bytes:
        ids: list[int] = []
        found = self.search(segment.replace(" ", SPACE))
        if not found or min(found) >= 0:
            return array("i", found).tobytes()
        for i in found:
            if i >= 0:
                ids.append(i)
            elif self.byte:
                ids += [self.byte[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian int32 ids."""
        text = self.normal(text)
        if not text:
            return b""
        return b"".join(map(self.memo.__getitem__, self.segments.findall(self.prefix + text)))

    def normal(self, text: str) -> str:
        """The text that is encoded, and that its ids decode to; without the space put in front."""
        if self.normalizer is None:
            return text.replace(SPACE, " ")
        return self.normalizer.normalize(text).replace(SPACE, " ").removeprefix(self.prefix)

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Memo(dict):
    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, segment: str) -> bytes:
        ids = self.model.segment_ids(segment)
        if len(segment) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[segment] = ids
        return ids


def load(blob: bytes) -> PieceModel:
    """The model of these bytes, built once in each Python process."""
    key = hashlib.sha256(blob).digest()
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(blob)
    return _models[key]


def _ids_array(encoded: list[bytes | None]) -> pa.Array:
    sizes = np.array([len(e) // 4 if e else 0 for e in encoded], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(e for e in encoded if e), np.int32), pa.int32())
    none = [e is None for e in encoded]
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(none) if any(none) else None)


def encode_texts(df: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array<int>, null for null text) and ``n_tokens`` of each row. One narrow pass, no shuffle."""
    text_batches(df.sparkSession)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in slices(batches):
            got = [None if t is None else m.encode(t) for t in column(b, "_t")]
            n = pa.array([len(e) // 4 if e else 0 for e in got], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), _ids_array(got), n], [key, "ids", "n_tokens"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())])
    return df.select(F.col(key), F.col(text).alias("_t")).mapInArrow(run, schema)


def decode_ids(df: DataFrame, model: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` decoded from ``ids``; null ids give null text."""
    text_batches(df.sparkSession)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in slices(batches):
            got = pa.array([None if i is None else m.decode(i) for i in column(b, "_i")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), got], [key, "text"])

    return df.select(F.col(key), F.col(ids).alias("_i")).mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("text", T.StringType())]))


def encode_and_verify(df: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encoding with a proof: also ``round_trip``, whether the decoded ids give the text back (null for null text)."""
    text_batches(df.sparkSession)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in slices(batches):
            texts = column(b, "_t")
            got = [None if t is None else m.encode(t) for t in texts]
            n = pa.array([len(e) // 4 if e else 0 for e in got], pa.int32())
            same = [None if t is None else m.decode(np.frombuffer(e, np.int32).tolist()) == m.normal(t) for t, e in zip(texts, got)]
            yield pa.RecordBatch.from_arrays([b.column(0), _ids_array(got), n, pa.array(same, pa.bool_())], [key, "ids", "n_tokens", "round_trip"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())])
    return df.select(F.col(key), F.col(text).alias("_t")).mapInArrow(run, schema)
