import sentencepiece
import pytest

from tidesignal.llm import pieces
from tidesignal.llm.queries import PIECE_MODEL, piece_model

ODD = ["", " ", "  a  b ", "\n\n", "a\tb", "é日本語 text", "▁ mark", "x" * 5000, "ab." * 3000, "😀😀", "Hello, world!  Numbers 123,456.", "\u0000z", "ａｂｃ", "été " * 400, "aaaaabaaaaab" * 200, "m². x½, ①.", "naïve. été, ab.c,d"]


@pytest.fixture(scope="module")
def model():
    return pieces.load(piece_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def as_list(raw):
    import numpy as np

    return np.frombuffer(raw, np.int32).tolist()


def test_equals_the_library_on_odd_texts(model, library):
    for t in ODD:
        assert as_list(model.encode(t)) == library.encode(t), t[:40]


def test_equals_the_library_on_documents(spark, small, model, library):
    texts = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").where("text is not null").select("text").collect()]
    assert [as_list(model.encode(t)) for t in texts] == library.encode(texts, num_threads=1)


def test_search_commits_on_the_way_and_holds_few_boundaries(spark, small, model, monkeypatch):
    """Over whole documents as one segment each: most ids are given out before the end, from a window of few boundaries."""
    texts = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 400").select("text").limit(40).collect()]
    given = late = most = 0
    for t in [*texts, "日本語の文章です。" * 300, "abcdefg" * 300, "internationalization" * 80]:
        far = [0]
        parts = list(model.stream("▁" + t.replace(" ", "▁"), lambda j, done, held: far.append(max(held, j + 1 - done))))
        assert max(far) <= 3 * model.window
        most = max(most, *far)
        given += sum(map(len, parts[:-1]))
        late += len(parts[-1])
    assert given > 50 * late and most > 2


def test_every_segment_goes_through_the_search(spark, small, monkeypatch):
    fresh, calls = pieces.PieceModel(piece_model()), []
    real = fresh.stream
    monkeypatch.setattr(fresh, "stream", lambda s, watch=None: calls.append(s) or real(s, watch))
    texts = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").where("text is not null").select("text").limit(50).collect()]
    segments = {x for t in texts for x in fresh.segments.findall(fresh.prefix + t)}
    for t in texts:
        fresh.encode(t)
    assert {c.replace("▁", " ") for c in calls} == segments


def test_model_with_a_normaliser(library):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(piece_model())
    proto.normalizer_spec.remove_extra_whitespaces = True
    other = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model = pieces.PieceModel(proto.SerializeToString())
    for t in ["  a  b ", "", "   ", "one  two", "x"]:
        assert as_list(model.encode(t)) == other.encode(t), t


def test_unigram_streaming_equals_full_lattice(model):
    s = "▁thequickbrownfox" * 120
    whole = pieces.PieceModel(piece_model())
    whole.kind = pieces.UNIGRAM
    best = {0: (0.0, 0, None)}
    for j in range(len(s)):
        for i in range(j + 1, min(len(s), j + whole.window) + 1):
            piece = whole.ids.get(s[j:i])
            if piece is not None and j in best and (i not in best or best[j][0] + whole.score[piece] > best[i][0]):
                best[i] = (best[j][0] + whole.score[piece], j, piece)
    path, k = [], len(s)
    while k:
        path.append(best[k][2])
        k = best[k][1]
    got = whole.search(s)
    assert sum(whole.score[p] for p in got) == pytest.approx(sum(whole.score[p] for p in path))
    assert "".join(whole.text[p] for p in got) == s


def test_frames(make_docs, model):
    rows = {r["doc_id"]: r for r in pieces.encode_and_verify(make_docs([None, *ODD]), piece_model()).collect()}
    assert rows[0]["ids"] is None and rows[0]["n_tokens"] == 0 and rows[0]["round_trip"] is None
    assert rows[1]["ids"] == [] and all(rows[k]["round_trip"] for k in range(1, len(ODD) + 1))
    back = {r["doc_id"]: r["text"] for r in pieces.decode_ids(pieces.encode_texts(make_docs([None, *ODD]), piece_model()), piece_model()).collect()}
    assert back == {k: t if t is None else t.replace("▁", " ") for k, t in enumerate([None, *ODD])}
    assert pieces.encode_texts(make_docs([]), piece_model()).count() == 0
