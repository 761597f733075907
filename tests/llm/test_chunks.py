import random

from tidesignal.llm import chunks

PASSAGE = " ".join(f"passage{k}" for k in range(80))


def prose(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def plain_chunks(raw):
    """Chunks byte by byte: a gear hash in 32 bits, whose upper five bits decide."""
    out, begin, h, tops = [], 0, 0, []
    for k, byte in enumerate(raw):
        h = (2 * h + int(chunks._GEAR[byte])) % 2**32
        tops.append(h >> 27)
    for k in range(len(raw)):
        size = k + 1 - begin
        if size > chunks.MAX_CHUNK:  # no end among the last MAX_CHUNK places: the last place with three zero bits, or the limit
            places = [p for p in range(begin + chunks.MIN_CHUNK, begin + chunks.MAX_CHUNK + 1) if tops[p - 1] % 8 == 0]
            end = places[-1] if places else begin + chunks.MAX_CHUNK
            out.append((begin, end))
            begin, size = end, k + 1 - end
        if size >= chunks.MIN_CHUNK and tops[k] == 0:
            out.append((begin, k + 1))
            begin = k + 1
    return out + ([(begin, len(raw))] if begin < len(raw) else [])


def brute(rows):
    """Cuts from one table of the first document of each chunk's bytes."""
    first, cut = {}, {}
    raws = [(k, (t or "").encode(), t) for k, t in rows]
    for k, raw, _ in raws:
        for a, b in plain_chunks(raw):
            first[raw[a:b]] = min(first.get(raw[a:b], k), k)
    for k, raw, t in raws:
        gone, seen = [], set()
        for a, b in plain_chunks(raw):
            x = raw[a:b]
            if first[x] < k or x in seen:
                if gone and gone[-1][1] == a:
                    gone[-1][1] = b
                else:
                    gone.append([a, b])
            seen.add(x)
        left = raw
        for a, b in reversed(gone):
            if b - a >= chunks.MIN_RUN or b - a == len(raw):
                while a < len(raw) and 128 <= raw[a] < 192:
                    a += 1
                while b < len(raw) and 128 <= raw[b] < 192:
                    b -= 1
                left = left[:a] + left[b:]
        cut[k] = None if t is None else left.decode()
    return cut


def test_equals_one_table_of_digests(make_docs):
    r = random.Random(1)
    texts = [prose(r, r.choice([5, 50, 300])) for _ in range(40)]
    texts += [f"{prose(r, 40)} {PASSAGE} {prose(r, 40)}" for _ in range(20)]
    texts += [None, "", "é" * 3000, "日本" * 500, texts[0], "a" * 100_000, f"{PASSAGE} mid {PASSAGE}"]
    r.shuffle(texts)
    got = {x["doc_id"]: x["text"] for x in chunks.dedup(make_docs(texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_repeated_passage_stays_once(make_docs):
    r = random.Random(2)
    texts = [f"{prose(r, 60)} {PASSAGE} {prose(r, 60)}" for _ in range(9)]
    got = chunks.dedup(make_docs(texts)).orderBy("doc_id").collect()
    assert got[0]["text"] == texts[0]
    for x, t in zip(got[1:], texts[1:]):
        gone = b"".join(t.encode()[s["start"] : s["end"]] for s in x["dup_spans"])
        assert x["dup_bytes"] == len(gone) >= 0.8 * len(PASSAGE) and gone.decode().strip() in PASSAGE + " "
        assert len(x["text"]) >= len(t) - len(PASSAGE) - 2  # the text around it stays


def test_insertion_moves_only_near_borders():
    r = random.Random(3)
    raw = prose(r, 2000).encode()
    moved = raw[:1000] + b"inserted" + raw[1000:]
    a, b = (set(chunks._digests(x, chunks.chunk_ends(x))) for x in (raw, moved))
    assert len(a - b) <= 12


def test_chunks_cover_text():
    for raw in (b"", b"a", b"ab" * 9, bytes(5000), PASSAGE.encode()):
        ends = chunks.chunk_ends(raw)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(raw)
        assert all(b - a <= chunks.MAX_CHUNK for a, b in zip([0, *ends], ends))


def test_edges(make_docs):
    t = PASSAGE
    got = chunks.dedup(make_docs([(2, t, "s"), (1, t, "s"), (None, t, "s"), (3, None, "s"), (4, "", "s"), (2, t, "s")])).collect()
    assert sorted(((x["doc_id"], x["text"]) for x in got), key=str) == sorted([(1, t), (2, ""), (2, ""), (None, t), (3, None), (4, "")], key=str)
    assert chunks.dedup(make_docs([])).count() == 0


def test_only_chunks_that_are_cut_are_reported_and_clashing_columns_give_way(make_docs):
    """A phrase shorter than the shortest run marks nothing, whatever its chunks."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    docs = make_docs([f"{prose(r, 50)} {PASSAGE[:50]} {prose(r, 50)}" for _ in range(8)] + [f"{prose(r, 9)} {PASSAGE}", f"{PASSAGE} {prose(r, 9)}"])
    got = chunks.dedup(docs.withColumn("n_chunks", F.lit("own")).withColumn("_known", F.lit(1)).withColumn("_doc", F.lit(2))).orderBy("doc_id").collect()
    assert all(x["n_dup_chunks"] == 0 and not x["dup_spans"] for x in got[:9]) and got[9]["n_dup_chunks"] > 5 and got[9]["_doc"] == 2
    assert all(isinstance(x["n_chunks"], int) for x in got)


def test_borders_follow_content_where_no_chunk_ends():
    """A stretch without a regular end is cut at the same places after an insertion before it."""
    r = random.Random(6)
    pool = [b for b in range(97, 123)]
    raw = bytes(r.choice(pool) for _ in range(200))
    while len(raw) < 3000:  # grow only with bytes that end no chunk
        more = raw + bytes([r.choice(pool)])
        h = 0
        for byte in more[-32:]:
            h = (2 * h + int(chunks._GEAR[byte])) % 2**32
        raw = more if h >> 27 else raw
    a, b = (set(chunks._digests(x, chunks.chunk_ends(x))) for x in (raw, b"inserted" + raw))
    assert len(a - b) <= 4
