import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duolist.llm import bpe, packing, tokenfile, tokens
from tests.llm import edge

PIECES = st.lists(st.sampled_from([*"aAéß北 \n\t\r\x0b\x1c\x85\xa0\u3000'1½.,!|\0", "<|endoftext|>", "'ll", "  ", "\n\n", " the", " \n", "\n "]), max_size=16).map("".join)


@pytest.fixture(scope="module")
def library():
    return tokens.tokenizer()


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_ids_are_the_librarys(text):
    library = tokens.tokenizer()
    want = library.encode(text, add_special_tokens=False).ids
    assert next(tokens.encode_all([text])).tolist() == want
    assert bpe.codec().encode(text).tolist() == want
    assert bpe.codec().decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_texts_are_cut_where_ids_stay(library):
    long = edge.text(5, 3000)
    assert len(tokens.cut_long(long, 1000)) > 5
    assert [i for p in tokens.cut_long(long, 1000) for i in plain(library, p)] == plain(library, long)
    assert tokens.cut_long("x" * 5000, 1000) == ["x" * 5000]


def test_broken_ids_decode_like_the_library(library):
    for ids in ([171], [171, 120, 50256, 13], list(range(200, 260))):
        assert bpe.codec().decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_operator(spark, library):
    got = bpe.digests(bpe.decode(bpe.encode(edge.documents(spark)))).collect()
    assert sorted(got, key=str) == sorted(bpe.digests(bpe.encode(edge.documents(spark), decoded=True)).collect(), key=str)
    want = []
    for doc, text, _ in edge.rows():
        ids = plain(library, text)
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(bpe.decode(bpe.encode(edge.nothing(spark)))).count() == 0


def test_packing(spark, library):
    got = packing.pack(edge.documents(spark), capacity=64, with_ids=True).collect()
    pieces = {}
    for r in got:
        assert 0 < r.length <= 64 and len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append(r)
    for doc, text, _ in edge.rows():
        if doc not in (None, 3):  # those come twice
            own = sorted(pieces[doc], key=lambda r: r.start)
            assert [i for r in own for i in r.ids] == [*plain(library, text), 1]
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and {r.doc_tokens for r in own} == {len(plain(library, text)) + 1}
    assert sum(r.length for r in got) == sum(len(plain(library, t)) + 1 for _, t, _ in edge.rows())
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 64 and sorted(by) == list(range(len(by))) and sum(by.values()) / 64 / len(by) > 0.97
    assert packing.pack(edge.nothing(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), min_size=1, max_size=12))
def test_plan_places_all_and_fills_best(histogram):
    left = dict(histogram)
    for fill, times in packing.plan(histogram, 30):
        room, first = 30, max(left)
        reach = {first}
        for length, n in left.items():
            for _ in range(n - (length == first)):
                reach |= {s + length for s in reach if s + length <= room}
        assert sum(k * n for k, n in fill.items()) == max(reach)  # no multiset with the largest length fills more
        for length, n in fill.items():
            left[length] -= n * times
        assert min(left.values()) >= 0
        left = {k: n for k, n in left.items() if n}
    assert not left


@pytest.mark.parametrize("bits", [False, True])
def test_token_file(spark, library, tmp_path, bits):
    got = tokenfile.round_trip(edge.documents(spark), f"file://{tmp_path}/t", bits=bits, shard_ids=5000, block=512).collect()
    data = sorted(edge.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for doc, text, _ in data:
        ids = np.array([*plain(library, text), 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    back = tokenfile.read_tokens(spark, f"file://{tmp_path}/t").collect()
    assert sum(len(r.ids) for r in back) == start and len({(r.part, r.number) for r in back}) > 1


def test_token_file_of_nothing(spark, tmp_path):
    assert tokenfile.round_trip(edge.nothing(spark), f"file://{tmp_path}/t").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50), st.booleans())
def test_planes_come_back(ids, bits):
    a = np.array(ids, np.uint32)
    planes = tokenfile.to_planes(a, bits)
    assert tokenfile.from_planes(planes, len(a), bits).tolist() == ids
    shard = tokenfile.write_shard(3, 4, [7, None], [a, a[:1]], bits, 16)
    part, number, doc_ids, back = tokenfile.read_shard(shard + b"\n")
    assert (part, number, doc_ids) == (3, 4, [7, None]) and [x.tolist() for x in back] == [ids, ids[:1]]


def _bytes_held(memory):
    import sys

    return sum(sys.getsizeof(g) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in g.items()) for g in (memory.known.young, memory.known.old))


@pytest.mark.parametrize("kind", ["words", "chinese", "base64"])
def test_memory_is_bounded_in_bytes(library, kind):
    """Whatever stands between blanks, what a worker remembers stays below its bound, and ids stay the library's."""
    lines = tokens.LibraryWords(tokens.vocabulary_path())
    bound = 4 << 20
    memory = tokens.WordMemory(lines.words, lines.texts, ["<|endoftext|>"], bound)
    rng, most, seen = np.random.default_rng(5), 0, 0
    for _ in range(12):
        if kind == "words":
            texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(150)) for _ in range(60)]
        elif kind == "chinese":
            texts = ["\n".join("".join(map(chr, rng.integers(0x4E00, 0x9FA0, 400))) for _ in range(10)) for _ in range(20)]
        else:
            texts = [" ".join(hashlib.sha256(rng.bytes(8)).hexdigest() * 3 for _ in range(20)) for _ in range(40)]
        seen += sum(len(t.encode()) for t in texts)
        got = [x.tolist() for x in memory.all(texts)]
        assert got[::7] == [plain(library, t) for t in texts[::7]]
        most = max(most, _bytes_held(memory))
    assert most < bound + (1 << 20) and seen > (bound // 8)
    if kind != "words":
        assert len(memory.known.young) < 5  # long parts aren't remembered


def test_one_very_long_text_goes_part_by_part(library, monkeypatch):
    monkeypatch.setattr(tokens, "_AT_ONCE", 300)
    monkeypatch.setattr(tokens.cut_long, "__defaults__", (300,))
    for long in (edge.text(4, 2000), "。".join(["北京是中国的首都"] * 200), "a, b. c  d\n" * 300, "x" * 4000, "it's, we'll. " * 200 + "<|endoftext|>" + " tail" * 200):
        assert next(tokens.encode_all([long])).tolist() == plain(library, long)


def test_words_are_merged_once_whatever_the_blanks(library):
    codec, merged = bpe.Codec(), []
    merge = codec.merge
    codec.merge = lambda word: merged.append(word) or merge(word)
    texts = [f"  one  two{'  ' * (i % 3)}\n\n\tthree, don't  four {'  five' * i}\n" for i in range(20)]
    for text in texts:
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(merged) == len(set(merged))


def test_one_id_with_most_rows_is_no_single_task(spark, tmp_path):
    """Four fifths of the rows share a null id, half of them with the same text: all tasks write, and starts have no gaps."""
    data = [(None if i % 5 else i, "same text here" if i % 2 else edge.text(i, 5), "en") for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would make one task
    try:
        tokenfile.write_tokens(edge.documents(spark, data).repartition(4), f"file://{tmp_path}/x")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = tokenfile.with_starts(tokenfile.read_tokens(spark, f"file://{tmp_path}/x", digests=True)).collect()
    parts = [r.part for r in rows]
    assert len(rows) == 2000 and max(map(parts.count, set(parts))) < 1000
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
