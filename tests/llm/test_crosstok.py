import hashlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duolist.llm import crosstok
from duolist.llm.bpe import byte_symbols
from tests.llm import edge

PIECES = st.lists(st.sampled_from([*"aAéß北 \n\t\r\x0b\x85\xa0　'1½.,!|\0▁ﬁ", "<|endoftext|>", "<s>", "<0x41>", "'ll", "  ", "\n\n", " the", " \n", "\n ", " word", "running", " éclair", "...", "=====", "ｆｕｌｌ"]), max_size=20).map("".join)


class Plain:
    """Both libraries on whole texts, groups by going over the bytes."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.back = {c: b for b, c in byte_symbols().items()}

    @cache
    def of_a(self, i):
        return bytes(self.back[c] for c in self.a.id_to_token(i))

    @cache
    def of_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        xs, ys = [self.of_a(i) for i in a], [self.of_b(i) for i in b]
        if not b"".join(xs) == b"".join(ys) == (" " + text).encode():
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in xs]).tolist(), np.cumsum([len(y) for y in ys]).tolist()
        out, i, j = [], 0, 0
        after_a, after_b = ({end: k + 1 for k, end in enumerate(ends)} for ends in (ends_a, ends_b))
        for end in sorted(after_a.keys() & after_b.keys()):
            p, q = after_a[end], after_b[end]
            out.append((a[i:p], b[j:q]))
            i, j = p, q
        return out


PLAIN = Plain()


def plain_rows(rows):
    held = [(d, PLAIN.groups(t)) for d, t, _ in rows]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for _, g in held]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (d, g), c in zip(held, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((d, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4))
def test_alignment_is_that_of_whole_texts(batch):
    got = crosstok.aligner().align(batch, with_groups=True)
    for i, text in enumerate(batch):
        want = PLAIN.groups(text) or []
        named = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
        assert got["groups"][i] == named and got["n_groups"][i] == len(want)
        assert got["n_links"][i] == sum(len(a) * len(b) for a, b in want)
        pair, times = crosstok.unpack(got["pairs"][i])
        links = Counter(x * 32_000 + y for a, b in want for x in a for y in b)
        assert dict(zip(pair.tolist(), times.tolist(), strict=True)) == links


@settings(max_examples=200, deadline=None)
@given(PIECES, st.sampled_from([1, 5, 30]))
def test_parts_that_are_cut_at_blanks_keep_their_ids(text, size):
    own = crosstok.aligner().b
    parts = crosstok._cut_at_blanks(" " + text, size)
    assert "".join(parts) == " " + text
    marked = np.frombuffer(b"".join(own.words(parts)), "<u4")
    assert (marked ^ crosstok._MARK).tolist() == (PLAIN.b.encode(text) if text else [own.blank])


def test_forgotten_windows_change_nothing():
    own = crosstok.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    data = [edge.text(i, 300) for i in range(20)]
    want = [own.align([t]) for t in data]
    own.windows.most = 1
    assert [own.align([t]) for t in data] == want


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_scores_equal_brute_force(spark, hot):
    rows = edge.rows() + [(400, "ﬁne ligatures", "en"), (401, "a▁b", "en"), (402, "ｆｕｌｌ width", "en"), (403, "<|endoftext|> is text here", "en"), (404, "=" * 5000, "en"), (405, "北京" * 3000, None), (406, " two  blanks\n\nand\tmore ", "en"), (406, " two  blanks\n\nand\tmore ", "en")]
    got = crosstok.score(edge.documents(spark, rows), hot_pairs=hot)
    assert sorted(map(tuple, got.collect()), key=str) == plain_rows(rows)


def test_empty_table(spark):
    assert crosstok.score(edge.nothing(spark)).count() == 0
    assert crosstok.score(edge.documents(spark, [(1, None, None), (2, "", "en")])).where("n_a = 0 and n_links = 0 and count_sum = 0 and groups_sha256 = ''").count() == 2


def test_pairs_are_packed_and_unpacked():
    for n in (0, 1, 5000):
        pair = np.unique(np.random.default_rng(n).integers(0, 2**40, n))
        times = np.arange(1, len(pair) + 1)
        assert all((x == y).all() for x, y in zip(crosstok.unpack(crosstok.pack(pair, times)), (pair, times), strict=True))
