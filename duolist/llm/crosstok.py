"""Alignment of two tokenizers' tokens by anchors at white space.

Both tokenizers encode a whole text. Where a token of each ends at the same byte, and the next token of each is marked as starting
with a space, stands an anchor: between two anchors lies a window, a tuple of ids of either side, mostly those of one word. What
a window's ids have in common doesn't depend on where it stands, so windows are aligned once and remembered by their id tuples:
which tokens stand in which group (between places where both end), whether both sides spell the same bytes, and which pairs of ids
are linked. A document's alignment is its windows' put together, in the order of the text.

How many documents hold a pair of ids linked is counted over the whole corpus. The commonest pairs, of which there is a bounded
number, go to all tasks; documents are joined with the counts of the others.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from itertools import accumulate, chain
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolist.llm.bpe import byte_symbols
from duolist.llm.common import Batches, id_and_text, ids_of, materialise, record, texts
from duolist.llm.tokens import LibraryWords, Recent, cut_long, vocabulary_path

PIECES = "piece_bpe_32k.model"
#: How the piece vocabulary writes a space.
SPACE = "▁"
#: Bytes that a worker remembers of words, and of windows.
REMEMBER_WORDS, REMEMBER_WINDOWS = 160 << 20, 192 << 20
#: Bytes of a remembered window besides its ids, groups and pairs.
_ENTRY = 280
#: Links of a group beyond which its different ids are linked, each with how often it comes.
_LARGE = 4096
#: Characters of texts that are aligned at a time.
_AT_ONCE = 400_000
#: Pairs whose counts go to all tasks, at most (17 bytes each).
HOT_PAIRS = 1 << 20
#: Pairs that a task counts before it passes them on.
COUNT_AT_ONCE = 4_000_000


def pieces_path(path: str | None = None) -> str:
    """path, or where the public piece vocabulary lies on this machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(PIECES)
    return path


def _cut_at_blanks(text: str, size: int) -> list[str]:
    """Parts of text that begin with a single blank, but for the first: no piece reaches over such a place."""
    parts, at = [], 0
    while len(text) - at > size:
        k = at + size
        while (k := text.find(" ", k)) >= 0 and (text[k - 1].isspace() or text[k + 1 : k + 2].isspace() or k + 1 == len(text)):
            k += 1
        if k < 0:
            break
        parts.append(text[at:k])
        at = k
    parts.append(text[at:])
    return parts


#: Marks ids of B where they stand beside ids of A.
_MARK = np.uint32(1 << 31)


class Bytewise:
    """The byte-level tokenizer (A): the bytes of each id, which ids begin with a space, and ids of parts of texts."""

    def __init__(self, path: str):
        self.library = LibraryWords(path)
        self.library.library.encode_special_tokens = True  # strings of special tokens are plain text
        back = {c: b for b, c in byte_symbols().items()}
        entries = [self.library.library.id_to_token(i) or "" for i in range(self.library.library.get_vocab_size())]
        self.bytes = [bytes(back[c] for c in e) if all(c in back for c in e) else e.encode() for e in entries]
        self.spaced = np.array([b[:1] == b" " for b in self.bytes])

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with a space or line end, as 32-bit integers. ValueError if they don't spell the words."""
        out = self.library.words(words)
        if b"".join(map(self.bytes.__getitem__, np.frombuffer(b"".join(out), "<u4").tolist())) != "".join(words).encode():
            raise ValueError("the byte-level vocabulary doesn't spell its input")
        return out

    def text(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.library.texts(cut_long(text))), "<u4")


class Piecewise:
    """The piece tokenizer (B), in the same form; its ids are marked."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.spaced = np.array([b[:1] == b" " for b in self.bytes])
        self.skip = len(self.library.encode("\n"))  # the space that the library puts in front, and a line end
        self.blank = self.library.piece_to_id(SPACE)

    def words(self, parts: list[str]) -> list[bytes]:
        """Ids of each part as it stands within a text: the space that the library adds is the part's own first one, or taken off."""
        own = [p[1:] if p[:1] == " " else "\n" + p for p in parts]
        ids = [[self.blank] if p == " " else x if p[:1] == " " else x[self.skip :] for p, x in zip(parts, self.library.encode(own, num_threads=1), strict=True)]
        ends = [0, *accumulate(4 * len(x) for x in ids)]
        raw = (np.fromiter(chain.from_iterable(ids), np.uint32, ends[-1] // 4) | _MARK).astype("<u4").tobytes()
        return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def text(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.words(_cut_at_blanks(text, _AT_ONCE))), "<u4") ^ _MARK


def spread_out(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of all places in ranges that begin at start and hold count places."""
    of = np.repeat(np.arange(len(start)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count - start, count)


class Windows:
    """Alignments of windows, remembered by their ids as long as they fit into a bounded number of bytes."""

    def __init__(self, a: Bytewise, b: Piecewise, most_bytes: int = REMEMBER_WINDOWS):
        self.a, self.b, self.most = a, b, most_bytes
        # a token as it is written in front of another of its group, and as the last one of its side
        self.written = [f"{i}{mark}".encode() for size, marks in ((len(a.bytes), ",|"), (len(b.bytes), ",;")) for mark in marks for i in range(size)]
        self.a_size, self.b_size = (np.array([len(x) for x in side.bytes], np.int64) for side in (a, b))
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.size, self.text, self.sound = 0, [], bytearray()
        self.n_a, self.n_b, self.n_groups, self.n_links = (array("q") for _ in range(4))
        self.start, self.pair, self.times = array("q", [0]), array("q"), array("q")

    def add(self, keys: list[bytes]) -> None:
        """Align windows that aren't known, all at once, and remember them. A key is the ids of A, then the marked ids of B."""
        raw = np.frombuffer(b"".join(keys), "<u4")
        of_b = raw >= _MARK
        owner = np.repeat(np.arange(len(keys)), [len(k) // 4 for k in keys])
        a, b, own_a, own_b = raw[~of_b].astype(np.int64), (raw[of_b] ^ _MARK).astype(np.int64), owner[~of_b], owner[of_b]

        # both sides must spell the same bytes; other windows stay without groups
        sizes, other = (np.bincount(own, weights=size[ids], minlength=len(keys)).astype(np.int64) for own, size, ids in ((own_a, self.a_size, a), (own_b, self.b_size, b)))
        sound = (sizes == other) & (sizes > 0)
        a, b, own_a = a[sound[own_a]], b[sound[own_b]], own_a[sound[own_a]]
        spelt = [np.frombuffer(b"".join(map(side.bytes.__getitem__, ids.tolist())), np.uint8) for side, ids in ((self.a, a), (self.b, b))]
        lasts = np.cumsum(np.where(sound, sizes, 0))
        sound[np.searchsorted(lasts, np.flatnonzero(spelt[0] != spelt[1]), side="right")] = False

        # groups lie between places where tokens of both sides end
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at = np.searchsorted(end_b, end_a)
        both = np.flatnonzero(end_b[np.minimum(at, len(end_b) - 1)] == end_a)
        stop_a, stop_b, window = both + 1, at[both] + 1, own_a[both]
        start_a, start_b = np.r_[0, stop_a[:-1]], np.r_[0, stop_b[:-1]]
        n_a, n_b = stop_a - start_a, stop_b - start_b
        count = np.bincount(window, minlength=len(keys))
        cuts = np.r_[0, np.cumsum(count)]  # groups of each window
        of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)

        # the text: a group's ids of A, then of B
        total = n_a + n_b
        base = np.cumsum(total) - total
        code = np.empty(int(total.sum()), np.int64)
        in_a, in_b = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) for of, n in ((of_a, n_a), (of_b, n_b)))
        wide_a, wide_b = len(self.a.bytes), len(self.b.bytes)
        code[base[of_a] + in_a] = a + np.where(in_a == n_a[of_a] - 1, wide_a, 0)
        code[base[of_b] + n_a[of_b] + in_b] = b + 2 * wide_a + np.where(in_b == n_b[of_b] - 1, wide_b, 0)
        written, ends = list(map(self.written.__getitem__, code.tolist())), np.r_[0, np.cumsum(total)][cuts].tolist()
        text = [b"".join(written[i:j]) for i, j in zip(ends, ends[1:], strict=False)]

        # the links: each id of A with each of B
        links = n_a * n_b
        if (large := links > _LARGE).any():
            pair, times, per = self._by_different_ids([a[i:j] for i, j in zip(start_a, stop_a, strict=True)], [b[i:j] for i, j in zip(start_b, stop_b, strict=True)], large)
        else:
            of, k = spread_out(np.zeros(len(links), np.int64), links)
            pair = a[start_a[of] + k // n_b[of]] * wide_b + b[start_b[of] + k % n_b[of]]
            times, per = np.ones(len(pair), np.int64), links
        per = np.bincount(window, weights=per, minlength=len(keys)).astype(np.int64)

        place = len(self.text)
        self.place.update(zip(keys, range(place, place + len(keys)), strict=True))
        self.text += text
        self.sound += sound.tobytes()
        for held, of, n in ((self.n_a, window, n_a), (self.n_b, window, n_b), (self.n_links, window, links), (self.n_groups, window, np.ones(len(window)))):
            held.frombytes(np.bincount(of, weights=n, minlength=len(keys)).astype(np.int64).tobytes())
        self.start.frombytes((self.start[-1] + np.cumsum(per)).tobytes())
        self.pair.frombytes(pair.astype(np.int64).tobytes())
        self.times.frombytes(times.tobytes())
        self.size += _ENTRY * len(keys) + sum(map(len, keys)) + sum(map(len, text)) + 16 * len(pair)

    def _by_different_ids(self, a: list[np.ndarray], b: list[np.ndarray], large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, how often each is linked, pairs of each group), where some groups have very many tokens on both sides."""
        pair, times = [], []
        for x, y, many in zip(a, b, large.tolist(), strict=True):
            (x, nx), (y, ny) = (np.unique(z, return_counts=True) if many else (z, np.ones(len(z), np.int64)) for z in (x, y))
            pair.append((x[:, None] * len(self.b.bytes) + y).ravel())
            times.append((nx[:, None] * ny).ravel())
        return np.concatenate(pair), np.concatenate(times), np.array([len(p) for p in pair])


def _joined(first: bytes, second: bytes) -> bytes:
    """The key of two stretches of ids put together."""
    a, b = (k[: 4 * int((np.frombuffer(k, "<u4") < _MARK).sum())] for k in (first, second))
    return a + b + first[len(a) :] + second[len(b) :]


class Aligner:
    """Aligns texts one batch after the other."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Bytewise(a_path), Piecewise(b_path)
        self.words, self.windows = Recent(REMEMBER_WORDS), Windows(self.a, self.b)

    def _compute(self, parts: list[str]) -> list[bytes]:
        """The key of each word: ids of A and of B."""
        own = [p if p[:1] == "\n" else " " + p for p in parts]
        return list(map(add, self.a.words(own), self.b.words(own)))

    def _by_words(self, texts: list[str]) -> list[list[bytes] | None]:
        """The windows' keys of each text, which begins with a space; None if white space stands together or at the ends.

        Otherwise tokens of both sides end in front of every space and line end, and a token that begins with the space follows,
        so a window is what lies between two spaces. Words are remembered.
        """
        self.words.turn()
        get, out, new = self.words.young.get, [], set()
        for text in texts:
            lines = text[1:].split("\n")
            parts = [p for k, line in enumerate(lines) for p in (("\n" + line) if k else line).split(" ")]
            got = list(map(get, parts))
            missing = {i: parts[i] for i, x in enumerate(got) if x is None}
            # white space inside of a remembered word was looked at when it was new
            if any(p in ("", "\n") or p[p[0] == "\n"].isspace() for p in missing.values()) or SPACE in text:
                out.append(None)
                continue
            new.update(missing.values())
            glued = list(accumulate(line.count(" ") + 1 for line in lines))[:-1]
            out.append((got, missing, glued))
        found = self.words.look(new, self._compute)
        for k, own in enumerate(out):
            if own is not None:
                keys, missing, glued = own
                for i, p in missing.items():
                    keys[i] = found[p]
                for i in reversed(glued):  # what a line end begins goes to the window before it
                    keys[i - 1 : i + 1] = [_joined(keys[i - 1], keys[i])]
                out[k] = keys
        return out

    def _by_tokens(self, text: str) -> list[bytes] | None:
        """The windows' keys of any text that begins with a space; None if the tokens of either side don't spell it."""
        a, b, raw = self.a.text(text), self.b.text(text), text.encode()
        if any(b"".join(map(side.bytes.__getitem__, ids.tolist())) != raw for side, ids in ((self.a, a), (self.b, b))):
            return None
        end_a, end_b = np.cumsum(self.windows.a_size[a]), np.cumsum(self.windows.b_size[b])
        at = np.searchsorted(end_b, end_a)
        shared = np.flatnonzero(end_b[at] == end_a)
        anchor = np.append(self.a.spaced[a[1:]], True)[shared] & np.append(self.b.spaced[b[1:]], True)[at[shared]]
        stop_a, stop_b = (4 * (shared[anchor] + 1)).tolist(), (4 * (at[shared[anchor]] + 1)).tolist()
        raw_a, raw_b = a.tobytes(), (b | _MARK).tobytes()
        return [raw_a[i:j] + raw_b[k:n] for i, j, k, n in zip([0, *stop_a], stop_a, [0, *stop_b], stop_b, strict=False)]

    def _places(self, keys: list[bytes]) -> np.ndarray:
        place = self.windows.place
        slots = list(map(place.get, keys))
        if missing := [i for i, s in enumerate(slots) if s is None]:
            self.windows.add(list({keys[i]: None for i in missing}))
            for i in missing:
                slots[i] = place[keys[i]]
        return np.array(slots, np.int64)

    def align(self, batch: list[str], with_groups: bool = False) -> dict[str, list]:
        """Columns n_a, n_b, n_groups, n_links, groups_sha256, pairs (packed) and groups of each text.

        Texts without tokens, or whose tokens don't spell a space and the text, have zeros and nothing.
        """
        w = self.windows
        w.size > w.most and w.forget()
        numbers = ("n_a", "n_b", "n_groups", "n_links")
        out = {c: [0] * len(batch) for c in numbers} | {"groups_sha256": [""] * len(batch), "pairs": [pack(np.empty(0, np.int64), np.empty(0, np.int64))] * len(batch), "groups": [""] * len(batch)}
        parts = [(i, p) for i, t in enumerate(batch) if t for p in _cut_at_blanks(" " + t, _AT_ONCE)]
        held: dict[int, list[list[bytes] | None]] = {}
        for (i, _), keys in zip(parts, self._by_words([p for _, p in parts]), strict=True):
            held.setdefault(i, []).append(keys)
        pairs = [(i, self._by_tokens(" " + batch[i]) if None in own else own[0] if len(own) == 1 else list(chain.from_iterable(own))) for i, own in held.items()]
        pairs = [(i, keys) for i, keys in pairs if keys]
        if not pairs:
            return out
        slots = self._places(list(chain.from_iterable(k for _, k in pairs)))
        bounds = np.r_[0, np.cumsum([len(k) for _, k in pairs])]
        # views of arrays that grow again are taken for one expression only
        sums = {c: np.add.reduceat(np.frombuffer(getattr(w, c), np.int64)[slots], bounds[:-1]) for c in numbers}
        of = np.repeat(np.arange(len(pairs)), np.diff(bounds))
        good = np.bincount(of[np.frombuffer(w.sound, np.uint8)[slots] == 0], minlength=len(pairs)) == 0
        packed = self._pairs(slots, of, len(pairs))
        named = slots.tolist()
        for k in np.flatnonzero(good).tolist():
            i, text = pairs[k][0], b"".join(map(w.text.__getitem__, named[bounds[k] : bounds[k + 1]]))[:-1]
            for c in numbers:
                out[c][i] = int(sums[c][k])
            out["groups_sha256"][i], out["pairs"][i] = hashlib.sha256(text).hexdigest(), packed[k]
            if with_groups:
                out["groups"][i] = text.decode()
        return out

    def _pairs(self, slots: np.ndarray, of: np.ndarray, n: int) -> list[bytes]:
        """Each text's different pairs and how often it holds each, packed."""
        w = self.windows
        start, stop = (np.frombuffer(w.start, np.int64)[x] for x in (slots, slots + 1))
        many = stop - start
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
        span = len(self.a.bytes) * len(self.b.bytes)
        key, t = np.repeat(of, many) * span + np.frombuffer(w.pair, np.int64)[at], np.frombuffer(w.times, np.int64)[at]
        if (t == 1).all():
            key, t = np.unique(key, return_counts=True)
        else:
            key, back = np.unique(key, return_inverse=True)
            t = np.bincount(back, weights=t).astype(np.int64)
        text, key = np.divmod(key, span)
        cuts = np.searchsorted(text, np.arange(n + 1))
        return [pack(key[i:j], t[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pairs, as differences, and how often each comes, compressed."""
    steps = np.diff(pairs, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return _PACK.compress(steps + times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(_UNPACK.decompress(raw), np.uint8)
    n = len(both) // 12
    steps = np.ascontiguousarray(both[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps.astype(np.int64)), np.ascontiguousarray(both[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str | None = None, b_path: str | None = None) -> Aligner:
    """The aligner of two vocabulary files, made once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (vocabulary_path(a_path), pieces_path(b_path))
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _aligned(a_path: str | None, b_path: str | None, with_groups: bool):
    def run(batches: Batches) -> Batches:
        own = aligner(a_path, b_path)
        for batch in batches:
            ids, held = ids_of(batch), texts(batch.column(1))
            at = end = size = 0
            while at < len(held):
                while end < len(held) and (size < _AT_ONCE or end == at):
                    size += len(held[end])
                    end += 1
                found = own.align(held[at:end], with_groups)
                numbers = {c: pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
                more = {"groups": pa.array(found["groups"], pa.string())} if with_groups else {}
                yield record(doc_id=ids.slice(at, end - at), **numbers, groups_sha256=pa.array(found["groups_sha256"], pa.string()), pairs=pa.array(found["pairs"], pa.binary()), **more)
                at, size = end, 0

    return run


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs[, groups]) of every whole text.

    groups names A and B ids between places where tokens of both end: `a1,a2|b1;a3|b2,b3`; pairs packs the different linked id
    pairs with how often they come. Null and empty texts, and those whose tokens of either side don't spell a space and the text,
    have zeros and nothing; null and repeated doc_ids and repeated rows are aligned like any other; other columns aren't read; an
    empty table gives an empty table. Nothing is shuffled.
    """
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary" + ", groups string" * with_groups
    return id_and_text(docs, id_col, text_col).mapInArrow(_aligned(a_path, b_path, with_groups), schema)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, a, b, n, best): in how many rows of align() a pair of ids is linked, and whether no pair of the same A id is in more.

    width: how many B ids there are; pair is a * width + b.
    """

    def run(batches: Batches) -> Batches:
        pair, n = np.empty(0, np.int64), np.empty(0, np.int64)
        held, size = [], 0

        def merged() -> None:
            nonlocal pair, n, held, size
            own, times = np.unique(np.concatenate([pair[:0], *held]), return_counts=True)
            every, back = np.unique(np.concatenate([pair, own]), return_inverse=True)
            pair, n, held, size = every, np.bincount(back, weights=np.concatenate([n, times]), minlength=len(every)).astype(np.int64), [], 0

        for batch in batches:
            for raw in batch.column(0):
                own = unpack(raw.as_py())[0]
                held.append(own)
                size += len(own)
                if size > COUNT_AT_ONCE:
                    merged()
                    if len(pair) > COUNT_AT_ONCE:
                        yield record(pair=pair, n=n)
                        pair, n = pair[:0], n[:0]
        merged()
        if len(pair):
            yield record(pair=pair, n=n)

    counted = aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialise(counted.select("pair", F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "n"), "pair-counts")
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def score(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot_pairs: int = HOT_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): align() with each document's links weighed.

    A pair's count is in how many documents of the corpus it is linked. n_best counts the links whose pair has the highest count
    of its A id; count_sum sums the counts over all links. hot_pairs bounds what goes to all tasks, and changes no result.
    """
    width = _pieces(b_path)
    aligned = materialise(align(docs, a_path, b_path, False, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(aligned, width), "weighed-pairs")
    # the commonest pairs, by powers of two, as far as they fit
    power = F.floor(F.log2("n")).cast("int")
    least, held = 63, 0
    bins = sorted(counts.groupBy(power.alias("p")).count().collect(), reverse=True)  # one row for each power of two at most
    for p, n in bins:
        if held + n > hot_pairs:
            break
        least, held = p, held + n
    hot = counts.where(power >= least).select("pair", "n", "best").toArrow().sort_by("pair")
    table = docs.sparkSession.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Batches) -> Batches:
        pair, n, best = table.value
        for batch in batches:
            n_best, total, rest, times = [], [], [], []
            for raw in batch.column(batch.schema.get_field_index("pairs")):
                own, t = unpack(raw.as_py())
                at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
                known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                at = at[known]
                n_best.append(int(t[known][best[at]].sum()))
                total.append(int((t[known] * n[at]).sum()))
                rest.append(own[~known])
                times.append(t[~known])
            keep = {c: batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            yield record(**keep, n_best=pa.array(n_best, pa.int64()), count_sum=pa.array(total, pa.int64()), rest=pa.array(rest, pa.list_(pa.int64())), times=pa.array(times, pa.list_(pa.int64())))

    columns = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    weighed = aligned.mapInArrow(run, columns + ", rest array<long>, times array<long>")
    if held < sum(n for _, n in bins):
        weighed = materialise(weighed, "weighed")
        cold = weighed.select("row", F.explode(F.arrays_zip("rest", "times")).alias("p")).select("row", F.col("p.rest").alias("pair"), F.col("p.times").alias("t"))
        sums = cold.join(counts.where(power < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more"))
        weighed = weighed.join(sums, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _pieces(b_path: str | None) -> int:
    """How many ids the piece vocabulary has."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces_path(b_path)).get_piece_size()
