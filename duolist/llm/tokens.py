"""Token ids of whole texts by the tokenizers library, in bounded memory.

Texts are looked at part by part: wherever a blank or a line end stands alone between other characters, the vocabulary's
pre-tokenizer starts a new word, so ids of what lies between are the same in every text. A worker remembers them and asks the
library for new ones only, many at a time. Its memory is bounded in bytes whatever the texts are: parts of more than a few
characters aren't remembered, and of the others only what was seen lately.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: Characters that are worked on at a time; longer texts are cut where that can't change their ids.
_AT_ONCE = 500_000
#: Bytes that the parts remembered by a worker take at most, counted with their ids and their places in the table.
REMEMBER_BYTES = 160 << 20
#: Characters of a part that is remembered, at most.
REMEMBER_SIZE = 64
#: Bytes of an entry besides its characters and ids: two objects and a place in the table.
_ENTRY = 216
#: Where a text can be cut: before a single blank, or between a letter or numeral and a mark that starts no contraction.
_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=[^\W_])(?=[,.;:!?。、，；：！？])")
_loaded: dict[str, object] = {}

Encode = Callable[[list[str]], list[bytes]]


def vocabulary_path(path: str | None = None) -> str:
    """path, or where the public vocabulary lies on this machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return path


def cut_long(text: str, size: int = _AT_ONCE) -> list[str]:
    """Parts of text whose ids, put together, are those of text."""
    parts, at = [], 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        parts.append(text[at : m.start()])
        at = m.start()
    parts.append(text[at:])
    return parts


class Recent:
    """What was computed for strings, as far as it was asked for lately.

    Entries lie in two generations. A new or found one goes to the young generation; once that takes half of the bytes allowed,
    the old one is dropped and the young one becomes it. So what is common stays, and the size is bounded in bytes.
    """

    def __init__(self, most_bytes: int = REMEMBER_BYTES, longest: int = REMEMBER_SIZE):
        self.most, self.longest = most_bytes, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def turn(self) -> None:
        """To be called between batches: starts a new generation where the young one is full."""
        if self.size > self.most // 2:
            self.old, self.young, self.size = self.young, {}, 0

    def look(self, keys: set[str], compute: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """Values of keys that aren't in the young generation; those that nobody knows are computed."""
        found = dict(zip(keys, map(self.old.get, keys), strict=True))
        new = [k for k, v in found.items() if v is None]
        found.update(zip(new, compute(new), strict=True))
        kept = {k: v for k, v in found.items() if len(k) <= self.longest}
        self.young.update(kept)
        self.size += len(kept) * _ENTRY + sum(len(k) if k.isascii() else 4 * len(k) for k in kept) + sum(map(len, kept.values()))
        return found


def _starts_blank(part: str) -> bool:
    """Whether more white space than one line end stands at the start; such parts are never remembered."""
    rest = part[1:2] if part[:1] == "\n" else part[:1]
    return rest.isspace()


class WordMemory:
    """Ids of whole texts as little-endian 32-bit integers.

    words: gives the ids of each of a list of parts, which start with a blank or a line end and hold no other of either.
    texts: gives the ids of each of a list of texts.
    cut: gives parts of a text whose ids, put together, are those of the text.
    """

    def __init__(self, words: Encode, texts: Encode, special: list[str], most_bytes: int = REMEMBER_BYTES, cut: Callable[[str, int], list[str]] = cut_long):
        self.texts, self.special, self.known, self.cut = texts, special, Recent(most_bytes), cut
        self.compute = lambda parts: words([p if p[:1] == "\n" else " " + p for p in parts])
        self.line_end = len(words(["\n"])[0])

    def _group(self, texts: list[str]) -> list[bytes]:
        self.known.turn()
        get, split, new = self.known.young.get, [], set()
        for text in texts:
            # a part that starts with a line end stands for itself, any other for itself behind a blank
            marked = "\n" + text.replace("\n", " \n")
            parts = marked.split(" ")
            got = list(map(get, parts))
            missing = {i: parts[i] for i, x in enumerate(got) if x is None}
            if "  " in marked or marked.find("\n ", 1) > 0 or marked[-1] == " " or any(map(_starts_blank, missing.values())) or any(x in text for x in self.special):
                split.append((None, text))
            else:
                split.append((got, missing))
                new.update(missing.values())
        found, out = self.known.look(new, self.compute), []
        for got, rest in split:
            if got is None:
                out.append(b"".join(b for part in self.cut(rest, _AT_ONCE) for b in self.texts([part])))
                continue
            for i, p in rest.items():
                got[i] = found[p]
            out.append(b"".join(got)[self.line_end :])
        return out

    def all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text as uint32, in order."""
        at, end, size = 0, 0, 0
        while at < len(texts):
            while end < len(texts) and (size < _AT_ONCE or end == at):
                size += len(texts[end])
                end += 1
            if end == at + 1 and size > _AT_ONCE:  # one very long text, part by part
                cut = [self._group([p])[0] if p[:1] != " " else self._group(["." + p])[0][self._dot :] for p in self.cut(texts[at], _AT_ONCE)]
                yield np.frombuffer(b"".join(cut), "<u4")
            else:
                for raw in self._group(texts[at:end]):
                    yield np.frombuffer(raw, "<u4")
            at, size = end, 0

    @property
    def _dot(self) -> int:
        return len(self.texts(["."])[0])


def tokenizer(path: str | None = None):
    """The library's tokenizer; without padding and truncation."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(path))
    t.no_padding()
    t.no_truncation()
    return t


class LibraryWords:
    """Ids of many parts by one call of the library on all of them in a row, cut apart where an id starts with a blank or line end."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        size = self.library.get_vocab_size()
        starts = (self.library.id_to_token(i) or "" for i in range(size))
        self.starts = np.array([s[:1] in ("Ġ", "Ċ") for s in starts])  # how the vocabulary writes a blank and a line end

    def texts(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at, end, size = 0, 0, 0
        while at < len(words):
            while end < len(words) and (size < 50_000 or end == at):
                size += len(words[end])
                end += 1
            raw = self.texts(["".join(words[at:end])])[0]
            start = np.flatnonzero(self.starts[np.frombuffer(raw, "<u4")])
            if len(start) == end - at:
                bounds = [*(4 * start).tolist(), len(raw)]
                out += [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            else:
                out += self.texts(words[at:end])
            at, size = end, 0
        return out


def _memory(path: str) -> WordMemory:
    if path not in _loaded:
        library = LibraryWords(path)
        _loaded[path] = WordMemory(library.words, library.texts, [x.content for x in library.library.get_added_tokens_decoder().values()])
    return _loaded[path]


def forget() -> None:
    """Let this worker's memories go, where the operator that comes next doesn't use them."""
    _loaded.clear()


def encode_all(texts: list[str], path: str | None = None) -> Iterator[np.ndarray]:
    """The library's ids of each text as uint32, in order; some hundred thousand characters are worked on at once."""
    return _memory(vocabulary_path(path)).all(texts)
