"""Byte-level BPE: encoding with a priority queue of merge ranks over a linked list of symbols, and decoding."""

from __future__ import annotations

import json
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolist.llm.common import Batches, id_and_text, ids_of, record, texts
from duolist.llm.tokens import Recent, WordMemory, vocabulary_path

#: Fixed value of the file format: how a text falls into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that a worker remembers of what lies between blanks, and of single words.
REMEMBER_BYTES, REMEMBER_WORDS = 192 << 20, 96 << 20
_BATCH_IDS = 2_000_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files of this kind: Latin-1's printable ones for
    themselves, the others, in order, for those from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str | None = None):
        with open(vocabulary_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        back = {c: b for b, c in symbols.items()}
        self.of_byte = [vocab[symbols[b]] for b in range(256)]
        self.left, self.right, self.merged = ([vocab[x] for x in side] for side in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        self.rank = {a << 32 | b: i for i, (a, b) in reversed(list(enumerate(zip(self.left, self.right, strict=True))))}
        self.byte_rank = [self.rank.get(a << 32 | b) for a in self.of_byte for b in self.of_byte]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces: dict[int, bytes] = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in vocab.items()}
        self.pieces |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(WORDS)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = Recent(REMEMBER_WORDS)
        self.memory = WordMemory(self._plain, lambda texts: list(map(self._text, texts)), list(self.special), REMEMBER_BYTES)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word. Entries of the queue are a rank above the bits of a place; one is stale if its pair no longer stands there."""
        rank, first, left, right, size = self.rank.get, self.byte_rank, self.left, self.right, len(word)
        ids = list(map(self.of_byte.__getitem__, word))
        bits = size.bit_length()
        queue = [r << bits | i for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if (r := first[a << 8 | b]) is not None]
        if not queue:
            return ids
        heapify(queue)
        after, before, places = list(range(1, size + 1)), list(range(-1, size - 1)), (1 << bits) - 1
        ids.append(-1)  # stands behind the last
        while queue:
            entry = heappop(queue)
            r, i = entry >> bits, entry & places
            j = after[i]
            if ids[i] != left[r] or ids[j] != right[r]:
                continue
            new, ids[j] = self.merged[r], -2  # -2: gone
            ids[i] = new
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                if (s := rank(new << 32 | ids[k])) is not None:
                    heappush(queue, s << bits | i)
            if (k := before[i]) >= 0 and (s := rank(ids[k] << 32 | new)) is not None:
                heappush(queue, s << bits | k)
        return [x for x in ids if x >= 0]

    def _merged(self, words: list[str]) -> list[bytes]:
        return [array("I", self.merge(word.encode())).tobytes() for word in words]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of each text without special tokens as little-endian 32-bit integers."""
        self.known.turn()
        split, young = list(map(self.words.findall, texts)), self.known.young
        got = {w: young.get(w) for words in split for w in words}
        got.update(self.known.look({w for w, ids in got.items() if ids is None}, self._merged))
        return [b"".join(map(got.__getitem__, words)) for words in split]

    def _text(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; strings of special tokens stand for those."""
        if not any(x in text for x in self.special):
            return self._plain([text])[0]
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain([p])[0] for p in self.parts.split(text))

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text."""
        return next(self.memory.all([text]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their vocabulary strings put together, read as UTF-8; what isn't UTF-8 becomes U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", errors="replace")


_codecs: dict[str | None, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """The codec of a vocabulary file, made once per worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32)))


def encode(docs: DataFrame, vocabulary: str | None = None, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids[, text]): the token ids of each whole text, without special tokens of the library's own.

    decoded: add what decode() gives for those ids, in the same pass. Null and empty texts have no ids; repeated rows and null
    doc_ids are encoded like any other; other columns aren't read; an empty table gives an empty table.
    """

    def run(batches: Batches) -> Batches:
        c = codec(vocabulary)

        def give(ids: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
            more = {"text": pa.array([c.decode(x.tolist()) for x in held], pa.string())} if decoded else {}
            return record(doc_id=ids, ids=_lists(held), **more)

        for batch in batches:
            ids, held, start, size = ids_of(batch), [], 0, 0
            for i, tokens in enumerate(c.memory.all(texts(batch.column(1)))):
                held.append(tokens)
                size += len(tokens)
                if size > _BATCH_IDS:
                    yield give(ids.slice(start, len(held)), held)
                    held, start, size = [], i + 1, 0
            if held:
                yield give(ids.slice(start, len(held)), held)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, text): adds the decoded text to what encode() gives; null ids decode to an empty text."""

    def run(batches: Batches) -> Batches:
        c = codec(vocabulary)
        for batch in batches:
            ids = batch.column(1)
            yield record(doc_id=batch.column(0), ids=ids, text=pa.array([c.decode(x.values.to_pylist()) if x.is_valid else "" for x in ids], pa.string()))

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what decode() gives."""
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))
