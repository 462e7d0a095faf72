"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces (forward algorithm), a text's the product over its words. The probabilities are learned by
expectation maximisation over all segmentations of the words of a bounded labelled sample. Words may be of any length: sums are
carried as ratios of neighbouring prefixes, so nothing underflows, and very long words pass in segments.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from duolist.llm.bpe import codec
from duolist.llm.common import Batches, fresh, materialise, record, texts
from duolist.llm.tokens import forget

#: Labelled documents learned from per language, those with the least hash of doc_id.
FIT_DOCS = 400
ROUNDS = 3
#: Added to every piece's expected count.
FLOOR = 0.01
#: Bytes that the words remembered by a worker take at most, and characters of such a word.
REMEMBER_BYTES, REMEMBER_SIZE = 96 << 20, 64
UNKNOWN = "und"
_RUNS = re.compile(r"[^\W\d_]+")
#: Bytes of a word, and places in a batch of words, that are segmented at a time.
_SEGMENT, _AT_ONCE = 1 << 16, 1 << 17
_WORDS_AT_ONCE = 200_000


def letters_of(run: str) -> list[str]:
    """The runs of letters in a run of letters and other numerals (as in 3 with a small 2 behind it)."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def words_of(text: str) -> list[str]:
    """Runs of letters, lower case."""
    return [w for run in _RUNS.findall(text.lower()) for w in letters_of(run)]


def _in_words(piece: bytes) -> bool:
    """Whether a lower-case word behind a blank can hold this piece."""
    own = piece[1:] if piece[:1] == b" " else piece
    try:
        text = own.decode()
        return text.isalpha() and text == text.lower()
    except UnicodeDecodeError:  # holds a part of a character
        return not any(b < 97 or 122 < b < 128 for b in own)


class Pieces:
    """The pieces that lower-case words behind a blank are made of: every single byte, and all of the vocabulary's strings that such
    words can hold. Looked up by a 64-bit hash, many at a time."""

    def __init__(self, vocabulary: str | None = None):
        self.ids = {p: i for i, p in codec(vocabulary).pieces.items() if len(p) == 1 or (p and _in_words(p))}
        self.longest = max(map(len, self.ids))
        self.size = max(self.ids.values()) + 1
        self.known = np.array(sorted(self.ids.values()))
        keys = np.zeros(len(self.ids), np.uint64)
        for n, piece in enumerate(self.ids):
            for b in piece:
                keys[n] = self._grown(keys[n : n + 1], np.array([b], np.uint8))[0]
        keys *= np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(keys)
        self.keys, self.of = keys[order], np.array(list(self.ids.values()), np.int32)[order]
        slots = (self.keys >> np.uint64(44)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange(1 << 20)).astype(np.int32)
        self.deep = int(np.bincount(slots).max())

    @staticmethod
    def _grown(key: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Key of a string with a byte added."""
        return key * np.uint64(0xD6E8FEB86659FD93) + (byte.astype(np.uint64) + np.uint64(1))

    def ending(self, raw: np.ndarray) -> np.ndarray:
        """raw: words by bytes. The piece (or -1) that ends with each byte of each word, by its length less 1."""
        words, n = raw.shape
        out = np.full((words, n, min(self.longest, n)), -1, np.int32)
        key = np.zeros((words, n), np.uint64)
        for k in range(out.shape[2]):
            key = self._grown(key[:, : n - k], raw[:, k:])
            mixed = key * np.uint64(0x9E3779B97F4A7C15)
            at = self.first[(mixed >> np.uint64(44)).astype(np.int64)]
            found = out[:, k:, k]
            for _ in range(self.deep):
                at = np.minimum(at, len(self.keys) - 1)
                np.copyto(found, self.of[at], where=self.keys[at] == mixed)
                at = at + 1
        return out


def forward(raw: np.ndarray, prob: np.ndarray, pieces: Pieces, backward: bool = False) -> Iterator[np.ndarray]:
    """Log probability, by word and language, of the first byte, the first two, and so on: the sum over all segmentations.

    prob: pieces by languages, last row 0. backward: of the last byte, the last two, and so on.
    """
    words, n = raw.shape
    longest = min(pieces.longest, n)
    total = np.zeros((words, prob.shape[1]))
    window = np.zeros((words, longest, prob.shape[1]))  # prefixes' probabilities over that of the longest so far
    window[:, 0] = 1
    for start in range(0, n, _SEGMENT):
        if not backward:
            low = max(0, start - longest + 1)
            ids = pieces.ending(raw[:, low : start + _SEGMENT])[:, start - low :]
            ids = np.pad(ids, ((0, 0), (0, 0), (0, longest - ids.shape[2])), constant_values=-1)
        else:  # by first byte, from the last one on
            high = min(n, n - start + longest - 1)
            low = max(0, n - start - _SEGMENT)
            ends = pieces.ending(raw[:, low:high])
            ids = np.full((words, n - start - low, longest), -1, np.int32)
            for k in range(ends.shape[2]):
                own = ends[:, k:, k][:, : n - start - low]
                ids[:, : own.shape[1], k] = own
            ids = ids[:, ::-1]
        for j in range(ids.shape[1]):
            ratio = np.einsum("wlg,wlg->wg", prob[ids[:, j]], window)
            total = total + np.log(ratio)
            window[:, 1:] = np.minimum(window[:, :-1], 1e280) / ratio[:, None]
            window[:, 0] = 1
            yield total


def batches_of(words: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Words of equal size, as many as are segmented at a time."""
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    for size, same in by_size.items():
        step = max(1, _AT_ONCE // size)
        for i in range(0, len(same), step):
            yield same[i : i + step]


def as_bytes(words: list[bytes]) -> np.ndarray:
    """Words of equal size as a matrix."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def log_probabilities(words: Iterable[bytes], prob: np.ndarray, pieces: Pieces) -> dict[bytes, np.ndarray]:
    """Log probability of each word by language."""
    out: dict[bytes, np.ndarray] = {}
    for same in batches_of(words):
        for total in forward(as_bytes(same), prob, pieces):
            pass
        out.update(zip(same, total, strict=True))
    return out


def expected_counts(words: list[bytes], weight: np.ndarray, prob: np.ndarray, pieces: Pieces, into: np.ndarray) -> None:
    """Add the pieces' expected counts in words of equal size, each as often as its weight, to into. prob: of one language."""
    raw = as_bytes(words)
    n = raw.shape[1]
    zero = np.zeros(len(words))
    before = np.array([zero, *(t[:, 0] for t in forward(raw, prob[:, None], pieces))])
    after = np.array([zero, *(t[:, 0] for t in forward(raw, prob[:, None], pieces, backward=True))])[::-1]
    for start in range(0, n, _SEGMENT):
        low = max(0, start - pieces.longest + 1)
        ids = pieces.ending(raw[:, low : start + _SEGMENT])[:, start - low :]
        for k in range(ids.shape[2]):
            w, j = np.nonzero(ids[:, :, k] >= 0)
            i, end = j + start - k, j + start + 1
            own = ids[w, j, k]
            np.add.at(into, own, weight[w] * prob[own] * np.exp(before[i, w] + after[end, w] - before[n, w]))


def learn(counts: dict[bytes, float], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of all pieces for one language, from how often each word was seen; the last place is 0."""
    expected = np.zeros(pieces.size + 1)
    work = [(same, np.array([counts[w] for w in same], float)) for same in batches_of(counts)]
    for same, weight in work:  # at first every piece counts wherever it fits
        ids = pieces.ending(as_bytes(same))
        w, j, k = np.nonzero(ids >= 0)
        np.add.at(expected, ids[w, j, k], weight[w])
    for k in range(rounds + 1):
        prob = np.zeros(pieces.size + 1)
        prob[pieces.known] = expected[pieces.known] + FLOOR
        prob /= prob.sum()
        if k < rounds:
            expected = np.zeros(pieces.size + 1)
            for same, weight in work:
                expected_counts(same, weight, prob, pieces, expected)
    return prob


#: Languages that are learned, at most: the model holds 8 bytes for each of them and each piece, and goes to all tasks.
MOST_LANGUAGES = 512


def choose(rows: DataFrame, fit_docs: int) -> DataFrame:
    """(doc_id, lang) of the fit_docs documents of each language with the least hash of doc_id, each once.

    Only what lies below a share of the hash range that holds twice as many different ids is ranked, so a common language is no
    large task, and rows that repeat an id change nothing. ValueError if there are more than MOST_LANGUAGES values of lang.
    """
    share = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / F.lit(float(2**53))
    ids = rows.select("lang", "doc_id").distinct()
    sizes = materialise(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages")
    if sizes.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    low = ids.join(F.broadcast(sizes), "lang").where(share * F.col("size") <= 2 * fit_docs + 100)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return low.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fit_docs).select("doc_id", "lang")


def fit(docs: DataFrame, vocabulary: str | None = None, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities) from documents with a label; docs: doc_id, text, lang.

    Learns from at most fit_docs whole documents per language, those with the least hash of doc_id. What comes back has a row
    per piece and a column per language, whatever the input's size.
    """
    rows = docs.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "text", "lang")

    def count(batches: Batches) -> Batches:
        for batch in batches:
            seen = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                seen.update((lang, w) for w in words_of(text))
            if seen:
                yield record(lang=[k[0] for k in seen], word=[k[1].encode() for k in seen], n=list(seen.values()))

    def one_language(frame: pd.DataFrame) -> pd.DataFrame:
        prob = learn({b" " + w: n for w, n in zip(frame["word"], frame["n"], strict=True)}, Pieces(vocabulary))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "prob": [prob.astype("<f8").tobytes()]})

    # at most fit_docs ids a language
    sample = rows.join(F.broadcast(choose(rows, fit_docs)), ["doc_id", "lang"], "left_semi")
    counts = sample.select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    learned = sorted(counts.groupBy("lang").applyInPandas(one_language, "lang string, prob binary").collect())
    return [r.lang for r in learned], np.stack([np.frombuffer(r.prob) for r in learned], axis=1) if learned else np.empty((0, 0))


class Predictor:
    """Scores whole texts; remembers words that it has segmented lately, in two generations of bounded size."""

    def __init__(self, languages: list[str], prob: np.ndarray, vocabulary: str | None = None):
        self.languages, self.prob = languages, prob
        self.pieces = Pieces(vocabulary)
        self.most = max(1000, REMEMBER_BYTES // (2 * (300 + 8 * len(languages))))
        self.none = np.zeros((1, len(languages)))
        self.young, self.old = {}, {}
        self.logs = self.old_logs = self.none  # row 0: no letters

    def _place(self, runs: set[str]) -> list[str]:
        """Give runs a row; returns those that are too long to be remembered."""
        known = [r for r in runs if r in self.old]
        new = [r for r in runs if r not in self.old]
        parts = [letters_of(r) for r in new]
        values = log_probabilities({b" " + w.encode() for ws in parts for w in ws}, self.prob, self.pieces)
        rows = [values[b" " + ws[0].encode()] if len(ws) == 1 else np.sum([values[b" " + w.encode()] for w in ws], axis=0) for ws in parts if ws]
        first = len(self.logs)
        self.young.update((r, first + i) for i, r in enumerate(known))
        at = iter(range(first + len(known), first + len(known) + len(rows)))
        self.young.update((r, next(at) if ws else 0) for r, ws in zip(new, parts, strict=True))
        self.logs = np.concatenate([self.logs, self.old_logs[[self.old[r] for r in known]], np.array(rows).reshape(len(rows), -1) if rows else self.none[:0]])
        return [r for r in runs if len(r) > REMEMBER_SIZE]

    def _runs(self, text: str) -> Iterator[list[str]]:
        if len(text) < 5 * _WORDS_AT_ONCE:
            yield _RUNS.findall(text.lower())
            return
        found = (m.group() for m in _RUNS.finditer(text.lower()))
        while runs := list(islice(found, _WORDS_AT_ONCE)):
            yield runs

    def _add(self, found: list[list[str]]) -> list[tuple[np.ndarray, bool]]:
        """(sum of the logs, whether there is a letter) of each list of runs."""
        if len(self.young) > self.most:
            self.old, self.old_logs, self.young, self.logs = self.young, self.logs, {}, self.none
        get = self.young.get
        held = [list(map(get, runs)) for runs in found]
        long = self._place({r for runs, at in zip(found, held, strict=True) if None in at for r, i in zip(runs, at, strict=True) if i is None})
        out = []
        for runs, at in zip(found, held, strict=True):
            rows = np.fromiter(map(get, runs) if None in at else at, np.int64, len(runs))
            out.append((self.logs[rows].sum(axis=0), bool(rows.any())))
        for r in long:
            del self.young[r]
        return out

    def predict(self, batch: list[str]) -> tuple[list[str], list[float]]:
        """(language, its probability among those learned) of each text."""
        names, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
        if not self.languages:
            return names, scores
        at = 0
        while at < len(batch):
            end, size = at, 0
            while end < len(batch) and end - at < 200 and (size + len(batch[end]) < 5 * _WORDS_AT_ONCE or end == at):
                size += len(batch[end])
                end += 1
            if end > at + 1:
                sums = self._add([_RUNS.findall(t.lower()) for t in batch[at:end]])
            else:
                parts = [self._add([runs])[0] for runs in self._runs(batch[at])]
                sums = [(np.sum([p for p, _ in parts], axis=0), any(x for _, x in parts))]
            for i, (total, letters) in enumerate(sums, at):
                if letters:
                    best = int(total.argmax())
                    names[i], scores[i] = self.languages[best], 1 / math.fsum(np.exp(total - total[best]))
            at = end
        return names, scores


def predict(docs: DataFrame, languages: list[str], prob: np.ndarray, vocabulary: str | None = None, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """docs with the predicted language and its probability added; all columns stay.

    Only the text is looked at. A null text or one without letters is `und` with score 0; ties go to the language whose name
    sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast((languages, prob))  # pieces by languages
    at = docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        forget()
        predictor = Predictor(*shared.value, vocabulary)
        for batch in batches:
            names, scores = predictor.predict(texts(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_as, score_as])

    added = [StructField(lang_as, StringType()), StructField(score_as, DoubleType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def _fold(docs: DataFrame):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def language_of(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those outside the held-out third.

    A null doc_id is never held out and never learned from; which documents are learned from depends on their ids alone, however
    often rows repeat, and other columns change nothing; more than MOST_LANGUAGES values of lang are refused with a ValueError; texts of numerals
    alone have no letters; an empty table, or one without labels, gives `und` for all its rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    languages, prob = fit(rows.where(_fold(rows) != 1))
    marked = rows.select("doc_id", F.coalesce(_fold(rows) == 1, F.lit(False)).alias("held_out"), "text")
    return predict(marked, languages, prob).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with a probability of at least `least`; all columns stay, under whatever names.

    Null and empty texts and texts without letters go; rows with a null or repeated doc_id are judged by their own text like any
    other, but a null doc_id isn't learned from; without labels to learn from no language is known and all rows go; an empty
    table gives an empty table.
    """
    languages, prob = fit(docs.where(_fold(docs) != 1))
    lang, score = fresh(docs.columns, "lang_pred", "score")
    got = predict(docs, languages, prob, lang_as=lang, score_as=score)
    return got.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*(f"`{c}`" for c in docs.columns))
