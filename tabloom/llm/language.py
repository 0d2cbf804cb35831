"""Language identification by unigrams over pieces, summed over all segmentations.

A language gives each piece of a fixed public vocabulary a probability.  A word's probability is the sum over all ways to cut it into
pieces, which a forward pass over its bytes adds up; a text's is the product over its words.  The probabilities come from the same sum:
every round of expectation-maximisation counts the pieces of the training words by how likely the cuts are that use them.
"""

from __future__ import annotations

import base64
import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.llm.batches import UPPER, append, as_bytes, rolling, slices, small_batches, span_hash, words
from tabloom.session import materialize

LONGEST = 12  # bytes of a piece
ROUNDS = 3
SAMPLE_ROWS = 6_000  # labelled documents that the model is fitted on, at most about so many
SMOOTHING = 0.1
UNDETERMINED = "und"
LETTERS = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])  # words: letters and non-ASCII characters
_SMALL = -1e30
_SIEVE_BITS = 22
KNOWN_WORDS = 1_000_000  # whose probabilities a task remembers


class Vocabulary(NamedTuple):
    """Pieces by the hash of their bytes, ascending; every single byte is one, so each word has a segmentation."""

    hashes: np.ndarray
    ids: np.ndarray
    size: int
    sieve: np.ndarray  # whether any piece's hash has these first bits


@functools.lru_cache(2)
def vocabulary(path: str, longest: int = LONGEST) -> Vocabulary:
    """The lower-cased letter pieces of up to ``longest`` bytes of a file of ranks, and all single bytes."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]).strip().lower() for line in f}
    pieces = sorted({p for p in pieces if 0 < len(p) <= longest and all(LETTERS[b] for b in p)} | {bytes([b]) for b in range(256)})
    data, offsets = as_bytes(pa.array(pieces, pa.binary()))
    hashes = span_hash(rolling(data), offsets[:-1], offsets[1:])
    order = np.argsort(hashes)
    sieve = np.zeros(1 << _SIEVE_BITS, bool)
    sieve[hashes >> np.uint64(64 - _SIEVE_BITS)] = True
    return Vocabulary(hashes[order], order, len(pieces), sieve)


class Lattice(NamedTuple):
    """Pieces in words: ``piece[e]`` runs from byte ``start[e]`` to ``end[e]`` of the bytes of all words; edges of one ``end`` lie together, ascending."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray


def lattice(voc: Vocabulary, data: np.ndarray, first: np.ndarray, longest: int = LONGEST) -> Lattice:
    """All pieces within the words whose bytes are ``data[first[i]:first[i + 1]]``."""
    sums = rolling(data)
    word_of = np.repeat(first[:-1], np.diff(first))  # start of the word of each byte
    found = []
    for n in range(1, longest + 1):
        end = np.arange(n, len(data) + 1)
        start = end - n
        inside = start >= word_of[end - 1]
        start, end = start[inside], end[inside]
        h = span_hash(sums, start, end)
        likely = np.flatnonzero(voc.sieve[h >> np.uint64(64 - _SIEVE_BITS)])
        start, end, h = start[likely], end[likely], h[likely]
        at = np.minimum(np.searchsorted(voc.hashes, h), len(voc.hashes) - 1)
        known = voc.hashes[at] == h
        found.append((start[known], end[known], voc.ids[at[known]]))
    start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, end))
    return Lattice(start[order], end[order], piece[order])


def forward(lat: Lattice, first: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Log probability of every prefix, by language: row 0 of each word is 0; ``log_p[piece, language]``.

    Position b of a word's bytes has row b + (number of the word), so every word has one row more than bytes.
    The words go forward side by side, one byte at a time; a word that has ended drops out.
    """
    length = np.diff(first)
    row = first[:-1] + np.arange(len(length))
    out = np.full((int(first[-1]) + len(length), log_p.shape[1]), _SMALL)
    out[row] = 0.0
    low = np.searchsorted(lat.end, np.arange(int(first[-1]) + 2))
    order = np.argsort(-length, kind="stable")
    running = len(length) - np.searchsorted(length[order][::-1], np.arange(length.max() if len(length) else 0), "right")
    for t, n in enumerate(running, 1):
        word = order[:n]
        end = first[word] + t
        a, b = low[end], low[end + 1]
        count = b - a
        edge = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
        value = out[lat.start[edge] + np.repeat(word, count)] + log_p[lat.piece[edge]]
        group = np.cumsum(count) - count
        top = np.maximum.reduceat(value, group, axis=0)
        out[end + word] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count, axis=0)), group, axis=0))
    return out


def expected(lat: Lattice, first: np.ndarray, log_p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece by language; ``weight[word, language]`` says how often a word occurs."""
    length = np.diff(first)
    ahead = forward(lat, first, log_p)
    total = ahead[first[1:] + np.arange(len(length))]
    back = forward(_mirrored(lat, first), first, log_p)
    word = np.searchsorted(first, lat.start, "right") - 1
    behind = back[first[word] + first[word + 1] - lat.end + word]  # suffixes are the prefixes of the mirrored word
    use = np.exp(ahead[lat.start + word] + log_p[lat.piece] + behind - total[word]) * weight[word]
    return np.stack([np.bincount(lat.piece, use[:, k], len(log_p)) for k in range(log_p.shape[1])], axis=1)


def _mirrored(lat: Lattice, first: np.ndarray) -> Lattice:
    word = np.searchsorted(first, lat.start, "right") - 1
    turn = first[word] + first[word + 1]
    start, end = turn - lat.end, turn - lat.start
    order = np.lexsort((start, end))
    return Lattice(start[order], end[order], lat.piece[order])


class Model(NamedTuple):
    path: str
    languages: list[str]
    log_p: np.ndarray  # by piece and language
    prior: np.ndarray


def unique_words(data: np.ndarray, offsets: np.ndarray):
    """Distinct lower-cased words of a slice: their bytes and starts, the number of each word's distinct one, the words of each text, and the distinct hashes."""
    data = UPPER[data]
    found = words(data, offsets, LETTERS)
    hashes, one, which = np.unique(found.hash, return_index=True, return_inverse=True)
    length = (found.end - found.start)[one]
    first = np.concatenate([[0], np.cumsum(length)])
    take = np.repeat(found.start[one] - first[:-1], length) + np.arange(first[-1])
    return data[take], first, which, found.first, hashes


def word_counts(docs: DataFrame, text: str, label: str) -> DataFrame:
    """``word, <label>, n``: how often each word occurs in the documents of each label."""
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField(label, T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = as_bytes(part.column(text))
                raw, first, which, of, _ = unique_words(data, offsets)
                labels, code = np.unique(np.array(part.column(label).to_pylist(), object), return_inverse=True)
                pair, n = np.unique(which * len(labels) + np.repeat(code, np.diff(of)), return_counts=True)
                pool = [raw[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([pool[i] for i in pair // max(1, len(labels))], pa.binary()), pa.array([labels[i] for i in pair % max(1, len(labels))], pa.string()), pa.array(n)], names=["word", label, "n"])

    return small_batches(docs.select(text, label)).mapInArrow(run, schema).groupBy("word", label).agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """Piece probabilities of each non-NULL label, from about ``sample_rows`` rows of ``docs`` chosen by the hash of their text.

    Words are counted in Spark; rounds of expectation-maximisation over the distinct words of the bounded sample run as Spark jobs
    that return a count for each piece and label.  Without a labelled text the model knows no language.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias(text), F.col(label).cast("string").alias(label))
    rows = known.count()
    if rows > sample_rows:
        known = known.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample_rows / rows)))
    counts = materialize(word_counts(known, text, label))
    languages = [r[0] for r in counts.select(label).distinct().orderBy(label).collect()]
    voc, shape = vocabulary(path), (vocabulary(path).size, len(languages))
    model = Model(path, languages, np.full(shape, -np.log(voc.size)), np.full(len(languages), -np.log(max(1, len(languages)))))
    for _ in range(rounds if languages else 0):
        got = np.zeros(shape)
        for r in _piece_counts(counts, label, model).collect():  # a row for each piece and label
            got[r.piece, r.language] = r.n
        log_p = np.log(got + SMOOTHING) - np.log((got + SMOOTHING).sum(axis=0))
        model = model._replace(log_p=log_p)
    return model


def _piece_counts(counts: DataFrame, label: str, model: Model) -> DataFrame:
    held = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        voc, number = vocabulary(model.path), {x: i for i, x in enumerate(model.languages)}
        total = np.zeros(model.log_p.shape)
        for batch in batches:
            data, first = as_bytes(batch.column("word"))
            weight = np.zeros((len(batch), len(number)))
            weight[np.arange(len(batch)), [number[x] for x in batch.column(label).to_pylist()]] = batch.column("n").to_numpy()
            total += expected(lattice(voc, data, first), first, model.log_p, weight)
        piece, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(total[piece, language])], names=["piece", "language", "n"])

    counts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    return counts.mapInArrow(run, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n"))


class _Remembered:
    """Log probabilities of words, kept by their hashes while a task reads slice after slice."""

    def __init__(self, languages: int) -> None:
        self.hashes, self.values = np.empty(0, np.uint64), np.empty((0, languages))

    def look_up(self, model: Model, raw: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Values of the distinct words ``raw[first[i]:first[i + 1]]``, whose hashes ascend."""
        if len(self.hashes) > KNOWN_WORDS:
            self.__init__(len(model.languages))
        at = np.searchsorted(self.hashes, hashes)
        there = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~there)
        if len(new):
            length = np.diff(first)[new]
            begin = np.concatenate([[0], np.cumsum(length)])
            data = raw[np.repeat(first[new] - begin[:-1], length) + np.arange(begin[-1])]
            ahead = forward(lattice(vocabulary(model.path), data, begin), begin, model.log_p)
            self.values = np.insert(self.values, at[new], ahead[begin[1:] + np.arange(len(new))], axis=0)
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            at = np.searchsorted(self.hashes, hashes)
        return self.values[at]


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``) with ``lang_pred`` and ``score``, the share of the best language in the probability per byte, 0 to 1.

    Whole texts are scored.  A NULL text, or one without a letter, and every text if the model knows no language, is ``und`` with score 0.
    """
    held, task = docs.sparkSession.sparkContext.broadcast(model), {}
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def run(part: pa.RecordBatch) -> list:
        model = held.value
        n = len(part)
        if not model.languages:
            return [pa.array([UNDETERMINED] * n), pa.array([0.0] * n)]
        column = part.column(text)
        raw, first, which, of, hashes = unique_words(*as_bytes(column))
        length = np.diff(first)
        score = task.setdefault("words", _Remembered(len(model.languages))).look_up(model, raw, first, hashes)[which]
        sums = np.concatenate([np.zeros((1, score.shape[1])), np.cumsum(score, axis=0)])
        total = sums[of[1:]] - sums[of[:-1]]
        size = np.concatenate([[0], np.cumsum(length[which])])
        per_byte = (total + model.prior) / np.maximum(1, size[of[1:]] - size[of[:-1]])[:, None]
        share = np.exp(per_byte - per_byte.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        share = share[np.arange(n), best] / share.sum(axis=1)
        has = np.array([x is not None and any(map(str.isalpha, x)) for x in column.to_pylist()], bool)
        return [pa.array([model.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)]), pa.array(np.where(has, share, 0.0))]

    return append(docs, run, fields, text, keep)
