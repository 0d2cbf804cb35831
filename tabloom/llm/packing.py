"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents become pieces; the packing itself needs only how many pieces there are of each length, a list of at most
``length`` numbers, so a plan for it is made on the driver in time that does not grow with the documents.  A join deals
the places of the plan out to the pieces, which are numbered within their length without gathering a length in one task.
"""

from __future__ import annotations

import base64
import bisect
import functools

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabloom.llm.batches import slices, small_batches
from tabloom.session import materialize

LENGTH = 1024
END_ID = 2
ROWS_PER_BUCKET = 50_000
ADDED = {"<|endoftext|>": 50256}  # the added token of ``byte_bpe_50k.json``, one id wherever it stands in a text


@functools.lru_cache(2)
def encoder(path: str, added: bool) -> tiktoken.Encoding:
    """The byte-level BPE whose ranks lie at ``path``, with the token of ``ADDED`` or without."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED if added else {})


@functools.lru_cache(1)
def _patient(path: str):
    """The tokenizer whose ids are meant; slower, but its patterns run over any text."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(encode: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text.  Where a run of blanks is too long for the regex engine (about a million), ``tokenizers`` gives them."""
    try:
        return encode.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
    except ValueError:
        if not encode.special_tokens_set:  # other ranks than those of the file
            raise
        return np.array(_patient(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, "<u4")


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """``key, piece, start, length, ids``: every document's token ids and ``end_id``, cut where they exceed ``length``.

    ``ids`` holds little-endian unsigned 32-bit integers.  The first piece of a cut document takes what is over, the others are
    full.  A NULL or empty text is the one id ``end_id``.  Repeated rows give repeated pieces, other columns are ignored.
    ``vocabulary`` is a file of ranks without added tokens, by default that of ``byte_bpe_50k.json`` with its added token, which gives
    the same ids faster.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow, last = to_arrow_schema(schema), np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(path, vocabulary is None)
        for batch in batches:
            for part in slices(batch, text):
                keys, rows = part.column(key), []
                for i, value in enumerate(part.column(text).to_pylist()):
                    ids = (token_ids(encode, value).tobytes() if value else b"") + last
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % length + 1, n + 1, length)]
                    rows += [(i, p, a, b - a, ids[4 * a : 4 * b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                took, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(took)), *(pa.array(c, f.type) for c, f in zip(rest, list(arrow)[1:]))], schema=arrow)

    return small_batches(docs.select(key, text)).mapInArrow(run, schema)


def best_two_fit(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[n]`` pieces of each length n: rows ``(n, first rank, last rank, per sequence, first sequence, offset)``.

    A sequence takes the longest piece that fits, again and again.  If a gap is left, its smallest piece gives way to the two
    unpacked pieces that fill the widened gap best, if they fill more.  A filling is repeated while the pieces for it last, so the
    number of steps depends on the number of lengths only.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    sizes = sorted(left)
    used, places, sequence = dict.fromkeys(left, 0), [], 0
    while sizes:
        greedy, gap = {}, length
        at = len(sizes) - 1
        while at >= 0 and gap >= sizes[0]:
            at = min(at, bisect.bisect_right(sizes, gap) - 1)
            if at < 0:
                break
            n = sizes[at]
            if take := min(left[n], gap // n):
                greedy[n] = take
                gap -= take * n
            at -= 1
        final, need = dict(greedy), dict(greedy)
        smallest = min(greedy)
        if gap and sum(greedy.values()) > 1:
            pair = _tightest(sizes, lambda n: left[n] - greedy.get(n, 0), gap + smallest)
            if pair and sum(pair) > smallest:
                final[smallest] -= 1
                for n in pair:
                    final[n] = final.get(n, 0) + 1
                for n in final:
                    need[n] = max(greedy.get(n, 0), final[n] + (n == smallest))
        final = {n: m for n, m in final.items() if m}
        times = min((left[n] - need[n]) // m + 1 for n, m in final.items())
        offset = 0
        for n, m in sorted(final.items(), reverse=True):
            places.append((n, used[n], used[n] + m * times - 1, m, sequence, offset))
            used[n] += m * times
            left[n] -= m * times
            offset += n * m
        sequence += times
        sizes = [n for n in sizes if left[n]]
    return places


def _tightest(sizes: list[int], free, room: int) -> tuple[int, int] | None:
    """Two lengths with the largest sum within ``room``, of which a piece each (two, if equal) is free."""
    best, pair, i, j = 0, None, 0, len(sizes) - 1
    while i <= j:
        a, b = sizes[i], sizes[j]
        if a + b > room or not free(b):
            j -= 1
            continue
        if not free(a) or (i == j and free(a) < 2):
            i += 1
            continue
        if a + b > best:
            best, pair = a + b, (a, b)
        i += 1
    return pair


def ranked(pieces: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``pieces`` with ``rank``, 0.. within each value of ``by``: hashed buckets are numbered alone and shifted by the buckets before them."""
    buckets = max(1, pieces.count() // ROWS_PER_BUCKET + 1)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(by, "_bucket").count().select(by, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1)
    return own.join(base, [by, "_bucket"]).withColumn("rank", F.col("_base") + F.col("_own")).drop("_base", "_own", "_bucket")


def pack(pieces: DataFrame, order: list[str], length: int = LENGTH, size: str = "length") -> DataFrame:
    """``pieces`` (lengths 1 to ``length``) with ``sequence_id`` and ``offset``; every sequence is filled gaplessly from 0.

    ``order`` names columns that tell pieces apart; equal rows may swap places.  ``pieces`` is read three times, so it should be a
    written table.  Pieces without a length, or with one out of range, get no place and raise an error, as they can't be packed.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy(size).count().collect()}
    if any(n is None or not 0 < n <= length for n in counts):
        raise ValueError(f"lengths must lie between 1 and {length}")
    places = best_two_fit(counts, length)
    spark = pieces.sparkSession
    plan = spark.createDataFrame(places, "_n long, _from long, _to long, _per long, _seq long, _off long")
    numbered = ranked(pieces, size, order)
    q = F.col("rank") - F.col("_from")
    return (
        numbered.join(F.broadcast(plan), (F.col(size) == F.col("_n")) & F.col("rank").between(F.col("_from"), F.col("_to")))
        .withColumn("sequence_id", F.col("_seq") + F.floor(q / F.col("_per")))
        .withColumn("offset", F.col("_off") + q % F.col("_per") * F.col(size))
        .drop("_n", "_from", "_to", "_per", "_seq", "_off", "rank")
    )


def packed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece: its place, and the CRC-32 of its ids in place of the ids."""
    pieces = token_pieces(docs, key, text, length).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialize(pieces), [key, "piece"], length)
