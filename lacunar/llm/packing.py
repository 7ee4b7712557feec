"""Best-fit packing of tokenised documents by minimum bin slack.

Documents are cut into pieces of at most `capacity` tokens. Only the number of pieces of each
length matters to the packing, so the driver works on a histogram of at most `capacity` rows,
whatever the size of the corpus. Per bin it takes the longest piece left and lets a bitset
subset-sum dynamic programme find the combination of the other lengths that fills the bin best;
that combination is removed as often as the histogram allows. The r-th piece of a length then
takes the r-th place of that length; ranks come from chunked running totals, so that a length
that a third of all pieces share is still ranked by many tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacunar.llm._dist import chunks_of, running_total, salt
from lacunar.llm._text import lean
from lacunar.sources.store import stored

CAPACITY = 1024
END_ID = 2
CACHED_CHUNKS = 400_000

PIECES = "doc_id long, piece int, start long, length long, payload {kind}"


def fullest(room: int, lengths: list[tuple[int, int]]) -> dict[int, int]:
    """The number of each length whose sum comes closest to room from below; lengths: (length, count), descending."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length, count in lengths:
        left = min(count, room // length) if length <= room else 0
        if not left:
            continue
        steps.append((length, reach))
        take = 1
        while left:
            take = min(take, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        copies = 0
        while not before >> best & 1:
            best -= length
            copies += 1
        if copies:
            out[length] = copies
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places as (length, first rank, rank after the last, first sequence, sequences, offset).

    Each pattern is used until one of its lengths runs short, so there are at most about
    capacity * ln(capacity) patterns, however many pieces there are.
    """
    left = {k: v for k, v in histogram.items() if k > 0 and v > 0}
    used = dict.fromkeys(left, 0)
    out, sequence = [], 0
    while left:
        order = sorted(left, reverse=True)
        top = order[0]
        pattern = fullest(capacity - top, [(k, left[k] - (k == top)) for k in order])
        pattern[top] = pattern.get(top, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for k in sorted(pattern, reverse=True):
            for _ in range(pattern[k]):
                out.append((k, used[k], used[k] + times, sequence, times, offset))
                used[k] += times
                offset += k
            left[k] -= times * pattern[k]
            if not left[k]:
                del left[k]
        sequence += times
    return out


class Encoder:
    """Token ids of whole texts, as the tokenizer file's own library gives them.

    Text without a space before other white space is cut before each space, where the byte-level
    pattern always has a boundary; the ids of each cut are kept in a bounded cache. Other text goes
    through the rank table, and text with the string of an added token through the full tokenizer.
    """

    def __init__(self, json_file: str, ranks_file: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(json_file)
        self.added = [x.content for x in self.full.get_added_tokens_decoder().values()]
        self.odd = re.compile(r" \s")
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(x in text for x in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.odd.search(text):
            return self._ids(text)
        known = self.known
        if len(known) > CACHED_CHUNKS:
            known.clear()
        parts = text.split(" ")
        out = [self._ids(parts[0])] if parts[0] else []
        for part in parts[1:]:
            ids = known.get(part)
            if ids is None:
                ids = known[part] = self._ids(" " + part)
            out.append(ids)
        return b"".join(out)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


def tokenized(docs: DataFrame, json_file: str, ranks_file: str, capacity: int = CAPACITY, end_id: int = END_ID, payload: Callable[[bytes], object] | None = None, kind: str = "binary") -> DataFrame:
    """Pieces (doc_id, piece, start, length, payload); payload is the piece's ids, or what `payload` makes of them."""

    @lean
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(json_file, ranks_file)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                at, piece = 0, 0
                cut = n % capacity or capacity
                while at < n:
                    part = ids[4 * at : 4 * cut]
                    rows.append((doc_id, piece, at, cut - at, payload(part) if payload else part))
                    at, cut, piece = cut, cut + capacity, piece + 1
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if kind == "long" else pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "payload"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES.format(kind=kind))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...).

    A null text is a piece of the end token alone. Repeated rows are pieces of their own. An empty
    input gives no rows.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    counted = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = {r["length"]: r["count"] for r in counted}
    places = spark.createDataFrame(plan(histogram, capacity), "_l long, _lo long, _hi long, _seq long, _n long, _off long")
    chunks = F.element_at(F.lit([chunks_of(histogram.get(n, 0)) for n in range(1, capacity + 1)]), F.col("length").cast("int"))
    ranked = running_total(pieces.withColumn("_c", salt(chunks, "doc_id", "piece")), ["length"], "_c", ["doc_id", "piece"], F.lit(1), "_r")
    # the plan's rows are bounded by the capacity, not by the data
    met = ranked.join(F.broadcast(places), (F.col("length") == F.col("_l")) & (F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi")))
    return met.select(*pieces.columns, (F.col("_seq") + F.col("_r") - F.col("_lo")).alias("sequence_id"), F.col("_off").alias("offset"))


def pack_documents(docs: DataFrame, json_file: str, ranks_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is the end token alone. Repeated rows, and rows without doc_id, are packed each. A text of any
    length is tokenised whole. An empty table gives no rows.
    """
    pieces = tokenized(docs, json_file, ranks_file, capacity, end_id, crc32, "long").withColumnRenamed("payload", "ids_crc32")
    return pack(pieces, capacity)
