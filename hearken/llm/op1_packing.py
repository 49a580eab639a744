"""Best-fit packing of tokenized documents into sequences, planned over a histogram of lengths.

The plan is best-fit decreasing over counts: pieces of equal length are alike, so only how many there are of each
length matters. It reads at most `limit` counts and gives runs of slots; a piece takes the slot of its rank among
the pieces of its length. Ranks come from small groups (length, bucket) with offsets between buckets, so that a
length which most pieces share is never gathered in one task.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearken.llm.common import small_batches, text_of, written
from hearken.llm.op4_word_bpe import LibraryBpe, word_bpe

LIMIT, END_ID = 4096, 1
#: Pieces of one length that a ranking task may hold; the number of buckets follows the input.
BUCKET_ROWS = 250_000


def plan_best_fit(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Slots for counts[length] pieces of each length: (length, first rank, pieces, first sequence, offset).

    Best-fit decreasing, as if piece by piece: each goes to the sequence with the least room that is enough, else
    to a new one. Sequences with equal room are kept as runs of consecutive numbers, so the work depends on
    `limit`, not on the number of pieces. Lengths of 0 or of more than `limit` are errors.
    """
    if any(not 0 < n <= limit for n in counts):
        raise ValueError("lengths must be from 1 to the limit")
    slots: list[tuple[int, int, int, int, int]] = []
    room: list[int] = []  # the distinct rooms left, in order
    runs: dict[int, list[tuple[int, int]]] = {}  # by room: a heap of (first sequence, how many)
    opened = 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in runs:
                runs[left] = []
                insort(room, left)
            heapq.heappush(runs[left], (first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            k = bisect_left(room, length)
            if k == len(room):  # new sequences: as many as take all that is left, each filled as far as it goes
                each = limit // length
                n = -(-todo // each)
                put(limit, opened, n)
                opened += n
                continue
            left = room[k]
            first, n = heapq.heappop(runs[left])
            if not runs[left]:
                del runs[left], room[k]
            # a run's sequences are filled one after the other: the room left fits this length best until it is too small
            each = left // length
            full, rest = divmod(todo, each)
            full = min(full, n)
            for j in range(each if full else 0):
                slots.append((length, rank + j * full, full, first, limit - left + j * length))
            rank, todo = rank + full * each, todo - full * each
            put(left - each * length, first, full)
            if full < n and todo:  # then todo < each: one sequence takes the rest
                for j in range(todo):
                    slots.append((length, rank + j, 1, first + full, limit - left + j * length))
                put(left - todo * length, first + full, 1)
                put(left, first + full + 1, n - full - 1)
                todo = 0
            else:
                put(left, first + full, n - full)
    return slots


def tokenized_pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of at most `limit` ids; a document ends with id 1.

    `salt` numbers the pieces that a task makes, so that copies of a row, whatever their id, can be dealt to buckets.
    """
    small_batches(docs.sparkSession)
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, made = word_bpe(path, LibraryBpe), 0
        for batch in batches:
            rows, crcs = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                ids = bpe.encode(t) + end
                for at in range(0, len(ids), 4 * limit):
                    rows.append((k, at // (4 * limit), at // 4, min(limit, (len(ids) - at) // 4)))
                    crcs.append(zlib.crc32(ids[at : at + 4 * limit]))
            a = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a[:, 0])), pa.array(a[:, 1].astype(np.int32)), pa.array(a[:, 2]), pa.array(a[:, 3]), pa.array(crcs, pa.int64()), pa.array(np.arange(made, made + len(a)))], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
            made += len(a)

    return docs.select("doc_id", text_of().alias("t")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, salt long")


def assign_slots(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`pieces` (of tokenized_pieces, with its salt) with sequence_id and offset. It must read the same rows each time: a written table, say.

    Only the histogram (at most `limit` rows) reaches the driver, and only the plan, whose size depends on `limit`
    alone, goes to the tasks. Equal rows take different slots.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = np.array(sorted(plan_best_fit(counts, limit)), np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast((slots[:, 0] << 44 | slots[:, 1], slots))
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(buckets)).cast("long")
    own = pieces.withColumn("bucket", bucket)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "salt")
    ranked = own.withColumn("r", F.row_number().over(inside)).join(offsets, ["length", "bucket"]).withColumn("r", F.col("r") - 1 + F.col("skip"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, of = plan.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "r"))
            s = of[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(s[:, 3] + rank - s[:, 1]), pa.array(s[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "r").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's ids in sequences of `limit`.

    A null or empty text is one piece with the end id alone; equal or null ids are separate documents; other
    columns are ignored; no documents give no rows. Sequences are filled without gaps from offset 0.
    """
    return assign_slots(written(tokenized_pieces(docs, path, limit), "pieces"), limit)
