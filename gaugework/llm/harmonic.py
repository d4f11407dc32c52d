"""Packing token ids into sequences by reciprocal-capacity classes (harmonic packing).

With capacity C, a piece of length n is of class k = C div n: k such pieces fit
into a sequence, whatever their exact lengths. Sequences of a class are filled with
exactly k pieces, in order of a global number that a worker gets from prefix sums
of counts, so that workers need not see each other's pieces.

A document is cut so that its pieces nearly fill their classes: whole sequences
first, then, from what is left, a piece of exactly C div (k + 1) as long as the
waste within the class would exceed ``slack``, at most ``cuts`` times. What is left
over in each class, fewer than k pieces, is at most about C ln C pieces in all; one
task packs those by first fit decreasing.

Null texts are empty; an empty text is its end id alone. Rows that share a doc_id
are packed as documents of their own. Null doc_ids stay null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.bpe import encoder
from gaugework.llm.tables import running_base, text_of
from gaugework.session import stored

CAPACITY = 2048
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, class int, task int, number int"
PACKED = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset int"
PACKED_NAMES = [field.split()[0] for field in PACKED.split(", ")]


def cut(n: int, capacity: int = CAPACITY, cuts: int = 2, slack: int = 24) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    pieces, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        k = capacity // rest
        if cuts == 0 or capacity // k - rest <= slack or capacity // (k + 1) == 0:
            return [*pieces, rest]
        pieces.append(capacity // (k + 1))
        rest -= pieces[-1]
        cuts -= 1
    return pieces


def _pieces(vocabulary: str, end: int, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, last, number = encoder(vocabulary), np.array([end], "<u4").tobytes(), {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            made = []
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc, ids, start = doc.as_py(), encode.encode(text.as_py()) + last, 0
                for n in cut(total := len(ids) // 4, capacity):
                    crc, k = zlib.crc32(ids[4 * start : 4 * (start + n)]), capacity // n
                    number[k] = number.get(k, -1) + 1
                    made.append((doc, start, n, crc, total, k, task, number[k]))
                    start += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(column, kind)
                    for column, kind in zip(
                        zip(*made, strict=True) if made else [[]] * 8,
                        [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()],
                        strict=True,
                    )
                ],
                names=[field.split()[0] for field in PIECES.split(", ")],
            )

    return run


def _first_fit(capacity: int):
    """Packs the few pieces left over; bins are numbered from 0."""

    def run(left: pa.Table) -> pa.Table:
        left = left.sort_by([("length", "descending"), *((c, "ascending") for c in ("class", "task", "number"))])
        room = np.empty(0, np.int64)
        bins, offsets = [], []
        for n in left.column("length").to_numpy():
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                room, fits = np.append(room, capacity), [len(room)]
            bins.append(at := int(fits[0]))
            offsets.append(int(capacity - room[at]))
            room[at] -= n
        kept = left.select(PACKED_NAMES[:5])
        kept = kept.append_column("sequence_id", pa.array(bins, pa.int64()))
        return kept.append_column("offset", pa.array(offsets, pa.int32()))

    return run


def pack(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end: int = 1, capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Only the encoding reads texts; all later steps move a few numbers per piece.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(vocabulary, end, capacity), PIECES), "pieces")
    # Rows of this table: tasks times classes, and classes.
    counts = stored(pieces.groupBy("class", "task").agg(F.count("*").alias("n")), "counts")
    bases = running_base(counts, ["class"], ["task"], "n", "base").drop("n")
    full = counts.groupBy("class").agg(F.floor(F.sum("n") / F.col("class")).alias("full"))
    full = running_base(full, [], ["class"], "full", "first")
    tail = full.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("sequences")).first()["sequences"]

    placed = (
        pieces.join(bases, ["class", "task"])
        .join(F.broadcast(full), "class")  # at most 2 sqrt(capacity) classes
        .withColumn("at", F.col("base") + F.col("number"))
        .withColumn("bin", F.floor(F.col("at") / F.col("class")))
    )
    inside = F.col("bin") < F.col("full")
    before = Window.partitionBy("class", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    packed = (
        placed.where(inside)
        .withColumn("sequence_id", F.col("first") + F.col("bin"))
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("int"))
        .select(PACKED_NAMES)
    )
    left = placed.where(~inside).select(pieces.columns).groupBy(F.lit("left")).applyInArrow(_first_fit(capacity), PACKED)
    whole = packed.unionByName(left.withColumn("sequence_id", F.col("sequence_id") + F.lit(tail)))
    return whole.withColumns({name: F.col(name).cast("long") for name in ("length", "offset")})
