"""A uniform random shuffle into shards of exact sizes, by a communication matrix.

Rows lie in blocks. For a uniform permutation of all rows, the numbers of rows
that go from each block to each shard follow a multivariate hypergeometric law with
the blocks' sizes and the shards' sizes as margins. The matrix is drawn exactly,
with a few numbers per block; then each block permutes its rows and deals them out
by its row of the matrix, rows are exchanged, and each shard permutes what it got.
Sizes of shards differ by at most one row.

Only DataFrame functions touch rows. The driver sees the blocks' sizes alone.
Any row counts, whatever its columns hold: null texts are empty, equal rows and
equal or null ids stay apart because rows are numbered in a stored table first.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.tables import running_base, text_of
from gaugework.session import stored

#: Rows of a block, and of a part of a shard, in the mean: what one task sorts.
TASK_ROWS = 1 << 18


def hypergeometric(draw: random.Random, good: int, bad: int, taken: int) -> int:
    """How many of ``taken`` from ``good + bad`` are good; for any size.

    Inverts the distribution outwards from its mode, by the ratios of neighbouring
    probabilities, until what is left cannot matter in double precision.
    """
    low, high = max(0, taken - bad), min(good, taken)
    mode = min(high, max(low, (taken + 1) * (good + 1) // (good + bad + 2)))
    up, down, weight, k = [], [], 1.0, mode
    while k < high and weight > 1e-20:
        weight *= (good - k) * (taken - k) / ((k + 1) * (bad - taken + k + 1))
        k += 1
        up.append(weight)
    weight, k = 1.0, mode
    while k > low and weight > 1e-20:
        weight *= k * (bad - taken + k) / ((good - k + 1) * (taken - k + 1))
        k -= 1
        down.append(weight)
    left = draw.random() * (1.0 + sum(up) + sum(down)) - 1.0
    for step, weights in ((1, up), (-1, down)):
        for i, weight in enumerate(weights, 1):
            if left < 0:
                return mode
            left -= weight
            if left < 0:
                return mode + step * i
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Exact counts from each block to each shard."""
    draw, free = random.Random(seed), list(shards)
    matrix = []
    for size in blocks:
        row, rest, others = [], size, sum(free)
        for j, room in enumerate(free):
            others -= room
            row.append(hypergeometric(draw, room, others, rest))
            rest -= row[-1]
        free = [room - n for room, n in zip(free, row, strict=True)]
        matrix.append(row)
    return matrix


def shard(docs: DataFrame, shards: int = 24, seed: int = 7, task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; slots are gapless from 0.

    Blocks and parts number by rows / ``task_rows``, so tasks keep their size at any
    scale. Which row goes where depends on the seed and on the rows' places in the
    input's splits: the same input, split the same way, gives the same shards.
    """
    text = text_of()
    measured = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = stored(measured, "rows")  # pins the numbers
    total = rows.count()
    blocks = max(16, -(-total // task_rows))
    parts = max(4, -(-total // (task_rows * shards)))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(blocks)))
    sizes = {r["block"]: r["count"] for r in dealt.groupBy("block").count().collect()}
    exact = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([sizes.get(b, 0) for b in range(blocks)], exact, seed)
    # A row per block; the end of each shard's range of places within the block.
    ends = []
    for b, row in enumerate(matrix):
        reach = 0
        ends.append((b, [reach := reach + n for n in row]))
    ends = docs.sparkSession.createDataFrame(ends, "block long, ends array<long>")

    place = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "row"), "row"))
    sent = (
        dealt.withColumn("place", place)
        .join(ends, "block")
        .withColumn("shard", F.size(F.filter("ends", lambda end: end < F.col("place"))))
        .withColumn("order", F.xxhash64(F.lit(seed + 2), "row"))
        .withColumn("part", F.shiftrightunsigned("order", 33).cast("long") * F.lit(parts) / F.lit(float(1 << 31)))
        .withColumn("part", F.floor("part"))
        .select("row", "doc_id", "size", "text_crc32", "shard", "order", "part")
    )
    # The order's leading bits choose the part, its rest the place within: sorting
    # parts one by one sorts the shard. Rows of this table: shards times parts.
    sent = stored(sent, "sent")
    bases = running_base(sent.groupBy("shard", "part").agg(F.count("*").alias("n")), ["shard"], ["part"], "n", "base")
    by_order = Window.partitionBy("shard", "part").orderBy(F.shiftrightunsigned("order", 0), "row")
    return (
        sent.withColumn("slot", F.row_number().over(by_order) - 1)
        .join(bases.drop("n"), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("slot")).alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """:func:`shard` with the name of its law; a new shard would move rows, so ``grown_shard`` is null."""
    return shard(docs, shards).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
