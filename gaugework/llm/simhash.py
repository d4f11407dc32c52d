"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets a nonzero vector of r + 1 bits; each nonzero vector v of
r + 1 bits gives a mask with the bits whose vectors have an odd product with v. For any r bits there is a
v orthogonal to all their vectors, so two fingerprints that differ in at most r
bits agree under at least one of the 2^(r+1) - 1 masks: no pair is missed. A mask
keeps about half of the bits.

Equal fingerprints are one node. Buckets of more than ``bucket`` fingerprints are
masked again over the bits that their mask left out, with the same guarantee, as
often as needed: under a mask of all but b bits a bucket has at most 2^b fingerprints. Within a
bucket, a task compares fingerprints and returns a spanning forest of the links,
not all pairs. Nothing is capped. Tables of a row for each mask or fingerprint are joined
by shuffles and never broadcast, as they grow with the documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.components import components
from gaugework.llm.tables import text_of, unsent, unsent_if_large
from gaugework.session import stored

BITS = 64
SEED = 42


def simhash(text: str | None, shingle: int = 4) -> int:
    """Fingerprint of one text: the majority of the shingles' hashes, bit by bit."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    # Words joined once; a shingle is a slice from one word's start to another's end.
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of long texts
        part = hashes[at : at + (1 << 16)].view("u1").reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py(), shingle) for t in batch.column("text")], "u8").view("i8")
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "fp", pa.array(found))

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of each row; null texts are empty, their fingerprint is 0."""
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over ``positions`` of which one at least avoids any ``radius`` of them.

    Unit vectors are given first, so that no mask is empty once there are radius + 1 positions.
    """
    vectors = sorted(range(1, 1 << (radius + 1)), key=lambda u: u.bit_count() > 1)
    given = dict(zip(positions, itertools.cycle(vectors), strict=False))
    return [sum(1 << p for p, u in given.items() if (u & v).bit_count() % 2) for v in vectors]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _finer(radius: int):
    """Rows of large buckets under masks that keep more bits.

    What the bucket's own mask keeps is equal within it, so its pairs differ in the
    other bits, and a covering of those misses none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in batches:
            fps = batch.column("fp").to_numpy().view("u8")
            masks = batch.column("mask").to_numpy().view("u8")
            for mask in np.unique(masks).tolist():
                if mask not in known:
                    left = [p for p in range(BITS) if not mask >> p & 1]
                    known[mask] = sorted({mask | more for more in covering_masks(left, radius)})
                own = fps[masks == mask]
                for new in known[mask]:
                    columns = (own, np.full(len(own), new, "u8"), own & np.uint64(new))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column.view("i8")) for column in columns], names=["fp", "mask", "key"]
                    )

    return run


def _forest(radius: int):
    """Links within each bucket: a spanning forest, grown breadth-first."""

    def links(fps: np.ndarray) -> Iterator[tuple[int, int]]:
        rest = fps.view("u8")
        while len(rest) > 1:
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                apart = np.bitwise_count(front[0] ^ rest) <= radius
                for other in rest[apart]:
                    yield int(front[0]), int(other)
                front, rest = np.concatenate([front[1:], rest[apart]]), rest[~apart]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pair for fps in batch.column("fps") for pair in links(fps.values.to_numpy())]
            pairs = np.array(found, "u8").reshape(-1, 2).view("i8")
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = 4, bucket: int = 1024) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fps`` (fp) that connect all within ``radius``."""
    masks = [F.lit(_signed(mask)) for mask in covering_masks(list(range(BITS)), radius)]
    rows = fps.select("fp", F.explode(F.array(*masks)).alias("mask"))
    rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    found = []
    while True:
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = stored(rows.join(unsent(sizes), ["mask", "key"]), "buckets")
        lists = shared.where(F.col("n") <= bucket).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(lists.select("fps").mapInArrow(_forest(radius), "a long, b long"))
        large = shared.where(F.col("n") > bucket).select("fp", "mask")
        if large.isEmpty():
            break
        rows = large.mapInArrow(_finer(radius), "fp long, mask long, key long")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def classes_of(rows: DataFrame, least, radius: int, bucket: int) -> DataFrame:
    """(fp, least) of stored ``rows`` (fp, ...): the least of ``least`` in the whole component of each fingerprint."""
    classes = stored(rows.groupBy("fp").agg(F.min(least).alias("least")), "classes")
    found = components(links(classes.select("fp"), radius, bucket))
    # Fingerprints that are linked to no other are their own root.
    rooted = classes.join(unsent_if_large(found.select(F.col("node").alias("fp"), "root")), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("least"))
    named = rooted.select("fp", "root").join(unsent(named), "root")
    return unsent_if_large(stored(named.select("fp", "least"), "named"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, bucket: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row.

    The component is named by the smallest doc_id in it (null if none has one).
    Rows without words share the fingerprint zero and link like any other.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    named = classes_of(rows, F.col("doc_id"), radius, bucket)
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", shown, F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4, bucket: int = 1024) -> DataFrame:
    """The row with the smallest doc_id of each component; of rows with the same one, the first.

    Only fingerprints are grouped; of the texts, one join drops those that go. It shuffles them
    where too many rows stay to be broadcast.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"))
    kept = rows.select("row", "doc", text_of("doc.text").alias("text"))
    kind = kept.schema["doc"].dataType.simpleString()
    # Stored with their texts, so that the rows' numbers stay the same.
    kept = stored(kept.mapInArrow(_fingerprints(shingle), f"row long, doc {kind}, fp long"), "fingerprints")
    narrow = kept.select("row", "fp", F.col("doc.doc_id").alias("doc_id"))
    named = classes_of(narrow.withColumn("order", order), F.col("order"), radius, bucket)
    stay = named.select(F.col("least.row").alias("row")).distinct()
    return kept.join(stay, "row", "left_semi").select("doc.*")
