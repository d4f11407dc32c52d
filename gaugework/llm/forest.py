"""Embedding near-duplicates by a forest of random-projection trees.

Vectors of one label (and length) are split again and again by the median of their
projections on a random direction. The ``spill`` share of a node's vectors next to the cut, on each
side of it, goes both ways. Each of ``trees`` trees ends in leaves of at most ``leaf`` vectors, and vectors
are compared within leaves, by cosine in double precision; nothing below ``least`` is ever linked.

A node in which a quarter of sampled pairs or more are links is a leaf at any size:
splitting it would lose links, and comparing it whole costs a few times the links that it holds.
Large leaves are compared in blocks, each pair of blocks by a task of its own.

Equal vectors of a label are one vector with a number of copies. A node of more than ``shard`` vectors is split
by thresholds fitted on about ``SAMPLE`` of its vectors, one table row per node, until a
task can take each node whole; every vector takes part in every tree.

Links are counted, never listed: a pair that meets in several leaves counts in the first leaf
that both are in. Of the links of a leaf a spanning forest is passed on, and components are found
by contraction over those edges.

Vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with
nothing. Vectors of different lengths are not compared. Repeated rows and ids count each on its
own. Rows without a vec_id link like others, but name no component and are never kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.components import components
from gaugework.session import stored

LEAST = 0.93
TREES, LEAF, SPILL = 6, 512, 0.05
#: Vectors that a task takes whole, vectors that thresholds are fitted on, levels fitted at a time.
SHARD, SAMPLE, DEPTH = 20_000, 2_048, 4
#: Vectors of a block when a large leaf is compared.
BLOCK = 1_024
#: A node with this share of links among sampled pairs is not split.
DENSE = 0.25

NODE = ["tree", "label", "dim", "node"]
LEAVES = "id long, leaf int"
FOUND = "a long, b long, n long"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.empty((0, 1))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def direction(seed: tuple[int, ...], dim: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(dim)


def is_dense(units: np.ndarray, least: float, seed: tuple[int, ...]) -> bool:
    """Whether splitting these would cut more links than it saves comparisons."""
    draw = np.random.default_rng(seed)
    a, b = draw.integers(len(units), size=(2, 2048))
    a, b = a[a != b], b[a != b]
    return len(a) > 0 and ((units[a] * units[b]).sum(1) >= least).mean() >= DENSE


def ordered(projected: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows by projection, ties by id, so that halves are halves even if all project alike."""
    return np.lexsort((ids, projected))


def leaves_of(units: np.ndarray, ids: np.ndarray, seed: tuple[int, ...], leaf: int, spill: float, least: float):
    """Row numbers of each leaf of the tree grown over ``units``."""
    open_nodes = [(np.arange(len(units)), 1)]
    while open_nodes:
        rows, node = open_nodes.pop()
        if len(rows) <= leaf or is_dense(units[rows], least, (*seed, node, 1)):
            yield rows
            continue
        at = ordered(units[rows] @ direction((*seed, node, 0), units.shape[1]), ids[rows])
        half, more = len(rows) // 2, int(len(rows) * spill)
        open_nodes.append((rows[at[: half + more]], 2 * node))
        open_nodes.append((rows[at[half - more :]], 2 * node + 1))


def _seed(group: pa.Table, *more: int) -> tuple[int, ...]:
    """From the node alone, so that an attempt grows the tree that the attempt before it grew."""
    return (*(zlib.crc32(str(group.column(name)[0].as_py()).encode()) for name in NODE), *more)


def _grow(leaf: int, spill: float, least: float):
    """The leaves of every vector of a node that a task takes whole."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending")])
        ids, units = group.column("id").to_numpy(), unit(_matrix(group.column("vector")))
        found = list(leaves_of(units, ids, _seed(group, 2), leaf, spill, least))
        rows = np.concatenate(found)
        numbers = np.repeat(np.arange(len(found), dtype=np.int32), [len(part) for part in found])
        return pa.table({"id": ids[rows], "leaf": numbers})

    return run


FITTED = (
    "tree int, label string, dim int, node long, dense boolean, levels int, lows array<double>, highs array<double>, "
    "low_ids array<long>, high_ids array<long>"
)


def _fit(shard: int, spill: float, least: float):
    """Thresholds of the next levels of a large node, from a sample of it."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending")])
        ids, units = group.column("id").to_numpy(), unit(_matrix(group.column("vector")))
        n = group.column("n")[0].as_py()
        seed = _seed(group, 3)
        levels = min(DEPTH, max(1, math.ceil(math.log2(n / shard))))
        dense = is_dense(units, least, (*seed, 1))
        bounds = [(0.0, 0, 0.0, 0)] * (1 << levels)
        inside = {1: np.arange(len(units))}
        for node in range(1, 1 << levels):
            rows = inside.pop(node)
            p = units[rows] @ direction((*seed, node, 0), units.shape[1])
            at = ordered(p, ids[rows])
            half, more = len(rows) // 2, int(len(rows) * spill)
            low, high = at[max(half - more, 0)], at[min(half + more, len(rows) - 1)]
            bounds[node] = (float(p[low]), int(ids[rows[low]]), float(p[high]), int(ids[rows[high]]))
            # A sample too thin to go on is used again, so that there is always a threshold.
            left, right = rows[at[: half + more]], rows[at[half - more :]]
            inside[2 * node], inside[2 * node + 1] = (left, right) if min(len(left), len(right)) > 8 else (rows, rows)
        row = {name: [group.column(name)[0].as_py()] for name in NODE}
        row |= {"dense": [dense], "levels": [levels]}
        for k, name in enumerate(("lows", "low_ids", "highs", "high_ids")):
            row[name] = [[bound[k] for bound in bounds]]
        types = {"tree": pa.int32(), "label": pa.string(), "dim": pa.int32(), "node": pa.int64(), "dense": pa.bool_()}
        types |= {"levels": pa.int32(), "lows": pa.list_(pa.float64()), "highs": pa.list_(pa.float64())}
        types |= {"low_ids": pa.list_(pa.int64()), "high_ids": pa.list_(pa.int64())}
        return pa.table({name: pa.array(row[name], kind) for name, kind in types.items()})

    return run


def _route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of large nodes sent down the fitted levels, to both sides next to a cut."""
    for batch in batches:
        names = [batch.column(name).to_pylist() for name in NODE]
        keys = list(zip(*names, strict=True))
        # Rows of one node together.
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(keys):
            groups.setdefault(key, []).append(i)
        for rows in groups.values():
            part = pa.Table.from_batches([batch.select(["id", "vector", *NODE]).take(pa.array(rows))])
            ids, units = part.column("id").to_numpy(), unit(_matrix(part.column("vector")))
            one = batch.slice(rows[0], 1).to_pylist()[0]
            seed, levels = _seed(part, 3), one["levels"]
            inside = {1: np.arange(len(ids))}
            for node in range(1, 1 << levels):
                at = inside.pop(node)
                if len(at):
                    p, i = units[at] @ direction((*seed, node, 0), units.shape[1]), ids[at]
                    low, high = one["lows"][node], one["highs"][node]
                    left = at[(p < high) | ((p == high) & (i < one["high_ids"][node]))]
                    right = at[(p > low) | ((p == low) & (i >= one["low_ids"][node]))]
                else:
                    left = right = at
                inside[2 * node], inside[2 * node + 1] = left, right
            for child, at in inside.items():
                if len(at):
                    out = part.take(pa.array(at)).combine_chunks()
                    below = (one["node"] << DEPTH) + child - (1 << levels)
                    out = out.set_column(5, "node", pa.array(np.full(len(at), below, np.int64)))
                    yield from out.to_batches()


def forest(vectors: DataFrame, trees: int, leaf: int, spill: float, least: float, shard: int) -> DataFrame:
    """(id, key): the leaves, of all trees, that each of ``vectors`` (id, label, dim, vector) is in."""
    vector = vectors.schema["vector"].dataType.simpleString()
    rows = vectors.select(
        "id",
        "vector",
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
        "label",
        "dim",
        F.lit(0).cast("long").alias("node"),
    )
    found, turn = [], 0
    while True:
        sizes = rows.groupBy(*NODE).agg(F.count("*").alias("n"))
        sized = rows.join(sizes, NODE)
        key = F.xxhash64(*NODE, F.lit(turn), "leaf").alias("key")
        small = sized.where(F.col("n") <= shard).groupBy(*NODE)
        grown = small.applyInArrow(_with_node(_grow(leaf, spill, least)), f"{LEAVES}, tree int, label string, dim int, node long")
        found.append(grown.select("id", key))
        large = sized.where(F.col("n") > shard)
        if sizes.where(F.col("n") > shard).isEmpty():
            break
        share = F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE))
        sample = large.where(F.pmod(F.xxhash64(F.lit(turn), "tree", "id"), share) == 0)
        fitted = stored(sample.groupBy(*NODE).applyInArrow(_fit(shard, spill, least), FITTED), "fitted")
        sent = large.join(fitted, NODE)
        found.append(sent.where("dense").select("id", F.xxhash64(*NODE, F.lit(turn), F.lit(-1)).alias("key")))
        schema = f"id long, vector {vector}, tree int, label string, dim int, node long"
        rows = stored(sent.where("NOT dense").mapInArrow(_route, schema), "nodes")
        turn += 1
    keys = found[0]
    for more in found[1:]:
        keys = keys.unionByName(more)
    return keys


def _with_node(function):
    """``function`` of a group, with the group's node beside its rows."""

    def run(group: pa.Table) -> pa.Table:
        made = function(group)
        for name in NODE:
            column = pa.array([group.column(name)[0].as_py()] * len(made), group.schema.field(name).type)
            made = made.append_column(name, column)
        return made

    return run


def _earlier(keys: list[np.ndarray], key: int) -> np.ndarray:
    """The leaves before ``key`` of each row, as small numbers, padded by -1."""
    before = [own[own < key] for own in keys]
    width = max(map(len, before), default=0)
    flat = np.concatenate(before) if before else np.empty(0, np.int64)
    _, numbers = np.unique(flat, return_inverse=True)
    out, at = np.full((len(keys), width), -1, np.int32), 0
    for i, own in enumerate(before):
        out[i, : len(own)] = numbers[at : at + len(own)]
        at += len(own)
    return out


def _spanning(links: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the graph with this symmetric matrix."""
    new = np.ones(len(links), bool)
    for start in range(len(links)):
        if not new[start]:
            continue
        new[start] = False
        front = [start]
        while front:
            at = front.pop()
            near = np.nonzero(links[at] & new)[0]
            new[near] = False
            for other in near.tolist():
                yield at, other
            front.extend(near.tolist())


def compare(units: np.ndarray, sides: np.ndarray | None, copies: np.ndarray, keys: list, key: int, least: float):
    """Linked copies of each row that no earlier leaf has counted, and edges that span the links.

    Where ``sides`` are given, only pairs across them are compared.
    """
    cosine = units @ units.T
    links = cosine >= least
    np.fill_diagonal(links, False)
    if sides is not None:
        links &= sides[:, None] != sides[None]
    counted = np.zeros(len(units), np.int64)
    a, b = np.nonzero(np.triu(links))
    earlier = _earlier(keys, key) if len(a) else None
    for at in range(0, len(a), 1 << 16):  # bounds the comparisons of leaves held at once
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        met = np.zeros(len(i), bool)
        for column in earlier.T:
            own = column[i]
            met |= ((own[:, None] == earlier[j]) & (own >= 0)[:, None]).any(1)
        i, j = i[~met], j[~met]
        np.add.at(counted, i, copies[j])
        np.add.at(counted, j, copies[i])
    return counted, list(_spanning(links))


def _links(least: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending")])
        ids, mine, low, high = (group.column(name).to_numpy() for name in ("id", "mine", "low", "high"))
        sides = mine if low[0] != high[0] else None
        lists = group.column("keys").combine_chunks()
        keys = [np.asarray(own.values) for own in lists]
        units, copies = unit(_matrix(group.column("vector"))), group.column("copies").to_numpy()
        counted, edges = compare(units, sides, copies, keys, group.column("key")[0].as_py(), least)
        at = np.nonzero(counted)[0]
        ends = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[at], ids[ends[:, 0]]])),
                "b": pa.chunked_array([pa.nulls(len(at), pa.int64()), pa.array(ids[ends[:, 1]])]),
                "n": pa.array(np.concatenate([counted[at], np.zeros(len(ends), np.int64)])),
            }
        )

    return run


def near_links(
    classes: DataFrame, trees: int, leaf: int, spill: float, least: float, shard: int, block: int = BLOCK
) -> DataFrame:
    """(a, b, n) over ``classes`` (id, label, dim, vector, copies): copies linked to a, or, with b, an edge."""
    keys = stored(forest(classes, trees, leaf, spill, least, shard), "leaves").distinct()
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keys.join(sizes, "key"), "leaves")
    # A vector is in a few leaves per tree.
    own = shared.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    rows = shared.join(classes.join(own, "id"), "id")
    # Leaves of several blocks: each pair of blocks is a group.
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(7), "id"), blocks).cast("int")
    rows = rows.withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    rows = rows.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    rows = rows.select("id", "vector", "copies", "keys", "key", "mine", "label", "dim", "low", "high")
    return rows.groupBy("label", "dim", "key", "low", "high").applyInArrow(_links(least), FOUND)


def usable(vector: Column, label: Column) -> Column:
    """Whether a row can link at all."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    told = vector.isNotNull() & label.isNotNull() & ~wrong & F.exists(vector, lambda x: x != 0)
    return F.coalesce(told, F.lit(False))


def near_duplicates(
    rows: DataFrame,
    least: float = LEAST,
    trees: int = TREES,
    leaf: int = LEAF,
    spill: float = SPILL,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row (vec_id, embedding, label)."""
    rows = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"))
    can = usable(F.col("vector"), F.col("label"))
    # Minus zero is zero, so that equal vectors are equal bytes.
    plain = F.transform("vector", lambda x: F.when(x == 0, F.lit(0).cast(_element(rows))).otherwise(x))
    linked = rows.where(can).select("vec_id", "label", plain.alias("vector"))
    found = linked.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    number = F.monotonically_increasing_id().alias("id")
    classes = stored(found.select(number, "label", F.size("vector").alias("dim"), "vector", "copies", "least"), "classes")
    narrow = classes.select("id", "label", "dim", "vector", "copies")
    links = stored(near_links(narrow, trees, leaf, spill, least, shard, block), "links")
    many = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(links.where("b IS NOT NULL").select("a", "b"))
    told = classes.join(many, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    told = told.withColumn("root", F.coalesce("root", "id"))
    # Two hashes of the vector stand for it, so that rows meet their classes without their vectors.
    marks = [F.xxhash64(F.lit(k), "vector").alias(f"mark{k}") for k in (1, 2)]
    names = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(names, "root").select(
        "label", *marks, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    joined = linked.select("vec_id", "label", *marks).join(told, ["label", "mark1", "mark2"])
    joined = joined.select("vec_id", "n_links", "component_id")
    alone = rows.where(~can).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return joined.unionByName(alone).select("vec_id", "n_links", "component_id", kept)


def _element(rows: DataFrame):
    return rows.schema["vector"].dataType.elementType
