"""A Merkle manifest of documents: a tree per source, and one over the sources' roots.

A node is the SHA-256, in lower-case hexadecimal, of its children's digests written one
after another. A parent keeps, for each child slot, a copy of the hash state as it is before that
slot, its left children read. Folding a replaced child upwards resumes that copy with the
replacement and the right siblings alone. A state lives within a task; between tasks it goes as
what it has read, the left siblings, which a proof needs as well, and is taken up once for all
documents below that node.

Leaves get their places within their source by range partitioning, so that a source with
most documents is spread over tasks. A task then works on an aligned block of 3^8
places, the eight levels of one subtree: one pass for every eight levels, up to the roots,
and one back, in which every node's path of siblings is put together. Only the last pass sees documents,
as pairs of digests; texts are read once, and never shuffled.

A leaf is the hash of doc_id, source, lang, n_chars and text, each ``-`` if null, else its
UTF-8 byte count, a colon and the value. Null doc_ids come first in their source; equal doc_ids
are in order of their leaves, and equal rows have equal leaves. Null sources are a
tree of their own, before all others. A tree of one leaf is that leaf. Without documents there is no root and no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.operators.positions import positions_by_range
from gaugework.session import stored

#: Children of a parent, and levels of a block.
ARITY, LEVELS = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "tree string, place long, digest string, n long, block long"
PATHS = "tree string, place long, steps array<struct<left: string, right: string>>, subroot string, root string"
PROOFS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def leaf(**changed: Column) -> Column:
    """The leaf of a row, some of its fields replaced."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)).cast("binary"), 256)


def depth(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Parent:
    """Hash states before each child's slot, and the children after it."""

    def __init__(self, children: list[str]):
        state = hashlib.sha256()
        self.before, self.children = [], children
        for child in children:
            self.before.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def left(self, slot: int) -> str:
        return "".join(self.children[:slot])

    def right(self, slot: int) -> str:
        return "".join(self.children[slot + 1 :])


def resumed(state, replacement: str, right: str) -> str:
    """The parent's digest with another child in the slot that ``state`` stands before."""
    state = state.copy()
    state.update(replacement.encode())
    state.update(right.encode())
    return state.hexdigest()


def subtree(digests: list[str], levels: int) -> list[list[Parent]]:
    """The parents of each level over ``digests``, the lowest first."""
    grown = []
    for _ in range(levels):
        parents = [Parent(digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]
        digests = [parent.digest for parent in parents]
        grown.append(parents)
    return grown


def _sorted(group: pa.Table) -> pa.Table:
    return group.sort_by([("place", "ascending")])


def _node(group: pa.Table) -> pa.Table:
    """The node at the top of a block."""
    group = _sorted(group)
    tree, place, n = (group.column(name)[0].as_py() for name in ("tree", "place", "n"))
    digests = group.column("digest").to_pylist()
    grown = subtree(digests, min(LEVELS, depth(n)))
    digest = grown[-1][0].digest if grown else digests[0]
    many = ARITY**LEVELS
    place //= many
    made = {"tree": tree, "place": place, "digest": digest, "n": -(-n // many), "block": place // many}
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.table({name: pa.array([made[name]], kind) for name, kind in zip(made, kinds, strict=True)})


def climb(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (tree, place, digest, n: the nodes of the tree) and every eighth level above, to one node per tree."""
    passes = [nodes]
    while (passes[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rows = passes[-1].select("tree", "place", "digest", "n", "block")
        passes.append(stored(rows.groupBy("tree", "block").applyInArrow(_node, NODES), "nodes"))
    return passes


def _folds(group: pa.Table) -> Iterator[tuple[int, list[tuple[Parent, int]]]]:
    """Each row of a block with its parents within the block and its slot in each, the lowest first."""
    n = group.column("n")[0].as_py()
    grown = subtree(group.column("digest").to_pylist(), min(LEVELS, depth(n)))
    for i in range(len(group)):
        at, own = i, []
        for parents in grown:
            own.append((parents[at // ARITY], at % ARITY))
            at //= ARITY
        yield i, own


def _paths(group: pa.Table, above: pa.Table) -> pa.Table:
    """The siblings on the way of each node of a block to the root of all."""
    group, above = _sorted(group), above.to_pylist()[0]
    steps = [
        [{"left": parent.left(slot), "right": parent.right(slot)} for parent, slot in own] + above["steps"]
        for _, own in _folds(group)
    ]
    step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    many = len(group)
    return pa.table(
        {
            "tree": group.column("tree"),
            "place": group.column("place"),
            "steps": pa.array(steps, step),
            "subroot": pa.array([above["subroot"]] * many, pa.string()),
            "root": pa.array([above["root"]] * many, pa.string()),
        }
    )


def _proofs(group: pa.Table, above: pa.Table) -> pa.Table:
    """The proof of each leaf of a block, and the root that its ``now`` folds to."""
    group, above = _sorted(group), above.to_pylist()[0]
    # The states of the nodes above, taken up once for all leaves of the block.
    upper = [(hashlib.sha256(step["left"].encode()), step["right"]) for step in above["steps"]]
    siblings = "".join(step["left"] + step["right"] for step in above["steps"]).encode()
    now, root = group.column("now").to_pylist(), above["root"]
    proofs, folded = [], []
    for i, own in _folds(group):
        digest, proof = now[i], hashlib.sha256()
        for parent, slot in own:
            proof.update((parent.left(slot) + parent.right(slot)).encode())
            digest = resumed(parent.before[slot], digest, parent.right(slot))
        proof.update(siblings)
        for state, right in upper:
            digest = resumed(state, digest, right)
        proofs.append(proof.hexdigest())
        folded.append(digest)
    many = len(group)
    return pa.table(
        {
            "doc_id": group.column("doc_id").cast(pa.int64()),
            "leaf": group.column("digest"),
            "subroot": pa.array([above["subroot"]] * many, pa.string()),
            "root": pa.array([root] * many, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([digest == root for digest in folded], pa.bool_()),
        }
    )


def _with_above(rows: DataFrame, above: DataFrame):
    """Blocks of ``rows``, each beside the one row of ``above`` for the block's top."""
    return rows.groupBy("tree", "block").cogroup(above.groupBy("tree", F.col("place").alias("block")))


def _descend(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the nodes of the second pass, the tops of the leaves' blocks."""
    for nodes in reversed(passes[1:-1]):
        rows = nodes.select("tree", "place", "digest", "n", "block")
        above = stored(_with_above(rows, above).applyInArrow(_paths, PATHS), "paths")
    return above


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0 in ``order`` within ``tree``, ``block``, and ``n``, the tree's rows.

    A tree's size meets its rows by blocks, so that a tree with most rows is no hot key.
    """
    many = ARITY**LEVELS
    found = positions_by_range(rows, ["tree"], order).withColumnRenamed("position", "place")
    found = stored(found.withColumn("block", F.expr(f"place div {many}")), "placed")
    sizes = found.groupBy("tree").agg((F.max("place") + 1).alias("n"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {many}"))).alias("block")
    return found.join(sizes.select("tree", "n", blocks), ["tree", "block"])


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    ``folded_root`` is what the row's leaf folds to with its siblings as they were, where
    ``where`` holds with the fields ``tampered`` replaced; ``verified`` says whether it is the root.
    ``proof_sha256`` is the hash of the siblings, level by level, left to right.
    """
    # Null sources first, the others by their bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree")
    now = F.when(where, leaf(**tampered)).otherwise(leaf()) if tampered else leaf()
    leaves = stored(docs.select("doc_id", tree, leaf().alias("digest"), now.alias("now")), "leaves")
    leaves = placed(leaves, ["doc_id", "digest"])
    below = climb(leaves)
    tops = below[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    tops = stored(placed(tops, ["of"]), "subroots")
    over = climb(tops)
    root = over[-1].select("tree", F.lit(0).cast("long").alias("place"), "digest")
    whole = root.select(
        "tree",
        "place",
        F.expr("cast(array() AS array<struct<left: string, right: string>>)").alias("steps"),
        F.lit(None).cast("string").alias("subroot"),
        F.col("digest").alias("root"),
    )
    paths = _descend(over, whole)
    if len(over) > 1:
        rows = tops.select("tree", "place", "digest", "n", "block")
        paths = stored(_with_above(rows, paths).applyInArrow(_paths, PATHS), "paths")
    sources = tops.select("place", F.col("of"), F.col("digest").alias("subroot"))
    top = paths.drop("tree", "subroot").join(sources, "place")
    top = top.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), "steps", "subroot", "root")
    top = stored(top, "paths")
    rows = leaves.select("tree", "place", "digest", "n", "block", "doc_id", "now")
    return _with_above(rows, _descend(below, top)).applyInArrow(_proofs, PROOFS)


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """:func:`manifest`, line feeds deleted from texts of documents with an even CRC-32 of their id."""
    text = F.translate(F.col("text"), "\n", "")
    return manifest(docs, {"text": text}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)


def _sql(levels: int) -> str:
    """The same in DuckDB for trees of up to ``levels`` levels, a level per table."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')".format
    fields = " || ".join(field(name) for name in FIELDS)
    cut = fields.replace("text::VARCHAR", "replace(text, chr(10), '')")
    # Fixed value: the polynomial of CRC-32, bits reversed.
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(c, ascii(x)::BIGINT), range(8)), lambda c, i: {bit})"
    digits = "string_split(doc_id::VARCHAR, '')"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform({digits}, lambda x: ascii(x)::BIGINT)), lambda c, x: {byte.replace('ascii(x)::BIGINT', 'x')}), 4294967295)"
    tables = [
        f"""rows AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({fields}) AS leaf,
           CASE WHEN ({crc}) % 2 = 0 THEN sha256({cut}) ELSE sha256({fields}) END AS now FROM documents)""",
        """a0 AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf AS digest FROM rows)""",
    ]

    def climbed(nodes: str, count: int) -> str:
        """Digests by level of the nodes of ``nodes`` (tree, place, digest)."""
        tables.append(f"{nodes}_0 AS (SELECT tree, place, digest, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}0)")
        for i in range(count):
            tables.append(
                f"""{nodes}_{i + 1} AS (
    SELECT tree, place // 3 AS place,
           CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE any_value(digest) END AS digest,
           (any_value(n) + 2) // 3 AS n
    FROM {nodes}_{i} GROUP BY tree, place // 3)"""
            )
        return f"{nodes}_{count}"

    def folded(rows: str, nodes: str, count: int) -> str:
        """``rows`` (tree, place, now, proof) folded along the levels of ``nodes``."""
        for i in range(count):
            tables.append(
                f"""{rows}_{i + 1} AS (
    SELECT r.* EXCLUDE (place, now, proof), r.place // 3 AS place,
           CASE WHEN p.n > 1 THEN sha256(p.l || r.now || p.r) ELSE r.now END AS now, r.proof || p.l || p.r AS proof
    FROM {rows}_{i} r JOIN (
        SELECT tree, place, n,
               coalesce(string_agg(digest, '') OVER (PARTITION BY tree, place // 3 ORDER BY place
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(digest, '') OVER (PARTITION BY tree, place // 3 ORDER BY place
                        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM {nodes}_{i}) p ON r.tree = p.tree AND r.place = p.place)"""
            )
        return f"{rows}_{count}"

    top = climbed("a", levels)
    tables.append(
        f"b0 AS (SELECT '' AS tree, tree AS of, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, digest FROM {top})"
    )
    root = climbed("b", levels)
    tables.append("f_0 AS (SELECT doc_id, leaf, tree AS of, tree, place, now, '' AS proof FROM a0)")
    first = folded("f", "a", levels)
    tables.append(
        f"""g_0 AS (
    SELECT f.doc_id, f.leaf, b.digest AS subroot, b.tree, b.place, f.now, f.proof FROM {first} f JOIN b0 b ON f.of = b.of)"""
    )
    last = folded("g", "b", levels)
    return (
        "WITH " + ",\n".join(tables) + f"""
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = t.digest AS verified
FROM {last} CROSS JOIN {root} t"""
    )


SQL = _sql(12)
