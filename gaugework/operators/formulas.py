"""The formula table prepared for evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions.formula_columns import outcome
from gaugework.functions.formula_text import NODE, TOO_DEEP, Formula, Shape, read_formula
from gaugework.session import stored
from gaugework.sources.variables import active_formulas

# Up to this many formulas and this much text the formula tables are read on the
# driver and broadcast; beyond, they are read by tasks and joined by shuffles.
BROADCAST_FORMULAS = 10_000
BROADCAST_CHARACTERS = 32 * 1024 * 1024

# Up to this many nodes are named in a filter on the readings.
FILTERED_NODES = 200

# Rows of a hot key are spread over this many tasks by the shuffle join.
SALTS = 32

PARSED = pa.schema(
    [
        ("variable_id", pa.int64()),
        ("minutes", pa.int32()),
        ("time_interval", pa.timestamp("us", "UTC")),
        ("kind", pa.string()),
        ("nodes", pa.list_(pa.string())),
        ("mentions", pa.list_(pa.string())),
        ("aggregate", pa.string()),
        ("shape", pa.string()),
        ("constants", pa.list_(pa.float64())),
        ("compile_error", pa.string()),
    ]
)

PARSED_DDL = (
    "variable_id bigint, minutes int, time_interval timestamp, kind string, "
    "nodes array<string>, mentions array<string>, aggregate string, shape string, "
    "constants array<double>, compile_error string"
)


@dataclass(frozen=True)
class FormulaSet:
    """Active formulas with their shapes.

    ``table`` has the columns of ``PARSED`` and ``shape_id``. The ``kind`` of a
    formula is how it is evaluated: "continuous"; or windowed, as an aggregate
    over "one" node or "many" aligned nodes, on the "last" values, or "idle"
    when it mentions no node. ``bounded`` says that the size of the table has
    been checked and that it may be broadcast.
    """

    table: DataFrame
    shapes: tuple[Shape, ...]
    kinds: frozenset[str]
    bounded: bool
    widest: int  # nodes of the widest aligned aggregate
    nodes: tuple[str, ...] | None = None  # every node mentioned, when few

    def of(self, *kinds: str) -> FormulaSet:
        """The formulas of these kinds."""
        shapes = tuple(shape for shape in self.shapes if shape.kinds.intersection(kinds))
        table = self.table.filter(F.col("kind").isin(*kinds))
        present = self.kinds.intersection(kinds)
        return replace(self, table=table, shapes=shapes, kinds=present)

    def edges(self) -> DataFrame:
        """(variable_id, idx, node_id), one row per formula and distinct node."""
        return self.table.select("variable_id", F.posexplode("nodes").alias("idx", "node_id"))

    def mentioned(self, readings: DataFrame) -> DataFrame:
        """Readings of nodes that may occur in a formula.

        The joins with the formulas would drop the others too; a filter by name
        reaches the scan and can skip files, row groups and partitions.
        """
        if self.nodes is None:
            return readings.filter(F.col("node_id").isNotNull())
        return readings.filter(F.col("node_id").isin(*self.nodes))

    def hint(self, small: DataFrame) -> DataFrame:
        """``small`` marked for broadcast when it is as small as the formulas."""
        return F.broadcast(small) if self.bounded else small

    def at_hand(self, small: DataFrame) -> DataFrame:
        """``small`` read on the driver, as the formulas are, when it is as small as they are.

        Plans that use it several times then neither compute it again nor start jobs for it.
        """
        if not self.bounded:
            return small
        return small.sparkSession.createDataFrame(small.toArrow(), small.schema)

    def attach(self, large: DataFrame, small: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
        """Join of many rows with a table derived from the formulas.

        Above the broadcast bound the large side is salted by its own content,
        so that a key holding a big part of all rows is spread over tasks.
        """
        if self.bounded:
            return large.join(F.broadcast(small), list(keys), how)
        hashed = [field.name for field in large.schema if not isinstance(field.dataType, T.MapType)]
        salt = F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        return (
            large.withColumn("_salt", salt)
            .join(small.withColumn("_salt", copies), [*keys, "_salt"], how)
            .drop("_salt")
        )


@lru_cache(maxsize=10_000)
def _problem(shape: str) -> str | None:
    """Why no expression can be made of ``shape``; what stops one formula must not stop the others."""
    try:
        outcome(shape, lambda i: f"x{i}")
    except RecursionError:
        return TOO_DEEP
    except Exception as problem:
        return f"EXECUTION_ERROR: {type(problem).__name__}"
    return None


def _read(text: str) -> Formula:
    """``text`` read, with a compile error instead of any exception."""
    try:
        formula = read_formula(text)
        problem = None if formula.shape is None else _problem(formula.shape)
    except Exception as failed:  # a formula's own fault, whatever it is
        nodes = tuple(NODE.findall(text))
        formula = Formula(tuple(dict.fromkeys(nodes)), nodes, None, None, (), None)
        problem = f"EXECUTION_ERROR: {type(failed).__name__}"
    return formula if problem is None else replace(formula, shape=None, constants=(), compile_error=problem)


def _record(variable_id: int, minutes: int, deadline: int | None, text: str) -> dict:
    formula = _read(text)
    if minutes <= 0:
        kind = "continuous"
    elif not formula.nodes:
        kind = "idle"
    elif formula.aggregate:
        kind = "one" if len(formula.nodes) == 1 else "many"
    else:
        kind = "last"
    return {
        "variable_id": variable_id,
        "minutes": minutes,
        "time_interval": deadline,
        "kind": kind,
        "nodes": list(formula.nodes),
        "mentions": list(formula.mentions),
        "aggregate": formula.aggregate,
        "shape": formula.shape,
        "constants": list(formula.constants),
        "compile_error": formula.compile_error,
    }


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(column.to_pylist() for column in batch.columns))
        yield pa.RecordBatch.from_pylist([_record(*row) for row in rows], PARSED)


def read_formulas(
    variables: DataFrame,
    max_formulas: int = BROADCAST_FORMULAS,
    max_characters: int = BROADCAST_CHARACTERS,
) -> FormulaSet:
    """Prepare the active formulas of ``variables``.

    The size is checked first. A table within the bounds is read on the driver,
    which needs the shapes anyway to write the plan; a larger one is read by
    tasks and kept in the shared folder, and only its distinct shapes come back.
    """
    spark = variables.sparkSession
    active = active_formulas(variables).select(
        F.col("variable_id").cast("long"),
        F.col("minutes").cast("int"),
        F.unix_micros(F.col("time_interval").cast("timestamp")).alias("deadline"),
        "formula",
    )
    size = active.agg(F.count("*").alias("rows"), F.sum(F.length("formula")).alias("characters")).first()
    if size.rows > max_formulas or (size.characters or 0) > max_characters:
        return _read_in_tasks(spark, active)
    rows = active.collect()
    records = [_record(*row) for row in rows]
    kinds_of: dict[str, set[str]] = {}
    for record in records:
        if record["shape"] is not None:
            kinds_of.setdefault(record["shape"], set()).add(record["kind"])
    shapes = _numbered(kinds_of)
    ids = {shape.text: shape.id for shape in shapes}
    for record in records:
        record["shape_id"] = ids.get(record["shape"])
    many = [len(record["nodes"]) for record in records if record["kind"] == "many"]
    nodes = sorted({node for record in records for node in record["nodes"]})
    return FormulaSet(
        table=spark.createDataFrame(
            pa.Table.from_pylist(records, PARSED.append(pa.field("shape_id", pa.int32())))
        ),
        shapes=shapes,
        kinds=frozenset(record["kind"] for record in records),
        bounded=True,
        widest=max(many, default=0),
        nodes=tuple(nodes) if len(nodes) <= FILTERED_NODES else None,
    )


def _numbered(kinds_of: dict[str, set[str]]) -> tuple[Shape, ...]:
    return tuple(
        Shape(at, text, frozenset(kinds)) for at, (text, kinds) in enumerate(sorted(kinds_of.items()))
    )


def _read_in_tasks(spark: SparkSession, active: DataFrame) -> FormulaSet:
    parsed = stored(active.mapInArrow(_read_batches, PARSED_DDL), "formulas")
    found = parsed.filter("shape is not null").groupBy("shape").agg(F.collect_set("kind").alias("kinds"))
    shapes = _numbered({row.shape: set(row.kinds) for row in found.toLocalIterator()})
    totals = parsed.agg(
        F.collect_set("kind").alias("kinds"),
        F.coalesce(F.max(F.when(F.col("kind") == "many", F.size("nodes"))), F.lit(0)).alias("widest"),
    ).first()
    ids = spark.createDataFrame(
        pa.table(
            {
                "shape": pa.array([shape.text for shape in shapes], pa.string()),
                "shape_id": pa.array([shape.id for shape in shapes], pa.int32()),
            }
        )
    )
    return FormulaSet(
        table=parsed.join(ids, "shape", "left"),
        shapes=shapes,
        kinds=frozenset(totals.kinds),
        bounded=False,
        widest=totals.widest,
    )


def as_formula_set(formulas: FormulaSet | DataFrame) -> FormulaSet:
    return formulas if isinstance(formulas, FormulaSet) else read_formulas(formulas)
