"""Mixing sources to target weights by Pareto order sampling.

Sources share a number of words by weight; no source gets more than ``cap`` times
what it has, and what is over is shared again by weight. Within a source, documents
share its target in the same way: a document's inclusion, the copies of it that the
mix expects, grows with its weight, up to ``cap``. By default the weight is the binary
logarithm of the length, so long documents are a little likelier than short ones.

The whole part of the inclusion is taken for certain. For the fraction p that is
left, each document gets a random number u from a hash of its id and text, and is
ranked by odds(u) / odds(p); the first documents in this order are taken, until
their words fill what the whole copies leave of the target. The order is not sorted: two
histograms of ranks find the place where the target is met, and only the few documents
about that place are looked at one by one: those that still fit are taken, in order.

Nulls: a null text has no words, a document without words is not taken, a null
source is a source of its own, after all others. Rows equal in id and text get the same decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.tables import WORD, text_of
from gaugework.session import stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Documents about the place where the target is met that are tried one by one.
TRIED = 64
#: Sources up to which the table of cuts is broadcast: some 100 MB at most.
BROADCAST_SOURCES = 100_000
LEVEL = 1024


def length_class(size: Column) -> Column:
    """Binary digits of the length: the classes of documents of one weight."""
    return F.length(F.bin(size)).cast("int")


def fill(shares: DataFrame, group: list[str], total: Column) -> DataFrame:
    """Adds ``target``: ``total`` shared by ``weight`` up to ``most``, the excess shared again.

    In order of most / weight, the level if all before are full rises to its final value and falls after it.
    """
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = over.orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    full, gone = F.coalesce(F.sum("most").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    weight = F.sum("weight").over(over)
    levels = shares.withColumn("ratio", F.col("most") / F.col("weight"))
    levels = levels.withColumn("level", (total - full) / (weight - gone))
    target = F.least(F.col("most"), F.col("weight") * F.max("level").over(over))
    return levels.withColumn("target", F.greatest(target, F.lit(0.0))).drop("ratio", "level")


def measured(docs: DataFrame) -> DataFrame:
    """``doc`` (the row as it is), size in words, a key for the source and a random number."""
    text = text_of()
    return docs.select(
        F.struct(*docs.columns).alias("doc"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        # One key that is never null, in the order of sources: null last.
        F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))).alias("key"),
        F.xxhash64(F.lit(17), "doc_id", F.xxhash64(text)).alias("drawn"),
    )


def _rank(drawn: Column, p: Column) -> Column:
    """odds(u) / odds(p) as its place r / (1 + r) in 0..2**20 - 1; null if never taken."""
    u = (F.pmod(drawn, F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    ranked = u * (1 - p) / (u * (1 - p) + (1 - u) * p)
    place = F.least(F.floor(ranked * F.lit(LEVEL * LEVEL)), F.lit(LEVEL * LEVEL - 1)).cast("int")
    return F.when(p > 0, place)


def _crossing(rows: DataFrame, place: str) -> DataFrame:
    """Per source: where the words pass ``left``, the words before it, and the place by which TRIED documents follow."""
    bins = rows.groupBy("key", place, "left").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    order = Window.partitionBy("key").orderBy(place)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summed = bins.withColumns(
        {
            "words_before": F.coalesce(F.sum("words").over(before), F.lit(0)),
            "n_before": F.coalesce(F.sum("n").over(before), F.lit(0)),
        }
    )
    beyond = summed.where(F.col("words_before") + F.col("words") > F.col("left"))
    first = F.min("n_before").over(Window.partitionBy("key"))
    near = beyond.withColumn("first", first).where(F.col("n_before") < F.col("first") + F.lit(TRIED))
    return near.groupBy("key").agg(
        F.min(place).alias("at"), F.max(place).alias("to"), F.min("words_before").alias("words_before")
    )


def _greedy(rows: Column, left: Column) -> Column:
    """Hashes of the documents, in order, that still fit into ``left`` words."""
    start = F.struct(left.alias("left"), F.lit([]).cast("array<bigint>").alias("taken"))

    def step(state, row):
        fits = row["size"] <= state["left"]
        return F.struct(
            F.when(fits, state["left"] - row["size"]).otherwise(state["left"]).alias("left"),
            F.when(fits, F.concat(state["taken"], F.array(row["drawn"]))).otherwise(state["taken"]).alias("taken"),
        )

    return F.aggregate(rows, start, step, lambda state: state["taken"])


def cuts(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(classes, cuts): inclusion of each source's length classes; the place of each source's cut."""
    sized = stored(measured(docs).select("key", "size", "drawn"), "sizes")
    groups = sized.withColumn("class", length_class(F.col("size")))
    groups = stored(groups.groupBy("key", "class").agg(F.sum("size").cast("double").alias("words")), "groups")

    sources = groups.groupBy("key").agg(F.sum("words").alias("words"))
    one = Window.partitionBy(F.lit(0))
    turn = F.pmod(F.row_number().over(one.orderBy("key")) - 1, F.lit(len(weights)))
    sources = sources.select(
        "key",
        F.col("words").cast("long").alias("source_size"),
        (F.col("words") * F.lit(float(cap))).alias("most"),
        F.element_at(F.lit([float(w) for w in weights]), turn + 1).alias("weight"),
        (F.sum("words").over(one) * F.lit(float(share))).alias("total"),
    )
    sources = fill(sources, [], F.col("total")).select("key", "source_size", "target")

    classes = groups.where("words > 0").join(sources, "key")
    classes = classes.withColumns(
        {"weight": F.col("words") * F.col("class"), "most": F.col("words") * F.lit(float(cap)), "total": F.col("target")}
    ).withColumnRenamed("target", "source_target")
    classes = fill(classes, ["key"], F.col("total"))
    inclusion = F.col("target") / F.col("words")
    # A share a hair below a whole number, as sums of doubles give it, is that number.
    whole = F.floor(inclusion + F.lit(1e-9)).cast("int")
    classes = stored(
        classes.select("key", "class", whole.alias("whole"), F.greatest(inclusion - whole, F.lit(0.0)).alias("p"), "words"),
        "classes",
    )
    certain = classes.groupBy("key").agg(F.sum(F.col("whole") * F.col("words")).alias("certain"))
    left = F.greatest(F.col("target") - F.coalesce("certain", F.lit(0.0)), F.lit(0.0))
    sources = stored(sources.join(certain, "key", "left").withColumn("left", left).drop("certain"), "sources")

    placed = sized.withColumn("class", length_class(F.col("size")))
    placed = placed.join(bounded(classes), ["key", "class"]).withColumn("place", _rank(F.col("drawn"), F.col("p")))
    placed = placed.where("place IS NOT NULL").join(bounded(sources.select("key", "left")), "key")
    placed = placed.select("key", "size", "drawn", "left", "place", F.floor(F.col("place") / LEVEL).alias("coarse"))
    rough = stored(_crossing(placed, "coarse"), "rough")
    # Only the bins about the crossing are told apart further.
    about = placed.join(bounded(rough), "key").where("coarse BETWEEN at AND to")
    about = stored(about.withColumn("left", F.col("left") - F.col("words_before")).drop("at", "to", "words_before"), "about")
    fine = _crossing(about, "place").withColumnRenamed("words_before", "fine_before")
    edge = about.join(bounded(fine), "key").where("place BETWEEN at AND to")
    row = F.struct("place", "drawn", "size")
    # Rows of one group: TRIED and those of one bin in a million of the source. Equal rows count together.
    edge = edge.groupBy("key", "place", "drawn").agg(
        F.sum("size").alias("size"), F.first("left").alias("left"), F.first("at").alias("at"), F.first("fine_before").alias("before")
    )
    picked = edge.groupBy("key").agg(
        F.sort_array(F.collect_list(row)).alias("rows"),
        F.first("at").alias("at"),
        (F.first("left") - F.first("before")).alias("room"),
    )
    picked = picked.select("key", F.col("at").alias("below"), _greedy(F.col("rows"), F.col("room")).alias("picked"))
    # Without a crossing all fractions fit.
    joined = sources.drop("left").join(picked, "key", "left")
    joined = joined.withColumn("below", F.coalesce("below", F.lit(LEVEL * LEVEL)))
    return classes, stored(joined, "cuts")


def bounded(table: DataFrame) -> DataFrame:
    """``table``, one or a few rows a source, for broadcast if that is small for certain."""
    return F.broadcast(table) if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else table


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Each row of ``docs`` as ``doc``, with size, source_size, target, and copies: how often the mix takes it."""
    classes, found = cuts(docs, weights, share, cap)
    rows = measured(docs).withColumn("class", length_class(F.col("size")))
    rows = rows.join(bounded(found), "key").join(bounded(classes.drop("words")), ["key", "class"], "left")
    extra = (_rank(F.col("drawn"), F.col("p")) < F.col("below")) | F.array_contains("picked", F.col("drawn"))
    copies = F.coalesce("whole", F.lit(0)) + F.coalesce(extra & (F.col("p") > 0), F.lit(False)).cast("int")
    return rows.select("doc", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    taken = mix(docs).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, words taken."""
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mix(docs.select("doc_id", "text", "source")).select("doc.doc_id", "size", "source_size", "target", taken)
