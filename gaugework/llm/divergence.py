"""How far sources of one language stand apart in their words, over texts counted once.

Equal texts of a language are collapsed: each task passes a text on once, with the number of
its copies per source, and the texts meet by (lang, digest). There a text is cut into
terms once, and its counts and document frequencies are added to each of its sources
as often as that source has it.

A language keeps the terms of at least ``least_docs`` of its documents. Shares are
integers in units of 1e-9 with additive smoothing, p = 1 + floor(1e9 (count + 5) / (N + 5 V)),
so all arithmetic is exact. Distances of sources are sums of absolute differences over all kept
terms, found without visiting terms that both sources lack:

* a term that one source has and the other lacks is compared with the other's share
  of an absent term, the same for all such terms; how many terms of a source have which count
  is a short table, and that table alone meets the other sources of its language;
* terms that both have correct that sum, by a join on (lang, term);
* terms that neither has are counted, and differ by the shares of absent terms.

Null texts, languages and sources are empty. A group without terms has shares like any
other; a language without kept terms has distances of 0. The rows of ``pair`` are as
many as the pairs of sources of a language, which is what they are asked for.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.session import stored

#: Documents of a language that a term must stand in, and the terms reported of each group.
LEAST_DOCS, TOP = 30, 50
#: Copies and terms that a task adds up before it passes them on.
HELD_TEXTS, HELD_TERMS = 100_000, 400_000

#: Letters to lower case, all bytes that are no part of a term to a space.
_TERMS = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))

COPIES = "lang string, digest binary, text binary, source string, copies long"
COUNTS = "lang string, source string, term string, docs long, n long"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and of all bytes beyond ASCII, with A-Z in lower case."""
    return text.translate(_TERMS).split()


def _collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The copies of each text per source, with the text itself the first time it is seen."""
    copies: Counter = Counter()
    seen: set = set()

    def counted() -> pa.RecordBatch:
        keys = list(copies)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [None] * len(keys), [k[2] for k in keys]]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(copies.values(), pa.int64())], names=NAMES)

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        first = []
        digests = []
        for i, (lang, source, text) in enumerate(zip(langs, sources, batch.column("text"), strict=True)):
            digest = hashlib.sha256(text.as_buffer()).digest()
            copies[lang, digest, source] += 1
            if (lang, digest) not in seen:
                seen.add((lang, digest))
                first.append(i)
                digests.append(digest)
        if first:
            part = batch.take(pa.array(first))
            none = pa.nulls(len(first), pa.string()), pa.nulls(len(first), pa.int64())
            arrays = [part.column("lang"), pa.array(digests, pa.binary()), part.column("text"), *none]
            yield pa.RecordBatch.from_arrays(arrays, names=NAMES)
        if len(copies) >= HELD_TEXTS:
            yield counted()
            copies.clear()
            seen.clear()
    if copies:
        yield counted()


NAMES = ["lang", "digest", "text", "source", "copies"]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms over rows sorted by (lang, digest): each text is cut once."""
    docs: dict[tuple, Counter] = {}
    counts: dict[tuple, Counter] = {}
    held, key, text, sources = 0, None, b"", Counter()

    def add() -> None:
        nonlocal held
        words = Counter(terms_of(text))
        for source, copies in sources.items():
            group = key[0], source
            d, n = docs.setdefault(group, Counter()), counts.setdefault(group, Counter())
            before = len(d)
            if copies == 1:
                d.update(words.keys())
                n.update(words)
            else:
                d.update(dict.fromkeys(words, copies))
                n.update({word: copies * many for word, many in words.items()})
            held += len(d) - before

    def counted() -> Iterator[pa.RecordBatch]:
        for (lang, source), d in docs.items():
            n = counts[lang, source]
            names = pa.array(list(d), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(d), pa.string()),
                    pa.array([source] * len(d), pa.string()),
                    names,
                    pa.array(d.values(), pa.int64()),
                    pa.array([n[word] for word in d], pa.int64()),
                ],
                names=["lang", "source", "term", "docs", "n"],
            )
        docs.clear()
        counts.clear()

    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("lang", "digest", "source", "copies"))
        for i, (lang, digest, source, copies) in enumerate(zip(*columns, strict=True)):
            if key != (lang, digest):
                if key is not None:
                    add()
                    if held >= HELD_TERMS:
                        yield from counted()
                        held = 0
                key, text, sources = (lang, digest), b"", Counter()
            if source is None:
                text = batch.column("text")[i].as_py()
            else:
                sources[source] += copies
    if key is not None:
        add()
    yield from counted()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, docs, n: in how many documents of a group a term stands, and how often.

    Rows of a term lie together by (lang, term), so that later steps over it need no shuffle.
    """
    rows = docs.select(
        *(F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("lang", "source")),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    texts = rows.mapInArrow(_collapse, COPIES).repartition("lang", "digest").sortWithinPartitions("lang", "digest")
    parts = texts.mapInArrow(_count, COUNTS).repartition("lang", "term")
    return parts.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _share(count: Column | int, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 (count + 5) / (total + 5 terms)); exact, and null where there are no terms."""
    count = F.lit(count) if isinstance(count, int) else count
    high = (count + 5).cast("decimal(19)") * F.lit(1_000_000_000).cast("decimal(10)")
    low = F.when(terms > 0, total + 5 * terms).cast("decimal(20)")
    return F.call_function("div", high, low) + 1


def _distance(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    ``part`` "pair": the other sources of the language by distance, largest first. ``part`` "term": the
    ``top`` terms whose share in the group exceeds that in the language most.
    """
    term = Window.partitionBy("lang", "term")
    kept = term_counts(docs)
    kept = kept.withColumns({"in_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term)})
    first = F.row_number().over(term.orderBy("source")) == 1
    kept = kept.withColumn("first", first).where(F.col("in_docs") >= least_docs)
    kept = stored(kept.select("lang", "source", "term", "n", "lang_n", "first"), "terms")

    groups = docs.select(*(F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("lang", "source"))).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "own", "lang_total", "terms"])
    groups = stored(groups.withColumn("absent", _share(0, F.col("total"), F.col("terms"))), "groups")

    shares = kept.join(groups.drop("own"), ["lang", "source"])
    shares = shares.withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))

    # Terms that stand out in a group.
    over = F.col("p") - _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    stand_out = shares.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")
    stand_out = stand_out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # Pairs of sources, each both ways.
    ours = groups.select("lang", "source", "own", "terms", "absent")
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("item_own"), F.col("absent").alias("item_absent"))
    pairs = ours.join(theirs, "lang").where("source <> item")
    by_share = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("same"))
    lacks = by_share.join(theirs, "lang").where("source <> item").groupBy("lang", "source", "item")
    lacks = lacks.agg(F.sum(_distance("p", "item_absent") * F.col("same")).alias("lacks"))
    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("absent").alias("item_absent"))
    both = shares.join(other, ["lang", "term"]).where("source < item")
    more = _distance("p", "q") - _distance("p", "item_absent") - _distance("q", "absent")
    both = both.groupBy("lang", "source", "item").agg(F.sum(more).alias("more"), F.count("*").alias("both"))
    swapped = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "more", "both")
    back = lacks.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("lacks").alias("lacked"))

    keys = ["lang", "source", "item"]
    summed = pairs.join(lacks, keys, "left").join(back, keys, "left").join(both.unionByName(swapped), keys, "left")
    summed = summed.na.fill(0, ["lacks", "lacked", "more", "both"])
    neither = F.col("terms") - F.col("own") - F.col("item_own") + F.col("both")
    rest = F.coalesce(neither * _distance("absent", "item_absent"), F.lit(0))
    value = F.col("lacks") + F.col("lacked") + F.col("more") + rest
    apart = summed.select(*keys, value.alias("value")).withColumn("rank", F.row_number().over(ranked))

    def shown(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long"), "rank")

    return shown(apart, "pair").unionByName(shown(stand_out, "term"))


#: The same in DuckDB: every kept term against every pair of sources, and texts not collapsed.
SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
tokens AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCS}),
sizes AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (
    SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, k.n AS lang_n,
           sum(coalesce(f.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
    FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
shares AS (
    SELECT d.lang, d.source, d.term, d.n,
           1 + (1000000000::HUGEINT * (d.n + 5)) // (d.total + 5 * s.v)::HUGEINT AS p,
           1 + (1000000000::HUGEINT * (d.lang_n + 5)) // (s.total + 5 * s.v)::HUGEINT AS q
    FROM dense d JOIN sizes s USING (lang)),
pairs AS (
    SELECT g.lang, g.source, o.source AS item FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
    SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN apart USING (lang, source, item)
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM rows)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
