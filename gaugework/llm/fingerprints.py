"""I-Match fingerprints: hashes of the distinct mid-frequency terms of a text.

A term is a run of letters and digits in lower case. The lexicon has the terms whose
inverse document frequency, log2(documents / documents with the term), lies in a band.
Its upper edge bounds the lexicon by itself: the terms in at least N / 2^upper documents are at most
2^upper times the mean number of distinct terms of a document, whatever N is. All of
them are kept, and that bound is what allows the lexicon to be broadcast.

A text's lexicon terms are sorted and made distinct; each of ``SUBSETS`` randomised
lexicons, drawn independently of each other, keeps a share of them and gives one 32-bit
hash. Shares halve from 1/16 to 1/256 and start again, so that short and long texts both
have subsets that an edit leaves alone. The likeness of two fingerprints is the share of
subsets with equal hashes among those in which either text has a term.

A text without lexicon terms, the empty one included, is fingerprinted by a hash of the
whole text, so equal texts always have equal fingerprints. Everything is DataFrame
functions; the driver passes on the broadcast lexicon and sees the edges of id ranges alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.tables import text_of
from gaugework.session import stored

SUBSETS = 48
#: Subsets keep one term in 2**LEAST_SHARE, one in twice that, and so on, SHARES times over.
LEAST_SHARE, SHARES = 4, 5
#: Documents of a bucket when neighbours are paired, and the most buckets.
BUCKET_DOCS = 1024
MOST_BUCKETS = 100_000


def distinct_terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the terms of ``text``."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda word: word != "")
    return F.array_distinct(F.transform(words, lambda word: F.xxhash64(word)))


def terms(text: Column) -> Column:
    """The same, sorted."""
    return F.sort_array(distinct_terms(text))


def lexicon(docs: DataFrame, band: tuple[float, float] = (2.0, 8.0)) -> DataFrame:
    """Hashes (term) of all terms within the band.

    Document frequencies cover all documents; partial counts are added up before
    the shuffle, so a frequent term is one row per task.
    """
    total = docs.count()
    # The terms in a step of their own, as an explode evaluates its argument without generated code; outer, as
    # a plain explode is given filters that make the terms anew to see whether there are any.
    held = docs.select(distinct_terms(text_of()).alias("terms"))
    found = held.select(F.explode_outer("terms").alias("term")).where("term IS NOT NULL").groupBy("term").count()
    low, high = (total / 2.0**edge for edge in reversed(band))
    return found.where(F.col("count").between(max(2.0, low), high)).select("term")


def drawn(known: DataFrame, subsets: int = SUBSETS) -> DataFrame:
    """(term, mask) of each term of ``known``: bit k says whether it is in the k-th randomised lexicon.

    That is by a hash of k and the term, taken here once for all texts.
    """

    def bit(k: int) -> Column:
        share = 1 << (LEAST_SHARE + k % SHARES)
        return F.when(F.pmod(F.xxhash64(F.lit(k), "term"), F.lit(share)) == 0, F.lit(1 << k)).otherwise(F.lit(0))

    mask = F.lit(0).cast("long")
    for k in range(subsets):
        mask = mask.bitwiseOR(bit(k).cast("long"))
    return known.select("term", mask.alias("mask"))


def looked_up(masks: DataFrame) -> Column:
    """The table of ``masks`` as one value, ``buckets``: place pmod(term, size) holds the terms of that place.

    Terms in no randomised lexicon have no part in any hash and are not in it. The value is a
    scalar subquery: tasks get it once, by the bound that the lexicon has, and rows do not carry it.
    """
    masks = stored(masks.where("mask <> 0"), "masks")
    size = F.lit(max(1, masks.count())).cast("long")
    full = masks.groupBy(F.pmod("term", size).alias("place")).agg(F.collect_list(F.struct("term", "mask")).alias("held"))
    places = masks.sparkSession.range(max(1, masks.count())).select(F.col("id").alias("place"))
    all_places = places.join(full, "place", "left")
    held = F.sort_array(F.collect_list(F.struct("place", F.coalesce("held", F.expr("array()")).alias("held"))))
    return stored(all_places.agg(F.transform(held, lambda p: p["held"]).alias("buckets")), "lexicon").scalar()


def hashes_of(text: Column, buckets: Column) -> Column:
    """A hash of the text's terms in each randomised lexicon, null without a term.

    A term is looked up once, whatever the number of lexicons; their parts are told by the mask.
    """

    def found(term: Column) -> Column:
        place = F.get(buckets, F.pmod(term, F.size(buckets).cast("long")).cast("int"))
        return F.get(F.filter(place, lambda held: held["term"] == term), F.lit(0))

    known = F.filter(F.transform(terms(text), found), lambda held: held.isNotNull())

    def made(inside: Column, k: Column) -> Column:
        # Sorted as the text's terms are.
        part = F.filter(inside, lambda held: F.getbit(held["mask"], k) == 1)
        return F.xxhash64(F.transform(part, lambda held: held["term"]))

    # ``known`` is bound to a name by an array of one, so that it is made once and not for each lexicon.
    each = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    digests = F.get(F.transform(F.array(known), lambda inside: F.transform(each, lambda k: made(inside, k))), F.lit(0))
    nothing = F.xxhash64(F.expr("cast(array() AS array<bigint>)"))
    return F.transform(digests, lambda d: F.when(d != nothing, d.bitwiseAND(F.lit(0xFFFFFFFF))))


def shown(hashes: Column, text: Column) -> Column:
    """The fingerprint as text: 8 hexadecimal digits per subset, 0 for one without a term."""
    digits = F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(F.coalesce(h, F.lit(0)))), 8, "0"))
    other = F.concat(F.lit("x"), F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0"))
    return F.when(F.exists(hashes, lambda h: h.isNotNull()), F.concat_ws("", digits)).otherwise(other)


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Share of equal hashes where either is there; without any, 1 if ``same``, else 0."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y)))
    told = F.filter(pairs, lambda p: p.isNotNull())
    equal = F.size(F.filter(told, lambda p: p))
    return F.when(F.size(told) > 0, equal / F.size(told)).otherwise(same.cast("double"))


def with_next(docs: DataFrame, add: Callable[[DataFrame], DataFrame] = lambda rows: rows, also: str = "text") -> DataFrame:
    """``docs`` (doc_id, text) with ``next``, the document after in order of doc_id: its text.

    ``add`` makes a column ``also`` from a document's text, once for itself and for ``next``.

    Equal ids are in order of a hash of their texts, null ids come first; after the
    last document comes the first. Ids are cut into ranges of about ``BUCKET_DOCS``
    documents; the first document of each range, at most ``MOST_BUCKETS`` of them, is
    also put at the end of the range before, so texts are shuffled once and a
    window never spans more than a range.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    known = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    buckets = max(1, min(MOST_BUCKETS, -(-known["n"] // BUCKET_DOCS)))
    cells = min(buckets, 256)
    inner = -(-buckets // cells)
    edges = sorted(set(docs.approxQuantile("doc_id", [i / cells for i in range(1, cells)], 0.002))) if cells > 1 else []
    edges = [int(edge) for edge in edges]
    lows, highs = [known["low"] or 0, *edges], [*edges, (known["high"] or 0) + 1]
    cell = F.size(F.filter(F.lit(edges).cast("array<bigint>"), lambda e: e <= F.col("doc_id"))) if edges else F.lit(0)
    rows = rows.withColumn("cell", F.when(F.col("doc_id").isNotNull(), cell))
    low = F.element_at(F.lit(lows).cast("array<bigint>"), F.col("cell") + 1)
    high = F.element_at(F.lit(highs).cast("array<bigint>"), F.col("cell") + 1)
    step = F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * F.lit(inner))
    by_id = F.col("cell") * F.lit(inner) + F.least(F.lit(inner - 1), F.greatest(F.lit(0), step))
    # Rows without an id are ordered, and dealt, by the hash of their texts.
    by_tie = F.floor((F.col("tie") / F.lit(2.0**64) - F.lit(0.5)) * F.lit(buckets))
    rows = rows.withColumn("bucket", F.coalesce(by_id, by_tie).cast("long")).drop("cell")

    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", "tie")).alias("first")
    firsts = rows.groupBy("bucket").agg(first)
    # One row per range. The first range also ends the last one.
    ends = F.lag("bucket").over(Window.partitionBy(F.lit(0)).orderBy("bucket"))
    last = F.max("bucket").over(Window.partitionBy(F.lit(0)))
    firsts = firsts.select(
        F.col("first.doc_id").alias("first_id"),
        F.col("first.tie").alias("first_tie"),
        F.coalesce(ends, last).alias("ends"),
        ends.isNull().alias("around"),
    )
    found = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    guards = rows.join(F.broadcast(firsts), found).select(
        "doc_id", "text", "tie", F.col("ends").alias("bucket"), F.lit(1).alias("guard"), "around"
    )
    both = rows.withColumns({"guard": F.lit(0), "around": F.lit(False)}).unionByName(guards)
    made = add(both).select("doc_id", "text", "tie", "bucket", "guard", *{also} - {"text"})
    order = Window.partitionBy("bucket").orderBy("guard", F.asc_nulls_first("doc_id"), "tie")
    after = F.lead(F.struct(*{"text", also})).over(order)
    return made.withColumn("next", after).where("guard = 0").drop("tie", "bucket", "guard")


def fingerprint_edits(docs: DataFrame, known: list[int] | None = None) -> DataFrame:
    """Fingerprints of each text and of the same text with its second half exchanged.

    The last floor(n / 2) of its n code points are replaced by the first as many of
    the next document. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts are empty.
    """
    found = lexicon(docs) if known is None else docs.sparkSession.createDataFrame([(k,) for k in known], "term long")
    # The lexicon is written first: what only depends on a term, as masks do, would else be computed before
    # the count, for every term of every document.
    buckets = looked_up(drawn(stored(found, "terms")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substr(F.col("text"), F.lit(1), F.length("text") - half), F.substr(F.col("next.text"), F.lit(1), half)
    )

    def hashed(rows: DataFrame, name: str, to: str) -> DataFrame:
        return rows.withColumn("buckets", buckets).withColumn(to, hashes_of(F.col(name), F.col("buckets"))).drop("buckets")

    rows = with_next(docs, lambda rows: hashed(rows, "text", "h_text"), "h_text").withColumn("edited", edited)
    rows = hashed(rows, "edited", "h_edited")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("h_text"), F.col("text")).alias("fingerprint"),
        shown(F.col("h_edited"), F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("h_text"), F.col("h_edited"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("h_text"), F.col("next.h_text"), F.col("text") == F.col("next.text")).alias("near_next"),
    )
