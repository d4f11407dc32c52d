"""Substring dedup over sliding spans of sentences.

A text is cut into sentences at ends of lines, after ``.``, ``!``, ``?`` before white space and
after the full stops of scripts that use no spaces. A sentence of more than ``PART`` words is cut
where its words say so: after each word whose hash is a multiple of ``EVERY``, or after ``PART``
words without one. The cuts of a passage are the same wherever it stands in a sentence, but for
its first and last few words. Words of more than ``LONG`` characters, as in scripts without
spaces, are cut likewise by pairs of characters. From each sentence runs the
shortest span of at least ``SENTENCES`` sentences and ``WORDS`` words; its hash is taken over
the lower-cased words, so spacing and capitals do not matter. Spans are joined over the whole
table by their hashes. The first span of a hash, by doc_id and place, stays; every
sentence that another one covers is removed, so the first document that has a passage keeps it.

A text without a repeated span is not cut again: its number of sentences is kept from the first time.

Hashes alone are counted, with partial counts, before any join; what has a repeated one is
written once, and a frequent one has one row on its side of the joins, so their other side can
be split over tasks.

Null texts are empty and have no span. A null doc_id comes first. Rows that share a
doc_id are told apart by the hash of their text; rows equal in both get the same decision.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.tables import text_of
from gaugework.session import stored

SENTENCES = 3
WORDS = 10
PART = 12
#: One word in so many, by its hash, ends a part of a long sentence.
EVERY = 4
#: A word of more characters is cut after one pair of characters in so many, and after so many without one.
LONG, LONG_EVERY, LONG_PART = 40, 12, 60
#: Characters of other alphabets than ASCII that count as one word.
CHARACTERS = 6

#: Where a sentence ends, with the white space after it.
#: It begins with one set of characters, so that a search goes from one of them to the next.
END = re.compile(
    r"[.!?\n\u2026\u0964\u061f\u06d4\u3002\uff01\uff1f]"
    r"(?:(?<=\n)|(?<=[\u3002\uff01\uff1f])(?![\u3002\uff01\uff1f])|(?=\s))\s*"
)
WORD = re.compile(r"\S+\s*")


def _every(part: str, n: int) -> bool:
    return zlib.crc32(part.lower().encode("utf-8", "surrogatepass")) % n == 0


def _cuts_of_word(word: str) -> Iterator[int]:
    """Places after some pairs of a long word's characters."""
    last = 0
    for at in range(2, len(word)):
        if at - last == LONG_PART or (at - last > 1 and _every(word[at - 2 : at], LONG_EVERY)):
            yield at
            last = at


class Enders(dict):
    """Whether a word, with the white space after it, ends a part; found once a word."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 1 << 17:  # bounds what is remembered
            self.clear()
        self[word] = ends = zlib.crc32(word.rstrip().lower().encode("utf-8", "surrogatepass")) % EVERY == 0
        return ends


def _parts_of_sentence(words: list[str], enders: Enders) -> Iterator[str]:
    """Parts of a long sentence, given as words with the white space after each."""
    first = 0
    for end in [i for i, ends in enumerate(map(enders.__getitem__, words), 1) if ends] + [len(words)]:
        while end - first > PART:
            yield "".join(words[first : first + PART])
            first += PART
        if end > first:
            yield "".join(words[first:end])
            first = end


def _parts_around_long_words(words: list[str], enders: Enders) -> Iterator[str]:
    first = 0
    for i, word in enumerate(words):
        if len(bare := word.rstrip()) > LONG:
            yield from _parts_of_sentence(words[first:i], enders)
            cuts = [0, *_cuts_of_word(bare), len(word)]
            yield from (word[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
            first = i + 1
    yield from _parts_of_sentence(words[first:], enders)


def sentences(text: str, enders: Enders | None = None) -> list[str]:
    """Parts of ``text`` that give it again when joined."""
    enders = Enders() if enders is None else enders
    found: list[str] = []
    start = 0
    for end in [*(m.end() for m in END.finditer(text)), len(text)]:
        piece, start = text[start:end], end
        if len(piece) <= 2 * PART:
            found += [piece] if piece else []
            continue
        words = WORD.findall(piece)
        long = max(map(len, words), default=0) > LONG and any(len(word.rstrip()) > LONG for word in words)
        if not long and len(words) <= PART:
            found.append(piece)
            continue
        at = len(found)
        found += _parts_around_long_words(words, enders) if long else _parts_of_sentence(words, enders)
        if piece[0].isspace():
            found[at] = piece[: len(piece) - len(piece.lstrip())] + found[at]
    return found


def _size(part: str, words: list[str]) -> int:
    if part.isascii():
        return len(words)
    return sum(1 if x.isascii() else max(1, len(x) // CHARACTERS) for x in words)


def ends_of_spans(parts: list[str], words: list[list[str]]) -> list[int]:
    """Where the span of each sentence ends; of the last sentences, that have none, beyond the text."""
    total = np.concatenate([[0], np.cumsum(list(map(_size, parts, words)))])
    least = np.searchsorted(total, total[:-1] + WORDS)  # first end with enough words
    return np.maximum(least, np.arange(len(parts)) + SENTENCES).tolist()


def spans(parts: list[str]) -> Iterator[tuple[int, int, int]]:
    """(hash, first sentence, number of sentences) of each run."""
    words = [part.lower().split() for part in parts]
    hashes = [xxhash.xxh64_digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words]
    for i, end in enumerate(ends_of_spans(parts, words)):
        if end > len(parts):
            return
        yield xxhash.xxh64_intdigest(b"".join(hashes[i:end])), i, end - i


def _spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each text, and a row without a hash that has its number of sentences."""
    enders = Enders()
    for batch in batches:
        rows, hashes, at, sizes = [], [], [], []
        for row, text in enumerate(batch.column("text")):
            parts = sentences(text.as_py(), enders)
            sizes.append(len(parts))
            for h, i, _ in spans(parts):
                rows.append(row)
                hashes.append(h)
                at.append(i)
        taken = pa.array(rows, pa.int64())
        columns = [batch.column(c).take(taken) for c in ("doc_id", "tie")]
        columns += [pa.array(np.array(hashes, "u8").view("i8")), pa.array(at, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "hash", "at"])
        columns = [batch.column(c) for c in ("doc_id", "tie")]
        columns += [pa.nulls(len(sizes), pa.int64()), pa.array(sizes, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "hash", "at"])


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.withColumn("tie", F.xxhash64("text"))


def _written(docs: DataFrame) -> DataFrame:
    return stored(_rows(docs).mapInArrow(_spans, "doc_id long, tie long, hash long, at int"), "spans")


def _others(written: DataFrame) -> DataFrame:
    """doc_id, tie, at: where the non-first repeated spans begin."""
    found = written.where("hash is not null")
    many = found.groupBy("hash").count().where("count > 1")
    shared = stored(found.join(many.select("hash"), "hash"), "shared")
    place = F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", "tie", "at")
    first = shared.groupBy("hash").agg(F.min(place).alias("first"))
    return shared.join(first, "hash").where(place > F.col("first")).select("doc_id", "tie", "at")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, tie, at: where the non-first repeated spans of each text that has some begin."""
    return _others(_written(docs)).groupBy("doc_id", "tie").agg(F.collect_set("at").alias("at"))


def _cut(docs: DataFrame) -> DataFrame:
    """As :func:`repeated` for every text, and its number of sentences."""
    written = _written(docs)
    sizes = written.where("hash is null").selectExpr("doc_id", "tie", "int(null) AS at", "at AS n_sentences")
    others = _others(written).selectExpr("*", "int(null) AS n_sentences")
    both = others.unionByName(sizes).groupBy("doc_id", "tie")
    return both.agg(F.collect_set("at").alias("at"), F.max("n_sentences").alias("n_sentences"))


CLEANED = "doc_id long, text string, n_sentences int, n_removed int, removed array<struct<start: int, end: int>>"


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    enders = Enders()
    for batch in batches:
        texts, sizes, removed, places = [], [], [], []
        for text, found, size in zip(*map(batch.column, ("text", "at", "n_sentences")), strict=True):
            if not len(found.values):
                texts.append(text.as_py())
                sizes.append(size.as_py())
                removed.append(0)
                places.append([])
                continue
            parts = sentences(text.as_py(), enders)
            gone = np.zeros(len(parts) + 1, int)
            at = found.values.to_numpy()
            ends = np.array(ends_of_spans(parts, [part.split() for part in parts]))[at]
            np.add.at(gone, at, 1)
            np.add.at(gone, ends, -1)
            gone = np.cumsum(gone)[:-1] > 0
            ends = np.cumsum([len(p) for p in parts])
            place: list[dict] = []
            for i in np.flatnonzero(gone).tolist():
                start, end = int(ends[i]) - len(parts[i]), int(ends[i])
                if place and place[-1]["end"] == start:
                    place[-1]["end"] = end
                else:
                    place.append({"start": start, "end": end})
            texts.append("".join(p for p, g in zip(parts, gone, strict=True) if not g))
            sizes.append(len(parts))
            removed.append(int(gone.sum()))
            places.append(place)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(texts, pa.string()),
                pa.array(sizes, pa.int32()),
                pa.array(removed, pa.int32()),
                pa.array(places, kind),
            ],
            names=["doc_id", "text", "n_sentences", "n_removed", "removed"],
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated spans, numbers of sentences and of removed ones, removed code points."""
    rows, found = _rows(docs), stored(_cut(docs), "repeated")
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["tie"] == found["tie"])
    joined = rows.join(found, same).select(rows["doc_id"], "text", "at", "n_sentences")
    return joined.mapInArrow(_remove, CLEANED)
