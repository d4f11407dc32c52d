"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words, the weight of its strongest words,
second-person words near lexicon words, shares of capitals, digits, punctuation,
exclamation marks and obfuscated words, and lengths. The lexicon is learned: words
and beginnings of words that are more frequent in toxic than in other labelled
texts, weighted by smoothed log odds. Counts are kept by fold, so that the features
of a labelled text come from the other folds' texts and do not flatter the trees.

Trees, calibration and lexicon are fitted on at most ``MAX_LABELLED`` labelled rows,
chosen by a hash of their id; everything else covers all rows. A text's score does
not depend on any other column. A null text is empty, and an empty one has a score too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.tables import text_of
from gaugework.session import stored

#: The most labelled rows that trees, calibration and lexicon are fitted on.
MAX_LABELLED = 40_000
#: The most entries of the lexicon.
LEXICON = 20_000
FOLDS = 4
#: Words a worker keeps the weights of.
CACHED_WORDS = 60_000
#: Counts that a task holds before it hands them on.
MOST_COUNTS = 150_000
PREFIXES = (4, 5, 6, 7, 8)

#: Words that address someone.
ADDRESS = {"you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
           "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "tú", "ti", "tus", "usted", "ustedes", "vosotros"}
#: Digits and signs that stand for letters.
DISGUISE = str.maketrans("0134578@$!", "oieastbasi")

WORD = re.compile(r"[^\W_]+(?:[@$!*.\-'0-9]+[^\W\d_]+)*")
INNER = re.compile(r"[@$!*.\-'_]+")
NAMES = ("strong", "medium", "any", "summed", "top", "top_mean", "near_you", "you", "capitals", "shouted",
         "digits", "signs", "exclaimed", "disguised", "disguised_weight", "repeated", "length")


def spellings(word: str) -> tuple[str, bool]:
    """The word in lower case without disguise, and whether it was disguised."""
    low = word.lower()
    if low.isalpha():
        return low, False
    plain = INNER.sub("", low.translate(DISGUISE))
    disguised = any(c.isalpha() for c in low) and plain != low and not low.isdigit()
    return plain, disguised


def entries(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, marked at its end, and its beginnings."""
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


class Weights(dict):
    """Weight, disguise and address of a word as it stands in the text."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[float, bool, bool, bool]:
        plain, disguised = spellings(word)
        weight = max((self.lexicon.get(e, 0.0) for e in entries(plain)), default=0.0)
        found = (weight, disguised, plain in ADDRESS, len(word) > 1 and word.isupper())
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found


def features(text: str, weights: Weights) -> list[float]:
    words = WORD.findall(text)
    counts = Counter(words)
    total = max(1, len(words))
    strong = medium = weak = near = you = shouted = disguised = 0
    summed = disguised_weight = 0.0
    heavy: list[float] = []
    for word, n in counts.items():
        weight, hidden, address, loud = weights[word]
        you += n * address
        shouted += n * loud
        if hidden:
            disguised += n
            disguised_weight = max(disguised_weight, weight)
        if weight > 0.0:
            weak += n
            summed += n * weight
            medium += n * (weight > 1.5)
            strong += n * (weight > 3.0)
            heavy.append(weight)
    if strong and you:  # someone is addressed within five words of a strong one
        told = [weights[word] for word in words]
        at = np.flatnonzero([t[0] > 3.0 for t in told])
        there = np.flatnonzero([t[2] for t in told])
        nearest = np.searchsorted(there, at)
        left, right = there[np.maximum(nearest - 1, 0)], there[np.minimum(nearest, len(there) - 1)]
        near = int((np.minimum(abs(at - left), abs(at - right)) <= 5).sum())
    heavy.sort(reverse=True)
    shown = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), "u1"), minlength=256)
    size = max(1, len(text))
    signs = int(shown[33:48].sum() + shown[58:65].sum() + shown[91:97].sum() + shown[123:127].sum())
    return [
        strong / total, medium / total, weak / total, summed / total,
        heavy[0] if heavy else 0.0, sum(heavy[:5]) / 5, near / total, you / total,
        int(shown[65:91].sum()) / size, shouted / total, int(shown[48:58].sum()) / size, signs / size,
        int(shown[33]) / size, disguised / total, disguised_weight, 1.0 - len(counts) / total, math.log1p(total),
    ]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by entry, fold and label, added up within the task as far as memory is bounded."""
    counts: Counter = Counter()

    def flush():
        rows = list(counts)
        out = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
        made = pa.RecordBatch.from_arrays([*out, pa.array([counts[r] for r in rows], pa.int64())], names=["entry", "fold", "toxic", "n"])
        counts.clear()
        return made

    for batch in batches:
        for text, fold, toxic in zip(*(batch.column(c) for c in ("text", "fold", "toxic")), strict=True):
            fold, toxic = fold.as_py(), toxic.as_py()
            words = {spellings(word)[0] for word in set(WORD.findall(text.as_py()))}
            for entry in {e for word in words for e in entries(word)}:
                counts[entry, fold, toxic] += 1
            if len(counts) > MOST_COUNTS:
                yield flush()
    if counts:
        yield flush()


def _log_odds(toxic: float, other: float, n_toxic: float, n_other: float) -> float:
    """Weight of an entry; 0 unless it leans to toxic texts beyond chance."""
    if toxic < 2:
        return 0.0
    weight = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))
    doubt = math.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    return max(0.0, weight - 1.0 * doubt)


@dataclass
class Trees:
    """Boosted trees of fixed depth over binned features, for the logistic loss."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b, width = self.binned(x), self.bins
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = math.log(share / (1 - share))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            inner = (1 << self.depth) - 1
            feature, split, leaf = np.zeros(inner, np.int32), np.full(inner, width, np.int32), np.zeros(inner + 1)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                gain, where = np.zeros(count), np.zeros((count, 2), np.int32)
                where[:, 1] = width
                for j in range(x.shape[1]):
                    key = (node - first) * width + b[:, j]
                    gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                    hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    better = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    better[(hs < 1) | (ht - hs < 1)] = 0
                    at = better.argmax(1)
                    found = better[np.arange(count), at]
                    new = found > gain
                    gain[new] = found[new]
                    where[new] = np.stack([np.full(count, j), at], 1)[new]
                feature[first : first + count], split[first : first + count] = where.T
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > split[node])
            at = node - inner
            sums = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
            leaf = -self.rate * sums[0] / (sums[1] + 1)
            raw += leaf[at]
            self.trees.append((feature, split, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows, out = self.binned(x), np.arange(len(x)), np.full(len(x), self.base)
        for feature, split, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > split[node])
            out += leaf[node - len(feature)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the rising step function from score to probability."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, label in zip(score[order], y[order], strict=True):
        blocks.append([float(label), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (
            blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]
        ):
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
            blocks[-1][3] = last[3]
    knots = np.array([(b[2], b[3]) for b in blocks]).ravel()
    return knots, np.repeat([b[0] / b[1] for b in blocks], 2)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        calibrated = np.interp(raw, *self.knots)
        # A little of the raw score keeps texts on one step apart.
        return np.clip(0.98 * calibrated + 0.02 / (1 + np.exp(-raw)), 0.0, 1.0)


def _measured(lexicons):
    """Features of each row, by the lexicon of its fold (-1: the whole one)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = {fold: Weights(lexicon) for fold, lexicon in lexicons.value.items()}
        for batch in batches:
            rows = zip(batch.column("text"), batch.column("fold"), strict=True)
            found = [features(text.as_py(), weights[fold.as_py()]) for text, fold in rows]
            kept = [batch.column("toxic"), batch.column("fold"), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(kept, names=["toxic", "fold", "features"])

    return run


def fit(labelled: DataFrame) -> Model:
    """Learn from ``labelled`` (doc_id, text, toxic 0 or 1), a bounded number of rows."""
    spark = labelled.sparkSession
    fold = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = stored(labelled.select(text_of().alias("text"), F.col("toxic").cast("int"), fold), "labelled")

    sizes = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    n = [sum(v for (f, y), v in sizes.items() if y == label) for label in (0, 1)]
    if not all(n):
        return Model({}, None, None, (n[1] + 0.5) / (sum(n) + 1))
    counted = rows.mapInArrow(_counted, "entry string, fold int, toxic int, n long")
    cells = [
        F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{f}{y}")
        for f in range(FOLDS)
        for y in (0, 1)
    ]
    toxic = sum((F.col(f"n{f}1") for f in range(FOLDS)), F.lit(0))
    other = sum((F.col(f"n{f}0") for f in range(FOLDS)), F.lit(0))
    lean = F.log((toxic + 0.5) / (n[1] + 1)) - F.log((other + 0.5) / (n[0] + 1))
    table = counted.groupBy("entry").agg(*cells).where((toxic >= 2) & (lean > 0.5))
    table = table.orderBy((lean * F.sqrt(toxic)).desc(), "entry").limit(LEXICON).collect()

    def lexicon(without: int) -> dict[str, float]:
        used = [f for f in range(FOLDS) if f != without]
        size = [sum(sizes.get((f, y), 0) for f in used) for y in (0, 1)]
        found = {}
        for r in table:
            weight = _log_odds(*(sum(r[f"n{f}{y}"] for f in used) for y in (1, 0)), size[1], size[0])
            if weight > 0:
                found[r["entry"]] = weight
        return found

    lexicons = {f: lexicon(f) for f in (-1, *range(FOLDS))}
    shared = spark.sparkContext.broadcast(lexicons)  # LEXICON entries a fold at most
    made = rows.mapInArrow(_measured(shared), "toxic int, fold int, features array<double>").collect()
    made.sort(key=lambda r: (r["fold"], r["toxic"], r["features"]))  # the same trees whatever the order of rows
    x, y = np.array([r["features"] for r in made]), np.array([r["toxic"] for r in made], float)
    fold_of = np.array([r["fold"] for r in made])
    raw = np.zeros(len(y))  # scores of each fold by trees that have not seen it
    for f in range(FOLDS):
        held = fold_of == f
        if held.any() and 0 < y[~held].sum() < (~held).sum():
            raw[held] = Trees().fit(x[~held], y[~held]).raw(x[held])
    return Model(lexicons[-1], Trees().fit(x, y), isotonic(raw, y), n[1] / sum(n))


def _scored(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = shared.value, Weights(shared.value.lexicon)
        for batch in batches:
            doc = batch.column("doc")
            texts = doc.field("text") if "text" not in batch.schema.names else batch.column("text")
            x = np.array([features(t.as_py() or "", weights) for t in texts]).reshape(-1, len(NAMES))
            scores = pa.array(model.scores(x), pa.float64())
            yield pa.RecordBatch.from_arrays([doc, scores], names=["doc", "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``doc``, the columns ``keep`` (all) of each row of ``docs`` as a struct, and its ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*keep).alias("doc"), *([] if "text" in keep else ["text"]))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(_scored(shared), f"doc {kind}, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning; a null id is not, and has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Model:
    """A model from the labels that are not held out, at most ``max_rows`` of them.

    At most as many texts are fitted: where ids are repeated, equal rows count once and the first texts
    in an order of hashes are taken.
    """
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(max_rows)
    # Two numbers a row, and max_rows of them: small enough to send everywhere.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    if rows.select("doc_id").count() > max_rows:  # ids are repeated
        order = F.xxhash64(F.lit(3), "doc_id"), "doc_id", F.xxhash64("text"), "text"
        rows = rows.dropDuplicates(["doc_id", "text"]).orderBy(*order).limit(max_rows)
    return fit(rows)


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    model = learned(docs, labels)
    rows = score(docs.select("doc_id", "text").withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
    return rows.select("doc.doc_id", "doc.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``."""
    return score(docs, model).where(F.col("score") < threshold).select("doc.*")
