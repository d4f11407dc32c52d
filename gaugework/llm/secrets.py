"""Secret scans: fixed patterns, and a character convolutional network for what they miss.

The patterns' matches are findings whatever the network says. Candidates are all runs of 16 or
more letters, digits and ``+/_=-``. The network is asked about every one that the patterns do
not cover whole, letters or digits only included; of a run that a match covers in part, what sticks out
by ``LEAST_REST`` characters or more is a candidate of its own, and is reported and
replaced besides the match; unless the match is an assignment, it counts as a secret where the
whole run does. It reads 64 characters of a candidate with the 32
before and the 16 after them. A longer candidate is read by windows of 64 that overlap
by half, over its whole length, and has the highest of their probabilities; its first window
is the one to train on.

It is trained on labelled findings: candidates that a pattern covers are secrets, those
made of words are not, and all others are left unlabelled. As the patterns only know assignments and a few forms, some of the secrets
lose their surroundings to another candidate's, and some get random characters of other
alphabets; words joined by digits and signs are added to the others. All findings are used: they
are dealt by hash into groups of about ``MAX_FINDINGS`` of a label, a first network is fitted to one of
them, then each group fits it further by itself, and the mean of all counts. Calibration and
threshold come from the logits of all rows kept from training, counted to 1 in ``PER_LOGIT``: the threshold
finds ``RECALL`` of the secrets among them, on calibrated probabilities.

A null text is empty and has no spans, an empty table has no network. A null doc_id stays null; repeated rows are
scanned each on its own. Spans are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.tables import text_of
from gaugework.session import stored

#: About how many findings of either label a group has; a task fits one group at a time.
MAX_FINDINGS = 3000
#: Logits are counted to such a part for calibration and threshold.
PER_LOGIT = 256
#: Share of kept-back secrets that the threshold must find.
RECALL = 0.97

#: The patterns, and the least length of a match or of its group.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "network")
HINTS = ("passw", "secret", "token", "api_key", "apikey")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGITS = re.compile("[0-9]+")
#: The shortest piece beside a pattern's match that the network is asked about.
LEAST_REST = 8
WORDS = re.compile("[A-Z]?[a-z]{3,}|[A-Z]{4,}")

BEFORE, WITHIN, AFTER = 32, 64, 16
WIDTH = BEFORE + WITHIN + AFTER


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start, then kind."""
    found = []
    low = text.lower()
    if any(hint in low for hint in HINTS):  # every match of the pattern holds one of these
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2])))


def window(text: str, start: int, end: int) -> bytes:
    """The candidate and its surroundings, one byte a character, 0 where there is none."""
    shown = lambda part: part.encode("ascii", "replace")
    left, right = shown(text[max(0, start - BEFORE) : start]), shown(text[end : end + AFTER])
    within = shown(text[start : min(end, start + WITHIN)])
    return left.rjust(BEFORE, b"\0") + within.ljust(WITHIN, b"\0") + right.ljust(AFTER, b"\0")


def windows(text: str, start: int, end: int) -> bytes:
    """The windows of a candidate, one after the other: the first is all of it if it is short."""
    last = max(start, end - WITHIN)
    first = window(text, start, end)
    later = range(start + WITHIN // 2, last, WITHIN // 2)
    return b"".join([first, *(window(text, at, at + WITHIN) for at in (*later, *([last] if last > start else [])))])


def wordlike(value: str) -> bool:
    """Whether half of the characters or more stand in words of one case, with digits in two places at most."""
    return len(DIGITS.findall(value)) <= 2 and 2 * sum(map(len, WORDS.findall(value))) >= len(value)


def uncovered(start: int, end: int, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The stretches of start to end outside all of ``base``, which is in order of starts."""
    left = []
    for a, b, _ in base:
        if a >= end:
            break
        if a > start:
            left.append((start, a))
        start = max(start, b)
    return [*left, (start, end)] if start < end else left


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, bool | None, bytes]]:
    """(start, end, label, windows): a secret if a pattern covers some of it, none if made of words, else unknown.

    Of a run that is a secret, stretches outside the patterns' matches follow as unknown ones.
    """
    found, at = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][1] <= start:
            at += 1
        near = []  # matches of other kinds may lie within one another, so ends are not in order
        for span in base[at:]:
            if span[0] >= end:
                break
            if span[1] > start:
                near.append(span)
        label = True if near else False if wordlike(m[0]) else None
        found.append((start, end, label, windows(text, start, end)))
        if near:
            rest = [part for part in uncovered(start, end, near) if part[1] - part[0] >= LEAST_REST]
            whole = b"" if any(kind == "assign" for _, _, kind in near) else windows(text, start, end)
            found += [(a, b, None, windows(text, a, b) + whole) for a, b in rest]
    return found


SPAN = "struct<start: int, end: int, kind: string>"
SEEN = "struct<start: int, end: int, known: boolean, window: binary>"
FOUND = f"doc_id long, base array<{SPAN}>, seen array<{SEEN}>"


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    seen = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("known", pa.bool_()), ("window", pa.binary())])
    for batch in batches:
        base, near = [], []
        for text in batch.column("text"):
            text = text.as_py()
            base.append(spans := base_spans(text))
            near.append(candidates(text, spans))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in x] for x in base], pa.list_(span)),
                pa.array(
                    [[dict(zip(("start", "end", "known", "window"), s, strict=True)) for s in x] for x in near],
                    pa.list_(seen),
                ),
            ],
            names=["doc_id", "base", "seen"],
        )


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and candidates of each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_scan, FOUND)


@dataclass
class Network:
    """Embedding, one convolution, the maximum of each of three parts, one linear unit."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1

    KERNEL = 5
    PARTS = ((0, BEFORE - 2), (BEFORE - 2, BEFORE + WITHIN - 2), (BEFORE + WITHIN - 2, WIDTH - 4))

    @staticmethod
    def new(seed: int = 1, depth: int = 8, filters: int = 24) -> Network:
        draw = np.random.default_rng(seed)
        k = Network.KERNEL
        return Network(
            {
                "embed": draw.normal(0, 0.5, (128, depth)),
                "conv": draw.normal(0, (2 / (k * depth)) ** 0.5, (k * depth, filters)),
                "bias": np.zeros(filters),
                "out": draw.normal(0, 0.1, 3 * filters),
                "base": np.zeros(1),
            }
        )

    def forward(self, codes: np.ndarray):
        w, k = self.weights, self.KERNEL
        embedded = w["embed"][codes]
        columns = np.concatenate([embedded[:, i : WIDTH - k + 1 + i] for i in range(k)], axis=2)
        active = np.maximum(columns @ w["conv"] + w["bias"], 0)
        tops = [active[:, a:b].argmax(1) + a for a, b in self.PARTS]
        pooled = np.concatenate([np.take_along_axis(active, t[:, None], 1)[:, 0] for t in tops], axis=1)
        return columns, tops, pooled, pooled @ w["out"] + w["base"][0]

    def logits(self, windows: list[bytes]) -> np.ndarray:
        codes = np.frombuffer(b"".join(windows), "u1").reshape(-1, WIDTH) & 127
        made = [self.forward(codes[i : i + 256])[3] for i in range(0, len(codes), 256)]
        return np.concatenate(made) if made else np.empty(0)

    def probabilities(self, windows: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(windows) + self.shift)))

    def copy(self) -> Network:
        return Network({n: w.copy() for n, w in self.weights.items()}, self.scale, self.shift, self.threshold)

    def packed(self) -> bytes:
        return b"".join(w.tobytes() for w in self.weights.values())

    @staticmethod
    def of(fits: list) -> Network:
        """The mean of networks, of (turn, rows, packed weights) each, by their rows."""
        flat = np.stack([np.frombuffer(bytes(weights)) for _, _, weights in fits])
        mean = np.average(flat, axis=0, weights=[max(n, 1e-9) for _, n, _ in fits])
        network, at = Network.new(), 0
        for n, w in network.weights.items():
            network.weights[n], at = mean[at : at + w.size].reshape(w.shape).copy(), at + w.size
        return network

    def calibrated(self, rows: list) -> Network:
        """With scale, shift and threshold by counts (near, secret, n, least) of the logits of rows kept back."""
        rows = sorted(rows, key=lambda row: (row.near, row.secret))
        logit = np.array([row.near / PER_LOGIT for row in rows])
        y, n = np.array([float(row.secret) for row in rows]), np.array([float(row.n) for row in rows])
        # Newton steps on scale and shift.
        for _ in range(20 if rows else 0):
            p = 1 / (1 + np.exp(-(self.scale * logit + self.shift)))
            x = np.stack([logit, np.ones_like(logit)])
            hessian = (x * n * p * (1 - p)) @ x.T + np.eye(2) * 1e-2
            self.scale, self.shift = np.array([self.scale, self.shift]) - np.linalg.solve(
                hessian, x @ (n * (p - y)) + 1e-2 * np.array([self.scale - 1, self.shift])
            )
        there = [row for row in rows if row.secret]
        self.threshold = 0.5
        if there:
            up_to = np.cumsum([row.n for row in there])
            least = there[int(np.searchsorted(up_to, int((1 - RECALL) * up_to[-1]), side="right"))].least
            self.threshold = float(1 / (1 + np.exp(-(self.scale * np.float64(least) + self.shift))))
        return self

    def fit(
        self, codes: np.ndarray, y: np.ndarray, steps: int = 1000, size: int = 64, seed: int = 2, passes: int | None = None
    ) -> Network:
        draw, w, k = np.random.default_rng(seed), self.weights, self.KERNEL
        first, second = ({n: np.zeros_like(v) for n, v in w.items()} for _ in range(2))
        turn = 0
        depth = w["embed"].shape[1]
        for _ in range(passes or max(4, steps * size // len(y))):
            order = draw.permutation(len(y))
            for i in range(0, len(y), size):
                rows = order[i : i + size]
                columns, tops, pooled, logit = self.forward(codes[rows])
                off = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
                grad = {"out": pooled.T @ off, "base": np.array([off.sum()]), "embed": np.zeros_like(w["embed"])}
                filters = len(w["bias"])
                conv, bias = np.zeros_like(w["conv"]), np.zeros(filters)
                back = off[:, None] * w["out"]
                for part, top in enumerate(tops):
                    passed = back[:, part * filters : (part + 1) * filters]
                    passed = passed * (pooled[:, part * filters : (part + 1) * filters] > 0)
                    chosen = columns[np.arange(len(rows))[:, None], top]  # rows, filters, kernel * depth
                    conv += np.einsum("rf,rfc->cf", passed, chosen)
                    bias += passed.sum(0)
                    to = (passed[:, :, None] * w["conv"].T[None]).reshape(len(rows), filters, k, depth)
                    at = codes[rows[:, None, None], top[:, :, None] + np.arange(k)]
                    np.add.at(grad["embed"], at.ravel(), to.reshape(-1, depth))
                grad |= {"conv": conv, "bias": bias}
                turn += 1
                for n, g in grad.items():
                    first[n] += 0.1 * (g - first[n])
                    second[n] += 0.01 * (g * g - second[n])
                    step = first[n] / (1 - 0.9**turn) / (np.sqrt(second[n] / (1 - 0.99**turn)) + 1e-8)
                    w[n] -= 0.01 * step
        return self


def _made_up(secrets: list[bytes], others: list[bytes], draw: np.random.Generator) -> tuple[list[bytes], list[bytes]]:
    """Secrets in other surroundings and alphabets, and joined words in those of candidates."""
    alphabets = [
        b"abcdefghijklmnopqrstuvwxyz0123456789",
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
        b"0123456789abcdef",
    ]
    around = [(w[:BEFORE], w[-AFTER:]) for w in (*others, *secrets)]
    words = [x for w in (*secrets, *others) for x in re.findall(rb"[A-Za-z]{3,}", w[:BEFORE] + b" " + w[-AFTER:])]
    words = words or [b"the", b"data", b"value"]

    def surroundings() -> tuple[bytes, bytes]:
        left, right = around[draw.integers(len(around))]
        if draw.random() < 0.5:  # characters in any order: no run of them tells a secret
            left, right = (draw.permutation(np.frombuffer(part, "u1")).tobytes() for part in (left, right))
        return left, right

    def framed(value: bytes) -> bytes:
        left, right = surroundings()
        return left + value[:WITHIN].ljust(WITHIN, b"\0") + right

    new_secrets, new_others = [], []
    for w in secrets * max(1, min(10, MAX_FINDINGS // len(secrets))):  # more variants of few findings
        new_secrets.append(framed(w[BEFORE:-AFTER]))
        letters = np.frombuffer(alphabets[draw.integers(len(alphabets))], "u1")
        value = draw.choice(letters, draw.integers(20, WITHIN)).tobytes()
        new_secrets.append(framed(value) if draw.random() < 0.5 else w[:BEFORE] + value.ljust(WITHIN, b"\0") + w[-AFTER:])
        parts: list[bytes] = []
        while sum(map(len, parts)) < 16:
            parts += [words[draw.integers(len(words))], b"-_/="[(i := draw.integers(4)) : i + 1]]
        new_others.append(framed(b"".join(parts) + str(draw.integers(3000)).encode()))
    new_others += [framed(w[BEFORE:-AFTER]) for w in others * max(1, min(5, MAX_FINDINGS // max(1, len(others))))]
    return new_secrets, new_others


def _examples(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels and which rows are kept from training, of a group's findings and what is made up of them."""
    known, window = table.column("known").to_pylist(), table.column("window").to_pylist()
    secrets = sorted(w for w, k in zip(window, known, strict=True) if k)
    others = sorted(w for w, k in zip(window, known, strict=True) if not k)
    draw = np.random.default_rng([3, table.column("turn")[0].as_py()])
    more_secrets, more_others = _made_up(secrets, others, draw) if secrets else ([], [])
    y = np.concatenate([np.ones(len(secrets) + len(more_secrets)), np.zeros(len(others) + len(more_others))])
    codes = np.frombuffer(b"".join([*secrets, *more_secrets, *others, *more_others]), "u1").reshape(-1, WIDTH) & 127
    return codes, y, draw.random(len(y)) < 0.25


def _fitting(start: Network | None):
    """Fits a network to a group, a new one or further from ``start``; its weights and how many rows it saw."""

    def run(table: pa.Table) -> pa.Table:
        codes, y, kept = _examples(table)
        network = Network.new() if start is None else start.copy()
        if not kept.all():
            network.fit(codes[~kept], y[~kept], passes=None if start is None else 1)
        made = [[table.column("turn")[0].as_py()], [int((~kept).sum())], [network.packed()]]
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)], ["turn", "n", "weights"])

    return run


def _kept_logits(network: Network):
    def run(table: pa.Table) -> pa.Table:
        codes, y, kept = _examples(table)
        logit = network.logits([codes[kept].astype("u1").tobytes()])
        return pa.table([pa.array(logit, pa.float64()), pa.array(y[kept] == 1)], ["logit", "secret"])

    return run


def train(found: DataFrame) -> Network | None:
    """A network from all labelled candidates of ``found``; None if there are no secrets."""
    rows = found.select(F.explode("seen").alias("c")).where("c.known is not null")
    rows = rows.select("c.known", F.substring("c.window", 1, WIDTH).alias("window")).distinct()
    rows = stored(rows, "labelled")
    count = {row.known: row["count"] for row in rows.groupBy("known").count().collect()}
    if not count.get(True):
        return None
    groups = -(-max(count.values()) // MAX_FINDINGS)
    dealt = rows.withColumn("turn", F.pmod(F.xxhash64("window", F.lit(7)), F.lit(groups)))

    def fits(part: DataFrame, start: Network | None) -> list:
        made = part.groupBy("turn").applyInArrow(_fitting(start), "turn long, n long, weights binary")
        return sorted(made.collect())

    # A first network from the group of the most secrets, and each group's from there; their mean counts.
    first = dealt.where("known").groupBy("turn").count().orderBy(F.desc("count"), "turn").first().turn
    network = Network.of(fits(dealt.where(F.col("turn") == first), None))
    dealt = dealt.repartition(groups, "turn")
    if groups > 1:
        network = Network.of(fits(dealt, network))
    kept = dealt.groupBy("turn").applyInArrow(_kept_logits(network), "logit double, secret boolean")
    near = F.round(F.greatest(F.least("logit", F.lit(40.0)), F.lit(-40.0)) * PER_LOGIT).cast("long")
    return network.calibrated(
        kept.groupBy(near.alias("near"), "secret").agg(F.count(F.lit(1)).alias("n"), F.min("logit").alias("least")).collect()
    )


def joined(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def all_spans(base, seen, network: Network | None) -> list[tuple[int, int, str]]:
    """Spans of the patterns, and of candidates that the network holds to be secrets."""
    spans = [(s["start"], s["end"], s["kind"]) for s in base]
    new = [s for s in seen if not s["known"]]
    if network and new:
        p = network.probabilities([bytes(s["window"]) for s in new])
        counts = [len(s["window"]) // WIDTH for s in new]
        p = np.maximum.reduceat(p, np.cumsum([0, *counts[:-1]]))
        spans += [(s["start"], s["end"], "network") for s, x in zip(new, p, strict=True) if x >= network.threshold]
    return sorted(spans, key=lambda span: (span[0], KINDS.index(span[2])))


REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _report(network: Network | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, base, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = hashlib.sha256(joined((s["start"], s["end"], s["kind"]) for s in base).encode()).hexdigest()
                n = [sum(s["kind"] == kind for s in base) for kind in KINDS[:3]]
                rows.append((doc, *n, digest, joined(all_spans(base, seen, network))))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                names=[part.split()[0] for part in REPORT.split(", ")],
            )

    return run


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the patterns, digest of their spans, and all spans, of each document."""
    found = stored(findings(docs), "findings")
    return found.select("doc_id", "base", "seen").mapInArrow(_report(train(found)), REPORT)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """``text`` with each stretch of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redact(network: Network | None, at_text: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "known", "window")
        for batch in batches:
            made = []
            for text in batch.column(at_text):
                text = text.as_py()
                if text:
                    base = base_spans(text)
                    seen = [dict(zip(names, c, strict=True)) for c in candidates(text, base)]
                    spans = all_spans([dict(zip(("start", "end", "kind"), s, strict=True)) for s in base], seen, network)
                    text = redacted(text, spans)
                made.append(text)
            yield batch.set_column(at_text, batch.schema.field(at_text), pa.array(made, pa.string()))

    return run


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced; ``n_chars`` follows the text where it was that of it."""
    network = train(stored(findings(docs), "findings"))
    rows = docs.mapInArrow(_redact(network, docs.columns.index("text")), docs.schema)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


