import hashlib
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugework.llm import components as graphs
from gaugework.llm import fingerprints, shards, simhash, spans, tables
from gaugework.llm.components import components
from gaugework.session import stored

from tests.llm.conftest import AWKWARD


def plain_simhash(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(run.encode(), 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [t for _, t, *_ in AWKWARD] + ["A b  C\x0bd e É f", "a b c", "a b c d"])
def test_simhash_by_the_book(text):
    assert simhash.simhash(text) == plain_simhash(text)


@pytest.mark.parametrize("positions", [range(64), range(3, 35), range(15), range(6)])
def test_masks_cover(positions):
    masks = simhash.covering_masks(list(positions), 4)
    assert all(masks)
    for bits in list(combinations(positions, 4))[:: 97 if len(positions) > 20 else 1]:
        assert any(not mask & sum(1 << b for b in bits) for mask in masks)


def reach(values, radius=4):
    """Component of each value, by comparing all."""
    root = list(range(len(values)))
    for i, j in combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_links_within_large_buckets(spark):
    draw = np.random.default_rng(4)
    centres = [int(x) for x in draw.integers(0, 1 << 63, 6)]
    values = set(centres)
    for centre in centres:  # chains, so that components are wider than the radius
        value = centre
        for _ in range(60):
            for bit in draw.choice(64, draw.integers(1, 7), replace=False):
                value ^= 1 << int(bit)
            values.add(value)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), 4, bucket=5).collect()
    index = {v: i for i, (v,) in enumerate(signed)}
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 4 for r in found)
    root = list(range(len(values)))
    for r in found:
        a, b = root[index[r["a"]]], root[index[r["b"]]]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert root == reach(values)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(41)}) == 1 and len({found[i] for i in range(100, 160)}) == 1
    assert found[0] != found[100]


def test_near_duplicates(spark, awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    values = [plain_simhash(t) for _, t, *_ in AWKWARD]
    ids = [i for i, *_ in AWKWARD]
    roots = reach(values)
    least = {r: min((ids[j] for j, x in enumerate(roots) if x == r and ids[j] is not None), default=None) for r in roots}
    wanted = sorted((str(i), f"{v:016x}", str(least[r])) for i, v, r in zip(ids, values, roots, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == wanted
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    stay = sorted(str(least[r]) for r in set(roots))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == stay


def test_near_duplicates_of_nothing(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.one_of_each(documents([])).collect() == []


def test_imatch(documents, awkward):
    rows = sorted(fingerprints.fingerprint_edits(awkward).collect(), key=lambda r: r["edited_sha256"])
    texts = [(i, t or "") for i, t, *_ in AWKWARD]
    assert len(rows) == len(texts)
    known = [(i, t) for i, t in sorted(((i, t) for i, t in texts if i is not None), key=lambda r: r[0])]
    digests = {r["edited_sha256"] for r in rows}
    for (_, a), (_, b) in zip(known, known[1:], strict=False):
        half = len(a) // 2
        assert hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest() in digests
    assert {r["n_chars"] for r in rows} == {len(t) for _, t in texts}
    shown = {}
    for r in rows:
        shown.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(shown[len(AWKWARD[0][1])]) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.fingerprint_edits(documents([])).collect() == []


def test_imatch_pairs_neighbours_over_buckets(documents):
    rows = [(3 * i, f"text number {i} " * (1 + i % 5), "en", "a") for i in range(3000)]
    found = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprint_edits(documents(rows), [1]).collect()}
    for (i, a, *_), (_, b, *_) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(a) // 2
        assert found[i] == hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()


def test_imatch_lexicons_are_drawn_apart(spark, documents):
    rows = [(i, f"common w{i // 2} v{i // 2}", "en", "a") for i in range(512)]
    band = fingerprints.lexicon(documents(rows), (2.0, 8.0)).collect()
    assert len(band) == 512  # all terms that are neither everywhere nor in one text alone
    known = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 40_000).tolist()
    table = fingerprints.drawn(spark.createDataFrame([(k,) for k in known], "term long")).collect()
    assert sorted(r["term"] for r in table) == sorted(known)
    shares = [1 / (1 << (fingerprints.LEAST_SHARE + k % fingerprints.SHARES)) for k in range(48)]
    sets = [{r["term"] for r in table if r["mask"] >> k & 1} for k in range(48)]
    assert fingerprints.SUBSETS == 48 and not any(r["mask"] >> 48 for r in table)
    assert all(abs(len(own) - 40_000 * share) <= 6 * (40_000 * share) ** 0.5 for own, share in zip(sets, shares, strict=True))
    for (a, p), (b, q) in combinations(list(zip(sets, shares, strict=True)), 2):
        mean = len(known) * p * q
        assert len(a & b) <= mean + 6 * mean**0.5 + 6


def xx64_of_longs(values, seed=42):
    """XXH64 of each value in turn, the hash so far as the seed of the next."""
    for value in values:
        seed = xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def plain_fingerprints(rows, band=(2.0, 8.0)):
    """doc_id -> (fingerprint, edited_fingerprint, near_edited, near_next), a document at a time."""

    def terms(text):
        words = set(re.findall(r"[^\W_]+", text.lower()))
        return sorted(signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words)

    low, high = len(rows) / 2 ** band[1], len(rows) / 2 ** band[0]
    df = {}
    for _, text, *_ in rows:
        for term in terms(text):
            df[term] = df.get(term, 0) + 1
    known = {term for term, n in df.items() if max(2.0, low) <= n <= high}
    sets = [{t for t in known if signed(xx64_of_longs_int(k, t)) % (1 << (4 + k % 5)) == 0} for k in range(48)]

    def hashes(text):
        parts = [[t for t in terms(text) if t in own] for own in sets]
        return [xx64_of_longs(part) & 0xFFFFFFFF if part else None for part in parts]

    def shown(h, text):
        whole = f"x{xxhash.xxh64_intdigest(text.encode(), 42):016x}"
        return "".join(f"{x or 0:08x}" for x in h) if any(x is not None for x in h) else whole

    def near(a, b, same):
        told = [x == y for x, y in zip(a, b, strict=True) if x is not None or y is not None]
        return sum(told) / len(told) if told else float(same)

    made = {}
    for (i, text, *_), (_, after, *_) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = hashes(text), hashes(edited), hashes(after)
        made[i] = shown(own, text), shown(other, edited), near(own, other, text == edited), near(own, following, text == after)
    return made


def xx64_of_longs_int(k, term):
    """XXH64 of a 32-bit number and then of a 64-bit one."""
    first = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)
    return xx64_of_longs([term], first)


def test_imatch_values_by_the_book(documents):
    draw = np.random.default_rng(7)
    rows = []
    for i in range(200):
        words = [f"w{min(int(x), 400)}" for x in draw.exponential(60, int(draw.integers(1, 120)))]
        rows.append((i, "" if i % 50 == 7 else " ".join(words) + f" Own{i}, Ärger", "en", "a"))
    rows += [(200 + i, rows[3 * i][1], "en", "a") for i in range(20)]
    found = {r["doc_id"]: tuple(r)[3:] for r in fingerprints.fingerprint_edits(documents(rows)).collect()}
    wanted = plain_fingerprints(rows)
    assert found == wanted
    assert sum(0 < r[2] < 1 for r in wanted.values()) > 20


def test_hypergeometric_margins_and_mean():
    import random

    draw = random.Random(1)
    assert all(shards.hypergeometric(draw, 5, 0, 3) == 3 for _ in range(20))
    values = [shards.hypergeometric(draw, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(values) - 6) < 0.15 and abs(np.var(values) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    matrix = np.array(shards.communication_matrix([10, 0, 35, 5], [13, 13, 12, 12], 3))
    assert matrix.sum(0).tolist() == [13, 13, 12, 12] and matrix.sum(1).tolist() == [10, 0, 35, 5]


@pytest.mark.parametrize("task_rows", [3, 1 << 18])
def test_shards_are_exact(documents, awkward, task_rows):
    rows = shards.shard(awkward, 4, task_rows=task_rows).collect()
    assert len(rows) == len(AWKWARD)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, slots.values())) == [2, 3, 3, 3]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 8 for _, t, *_ in AWKWARD)
    assert shards.shard_documents(documents([])).collect() == []


def plain_repeats(rows):
    """Sentences of each row that a non-first span covers, by a dictionary of all spans."""
    seen, gone = {}, {i: set() for i, _ in rows}
    for i, text in rows:
        for h, at, n in spans.spans(spans.sentences(text)):
            if h in seen:
                gone[i] |= set(range(at, at + n))
            seen.setdefault(h, (i, at))
    return gone


def test_sentences_give_the_text_again():
    for _, text, *_ in AWKWARD:
        parts = spans.sentences(text or "")
        assert "".join(parts) == (text or "")
        assert all(len(p.split()) <= spans.PART for p in parts)


@pytest.mark.parametrize("long", [False, True])
def test_a_passage_goes_at_any_place_in_a_sentence(documents, long):
    """A passage begins after 0 to 23 other words (or characters of one word) of a run-on text."""
    draw = np.random.default_rng(3)
    glue, size = ("", 1) if long else (" ", 6)
    alphabet = [chr(0x4E00 + k) for k in range(800)] if long else list("abcdefghijklmnopqrstuvwxyz")
    words = lambda n: ["".join(draw.choice(alphabet, size)) for _ in range(n)]
    passage = words(400 if long else 120)
    rows = [(0, glue.join([*words(7), *passage, *words(30)]))]
    rows += [(1 + k, glue.join([*words(k), *passage, *words(30)])) for k in range(24)]
    found = {r["doc_id"]: r for r in spans.without_repeats(documents([(*r, "en", "a") for r in rows])).collect()}
    assert found[0]["text"] == rows[0][1]
    for i, text in rows[1:]:
        left, own = found[i]["text"], text.split(glue.join(passage))
        gone = len(text) - len(left)
        assert 0.9 * len(glue.join(passage)) <= gone <= len(glue.join(passage)) + 1
        assert left.startswith(own[0]) and left.endswith(own[1])


def test_equal_rows_gather_each_place_once(documents):
    text = "One is here. Two are there now. Three more of them come along today. And four stay."
    rows = spans.repeated(documents([(i // 500, text, "en", "a") for i in range(1000)])).collect()
    assert {r["doc_id"] for r in rows} == {1} and all(len(r["at"]) == len(set(r["at"])) <= 4 for r in rows)


def test_repeated_passages_go(documents):
    passage = "The quick brown fox jumps. It runs over the lazy dog! Then it sleeps for an hour. " * 1 + "So it ends there."
    other = [f"Sentence {i} is quite its own. Nothing of {i} is said again. Well, {i} it is, for good. " for i in range(30)]
    rows = [(i, other[i] + (passage if i % 3 == 0 else "") + " " + other[(i + 1) % 30][:0] + "Tail %d." % i) for i in range(30)]
    found = {r["doc_id"]: r for r in spans.without_repeats(documents([(*r, "en", "a") for r in rows])).collect()}
    gone = plain_repeats(rows)
    for i, text in rows:
        parts = spans.sentences(text)
        assert found[i]["text"] == "".join(p for k, p in enumerate(parts) if k not in gone[i])
        assert found[i]["n_removed"] == len(gone[i])
        assert ("lazy dog" in found[i]["text"]) == (i == 0)
        cut = text
        for span in reversed(found[i]["removed"]):
            cut = cut[: span["start"]] + cut[span["end"] :]
        assert cut == found[i]["text"]


def test_texts_without_repeats_are_cut_once(documents, awkward, monkeypatch):
    rows = spans._cut(awkward).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_sentences"]) for r in rows) == sorted(
        {(i is None, i or 0, len(spans.sentences(t or ""))) for i, t, *_ in AWKWARD}
    )
    whole = {(r["doc_id"], r["text"]): r["n_sentences"] for r in spans.without_repeats(awkward).collect()}
    assert all(whole.get((i, t or ""), n) == n for i, t, *_ in AWKWARD for n in [len(spans.sentences(t or ""))])
    batch = pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([7], pa.int64()),
            "text": ["One. Two. Three."],
            "at": pa.array([[]], pa.list_(pa.int32())),
            "n_sentences": pa.array([3], pa.int32()),
        }
    )
    monkeypatch.setattr(spans, "sentences", None)
    (made,) = spans._remove([batch])
    assert made.to_pylist() == [
        {"doc_id": 7, "text": "One. Two. Three.", "n_sentences": 3, "n_removed": 0, "removed": []}
    ]


def test_spans_of_awkward_rows(documents, awkward):
    rows = spans.without_repeats(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {r["doc_id"]: r["text"] for r in rows}
    assert by_id[0].startswith("The cat") and "cat" not in by_id[4]
    assert by_id[2] == ""
    assert spans.without_repeats(documents([])).collect() == []


def planned_joins(monkeypatch, plans):
    """From now on ``plans`` gets the joins that Spark plans for each table that simhash and components store."""

    def kept(df, name, *by):
        plans.append((name, joins_of(df)))
        return stored(df, name, *by)

    for module in (simhash, graphs):
        monkeypatch.setattr(module, "stored", kept)


def joins_of(df):
    return re.findall(r"\w+Join\b", df._jdf.queryExecution().executedPlan().toString())


def test_rows_of_masks_are_not_broadcast(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "fps")  # a file of 8 bytes a row, of which an explode makes 31 rows each
    spark.range(300).select(F.col("id").alias("fp")).write.parquet(path)
    planned_joins(monkeypatch, plans := [])
    simhash.links(spark.read.parquet(path), bucket=60)  # large buckets are masked again
    assert len(plans) > 1 and all(found == ("buckets", ["SortMergeJoin"]) for found in plans)


@pytest.mark.parametrize("most, join", [(0, "SortMergeJoin"), (1000, "BroadcastHashJoin")])
def test_only_few_rows_may_be_broadcast(spark, documents, monkeypatch, most, join):
    texts = [f"{'the same words stand here again and again ' * 5}{'x' * (i % 7)}" for i in range(30)]
    rows = [(i, text, "en", "a") for i, text in enumerate([*texts, "some other text"])]
    monkeypatch.setattr(tables, "BROADCAST_ROWS", most)
    planned_joins(monkeypatch, plans := [])
    ends = [simhash.near_duplicates(documents(rows)), simhash.one_of_each(documents(rows))]
    for made in ends:
        plans.append(("end", joins_of(made)))
    by_name = {name: {join for n, found in plans if n == name for join in found} for name, _ in plans}
    assert by_name["buckets"] == {"SortMergeJoin"} and by_name["end"] == {join}
    assert by_name["edges"] == {join}
    assert ends[1].count() == len({r["component_id"] for r in ends[0].collect()})
