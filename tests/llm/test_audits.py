"""The Merkle manifest and the divergence of sources, against plainer versions."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from checks.compare import database, difference
from gaugework.llm import divergence, merkle
from gaugework.llm.queries import ORACLES, QUERIES

from tests.llm.conftest import AWKWARD

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_twins(spark, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(found, database(FOLDER).execute(ORACLES[name]).df()) is None


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(i, text, lang, source):
    n = None if text is None else len(text)
    values = [None if v is None else str(v) for v in (i, source, lang, n, text)]
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb_with(digests, at):
    """(root, siblings of place ``at``, a function that folds another digest in its place)."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    siblings, steps, place = [], [], at
    for level in levels[:-1]:
        run = level[place // 3 * 3 : place // 3 * 3 + 3]
        steps.append((run, place % 3))
        siblings += run[: place % 3] + run[place % 3 + 1 :]
        place //= 3

    def fold(digest):
        for run, slot in steps:
            digest = h(*run[:slot], digest, *run[slot + 1 :])
        return digest

    return levels[-1][0], siblings, fold


def plain_manifest(rows):
    trees = {}
    for i, text, lang, source in rows:
        trees.setdefault(source, []).append((i is not None, i, plain_leaf(i, text, lang, source), text, lang))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for own in trees.values():
        own.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
    roots = [climb_with([r[2] for r in trees[name]], 0)[0] for name in names]
    made = []
    for k, name in enumerate(names):
        root, above, fold_above = climb_with(roots, k)
        digests = [r[2] for r in trees[name]]
        for at, (_, i, digest, text, lang) in enumerate(trees[name]):
            subroot, siblings, fold = climb_with(digests, at)
            odd = i is None or zlib.crc32(str(i).encode()) % 2
            n = None if text is None else len(text)
            now = digest if odd or text is None else hashlib.sha256(cut(i, name, lang, n, text).encode()).hexdigest()
            folded = fold_above(fold(now))
            made.append((str(i), digest, subroot, root, h(*siblings, *above), folded, folded == root))
    return sorted(made)


def cut(i, source, lang, n, text):
    values = [None if v is None else str(v) for v in (i, source, lang, n, text.replace("\n", ""))]
    return "".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values)


def shown(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())


def test_manifest_of_awkward_rows(documents, awkward):
    made = merkle.tampered_manifest(awkward)
    assert shown(made) == plain_manifest(AWKWARD)
    assert merkle.tampered_manifest(documents([])).collect() == []
    one = [(5, "a\nb", "en", None)]
    assert shown(merkle.tampered_manifest(documents(one))) == plain_manifest(one)


def test_manifest_over_several_blocks(documents):
    """A source of three passes, one of a block and one leaf, small ones, ties of doc_id over an edge of blocks."""
    rows = [(i // 2, f"t{i}\n", "en", "hot") for i in range(2 * 3**8 + 5)]
    rows += [(i, "x\n" * (i % 3), None, "b") for i in range(3**8 + 1)]
    rows += [(i, "y", "en", f"s{i % 40}") for i in range(100)]
    made = shown(merkle.tampered_manifest(documents(rows)))
    assert made == plain_manifest(rows)
    assert {r[6] for r in made} == {True, False}


def test_a_state_is_resumed_where_it_was_kept():
    digests = [h(str(i)) for i in range(3)]
    parent = merkle.Parent(digests)
    for slot in range(3):
        new = h("new")
        assert merkle.resumed(parent.before[slot], new, parent.right(slot)) == h(*digests[:slot], new, *digests[slot + 1 :])
        assert merkle.resumed(parent.before[slot], digests[slot], parent.right(slot)) == parent.digest


def plain_divergence(rows, least, top):
    docs = [
        (lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        for _, text, lang, source in rows
    ]
    made = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                made += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(made)


@pytest.mark.parametrize("least", [1, 2, 30])
def test_divergence_of_awkward_rows(documents, awkward, least):
    made = divergence.divergence(awkward, least, 5)
    assert sorted(map(tuple, made.collect())) == plain_divergence(AWKWARD, least, 5)
    assert divergence.divergence(documents([]), least).collect() == []


def test_divergence_of_copies_over_sources(documents):
    texts = [f"w{chr(97 + i % 7)} Äpfel{chr(97 + i % 5)} common x{chr(97 + i % 11)} 12 common" for i in range(60)]
    rows = [(i, texts[i * i % 60 if i % 3 else 0], "en" if i % 4 else "de", f"s{i % 6}") for i in range(600)]
    made = divergence.divergence(documents(rows), 20, 3)
    assert sorted(map(tuple, made.collect())) == plain_divergence(rows, 20, 3)


def test_texts_are_cut_once_and_counted_by_copies(documents, monkeypatch):
    rows = divergence.term_counts(documents([(i, "a b a", "en", "xy"[i % 3 == 0]) for i in range(90)]))
    found = {(r["source"], r["term"]): (r["docs"], r["n"]) for r in rows.collect()}
    assert found == {("x", "a"): (60, 120), ("x", "b"): (60, 60), ("y", "a"): (30, 60), ("y", "b"): (30, 30)}
