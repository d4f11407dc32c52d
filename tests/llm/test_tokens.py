import zlib
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugework.llm import harmonic, token_files
from gaugework.llm.bpe import PACK, Words, encoder
from gaugework.session import fresh_dir

from tests.llm.conftest import AWKWARD

VOCABULARIES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = st.text(st.sampled_from("aZé '\n\t0.,!_—ñß\r’sdlmtvreΩЯ́\x1c中İ²<|endoftext|>"), max_size=60)


@pytest.mark.parametrize("name", VOCABULARIES)
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(ODD, st.text(max_size=40)))
def test_ids_are_the_librarys(name, text):
    encode = encoder(name)
    assert encode.encode(text) == encode.whole(text)


def test_long_words_have_the_librarys_ids():
    encode = encoder("byte_bpe_50k.json")
    texts = ["xq" * n + "é" * n for n in (1, len(PACK) // 2, len(PACK), 5 * len(PACK))]
    assert [encode.encode(text) for text in texts] == [encode.whole(text) for text in texts]


def test_token_files_ask_the_model_once_for_a_word():
    class Model:
        asked = 0

        def tokenize(self, shown):
            self.asked += 1
            return []

    model = Model()
    words = Words(model, token_files.WORDS)
    for _ in range(2):
        for n in range(token_files.WORDS):
            words[f"w{n}"]
    assert model.asked == token_files.WORDS
    assert len(words) <= token_files.WORDS and len(words.old) <= token_files.WORDS


def expected(name, text, end):
    return [*encoder(name).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_give_back_every_id(spark, awkward):
    out = fresh_dir(spark, "tokens")
    token_files.write_token_files(awkward, out)
    rows = sorted(token_files.read_token_files(spark, out).collect(), key=lambda r: r["start"])
    texts = sorted(((i, t) for i, t, *_ in AWKWARD), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [expected("byte_bpe_50k.json", t, 0) for _, t in texts]
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
    assert [r["n_tokens"] for r in rows] == [len(x) for x in ids]
    assert [r["start"] for r in rows] == [0, *accumulate(len(x) for x in ids)][:-1]
    assert [r["ids_crc32"] for r in rows] == [crc(x) for x in ids]
    # The files by themselves: one after another they are all ids.
    manifest = sorted(token_files.read_manifest(spark, out).collect(), key=lambda r: r["part"])
    parts = [token_files.open_part(out, r["file"], r["docs"], r["tokens"]) for r in manifest]
    assert np.concatenate([p[3] for p in parts]).tolist() == [x for doc in ids for x in doc]
    assert all(isinstance(p[3], np.memmap) and p[3].dtype == np.uint16 for p in parts)


def test_token_files_of_nothing(spark, documents):
    out = fresh_dir(spark, "tokens")
    token_files.write_token_files(documents([]), out)
    assert token_files.read_token_files(spark, out).collect() == []


@given(st.integers(1, 10_000))
def test_cuts_cover_a_document(n):
    pieces = harmonic.cut(n)
    assert sum(pieces) == n and all(0 < p <= 2048 for p in pieces)
    assert len(pieces) <= n // 2048 + 3


def test_packing(spark, awkward):
    rows = harmonic.pack(awkward).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [0, *accumulate(r["length"] for r in pieces)][:-1]
        assert sum(r["length"] for r in pieces) <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    wanted = {}
    for i, t, *_ in AWKWARD:
        ids = expected("word_bpe_49k.json", t, 1)
        start = 0
        for n in harmonic.cut(len(ids)):
            wanted.setdefault(i, []).append((start, n, crc(ids[start : start + n]), len(ids)))
            start += n
    made = {i: sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in p) for i, p in by_doc.items()}
    assert made == {i: sorted(p) for i, p in wanted.items()}


def test_packing_wastes_little(spark, documents):
    texts = [(i, "some words to pack " * (7 * i % 640 + 1), "en", "a") for i in range(400)]
    rows = harmonic.pack(documents(texts)).collect()
    sequences = len({r["sequence_id"] for r in rows})
    assert sum(r["length"] for r in rows) > 0.97 * 2048 * sequences


def test_packing_of_nothing(documents):
    assert harmonic.pack(documents([])).collect() == []
