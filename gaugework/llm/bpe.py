"""Token ids of whole texts with the tokenizers library, through a cache of words.

The library's own pipeline spends most of its time on offsets. Here a text of
plain characters is cut into words by the tokenizer's own pattern, and each word
that is new to the worker goes to the library's model once. Any other text (rare
alphabets, combining marks, digits that are not ASCII, anything that may spell a
special token) goes through the library as a whole. Ids are the same either way.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from codecs import charmap_decode

import numpy as np
import public_tokenizers

#: Words a worker keeps, in each of two generations, if not told otherwise. A word takes about 160 bytes.
CACHED_WORDS = 120_000

#: Letters for which Python's classes and the tokenizers' agree, and which
#: normalisation leaves alone; "plain" texts have no others.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ŽΑ-ΡΤ-Ωα-ρτ-ωА-яёЁ"
NOT_PLAIN = re.compile(f"[^\t\n\r -~\xa1\xab\xbb\xbf–—‘-„…{LETTERS}]")

#: The word patterns of the two kinds of tokenizer, for plain texts.
BYTE_WORDS = (
    rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{LETTERS}0-9\t\n\r ]+"
    r"|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
)
LOWER_WORDS = rf"[{LETTERS}]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^{LETTERS}0-9\t\n\r ]+"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: By their number, how to pack the ids of a word; longer words are rare.
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


class Words(dict):
    """Packed ids by word; two generations bound its size."""

    def __init__(self, model, most: int = CACHED_WORDS):
        super().__init__()
        self.most = most
        # By byte, as a string: so decoding a word shows it in one step.
        self.tokenize, self.old, self.alphabet = model.tokenize, {}, "".join(map(byte_alphabet().get, range(256)))

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            shown, _ = charmap_decode(word.encode(), "strict", self.alphabet)
            ids = [t.id for t in self.tokenize(shown)]
            packed = PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = packed
        return packed


class Encoder:
    def __init__(self, path: str, words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            described = json.load(file)
        self.specials = [t["content"] for t in described.get("added_tokens", [])]
        self.lower = bool(described.get("normalizer"))
        cut = str(described.get("pre_tokenizer"))
        pattern = BYTE_WORDS if not self.lower and "'use_regex': True" in cut else None
        pattern = LOWER_WORDS if self.lower and "Split" in cut else pattern
        self.find = re.compile(pattern).findall if pattern else None
        self.words = Words(self.tokenizer.model, words)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for a null text."""
        if not text:
            return b""
        if not self.find or NOT_PLAIN.search(text) or any(s in text for s in self.specials):
            return self.whole(text)
        words = self.find(text.lower() if self.lower else text)
        return b"".join(map(self.words.__getitem__, words))


def vocabulary_file(name: str) -> str:
    """Where the public vocabulary ``name`` lies on this machine."""
    return name if "/" in name else public_tokenizers.path(name)


@functools.cache
def encoder(name: str, words: int = CACHED_WORDS) -> Encoder:
    """This worker's encoder, which keeps twice so many ``words``; it outlives a task."""
    return Encoder(vocabulary_file(name), words)
