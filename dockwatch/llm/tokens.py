"""Token ids of texts by a public byte-level BPE file, fast for repeated words.

The tokenizer first cuts a text into pieces (a word with its leading space, a
number, a run of signs) and encodes each piece on its own. For plain Latin texts
the cut is one regular expression over fixed character classes, so pieces that
come again are looked up, and new ones are merged by the file's own ranks. Every
other text, and any text that could hold a special token, goes to the tokenizer
whole.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Characters up to here have had their Unicode classes fixed since long.
PLAIN_END = 0x240
#: Pieces kept by a task.
CACHE = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _class(prefix: str) -> str:
    """A regular-expression class of the plain characters of one Unicode class."""
    inside = [c for c in range(PLAIN_END) if unicodedata.category(chr(c)).startswith(prefix)]
    return "".join(f"\\u{c:04x}" for c in inside)


def _pattern() -> re.Pattern:
    # Fixed value: the published cut of this vocabulary, with its classes spelled out for plain characters.
    letter, number, space = _class("L"), _class("N"), r"\t-\r \x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+"
                      rf"| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def _ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of the file by bytes: printable bytes stand for themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in shown}
    byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}


class Encoder(dict):
    """Piece to its ids, as little-endian unsigned numbers of 32 bits in bytes."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = _pattern().findall
        ranks = {b: i for b, i in _ranks(path).items() if b.decode("utf-8", "replace") not in self.special}
        # Its pattern takes a piece as it is.
        self.merge = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks,
                                       special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = array("I", self.merge(piece))
        if sys.byteorder == "big":
            ids.byteswap()
        self[piece] = out = ids.tobytes()
        return out

    def encode(self, text: str) -> bytes:
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        # Lead bytes up to 0xC8 are characters below PLAIN_END; 0x1C to 0x1F are left to the tokenizer.
        if (not len(raw) or raw.max() > 0xC8 or ((raw >= 0x1C) & (raw < 0x20)).any()
                or any(s in text for s in self.special)):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.cut(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once by each Python worker."""
    return Encoder(path)
