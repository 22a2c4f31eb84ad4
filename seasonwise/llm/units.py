"""Tokens of whole texts by a cache of their space-separated units.

A byte-level tokenizer cuts a text before every single space that no white space follows, so
the ids of a text are the ids of its units in a row. Units repeat, so each is encoded once.
"""

import array
import json
import re
import sys
from functools import cached_property

from seasonwise.llm.common import tokenizer_path

# White space of Unicode beyond the six ASCII characters, and the separators on which
# Python and Unicode disagree: texts that hold one are left to the library as a whole.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
SPACE_RUN = re.compile("[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
AFTER_SPACE = tuple(" " + c for c in " \t\n\r\x0b\x0c")
# Letters and numbers of the Latin blocks, where the classes are certain (fixed values).
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"
LATIN = re.compile("[\t-\r -~¡-ɏ]*")


def odd_space(text: str) -> bool:
    if text.isascii():
        return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    return ODD_SPACE.search(text) is not None


class Remembered(dict):
    """Results of a function by argument; starts anew when ``limit`` entries are reached."""

    def __init__(self, function, limit: int):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self.function(key)
        self[key] = value
        return value


class ByteBpe:
    """Ids of texts as ``tokenizers`` gives them without added special tokens.

    ``max_units`` bounds the cache (about 200 bytes a unit).
    """

    PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+"
                           rf"| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")

    def __init__(self, file: str, max_units: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer
        path = tokenizer_path(file)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as handle:
            described = json.load(handle)
        self.special = tuple(t["content"] for t in described["added_tokens"])
        # Ids below the special ones are in the order of the merges: the ranks.
        letter = _byte_letters()
        ranks = {bytes(letter[c] for c in piece): i
                 for piece, i in described["model"]["vocab"].items()
                 if piece not in self.special}
        self.piece = tiktoken.Encoding(
            "ranks", pat_str=r"\s+|\S+", mergeable_ranks=ranks,
            special_tokens={})._core_bpe.encode_single_piece
        self.words = Remembered(lambda word: packed(self.piece(word.encode())), max_units // 2)
        self.spaced = Remembered(lambda unit: self._encode(" " + unit), max_units)

    def _whole(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def _encode(self, unit: str) -> bytes:
        if not LATIN.fullmatch(unit):
            return self._whole(unit)
        return b"".join(map(self.words.__getitem__, self.PRE_TOKEN.findall(unit)))

    def ids(self, text: str) -> bytes:
        """Ids as unsigned little-endian 32-bit numbers."""
        if odd_space(text) or any(s in text for s in self.special):
            return self._whole(text)
        if any(pair in text for pair in AFTER_SPACE):
            return b"".join(map(self._encode, SPACE_RUN.findall(text)))
        first, *rest = text.split(" ")
        return self._encode(first) + b"".join(map(self.spaced.__getitem__, rest))


def packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, reversed.

    Printable Latin-1 bytes stand for themselves, the others follow from code point 256.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class PreTokens:
    """Pre-tokens of units of a tokenizer that drops white space, and their piece counts."""

    PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]"
                           rf"|[^\s{LETTERS}{NUMBERS}]+")

    def __init__(self, file: str):
        self.file = file
        with open(tokenizer_path(file), encoding="utf-8") as handle:
            special = [t["content"] for t in json.load(handle)["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")

    @cached_property
    def library(self):
        """The whole tokenizer, loaded when a task first counts pieces."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(tokenizer_path(self.file))

    @cached_property
    def rules(self):
        """Its normalisation and cutting alone, without the vocabulary."""
        from tokenizers import Tokenizer
        with open(tokenizer_path(self.file), encoding="utf-8") as handle:
            described = json.load(handle)
        bare = {"type": "BPE", "vocab": {}, "merges": []}
        return Tokenizer.from_str(json.dumps(described | {
            "model": bare, "added_tokens": [], "post_processor": None}))

    @staticmethod
    def units(text: str) -> list[str]:
        """Runs without white space of Unicode."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return re.findall("[^\\s]*(?:[\x1c-\x1f]+[^\\s]*)+|[^\\s]+", text)
        return text.split()

    def of_unit(self, unit: str) -> list[str]:
        """Normalised pre-tokens of a unit; a special string is a pre-token of its own."""
        if unit.isascii() and unit.isalpha():
            return [unit if unit.islower() else unit.lower()]
        if "<|" in unit and self.special.search(unit):
            return [p for k, part in enumerate(self.special.split(unit)) if part
                    for p in ([part] if k % 2 else self.of_unit(part))]
        if LATIN.fullmatch(unit):
            return self.PRE_TOKEN.findall(unit.lower())
        normal = self.rules.normalizer.normalize_str(unit)
        return [normal[a:b] for _, (a, b) in self.rules.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of each pre-token by the library."""
        return list(map(len, self.library.encode_batch_fast(
            pre_tokens, add_special_tokens=False)))
