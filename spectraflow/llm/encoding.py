"""Whole-text encoding with the tokenizers library, at corpus speed.

A tokenizer splits a text into words before it merges, so words are encoded
once and remembered. That is only done where the split is sure to be the
library's own: plain Latin text. Any other text goes to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import regex

# The split patterns of the two vocabulary files.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Anything but Latin letters, ASCII and general punctuation, spaces and newlines; one code point that changes length in lower case is out.
FOREIGN = re.compile("[^ -~\n\xa1-įı-ſ‐-‧]")
UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
STOPS = frozenset(",.;:!?")
#: Bounds of the two memos: some 150 and 60 MB a worker if full.
UNITS_KEPT = 500_000
WORDS_KEPT = 250_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


LETTERS = _byte_letters()


class Memo(dict):
    """What ``make`` gives for a key; kept for short keys, up to a bound."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(self) < UNITS_KEPT and len(key) < 40:
            self[key] = found
        return found


class Encoder:
    """ids of whole texts as uint32 bytes, the same as ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        self.lower = "Lowercase" in kinds
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        known = BYTE_SPLIT if not self.lower and '"use_regex": true' in kinds else WORD_SPLIT if self.lower and WORD_SPLIT.replace("\\", "\\\\") in kinds else None
        self.split = regex.compile(known) if known else None
        self.words: dict[str, bytes] = {}
        self.units = Memo(self._unit)
        self.spaced = Memo(lambda word: self._unit(" " + word))
        self.model = self.tokenizer.model
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            symbols = word.translate(LETTERS) if word.isascii() else word.encode().decode("latin-1").translate(LETTERS)
            found = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
            if len(self.words) < WORDS_KEPT:
                self.words[word] = found
        return found

    def _unit(self, unit: str) -> bytes:
        if self.lower:
            unit = unit.lower()
        body = unit[1:] if unit[:1] == " " else unit
        if body.isalpha():  # letters only, with one blank before them at most, are one word to either pattern
            return self._word(unit)
        if body[-1:] in STOPS and body[:-1].isalpha():
            return self._word(unit[:-1]) + self._word(unit[-1])
        return b"".join([self._word(w) for w in self.split.findall(unit)])

    def _plain(self, text: str) -> bool:
        if text.isascii():
            return text.replace("\n", "").isprintable()
        return FOREIGN.search(text) is None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split is None or not self._plain(text) or any(s in text for s in self.specials):
            return self.whole(text)
        if self.lower:
            return b"".join(map(self.units.__getitem__, text.split()))
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return b"".join(map(self.units.__getitem__, UNIT.findall(text)))
        lines = []
        for line in text.split("\n"):  # single spaces and newlines: a space goes to the word after it, a newline is a word
            first, *rest = line.split(" ")
            lines.append(b"".join([self.units[first], *map(self.spaced.__getitem__, rest)]))
        return self.newline.join(lines)

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) // 4


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker; workers live longer than tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def version(path: str) -> str:
    """Digest of a tokenizer file: what a stored count depends on besides the text."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
