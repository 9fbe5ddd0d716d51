"""Pieces of pre-tokens, as the tokenizers library gives them for a vocabulary file.

A text of plain characters is lower-cased and split by the vocabulary's pattern; only
distinct pre-tokens then go through the library's merge model. Any other text (other
scripts, special strings, odd white space) is cut at spaces and line ends, which the
vocabulary drops, and its distinct chunks go through the whole library pipeline. What a
pre-token or chunk gave is kept as long as the worker process lives.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable
from functools import cache

from tokenizers import Tokenizer

#: Entries of the cache; beyond them it starts anew, which costs time and changes nothing.
CACHE = 600_000
#: Anything but these: white space, and characters whose lower case, NFC form and class are the same in every library.
NOT_PLAIN = re.compile(r"[^ \n\t\r!-~À-ÿ]")
#: Letters and digits among the plain characters.
LETTERS, DIGITS = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"
#: Before the key of a chunk that the whole library has to split.
WHOLE = "\x00"


def plain_pattern(pattern: str) -> re.Pattern | None:
    """A splitting pattern for plain texts, its letter and number classes written out."""
    for given, own in ((r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}{DIGITS}]"), (r"[\p{L}]", f"[{LETTERS}]"), (r"[\p{N}]", f"[{DIGITS}]"), (r"\p{L}", f"[{LETTERS}]"), (r"\p{N}", f"[{DIGITS}]")):
        pattern = pattern.replace(given, own)
    return None if r"\p" in pattern else re.compile(pattern)


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces:
    """Texts to keys, and keys to packed ids, for lower-casing vocabularies that drop white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if spec["normalizer"]["normalizers"][-1]["type"] != "Lowercase" or steps[0]["behavior"] != "Removed":
            raise ValueError(f"{path}: not a lower-casing vocabulary that drops white space")
        self.pattern = plain_pattern(steps[0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cache: dict[str, bytes] = {}

    def split(self, text: str | None) -> list[str]:
        """The text's pre-tokens, or its chunks marked with ``WHOLE``."""
        if not text:
            return []
        if self.pattern and not NOT_PLAIN.search(text) and not any(s in text for s in self.special):
            return self.pattern.findall(text.lower())
        return [WHOLE + c for c in re.split("[ \n\t\r]+", text) if c]

    def learn(self, wanted: Iterable[str]) -> dict[str, bytes]:
        """The cache, holding at least the wanted keys."""
        if len(self.cache) > CACHE:
            self.cache = {}
        known, tokenize, whole = self.cache, self.model.tokenize, []
        for key in wanted:
            if key in known:
                continue
            if key[0] == WHOLE:
                whole.append(key)
            elif key.isascii():
                known[key] = pack([t.id for t in tokenize(key)])
            else:
                known[key] = pack([t.id for part, _ in self.library.pre_tokenizer.pre_tokenize_str(key) for t in tokenize(part)])
        if whole:
            for key, found in zip(whole, self.library.encode_batch([k[1:] for k in whole], add_special_tokens=False), strict=True):
                known[key] = pack(found.ids)
        return known


@cache
def pieces(path: str) -> Pieces:
    """The vocabulary of this worker process, with what its earlier tasks have seen."""
    return Pieces(path)
