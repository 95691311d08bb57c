"""Byte-level pre-tokens and a bounded cache of what becomes of them.

A text is cut before every blank that a non-blank character follows. A pre-token never reaches over such a
place, so the stretches between ("units") can be looked up one by one: most units of a corpus repeat.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable

import regex
from tokenizers.pre_tokenizers import ByteLevel

from jobdelta.llm.common import once

# The pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BEFORE_WORD = regex.compile(r" (?=\S)")
_NO_WORD = re.compile(r" (?!\S)")  # re's blanks are those of regex and a few more
_FIND = regex.compile(PATTERN)
_MARKS = frozenset(string.punctuation)
#: Below this character all Unicode versions class letters, digits and blanks alike; above, the library's own version decides.
_SETTLED = "\u0530"


def units(text: str) -> tuple[str, list[str]]:
    """The stretch before the first cut, and the stretches after the cuts, each without its leading blank."""
    parts = _BEFORE_WORD.split(text) if _NO_WORD.search(text) else text.split(" ")
    return parts[0], parts[1:]


def find(text: str) -> list[bytes]:
    """The pre-tokens of a text, in order, as UTF-8."""
    if text.isascii() or max(text) < _SETTLED:
        # Most texts are a word, or a word and one mark: their pre-tokens are known without a search.
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            return [text.encode()]
        if word[-1:] in _MARKS and word[:-1].isalpha():
            return [text[:-1].encode(), text[-1:].encode()]
        return [p.encode() for p in _FIND.findall(text)]
    letters = once("byte letters", byte_letters)
    return [bytes(letters[c] for c in p) for p, _ in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]


def keep_used(kept: dict, used: set, limit: int) -> None:
    """Empties a dictionary of more than `limit` entries but for those of `used`: frequent ones stand in nearly every request."""
    if len(kept) > limit:
        stay = {u: kept[u] for u in used if u in kept}
        kept.clear()
        if len(stay) <= limit // 2:
            kept.update(stay)


class UnitCache:
    """What `encode` makes of units, kept for up to `limit` units.

    `encode` takes a list of strings and returns a value for each. A full cache is emptied but for what is asked for now.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 200_000, longest: int = 64):
        self.encode, self.limit, self.longest, self.kept = encode, limit, longest, {}

    def values(self, texts: list[str]) -> list[tuple]:
        """For each text the value of its first stretch, and an iterator over those of the others."""
        kept = self.kept
        cut = [units(t) for t in texts]
        used = set().union(*(rest for _, rest in cut))
        keep_used(kept, used, self.limit)
        new = used.difference(kept)
        heads = list({h for h, _ in cut})
        new = list(new)
        made = self.encode(heads + [" " + u for u in new])
        head = dict(zip(heads, made))
        kept.update(zip(new, made[len(heads):]))
        out = [(head[h], list(map(kept.__getitem__, rest))) for h, rest in cut]
        for u in new:
            if len(u) > self.longest:
                del kept[u]
        return out

    def drop_long(self, made: dict, found: list[list[bytes]]) -> None:
        """Takes pre-tokens beyond `longest` out of `made`: entries of bounded size, of bounded number, take bounded memory."""
        for p in {p for ps in found for p in ps if len(p) > self.longest}:
            del made[p]


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable bytes stand for themselves,
    the others, in order, for the letters from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges by rank, and the special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = j["model"]["vocab"]
        self.tokens: dict[int, bytes] = {n: raw(t) for t, n in ids.items()}
        self.byte_ids = [0] * 256
        for n, t in self.tokens.items():
            if len(t) == 1:
                self.byte_ids[t[0]] = n
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        #: (left id, right id) by rank, and the id each makes
        self.merges = [(ids[a], ids[b]) for a, b in pairs]
        self.made = [ids[a + b] for a, b in pairs]
        self.specials = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings: ordinary text at even places, special strings at odd ones."""
        if self._special is None or not any(s in text for s in self.specials):
            return [text]
        return self._special.split(text)
