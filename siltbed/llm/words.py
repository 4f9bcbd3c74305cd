"""Text reduced to the words that survive reformatting."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

# Characters without width, and letters of other scripts that look like Latin ones.
_UNSEEN = re.compile("[­͏᠎​-‏⁠-⁤︀-️﻿]")
_LOOKALIKE = str.maketrans(
    "аеорсухіјѕԁкмтнвАЕОРСУХІЈЅКМТНВαενικορτυχΑΕΝΙΚΟΡΤΥΧ",
    "aeopcyxijsdkmtnbAEOPCYXIJSKMTHBaevikoptuxAEVIKOPTYX",
)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_BROKEN = re.compile(r"(?<=\w)[-‐‑]+[ \t]*\r?\n[ \t>#*/|-]*(?=\w)")
_JOINER = re.compile(r"(?<=\w)[-‐‑'‘’`´](?=\w)")
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|\n\s*\n")


def clean(text: str) -> str:
    """text without markup, unseen characters, look-alike letters, ligatures, and hyphens and apostrophes inside words; case is kept."""
    # Most texts need few of these steps, and to ask is cheaper than to search.
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text)).translate(_LOOKALIKE)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _JOINER.sub("", text)


@lru_cache(maxsize=100_000)
def fold(word: str) -> str:
    """A word without case and accents; the last words are remembered, as most words come again."""
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.combining(c))


def alike(a: str, b: str) -> bool:
    """Equal, or words of four letters or more that differ by one letter added, dropped, changed or swapped with the next."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[at:], b[at:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])
