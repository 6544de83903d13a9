"""Text as the tokenizers' libraries see it, whatever Unicode version Python and its modules have."""

from __future__ import annotations

import re
import unicodedata

import regex

# What the libraries' Unicode version doesn't hold for letters, numbers and marks, and letters whose
# lower case Python may not know.  Code points in hexadecimal.
NEWER_LETTERS = """
    0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
    10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA
    18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96
    1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD
    323B0-33479 3D000-3FC3F
"""
NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
UNORDERED_MARKS = """
    07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF
    10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45
    11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF
"""
NEWER_LOWER = {0xA7CB: 0x264, 0xA7DC: 0x19B}  # and these ranges, by how far the lower case lies from them
NEWER_LOWER_RANGES = [(0x1C89, 0x1C89, 1), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]


def _class(ranges: str) -> str:
    """The inside of a character class."""
    return "".join("-".join(f"\\U{int(end, 16):08x}" for end in one.split("-")) for one in ranges.split())


_NEWER = re.compile(f"[{_class(NEWER_LETTERS + ' ' + NEWER_NUMBERS)}]")
_MARKS = re.compile(f"([{_class(UNORDERED_MARKS)}])")
_LOWER = {c + k: c + k + by for c, end, by in NEWER_LOWER_RANGES for k in range(end - c + 1)} | NEWER_LOWER
_TO_LOWER = re.compile("[" + "".join(map(chr, _LOWER)) + "]")
# the final sigma has no form of its own when letters are lowered one by one
_LOWER[0x3A3] = 0x3C3


class Splitter:
    """Finds a pattern's matches with the letters and numbers that the libraries know."""

    def __init__(self, pattern: str):
        self._plain = regex.compile(pattern)
        letters, numbers = f"[\\p{{L}}--[{_class(NEWER_LETTERS)}]]", f"[\\p{{N}}--[{_class(NEWER_NUMBERS)}]]"
        self._older = regex.compile(pattern.replace("\\p{L}", letters).replace("\\p{N}", numbers), regex.V1)

    def _for(self, text: str) -> regex.Pattern:
        return self._older if not text.isascii() and _NEWER.search(text) else self._plain

    def findall(self, text: str) -> list[str]:
        return self._for(text).findall(text)

    def finditer(self, text: str):
        return self._for(text).finditer(text)


def composed(text: str) -> str:
    """NFC; marks without an order there stay where they are."""
    if text.isascii() or unicodedata.is_normalized("NFC", text) and not _MARKS.search(text):
        return text
    return "".join(x if k % 2 else unicodedata.normalize("NFC", x) for k, x in enumerate(_MARKS.split(text)))


def lowered(text: str) -> str:
    """Lower case, letter by letter."""
    if not text.isascii() and ("Σ" in text or _TO_LOWER.search(text)):
        text = text.translate(_LOWER)
    return text.lower()
