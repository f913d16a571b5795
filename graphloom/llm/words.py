"""Words of a text however it was typeset, wrapped or encoded."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

_ASCII_WORD = re.compile(r"[a-z]+|[0-9]+")
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}])+|\p{N}+")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")
_WRAPPED = regex.compile(r"(?<=\p{L})-[ \t]*\r?\n[\s>*#/|]*(?=\p{L})")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\([nrt])|\\([\"'\\/])")
#: Characters without a width that typesetting puts inside words.
_UNSEEN = tuple("­​‌‍‎‏⁠﻿")


def _unescape(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else " " if m[2] else m[3]


def plain(text: str) -> str:
    """Lower case without escapes, entities, markup tags, invisible characters, ligatures and hyphens at line ends."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        for unseen in _UNSEEN:
            if unseen in text:
                text = text.replace(unseen, "")
        text = unicodedata.normalize("NFKC", text)
    if "-" in text:
        text = _WRAPPED.sub("", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    """The words and numbers of a text; each Chinese or Japanese character is one. Null has none."""
    if not text:
        return []
    low = plain(text)
    return _ASCII_WORD.findall(low) if low.isascii() else _WORD.findall(low)
