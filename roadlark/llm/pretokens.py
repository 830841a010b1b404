"""Pretokens of byte-level BPE: the pieces of a text that merges never cross."""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex

#: The pretoken pattern of byte-level BPE, over all of Unicode and over ASCII.
BLANK = r"\t-\r \x85\xa0  -     　"
WIDE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
NARROW = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
END_OF_TEXT = "<|endoftext|>"
#: A single space between two characters that are no blanks always begins a pretoken.
SAFE_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
CHUNK = 1 << 20


def chunks(text: str) -> Iterator[str]:
    """The text in parts of about CHUNK characters, cut where a pretoken begins anyway."""
    at = 0
    while len(text) - at > CHUNK and (cut := SAFE_CUT.search(text, at + CHUNK)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def pretokens(text: str) -> Iterator[list[str]]:
    """Lists of pretokens, in order; the end-of-text marker comes as a list of its own."""
    parts = text.split(END_OF_TEXT) if END_OF_TEXT in text else [text]
    for k, part in enumerate(parts):
        if k:
            yield [END_OF_TEXT]
        for chunk in chunks(part):
            if chunk:
                yield (NARROW if chunk.isascii() else WIDE).findall(chunk)
