"""Cuts text into the pieces that byte-level BPE encodes one by one."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: The code points of white space.
WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe to stand as a piece with it.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Longer texts are cut where a piece surely ends, so that working arrays stay small.
SEGMENT = 1 << 20


@functools.cache
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[WHITE] = SPACE
    return table


def _starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start, for code points of texts that each have one more point after them, at ``ends``."""
    n = len(points)
    kind = _classes()[points]
    kind[ends] = END
    start = np.ones(n + 1, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[ends] = True
    # The last white space before other text stands alone, or joins that text if it is a blank.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    start[last + 1] = points[last] != 0x20
    # An apostrophe that starts a piece takes an ending with it.
    marks = np.flatnonzero((points == 0x27) & start[:n] & (kind != END))
    if len(marks):
        one, two = points[np.minimum(marks + 1, n - 1)], points[np.minimum(marks + 2, n - 1)]
        one_end, two_end = kind[np.minimum(marks + 1, n - 1)] == END, kind[np.minimum(marks + 2, n - 1)] == END
        size = np.zeros(len(marks), dtype=np.int64)
        for ending in ENDINGS:
            hit = (one == ord(ending[0])) & ~one_end
            if len(ending) == 2:
                hit &= (two == ord(ending[1])) & ~two_end
            size[hit & (size == 0)] = len(ending)
        at, size = marks[size > 0], size[size > 0]
        start[at + 1] = False
        start[at + 1 + size] = True
    return start


def _segments(text: str):
    """The text in parts of about :data:`SEGMENT`, each ending before a blank that follows other text."""
    a, n = 0, len(text)
    while n - a > 2 * SEGMENT:
        b = a + SEGMENT
        while True:
            b = text.find(" ", b)
            if b < 0 or not text[b - 1].isspace():
                break
            b += 1
        if b < 0:
            break
        yield text[a:b]
        a = b
    yield text[a:] if a else text


def pieces_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of many texts, in order, with one empty string after those of each text; and the places
    of these.  The pieces of a text joined are the text again."""
    whole = "\0".join([*texts, ""])
    if not whole:
        return [], np.zeros(0, dtype=np.int64)
    points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
    at = np.flatnonzero(_starts(points, ends))
    places = np.searchsorted(at, ends)
    bounds = at.tolist()
    out = [whole[a:b] for a, b in zip(bounds, bounds[1:])]
    for i in places.tolist():
        out[i] = ""
    return out, places


def parts_of(text: str) -> list[str]:
    """A text in parts of at most about twice :data:`SEGMENT`, cut only where pieces end anyway."""
    return [text] if len(text) <= 2 * SEGMENT else list(_segments(text))
