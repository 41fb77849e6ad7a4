"""Words of byte texts as hashes, piece by piece: a very long text takes a bounded multiple of PIECE beside
its eight bytes a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes of a text that are worked on at once; a piece ends at white space, so a longer word makes a longer one.
PIECE = 1_000_000
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> U(30)
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end behind white space."""
    at = 0
    while len(raw) - at > size:
        end = at + size
        while end < len(raw):
            found = np.flatnonzero(SPACE[np.frombuffer(raw, np.uint8, min(size, len(raw) - end), end)])
            if len(found):
                end += int(found[0]) + 1
                break
            end = min(len(raw), end + size)
        yield raw[at:end]
        at = end
    if at < len(raw) or not raw:
        yield raw[at:]


def spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(white space or not, starts, ends) of the words; the text's last byte must be white space."""
    space = SPACE[text]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    return space, starts, np.flatnonzero(space & np.r_[False, ~space[:-1]])


def hashes(text: np.ndarray, space: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.empty(0, U)
    widths = np.diff(np.r_[starts, len(text)])
    inside = np.zeros(len(text), np.int64)
    inside[starts[0] :] = np.arange(starts[0], len(text)) - np.repeat(starts, widths)
    powers = np.cumprod(np.r_[U(1), np.full(int(widths.max()), U(0x9E3779B97F4A7C15))].astype(U))
    words = np.add.reduceat(np.where(space, U(0), (text.astype(U) + U(1)) * powers[inside]), starts)
    return mix(words + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_hashes(raw: bytes) -> np.ndarray:
    """The hashes of a text's words, A-Z lower-cased."""
    out = []
    for piece in pieces(raw):
        text = np.frombuffer(piece.lower() + b" ", np.uint8)
        out.append(hashes(text, *spans(text)))
    return out[0] if len(out) == 1 else np.concatenate(out)
