"""Seeded 64-bit hashes of words, word windows and byte windows, vectorised over whole texts."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; longer stretches without white space are taken whole.
PIECE = 1 << 18
#: The longest table of powers that is kept.
KEPT = 1 << 22
_BASE = 0x9E3779B97F4A7C15
INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(64).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        steps = np.full(max(n, PIECE) + 1, base, dtype=np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if n <= KEPT:
            _powers[base] = known
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of byte values times powers: differences are hashes of stretches, up to a power."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data))[: len(data)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each stretch of bytes, wherever it stands."""
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64) * _STEP)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space) of the texts, and where each text's words begin: n + 1 bounds."""
    found, counts = [np.zeros(0, dtype=np.uint64)], []

    def add(some: list[bytes]) -> np.ndarray:
        """Hash some texts; their numbers of words."""
        data = np.frombuffer(b" ".join([*some, b""]), dtype=np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        found.append(stretch_hashes(prefix_sums(data), starts, ends))
        return np.diff(np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in some)])))

    some: list[bytes] = []
    width = 0
    for text in [*texts, None]:
        if some and (text is None or width + len(text) > PIECE):
            counts.append(add(some))
            some, width = [], 0
        if text is None:
            break
        if len(text) <= PIECE:
            some.append(text)
            width += len(text) + 1
            continue
        words, at = 0, 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            words += int(add([text[at:end]])[0])
            at = end
        counts.append(np.array([words]))
    sizes = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` words, by the place of its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = total * _STEP + words[k : k + n]
    return mix(total + np.uint64(width))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window of ``width`` values, by the place of its first."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
