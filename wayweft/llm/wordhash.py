"""Word and word-sequence hashes of whole texts, without a Python object for each word.

Words are runs of bytes other than space and 0x09 to 0x0D. A word's hash is a polynomial in its bytes modulo
2**64, taken from one running sum over the text, and then mixed; a sequence's hash is a polynomial in its
words' hashes, likewise.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Odd multipliers of the polynomials over bytes, over words, and of a second one over words.
BYTES, WORDS, WORDS_TWO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Bytes or words hashed at once.
STEP = 1 << 21

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    found = _powers.get(base)
    if found is None or len(found[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        up = np.full(size, base, dtype=_U)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=_U)
        up[0] = down[0] = 1
        found = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    mask = np.zeros(len(buffer) + 2, dtype=np.int8)
    mask[1:-1] = ~_SPACE[buffer]
    step = np.diff(mask)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _hash_part(buffer: np.ndarray) -> np.ndarray:
    starts, ends = bounds(buffer)
    up, down = _power_table(BYTES, len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, dtype=_U)
    np.cumsum((buffer.astype(_U) + _U(1)) * up[: len(buffer)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xFF51AFD7ED558CCD))


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; lower: A-Z count as a-z."""
    buffer = np.frombuffer(data, dtype=np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    if len(buffer) <= STEP:
        return _hash_part(buffer) if len(buffer) else np.zeros(0, dtype=_U)
    parts, at = [], 0
    while at < len(buffer):
        end = min(len(buffer), at + STEP)
        while end < len(buffer) and not _SPACE[buffer[end]]:
            spaces = np.flatnonzero(_SPACE[buffer[end : end + STEP]])
            end = end + int(spaces[0]) if len(spaces) else min(len(buffer), end + STEP)
        parts.append(_hash_part(buffer[at:end]))
        at = end
    return np.concatenate(parts)


def sequence_hashes(words: np.ndarray, k: int, base: int = WORDS) -> np.ndarray:
    """The hash of each run of k consecutive words, by its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    parts = []
    for at in range(0, n, STEP):
        part = words[at : at + STEP + k - 1]
        up, down = _power_table(base, len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        m = len(part) - k + 1
        parts.append(mix((sums[k : k + m] - sums[:m]) * down[:m] + _U(k)))
    return np.concatenate(parts)


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of width consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
