"""Words of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

U = np.uint64
# Byte classes: a separator byte is False. Bytes above 127 belong to letters.
NOT_SPACE = np.array([not (b == 0x20 or 9 <= b <= 13) for b in range(256)])
LETTERS = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=U)
_STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and where each text's words begin
    (one more entry than texts)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    member = inside[buf]
    at = np.flatnonzero(member)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    if not len(at):
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    opens = np.empty(len(at), bool)
    opens[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=opens[1:])
    first = np.flatnonzero(opens)
    begin = at[first]
    length = np.diff(np.append(first, len(at)))
    inner = np.arange(len(at)) - np.repeat(first, length)
    value = _BYTES[buf[at]] * powers(int(length.max()))[inner]
    return mix(np.add.reduceat(value, first) + length.astype(U)), np.searchsorted(begin, offsets)


def windows(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of ``size`` words in one array of words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U)
    weight = mix(np.arange(1, size + 1, dtype=U) * U(2 * seed + 1) * _STEP) | U(1)
    out = np.zeros(n, U)
    for i in range(size):
        out += words[i : i + n] * weight[i]
    return mix(out)


def text_windows(words: np.ndarray, first: np.ndarray, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows that lie within one text: their hashes and the text of each."""
    out = windows(words, size, seed)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = owner[: len(out)] == owner[size - 1 :] if len(out) else np.empty(0, bool)
    return out[whole], owner[: len(out)][whole]
