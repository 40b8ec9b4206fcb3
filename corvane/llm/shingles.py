"""Word shingles as sorted sets of 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20)
#: A random number for each byte; A-Z get those of a-z.
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTES[65:91] = _BYTES[97:123]
_STEPS = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
#: Bytes of text that are hashed at once, if no single text is longer.
CHUNK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _grow(n: int) -> None:
    """Powers of the base and of its inverse, modulo 2 to the 64."""
    while len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BACK)):
            p = _powers[k]
            _powers[k] = np.concatenate([p, p * _U(pow(b, len(p), 1 << 64))])


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes; equal stretches (A-Z as a-z) have equal hashes wherever they stand."""
    _grow(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[data] * _powers[0][: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def _chunk(raw: list[bytes]) -> list[np.ndarray]:
    lengths = np.array([len(r) + 1 for r in raw])
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    _grow(len(data) + 1)
    space = _SPACE[data]
    inside = ~space
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(np.where(inside, _BYTES[data], _U(0)) * _powers[0][: len(data)], out=total[1:])
    word = mix((total[ends] - total[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    n = len(word)
    rolled = np.zeros(max(0, n - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        rolled += word[k : k + len(rolled)] * _STEPS[k]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= WORDS:
            out.append(np.unique(rolled[lo : hi - WORDS + 1]))
        elif hi > lo:
            few = (word[lo:hi] * _STEPS[: hi - lo]).sum(dtype=np.uint64) + _U(int(hi - lo))
            out.append(mix(np.array([few], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_sets(texts) -> list[np.ndarray]:
    """The set of each text: hashes of its 5-word shingles, or of all its words if these are fewer."""
    out: list[np.ndarray] = []
    raw: list[bytes] = []
    size = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if raw and size + len(b) > CHUNK:
            out += _chunk(raw)
            raw, size = [], 0
        raw.append(b)
        size += len(b) + 1
    return out + (_chunk(raw) if raw else [])
