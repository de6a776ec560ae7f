"""Content-chosen fingerprints of all windows of texts, vectorised over many documents at a time.

Every window of ``span`` characters is represented by the least hash among the ``gram``-character grams inside it, so equal
windows have equal representatives wherever they stand. Neighbouring windows mostly share theirs: a maximal stretch of
windows with one representative is a segment, about 2/(span-gram+2) as many as there are characters.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so that it has an inverse


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any stretch of a text, from prefix sums: polynomial in a base, modulo 2**64, over mixed characters."""

    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        if Rolling._powers is None or len(Rolling._powers[0]) <= n:
            both = []
            for b in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(max(n + 1, 1 << 16), b, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            Rolling._powers = (both[0], both[1])
        up, self._down = Rolling._powers
        values = _mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self._sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """The hash of every window of ``length`` characters."""
        n = len(self._sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return _mix((self._sums[length:] - self._sums[:n]) * self._down[:n])


class Exact:
    """Hashes of all windows of one length modulo two primes: 62 bits, without the coincidences that powers of two have on
    texts of regular structure."""

    _PRIMES, _BASES = (2_147_483_647, 2_147_483_629), (1_000_003_579, 1_234_567_891)
    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def _held(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = cls._powers.get(which)
        if held is None or len(held[0]) < n:
            p = np.uint64(cls._PRIMES[which])
            both = []
            for b in (cls._BASES[which], pow(cls._BASES[which], -1, cls._PRIMES[which])):
                powers, step = np.ones(1, np.uint64), b
                while len(powers) < max(n, 1 << 16):
                    powers = np.concatenate([powers, powers * np.uint64(step) % p])
                    step = step * step % int(p)
                both.append(powers)
            held = cls._powers[which] = (both[0], both[1])
        return held

    @classmethod
    def windows(cls, codes: np.ndarray, length: int) -> np.ndarray:
        """The hash of every window of ``length`` characters, as int64."""
        n = len(codes) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out = np.zeros(n, np.uint64)
        for which, prime in enumerate(cls._PRIMES):
            p = np.uint64(prime)
            up, down = cls._held(which, len(codes))
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(which + 1)) % p * up[: len(codes)] % p, out=sums[1:])
            sums %= p
            out = (out << np.uint64(31)) | ((sums[length:] + p - sums[:n]) % p * down[:n] % p)
        return out.view(np.int64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """All characters of ``texts`` in a row, where each text starts (and the end), and the same as UTF-32 bytes."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(raw, np.uint32), starts, raw


def segments(texts: list[str], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """The segments of all windows of ``span`` characters of ``texts``: (text number, first window's start in that text,
    count of windows, representative, digest of the segment's own text), the last two as int64."""
    codes, starts, raw = codes_of(texts)
    least = sliding_min(Rolling(codes).windows(gram), span - gram + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(least)]
    inside = np.arange(len(least)) + span <= starts[owner + 1]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(fresh)
    count = np.diff(np.append(at, len(least)))
    kept = inside[at]
    at, count = at[kept], count[kept]
    view = memoryview(raw)
    digest = xxhash.xxh3_64_intdigest
    ends = at + count - 1 + span
    digests = np.fromiter((digest(view[4 * a : 4 * e]) for a, e in zip(at.tolist(), ends.tolist())), np.uint64, len(at))
    return owner[at], at - starts[owner[at]], count, least[at].view(np.int64), digests.view(np.int64)
