"""Compressed bitmaps of integers: by 65,536 neighbouring values one container, the smallest of three kinds."""

from __future__ import annotations

import numpy as np

SPAN = 1 << 16  # values of a container
_DENSE = SPAN // 8  # bytes of a plain one


class Container:
    """A set of values below SPAN: sorted ``values`` (2 bytes each), ``runs`` of (first, last) (4 bytes each) or plain ``bits``."""

    __slots__ = ("kind", "data")

    def __init__(self, kind: str, data: np.ndarray):
        self.kind, self.data = kind, data

    @classmethod
    def of(cls, values: np.ndarray) -> Container:
        """From sorted distinct values, in the form that takes the least room."""
        n = len(values)
        if not n:
            return cls("values", values.astype(np.uint16))
        ends = np.flatnonzero(np.diff(values) != 1)
        n_runs = len(ends) + 1
        if 4 * n_runs < min(2 * n, _DENSE):
            first = values[np.concatenate(([0], ends + 1))]
            last = values[np.concatenate((ends, [n - 1]))]
            return cls("runs", np.stack([first, last]).astype(np.uint16))
        if 2 * n < _DENSE:
            return cls("values", values.astype(np.uint16))
        return cls("bits", _bits_of(values))

    def values(self) -> np.ndarray:
        """The members in order."""
        if self.kind == "values":
            return self.data
        if self.kind == "bits":
            return np.flatnonzero(np.unpackbits(self.data, bitorder="little")).astype(np.uint16)
        first, last = self.data.astype(np.int64)
        size = last - first + 1
        return (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)).astype(np.uint16)

    def has(self, values: np.ndarray) -> np.ndarray:
        """Which of the sorted ``values`` are members."""
        if self.kind == "bits":
            return (self.data[values >> 3] >> (values & 7).astype(np.uint8) & 1).astype(bool)
        if not self.data.size:
            return np.zeros(len(values), bool)
        if self.kind == "values":
            at = np.searchsorted(self.data, values)
            return self.data[np.minimum(at, len(self.data) - 1)] == values
        at = np.searchsorted(self.data[0], values, side="right") - 1
        return (at >= 0) & (values <= self.data[1][np.maximum(at, 0)])

    def or_(self, other: Container) -> Container:
        if not other.data.size:
            return self
        if not self.data.size:
            return other
        if "bits" in (self.kind, other.kind):
            return Container("bits", self._dense() | other._dense())
        return Container.of(np.union1d(self.values(), other.values()))

    def and_not(self, other: Container) -> Container:
        """The members that ``other`` hasn't."""
        if self.kind == "bits" and other.kind == "bits":
            return Container("bits", self.data & ~other.data)
        mine = self.values()
        return Container.of(mine[~other.has(mine)])

    def _dense(self) -> np.ndarray:
        return self.data if self.kind == "bits" else _bits_of(self.values())


def _bits_of(values: np.ndarray) -> np.ndarray:
    flags = np.zeros(SPAN, np.uint8)
    flags[values] = 1
    return np.packbits(flags, bitorder="little")


NONE = Container("values", np.zeros(0, np.uint16))


def by_group(groups: np.ndarray, values: np.ndarray) -> dict[int, Container]:
    """One container for each of ``groups``, of the ``values`` beside it (below SPAN, in any order, repeats count once)."""
    order = np.lexsort((values, groups))
    g, v = groups[order], values[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    g, v = g[fresh], v[fresh]
    cuts = np.flatnonzero(np.diff(g)) + 1
    return {int(a[0]): Container.of(b) for a, b in zip(np.split(g, cuts), np.split(v, cuts), strict=True) if len(a)}
