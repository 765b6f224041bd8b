"""Token ids of runs of text that a worker has met before."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Runs remembered, and their ids; beyond either the memory starts anew.  About 90 MB in all.
REMEMBERED, IDS = 1 << 21, 1 << 23
#: Runs that wait in a small table before they join the large one.
SMALL = 1 << 17

_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))


def _merged(a: tuple, b: tuple) -> tuple:
    at = np.searchsorted(a[0], b[0])
    return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))


class Runs:
    """Two sorted tables of run hashes, and one growing array of ids.

    A run is known if both its hashes are, which have nothing in common but its bytes.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.large, self.small, self.flat, self.used = _NONE, _NONE, np.zeros(1 << 16, np.uint32), 0

    def ids(self, keys: np.ndarray, checks: np.ndarray, encode: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct runs, in the order of their first hashes: an array of ids, and where in it those of each run begin and how many they are.

        encode(which): ids and lengths of the runs that aren't known, by their places in ``keys``.
        """
        if len(self.large[0]) + len(self.small[0]) > REMEMBERED or self.used > IDS:
            self.clear()
        starts, lens, new = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        for k, c, s, n in (self.large, self.small):
            if len(k):
                at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
                hit = (k[at] == keys) & (c[at] == checks)
                starts[hit], lens[hit] = s[at[hit]], n[at[hit]]
                new &= ~hit
        which = np.flatnonzero(new)
        if len(which):
            ids, own = encode(which)
            stop = self.used + len(ids)
            if stop > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * stop - self.used, np.uint32)])
            self.flat[self.used : stop] = ids
            starts[which], lens[which] = self.used + np.cumsum(own) - own, own
            self.used = stop
            self.small = _merged(self.small, (keys[which], checks[which], starts[which].astype(np.int32), lens[which].astype(np.int32)))
            if len(self.small[0]) > SMALL:
                self.large, self.small = _merged(self.large, self.small), _NONE
        return self.flat, starts, lens
