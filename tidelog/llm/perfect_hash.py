"""Minimal perfect hashes of byte strings, by levels of collision-free cells."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash

#: Cells of a level for each key that is left.
CELLS = 2
#: Levels after which the few keys left (equal hashes never part) are listed.
LEVELS = 40


def hashes(keys: list[bytes]) -> np.ndarray:
    """XXH64 with seed 42, as Spark's xxhash64 has it."""
    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))


def _cells(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """Cells of hashes on a level: another mix of the same bits on each."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys; ``levels`` hold a bit for each cell that one key alone fell into."""

    levels: list[bytes]
    keys: list[bytes]  # by slot
    _cells_of: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list, repr=False)
    _rest: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        used = 0
        for data in self.levels:
            bits = np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
            self._cells_of.append((bits, used + np.cumsum(bits) - 1))
            used += int(bits.sum())
        self._rest = {k: i for i, k in enumerate(self.keys[used:], used)}

    @staticmethod
    def build(keys: list[bytes]) -> "PerfectHash":
        h, left = hashes(keys), np.arange(len(keys))
        levels, slots = [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = (CELLS * len(left) + 7) // 8 * 8
            cells = _cells(h[left], level, size)
            alone = np.bincount(cells, minlength=size) == 1
            placed = alone[cells]
            slots += left[placed][np.argsort(cells[placed])].tolist()
            levels.append(np.packbits(alone).tobytes())
            left = left[~placed]
        return PerfectHash(levels, [keys[i] for i in [*slots, *left.tolist()]])

    def slots(self, keys: list[bytes], h: np.ndarray) -> np.ndarray:
        """The slot of each key with hash ``h``, -1 where the key stored there is another."""
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (bits, rank) in enumerate(self._cells_of):
            cells = _cells(h[left], level, len(bits))
            hit = bits[cells]
            out[left[hit]] = rank[cells[hit]]
            left = left[~hit]
        if self._rest:
            for i in left.tolist():
                out[i] = self._rest.get(keys[i], -1)
        same = np.fromiter((s >= 0 and self.keys[s] == k for s, k in zip(out.tolist(), keys)), bool, len(keys))
        return np.where(same, out, -1)
