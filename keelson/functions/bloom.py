"""Bloom filters with double hashing, over whole sets and per 2 KB of data offset."""

from __future__ import annotations

from dataclasses import dataclass

from .hashes import bloom_hash


@dataclass(frozen=True)
class Bloom:
    """`bits` per key; k = 0.69 * bits probes, from 1 to 30; 64 bits at least."""

    bits_per_key: int = 10

    @property
    def probes(self) -> int:
        return min(30, max(1, int(self.bits_per_key * 0.69)))

    def create(self, keys: list[bytes]) -> bytes:
        size = -(-max(64, len(keys) * self.bits_per_key) // 8)
        out = bytearray(size + 1)
        out[size] = self.probes
        for key in keys:
            for bit in self._places(key, size * 8, self.probes):
                out[bit // 8] |= 1 << bit % 8
        return bytes(out)

    @staticmethod
    def _places(key: bytes, bits: int, probes: int):
        h = bloom_hash(key)
        step = (h >> 17 | h << 15) & 0xFFFFFFFF
        for _ in range(probes):
            yield h % bits
            h = (h + step) & 0xFFFFFFFF

    def may_match(self, key: bytes, filter_: bytes) -> bool:
        """False only if the key was not among those of create()."""
        if len(filter_) < 2:
            return False
        probes = filter_[-1]
        if probes > 30:  # kept for other encodings: matches
            return True
        return all(filter_[bit // 8] >> bit % 8 & 1 for bit in self._places(key, (len(filter_) - 1) * 8, probes))


class FilterBlock:
    """A filter for each 2 KB range of data offsets; an offset beyond the last may match, an empty range doesn't."""

    BASE_LG = 11

    def __init__(self, blocks: dict[int, list[bytes]], policy: Bloom | None = None):
        """`blocks`: keys by the offset of their data block."""
        self.policy = policy or Bloom()
        ranges: dict[int, list[bytes]] = {}
        for offset, keys in blocks.items():
            ranges.setdefault(offset >> self.BASE_LG, []).extend(keys)
        self.filters = [self.policy.create(ranges[i]) if i in ranges else b"" for i in range(max(ranges, default=-1) + 1)]

    def may_match(self, offset: int, key: bytes) -> bool:
        i = offset >> self.BASE_LG
        return True if i >= len(self.filters) else self.policy.may_match(key, self.filters[i])
