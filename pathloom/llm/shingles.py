"""Word shingles as 64-bit hashes, and consistent weighted samples of weighted sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)  # odd


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Hashes windows of `width` words; a text of fewer words is one shingle, one without words none."""

    def __init__(self, width: int = 5):
        self.width = width

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The shingles of each text of a column without nulls, in the text's order. Each distinct word is hashed once."""
        if not len(texts):
            return []
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = split.flatten()
        filled = pc.greater(pc.binary_length(words), 0)
        ends = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        coded = words.filter(filled).dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
        h = np.concatenate([own[coded.indices.to_numpy()], np.zeros(self.width - 1, dtype=np.uint64)])
        n = len(h) - self.width + 1
        out = np.zeros(n, dtype=np.uint64)
        for k in range(self.width):
            out = (out ^ h[k : k + n]) * _MULTIPLIERS[k % 5] + np.uint64(k + 1)
        out = mixed(out)
        found = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= self.width or b == a:
                found.append(out[a : max(a, b - self.width + 1)])
            else:
                x = np.zeros(1, dtype=np.uint64)
                for k in range(self.width):
                    x = (x ^ (h[a + k] if a + k < b else np.uint64(0))) * _MULTIPLIERS[k % 5] + np.uint64(k + 1)
                found.append(mixed(x))
        return found

    def counted(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct shingles of each text, ascending, and how often each occurs."""
        return [np.unique(h, return_counts=True) if len(h) else (h, np.zeros(0, dtype=np.int64)) for h in self(texts)]


class WeightedSampler:
    """Improved consistent weighted sampling: for two weighted sets, each sample agrees with a probability of their weighted
    Jaccard similarity.

    For each sample and element, r and c follow Gamma(2, 1) and beta is uniform; they are drawn from tables of 2**16 values
    by bits of the element's hash. The element with the least ln c - r (floor(ln w / r + beta) - beta + 1) is chosen, with
    that floor.
    """

    def __init__(self, samples: int, seed: int = 7, chunk: int = 1 << 15):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.samples, self.chunk = samples, chunk
        self.seeds = rng.integers(1, 1 << 62, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        size = 1 << 16
        self.r = (-np.log(1 - rng.random(size)) - np.log(1 - rng.random(size))).astype(np.float32) + np.float32(1e-6)
        self.ln_c = np.log(-np.log(1 - rng.random(size)) - np.log(1 - rng.random(size)) + 1e-12).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)

    def __call__(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """sets: (elements, weights) each, none empty. A row of `samples` unsigned 32-bit values for each set."""
        out = np.zeros((len(sets), self.samples), dtype=np.uint32)
        a = 0
        while a < len(sets):
            b, n = a, 0
            while b < len(sets) and (b == a or n + len(sets[b][0]) <= self.chunk):
                n += len(sets[b][0])
                b += 1
            self._some(sets[a:b], out[a:b])
            a = b
        return out

    def _some(self, sets: list, out: np.ndarray) -> None:
        sizes = np.array([len(s[0]) for s in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        element = np.concatenate([s[0] for s in sets])
        ln_w = np.log(np.concatenate([s[1] for s in sets])).astype(np.float32)
        owner = np.repeat(np.arange(len(sets)), sizes)
        low = np.uint64(0xFFFF)
        for k in range(self.samples):
            x = element * self.seeds[k]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            r = self.r[(x & low).astype(np.int64)]
            beta = self.beta[((x >> np.uint64(16)) & low).astype(np.int64)]
            t = np.floor(ln_w / r + beta)
            value = self.ln_c[((x >> np.uint64(32)) & low).astype(np.int64)] - r * (t - beta + 1)
            best = np.minimum.reduceat(value, starts)
            at = np.flatnonzero(value == best[owner])[::-1]
            chosen = np.zeros(len(sets), dtype=np.int64)
            chosen[owner[at]] = at
            picked = mixed(element[chosen] ^ (t[chosen].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            out[:, k] = (picked >> np.uint64(32)).astype(np.uint32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets whose elements ascend."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    either = float(a[1].sum() + b[1].sum()) - both
    return both / either if either > 0 else 0.0
