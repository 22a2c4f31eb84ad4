"""Hashed word shingles of texts, MinHash samples and odd sketches, in numpy."""

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK = 1 << 18
_rng = np.random.default_rng(20240607)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finisher of a well-known hash function)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power_tables(n: int):
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        _powers = tuple(np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(
            np.full(size - 1, step, dtype=np.uint64), dtype=np.uint64)])
            for step in (_STEP, _STEP_INVERSE))
    return _powers


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of every word (run without ASCII white space) of lower-cased bytes."""
    parts, at = [], 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):  # cut at white space, wherever the next one is
            rest = np.frombuffer(data, dtype=np.uint8, offset=end)
            for low in range(0, len(rest), CHUNK):
                hits = np.flatnonzero(SPACE[rest[low:low + CHUNK]])
                if len(hits):
                    end += low + int(hits[0])
                    break
            else:
                end = len(data)
        parts.append(_words_of(np.frombuffer(data[at:end], dtype=np.uint8)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def _words_of(text: np.ndarray) -> np.ndarray:
    space = SPACE[text]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(text))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64),
                           np.cumsum(_BYTES[text] * power[:len(text)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * inverse[starts]
               + (ends - starts).astype(np.uint64) * _FOLD)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words.

    Upper-case ASCII letters count as lower-case. With fewer words the whole sequence is the
    only shingle; without words the set is empty.
    """
    words = word_hashes(text.encode("utf-8", "replace").lower()) if text else ()
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    run = min(width, len(words))
    folded = np.full(len(words) - run + 1, np.uint64(run), dtype=np.uint64)
    for k in range(run):
        folded = folded * _FOLD + words[k:len(words) - run + 1 + k]
    return np.unique(mix(folded))


class Sketcher:
    """MinHash samples of a shingle set, as keys of bands and an odd sketch of parities."""

    def __init__(self, bands: int, rows: int, bits: int, block: int = 4096):
        self.bands, self.rows, self.bits, self.block = bands, rows, bits, block
        rng = np.random.default_rng(7)
        self.factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) \
            + np.uint64(1)
        self.order = np.arange(1, bands * rows + 1, dtype=np.uint64) * _STEP
        self.band = np.arange(1, bands + 1, dtype=np.uint64) * _FOLD

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.factors), np.uint64(2**64 - 1), dtype=np.uint64)
        for at in range(0, len(shingles), self.block):
            part = shingles[at:at + self.block, None] * self.factors
            low = np.minimum(low, (part ^ (part >> np.uint64(29))).min(axis=0))
        return low

    def sketch(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the bands, and the parity bitmap, as signed 64-bit numbers."""
        low = self.minima(shingles)
        keys = self.band.copy()
        for k in range(self.rows):
            keys = mix(keys * _FOLD + low[k::self.rows])
        flips = np.bincount((mix(low + self.order) % np.uint64(self.bits)).astype(np.int64),
                            minlength=self.bits) & 1
        parity = np.packbits(flips.astype(np.uint8)).view(np.int64)
        return keys.view(np.int64), parity


def most_odd_bits(samples: int, bits: int, similarity: float) -> int:
    """Most differing parity bits to expect of a pair with at least ``similarity``.

    The number of differing samples is binomial, each flips a random bit on both sides; four
    and a half deviations of the one and three of the other are granted, so that a pair at the
    threshold is turned away less than once in 100,000.
    """
    mean = samples * (1 - similarity)
    differing = mean + 4.5 * (mean * similarity) ** 0.5
    odd = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differing))
    return int(odd + 3 * (odd * (1 - odd / bits)) ** 0.5)
