"""Word shingles of texts as 64-bit hashes, and their MinHash values."""

from __future__ import annotations

import numpy as np

WORDS = 5
_ODD = 0x9E3779B97F4A7C15
#: Places of a word whose weights are read from one table; a further table has the weights of whole stretches of it.
_STRETCH = 1 << 12


def _table() -> np.ndarray:
    """Bytes of words: ASCII letters and digits, and all bytes of other characters."""
    held = np.zeros(256, dtype=bool)
    held[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    return held


_HELD = _table()
#: Bytes of words that only blanks part: all but 0x20 and 0x09 to 0x0D, which bytes.split() parts at too.
_FILLED = np.ones(256, dtype=bool)
_FILLED[[32, *range(9, 14)]] = False


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0, 1 .. n - 1, modulo 2^64."""
    out = np.ones(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, base, dtype=np.uint64), out=out[1:])
    return out


_POW = _powers(_ODD, _STRETCH)


def _weights(place: np.ndarray) -> np.ndarray:
    """_ODD to the power of each place: no two places of a word have one weight."""
    low = _POW[place % _STRETCH]
    stretches = int(place.max()) // _STRETCH
    if not stretches:
        return low
    with np.errstate(over="ignore"):
        return low * _powers(pow(_ODD, _STRETCH, 1 << 64), stretches + 1)[place // _STRETCH]


def word_hashes(text: str) -> np.ndarray:
    """A hash of every word: runs of letters, digits and non-ASCII characters, in lower case."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return _run_hashes(raw, _HELD[raw])


def blank_parted_hashes(text: bytes) -> np.ndarray:
    """A hash of every word of text.split(), in the text's own case."""
    raw = np.frombuffer(text, dtype=np.uint8)
    return _run_hashes(raw, _FILLED[raw])


def _run_hashes(raw: np.ndarray, held: np.ndarray) -> np.ndarray:
    """A hash of every run of held bytes."""
    if not held.any():
        return np.empty(0, dtype=np.uint64)
    edge = np.diff(held.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    at = np.flatnonzero(held)
    # held bytes only: where each word begins among them, and each byte's place in its word
    first = np.searchsorted(at, starts)
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        value = (raw[at].astype(np.uint64) + np.uint64(1)) * _weights(place)
        return _mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words; of all words together if there are
    fewer, and none if there is no word."""
    own = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    if not len(own):
        return own
    width = min(words, len(own))
    with np.errstate(over="ignore"):
        value = np.full(len(own) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            value = value * np.uint64(_ODD) + own[k : len(own) - width + 1 + k]
        value = _mix(value)
    return np.unique(value)


def parameters(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minhash(own: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 2048) -> np.ndarray:
    """The least value of each hash function over the set, 32 bits each."""
    low = np.full(len(a), 2**64 - 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), step):
            values = own[at : at + step, None] * a[None, :]
            values += b[None, :]
            np.minimum(low, values.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)
