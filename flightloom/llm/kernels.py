"""Numpy kernels that run inside Spark tasks, over the texts of one Arrow batch.

Every kernel works on chunks of whole documents, so that memory follows the
chunk and not the partition.  A chunk is the documents' UTF-8 bytes joined by a
line feed, with the documents' first and last offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (one longer document is a chunk of its own).
CHUNK_BYTES = 1_000_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads all bits of a 64-bit value."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random 64-bit value for each byte, and the same with A-Z folded onto a-z.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
BYTE_VALUES_FOLDED = BYTE_VALUES.copy()
BYTE_VALUES_FOLDED[65:91] = BYTE_VALUES[97:123]

#: The same for the polynomials modulo a prime.
BYTE_PRIMES = (mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95)) >> _U(33)) | _U(1)
BYTE_PRIMES_FOLDED = BYTE_PRIMES.copy()
BYTE_PRIMES_FOLDED[65:91] = BYTE_PRIMES[97:123]

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


class RollingHash:
    """64-bit hashes of any range of a sequence, equal ranges hashing equally wherever they stand."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _power("up", _BASE, n), out=self._sums[1:])
        self._down = _power("down", _INV, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[start]) * self._down[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of each run of k symbols, by its start."""
        n = len(self._sums) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix64((self._sums[k:] - self._sums[:n]) * self._down[:n])


_PRIME = _U((1 << 31) - 1)
_ROOTS = [1_340_861_203, 1_907_244_881]


def _prime_powers(base: int, n: int, name: str) -> np.ndarray:
    """base ** 0 .. n - 1 modulo the prime, by doubling; kept for chunks of the usual size."""
    have = _powers.get(name)
    if have is not None and len(have) >= n:
        return have[:n]
    size = max(n, CHUNK_BYTES + 4096)
    out = np.empty(size, dtype=np.uint32)
    out[0], done = 1, 1
    while done < size:
        more = min(done, size - done)
        out[done : done + more] = out[:more].astype(np.uint64) * _U(pow(base, done, int(_PRIME))) % _PRIME
        done += more
    if size <= 4 * CHUNK_BYTES:
        _powers[name] = out
    return out[:n]


def prime_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62 bits of hash of each range of symbols (below 2 ** 31), from two polynomials modulo a prime.

    A polynomial modulo 2 ** 64 alone takes a long Thue-Morse word and its complement
    for equal, whatever its base; modulo a prime they differ."""
    out = np.zeros(len(start), dtype=np.uint64)
    for k, root in enumerate(_ROOTS):
        up = _prime_powers(root, len(values), f"prime{k}")
        product = values * up
        product = (product & _PRIME) + (product >> _U(31))
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(product, out=sums[1:])
        back = _prime_powers(pow(root, -1, int(_PRIME)), len(values) + 1, f"back{k}")
        out = (out << _U(31)) | ((sums[end] - sums[start]) % _PRIME * back[start] % _PRIME)
    return out


class Chunk:
    """Some documents' bytes in one array, a line feed between documents."""

    def __init__(self, texts: list[bytes], first: int):
        self.first, self.n = first, len(texts)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=self.n)
        self.data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        self.start = np.zeros(self.n, dtype=np.int64)
        np.cumsum(lengths[:-1] + 1, out=self.start[1:])
        self.end = self.start + lengths
        self.texts = texts


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow string column (null: empty), cut between documents."""
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    at = 0
    while at < len(texts):
        till, size = at, 0
        while till < len(texts) and (till == at or size + len(texts[till]) <= limit):
            size += len(texts[till])
            till += 1
        yield Chunk(texts[at:till], at)
        at = till


def words(chunk: Chunk, folded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (two independent kinds mixed), the words' byte ranges, and for each document the number of its first word.

    The last array has one entry more than there are documents."""
    space = _SPACE[chunk.data]
    if not len(space):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, np.zeros(chunk.n + 1, dtype=np.int64)
    edge = np.diff(space.astype(np.int8))
    begin = np.flatnonzero(edge == -1) + 1
    stop = np.flatnonzero(edge == 1) + 1
    if not space[0]:
        begin = np.concatenate([[0], begin])
    if not space[-1]:
        stop = np.concatenate([stop, [len(space)]])
    table, primes = (BYTE_VALUES_FOLDED, BYTE_PRIMES_FOLDED) if folded else (BYTE_VALUES, BYTE_PRIMES)
    hashes = mix64(RollingHash(table[chunk.data])(begin, stop) + mix64(prime_hashes(primes[chunk.data], begin, stop)))
    first = np.searchsorted(begin, np.append(chunk.start, len(space) + 1))
    return hashes, begin, stop, first


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, size = values, 1
    while size * 2 <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return np.minimum(have[:n], have[width - size : width - size + n])


#: Packed minimum: 33 bits of hash above 31 bits of position (a text in Spark is shorter than 2 GB).
_POS_BITS = _U(31)
_POS_MASK = _U((1 << 31) - 1)


def anchored_windows(roll: RollingHash, n: int, doc_start: np.ndarray, doc_end: np.ndarray, window: int, gram: int):
    """Cuts all windows of `window` symbols into units of windows that share an anchor.

    The anchor of a window is its run of `gram` symbols with the smallest hash
    (leftmost of equals), so that equal windows have equal anchors at the same
    offset wherever they stand: to look for equal windows it is enough to compare
    units whose anchors are equal.  Returns, for each unit: document (number in
    the chunk), first window, anchor, number of windows, the anchor's hash, and a
    hash of all the unit's symbols with the anchor's place in it."""
    none = np.zeros(0, dtype=np.int64)
    hashes = roll.grams(gram)
    if n < window or not len(hashes):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    packed = (hashes >> _POS_BITS) << _POS_BITS
    packed |= np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(packed, window - gram + 1)
    starts = np.arange(len(least), dtype=np.int64)
    doc = np.searchsorted(doc_start, starts, side="right") - 1
    whole = starts + window <= doc_end[doc]
    starts, doc, anchor = starts[whole], doc[whole], (least[whole] & _POS_MASK).astype(np.int64)
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    first, anchor, doc = starts[at], anchor[at], doc[at]
    shape = mix64((anchor - first).astype(np.uint64) * _U(0x100000001B3) + count.astype(np.uint64))
    return doc, first, anchor, count, hashes[anchor], mix64(roll(first, first + count - 1 + window) ^ shape)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
