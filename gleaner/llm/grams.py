"""Words of Arrow text columns and Karp-Rabin fingerprints of runs of them, in numpy.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D.  Its hash takes it in eight bytes
at a time, scrambled after each; long words are hashed by BLAKE2.  A fingerprint of a run of words is a polynomial of
their hashes over the prime field of 2^61 - 1, mixed at the end; prefix sums give that of any
run in constant time.  A field has no values that are zero for some sequences by construction, as
the ring of 64-bit integers has for Thue-Morse words.

Equal fingerprints stand for equal runs where few are compared.  Where runs of a whole corpus are, the
polynomials of two bases make pairs of 122 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # text handled at once; a longer document makes a slice of its own
LONG_WORD = 64  # bytes from which a word is hashed by itself
U = np.uint64
PRIME = (1 << 61) - 1
_P, _LOW, _ODD = U(PRIME), U((1 << 32) - 1), 0x9E3779B97F4A7C15
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo the prime."""
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 30 and 31 bits."""
    half = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & half, b >> U(31), b & half
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << U(1)) + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << U(31)) + a0 * b0)


def _added(x: np.ndarray) -> np.ndarray:
    """Running sums modulo the prime, of values below it."""
    high, low = _reduced(np.cumsum(x >> U(32))), _reduced(np.cumsum(x & _LOW))
    return _reduced((((high << U(32)) & _P) | (high >> U(29))) + low)


# The bases of two families of fingerprints.
BASES = tuple(int(b) % PRIME for b in mix(np.array([_ODD, 3 * _ODD % 2**64], U)).tolist())
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a family's base and of its inverse."""
    if family not in _powers or len(_powers[family][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        both = []
        for base in (BASES[family], pow(BASES[family], -1, PRIME)):
            out = np.ones(1, U)
            while len(out) < size:
                out = np.concatenate([out, times(out, U(pow(base, len(out), PRIME)))])
            both.append(out)
        _powers[family] = tuple(both)
    ups, downs = _powers[family]
    return ups[:n], downs[:n]


class Runs:
    """Fingerprints of runs of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, family: int = 0):
        ups, self.downs = powers(len(values) + 1, family)
        self.sums = np.zeros(len(values) + 1, U)
        self.sums[1:] = _added(times(_reduced(values), ups[:-1]))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(times(_reduced(self.sums[ends] + (_P - self.sums[starts])), self.downs[starts]) + U(0x5851F42D4C957F2D))

    def windows(self, length: int) -> np.ndarray:
        """Of each run of that length, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, U)
        return mix(times(_reduced(self.sums[length:] + (_P - self.sums[:n])), self.downs[:n]) + U(0x5851F42D4C957F2D))


class Buckets:
    """Hashes of short runs, where a collision does no more than share a weight or bring rows together that are then told apart.

    Polynomials over the ring of 64-bit integers: quicker than Runs, but never proof of equal runs.
    """

    _known: dict[str, np.ndarray] = {}

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        if len(self._known.get("ups", ())) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("ups", _ODD), ("downs", pow(_ODD, -1, 1 << 64))):
                steps = np.full(size, base, U)
                steps[0] = 1
                self._known[name] = np.multiply.accumulate(steps)
        self.downs = self._known["downs"][:n]
        self.sums = np.zeros(n, U)
        np.cumsum(values * self._known["ups"][:n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.downs[starts] + U(0x5851F42D4C957F2D))

    def windows(self, length: int) -> np.ndarray:
        """Of each run of that length, by start."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * self.downs[:n] + U(0x5851F42D4C957F2D))


BYTES = mix(np.arange(1, 257, dtype=U) * U(_ODD))  # what stands for a byte in Buckets
FOLDED = BYTES[_FOLD]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span; spans of up to eight bytes and one length never share one."""
    lengths = ends - starts
    out = mix(lengths.astype(U) + U(1))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = np.flatnonzero(lengths < LONG_WORD)
    lane = 0
    while len(left):
        rest = lengths[left] - lane
        out[left] = mix(out[left] ^ (eights[starts[left] + lane] & _MASKS[np.minimum(rest, 8)]))
        lane += 8
        left = left[rest > 8]
    for i in np.flatnonzero(lengths >= LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def equal_spans(left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether byte spans, given as (data, starts, ends), hold the same bytes pair by pair."""
    sides = []
    for data, starts, ends in (left, right):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[:len(data)] = data
        sides.append((np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)), starts))
    lengths = left[2] - left[1]
    out = lengths == right[2] - right[1]
    at, lane = np.flatnonzero(out), 0
    while len(at):
        rest = lengths[at] - lane
        one, two = (eights[starts[at] + lane] & _MASKS[np.minimum(rest, 8)] for eights, starts in sides)
        out[at[one != two]] = False
        lane += 8
        at = at[(rest > 8) & (one == two)]
    return out


class Slice:
    """The words of some whole texts: byte spans, hashes and where each text's words begin.

    With fold, A-Z are a-z in the bytes as well.  gaps, if given, tells by byte value what stands between words instead of white space.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False, gaps: np.ndarray | None = None):
        self.data, self.offsets = _FOLD[data] if fold else data, offsets
        word = np.ones(len(data) + 2, bool)
        word[0] = word[-1] = False
        word[1:-1] = (data != 32) & ((data - np.uint8(9)) > 4) if gaps is None else ~gaps[data]
        inner = np.zeros(len(data) + 1, bool)  # a text starts here, so a word ends before it
        inner[offsets] = True
        self.starts = np.flatnonzero(word[1:] & (~word[:-1] | inner))
        self.ends = np.flatnonzero(word[:-1] & (~word[1:] | inner))
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = hash_words(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, i: int) -> np.ndarray:
        """Hashes of text i's words."""
        return self.hashes[self.first[i]:self.first[i + 1]]

    def spans(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of text i's words within the text."""
        part = slice(self.first[i], self.first[i + 1])
        return self.starts[part] - self.offsets[i], self.ends[part] - self.offsets[i]

    def run_prints(self, length: int) -> list[np.ndarray]:
        """Each text's fingerprints of its runs of so many words; a text of fewer words has none."""
        prints = Runs(self.hashes).windows(length)
        return [prints[a:max(a, b - length + 1)] for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(at, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, fold: bool = False, gaps: np.ndarray | None = None,
           size: int = SLICE_BYTES) -> Iterator[tuple[int, Slice]]:
    """Consecutive slices of whole texts, each with its first row."""
    data, offsets = text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        part = offsets[row:end + 1]
        yield row, Slice(data[part[0]:part[-1]], part - part[0], fold, gaps)
        row = end


def signed(x: np.ndarray) -> pa.Array:
    """Fingerprints as a column of longs."""
    return pa.array(x.view(np.int64))
