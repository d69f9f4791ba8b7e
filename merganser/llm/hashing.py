"""Vectorised identities and 64-bit hashes of tokens and shingles over whole batches of texts.

``distinct`` decides by bytes which slices of a batch are equal: slices of up to seven bytes are one number each, together
with their length; longer ones are told apart by their hashes, and what looks equal is compared. A token's hash doesn't
depend on where it stands: a bijection of that number; a keyed chain of bijections of eight bytes at a time, each mixed in
full before the next; and beyond LONG bytes the keyed BLAKE2b. No Python loop runs over tokens of ordinary length.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
#: Slices of more bytes are looked up and hashed one by one.
LONG = 64
_KEY = b"merganser tokens"
_SALT = U(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator: every bit of the result depends on every bit of h."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def classes(space: bytes, *others: bytes) -> np.ndarray:
    """A table of byte classes: 0 for ``space``, 2, 3, ... for the others, 1 for the rest."""
    table = np.ones(256, np.uint8)
    for k, chars in enumerate((space, *others)):
        table[list(chars)] = k + 1 if k else 0
    return table


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number; behind the end there are zeros."""
    padded = np.concatenate([np.ascontiguousarray(data), np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _lane(lanes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of slices that have more than 8 * k, zeros behind their ends."""
    return lanes[starts + 8 * k] & _KEEP[np.minimum(sizes - 8 * k, 8)]


def _chained(lanes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: int = 0) -> np.ndarray:
    """Hashes of slices of 8 to LONG bytes."""
    h = mix(_lane(lanes, starts, sizes, 0) ^ (sizes.astype(U) * _SALT) ^ U(key))
    more, k = np.flatnonzero(sizes > 8), 1
    while len(more):
        h[more] = mix(h[more] * U(0xD1342543DE82EF95) + _lane(lanes, starts[more], sizes[more], k))
        k += 1
        more = more[sizes[more] > 8 * k]
    return h


def _distinct_middle(lanes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Codes of slices of 8 to LONG bytes, equal where the bytes are equal, by a comparison with each code's first slice."""
    import pandas as pd

    h = _chained(lanes, starts, sizes)
    codes, _ = pd.factorize(h)
    like = np.unique(codes, return_index=True)[1][codes]
    if not equal_slices(data, starts, sizes, data, starts[like], sizes[like]).all():  # unequal bytes of one hash
        seen: dict[bytes, int] = {}
        codes = np.array([seen.setdefault(data[s : s + n].tobytes(), len(seen)) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
    return codes


def equal_slices(a: np.ndarray, a_starts: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Whether each slice of a has the bytes of the slice of b in the same row."""
    same = a_sizes == b_sizes
    for i in np.flatnonzero(same & (a_sizes > LONG)).tolist():
        n = int(a_sizes[i])
        same[i] = np.array_equal(a[a_starts[i] : a_starts[i] + n], b[b_starts[i] : b_starts[i] + n])
    a_lanes, b_lanes = _lanes(a), _lanes(b)
    more, k = np.flatnonzero(same & (a_sizes <= LONG) & (a_sizes > 0)), 0
    while len(more):
        same[more] = _lane(a_lanes, a_starts[more], a_sizes[more], k) == _lane(b_lanes, b_starts[more], b_sizes[more], k)
        k += 1
        more = more[same[more] & (a_sizes[more] > 8 * k)]
    return same


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each slice data[start:end], an index of one slice of each code); codes are equal just where the bytes are."""
    import pandas as pd

    starts, sizes = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
    lanes = _lanes(data)
    codes = np.empty(len(starts), np.int64)
    short, long = sizes < 8, sizes > LONG
    middle = ~short & ~long
    codes[short], found = pd.factorize(_lane(lanes, starts[short], sizes[short], 0) | (sizes[short].astype(U) << U(56)))
    n = len(found)
    if middle.any():
        own = _distinct_middle(lanes, data, starts[middle], sizes[middle])
        codes[middle] = own + n
        n += int(own.max()) + 1
    if long.any():
        seen: dict[bytes, int] = {}
        codes[long] = [seen.setdefault(data[s : s + m].tobytes(), n + len(seen)) for s, m in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
        n += len(seen)
    where = np.zeros(n, np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, where


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """Hashes of data[start:end] for each pair, in order; equal bytes hash equal wherever they stand.

    Whoever knows the key (64 bits) can find texts whose hashes collide; one that is drawn for each run is known to nobody.
    """
    starts, sizes = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
    lanes, out = _lanes(data), np.empty(len(starts), U)
    short, long = sizes < 8, sizes > LONG
    middle = ~short & ~long
    out[short] = mix((_lane(lanes, starts[short], sizes[short], 0) | (sizes[short].astype(U) << U(56))) ^ _SALT ^ U(key))
    out[middle] = _chained(lanes, starts[middle], sizes[middle], key)
    if long.any():
        digests = [blake2b(data[s : s + n].tobytes(), digest_size=8, key=_KEY + key.to_bytes(8, "little")).digest() for s, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
        out[long] = np.frombuffer(b"".join(digests), "<u8")
    return out


def spans(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes; starts and ends of the runs of one class, class 0 aside, in order; and the number of runs before
    each text and in all.

    A line feed has to be of class 0: it separates the texts.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = table[data]
    at = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = np.concatenate([[0], at]), np.concatenate([at, [len(data)]])
    solid = kind[starts] != 0
    starts, ends = starts[solid], ends[solid]
    return data, starts, ends, np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))


def tokens(texts: list[bytes], table: np.ndarray, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs that spans() finds; and the number of runs before each text and in all."""
    data, starts, ends, bounds = spans(texts, table)
    return hash_slices(data, starts, ends, key), bounds


_STEP = 0xD1342543DE82EF95


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n tokens, wherever texts begin and end: one for each place where a run may start."""
    out = np.zeros(max(0, len(hashes) - n + 1), U)
    for k in range(n if len(out) else 0):
        out += hashes[k : len(hashes) - n + 1 + k] * U(pow(_STEP, k, 1 << 64))
    return mix(out + U(n))


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n tokens in each text, or of all its tokens if it has fewer; and bounds as in tokens()."""
    sizes = np.diff(bounds)
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(sizes.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(out_bounds[-1], U)
    long = sizes >= n
    every = runs(hashes, n)
    inside = np.zeros(len(every) + 1, np.int32)
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - n + 1, -1)
    whole = np.repeat(long, counts)
    out[whole] = every[np.cumsum(inside[:-1]) > 0]
    for i in np.flatnonzero((sizes > 0) & ~long):
        out[out_bounds[i]] = runs(hashes[bounds[i] : bounds[i + 1]], int(sizes[i]))[0]
    return out, out_bounds
