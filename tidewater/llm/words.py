"""Words and shingles of whole texts as 64-bit hashes, by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 1 << 18  # bytes hashed at once
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(11)
_LETTERS = _rng.integers(1, 2**63, 256, dtype=np.uint64)[LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of a text, A-Z lower-cased: runs of other bytes than blanks.

    A word's hash adds up mixed numbers of each letter and its place in the word, so a text of any
    length, or a word longer than a window, is taken window by window.
    """
    data, starts, sums, sizes, open_at = np.frombuffer(raw, np.uint8), [], [], [], -1
    for at in range(0, len(data), WINDOW):
        window = data[at : at + WINDOW]
        solid = ~BLANKS[window]
        edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        if not len(edges):
            open_at = -1
            continue
        begins, ends = edges[::2] + at, edges[1::2] + at
        goes_on = int(open_at >= 0 and begins[0] == at)  # how many words began before this window
        if goes_on:
            begins[0] = open_at
        within = edges[1::2] - edges[::2]
        places = np.flatnonzero(solid)
        own = mix(_LETTERS[window[places]] + (places + at - np.repeat(begins, within)).astype(np.uint64) * _STEP)
        totals = np.add.reduceat(own, np.cumsum(within) - within)
        if goes_on:
            sums[-1][-1:] += totals[:1]
            sizes[-1][-1:] += within[:1].astype(np.uint64)
        starts.append(begins[goes_on:])
        sums.append(totals[goes_on:])
        sizes.append(within[goes_on:].astype(np.uint64))
        open_at = int(begins[-1]) if solid[-1] else -1
        if not len(starts[-1]):
            for held in (starts, sums, sizes):
                held.pop()
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), mix(np.concatenate(sums) + np.concatenate(sizes) * _PLACES[0])


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted set of its hashed k-word shingles; fewer words make one shingle, none an empty set."""
    texts = [t or b"" for t in texts]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    starts, words = word_hashes(b"\n".join(texts))
    counts = np.diff(np.searchsorted(starts, begins))
    n = max(0, len(words) - k + 1)
    shingles = np.zeros(n, np.uint64)
    for i in range(k):
        shingles = mix(shingles + words[i : i + n] * _PLACES[i % len(_PLACES)] + np.uint64(i + 1))
    at = 0
    for count in counts.tolist():
        if count >= k:
            yield np.unique(shingles[at : at + count - k + 1])
        elif count:
            own = np.array([count], np.uint64)
            for i in range(at, at + count):
                own = mix(own * _PLACES[4] + words[i : i + 1])
            yield own
        else:
            yield np.zeros(0, np.uint64)
        at += count


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, and of few megabytes unless a single row is larger."""
    for batch in batches:
        step = rows
        while step > 1 and batch.nbytes // max(1, batch.num_rows) * step > most:
            step //= 2
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)
        pa.default_memory_pool().release_unused()  # workers live on, beside others on their machine


def raw_texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()
