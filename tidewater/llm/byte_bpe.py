"""Byte-level BPE encoding and decoding with padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewater.llm.unicode import Splitter
from tidewater.llm.words import slices

NONE = np.int32(2**31 - 1)  # the rank of a pair that doesn't merge
LONG = 256  # longer pieces get no row of a matrix: they are merged by themselves
CHARS = 1 << 20  # characters of text that are split before their new units are encoded
CACHED = 500_000  # units of at most LONG characters that a worker remembers
BLOCK = 1 << 18  # tokens that are put together at once
# Fixed value: a pattern of which no match goes on from something else than a blank into a blank.
PARTED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GAP = re.compile(r" (?<=\S )")  # a blank after something else; all that libraries take for blanks is one here


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of an array, one after another."""
    out, at = np.empty(counts.sum(), flat.dtype), 0
    for k in range(0, len(starts), BLOCK):
        own = counts[k : k + BLOCK]
        ends = np.cumsum(own)
        out[at : at + ends[-1]] = flat[np.repeat(starts[k : k + BLOCK] - ends + own, own) + np.arange(ends[-1])]
        at += ends[-1]
    return out


class PairTable:
    """Open-addressing hash table from a pair of token ids to the rank of their concatenation."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, room: int = 0):
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(left), room)))))
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        self.add(left, right, rank)

    def add(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        """Different pairs that aren't there yet; there must be room for them."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = waiting[self.keys[slot[waiting]] == -1]
            taken, first = np.unique(slot[free], return_index=True)
            self.keys[taken], self.ranks[taken] = keys[free[first]], rank[free[first]]
            waiting = waiting[self.keys[slot[waiting]] != keys[waiting]]
            slot[waiting] = (slot[waiting] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of one-dimensional arrays; NONE where an id is negative or the pair doesn't merge."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(len(keys), NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys, slot = keys[at], self._slot(keys[at])
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            out[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != -1)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class ByteBpe:
    """A vocabulary of byte strings with ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = array("i")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None:
                    pairs.extend((left, right, rank))
        self.pairs = PairTable(*np.frombuffer(pairs, np.int32).reshape(-1, 3).T)
        self.byte_pairs = self.pairs.lookup(np.repeat(self.first, 256), np.tile(self.first, 256))

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of every piece: the piece itself if it is a token, else the merges of its bytes."""
        flat, starts, counts = self.encode_runs(pieces)
        return [flat[k : k + n].tolist() for k, n in zip(starts, counts)]

    def encode_runs(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same as runs of one array: the array, where each piece's run begins, and its length."""
        get = self.ranks.get
        sizes, whole = np.array([len(p) for p in pieces], np.int64), np.array([get(p, -1) for p in pieces], np.int32)
        rows = np.flatnonzero(whole >= 0)
        runs = [(rows, np.ones(len(rows), np.int64), whole[rows])]
        for i in np.flatnonzero((whole < 0) & (sizes > LONG)).tolist():
            own = self._encode_long(pieces[i])
            runs.append((np.array([i]), np.array([len(own)]), own))
        rows = np.flatnonzero((whole < 0) & (sizes > 0) & (sizes <= LONG))
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        for k in range(0, len(rows), 8192):
            runs += self._encode_rows(rows[k : k + 8192], pieces)
        starts, counts = np.zeros((2, len(pieces)), np.int64)
        rows, lengths, flat = map(np.concatenate, zip(*runs))
        starts[rows], counts[rows] = np.cumsum(lengths) - lengths, lengths
        return flat, starts, counts

    def _encode_rows(self, row: np.ndarray, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        width = len(pieces[row[-1]])
        padded = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in row.tolist()]), np.uint8).reshape(len(row), width)
        within = np.arange(width) < np.array([len(pieces[i]) for i in row.tolist()])[:, None]
        ids = np.where(within, self.first[padded], np.int32(-1))
        ranks = np.full(ids.shape, NONE)  # of each id and the next one
        ranks[:, :-1] = np.where(within[:, 1:], self.byte_pairs[padded[:, :-1].astype(np.int32) * 256 + padded[:, 1:]], NONE)
        while len(ids):
            place = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(ids)), place]
            ended = best == NONE
            if ended.any():
                done = ids[ended]
                yield row[ended], (done >= 0).sum(axis=1), done[done >= 0]
                ids, ranks, row, place, best = ids[~ended], ranks[~ended], row[~ended], place[~ended], best[~ended]
                if not len(ids):
                    return
                used = (ids >= 0).any(axis=0).sum()
                ids, ranks = ids[:, :used], ranks[:, :used]
            at, width = np.arange(len(ids)), ids.shape[1] - 1
            ids[at, place] = best
            keep = np.ones(ids.shape, bool)
            keep[at, place + 1] = False
            ids, ranks = ids[keep].reshape(-1, width), ranks[keep].reshape(-1, width)  # every row closes up by one
            before = np.where(place > 0, ids[at, place - 1], np.int32(-1))
            after = np.where(place + 1 < width, ids[at, np.minimum(place + 1, width - 1)], np.int32(-1))
            found = self.pairs.lookup(np.concatenate([before, best]), np.concatenate([best, after]))  # only these are new
            ranks[at, place] = found[len(at) :]
            ranks[at[place > 0], place[place > 0] - 1] = found[: len(at)][place > 0]

    def _encode_long(self, piece: bytes) -> np.ndarray:
        """One long piece: all places of the least rank that don't overlap merge in one round.

        That equals merging them one after another from the left unless a merge makes a pair of
        a still smaller rank; then only the leftmost is merged in that round.
        """
        ids = self.first[np.frombuffer(piece, np.uint8)].copy()
        ranks = self.pairs.lookup(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            places = np.flatnonzero(ranks == best)
            if (np.diff(places) == 1).any():
                apart, last = [], -2
                for p in places.tolist():
                    if p > last + 1:
                        apart.append(p)
                        last = p
                places = np.array(apart)
            for chosen in (places, places[:1]):
                keep = np.ones(len(ids), bool)
                keep[chosen + 1] = False
                merged = ids.copy()
                merged[chosen] = best
                merged, kept_ranks = merged[keep], np.append(ranks, NONE)[keep][:-1]
                here = chosen - np.arange(len(chosen))
                around = np.unique(np.concatenate([here - 1, here]))
                around = around[(around >= 0) & (around < len(merged) - 1)]
                kept_ranks[around] = self.pairs.lookup(merged[around], merged[around + 1])
                # between two merges side by side the first one's new pair stands for a moment
                passing = chosen[chosen + 2 < len(ids)]
                passing = self.pairs.lookup(np.full(len(passing), best), ids[passing + 2])
                if len(chosen) == 1 or min(kept_ranks[around].min(initial=NONE), passing.min(initial=NONE)) > best:
                    break
            ids, ranks = merged, kept_ranks
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


Unit = str | tuple[str]  # what follows a gap; (it,) if it begins a text, or is a match of a pattern that isn't known


class UnitEncoder:
    """Encodes texts unit by unit, and remembers units.

    With the pattern ``PARTED`` a match ends before every blank that follows something else, and what
    a match holds depends on nothing before it: so a text may be parted there, and the matches of its
    units, taken one after another, are its matches.  With other patterns the matches are the units.
    """

    def __init__(self, raw: bytes, pattern: str):
        self.bpe, self.split, self.parted = ByteBpe(read_ranks(raw)), Splitter(pattern), pattern == PARTED
        tokens = [self.bpe.bytes_of.get(rank, b"") for rank in range(max(self.bpe.bytes_of) + 1)]
        self.bytes, self.n_bytes = np.frombuffer(b"".join(tokens), np.uint8), np.array(list(map(len, tokens)), np.int64)
        self.bytes_at = np.cumsum(self.n_bytes) - self.n_bytes
        width = len(b"%d," % len(tokens))
        self.decimals = np.frombuffer(b"".join([(b"%d," % k).ljust(width, b"\0") for k in range(len(tokens))]), np.uint8).reshape(-1, width)
        self.n_decimals = (self.decimals > 0).sum(axis=1)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[Unit, int] = {}  # numbers of runs
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def units(self, text: str) -> list[Unit]:
        if not text:
            return []
        if not self.parted:
            return [(piece,) for piece in self.split.findall(text)]
        own: list[Unit] = _GAP.split(text)
        own[0] = (own[0],)
        return own

    def _pieces(self, units: list[Unit]) -> tuple[list[Unit], list[str], np.ndarray]:
        """The units in another order, their matches, and which match is the first of each."""
        plain = [u for u in units if isinstance(u, str) and u and not u[-1].isspace()]
        pieces = self.split.findall(" " + " ".join(plain)) if plain else []  # a gap lies before each
        begins = np.cumsum([0, *map(len, pieces)])
        first = [np.searchsorted(begins, np.cumsum([0, *[len(u) + 1 for u in plain]])[:-1])]
        others = list(set(units).difference(plain))
        for u in others:
            first.append([len(pieces)])
            pieces += [u[0]] if not self.parted else self.split.findall(u[0] if isinstance(u, tuple) else " " + u)
        return plain + others, pieces, np.concatenate(first)

    def _learn(self, units: list[Unit]) -> None:
        units, pieces, first = self._pieces(units)
        number = dict(zip(set(pieces), range(len(pieces))))
        which = np.array([number[p] for p in pieces])
        flat, starts, counts = self.bpe.encode_runs([p.encode() for p in number])
        counts = counts[which]
        self.known.update(zip(units, range(len(self.starts), len(self.starts) + len(units))))
        own = np.add.reduceat(counts, first)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(own) - own])
        self.counts = np.concatenate([self.counts, own])
        self.ids = np.concatenate([self.ids, gather(flat, starts[which], counts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has."""
        if len(self.known) > CACHED or len(self.ids) > 8 * CACHED:
            self._forget()
        units = [self.units(text) for text in texts]
        if new := list(set().union(*units).difference(self.known)):
            self._learn(new)
        sizes = np.array(list(map(len, units)))
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, sizes.sum())
        for unit in new:
            if len(unit[0] if isinstance(unit, tuple) else unit) > LONG:
                del self.known[unit]
        counts = self.counts[numbers]
        ends = np.cumsum(sizes)
        return gather(self.ids, self.starts[numbers], counts), np.diff(np.append(0, np.cumsum(counts))[ends], prepend=0)

    def in_decimals(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in decimals, each with a comma behind it."""
        rows = [self.decimals[ids[k : k + BLOCK]] for k in range(0, len(ids), BLOCK)]
        return np.concatenate([r[r > 0] for r in rows]) if rows else self.decimals[:0].ravel()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.bytes_at[ids], self.n_bytes[ids])


def _ends(sizes: np.ndarray, counts: np.ndarray) -> list[int]:
    """Where runs of so many items end, and 0 before them, by the sizes of the items."""
    return np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()


@lru_cache(maxsize=2)
def _worker_state(raw: bytes, pattern: str) -> UnitEncoder:
    return UnitEncoder(raw, pattern)


def chunks(texts: list[str | None], chars: int) -> Iterator[list[str]]:
    """Texts in runs of about so many characters."""
    held, n = [], 0
    for text in texts:
        held.append(text or "")
        n += len(held[-1])
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, text_col: str = "text") -> DataFrame:
    """Encode every whole text by byte-level BPE, then decode the ids.

    Texts are split by ``pattern`` and each match is encoded by itself, as the reference
    encoder of the rank file does, without special tokens.  The matches in units of text that a
    worker hasn't met go into matrices by length; each round every row merges its leftmost pair
    of least rank, found by a hashed pair lookup, and closes up.  A worker remembers a bounded
    number of units.  The rank file is read on the driver and sent to the tasks; it has a fixed size.

    Returns the columns of ``docs`` and ``_n_tokens``, ``_ids_sha256`` (of decimal ids joined
    by commas), ``_decoded_sha256`` and, if ``with_ids``, ``_ids`` (array of int).  Null and
    empty texts have no tokens; repeated rows, extra columns and empty tables need no care.
    """
    with open(ranks_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    names = list(docs.columns)
    added = [T.StructField("_n_tokens", T.LongType()), T.StructField("_ids_sha256", T.StringType()), T.StructField("_decoded_sha256", T.StringType())]
    added += [T.StructField("_ids", T.ArrayType(T.IntegerType()))] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_state(raw.value, pattern)
        for batch in slices(batches):
            counts, digests, decoded, ids = [], [], [], []
            for texts in chunks(batch.column(names.index(text_col)).to_pylist(), CHARS):
                flat, own = encoder.encode(texts)
                counts += own.tolist()
                written, at = encoder.in_decimals(flat), _ends(encoder.n_decimals[flat], own)
                digests += [hashlib.sha256(written[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]
                back, at = encoder.decode(flat), _ends(encoder.n_bytes[flat], own)
                decoded += [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(at, at[1:])]
                if with_ids:
                    ids += np.split(flat, np.cumsum(own)[:-1])
            new = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            new += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, *[x.name for x in added]])

    return docs.mapInArrow(encode, T.StructType([*docs.schema.fields, *added]))


def decode_ids(encoded: DataFrame, ranks_path: str, ids_col: str = "_ids") -> DataFrame:
    """Adds ``_decoded`` (binary), the bytes of an array of ids; null ids give null."""
    with open(ranks_path, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())
    names = list(encoded.columns)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_state(raw.value, PARTED).bpe
        for batch in slices(batches):
            texts = [None if own is None else bpe.decode(own) for own in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*names, "_decoded"])

    return encoded.mapInArrow(decode, T.StructType([*encoded.schema.fields, T.StructField("_decoded", T.BinaryType())]))
