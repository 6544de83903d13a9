"""Token counts at every prefix by dynamic programming."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.byte_bpe import NONE, PairTable, chunks
from tidewater.llm.unicode import Splitter, composed, lowered
from tidewater.llm.words import slices

END = "</w>"
CACHED = 500_000  # units of text, words, beginnings of words, and pairs of tokens, that a worker remembers
REMEMBERED = 12  # letters of the beginnings that are remembered
WORD = 256  # letters of words and units that are remembered whole
CHARS = 1 << 20  # characters of text that are parted before their new units are counted
TOGETHER = 8192  # words that are counted at once
# How the vocabulary's file says that texts are normalized and split.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = ["Split", "ByteLevel"]
_BLANKS, _INNER = regex.compile(r"\s"), regex.compile(r"[^\S ]")
_RUNS = regex.compile(r"[^\S ]\s*| \s+")  # blanks that aren't one space already
PARTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # of this pattern all but blanks is matched, and no match looks beyond one


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PrefixCounter:
    """Counts the tokens of a lower-casing word BPE without encoding a text twice.

    A sequence of tokens is a BPE encoding just when every two neighbours are: so the last
    token of a prefix is the one suffix token that may follow the last token of what precedes
    it, and a prefix's count is that prefix's count plus one.
    """

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, splitters = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        options = [splitters[0].get("invert"), splitters[0].get("behavior"), splitters[1].get("use_regex"), splitters[1].get("add_prefix_space")] if len(splitters) == 2 else None
        if (
            spec["normalizer"].get("normalizers") != NORMALIZERS
            or [x["type"] for x in splitters] != SPLITTERS
            or options != [True, "Removed", False, False]
            or (model["type"], model["end_of_word_suffix"]) != ("BPE", END)
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ):
            raise ValueError("this vocabulary normalizes or splits texts in a way that isn't known here")
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.longest = max(map(len, self.vocab))
        self.whole = {t[: -len(END)] for t in self.vocab if t.endswith(END)}  # tokens that end a word
        self.open = {t for t in self.vocab if not t.endswith(END)}
        self.letters = byte_letters()
        self.words = Splitter(splitters[0]["pattern"]["Regex"])
        self.parted = splitters[0]["pattern"]["Regex"] == PARTED and not any(_BLANKS.search(t["content"]) for t in spec["added_tokens"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.counts: dict[str, int] = {}
        self.opened: dict[str, tuple[str, int]] = {}
        self.units: dict[str, int] = {"": 0}
        self._grow()

    def _grow(self) -> None:
        """The tree of the tokens' bytes, from its root 0, and a table for pairs of tokens; token 0 stands for none."""
        byte_of = {letter: b for b, letter in enumerate(self.letters)}
        self.names, edges, ends = [""], {}, []
        for known, ending in ((self.open, ""), (self.whole, END)):
            for token in sorted(known):
                if token and all(letter in byte_of for letter in token):
                    node = 0
                    for letter in token:
                        node = edges.setdefault((node, byte_of[letter]), len(edges) + 1)
                    ends.append((bool(ending), node, len(self.names)))
                    self.names.append(token + ending)
        left, right = np.array(list(edges), np.int64).reshape(-1, 2).T
        self.tree = PairTable(left, right, np.array(list(edges.values()), np.int32))
        self.ended = np.zeros((2, len(edges) + 1), np.int32)  # the token that ends at each node, open and whole
        for kind, node, token in ends:
            self.ended[int(kind), node] = token
        self._forget_pairs()

    def _forget_pairs(self) -> None:
        none = np.zeros(0, np.int32)
        self.follow, self.n_follow = PairTable(none, none, none, CACHED), 0

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols: for checking pairs of tokens only."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            return [*token[: -len(END) - 1], token[-len(END) - 1 :]]
        return list(token)

    def follows(self, left: str, right: str) -> bool:
        """Whether two tokens side by side are what BPE makes of their letters; left may be empty."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > CACHED:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged_alike(left, right)
        return found

    def merged_alike(self, left: str, right: str) -> bool:
        return self.merged(self._symbols(left) + self._symbols(right)) == ([left, right] if left else [right])

    def _all_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same for arrays of tokens."""
        found = self.follow.lookup(left, right)
        new = found == NONE
        if new.any():
            pairs = list(set(zip(left[new].tolist(), right[new].tolist())))
            if self.n_follow + len(pairs) > CACHED:
                self._forget_pairs()
            if len(pairs) <= CACHED:
                answers = np.array([self.merged_alike(self.names[a], self.names[b]) for a, b in pairs], np.int32)
                self.follow.add(*np.array(pairs, np.int32).T, answers)
                self.n_follow += len(pairs)
                found[new] = self.follow.lookup(left[new], right[new])
            else:
                found[new] = [self.merged_alike(self.names[a], self.names[b]) for a, b in zip(left[new].tolist(), right[new].tolist())]
        return found == 1

    def word_counts(self, words: list[str]) -> list[int]:
        """The counts of many words, letter by letter of all of them.

        ``begun`` are runs of letters that some token goes on from: their words, where they begin, and
        their nodes of the tree.  One that is a token ends a prefix if it may follow the last token there.
        """
        raw = [w.encode() for w in words]
        sizes = np.array(list(map(len, raw)), np.int64)
        data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
        last, counts = np.zeros((2, len(data) + 1 + len(raw)), np.int32)  # at every prefix, the empty one too
        places = starts + np.arange(len(raw))
        word = begin = node = np.zeros(0, np.int64)
        for at in range(sizes.max(initial=0)):
            going = sizes[word] > at
            fresh = np.flatnonzero(sizes > at)
            word, begin = np.concatenate([word[going], fresh]), np.concatenate([begin[going], np.full(len(fresh), at)])
            node = self.tree.lookup(np.concatenate([node[going], np.zeros(len(fresh), np.int64)]), data[starts[word] + at])
            going = node != NONE
            word, begin, node = word[going], begin[going], node[going].astype(np.int64)
            token = self.ended[(sizes[word] == at + 1).astype(np.int64), node]
            ending = np.flatnonzero(token)
            before = places[word[ending]] + begin[ending]
            right = self._all_follow(last[before], token[ending])
            ending, before = ending[right], before[right]
            here = places[word[ending]] + at + 1
            last[here], counts[here] = token[ending], counts[before] + 1
            if (last[places[fresh] + at + 1] == 0).any():
                raise ValueError(f"no token ends at {at + 1}")
        return counts[places + sizes].tolist()

    def _last(self, text: str, at: int, ending: str, last: list[str]) -> tuple[str, int]:
        """The last token of text[:at], with or without the word's end, and where it begins."""
        known, pairs = self.whole if ending else self.open, self.pairs
        for begin in range(max(0, at - self.longest), at):
            token = text[begin:at]
            if token in known:
                token += ending
                found = pairs.get((last[begin], token))
                if found or found is None and self.follows(last[begin], token):
                    return token, begin
        raise ValueError(f"no token ends at {at}")

    def word_prefixes(self, word: str) -> tuple[list[int], list[str], str]:
        """For every prefix of the word's byte letters: its count as an open prefix, and its last token."""
        text = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        counts, last, opened = [0], [""], self.opened
        for at in range(1, len(text)):
            found = opened.get(text[:at]) if at <= REMEMBERED else None
            if found is None:
                token, begin = self._last(text, at, "", last)
                found = token, counts[begin] + 1
                if at <= REMEMBERED:
                    opened[text[:at]] = found
            last.append(found[0])
            counts.append(found[1])
        if len(opened) > CACHED:
            opened.clear()
        return counts, last, text

    def word_count(self, word: str) -> int:
        counts, last, text = self.word_prefixes(word)
        return counts[self._last(text, len(text), END, last)[1]] + 1

    def word_table(self, word: str) -> list[int]:
        """The count of every prefix of the word's characters, each as a word of its own."""
        counts, last, text = self.word_prefixes(word)
        ends = np.cumsum([len(c.encode()) for c in word])
        return [counts[self._last(text, int(e), END, last)[1]] + 1 for e in ends]

    def _counts_of(self, words: list[str]) -> list[int]:
        cache = self.counts
        if len(cache) > CACHED:
            cache.clear()
        fresh = set(words).difference(cache)
        long = {w: self.word_count(w) for w in fresh if len(w) > WORD}
        rest = sorted(fresh.difference(long), key=len)
        for k in range(0, len(rest), TOGETHER):
            cache.update(zip(rest[k : k + TOGETHER], self.word_counts(rest[k : k + TOGETHER])))
        return [long[w] if w in long else cache[w] for w in words] if long else [cache[w] for w in words]

    def _learn(self, units: list[str]) -> None:
        """Counts units of text; of those that hold no blanks and no special tokens, all at once."""
        text = " ".join(units)
        odd = [u for u in units if self.special.search(u) or _BLANKS.search(u)] if not self.parted or self.special.search(text) or _INNER.search(text) else []
        self.units.update((u, self.prefixes(u).count()) for u in odd)
        if plain := list(set(units).difference(odd)) if odd else units:
            text = lowered(composed(" ".join(plain)))
            words = self.words.findall(text)
            begins = np.cumsum([0, *map(len, words)])
            first = np.searchsorted(begins, np.cumsum([0, *map(len, text.split(" "))])[:-1])
            self.units.update(zip(plain, np.add.reduceat(self._counts_of(words), first).tolist()))

    def counted(self, texts: list[str], limit: int) -> Iterator[tuple[int, int | None]]:
        """The count of each text, and the characters of its normalized text that ``limit`` tokens hold, if not all."""
        if not self.parted:
            for text in texts:
                found = self.prefixes(text)
                yield found.count(), found.fits(limit) if found.count() > limit else None
            return
        if len(self.units) > CACHED:
            self.units = {"": 0}
        known = self.units
        units = [text.replace("\n", " ").split(" ") for text in texts]  # where words end in any case
        if new := list(set().union(*units).difference(known)):
            self._learn(new)
        for own in units:
            counts = list(map(known.__getitem__, own))
            n = sum(counts)
            yield n, self._fits(own, counts, limit) if n > limit else None
        for unit in new:
            if len(unit) > WORD:
                del known[unit]

    def _fits(self, units: list[str], counts: list[int], limit: int) -> int:
        totals = np.cumsum(counts)
        k = int(np.searchsorted(totals, limit, side="right"))  # the first unit that doesn't fit whole
        if units[k][0].isspace():
            return self.prefixes(" ".join(units[: k + 1])).fits(limit)
        head, before = (" ".join(units[:k]) + " ", int(totals[k - 1])) if k else ("", 0)
        return len(self.normalized(head)) + self.prefixes(units[k]).fits(limit - before)

    def normalized(self, text: str) -> str:
        marks = self.special.findall(text)
        parts = [_RUNS.sub(" ", lowered(composed(part))) for part in (self.special.split(text) if marks else [text])]
        return "".join(chain.from_iterable(zip(parts, [*marks, ""])))

    def prefixes(self, text: str) -> "Prefixes":
        """The counts at all prefixes of a text, from one pass over it."""
        pieces, words, counts = [], [], []
        marks = self.special.findall(text)
        for k, part in enumerate(self.special.split(text) if marks else [text]):
            part = lowered(composed(part))
            own = self.words.findall(part)
            words += own
            counts += self._counts_of(own)
            pieces.append(part)
            if k < len(marks):  # a special token is whole or not there
                words.append(marks[k])
                counts.append(1)
                pieces.append(marks[k])
        return Prefixes(self, pieces, words, np.cumsum([0, *counts]), set(marks))


@dataclass
class Prefixes:
    """The counts at all prefixes of a normalized text.

    ``totals`` holds the count before each word and after the last one.  Inside a word, the count
    is the total before it and an entry of the word's own table, which is made when it is asked for.
    """

    counter: PrefixCounter
    pieces: list[str]
    words: list[str]
    totals: np.ndarray
    specials: set[str]

    @cached_property
    def text(self) -> str:
        """The normalized text: composed, blanks joined, lower case."""
        return "".join(_RUNS.sub(" ", x) for x in self.pieces)

    @cached_property
    def begins(self) -> np.ndarray:
        """Where each word begins; only blanks lie between words."""
        found, at = [], 0
        for word in self.words:
            at = self.text.index(word, at)
            found.append(at)
            at += len(word)
        return np.array(found, np.int64)

    @cached_property
    def ends(self) -> np.ndarray:
        return self.begins + np.array(list(map(len, self.words)), np.int64)

    def count(self) -> int:
        return int(self.totals[-1])

    def _table(self, word: int, most: int | None = None) -> list[int] | None:
        own = self.words[word]
        return None if own in self.specials else self.counter.word_table(own[:most])

    def at(self, chars: int) -> int:
        """The count of the prefix of so many characters."""
        done = int(np.searchsorted(self.ends, chars, side="right"))
        if done == len(self.ends) or self.begins[done] >= chars:
            return int(self.totals[done])
        table = self._table(done)
        if table is None:
            raise ValueError("a prefix that ends inside a special token has no count of its own")
        return int(self.totals[done]) + table[chars - int(self.begins[done]) - 1]

    def fits(self, limit: int) -> int:
        """The length of the longest prefix that has at most ``limit`` tokens."""
        if self.count() <= limit:
            return len(self.text)
        word = int(np.searchsorted(self.totals[1:], limit, side="right"))  # the first one that doesn't fit whole
        begin = int(self.begins[word])
        # no token is longer than the longest of the vocabulary
        table = self._table(word, (limit - int(self.totals[word]) + 1) * self.counter.longest) or []
        return begin + max((i + 1 for i, n in enumerate(table) if self.totals[word] + n <= limit), default=0)


@lru_cache(maxsize=2)
def _counter(raw: bytes) -> PrefixCounter:
    return PrefixCounter(raw)


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 2048, text_col: str = "text", with_prefixes: bool = False) -> DataFrame:
    """Count the tokens of every whole text at all its prefixes, and where it reaches ``limit``.

    Returns the columns of ``docs`` and ``_n_tokens`` and ``_fits_chars``: characters of the
    normalized text that ``limit`` tokens hold, null if they hold all of it.
    One pass over a text gives its prefix counts: stored totals at the words, tables inside them.
    ``with_prefixes`` adds ``_prefixes``, an array of (end, tokens) for every word of the
    normalized text, from which ``tokens_at`` and ``fits_chars`` answer other questions on
    truncation and budgets without a look at the text.  Strings of special tokens inside a text
    count as one token each.

    Null and empty texts have no tokens; repeated rows, extra columns and empty tables need no
    care.  The vocabulary is read on the driver and sent to the tasks; it has a fixed size.
    """
    with open(vocabulary_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(raw.value)
        for batch in slices(batches):
            counts, fits, prefixes = [], [], []
            for texts in chunks(batch.column(names.index(text_col)).to_pylist(), CHARS):
                if not with_prefixes:
                    for n, held in counter.counted(texts, limit):
                        counts.append(n)
                        fits.append(held)
                    continue
                for text in texts:
                    found = counter.prefixes(text)
                    counts.append(found.count())
                    fits.append(found.fits(limit) if counts[-1] > limit else None)
                    prefixes.append([{"end": e, "tokens": n} for e, n in zip(found.ends.tolist(), found.totals[1:].tolist())])
            new = [pa.array(counts, pa.int64()), pa.array(fits, pa.int64())]
            new += [pa.array(prefixes, pa.list_(pa.struct([("end", pa.int32()), ("tokens", pa.int32())])))] * with_prefixes
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [x.name for x in fields])

    fields = [*docs.schema.fields, T.StructField("_n_tokens", T.LongType()), T.StructField("_fits_chars", T.LongType())]
    one = T.StructType([T.StructField("end", T.IntegerType()), T.StructField("tokens", T.IntegerType())])
    fields += [T.StructField("_prefixes", T.ArrayType(one))] * with_prefixes
    return docs.mapInArrow(run, T.StructType(fields))


def fits_chars(limit: int | Column, prefixes: str = "_prefixes") -> Column:
    """Characters of the normalized text up to the last whole word that ``limit`` tokens hold."""
    most = limit if isinstance(limit, Column) else F.lit(limit)
    return F.coalesce(F.array_max(F.transform(F.filter(prefixes, lambda p: p["tokens"] <= most), lambda p: p["end"])), F.lit(0))


def tokens_at(chars: int | Column, prefixes: str = "_prefixes") -> Column:
    """Tokens of the whole words among the first ``chars`` characters of the normalized text."""
    most = chars if isinstance(chars, Column) else F.lit(chars)
    return F.coalesce(F.array_max(F.transform(F.filter(prefixes, lambda p: p["end"] <= most), lambda p: p["tokens"])), F.lit(0))
