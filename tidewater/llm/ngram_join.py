"""N-gram Jaccard join by T-occurrence search: merge the short inverted lists, probe the long ones.

A set of n shingles links only with sets that share at least T of its shingles.  Its inverted
lists are split after DivideSkip: the L longest, L = T / (MU log2 M + 1) with M the longest list
of all, aren't merged.  The others are, and a pair that these don't bring up to its overlap less
L can't link; for the rest the L long lists are probed by binary search, until the overlap is
reached or out of reach.  All sets rank lists alike, rarest first, so the merged lists of the
two sets of a pair hold the same shared shingles up to the lower of their two cuts: merged lists
need only hold the sets that merge them.  A long list is probed where its entry would be, in
the candidate's own sorted shingles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.cluster import EDGES, broadcast_if_small, components, cut
from tidewater.llm.words import mix, raw_texts, shingle_sets, slices

MU = 0.003  # weighs merging a list against probing it
COUNTERS = 1 << 23  # of the sketch that ranks lists, at most; of 16 bits in a task, where they stop at 65,535
SEGMENT = 1 << 16
FAN_IN = 32
CELLS = 64  # of the histogram of a set that bounds overlaps
BATCH = 1 << 14  # postings of much the same lists that come to one task, about
TASKS = 20_000  # that lists are dealt to, at most
LIST = 1 << 15  # sets of a merged list that meet in one task; longer lists are dealt into a grid
PAIRS = 1 << 18  # different pairs that a task holds before it passes them on
FEW = 4  # the first turns look at one in so many of the merged lists
LIKELY = 16  # candidates of a set that each of the first turns verifies
TURNS = 2  # before all remaining pairs are taken
GROUPED = 1_000_000  # named nodes, of two numbers each, that may be broadcast
PROBES = 64  # long lists probed at once
BLOCK = 1024  # sets of a group, about, that meet as many others at once
BLOCK_SHINGLES = 1 << 19  # of such a block, about
COLUMNS = 1 << 11  # shingles of two blocks that are multiplied at once


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """T: the least overlap of a set of n shingles with any set that it links with."""
    return -(-n * percent // 100)


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The overlap at which two sets of n and m shingles link."""
    return -(-percent * (n + m) // (100 + percent))


def _long_lists(n: np.ndarray, percent: int, longest: int) -> np.ndarray:
    """L: how many of a set's lists are probed instead of merged; ``longest`` is log2 of the longest list."""
    t = _least_overlap(n, percent)
    return np.clip((t / (MU * longest + 1)).astype(np.int64), 0, np.maximum(t - 1, 0))


def list_lengths(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """Base-2 logarithms of upper bounds of the lengths of inverted lists, by the hash of a shingle.

    A counting sketch with about a counter for each word of the input, 2**23 at most, merged in a
    tree over the partitions; a task's counters stop at 65,535, more than LIST.  It only ranks lists: its errors cost time and never change a
    result.
    """
    words = (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // 6
    counters = min(COUNTERS, max(SEGMENT, 1 << int(words).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(counters, np.uint16)
        for batch in slices(batches):
            sets = list(shingle_sets(raw_texts(batch.column(0)), k))
            if sets:
                places, n = np.unique((np.concatenate(sets) & np.uint64(counters - 1)).astype(np.int64), return_counts=True)
                counts[places] = np.minimum(counts[places] + n, 65_535)
        for s in range(0, counters, SEGMENT):
            own = counts[s : s + SEGMENT]
            if own.any():
                yield pa.RecordBatch.from_pylist(
                    [{"segment": s // SEGMENT, "slot": TaskContext.get().partitionId(), "counts": zlib.compress(own.tobytes(), 1)}],
                    pa.schema([("segment", pa.int32()), ("slot", pa.int32()), ("counts", pa.binary())]),
                )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SEGMENT, np.uint64)
        for x in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(x), np.uint16)
        packed = zlib.compress(np.minimum(total, 65_535).astype(np.uint16).tobytes(), 1)
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "slot": pdf["slot"].iloc[:1] // FAN_IN, "counts": [packed]})

    def logs(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.frombuffer(zlib.decompress(merge(pdf)["counts"][0]), np.uint16)
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "logs": [zlib.compress(np.ceil(np.log2(counts.astype(np.float64) + 1)).astype(np.uint8).tobytes(), 1)]})

    schema = "segment int, slot int, counts binary"
    slots, parts = docs.rdd.getNumPartitions(), docs.select(text_col).mapInArrow(count, schema)
    while slots > FAN_IN:
        parts = parts.groupBy("segment", F.floor(F.col("slot") / FAN_IN).alias("merged")).applyInPandas(merge, schema)
        slots = -(-slots // FAN_IN)
    found = np.zeros(counters, np.uint8)
    for row in parts.groupBy("segment").applyInPandas(logs, "segment int, logs binary").toLocalIterator():  # one sketch of a bounded size
        found[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(zlib.decompress(bytes(row["logs"])), np.uint8)
    return found


def _fingerprints(own: np.ndarray) -> tuple[int, int]:
    sums = (mix(own ^ np.uint64(salt)).sum(dtype=np.uint64) for salt in (0, 0xA5A5A5A5A5A5A5A5))
    return tuple(int(x.view(np.int64)) for x in sums)  # type: ignore[return-value]


def _named_sets(docs: DataFrame, k: int) -> DataFrame:
    """For each row: id, n, and two fingerprints of its set."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [(len(own), *_fingerprints(own)) for own in shingle_sets(raw_texts(batch.column(1)), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in zip(*made)]], ["id", "n", "one", "two"])

    return docs.mapInArrow(name, f"id {docs.schema['id'].dataType.simpleString()}, n long, one long, two long")


def _rarest_first(own: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set in the order in which all sets rank their lists, and the logarithms that rank them."""
    logs = lengths[(own & np.uint64(len(lengths) - 1)).astype(np.int64)]
    order = np.lexsort((own, logs))
    return own[order], logs[order]


def _described(docs: DataFrame, lengths, k: int, percent: int) -> DataFrame:
    """For each row: id, n, two fingerprints of its set, its histogram, L, the shingles whose lists it merges.

    ``many`` are those of its merged lists that may hold more than LIST sets.
    """
    longest, hot = int(lengths.value.max(initial=0)), LIST.bit_length()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, ones, twos, grams, longs, shorts, many = [], [], [], [], [], [], []
            for own in shingle_sets(raw_texts(batch.column(1)), k):
                n = len(own)
                one, two = _fingerprints(own)
                probed = int(_long_lists(np.int64(n), percent, longest))
                ranked, logs = _rarest_first(own, lengths.value)
                sizes.append(n)
                ones.append(one)
                twos.append(two)
                longs.append(probed)
                grams.append(np.minimum(np.bincount((own >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8).tobytes())
                shorts.append(ranked[: n - probed].view(np.int64))
                many.append(ranked[: n - probed][logs[: n - probed] >= hot].view(np.int64))
            arrays = [pa.array(x, pa.int64()) for x in (sizes, ones, twos, longs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays, pa.array(grams, pa.binary()), pa.array(shorts, pa.list_(pa.int64())), pa.array(many, pa.list_(pa.int64()))],
                ["id", "n", "one", "two", "longs", "cells", "short", "many"],
            )

    return docs.mapInArrow(describe, f"id {docs.schema['id'].dataType.simpleString()}, n long, one long, two long, longs long, cells binary, short array<long>, many array<long>")


def _in_pieces(postings: DataFrame, *near: str, tasks: int | None = None) -> DataFrame:
    """Each list, or two blocks of a long one, in one task: ``piece`` numbers both blocks and, in its last bit, a set's own.

    Lists of equal columns ``near`` come to one task, side by side.
    """
    return postings.repartition(*[tasks] * bool(tasks), *(near or ["gram", F.shiftright("piece", 1)])).sortWithinPartitions(*near, "gram", "piece")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted postings with only whole pieces of lists in each table, and where its pieces begin and end."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            table = pa.concat_tables([rest, table])
        if table.num_rows:
            cuts = _cuts(table)
            rest = table.slice(cuts[-2])
            if len(cuts) > 2:
                yield table.slice(0, cuts[-2]), cuts[:-1]
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _cuts(table: pa.Table) -> np.ndarray:
    new = np.ones(table.num_rows + 1, bool)
    new[1:-1] = False
    for own in (table.column("gram").to_numpy(), table.column("piece").to_numpy() >> 1):
        new[1:-1] |= own[1:] != own[:-1]
    return np.flatnonzero(new)


def _merged_lists(classes: DataFrame, percent: int) -> DataFrame:
    """Postings of the merged lists of two sets or more: each list, or pair of blocks of a long list, in one piece.

    ``c`` counts those of a set's merged lists that hold another set.  With its L long lists they
    bound what it can share with any other, so sets whose bound is too low are left out.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _runs(batches):
            alone = np.repeat(np.diff(cuts) == 1, np.diff(cuts))
            leader = np.repeat(np.minimum.reduceat(table.column("id").to_numpy(), cuts[:-1]), np.diff(cuts))
            kept = pa.array(~alone | table.column("dealt").to_numpy(zero_copy_only=False))
            yield from table.drop_columns("dealt").append_column("leader", pa.array(leader)).filter(kept).combine_chunks().to_batches()

    hot = classes.select(F.explode("many").alias("gram")).groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("blocks")).where("blocks > 1")
    listed = classes.select(F.explode("short").alias("gram"), "id").join(broadcast_if_small(cut(hot), 100_000), "gram", "left")
    placed = (
        listed.withColumn("own", F.coalesce(F.expr("pmod(xxhash64(id), blocks)"), F.lit(0)).cast("long"))
        .withColumn("other", F.explode(F.expr("if(blocks is null, array(0L), sequence(0L, blocks - 1L))")))
        .withColumn("piece", F.shiftleft(F.least("own", "other"), 32) + F.shiftleft(F.greatest("own", "other"), 1) + (F.col("own") > F.col("other")).cast("long"))
        .select("gram", "piece", (F.col("blocks").isNotNull() & (F.col("own") == F.col("other"))).alias("dealt"), "id")
    )
    merged = cut(_in_pieces(placed).mapInArrow(shared, "gram long, piece long, id long, leader long"))
    met = merged.where("shiftright(piece, 32) = shiftright(piece & 4294967295, 1)").groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    able = classes.select("id", "n", "longs", "cells").join(met, "id").where(100 * (F.col("c") + F.col("longs")) >= percent * F.col("n"))
    # lists of the same smallest set are much alike: side by side, a pair's hits add up in few tasks
    many = merged.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BATCH).alias("parts")).where("parts > 1")
    wide = merged.join(able.drop("longs"), "id").join(broadcast_if_small(cut(many), 100_000), "leader", "left")
    wide = wide.withColumn("part", F.when(F.col("parts").isNotNull(), F.expr("pmod(xxhash64(gram), parts)")).otherwise(0))
    return cut(_in_pieces(wide.select("gram", "piece", "id", "n", "c", "cells", "leader", "part"), "leader", "part", tasks=min(TASKS, merged.count() // BATCH + 1)))


def _cells(column: pa.ChunkedArray) -> np.ndarray:
    arrays = [np.frombuffer(b"".join(c.to_pylist()), np.uint8) for c in column.chunks]
    return (np.concatenate(arrays) if arrays else np.zeros(0, np.uint8)).reshape(-1, CELLS).astype(np.int16)


def _possible(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, cells: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs' histograms allow the overlap: cells that differ are shingles that aren't shared."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 14):
        x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
        total = sizes[x] + sizes[y]
        most = (total - np.abs(cells[x] - cells[y]).sum(axis=1, dtype=np.int64)) // 2
        out[k : k + (1 << 14)] = 100 * most >= percent * (total - most)
    return out


def _meetings(ns: np.ndarray, most: np.ndarray, groups: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of a list, a larger set first, whose sizes and counts allow the overlap, but for pairs inside its largest group.

    ``most`` bounds what a set can share with any smaller one.  Few pairs come at once.
    """
    order = np.argsort(ns, kind="stable")
    least, reach = -(-ns * percent // 100), most * (100 + percent) // percent - ns
    names, counts = np.unique(groups, return_counts=True)
    inside = groups[order] == names[counts.argmax()] if 2 * counts.max() > len(ns) else np.zeros(len(ns), bool)
    every, main, others = np.arange(len(ns)), np.flatnonzero(inside), np.flatnonzero(~inside)
    for xs, ys in ((every, others), (others, main)):
        if not len(xs) or not len(ys):
            continue
        sizes = ns[order[ys]]
        low = np.searchsorted(sizes, least[order[xs]], side="left")
        high = np.minimum(np.searchsorted(ys, xs), np.searchsorted(sizes, reach[order[xs]], side="right"))
        many = np.maximum(high - low, 0)
        ends = np.cumsum(many)
        begin = 0
        while begin < len(xs):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")))
            own = many[begin:end]
            if own.sum():
                first = np.repeat(np.arange(begin, end), own)
                place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + low[first]
                yield order[xs[first]], order[ys[place]]
            begin = end


def _candidates(lists: DataFrame, grouped: DataFrame | None, percent: int, longest: int, turn: int | None) -> DataFrame:
    """Candidate pairs (a, b, hits) of different groups from the merged lists.

    With a ``turn``, each set of one in FEW lists meets those 1, 2, 4, 8, ... places before it in an
    order that the turn shuffles, so a list of n makes at most n log n pairs; hits are then only a
    rank.  Without one all sets meet that their sizes, counts and histograms allow, in all lists, and pairs
    remain whose hits reach the overlap that they need less the long lists.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, waiting = None, [], 0
        for table, cuts in _runs(batches):
            piece, ns, cs, ids, groups = (table.column(c).to_numpy() for c in ("piece", "n", "c", "id", "group"))
            longs, cells = _long_lists(ns, percent, longest), None
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                f, group = end - begin, groups[begin:end]
                if group.min() == group.max():
                    continue
                if cells is None:
                    cells = _cells(table.column("cells"))
                if turn is not None:
                    order = np.argsort(mix(ids[begin:end].view(np.uint64) + np.uint64(turn * 7919)))
                    meetings = ((order[: f - (1 << s)], order[1 << s :]) for s in range((f - 1).bit_length()))
                else:
                    meetings = _meetings(ns[begin:end], (cs + longs)[begin:end], group, percent)
                for x, y in meetings:
                    x, y = x + begin, y + begin
                    need = _needed(ns[x], ns[y], percent) - np.maximum(longs[x], longs[y])
                    fit = (groups[x] != groups[y]) & (np.minimum(cs[x], cs[y]) >= need) & (100 * np.minimum(ns[x], ns[y]) >= percent * np.maximum(ns[x], ns[y]))
                    if (piece[begin] >> 32) != (piece[begin] & 0xFFFFFFFF) >> 1:  # two blocks: only pairs across
                        fit &= (piece[x] & 1) != (piece[y] & 1)
                    x, y, need = x[fit], y[fit], need[fit]
                    if len(x):
                        fit = _possible(x, y, ns, cells, percent)
                        x, y = ids[x[fit]], ids[y[fit]]
                        held.append((np.minimum(x, y), np.maximum(x, y), need[fit], np.ones(len(x), np.int64)))
                        waiting += len(x)
                    if waiting > PAIRS:  # count what is held; pass it on only if it is many different pairs
                        done, held, waiting = _counted([done, *held] if done else held), [], 0
                        if len(done[0]) > PAIRS:
                            yield pa.RecordBatch.from_arrays(list(map(pa.array, done)), names)
                            done = None
        if held or done:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _counted([done, *held] if done else held))), names)

    names = ["a", "b", "need", "hits"]
    if turn is not None:
        lists = lists.where(F.pmod("gram", F.lit(FEW)) == turn % FEW)
    met = lists.withColumn("group", F.col("id"))
    if grouped is not None:
        named = grouped.select(F.col("node").alias("id"), "component")
        few = named.limit(GROUPED + 1).count() <= GROUPED
        met = lists.join(F.broadcast(named) if few else named, "id", "left").withColumn("group", F.coalesce("component", "id"))
        if not few:  # a broadcast leaves the lists in their order
            met = _in_pieces(met, "leader", "part")
    pairs = met.select("gram", "piece", "n", "c", "id", "group", "cells").mapInArrow(merge, "a long, b long, need long, hits long")
    pairs = pairs.groupBy("a", "b", "need").agg(F.sum("hits").alias("hits")).where("a <> b")
    return pairs.select("a", "b", "hits") if turn is not None else pairs.where("hits >= need").select("a", "b", "hits")


def _counted(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Different pairs and the sums of their hits."""
    a, b, need, hits = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((need, b, a))
    a, b, need, hits = a[order], b[order], need[order], hits[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (need[1:] != need[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], need[first], np.add.reduceat(hits, first) if len(a) else hits


def links_by_probes(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, percent: int, longest: int) -> bool:
    """Whether two sets, rarest first, link: the merged lists of one of them, then its long ones, by binary search."""
    if not len(x) or not len(y):
        return False
    short = [len(s) - int(_long_lists(np.int64(len(s)), percent, longest)) for s in (x, y)]
    ends = [(lengths[int(s[k - 1]) & (len(lengths) - 1)], s[k - 1]) for s, k in zip((x, y), short)]
    if ends[0] > ends[1]:  # the one whose merged lists end earlier asks
        x, y, short = y, x, short[::-1]
    need, known = int(_needed(len(x), len(y), percent)), np.sort(y)
    found, begin, end = 0, 0, short[0]
    while begin < len(x):
        own = x[begin:end]
        found += int((known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own).sum())
        if found >= need:
            return True
        if found + len(x) - end < need:
            return False
        begin, end = end, min(len(x), end + PROBES)
    return False


def _linked(pairs: DataFrame, docs: DataFrame, lengths, k: int, percent: int) -> DataFrame:
    """Pairs whose whole sets overlap enough."""
    longest = int(lengths.value.max(initial=0))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [_rarest_first(x, lengths.value)[0].tobytes() for x in shingle_sets(raw_texts(batch.column(1)), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["id", "own"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sides = zip(*[[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("left", "right")])
            yield batch.select(["a", "b"]).filter(pa.array([links_by_probes(x, y, lengths.value, percent, longest) for x, y in sides], pa.bool_()))

    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.join(broadcast_if_small(wanted, 500_000), "id", "left_semi")
    # merge joins part the Python steps: in one stage each task would hold three workers
    own = texts.mapInArrow(sets, "id long, own binary").hint("merge")
    met = pairs.join(own.select(F.col("id").alias("a"), F.col("own").alias("left")), "a").join(own.select(F.col("id").alias("b"), F.col("own").alias("right")), "b")
    return met.select("a", "b", "left", "right").mapInArrow(probe, "a long, b long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each set of one side shares with each of the other, or of its own side."""
    sets = left + (right or [])
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    if right is None:
        met = np.bincount(column) > 1
    else:
        own = row < len(left)
        met = (np.bincount(column[own], minlength=len(grams)) > 0) & (np.bincount(column[~own], minlength=len(grams)) > 0)
    kept = met[column]
    row, column = row[kept], (np.cumsum(met) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right or left)), np.int64)
    for at in range(0, int(met.sum()), COLUMNS):
        begin, end = np.searchsorted(column, [at, at + COLUMNS])
        cells = np.zeros((len(sets), COLUMNS if at + COLUMNS <= met.sum() else int(met.sum()) - at), np.float32)
        cells[row[begin:end], column[begin:end] - at] = 1
        out += (cells[: len(left)] @ (cells if right is None else cells[len(left) :]).T).astype(np.int64)
    return out


def _link_counts(classes: DataFrame, grouped: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(c, links)``: with how many rows of other classes each class links.

    Every link lies inside a group, so each group is dealt into blocks, and each pair of its
    blocks meets in one piece that verifies all its pairs of sets.  A piece passes on sums for
    its classes, no pairs.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = list(shingle_sets(raw_texts(batch.column("text")), k))
            # rows that repeat an id may have other texts
            right = [_fingerprints(x) == y for x, y in zip(own, zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()))]
            kept = batch.select(["component", "blocks", "c", "times"]).filter(pa.array(right, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x.tobytes() for x, y in zip(own, right) if y], pa.binary())], [*kept.schema.names, "own"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, done, waiting = None, ({}, {}), [], 0

        def settled(low: int, high: int) -> None:
            nonlocal waiting
            names, times, owned = [[[x[i] for x in side.values()] for side in sides] for i in range(3)]
            if low == high and len(owned[0]) > 1 or low != high and owned[0] and owned[1]:
                n = [np.array([len(x) for x in side], np.int64) for side in owned]
                shared = _overlaps(owned[0], None if low == high else owned[1])
                linked = (shared > 0) & (100 * shared >= percent * (n[0][:, None] + n[low != high] - shared))
                if low == high:
                    np.fill_diagonal(linked, False)
                    done.append((names[0], linked @ np.array(times[0])))
                else:
                    done.extend([(names[0], linked @ np.array(times[1])), (names[1], np.array(times[0]) @ linked)])
                waiting += len(names[0]) + len(names[1])
            for side in sides:
                side.clear()

        def summed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(x[i], np.int64) for x in done])) for i in (0, 1)], ["c", "links"])

        for batch in slices(batches):
            for component, low, high, side, c, times, own in zip(*batch.select(["component", "low", "high", "side", "c", "times", "own"]).to_pydict().values()):
                if (component, low, high) != now:
                    if now is not None:
                        settled(*now[1:])
                    now = component, low, high
                sides[side != low].setdefault(c, (c, times, np.frombuffer(own, np.uint64)))
            if waiting > 1 << 14:
                yield summed()
                done, waiting = [], 0
        if now is not None:
            settled(*now[1:])
        if done:
            yield summed()

    members = classes.join(grouped, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"), blocks.alias("blocks")).where("m > 1").select("component", "blocks")
    placed = cut(members.select("c", "id", "one", "two", "times", "component").join(sized, "component"))
    met = docs.join(broadcast_if_small(placed, 200_000), "id").mapInArrow(sets, "component long, blocks int, c long, times long, own binary")
    met = met.withColumn("side", F.expr("cast(pmod(xxhash64(c), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("other", "blocks")
    pieces = ["component", "low", "high"]
    return met.repartition(*pieces).sortWithinPartitions(*pieces).mapInArrow(count, "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_links: bool = False) -> DataFrame:
    """Group documents whose sets of k-word shingles have a Jaccard similarity of ``percent`` in 100 or more.

    Returns one row for each row of ``docs``: ``_id``, ``_n_shingles`` and ``_group``, the
    smallest id that links reach from it.  Words are runs of other bytes than blanks with
    A-Z lower-cased; a text with fewer words than ``k`` is one shingle; one without words, or
    null, has none and links with nothing.

    Equal sets meet by fingerprint, so copies count once.  The others are found by the module's
    T-occurrence search, in turns.  The first ones verify a few likely candidates of each set and
    join what links, so a large group of near copies isn't expanded into its pairs.  The last
    takes all pairs of sets that are still in different groups, counts their hits in the merged
    lists over the cluster, drops those under the threshold and probes the long lists for the
    rest, so no link between groups is lost.  A list of more than LIST sets is dealt into blocks
    whose pairs are different pieces of work; tasks pass pairs on as they count them.

    ``with_links`` adds ``_n_links``: the number of other rows with an id whose texts link with
    this one, copies included; 0 for a row without an id or words.  All pairs of different sets in
    a group are verified for it, in blocks that pass on sums.

    Ids are long numbers.  A row without an id keeps a null group; rows that repeat an id are one
    document whose texts may each link.  Extra columns play no part, empty tables give no rows.
    """
    spark, percent = docs.sparkSession, int(percent)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lengths = spark.sparkContext.broadcast(list_lengths(plain, "text", k))
    longest = int(lengths.value.max(initial=0))
    firsts = [F.first(x).alias(x) for x in ("n", "longs", "cells", "short", "many")]
    classes = cut(
        _described(plain, lengths, k, percent).where("n > 0 and id is not null").groupBy("one", "two")
        .agg(F.min("id").alias("id"), *firsts, F.count(F.lit(1)).alias("times"))
        .withColumn("c", F.monotonically_increasing_id())  # ids may repeat with other texts
    )
    lists, texts = _merged_lists(classes, percent), plain.where("id is not null")
    by_hits = Window.partitionBy("b").orderBy(F.col("hits").desc(), "a")
    grouped, tried = None, None
    for turn in [*range(TURNS), None]:
        pairs = _candidates(lists, grouped, percent, longest, turn)
        if turn is not None:
            pairs = pairs.withColumn("k", F.row_number().over(by_hits)).where(F.col("k") <= LIKELY)
        if tried is not None:  # no pair is verified twice
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs.select("a", "b"), EDGES)
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = _linked(pairs, texts, lengths, k, percent)
        if grouped is not None:
            found = found.unionByName(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")))
        grouped = components(found)
    named = classes.select("one", "two", "c", "times", F.col("id").alias("node")).join(grouped, "node", "left").withColumn("_group", F.coalesce("component", "node"))
    if with_links:
        named = named.join(_link_counts(classes, grouped, texts, k, percent), "c", "left").withColumn("_n_links", F.col("times") - 1 + F.coalesce("links", F.lit(0)))
    kept = ["_group", "_n_links"] if with_links else ["_group"]
    out = _named_sets(plain, k).join(named.select("one", "two", *kept), ["one", "two"], "left")
    links_of = [F.when(F.col("id").isNotNull(), F.coalesce("_n_links", F.lit(0))).otherwise(0).alias("_n_links")] if with_links else []
    return out.select(F.col("id").alias("_id"), F.col("n").alias("_n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("_group", "id")).alias("_group"), *links_of)
