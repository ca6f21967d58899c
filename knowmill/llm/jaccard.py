"""Exact Jaccard join of documents on word shingles by T-occurrence search with divided lists.

Two documents link when 100 * |A and B| >= 75 * |A or B| over their sets of distinct five-word shingles (a shorter
text is one shingle). Equal sets form a class; the join runs between classes.

The search: a class probes an index of inverted lists for the classes that stand in at least T of its lists
(T follows from its size). Its lists are divided (DivideSkip): the short ones are merged by a heap that skips entries no
count can save, the long ones are probed by binary search for the classes the merge has left (``divide_skip``).

An index must hold whole lists and fit a task, so classes first meet: a set may leave out its T - h last shingles in an
order from rare to frequent and still shares h = max(1, n / HITS) of the others with each partner. Those others are
shuffled by shingle; classes that share enough of them meet, in pairs for lists of up to ``LIST`` classes, through the first
class for longer ones. Which shingles count as frequent only steers the work: any order shared by all gives the same
links. Classes connected by meetings form a group. In a group larger than a block, which passages that many texts hold can join
without a link, classes meet anew by their whole sets: lists are those of the group, and a pair must reach its T in them
(``regroup``). Small groups share an index of bounded size; a large group is cut into blocks
of bounded size, each block is indexed and probed by itself and by every other block, so that no pair of a group becomes
a row. Components of the links come from Spark jobs. Nothing is sampled or capped.

Null or empty texts have no shingles and link with nothing; equal texts always link. Rows that repeat a doc_id, with the
same or another text, are returned as often and each by its own text. A document without doc_id takes part and gets the
component of the documents it links with, null if none of them has an id. Only doc_id and text are read. Texts may have any
length; one text's shingles must fit a task. Empty tables give no rows. Shingles are compared by 64-bit hashes of their words, classes by
64-bit hashes of their shingles.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, release, stash, table

SHINGLE, PERCENT = 5, 75
#: Longest list whose classes meet in pairs; a set's size for each meeting asked for; frequent shingles that steer the order, at most.
LIST, HITS, STEER = 8, 16, 1 << 18
#: Classes and shingles of a block; shingles of small groups that share an index; entries of a bucket; bytes of text at once.
BLOCK, BLOCK_SHINGLES, SHARED, BUCKET, PART_BYTES = 512, 1_000_000, 200_000, 300_000, 4_000_000
#: Up to so many entries for each member of an index, short lists are merged by a heap.
DENSE = 16
NONE = np.zeros(0, dtype=np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed multipliers), so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


FORWARD = 0x9E3779B97F4A7C15
BACKWARD = pow(FORWARD, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14)]] = True


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within a text, and each text's number of them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = LOWER[raw]
    blank = BLANK[raw]
    begins, ends = ~blank, ~blank
    begins[1:] &= blank[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edges] = ~blank[edges]
    ends[:-1] &= blank[1:]
    ends[edges - 1] = ~blank[edges - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # Prefix sums of a polynomial modulo 2^64 give each word's hash without a loop over words.
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw), FORWARD), out=sums[1:])
    words = _mix((sums[last] - sums[first]) * _powers(len(raw), BACKWARD)[first] + (last - first).astype(np.uint64))
    doc = np.searchsorted(offsets, first, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    n = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    starts = np.cumsum(n_words) - n_words
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[owner]
    room = np.minimum(size, n_words)[owner]
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        inside = k < room
        step = words[np.minimum(at + k, len(words) - 1)]
        value = np.where(inside, _mix(value * np.uint64(3) + step + np.uint64(k + 1)), value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(texts))


def _classes(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, 0 for the empty one."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(values + np.uint64(FORWARD)), dtype=np.uint64)])
    keys = _mix(total[ends[1:]] - total[ends[:-1]] + counts.astype(np.uint64))
    return np.where(counts > 0, keys | np.uint64(1), np.uint64(0))


def _parts(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text, whole texts each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.searchsorted(sizes, np.arange(most, sizes[-1] if len(sizes) else 0, most)))
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(values) if kind is None else pa.array(values, kind))


def measure_sets(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, n, cls), and rows (often, cls = shingle, n) that count shingles found in
    more than one document of a part of the input, which is where long lists show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "cls", "often"]
        kept: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            seen, times = np.unique(np.concatenate(kept), return_counts=True)
            seen, times = seen[times > 1], times[times > 1]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.int64()), pa.array(times, pa.int64()), _signed(seen), pa.array(np.ones(len(seen), dtype=bool))], names=names)

        for batch in batches:
            for part in _parts(batch):
                values, counts = shingle_sets(part.column(1))
                keys = _classes(values, counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), _signed(keys), pa.array(np.zeros(len(keys), dtype=bool))], names=names)
                _, one = np.unique(keys, return_index=True)
                kept.append(values[np.repeat(np.isin(np.arange(len(keys)), one), counts)])
                if sum(map(len, kept)) > 3_000_000:
                    yield often()
        if kept:
            yield often()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cls long, often boolean")


def postings(docs: DataFrame, long_lists: np.ndarray, buckets: int) -> DataFrame:
    """The entries through which classes meet, packed by bucket of shingle: parallel arrays of shingle and class.
    long_lists: ascending hashes of frequent shingles, with ranks from rare to frequent."""
    spark = docs.sparkSession
    steer = spark.sparkContext.broadcast(long_lists)  # at most STEER entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = steer.value["h"], steer.value["rank"]
        for batch in batches:
            kept = []
            for part in _parts(batch):
                values, counts = shingle_sets(part.column(1))
                keys = _classes(values, counts)
                owner = np.repeat(np.arange(len(keys)), counts)
                rank = np.zeros(len(values), dtype=np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
                    rank = np.where(hashes[at] == values, ranks[at], 0)
                order = np.lexsort((values, rank, owner))
                place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
                short = counts - (PERCENT * counts + 99) // 100 + np.maximum(1, counts // HITS)
                _, one = np.unique(keys, return_index=True)  # equal sets of a part once
                first = np.zeros(len(keys), dtype=bool)
                first[one] = True
                pick = order[(place < np.repeat(short, counts)) & first[owner]]
                kept.append((values[pick], keys[owner[pick]]))
            if not kept:
                continue
            value, key = (np.concatenate(x) for x in zip(*kept, strict=True))
            bucket = (value >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            per = np.bincount(bucket.astype(np.int64), minlength=buckets)
            live, per = np.flatnonzero(per), per[per > 0]
            cols = [pa.array(live, pa.int64()), _lists(value[order], per), _lists(key[order], per)]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "shingles", "classes"])

    return docs.select("doc_id", "text").mapInArrow(run, "bucket long, shingles array<long>, classes array<long>")


def _met(key: np.ndarray, begins: np.ndarray) -> pd.DataFrame:
    """The meetings of classes in lists, which lie one behind the other."""
    heads = np.flatnonzero(begins)
    lengths = np.diff(np.append(heads, len(key)))
    owner = np.repeat(np.arange(len(heads)), lengths)
    place = np.arange(len(key)) - heads[owner]
    found = []
    small = lengths[owner] <= LIST
    for d in range(1, LIST):
        (i,) = np.nonzero(small[d:] & (place[d:] >= d))
        if not len(i):
            break
        found.append(np.stack([key[i], key[i + d]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    pairs, hits = np.unique(np.sort(pairs, axis=0), axis=1, return_counts=True)
    (hot,) = np.nonzero(~small)
    stars, more = np.unique(np.stack([key[heads[owner[hot]]], key[hot]]), axis=1, return_counts=True)
    both = np.concatenate([pairs, stars], axis=1)
    return pd.DataFrame({"a": both[0], "b": both[1], "hot": np.arange(both.shape[1]) >= pairs.shape[1], "hits": np.concatenate([hits, more])})


def merge_lists(packed: DataFrame) -> DataFrame:
    """Counts the meetings of a bucket: pairs (a, b) from lists of up to LIST classes, and for longer lists (hot) their
    first class with each of their classes."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        value, key = (np.concatenate(part[c].to_list()) for c in ("shingles", "classes"))
        order = np.lexsort((key, value))
        value, key = value[order], key[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (key[1:] != key[:-1])
        value, key = value[new], key[new]
        return _met(key, np.concatenate([[True], value[1:] != value[:-1]]))

    return packed.groupBy("bucket").applyInPandas(run, "a long, b long, hot boolean, hits long")


def whole_lists(members: DataFrame, buckets: int) -> DataFrame:
    """members: grp, cls, n, shingles. All entries of their lists, packed by bucket: parallel arrays of the list (a shingle in a
    group), class and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                grp, cls, n = (part.column(c).to_numpy() for c in range(3))
                value, owner = part.column(3).flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(n)), n)
                key = _mix(value ^ _mix(grp.view(np.uint64))[owner])
                bucket = (key >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                per = np.bincount(bucket.astype(np.int64), minlength=buckets)
                live, per, owner = np.flatnonzero(per), per[per > 0], owner[order]
                cols = [pa.array(live, pa.int64()), _lists(key[order], per), _lists(cls[owner], per), _lists(n[owner], per, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "lists", "classes", "sizes"])

    return members.select("grp", "cls", "n", "shingles").mapInArrow(run, "bucket long, lists array<long>, classes array<long>, sizes array<int>")


def merge_whole(packed: DataFrame) -> DataFrame:
    """Counts the meetings of a bucket as ``merge_lists`` does. A list is cut where sizes leave so wide a gap that no set on
    one side can link with one on the other."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        value, key, size = (np.concatenate(part[c].to_list()) for c in ("lists", "classes", "sizes"))
        order = np.lexsort((key, size, value))
        value, key, size = value[order], key[order], size[order].astype(np.int64)
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (key[1:] != key[:-1])
        value, key, size = value[new], key[new], size[new]
        return _met(key, np.concatenate([[True], (value[1:] != value[:-1]) | (100 * size[:-1] < PERCENT * size[1:])]))

    return packed.groupBy("bucket").applyInPandas(run, "a long, b long, hot boolean, hits long")


def regroup(members: DataFrame, large: DataFrame) -> DataFrame:
    """cls, grp of those classes of large groups (cls, grp) that may link: classes meet in their groups by their whole sets, and
    again in the groups that this leaves, until they shrink by less than a tenth. Sets that link share T of their lists, where
    T is 0.75 of the larger."""
    need = lambda n: F.ceil(PERCENT * F.col(n) / 100)
    last, left = None, large.count()
    while left and (last is None or left < 0.9 * last):
        own = members.join(large, "cls")
        entries = own.agg(F.sum("n")).first()[0] or 0
        merged = stash(merge_whole(whole_lists(own, 1 + int(entries / BUCKET))), "merged")
        long_hits = merged.where("hot").groupBy(F.col("b").alias("cls")).agg(F.sum("hits").alias("h"))
        sized = stash(own.select("cls", "n").distinct().join(long_hits, "cls", "left").select("cls", "n", F.coalesce("h", F.lit(0)).alias("h")), "sized")
        pairs = merged.where("not hot").groupBy("a", "b").agg(F.sum("hits").alias("hits"))
        pairs = pairs.join(sized.toDF("a", "na", "ha"), "a").join(sized.toDF("b", "nb", "hb"), "b")
        enough = F.col("hits") + F.least("ha", "hb") >= F.greatest(need("na"), need("nb"))
        pairs = pairs.where(enough & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))).select("a", "b", F.lit(False).alias("star"))
        # Without a meeting in short lists, all that a pair shares lies in long ones.
        alive = sized.where(F.col("h") >= need("n")).select("cls")
        stars = merged.where("hot").join(alive, F.col("b") == F.col("cls"), "left_semi").select("a", "b", F.lit(True).alias("star"))
        meetings = stash(pairs.union(stars).toDF("u", "v", "star"), "meetings")
        # What neither a pair nor a star of its own asks for only leads lists.
        asked = meetings.select(F.explode(F.when(F.col("star"), F.array("v")).otherwise(F.array("u", "v"))).alias("cls")).distinct()
        large = stash(components(meetings.select("u", "v")).toDF("cls", "grp").join(asked, "cls", "left_semi"), "groups")
        release(merged, sized, meetings)
        last, left = left, large.count()
    return large


def heap_merge(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """Entries that at least ``need`` of the ascending lists hold, with how many do. The heap holds each list's next entry;
    where too few lists stand at the least one, need - 1 lists are moved on to the next entry that can still be reached."""
    k = len(lists)
    heap = [x[0] * k + i for i, x in enumerate(lists)]
    heapify(heap)
    at, out = [0] * k, []
    while len(heap) >= need:
        least = heap[0] // k
        stop, popped = (least + 1) * k, []
        while heap and heap[0] < stop:
            popped.append(heappop(heap) % k)
        if len(popped) >= need:
            out.append((least, len(popped)))
            goal = least + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heappop(heap) % k)
            if not heap:
                break
            goal = heap[0] // k
        for i in popped:
            rest = lists[i]
            at[i] = bisect_left(rest, goal, at[i])
            if at[i] < len(rest):
                heappush(heap, rest[at[i]] * k + i)
    return out


class Index:
    """Inverted lists of classes, given as flat shingle codes with their owners, ascending."""

    def __init__(self, code: np.ndarray, owner: np.ndarray, members: int):
        order = np.argsort(code, kind="stable")
        self.owner, self.members = owner[order], members
        self.ends = np.cumsum(np.bincount(code, minlength=int(code.max(initial=-1)) + 1))
        self.keys = code[order].astype(np.int64) * members + self.owner

    def divide_skip(self, codes: np.ndarray, need: int, above: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Members after ``above`` that stand in at least ``need`` of the codes' lists, and in how many. The longest
        lists, fewer than need, are set apart and probed for what the others' merge leaves."""
        codes = codes[codes < len(self.ends)]
        hi = self.ends[codes]
        lo = np.searchsorted(self.keys, codes * self.members + above + 1)
        live = hi > lo
        codes, lo, hi = codes[live], lo[live], hi[live]
        if len(codes) < need:
            return NONE, NONE
        order = np.argsort(hi - lo, kind="stable")
        codes, lo, hi = codes[order], lo[order], hi[order]
        apart = min(need - 1, int(need / (0.01 * np.log2(max(int(hi[-1] - lo[-1]), 2)) + 1)))
        cut = len(codes) - apart
        lists = [self.owner[x:y] for x, y in zip(lo[:cut].tolist(), hi[:cut].tolist(), strict=True)]
        if sum(map(len, lists)) <= DENSE * self.members:
            found = heap_merge([x.tolist() for x in lists], need - apart)
            at, hits = (np.array(x, dtype=np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        else:  # lists that nearly all members fill: counting in an array is the cheaper merge
            hits = np.bincount(np.concatenate(lists), minlength=self.members)
            (at,) = np.nonzero(hits >= need - apart)
            hits = hits[at]
        for k in range(cut, len(codes), 64):
            probed = codes[k : k + 64]
            wanted = (probed[:, None] * self.members + at).ravel()
            spot = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hits = hits + (self.keys[spot] == wanted).reshape(len(probed), -1).sum(axis=0)
            stay = hits >= need - max(0, len(codes) - k - 64)
            at, hits = at[stay], hits[stay]
        return at, hits


def link_cells(cells: DataFrame) -> DataFrame:
    """cells: grp, i, j, cls, blk, shingles. Rows (u, v) that join the classes which links of a cell connect, and rows
    (cls, n) of how many links each class has there. A cell i = j links its classes with each other, another one those of
    its two blocks."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("cls")
        part = part.assign(size=part["shingles"].map(len)).sort_values(["size", "cls"], ignore_index=True)
        m, sizes, keys = len(part), part["size"].to_numpy(), part["cls"].to_numpy()
        owner = np.repeat(np.arange(m), sizes)
        _, code = np.unique(np.concatenate(part["shingles"].to_list()), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(sizes)])
        alone = part["i"].iat[0] == part["j"].iat[0]
        held = np.ones(m, dtype=bool) if alone else (part["blk"] == part["i"]).to_numpy()
        index = Index(code[held[owner]], owner[held[owner]], m)
        label, n_links = np.arange(m), np.zeros(m, dtype=np.int64)
        for a in range(m) if alone else np.flatnonzero(~held):
            # Alone, a class looks for those after it, which are no smaller: |A and B| >= 0.75 / 1.75 * (|A| + |B|).
            need = -(-2 * PERCENT * sizes[a] // (100 + PERCENT)) if alone else -(-PERCENT * sizes[a] // 100)
            found, hits = index.divide_skip(code[at[a] : at[a + 1]], max(1, int(need)), a if alone else -1)
            found = found[100 * hits >= PERCENT * (sizes[a] + sizes[found] - hits)]
            if len(found):
                n_links[a] += len(found)
                n_links[found] += 1
                some = np.unique(np.append(label[found], label[a]))
                if len(some) > 1:
                    label[np.isin(label, some)] = some[0]
        (moved,) = np.nonzero(label != np.arange(m))
        (some,) = np.nonzero(n_links)
        edges = pd.DataFrame({"u": keys[label[moved]], "v": keys[moved], "cls": pd.NA, "n": pd.NA})
        return pd.concat([edges, pd.DataFrame({"u": pd.NA, "v": pd.NA, "cls": keys[some], "n": n_links[some]})]).astype("Int64")

    return cells.groupBy("grp", "i", "j").applyInPandas(run, "u long, v long, cls long, n long")


def set_members(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, n, shingles of the wanted classes (cls, doc), from the texts of their first documents; a class without any
    doc_id is looked for among the documents without."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                values, counts = shingle_sets(part.column(1))
                own = _classes(values, counts)
                asked = part.column(0)
                # A repeated doc_id may have another text.
                right = pc.fill_null(pc.equal(asked, _signed(own)), True)
                cols = [_signed(own), pa.array(counts, pa.int32()), _lists(values, counts)]
                yield pa.RecordBatch.from_arrays(cols, names=["cls", "n", "shingles"]).filter(right)

    kind = "cls long, n int, shingles array<long>"
    named = docs.select("doc_id", "text").join(wanted.where("doc is not null"), F.col("doc_id") == F.col("doc"))
    named = named.select("cls", "text").mapInArrow(listed, kind)
    bare = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("cls"), "text").mapInArrow(listed, kind)
    return named.union(bare.join(wanted.where("doc is null").select("cls"), "cls"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id (least doc_id reachable by links), class_id (least
    doc_id with the same set), n_links (classes that the class links with)."""
    measured = stash(measure_sets(docs), "sets")
    sets = measured.where("not often")
    often = measured.where("often").groupBy("cls").agg(F.sum("n").alias("n")).where("n >= 16")
    steer = often.orderBy(F.desc("n"), "cls").limit(STEER).toPandas()  # bounded by STEER
    hashes = steer["cls"].to_numpy(dtype=np.int64).view(np.uint64)
    ranks = np.arange(len(steer), 0, -1)
    order = np.argsort(hashes)
    long_lists = np.rec.fromarrays([hashes[order], ranks[order]], names="h,rank")
    classes = stash(sets.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n")), "classes")
    entries = classes.agg(F.sum("n") * (1 - PERCENT / 100 + 1 / HITS)).first()[0] or 0
    merged = stash(merge_lists(postings(docs, long_lists, 256 + int(entries / BUCKET))), "merged")
    # A class may meet others in long lists too: in how many of its own it stands bounds those with any partner.
    long_hits = merged.where("hot").groupBy(F.col("b").alias("cls")).agg(F.sum("hits").alias("h"))
    sized = stash(classes.join(long_hits, "cls", "left").select("cls", "n", F.coalesce("h", F.lit(0)).alias("h")), "sized")
    need = lambda n: F.greatest(F.lit(1), F.floor(n / HITS))
    pairs = merged.where("not hot").groupBy("a", "b").agg(F.sum("hits").alias("hits"))
    pairs = pairs.join(sized.toDF("a", "na", "ha"), "a").join(sized.toDF("b", "nb", "hb"), "b")
    enough = F.col("hits") + F.least("ha", "hb") >= F.least(need(F.col("na")), need(F.col("nb")))
    pairs = pairs.where(enough & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))).select("a", "b")
    # Pairs without a meeting in short lists have all in long ones; the smaller set's need is at least 0.75 of the larger's.
    alive = sized.where((F.col("h") > 0) & (F.col("h") >= F.floor(0.75 * F.col("n") / HITS))).select("cls")
    stars = merged.where("hot").join(alive, F.col("b") == F.col("cls"), "left_semi").select("a", "b")
    meetings = stash(pairs.union(stars).toDF("u", "v"), "meetings")
    release(merged)
    groups = stash(components(meetings).toDF("cls", "grp"), "groups")
    # Classes that only lead a long list may be alone now.
    wanted = groups.join(classes.select("cls", "doc"), "cls").select("cls", "doc")
    members = stash(set_members(docs, wanted), "members")
    release(meetings)
    count = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    cut = lambda groups: groups.join(members.select("cls", "n"), "cls").groupBy("grp").agg(count.alias("blocks"), F.sum("n").alias("load"))
    wide = stash(cut(groups).where("blocks > 1").select("grp"), "wide")
    large = stash(groups.join(wide, "grp", "left_semi").select("cls", "grp"), "groups")
    groups = stash(groups.join(wide, "grp", "left_anti").select("cls", "grp").union(regroup(members, large)), "groups")
    blocks = stash(cut(groups), "blocks")
    load = blocks.where("blocks = 1").agg(F.sum("load")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("grp"), F.lit(1 + load // SHARED))
    dealt = members.join(groups, "cls").join(blocks, "grp").withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    cells = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # Groups of one block share cells i = j = -1.
    single = F.col("blocks") == 1
    cells = cells.select(
        F.when(single, bundle).otherwise(F.col("grp")).alias("grp"), F.when(single, -1).otherwise(F.least("blk", "o")).alias("i"),
        F.when(single, -1).otherwise(F.greatest("blk", "o")).alias("j"), "cls", "blk", "shingles",
    )
    found = stash(link_cells(cells), "found")
    release(members, blocks)
    n_links = found.where("cls is not null").groupBy("cls").agg(F.sum("n").alias("n_links"))
    joined = stash(components(found.where("cls is null").select("u", "v")), "joined").toDF("cls", "head")
    named = stash(classes.select("cls", "doc").join(joined, "cls", "left").withColumn("head", F.coalesce("head", "cls")), "named")
    least = named.groupBy("head").agg(F.min("doc").alias("component"))
    named = named.join(least, "head").join(n_links, "cls", "left").select("cls", F.col("doc").alias("class_id"), "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sets.join(stash(named, "classes"), "cls", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the least doc_id. Documents without doc_id stay."""
    first = near_duplicates(docs).where("doc_id = component_id").select("doc_id")
    return docs.join(first, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
