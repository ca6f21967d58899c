"""Packing documents into sequences by shortest-pack-first over the length histogram.

Documents are tokenised in tasks and cut: full pieces of ``size`` tokens are sequences by themselves, and the rest of a
document is one piece. Only the histogram of rest lengths (at most ``size`` numbers) reaches the driver. There lengths
are placed longest first, each into the shortest packs, those with the most room, or into new ones where even they have
too little; this updates counts of packing patterns instead of single packs. The patterns go back to the pieces by rank: the r-th piece of a length takes the
r-th slot that the patterns hold for this length. In the pipeline pieces rank by the place of their document in the mix
and sequences are numbered by their first piece's place; else hashes of the pieces order them.

Null texts count as empty: one piece with the closing id. Repeated rows are packed as often as they occur, whether or
not they repeat or lack a doc_id; equal pieces of equal ids are interchangeable. Empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rank_in_group, stash, table

#: The token that closes each document.
CLOSE = 0
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@functools.cache
def _tokenizers(name: str):
    """The tokenizer of the JSON file, and a faster library's reading of the same vocabulary, with its token lengths."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json")), fast, lengths


#: Kinds of bytes where texts may be cut.
GAP, SPACE, LEAD, HIGH, ODD = 1, 2, 4, 8, 16
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[10, 32]] |= GAP
KINDS[[*range(9, 14), *range(28, 33)]] |= SPACE
KINDS[[0xC2, 0x80, 0x81, 0x9A]] |= LEAD
KINDS[0x80:] |= HIGH
KINDS[[0xC2, 0xE1, 0xE2, 0xE3]] |= ODD


def token_ids(texts: list[str], name: str = "byte_bpe_50k") -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and each text's number of ids. The tokenizer never joins what stands before a single
    white space between two other characters with what follows, so texts are cut there and each distinct
    piece is encoded once. Texts that start or end with white space or unusual characters, or name the special token, are encoded whole."""
    whole, fast, lengths = _tokenizers(name)
    # Edges of a text must be letters or marks that no rule for cuts mistakes for white space.
    edge = lambda c: "\x20" < c < "\x7f" or "\xc0" <= c < "\u0250"
    plain = [bool(t) and edge(t[0]) and edge(t[-1]) and SPECIAL not in t for t in texts]
    data = "\n" + "\n".join(t for t, p in zip(texts, plain, strict=True) if p)
    raw = np.frombuffer(data.encode(), dtype=np.uint8)
    if len(raw) > 1:
        kind = KINDS[raw]
        cut = (kind & GAP).astype(bool)
        # No cut after white space, ASCII or the last byte of a longer code (taken widely), nor before either.
        wide = np.zeros(len(raw), dtype=bool)
        wide[1:] = ((kind[:-1] & LEAD) != 0) & ((kind[1:] & HIGH) != 0)
        cut[1:] &= ((kind[:-1] & SPACE) == 0) & ~wide[:-1]
        cut[:-1] &= (kind[1:] & (SPACE | ODD)) == 0
        cut[0] = True
        at = np.append(np.flatnonzero(cut), len(raw)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw)).dictionary_encode()
        # The distinct pieces, each starting with white space, are encoded as one text and cut apart again.
        distinct = pieces.dictionary
        ids = np.asarray(fast.encode_ordinary("".join(distinct.to_pylist())), dtype=np.uint32)
        ends = np.cumsum(lengths[ids])
        stops = np.searchsorted(ends, np.cumsum(pc.binary_length(distinct).to_numpy())) + 1
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(ids)).take(pieces.indices)
        flat, total = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        # A text's first piece starts at the line break before it, whose id is not the text's own.
        sizes = np.array([len(t.encode()) for t, p in zip(texts, plain, strict=True) if p], dtype=np.int64)
        first = np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]))
        heads = total[first]
        counts = np.diff(np.append(heads, total[-1])) - 1
        keep = np.ones(len(flat), dtype=bool)
        keep[heads] = False
        flat = flat[keep]
    else:
        flat, counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    if all(plain):
        return flat, counts
    parts, out, k, at_id = [], np.zeros(len(texts), dtype=np.int64), 0, 0
    for i, (t, p) in enumerate(zip(texts, plain, strict=True)):
        if p:
            parts.append(flat[at_id : at_id + counts[k]])
            at_id, k = at_id + counts[k], k + 1
        else:
            parts.append(np.asarray(whole.encode(t, add_special_tokens=False).ids, dtype=np.uint32))
        out[i] = len(parts[-1])
    return np.concatenate(parts) if parts else flat, out


def in_order(docs: DataFrame, name: str = "at") -> DataFrame:
    """Adds ``name`` (long): the row's place from 0 in the order of the files that docs are read from, and of their rows.
    Other tables are written first, in the order of their partitions. Files reach the driver with their sizes only."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = stash(docs, "ordered")
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    number = F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).try_cast("long")
    sizes = docs.groupBy(file.alias("_file"), number.alias("_number")).agg((F.max(row) + 1).alias("n")).orderBy("_number", "_file").collect()
    starts, at = [], 0
    for f in sizes:
        starts.append((f["_file"], at))
        at += f["n"]
    starts = docs.sparkSession.createDataFrame(starts, "_file string, _start long")
    placed = docs.select("*", file.alias("_file"), row.alias("_row")).join(F.broadcast(starts), "_file")
    return placed.withColumn(name, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def cut_documents(docs: DataFrame, size: int = 1024, tokenizer: str = "byte_bpe_50k", batch_chars: int = 8_000_000, at: str | None = None) -> DataFrame:
    """docs: doc_id, text. Returns the pieces, full ones and rests, with a checksum of their ids; at: a column of docs that
    pieces keep."""

    def pieces(ids: list[int], texts: list[str], places: list[list[int]]) -> pa.RecordBatch:
        flat, counts = token_ids(texts, tokenizer)
        rows, begin = [], 0
        for doc, n, *place in zip(ids, counts.tolist(), *places, strict=True):
            own = np.append(flat[begin : begin + n], np.uint32(CLOSE)).astype("<u4").tobytes()
            begin += n
            rows += [(doc, s, min(size, n + 1 - s), zlib.crc32(own[4 * s : 4 * (s + size)]), n + 1, *place) for s in range(0, n + 1, size)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[*["doc_id", "start", "length", "ids_crc32", "doc_tokens"], *kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            for part in np.split(np.arange(len(ids)), np.searchsorted(sizes, np.arange(batch_chars, sizes[-1] if len(sizes) else 0, batch_chars))):
                if len(part):
                    texts = batch.column(1).slice(part[0], len(part)).to_pylist()
                    places = [c.slice(part[0], len(part)).to_pylist() for c in batch.columns[2:]]
                    yield pieces(ids[part[0] : part[-1] + 1], [t or "" for t in texts], places)

    kept = [at] if at else []
    return docs.select("doc_id", "text", *kept).mapInArrow(run, ", ".join([PIECES, *[f"{c} long" for c in kept]]))


def pack_histogram(histogram: dict[int, int], size: int = 1024) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first: (count, lengths) of each packing pattern. Lengths are placed longest first, each into
    the shortest open packs; where more pieces than such packs are left, the rest go on to the next shortest, and where
    even the shortest has too little room, to new packs. There are at most as many patterns as placements, which the
    number of lengths bounds, not the number of pieces."""
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if not rooms or rooms[-1] < length:
                # New packs take one piece each; pieces of this length that are left fill them up before more are opened.
                fit = size // length
                made = [(left // fit, [length] * fit)] if left >= fit else []
                made += [(1, [length] * (left % fit))] if left % fit else []
                for n, pattern in made:
                    _put(open_, rooms, size - sum(pattern), n, pattern)
                left = 0
                continue
            room = rooms[-1]
            count, pattern = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[-1]
            used = min(count, left)
            left -= used
            _put(open_, rooms, room - length, used, [*pattern, length])
            if used < count:
                _put(open_, rooms, room, count - used, pattern)
    return [x for room in rooms for x in open_[room]]


def _put(open_: dict, rooms: list[int], room: int, count: int, pattern: list[int]) -> None:
    if room not in open_:
        bisect.insort(rooms, room)
    open_.setdefault(room, []).append((count, pattern))


def pack(pieces: DataFrame, size: int = 1024, at: str | None = None) -> DataFrame:
    """Adds sequence_id (gapless from 0) and offset to pieces; full pieces come first, or with the column ``at`` pieces
    of a length and sequences go by it."""
    spark = pieces.sparkSession
    pieces = stash(pieces, "pieces")
    counts = dict(pieces.groupBy("length").count().collect())  # at most ``size`` rows
    patterns = pack_histogram(counts, size)
    slots, ranks, sequence = [], dict.fromkeys(counts, 0), 0
    for count, lengths in patterns:
        filled = 0
        groups: list[tuple[int, list[int]]] = []  # equal lengths follow each other
        for x in lengths:
            if groups and groups[-1][0] == x:
                groups[-1][1].append(filled)
            else:
                groups.append((x, [filled]))
            filled += x
        for x, offsets in groups:
            m = len(offsets)
            slots.append((x, ranks[x], ranks[x] + count * m, sequence, m, offsets[0]))
            ranks[x] += count * m
        sequence += count
    cells = spark.createDataFrame(slots or [(0, 0, 0, 0, 1, 0)], "slot_length long, rank_from long, rank_to long, first_sequence long, per_sequence long, first_offset long")
    ranked = rank_in_group(pieces.withColumn("_id", F.struct("doc_id", "start")), "length", "_id", "_rank", at=at).drop("_id")
    # The slots are bounded by the number of lengths, so this side is small at any size of input.
    out = ranked.join(F.broadcast(cells), (F.col("length") == F.col("slot_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
    k = F.col("_rank") - F.col("rank_from")
    out = out.withColumn("sequence_id", F.col("first_sequence") + F.floor(k / F.col("per_sequence")))
    out = out.withColumn("offset", F.col("first_offset") + k % F.col("per_sequence") * F.col("length"))
    if at:
        out = stash(out.drop("_rank", *cells.columns), "packed")
        first = stash(out.groupBy("sequence_id").agg(F.min(at).alias("_at")).withColumn("_all", F.lit(0)), "sequences")
        named = rank_in_group(first, "_all", "sequence_id", "_number", rows_per_cell=100, at="_at").select("sequence_id", "_number")
        out = out.join(named, "sequence_id").withColumn("sequence_id", F.col("_number"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, ranked by the order of the files that the mix has written."""
    return pack(cut_documents(in_order(docs), at="at"), at="at")
