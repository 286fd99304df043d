"""Token counts, token files and packing."""

from __future__ import annotations

import json
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Counter, Encoder, of
from .common import gathered, hash_rank, shared_root, written

# ---- counts ------------------------------------------------------------------------------------


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs.

    Tokens by heap-and-linked-list merging (bpe.Counter), no identifiers are made. Null text is empty: no
    bytes, no tokens. No shuffle; each row is counted where it is read, rows alike get rows alike,
    an empty table gives an empty result, other columns aren't read.
    """

    def run(batches):
        counter = of(Counter, path)
        for b in batches:
            texts = b.column(1)
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            n = pa.array(counter.count_all(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, n, pa.compute.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


# ---- token files -------------------------------------------------------------------------------

MAGIC = b"LOOMTOK2"


def _file_system(uri: str):
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, root: str | None = None, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode all texts, append end_id to each and write the identifiers in ascending doc_id order; returns the folder.

    A folder holds parts in order. ``part.bin`` is flat little-endian unsigned integers (16 bits if the
    vocabulary fits, else 32); ``part.idx`` is the magic, the width in bytes and the number of documents
    (64 bits each), the doc_ids, documents + 1 64-bit offsets in identifiers, then a byte for each document, 1 if
    its doc_id is null (and 0 stands in its place). ``manifest.json`` names
    the parts and, by prefix sums of their sizes, the first document and identifier of each. A part's
    name is that of its task attempt and only finished attempts are in the manifest, so a task that is
    run again, or twice, does no harm. root must be in a folder that all executors see.

    Null text is empty: its document is the end_id alone. Equal doc_ids stand by the hash of their text, null ones
    first, and come back null. An empty table gives a folder without parts.
    """
    spark = docs.sparkSession
    root = root or f"{shared_root(spark)}/loomtext-{uuid.uuid4().hex}/tokens"

    def run(batches):
        encoder, fs, at = of(Encoder, path), *_file_system(root)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        ids, nulls, offsets, written_ids, out = [], [], [np.zeros(1, "<u8")], 0, None
        for b in batches:
            if out is None:
                fs.create_dir(at, recursive=True)
                out = fs.open_output_stream(f"{at}/{name}.bin")
            ids.append(np.asarray(pa.compute.fill_null(b.column(0), 0)).astype("<i8"))
            nulls.append(np.asarray(pa.compute.is_null(b.column(0))).astype(np.uint8))
            for flat, ends in encoder.encode_all(b.column(1), end_id):
                out.write(flat.tobytes())
                offsets.append((ends + written_ids).astype("<u8"))
                written_ids += len(flat)
        if out is not None:
            out.close()
            n = sum(map(len, ids))
            with fs.open_output_stream(f"{at}/{name}.idx") as f:
                f.write(MAGIC + np.array([encoder.dtype.itemsize, n], "<u8").tobytes() + b"".join(x.tobytes() for x in [*ids, *offsets, *nulls]))
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "n_docs": [n], "n_ids": [written_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    parts = sorted(placed.mapInArrow(run, "part long, name string, n_docs long, n_ids long").collect())  # a row for each partition
    manifest, doc, first = [], 0, 0
    for p in parts:
        manifest.append({"name": p["name"], "n_docs": p["n_docs"], "n_ids": p["n_ids"], "first_doc": doc, "first_id": first})
        doc, first = doc + p["n_docs"], first + p["n_ids"]
    fs, at = _file_system(root)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return root


def open_part(root: str, name: str) -> tuple[np.ma.MaskedArray, np.ndarray, np.ndarray]:
    """(doc_ids, null ones masked; offsets; identifiers) of a part, memory-mapped where the folder is a file system's."""
    fs, at = _file_system(root)
    with fs.open_input_stream(f"{at}/{name}.idx") as f:
        head = f.read()
    if head[:8] != MAGIC:
        raise ValueError(f"{name}.idx is not an index of tokens")
    width, n = np.frombuffer(head, "<u8", 2, 8)
    width, n = int(width), int(n)
    ids = np.ma.array(np.frombuffer(head, "<i8", n, 24), mask=np.frombuffer(head, np.uint8, n, 32 + 16 * n) > 0)
    offsets = np.frombuffer(head, "<u8", n + 1, 24 + 8 * n)
    kind = {2: "<u2", 4: "<u4"}[width]
    if isinstance(fs, pa.fs.LocalFileSystem):
        return ids, offsets, np.memmap(f"{at}/{name}.bin", kind, "r")
    with fs.open_input_file(f"{at}/{name}.bin") as f:
        return ids, offsets, np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document of a folder; start counts the identifiers of all before it.

    The checksum is that of the identifiers as little-endian unsigned 32-bit integers.
    """
    fs, at = _file_system(root)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        n = len(json.loads(f.read()))

    def run(batches):
        for b in batches:
            fs, at = _file_system(root)
            with fs.open_input_stream(f"{at}/manifest.json") as f:
                manifest = json.loads(f.read())
            for k in b.column(0).to_pylist():
                part = manifest[k]
                ids, offsets, flat = open_part(root, part["name"])
                step = 4096
                masked = np.ma.getmaskarray(ids)
                for i in range(0, len(ids), step):
                    o = offsets[i : i + step + 1].astype(np.int64)
                    crc = [zlib.crc32(flat[a:z].astype("<u4").tobytes()) for a, z in zip(o[:-1], o[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids.data[i : i + step], mask=masked[i : i + step]), "start": o[:-1] + part["first_id"], "n_tokens": np.diff(o), "ids_crc32": np.array(crc, np.int64)})

    return spark.range(0, n, 1, max(n, 1)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


# ---- packing -----------------------------------------------------------------------------------


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first over a histogram of lengths: [(number of sequences, lengths in them)].

    Lengths are placed longest first, each into the pattern with the most room left that has enough for
    it; a pattern of more sequences than are needed is split. The result is that of placing piece by piece; work depends on
    the number of distinct lengths, not on the number of pieces.
    """
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        widest = max((r for r, x in room.items() if x), default=0)
        for r in range(widest, length - 1, -1):
            while left and room.get(r):
                n, pattern = room[r].pop()
                used = min(n, left)
                if n > used:
                    room[r].append((n - used, pattern))
                room[r - length].append((used, [*pattern, length]))
                left -= used
            if not left:
                break
        fit = size // length  # of what is left, each goes to the shortest pack, which is the one just opened while it has room
        if left >= fit:
            room[size - fit * length].append((left // fit, [length] * fit))
        if left % fit:
            room[size - left % fit * length].append((1, [length] * (left % fit)))
    return [x for r in sorted(room) for x in room[r]]


def seats(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of its runs of seats, in rank order."""
    runs, taken, base = defaultdict(list), defaultdict(int), 0
    for n, lengths in patterns:
        offset = 0
        for x in lengths:
            runs[x].append((taken[x], base, offset))
            taken[x] += n
            offset += x
        base += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def pieces(docs: DataFrame, size: int, end_id: int, path: str | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the documents' identifiers cut every size."""

    def run(batches):
        encoder = of(Encoder, path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for b in batches:
            at = 0
            for flat, ends in encoder.encode_all(b.column(1), end_id):
                tokens = np.diff(ends, prepend=0)
                cuts = -(-tokens // size)
                row = np.repeat(np.arange(len(ends)), cuts)
                start = size * gathered(np.zeros(len(ends), np.int64), cuts)
                length = np.minimum(size, tokens[row] - start)
                wide, begin = flat.astype("<u4"), (ends - tokens)[row] + start
                crc = [zlib.crc32(wide[a:z]) for a, z in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + at)), *map(pa.array, (start, length, np.array(crc, np.int64), tokens[row]))], names=names)
                at += len(ends)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most size tokens: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Each document's identifiers, with end_id, are cut every size; the counts of the pieces' lengths (at
    most size numbers, all that the driver sees) are packed by pack_histogram, and the piece of rank r
    among those of its length takes the r-th seat of that length. Ranks are by hash_rank, so a length
    that a third of the pieces have is ranked in many tasks. sequence_id runs from 0 without gaps.

    Null text is empty: end_id alone. Rows alike are packed each on its own. An empty table gives an empty
    result.
    """
    cut = written(pieces(docs, size, end_id, path, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(seats(pack_histogram(counts, size)))  # bounded: patterns of size lengths
    ranked = hash_rank(cut.withColumn("h", F.xxhash64("doc_id", "start", "ids_crc32")), "length", "h", ["doc_id", "start"], sum(counts.values()), "r").drop("h", "r_of")

    def run(batches):
        table = places.value
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "r"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                rows = order[a:z]
                first, base, offset = table[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], "right") - 1
                seq[rows], off[rows] = base[k] + rank[rows] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(seq), pa.array(off)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
