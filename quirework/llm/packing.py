"""Token-ID / binary output: best-fit-decreasing packing into fixed-width id matrices.

Documents are tokenised, cut losslessly into pieces of at most ``width`` ids, and packed: pieces in
order of falling length, each into the row whose free space is the smallest that still holds it.  That
row is found in a segment tree over free space, in ``log2(width)`` steps however many rows are open.
Every task packs what it reads, ``buffer_ids`` ids at a time, so nothing is shuffled and memory is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

WIDTH, BUFFER_IDS = 4096, 1 << 22
ROW = "ids binary, n_ids int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, doc_starts array<int>"
ROW_ARROW = pa.schema([("ids", pa.binary()), ("n_ids", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32()))])


@dataclass
class Piece:
    """``ids`` of a document from its ``start``-th id on."""

    doc_id: int | None
    start: int
    ids: np.ndarray


@dataclass
class Window:
    free: int
    pieces: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.free -= len(piece.ids)


def pieces_of(doc_id: int | None, ids: np.ndarray, width: int) -> Iterator[Piece]:
    for start in range(0, len(ids), width):
        yield Piece(doc_id, start, ids[start : start + width])


class FreeSpace:
    """Segment tree over amounts of free space; each leaf keeps the windows with exactly that much."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.any = bytearray(2 * self.size)
        self.at: dict[int, list[int]] = {}

    def put(self, free: int, window: int) -> None:
        self.at.setdefault(free, []).append(window)
        node = free + self.size
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, least: int) -> int | None:
        """Remove and return the window with the least free space of at least ``least``; the oldest put there last wins."""
        node, any_ = least + self.size, self.any
        while not any_[node]:  # up until a right neighbour has one, then down its left-most path
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if any_[2 * node] else 2 * node + 1
        free = node - self.size
        window = self.at[free].pop()
        if not self.at[free]:
            any_[node] = 0
            node >>= 1
            while node and not (any_[2 * node] or any_[2 * node + 1]):
                any_[node] = 0
                node >>= 1
        return window


def best_fit_decreasing(pieces: Iterable[Piece], width: int) -> list[Window]:
    """Windows in the order they were opened; equal lengths are placed in the order given."""
    windows: list[Window] = []
    space = FreeSpace(width)
    for piece in sorted(pieces, key=lambda p: -len(p.ids)):
        at = space.take(len(piece.ids))
        if at is None:
            at = len(windows)
            windows.append(Window(width))
        windows[at].add(piece)
        if windows[at].free:
            space.put(windows[at].free, at)
    return windows


def row(window: Window, width: int | None, kind: np.dtype) -> dict:
    """A window as an output row; ``width`` pads the ids with zeros to a matrix row."""
    lengths = [len(p.ids) for p in window.pieces]
    ends = np.cumsum([0, *lengths]).tolist()
    ids = b"".join(p.ids.tobytes() for p in window.pieces)
    if width:
        ids += bytes(width * kind.itemsize - len(ids))
    return {"ids": ids, "n_ids": ends[-1], "cu_seqlens": ends, "position_resets": ends[:-1], "doc_ids": [p.doc_id for p in window.pieces], "doc_starts": [p.start for p in window.pieces]}


def pack(docs: DataFrame, width: int = WIDTH, tokenizer: str = tokens.TOKENIZER, buffer_ids: int = BUFFER_IDS) -> DataFrame:
    """One row for each packed matrix row of ``width`` ids.

    ``ids``: little-endian ids (two bytes each if the vocabulary allows), padded with zeros after ``n_ids``;
    ``cu_seqlens``: 0 and the end of each piece, so attention stays within pieces; ``position_resets``:
    where position ids start again from 0; ``doc_ids``/``doc_starts``: whose ids each piece holds, from
    which id on, so that documents can be put together again exactly.

    Defined cases: null and empty texts have no ids and appear in no row; a null doc_id is carried as
    null; repeated rows are packed as often as they occur; other columns are not read; an empty table
    gives no rows.  Which rows share a window depends on how the input is cut into tasks, never the ids.
    """
    if width < 1:
        raise ValueError("width must be 1 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = tokens.id_type(tokenizer)
        full: list[Window] = []
        part: list[Piece] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            windows = full + best_fit_decreasing(part, width)
            for k in range(0, len(windows), 2048):
                yield pa.RecordBatch.from_pylist([row(w, width, kind) for w in windows[k : k + 2048]], ROW_ARROW)
            full.clear()
            part.clear()
            held = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in pieces_of(doc_id, tokens.encode(text.as_py(), tokenizer), width):
                    if len(piece.ids) == width:
                        full.append(Window(0, [piece]))
                    else:
                        part.append(piece)
                    held += len(piece.ids)
                if held >= buffer_ids:
                    yield from flush()
        yield from flush()

    return docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROW)


def unpack(packed: DataFrame, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """(doc_id, text): the documents that went into ``packed``, from their ids; doc_ids must be unique."""
    width = tokens.id_type(tokenizer).itemsize
    piece = F.posexplode("doc_ids").alias("k", "doc_id")
    rows = packed.select("ids", "cu_seqlens", "doc_starts", piece).select(
        "doc_id", F.get("doc_starts", "k").alias("start"),
        F.substring(F.col("ids"), F.get("cu_seqlens", F.col("k")) * width + 1, (F.get("cu_seqlens", F.col("k") + 1) - F.get("cu_seqlens", F.col("k"))) * width).alias("part"),
    )
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = tokens.id_type(tokenizer)
        for batch in batches:
            texts = [tokens.decode(np.frombuffer(b"".join(p["part"] for p in parts), kind), tokenizer).decode() for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return whole.mapInArrow(run, "doc_id long, text string")


def write_matrices(packed: DataFrame, folder: str) -> DataFrame:
    """Write each partition as ``part-N.ids`` (the id matrix) and ``part-N.cu`` (int32: per row its count, then its cu_seqlens).

    Returns the manifest (ids_file, cu_file, rows, sha256).  A task writes under a name of its own attempt and
    then renames, so a lost executor or a second attempt leaves whole files of the same content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        name, attempt = f"{root}/part-{context.partitionId():06d}", context.taskAttemptId()
        digest, rows = hashlib.sha256(), 0
        with system.open_output_stream(f"{name}.ids.{attempt}") as ids, system.open_output_stream(f"{name}.cu.{attempt}") as cu:
            for batch in batches:
                for line, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids.write(line)
                    digest.update(line)
                    cu.write(np.array([len(ends), *ends], "<i4").tobytes())
                    rows += 1
        for end in ("ids", "cu"):
            system.move(f"{name}.{end}.{attempt}", f"{name}.{end}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.ids"]), pa.array([f"{name}.cu"]), pa.array([rows], pa.int64()), pa.array([digest.hexdigest()])], ["ids_file", "cu_file", "rows", "sha256"])

    return packed.select("ids", "cu_seqlens").mapInArrow(run, "ids_file string, cu_file string, rows long, sha256 string")
