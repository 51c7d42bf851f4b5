"""Packing by bounded-space online best fit.

Each task keeps at most ``open_windows`` windows.  A piece goes into the open window with the least
space that holds it (the oldest of equals); if none does, a new one is opened, and where all places are
taken the fullest (the oldest of equals) is emitted first.  What is open at a task's end is merged with
that of ``fan_in`` neighbouring tasks by packing its pieces again, best fit decreasing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .packing import ROW, ROW_ARROW, Piece, Window, best_fit_decreasing, pieces_of, row
from .storage import checkpoint

WIDTH, OPEN_WINDOWS, FAN_IN = 2048, 16, 64


def place(open_: list[Window], piece: Piece, width: int, open_windows: int) -> Window | None:
    """Put ``piece`` into one of ``open_`` (oldest first); returns the window that had to be emitted."""
    size, best = len(piece.ids), None
    for w in open_:
        if w.free >= size and (best is None or w.free < best.free):
            best = w
    out = None
    if best is None:
        if len(open_) >= open_windows:
            out = min(open_, key=lambda w: w.free)
            open_.remove(out)
        best = Window(width)
        open_.append(best)
    best.add(piece)
    return out


def pack_windows(docs: DataFrame, width: int = WIDTH, open_windows: int = OPEN_WINDOWS, tokenizer: str = tokens.TOKENIZER, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each window of at most ``width`` ids: the columns of ``packing.pack``, without padding.

    Pieces of exactly ``width`` ids are windows at once.  Only left-over windows are shuffled, at most
    ``open_windows`` a task, in groups of ``fan_in`` tasks, so the merge is spread as the input is.  The
    texts are tokenised once: the first step's windows are checkpointed and read for both branches.

    Defined cases: as for ``packing.pack``; the windows, but not the ids, depend on the cut into tasks.
    """
    if width < 1 or open_windows < 1 or fan_in < 1:
        raise ValueError("width, open_windows and fan_in must be 1 or more")
    names = [*ROW_ARROW.names, "left_over", "task"]
    arrow = ROW_ARROW.append(pa.field("left_over", pa.bool_())).append(pa.field("task", pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, task = tokens.id_type(tokenizer), TaskContext.get().partitionId()
        open_: list[Window] = []
        done: list[dict] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in pieces_of(doc_id, tokens.encode(text.as_py(), tokenizer), width):
                    out = Window(0, [piece]) if len(piece.ids) == width else place(open_, piece, width, open_windows)
                    if out is not None:
                        done.append(row(out, None, kind) | {"left_over": False, "task": task})
                if len(done) >= 2048:
                    yield pa.RecordBatch.from_pylist(done, arrow)
                    done.clear()
        done += [row(w, None, kind) | {"left_over": True, "task": task} for w in open_]
        yield pa.RecordBatch.from_pylist(done, arrow)

    def merge(table: pa.Table) -> pa.Table:
        kind = tokens.id_type(tokenizer)
        pieces = []
        for r in table.sort_by([("task", "ascending")]).to_pylist():
            ids = np.frombuffer(r["ids"], kind)
            pieces += [Piece(d, s, ids[a:b]) for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True)]
        pieces.sort(key=lambda p: (-len(p.ids), p.doc_id is None, p.doc_id or 0, p.start))
        return pa.Table.from_pylist([row(w, None, kind) for w in best_fit_decreasing(pieces, width)], ROW_ARROW)

    source = docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("long"), "text")
    first = checkpoint(source.mapInArrow(run, f"{ROW}, left_over boolean, task int"))
    merged = first.where("left_over").withColumn("bundle", F.floor(F.col("task") / fan_in)).groupBy("bundle").applyInArrow(merge, ROW)
    return first.where("not left_over").select(*names[:-2]).unionByName(merged)
