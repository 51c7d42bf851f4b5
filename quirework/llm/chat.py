"""Chat formatting as prefix trees: shared opening turns are emitted once, depth first.

Conversations that begin with the same turns share those nodes.  A node is named by a chained digest of
its path, so nodes are found by grouping and no tree is ever built in one place.  Depth-first order is the
order of conversations by their paths: each conversation emits the nodes that none before it has, in turn
order.  A node's position ids go on from its parent's, and the intervals of emitted ids that it may
attend to are its ancestors', merged where they touch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .storage import checkpoint, running


def render(role: str, text: str) -> str:
    """A turn as text."""
    return f"<|{role}|>\n{text}\n<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, role, text, node, path: the turns of each conversation in order, without exact repeats.

    ``node`` names the path up to a turn by a chained digest; ``path`` (on a conversation's last turn only) lists
    its nodes.  Texts are shuffled once, by conversation; repeats, order and digests need no other shuffle.
    """
    clean = conversations.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    mark = F.substring(F.unhex(F.sha2(F.to_json(F.struct("role", "text")), 256)), 1, 16)
    turns = clean.repartition("conv_id").distinct().withColumns({"depth": F.row_number().over(order) - 1, "more": F.lead("turn").over(order).isNotNull()}).withColumn("mark", mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come conversation by conversation, in order."""
        node, path = b"", []
        for batch in batches:
            nodes, paths = [], []
            for depth, more, mark in zip(*(batch.column(k).to_pylist() for k in (1, 4, 5)), strict=True):
                if depth == 0:
                    node, path = b"", []
                node = hashlib.blake2b(node + mark, digest_size=16).digest()
                path.append(node)
                nodes.append(node)
                paths.append(None if more else path)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(nodes, pa.binary()), pa.array(paths, pa.list_(pa.binary()))], ["conv_id", "depth", "role", "text", "node", "path"])

    return turns.select("conv_id", "depth", "role", "text", "more", "mark").mapInArrow(run, "conv_id long, depth int, role string, text string, node binary, path array<binary>")


def format_chats(conversations: DataFrame, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """One row for each node of every tree, in the columns

    tree_id (lowest conv_id of the tree), start (offset of the node's ids in the tree's emitted sequence),
    n_ids, ids (little-endian), depth, position (position id of the first; the others follow), attends
    (half-open intervals of emitted offsets of all ancestors; within itself a node is causal), conv_id (the
    first conversation, in emission order, that has the node) and conversations (how many have it).

    Texts are shuffled twice (by conversation, and to their nodes) and ids once, at the end; between, only
    nodes' names and numbers travel.  Each node's text is tokenised once.

    Defined cases: rows with a null conv_id or turn are left out; a null role or text counts as empty; exact
    repeats of a row count once and rows that tie on (conv_id, turn) follow each other by role and text;
    identical conversations are one path; turn numbers may have gaps; other columns are not read.
    """
    turns = checkpoint(_turns(conversations))
    paths = turns.where("path is not null").select("conv_id", F.get("path", 0).alias("tree"), "path")
    # ranks run on over all trees: a tree that every conversation shares is spread over tasks all the same
    ranked = checkpoint(running(paths, ["path", "conv_id"], F.lit(1), "rank"))
    steps = ranked.select("conv_id", "rank", F.posexplode("path").alias("depth", "node"))
    nodes = steps.groupBy("node").agg(F.min("depth").alias("depth"), F.min(F.struct("rank", "conv_id")).alias("first"), F.count(F.lit(1)).alias("conversations"))
    nodes = nodes.select("node", "depth", F.col("first.rank").alias("rank"), F.col("first.conv_id").alias("conv_id"), "conversations")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [tokens.encode(render(r, t), tokenizer) for r, t in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)]
            extra = [pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *extra], ["node", "depth", "rank", "conv_id", "conversations", "ids", "n_ids"])

    texts = nodes.join(turns.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"]).select("node", "depth", "rank", "conv_id", "conversations", "role", "text")
    coded = checkpoint(texts.mapInArrow(encode, "node binary, depth int, rank long, conv_id long, conversations long, ids binary, n_ids int"))
    light = coded.select("node", "depth", "rank", "n_ids")
    # offsets in two steps: running sums over conversations, less those at the tree's first, then over a conversation's nodes
    own = light.groupBy("rank").agg(F.sum(F.col("n_ids").cast("long")).alias("total"))
    summed = checkpoint(running(own, ["rank"], F.col("total"), "before").join(ranked.select("rank", "tree"), "rank"))
    trees = summed.groupBy("tree").agg(F.min("before").alias("first")).join(paths.groupBy("tree").agg(F.min("conv_id").alias("tree_id")), "tree")
    before = summed.join(trees, "tree").select("rank", "tree_id", (F.col("before") - F.col("first")).alias("base"))
    inside = F.sum(F.col("n_ids").cast("long")).over(W.partitionBy("rank").orderBy("depth")) - F.col("n_ids")
    placed = checkpoint(light.withColumn("inside", inside).join(before, "rank").select("node", "depth", "rank", "n_ids", "tree_id", (F.col("base") + F.col("inside")).alias("start")))
    spans = placed.select("node", "start", "n_ids", F.col("rank").alias("owner"))
    emitting = summed.select("rank")
    lines = steps.join(emitting, "rank").select("rank", "depth", "node").join(spans, "node").groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("depth", "start", "n_ids", "owner"))).alias("line"))

    def relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out: list[tuple] = []
            for rank, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: list[list[int]] = []
                position = 0
                for step in line:
                    if step["owner"] == rank:
                        out.append((rank, step["depth"], position, [{"start": a, "end": b} for a, b in seen]))
                    if seen and seen[-1][1] == step["start"]:
                        seen[-1][1] += step["n_ids"]
                    else:
                        seen.append([step["start"], step["start"] + step["n_ids"]])
                    position += step["n_ids"]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), interval]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["rank", "depth", "position", "attends"])

    related = lines.mapInArrow(relate, "rank long, depth int, position long, attends array<struct<start: long, end: long>>")
    told = placed.select("rank", "depth", "tree_id", "start").join(related, ["rank", "depth"])
    return coded.join(told, ["rank", "depth"]).select("tree_id", "start", "n_ids", "ids", "depth", "position", "attends", "conv_id", "conversations")


def replay(formatted: list[dict], tree_id: int, start: int, kind: np.dtype) -> bytes:
    """The ids that the node at ``start`` sees, ancestors first and itself last (for checks and readers)."""
    nodes = {r["start"]: r for r in formatted if r["tree_id"] == tree_id}
    flat = b"".join(nodes[s]["ids"] for s in sorted(nodes))
    node = nodes[start]
    size = kind.itemsize
    return b"".join(flat[i["start"] * size : i["end"] * size] for i in node["attends"]) + node["ids"]
