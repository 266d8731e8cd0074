"""Operator 8, chat formatting with a prefix tree.

Template: a turn is ``<turn>### role: text</turn>`` and a line end. Inside role and text a
backslash goes before each backslash and before each control string (and each colon of a role), so
that any text can be read back. The text of an assistant turn is under the loss mask, without the
strings around it.

Turns are the nodes of a tree: a node is a turn with all turns before it, named by a chained hash.
Conversations that begin alike share nodes, and each node is written once. The smallest conversation
that holds a node owns it; what a conversation owns is the end of it, and hangs on a node of
another. The nodes lie in one stream of tokens, depth first: after a conversation's own nodes come
the branches from it, the deepest first. A node has its place in the stream, the position of its
first token in any conversation, and the stream intervals of all that stands before it there.

A conversation is read turn by turn and never held as a whole; branches of branches are resolved
by doubling, and the places in the stream by a running total over ranges of the order.

Cases: a null text or role is empty; rows of a null conv_id are one conversation; equal turn numbers
are ordered by role and text, and null numbers come first; repeated rows are turns as others; an
empty table gives an empty stream; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerprep.llm.token_shards import VOCABULARY, _encoder
from ledgerprep.operators.ordered import place, running_sum
from ledgerprep.session import Scratch

OPEN, SEPARATOR, CLOSE = "<turn>### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|</?turn>|### ")
_CONTROL_ROLE = re.compile(r"\\|</?turn>|### |:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn>### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
LEARNED = "assistant"

TURNS = "conv string, depth int, node binary, parent binary, role string, text string"
PIECES = "node binary, ids binary, n_ids int, loss_begin int, loss_stop int"


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL_ROLE if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; raises if it is not one."""
    turns, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return turns


def turns(conversations: DataFrame) -> DataFrame:
    """Every turn with its depth, the name of its node, and that of the node before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, depth, node = None, 0, b""
        for batch in batches:
            out: list[list] = [[], [], []]
            conv, roles, texts = (batch.column(c).to_pylist() for c in ("conv", "role", "text"))
            for c, role, text in zip(conv, roles, texts, strict=True):
                if c != last:
                    last, depth, node = c, 0, b""
                parent, depth = node, depth + 1
                raw = role.encode()
                node = hashlib.blake2b(parent + len(raw).to_bytes(8, "little") + raw + text.encode(), digest_size=16).digest()
                for column, value in zip(out, (depth, node, parent), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()),
                 batch.column("role"), batch.column("text")],
                names=["conv", "depth", "node", "parent", "role", "text"],
            )

    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn",
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv", "role", "text").mapInArrow(run, TURNS)


def _tokenised(nodes: DataFrame, vocabulary: str) -> DataFrame:
    """ids of each node's turn, and which of them are under the loss mask."""
    with open(vocabulary, "rb") as file:  # under a megabyte; tasks get it by broadcast
        shared = nodes.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                head, body, tail = (encoder.encode(x) for x in (OPEN + escape(role, True) + SEPARATOR, escape(text), CLOSE))
                begin, stop = len(head) // 2, (len(head) + len(body)) // 2
                learned = role == LEARNED
                values = (head + body + tail, (len(head) + len(body) + len(tail)) // 2, begin if learned else 0, stop if learned else 0)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(out[0], pa.binary()), *(pa.array(c, pa.int32()) for c in out[1:])],
                names=["node", "ids", "n_ids", "loss_begin", "loss_stop"],
            )

    return nodes.select("node", "role", "text").mapInArrow(run, PIECES)


def format_chats(conversations: DataFrame, scratch: Scratch, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The stream and the paths through it.

    Stream: node, place (of the first token in the stream), position (of it in its conversations),
    ids (16-bit numbers), loss_begin and loss_stop (tokens of the node under the loss mask), ancestors
    (stream intervals of all tokens before it in its conversations). Paths: conv, depth, node."""
    rows = scratch.keep(turns(conversations), "zstd")
    paths = rows.select("conv", "depth", "node", "parent")
    owners = paths.groupBy("node").agg(F.min("conv").alias("owner"))
    owned = scratch.keep(rows.join(owners, "node").filter("conv = owner").drop("owner"), "zstd")  # each node once
    pieces = scratch.keep(_tokenised(owned, vocabulary), "zstd")
    sized = owned.select("conv", "depth", "node", "parent").join(pieces.select("node", "n_ids"), "node")
    # What a conversation owns is one run of depths; it hangs on the node before its first.
    runs = sized.groupBy("conv").agg(
        F.min(F.struct("depth", "parent")).alias("first"), F.sum("n_ids").cast("long").alias("length")
    )
    holders = sized.select(F.col("node").alias("parent"), F.col("conv").alias("up"))
    runs = scratch.keep(
        runs.select("conv", "length", F.col("first.depth").alias("depth"), F.col("first.parent").alias("parent")).join(holders, "parent", "left")
    )
    # Tokens of ``up`` before the branch, counted from its own first token.
    before = sized.alias("s").join(runs.filter("up IS NOT NULL").alias("r"), F.col("s.conv") == F.col("r.up"))
    kept = before.filter("s.depth < r.depth").groupBy("r.conv").agg(F.sum("s.n_ids").cast("long").alias("kept"))
    step = F.struct((-F.col("depth")).alias("back"), F.col("conv").alias("conv"), F.coalesce("kept", F.lit(0).cast("long")).alias("kept"))
    chains = scratch.keep(runs.join(kept, "conv", "left").select("conv", "up", "length", F.array(step).alias("path")))
    while chains.filter("up IS NOT NULL").take(1):  # halves the hops left each time
        above = chains.select(F.col("conv").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        chains = scratch.keep(
            chains.join(above, "up", "left").select("conv", F.col("next").alias("up"), "length", F.concat(F.coalesce("above", F.array().cast(above.schema["above"].dataType)), "path").alias("path"))
        )
    order = [F.col("path")]
    placed = running_sum(place(chains.select("conv", "length", "path"), order), F.col("length"), order, "total")
    segments = scratch.keep(placed.select("conv", "path", (F.col("total") - F.col("length")).alias("place")))
    # path[i + 1].kept tells how much of segment i comes before; the last of the path is the segment itself.
    hops = segments.select(
        F.col("conv").alias("of"), F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("up"), F.slice("path", 2, F.size("path")).alias("down"))).alias("i", "hop")
    )
    hops = hops.select("of", "i", F.col("hop.up.conv").alias("conv"), F.col("hop.down.kept").alias("kept")).join(segments.select("conv", "place"), "conv")
    ancestors = hops.groupBy("of").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("i", "place", "kept"))),
            lambda h: F.struct(h["place"].alias("begin"), (h["place"] + h["kept"]).alias("stop")),
        ).alias("above"),
        F.sum("kept").alias("skipped"),
    )
    segments = segments.join(ancestors, segments.conv == ancestors.of, "left").select("conv", "place", "above", F.coalesce("skipped", F.lit(0)).alias("skipped"))
    inside = running_sum(place(sized.select("conv", "depth", "node", "n_ids"), [F.col("conv"), F.col("depth")]), F.col("n_ids"), [F.col("depth")], "total", ["conv"])
    inside = inside.select("conv", "node", (F.col("total") - F.col("n_ids")).cast("long").alias("offset"))
    none = F.array().cast("array<struct<begin:bigint,stop:bigint>>")
    stream = (
        inside.join(segments, "conv").join(pieces, "node")
        .select(
            "node", (F.col("place") + F.col("offset")).alias("place"), (F.col("skipped") + F.col("offset")).alias("position"),
            "ids", "loss_begin", "loss_stop",
            F.filter(
                F.concat(F.coalesce("above", none), F.array(F.struct(F.col("place").alias("begin"), (F.col("place") + F.col("offset")).alias("stop")))),
                lambda a: a["begin"] < a["stop"],
            ).alias("ancestors"),
        )
    )
    return scratch.keep(stream.repartitionByRange("place").sortWithinPartitions("place"), "zstd"), paths.select("conv", "depth", "node")


def read_back(stream: DataFrame, paths: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of every conversation, from the tokens of the stream alone."""
    with open(vocabulary, "rb") as file:
        shared = stream.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = _encoder(shared.value).plain
        last, state = None, None
        done: list[tuple] = []

        def finish() -> None:
            conv, n, all_, loss, loss_chars, chars = state
            done.append((int(conv) if conv else None, n, all_.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*done, strict=True) if done else [[]] * 6
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )
            done.clear()
            return out

        for batch in batches:
            values = (batch.column(c).to_pylist() for c in ("conv", "ids", "loss_begin", "loss_stop"))
            for conv, raw, begin, stop in zip(*values, strict=True):
                if state is None or conv != last:
                    if state is not None:
                        finish()
                    last, state = conv, [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                ids = np.frombuffer(raw, dtype="<u2").tolist()
                formatted = plain.decode_bytes(ids).decode()
                ((role, text),) = parse(formatted)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                learned = unescape(plain.decode_bytes(ids[begin:stop]).decode())
                state[3].update(learned.encode())
                state[4] += len(learned)
                state[5] += len(formatted)
            yield batch_of()
        if state is not None:
            finish()
        yield batch_of()

    rows = paths.join(stream.select("node", "ids", "loss_begin", "loss_stop"), "node")
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "depth").select("conv", "ids", "loss_begin", "loss_stop")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(run, schema)
