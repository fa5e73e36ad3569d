"""Chat formatting over a prefix tree of conversations.

A turn's node is named by the hash of all turns up to it, so conversations that begin alike share
nodes. Each node is tokenized and emitted once, in depth-first order. Order needs no tree in one
place: a node belongs to the least conversation that passes through it, so a path is a short list
of the depths at which the owner changes, and sorting by that list is depth-first order. The nodes
of one owner stand side by side, so a node's ancestors are one interval of the emitted tokens for
each owner on its path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokenization import coder, default_vocabulary

# The template: a turn is OPEN role MIDDLE text CLOSE. Each of its control strings holds # or <.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
#: In texts and roles, in this order; undone in the reverse order.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
#: Stands in for a null conversation id, which is a conversation of its own.
NO_ID = -(1 << 63)
#: Intervals of emitted tokens find their nodes by blocks of two to the power of this.
BLOCK_BITS = 12


def escape(text: str, role: bool = False) -> str:
    for plain, coded in ESCAPES[: 4 if role else 3]:
        text = text.replace(plain, coded)
    return text


def unescape(text: str) -> str:
    for plain, coded in reversed(ESCAPES):
        text = text.replace(coded, plain)
    return text


def turns(conversations: DataFrame) -> DataFrame:
    """(cid, depth, key, role, text): rows by turn (ties by role, then text); null role and text are empty.

    Conversations are sorted, not gathered: a task goes through them row by row and holds one hash.
    """
    src = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("cid"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, depth, key = None, 0, b""
        for b in batches:
            depths, keys = [], []
            cids, roles, words = (b.column(k).to_pylist() for k in (0, 1, 2))
            for cid, role, text in zip(cids, roles, words, strict=True):
                at, depth, key = (cid, depth + 1, key) if cid == at else (cid, 0, b"")
                r = role.encode("utf-8", "surrogatepass")
                key = hashlib.sha256(key + len(r).to_bytes(8, "big") + r + text.encode("utf-8", "surrogatepass")).digest()
                depths.append(depth)
                keys.append(key)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(depths, pa.int32()), pa.array(keys, pa.binary()), b.column(1), b.column(2)], ["cid", "depth", "key", "role", "text"])

    ordered = src.repartition("cid").sortWithinPartitions("cid", "turn", "role", "text").select("cid", "role", "text")
    return ordered.mapInArrow(run, "cid long, depth int, key binary, role string, text string")


def prefix_tree(conversations: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, members).

    nodes, one row per distinct prefix: key, depth, owner, role, ids, loss_from and loss_to (token
    places within the node that the loss covers: the text of an assistant's turn, else none),
    emit_start and emit_end (places among all tokens emitted, trees one after the other),
    position (position id of the first token: tokens before it on its path), and attend (the
    intervals of emitted tokens of all ancestors, in order; a node also attends to itself,
    causally). members: cid, depth, key, the path of each conversation.
    """
    spark, path = conversations.sparkSession, vocabulary or default_vocabulary()
    members = materialize(turns(conversations), "turns")
    owners = materialize(members.groupBy("key").agg(F.min("cid").alias("owner")), "owners")
    # where the owner changes along each conversation
    by_depth = Window.partitionBy("cid").orderBy("depth")
    along = members.select("cid", "depth", "key").join(owners, "key").select("cid", "depth", "owner", F.lag("owner").over(by_depth).alias("above"))
    changes = along.where("above is null or above != owner").select("cid", "depth", "owner")
    paths = materialize(changes.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("depth", "owner"))).alias("path")), "paths")

    # a node's row is its owner's
    own = members.join(owners.select(F.col("key").alias("k"), "owner"), (F.col("key") == F.col("k")) & (F.col("cid") == F.col("owner")))
    step = lambda kind, d, o: F.struct(F.lit(kind).alias("leaves"), d.cast("int").alias("depth"), o.cast("long").alias("owner"))
    place = F.concat(F.transform("path", lambda s: step(1, -s["depth"], s["owner"])), F.array(step(0, F.col("depth"), F.lit(0))))
    placed = own.select("key", "depth", "owner", "role", "text").join(paths, F.col("owner") == F.col("cid")).withColumn("place", place)
    ordered = placed.repartitionByRange("place").sortWithinPartitions("place").select("key", "depth", "owner", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = coder(path)[0], TaskContext.get().partitionId(), 0
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for role, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                head, body = encode(OPEN + escape(role, True) + MIDDLE), encode(escape(text))
                ids = head + body + encode(CLOSE)
                loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
                for o, x in zip(out, (ids, *loss, part, start, start + len(ids)), strict=True):
                    o.append(x)
                start += len(ids)
            kinds = (pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(b.columns[:4] + [pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["key", "depth", "owner", "role", "ids", "loss_from", "loss_to", "part", "start", "stop"])

    emitted = materialize(ordered.mapInArrow(run, "key binary, depth int, owner long, role string, ids array<int>, loss_from int, loss_to int, part int, start long, stop long"), "emitted")
    # one row for each partition
    before, base = 0, []
    for r in emitted.groupBy("part").agg(F.max("stop").alias("n")).orderBy("part").collect():
        base.append((r["part"], before))
        before += r["n"]
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    nodes = emitted.join(bases, "part").select("key", "depth", "owner", "role", "ids", "loss_from", "loss_to", (F.col("base") + F.col("start")).alias("emit_start"), (F.col("base") + F.col("stop")).alias("emit_end"))

    # the interval of each owner on a conversation's path: from where the path enters to where it leaves
    legs = paths.select("cid", "path", F.posexplode("path").alias("leg", "s")).select("cid", "leg", F.col("s.owner").alias("o"), F.col("s.depth").alias("enter"), (F.try_element_at("path", F.col("leg") + 2)["depth"] - 1).alias("leave"))
    spots = nodes.select("owner", "depth", "emit_start", "emit_end")
    enters = spots.select(F.col("owner").alias("o"), F.col("depth").alias("enter"), F.col("emit_start").alias("from"))
    leaves = spots.select(F.col("owner").alias("o"), F.col("depth").alias("leave"), F.col("emit_end").alias("to"))
    found = legs.join(enters, ["o", "enter"]).join(leaves, ["o", "leave"], "left")
    upto = found.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("leg", "from", "to"))).alias("legs"))
    above = upto.select(F.col("cid").alias("owner"), F.transform(F.filter("legs", lambda x: x["to"].isNotNull()), lambda x: F.struct(x["from"].alias("start"), x["to"].alias("end"))).alias("above"), F.element_at("legs", -1)["from"].alias("own_from"))
    length = F.aggregate("above", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    chain = F.when(F.col("own_from") < F.col("emit_start"), F.array(F.struct(F.col("own_from").alias("start"), F.col("emit_start").alias("end"))))
    full = nodes.join(above, "owner").select("key", "depth", "owner", "role", "ids", "loss_from", "loss_to", "emit_start", "emit_end", (length + F.col("emit_start") - F.col("own_from")).alias("position"), F.concat("above", F.coalesce(chain, F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("attend"))
    return materialize(full, "nodes"), members.select("cid", "depth", "key")


def read_back(nodes: DataFrame, members: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digests of each conversation, from the emitted tokens that its last turn attends to, and itself, by position id.

    Null ids are one conversation, rows of equal turn stand by role and text, as in turns(); no
    conversations give no rows, and an empty text is a turn without characters.
    """
    path = vocabulary or default_vocabulary()
    turn = re.compile(re.escape(OPEN) + "([^:]*)" + re.escape(MIDDLE) + "(.*)" + re.escape(CLOSE), re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, at, state, names = coder(path)[1], None, None, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

        def close() -> tuple:
            n, whole, loss_n, loss, chars, size = state
            return None if at == NO_ID else at, n, whole.hexdigest(), loss_n, loss.hexdigest(), chars, size

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            done = []
            for cid, ids, lo, hi in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if cid != at:
                    if state:
                        done.append(close())
                    at, state = cid, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                formatted = decode(ids).decode("utf-8", "surrogatepass")
                role, text = map(unescape, turn.fullmatch(formatted).groups())
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                under = unescape(decode(ids[lo:hi]).decode("utf-8", "surrogatepass"))
                state[2] += len(under)
                state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
                state[5] += len(ids)
            if done:
                yield batch(done)
        if state:
            yield batch([close()])

    last = members.groupBy("cid").agg(F.max_by("key", "depth").alias("key"))
    itself = F.array(F.struct(F.col("emit_start").alias("start"), F.col("emit_end").alias("end")))
    spans = last.join(nodes.select("key", F.concat("attend", itself).alias("spans")), "key").select("cid", F.inline("spans"))
    # nodes meet the intervals in blocks of emitted tokens
    block = lambda place: F.shiftright(place, BLOCK_BITS)
    wanted = spans.select("cid", "start", "end", F.explode(F.sequence(block(F.col("start")), block(F.col("end") - 1))).alias("block"))
    emitted = nodes.select(block(F.col("emit_start")).alias("block"), "emit_start", "position", "ids", "loss_from", "loss_to")
    walked = wanted.join(emitted, "block").where("emit_start >= start and emit_start < end")
    walked = walked.repartition("cid").sortWithinPartitions("cid", "position").select("cid", "ids", "loss_from", "loss_to")
    return walked.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
