"""The prefix trie of conversations, rolled up by pointer jumping.

Every distinct sequence of first turns is a node. Its key is a digest of the sequence, so equal prefixes of different
conversations meet by a hash aggregate, and the edge to the parent is a pair of digests. Sums over subtrees take as many rounds
as the depth has binary digits: in round k a node's sums cover all nodes less than 2**k below it, and the pointers, which lead 2**k
up, carry each node's sums to its ancestor there and are then joined with themselves to lead twice as far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, ordered_numbers, parts, table, tidied, written

#: Turns whose digests are put one after another; further turns build on the digest of all blocks before theirs.
BLOCK = 32
#: Nodes that more than the one in so many pointers lead to are met by a broadcast join, so it holds no more rows than this.
HOT_SHARE = 20_000
#: Conversations, by number in the order of their ids, whose ids are put together before they are hashed.
IDS_TOGETHER = 2048


def bare(digest: Column) -> Column:
    return F.unhex(F.sha2(digest, 256))


def root_key() -> Column:
    return bare(F.lit("root").cast("binary"))


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes that tell turns apart: the role's length comes first, so role and text can't run into each other."""
    return bare(F.concat_ws("", F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def prefix_digests(items: DataFrame) -> DataFrame:
    """items (seq, pos, item, and others) with node and parent: digests of the sequence's first pos + 1 items and of its first pos.

    pos counts from 0 without gaps. A sequence is cut into blocks of BLOCK items, which are digested where they lie; the digest of
    all blocks before a block comes from the same function over the blocks, so a sequence of n items takes log(n) to base BLOCK
    rounds and a task holds BLOCK digests.
    """
    block = F.floor(F.col("pos") / BLOCK)
    w = Window.partitionBy("seq", "block of").orderBy("pos")
    local = items.withColumn("block of", block).withColumn("so far", F.concat_ws("", F.transform(F.collect_list("item").over(w), F.hex)))
    deepest = items.agg(F.max("pos")).first()[0]
    if deepest is None or deepest < BLOCK:
        node = bare(F.concat_ws("", F.lit("|"), "so far").cast("binary"))
        return local.withColumn("node", node).withColumn("parent", F.coalesce(F.lag("node").over(w), root_key())).drop("block of", "so far")
    local = written(local, "blocks")
    full = local.where(F.col("pos") % BLOCK == BLOCK - 1).select("seq", F.col("block of").alias("pos"), bare(F.col("so far").cast("binary")).alias("item"), F.col("so far").alias("whole"))
    up = written(prefix_digests(full), "upper")

    def joined(before: Column, own: Column) -> Column:
        return bare(F.concat_ws("", F.coalesce(F.hex(before), F.lit("")), F.lit("|"), own).cast("binary"))

    carry = F.when(F.col("pos") > 0, F.col("parent"))
    up = up.select(F.col("seq").alias("seq up"), (F.col("pos") + 1).alias("block up"), F.col("node").alias("carry"), joined(carry, F.col("whole")).alias("closing"))
    found = local.join(up, (F.col("seq") == F.col("seq up")) & (F.col("block of") == F.col("block up")), "left")
    found = found.withColumn("node", joined(F.col("carry"), F.col("so far")))
    return found.withColumn("parent", F.coalesce(F.lag("node").over(w), "closing", root_key())).drop("block of", "so far", "seq up", "block up", "carry", "closing")


def jumped(pointers: DataFrame, nodes: DataFrame) -> DataFrame:
    """pointers (node, up) with up replaced by what it points to itself in nodes (node, up). Nodes that a large share of the
    pointers lead to are met by a broadcast join of at most HOT_SHARE rows, all others by a shuffle in which no key is large."""
    led = pointers.groupBy("up").agg(F.count("*").alias("led")).where(F.col("led") > max(1, pointers.count() // HOT_SHARE))
    hot = written(led.select("up"), "hot")
    at = nodes.select(F.col("node").alias("up"), F.col("up").alias("beyond"))
    many = pointers.join(F.broadcast(hot.join(at, "up")), "up")
    few = pointers.join(F.broadcast(hot), "up", "left_anti").join(at, "up")
    return many.unionByName(few).select("node", F.col("beyond").alias("up"))


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes (node, parent, depth, and the columns sums, bigint) with these columns summed over each node's subtree.

    Depth counts from 0 at nodes without a parent. Rounds: the binary digits of the greatest depth. Each one is an aggregate by
    pointer, combined before it is shuffled, and two joins by node.
    """
    state = written(nodes.select("node", F.col("parent").alias("up"), "depth", *sums), "state")
    deepest, step = state.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        reaching = state.where(F.col("depth") >= step)
        given = reaching.groupBy(F.col("up").alias("node")).agg(*(F.sum(c).alias(f"given {c}") for c in sums))
        further = jumped(reaching.where(F.col("depth") >= 2 * step).select("node", "up"), reaching.select("node", "up"))
        new = state.drop("up").join(given, "node", "left").join(further, "node", "left")
        before, state = state, written(new.select("node", "up", "depth", *((F.col(c) + F.coalesce(f"given {c}", F.lit(0))).alias(c) for c in sums)), "state")
        dropped(before)
        step *= 2
    return state.select("node", *sums)


def joined_digests(ends: DataFrame) -> DataFrame:
    """From ends (node, nr, conv_id): node and ends_sha256, the SHA-256 of its conv_ids in order of nr, in decimal, comma-joined.

    A hash takes its bytes in order. Ids are put together by blocks of IDS_TOGETHER numbers first, so however many conversations
    end at a node, the task that hashes them reads a row for each block, and as a stream.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "conv_id"))), lambda x: x["conv_id"].cast("string")), ",")
    blocks = ends.groupBy("node", F.floor(F.col("nr") / IDS_TOGETHER).alias("block")).agg(ids.alias("ids"))
    ordered = blocks.repartition(parts(ends.sparkSession), "node").sortWithinPartitions("node", "block").select("node", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = digest = None
        for b in batches:
            nodes, hashes = [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        nodes.append(now)
                        hashes.append(digest.hexdigest())
                    now, digest = node, hashlib.sha256()
                digest.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return ordered.mapInArrow(run, "node binary, ends_sha256 string")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """From turns (conv_id, turn, role, text): conv_id, pos (from 0, by turn with null first, then role and text), item (digest of
    role and text) and bytes (of the text in UTF-8). Null roles and texts count as empty.

    The order is that of a sort over all rows, so a conversation of any length is spread over tasks. Repeated rows stay, each in a
    place of its own. Rows without a conv_id belong to no conversation and are left out. Other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"item": turn_digest(F.col("role"), F.col("text")), "bytes": F.octet_length("text").cast("long")})
    rows = ordered_numbers(rows, ["conv_id", "turn", "role", "text", "row"], "nr", keep=["conv_id", "item", "bytes"])
    first = rows.groupBy("conv_id").agg(F.min("nr").alias("first"))
    return rows.join(first, "conv_id").select("conv_id", (F.col("nr") - F.col("first")).alias("pos"), "item", "bytes")


@tidied
def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of conversations, the root (no turns) among them.

    turns (conv_id, pos, item, bytes): pos counts each conversation's turns from 0 without gaps, item tells turns apart, bytes is
    what a turn costs. convs (conv_id): each conversation once, also those without turns. Returns conv_id (the smallest member),
    depth, parent_conv_id (the parent's smallest member; null at the root), n_convs, n_children, n_leaves (childless nodes in the
    subtree, itself included), saved_tokens (over the subtree, members but one times the bytes of a node's last turn) and
    ends_sha256 (of the ids of members that end at the node). Without conversations there are no nodes.
    """
    numbers = ordered_numbers(convs.select("conv_id"), ["conv_id"], "nr")
    rows = written(prefix_digests(turns.select(F.col("conv_id").alias("seq"), "pos", "item", "bytes")).select(F.col("seq").alias("conv_id"), (F.col("pos") + 1).alias("depth"), "node", "parent", "bytes"), "prefixes")
    inner = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(root_key().alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"))
    members = written(root.unionByName(inner), "members")
    children = members.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(members.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    own = nodes.select("node", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    over = rolled_up(own, ["n_leaves", "saved_tokens"])
    above = jumped(nodes.where("depth > 0").select("node", F.col("parent").alias("up")), nodes.select("node", F.col("conv_id").alias("up"))).select("node", F.col("up").alias("parent_conv_id"))
    last = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = rows.join(last, ["conv_id", "depth"]).select("conv_id", "node").unionByName(convs.join(last, "conv_id", "left_anti").select("conv_id", root_key().alias("node")))
    ended = joined_digests(ends.join(numbers, "conv_id"))
    found = nodes.join(over, "node").join(above, "node", "left").join(ended, "node", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (of numbered_turns()) of conversations that share their beginnings, and the conversations: that of id c has the first
    h turns of conversation c - c % group, then its own from place h on; h is CRC-32 of c in decimal, modulo most. A negative c has
    the remainder of its absolute value, negated. Only the first most - 1 turns of a conversation are read by others."""
    turns = written(turns, "numbered")
    convs = written(turns.select("conv_id").distinct(), "convs")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.where(F.col("pos") >= h)
    asking = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("from"), h.alias("h"))
    lent = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "from")
    taken = lent.join(asking, "from").where("pos < h").select("conv_id", "pos", "item", "bytes")
    # Where fewer turns are lent than h, the conversation's own come right behind them.
    n = taken.groupBy("conv_id").agg(F.count("*").alias("n taken"))
    moved = own.join(n, "conv_id", "left").select("conv_id", (F.col("pos") - h + F.coalesce("n taken", F.lit(0))).alias("pos"), "item", "bytes")
    return written(taken.unionByName(moved), "rebuilt"), convs


@tidied
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(numbered_turns(table(spark, sf_dir, "conversations"))))


_CRC = "list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1))))"
OP11_SQL = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
),
convs as (select conv_id, xor({_CRC}, 4294967295::bigint) % 9 as h from (select distinct conv_id from turns)),
put as (
  select c.conv_id, 0 as own, t.pos, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 5 and t.pos < c.h
  union all select c.conv_id, 1, t.pos, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.pos >= c.h
),
rebuilt as (select conv_id, row_number() over (partition by conv_id order by own, pos) as depth, sha256(length(role) || ':' || role || text) as item, strlen(text) as bytes from put),
prefixes as (select conv_id, depth, bytes, string_agg(item, '') over (partition by conv_id order by depth rows unbounded preceding) as node from rebuilt),
nodes as (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs, min(bytes) as bytes from prefixes group by node, depth
  union all select '', 0, min(conv_id), count(*), 0 from convs having count(*) > 0
),
children as (select left(node, 64 * (depth - 1)) as node, count(*) as n_children from nodes where depth > 0 group by 1),
own as (select n.*, coalesce(c.n_children, 0) as n_children, unnest(range(0, depth + 1)) as k from nodes n left join children c using (node)),
over_all as (select left(node, 64 * k) as node, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * bytes) as saved_tokens from own group by 1),
ends as (
  select conv_id, node from prefixes qualify depth = max(depth) over (partition by conv_id)
  union all select conv_id, '' from convs where conv_id not in (select conv_id from prefixes)
),
ended as (select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from ends group by node)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(c.n_children, 0)::bigint as n_children,
  o.n_leaves::bigint as n_leaves, o.saved_tokens::bigint as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from nodes n left join nodes p on n.depth > 0 and p.node = left(n.node, 64 * (n.depth - 1)) left join children c on c.node = n.node join over_all o on o.node = n.node left join ended e on e.node = n.node
"""
