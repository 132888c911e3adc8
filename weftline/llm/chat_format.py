"""Reply trees to conversations.

Self-joins double the reach of each message's pointer to its ancestor until every pointer has passed the root, which gives
depth and summed score of each path in as many joins as the depth has binary digits. Branches are ranked by mean score, the
chosen leaves' paths enumerated over the same pointers, and each path rendered turn by turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, table, tidied, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that a text must not hold unescaped: the template's own and those of other common templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<pad>", "<unk>")
#: Put behind the first character of a control string. Itself it is written with a full stop, a line feed in a role with n.
ESCAPE = "␛"


def escaped(text: Column) -> Column:
    ahead = "|".join(re.escape(c[1:]).replace("<", "\\<") for c in CONTROL)
    return F.regexp_replace(F.regexp_replace(text, ESCAPE, f"{ESCAPE}."), f"([<\\[])(?=(?:{ahead}))", f"$1{ESCAPE}")


def unescaped(text: str) -> str:
    if ESCAPE not in text:
        return text
    return re.sub(f"{ESCAPE}(.)", lambda m: {".": ESCAPE, "n": "\n"}.get(m[1], m[1]), text, flags=re.S)


def path_nodes(nodes: DataFrame, top: int = 1) -> DataFrame:
    """From nodes (tree, node, parent, role, text, score): for the top branches of each tree one row for each of their
    messages: tree, path (the leaf's node), branch (1 for the best), position (0 at the root), role, text.

    A branch runs from a root to a leaf; branches are ranked by mean score, null counting as 0, then by leaf. Parents that are
    null or not among the nodes make a root. Of repeated node ids the row of least parent, role and text counts. Messages on
    a cycle have no root and are on no branch. No nodes give no rows. Node ids are unique over all trees.
    """
    best = F.min(F.struct(F.col("parent").isNull(), "parent", "role", "text", "tree", "score")).alias("m")
    nodes = written(nodes.where("node is not null").groupBy("node").agg(best).select("node", "m.tree", "m.parent", "m.role", "m.text", F.coalesce("m.score", F.lit(0.0)).cast("double").alias("score")), "nodes")
    ids = nodes.select(F.col("node").alias("parent"))
    rooted = nodes.join(ids, "parent", "left_semi").select("node", F.col("parent").alias("up"))
    state = written(nodes.select("node", F.lit(1).cast("long").alias("depth"), "score").join(rooted, "node", "left"), "jump")
    # Round k: pointers of nodes at least 2**k below their root, and what lies between; nodes whose pointer has passed the root.
    jumps, passed, rounds = [], state.where("up is null"), nodes.count().bit_length() + 1
    going = state.where("up is not null")
    while len(jumps) < rounds and going.limit(1).count():
        jumps.append(going)
        reached = going.unionByName(passed).select(F.col("node").alias("up"), F.col("depth").alias("more"), F.col("score").alias("plus"), F.col("up").alias("beyond"))
        state = written(going.join(reached, "up").select("node", (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("plus")).alias("score"), F.col("beyond").alias("up")), "jump")
        passed, going = passed.unionByName(state.where("up is null")), state.where("up is not null")
    leaves = nodes.join(nodes.select(F.col("parent").alias("node")), "node", "left_anti").select("node", "tree")
    ranked = leaves.join(passed.select("node", "depth", (F.col("score") / F.col("depth")).alias("mean")), "node")
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), "node")
    chosen = written(ranked.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= top).select(F.col("node").alias("path"), "branch", "depth"), "chosen")
    at = chosen.select("path", F.col("path").alias("node"), F.lit(0).cast("long").alias("above"))
    for k in range(len(jumps) - 1, -1, -1):  # each distance is one sum of powers of two, so each message comes up once
        up = jumps[k].select("node", "up")
        at = at.unionByName(at.join(up, "node").select("path", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above")))
        if k % 4 == 0:
            at = written(at, "paths")
    return at.join(nodes, "node").join(chosen, "path").select("tree", "path", "branch", (F.col("depth") - 1 - F.col("above")).alias("position"), "role", "text")


def rendered(turns: DataFrame, learnt_role: str = "assistant") -> DataFrame:
    """turns (with position, role, text) with segment, the turn as the template writes it, and loss_start and loss_chars, the
    part of the segment that a loss is taken on: texts of learnt_role. A path's segments by position, put together, are the
    conversation. Null roles and texts count as empty. All other columns stay."""
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), F.regexp_replace(escaped(role), "\n", f"{ESCAPE}n"), F.lit("\n"))
    learnt = role == learnt_role
    made = {"segment": F.concat("head of turn", "body of turn", F.lit(CLOSE)), "loss_start": F.when(learnt, F.length("head of turn")), "loss_chars": F.when(learnt, F.length("body of turn"))}
    return turns.withColumns({"head of turn": head, "body of turn": text}).withColumns(made).drop("head of turn", "body of turn", "role", "text")


def parsed(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    role, text = segment[len(OPEN) : -len(CLOSE)].split("\n", 1)
    return unescaped(role), unescaped(text)


def read_back(segments: DataFrame) -> DataFrame:
    """One row for each path: n_turns, SHA-256 of its turns and of its text under the loss mask, sizes; read from segments.

    A hash takes a conversation's turns in order, so a path is read within one task, but as a stream: no path is held.
    """
    ordered = segments.select("tree", "path", "position", "segment", "loss_start", "loss_chars").repartition(parts(segments.sparkSession), "path").sortWithinPartitions("path", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def closed() -> list:
            tree, _, n, turns, chars, loss, size = now
            return [tree, n, turns.hexdigest(), chars, loss.hexdigest(), size]

        def out() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=NAMES)

        for b in batches:
            for tree, path, _, segment, start, chars in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[1] != path:
                    if now is not None:
                        done.append(closed())
                    now = [tree, path, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parsed(segment)
                now[2] += 1
                now[3].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learnt = unescaped(segment[start : start + chars])
                    now[4] += len(learnt)
                    now[5].update(learnt.encode())
                now[6] += len(segment)
            if done:
                yield out()
                done = []
        if now is not None:
            done = [closed()]
            yield out()

    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def chains(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) as trees without branches: each row answers the one before it in its conversation.

    Rows are numbered through in a sort over all conversations, so a conversation of any length is spread over tasks. Rows of
    one turn follow by role, then text; repeated rows stay. Null turns come first; null conversation ids are one conversation.
    """
    spark = turns.sparkSession
    keys = ["conv_id", "turn", "role", "text"]
    rows = written(turns.select(*keys).repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "turns")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    firsts, n = [], 0
    for p in sorted(sizes):
        firsts.append((p, n))
        n += sizes[p]
    first = spark.createDataFrame(firsts, "part bigint, first bigint")
    rows = written(rows.withColumn("part", part).join(F.broadcast(first), "part").select("conv_id", "role", "text", (F.col("first") + within).alias("node")), "numbered")
    before = rows.select((F.col("node") + 1).alias("node"), F.col("conv_id").alias("conv_before"), F.lit(True).alias("any"))
    linked = rows.join(before, "node", "left")
    parent = F.when(F.col("any") & F.col("conv_id").eqNullSafe(F.col("conv_before")), F.col("node") - 1)
    return linked.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(1.0).alias("score"))


@tidied
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string"))
    return read_back(rendered(path_nodes(chains(turns))))


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, chr(9243), chr(9243) || '.')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(9243) || '{c[1:]}')"
    return out


OP1_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(OPEN) + 1 + len(CLOSE)} + length({_sql_escaped("role")}) + length(role) - length(replace(role, chr(10), '')) + length({_sql_escaped("text")}))::bigint as formatted_chars
from turns group by conv_id
"""
