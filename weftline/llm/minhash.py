"""Near-duplicates by MinHash: universal hash minima, banding, verification and connected components.

Documents of one shingle set are one text; only texts are compared. Minima of many universal hash functions fall into bands,
and texts that agree on a band share a bucket. Buckets are never expanded into pairs: each hangs on its most central member,
and what hangs together is a family. In a family the most central texts are compared with all others, which joins copies of
them. Texts of different components are then compared only where their rarest shingles meet, as any two that are alike enough
share one of those; estimates from signatures come first, full sets confirm. Of a family too large for one task all are
compared with its most central text, in blocks, and only what isn't linked with that one meets all blocks. Links become
components by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, parts, sliced, table, tidied, written

#: Bands and minima in each: a pair of similarity 0.8 shares no band with a chance of (1 - 0.8**4)**28, 4 in 10 million.
BANDS, ROWS = 28, 4
#: Share of equal minima that a pair needs to be confirmed on full sets, 5 standard deviations below 0.8.
LEAST_ESTIMATE = 0.6
#: Shingles of a block of a family: two blocks' sets are in a task's memory at once, 8 bytes a shingle.
BLOCK_SHINGLES = 500_000
#: Pairs that are held before they are compared, 8 bytes each.
PAIRS = 1_000_000
#: A node of a graph of n edges with n / HUBS neighbours or more, 1,000 at least, is a hub: there are no more than 2 * HUBS of them.
HUBS = 10_000
#: Texts in buckets up to which their ids are sent to all executors, some 30 bytes each. Beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES, _A, _B = _odd(1, 256), _odd(2, BANDS * ROWS), _odd(3, BANDS * ROWS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse, as many as have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = 0x9E3779B97F4A7C15
            for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
                setattr(self, name, np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct hashes of the n-word shingles of each text, in order; A-Z count as a-z."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        size, end = len(texts[at]), at + 1
        while end < len(texts) and size + len(texts[end]) < CHUNK:
            size += len(texts[end])
            end += 1
        out += _chunk_sets(texts[at:end], n)
        at = end
    return out


def _chunk_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    sizes = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.r_[True, space].astype(np.int8))
    starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    up, down = _powers.of(max(len(data) + 1, CHUNK))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(space, np.uint64(0), _BYTES[data]) * up[: len(data)])])
    # A word's hash depends on its bytes and length alone.
    word = _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    chained = word.copy()
    if len(word) >= n:
        m = len(word) - n + 1
        chained = word[:m].copy()
        for k in range(1, n):
            chained = _mixed(chained) + word[k : k + m]
        chained = _mixed(chained)
    for k in range(len(texts)):
        a, z = int(first[k]), int(first[k + 1])
        if z - a >= n:
            out.append(np.unique(chained[a : z - n + 1]))
        elif z > a:
            h = word[a : a + 1].copy()
            for j in range(a + 1, z):
                h = _mixed(h) + word[j : j + 1]
            out.append(_mixed(h ^ np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each set, none of which may be empty."""
    out = np.zeros((len(sets), BANDS * ROWS), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) < CHUNK // 16:
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        starts = np.r_[0, np.cumsum([len(s) for s in sets[at : end - 1]])].astype(np.int64)
        for k in range(BANDS * ROWS):
            out[at:end, k] = np.minimum.reduceat((x * _A[k] + _B[k]) >> np.uint64(32), starts)
        at = end
    return out


def band_keys(signs: np.ndarray) -> np.ndarray:
    """For each row and band one number, which no other band has but by chance."""
    h = np.broadcast_to(_mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signs), BANDS)).copy()
    for k in range(ROWS):
        h = _mixed(h + signs[:, k::ROWS].astype(np.uint64))
    return h.view(np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


@tidied
def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: its id, n_shingles (size of its set), component_id (smallest id reachable over links, its
    own included) and kept (whether that is its own).

    A set holds the distinct shingles of so many words; with fewer words the whole sequence is the one shingle. Two documents
    are linked if 100 * intersection >= percent * union. Null, empty and blank texts have an empty set and are linked with
    nothing. Equal texts are linked. Of repeated ids every row counts; rows with a null id are linked with nothing. Ids are whole
    numbers. Other columns are not read.
    """
    kind = "bigint"
    source = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text"))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(_bytes(b.column(1)), shingle)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            distinct = {d: s for d, s in zip(digests, sets, strict=True) if d}
            keys = dict(zip(distinct, band_keys(signatures(list(distinct.values()))).tolist(), strict=True)) if distinct else {}
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array([keys.get(d) for d in digests], pa.list_(pa.int64()))], names=["id", "n", "digest", "bands"])

    rows = written(source.mapInArrow(first_pass, "id bigint, n bigint, digest binary, bands array<bigint>"), "sets")
    texts = written(rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep")), "texts")
    # Rows of one text that have the same id stand for it once.
    reps = rows.join(texts, (F.col("id") == F.col("rep")) & (rows["digest"] == texts["digest"]), "left_semi").select(F.col("id").alias("rep"), "n", "bands")
    keyed = written(reps.select("rep", "n", F.explode("bands").alias("key")).distinct(), "bands")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(keyed.join(sizes, "key"), "buckets")
    dropped(keyed)
    central = shared.groupBy("rep").agg(F.sum("size").alias("central"))
    members = written(shared.join(central, "rep"), "members")
    dropped(shared)

    linked = _links(source, members, shingle, percent)
    dropped(members)
    of_text = texts.join(linked, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    whole = rows.select("id", "n", "digest").join(of_text, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return whole.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links(source: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(rep, component) of all texts that share a bucket with another.

    Texts that buckets join, directly or over others, are a family; no pair that may be linked is split by it. The sets of a
    family of one block meet in one task.
    """
    pivots = members.groupBy("key").agg(F.max(F.struct("central", (-F.col("rep")).alias("minus"))).alias("p")).select("key", (-F.col("p.minus")).alias("pivot"))
    spokes = members.join(pivots, "key").where("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    in_families = stars(spokes)
    known = members.groupBy("rep").agg(F.max("central").alias("central"), F.max("n").alias("n")).join(in_families.withColumnRenamed("component", "family"), "rep", "left").withColumn("family", F.coalesce("family", "rep"))
    known = written(known, "families")
    dropped(in_families)
    large = written(_blocks(known, "family", "n").where("blocks > 1"), "large")
    small = _with_sets(source, known.join(F.broadcast(large) if large.count() <= MOST_BROADCAST else large, "family", "left_anti"), shingle)
    small = small.select("family", F.lit(0).alias("low"), F.lit(0).alias("high"), "central", "id", F.lit(False).alias("core"), "shingles", "signature")
    links = _compared(small, percent)
    if large.limit(1).count():
        links = links.unionByName(_large_families(source, known.join(large, "family"), shingle, percent))
    out = stars(links)
    dropped(known, large)
    return out


def _blocks(rows: DataFrame, by: str, size: str) -> DataFrame:
    """(by, blocks): how many blocks the sets of each family make."""
    return rows.groupBy(by).agg(F.ceil(F.sum(size) / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))


def _with_sets(source: DataFrame, known: DataFrame, shingle: int) -> DataFrame:
    """known (rep and more) as id and more, with shingles and signature, made from the texts anew."""
    more = [f for f in known.schema.fields if f.name != "rep"]
    names = ["id", *(f.name for f in more), "shingles", "signature"]

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(_bytes(b.column(1)), shingle)
            full = [k for k, s in enumerate(sets) if len(s)]
            if full:
                signs = signatures([sets[k] for k in full])
                rest = [b.column(c).take(pa.array(full, pa.int64())) for c in (0, *range(2, 2 + len(more)))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([sets[k].tobytes() for k in full], pa.binary()), pa.array([s.tobytes() for s in signs], pa.binary())], names=names)

    few = known.count() <= MOST_BROADCAST
    placed = source.join(F.broadcast(known) if few else known, F.col("id") == F.col("rep")).select("id", "text", *(f.name for f in more))
    return placed.mapInArrow(sets_of, "id bigint, " + "".join(f"{f.name} {f.dataType.simpleString()}, " for f in more) + "shingles binary, signature binary")


def _compared(met: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of what meets at one (family, low, high); the most central texts come first."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> pa.RecordBatch:
            core = np.array([r[5] for r in held])
            pairs = confirmed([r[4] for r in held], [np.frombuffer(r[6], np.uint64) for r in held], np.array([np.frombuffer(r[7], np.uint32) for r in held]), percent, core)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])

        for b in sliced(batches, 6):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and r[:3] != held[-1][:3]:
                    if len(held) > 1:
                        yield out()
                    held = []
                held.append(r)
        if len(held) > 1:
            yield out()

    n = parts(met.sparkSession)
    dealt = met.repartition(n, "family", "low", "high").sortWithinPartitions("family", "low", "high", F.desc("central"), "id")
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _large_families(source: DataFrame, large: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) of families of several blocks, known with rep, family, central, n, blocks.

    Each block meets the family's most central text, so copies of it are joined at the cost of reading them once. What is left
    asks: blocks of it meet all blocks, where texts that are joined already aren't compared with each other.
    """
    most = large.groupBy("family").agg(F.max(F.struct("central", (-F.col("rep")).alias("minus"))).alias("p")).select("family", (-F.col("p.minus")).alias("pivot"))
    marked = written(large.join(most, "family").withColumn("first", F.col("rep") == F.col("pivot")), "marked")
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    all_of = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    sets = _with_sets(source, marked.select("rep", "family", "blocks", "first"), shingle)
    dealt = sets.withColumn("block", F.explode(F.when(F.col("first"), all_of("blocks")).otherwise(F.array(own("blocks")))))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, pivot = None, (0, np.zeros(0, np.uint64))
        for b in sliced(batches, 4):
            out = []
            for family, block, _, i, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(x, np.uint64)
                if (family, block) != where:  # the pivot comes first
                    where, pivot = (family, block), (i, x)
                    continue
                shared = len(np.intersect1d(x, pivot[1], assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(pivot[1]) - shared):
                    out.append((i, pivot[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    n = parts(source.sparkSession)
    dealt = dealt.select("family", "block", "first", "id", "shingles").repartition(n, "family", "block").sortWithinPartitions("family", "block", F.desc("first"))
    to_pivot = written(dealt.mapInArrow(linked, "a bigint, b bigint"), "to-pivot")
    # (rep, ...) with asks: not linked with the pivot.
    asking = marked.join(to_pivot.select(F.col("a").alias("rep"), F.lit(False).alias("far")).distinct(), "rep", "left").withColumn("asks", ~F.col("first") & F.col("far").isNull())
    some = _blocks(asking.where("asks"), "family", "n").withColumnRenamed("blocks", "asking")
    asking = written(asking.join(some, "family").select("rep", "family", "central", "blocks", "asking", "asks"), "asking")
    sets = _with_sets(source, asking, shingle)
    base = F.transform(all_of("asking"), lambda j: F.struct(own("blocks").alias("low"), j.alias("high")))
    asked = F.transform(all_of("blocks"), lambda k: F.struct(k.alias("low"), own("asking").alias("high")))
    met = sets.withColumn("at", F.explode(F.array_distinct(F.when(F.col("asks"), F.concat(base, asked)).otherwise(base))))
    return to_pivot.unionByName(_compared(met.select("family", "at.low", "at.high", "central", "id", (~F.col("asks")).alias("core"), "shingles", "signature"), percent))


def confirmed(ids: list[int], sets: list[np.ndarray], signs: np.ndarray, percent: int, core: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between texts, enough to join all that are linked directly or over others; those in core are joined already, those
    of one id are one text. The first texts should be the most central ones.

    Two steps: texts are compared with all others one by one, as long as that joins a good part of what is left; then those of
    different components that share one of their rarest shingles. Where n shingles have to share a part p of the larger set, the
    rarest n - ceil(p * n) + 1 of each of two linked sets have one in common.
    """
    m = len(ids)
    first: dict[int, int] = {}
    root = np.array([first.setdefault(i, k) for k, i in enumerate(ids)])  # every text's component; merged ones are renamed at once
    if core is not None and core.any():
        root[np.isin(root, root[core])] = root[core][0]
    sizes = np.fromiter(map(len, sets), np.int64, m)
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner, offsets = np.repeat(np.arange(m), sizes), np.r_[0, np.cumsum(sizes)]
    mine, out = np.zeros(len(tokens), bool), []

    def compare(x: int, others: np.ndarray) -> None:
        """Links of a text with some of other components; only estimates that come near enough are looked into."""
        others = others[(signs[others] == signs[x]).sum(1) >= LEAST_ESTIMATE * BANDS * ROWS]
        if not len(others):
            return
        n = sizes[others]
        ends = np.cumsum(n)
        flat = np.arange(ends[-1]) + np.repeat(offsets[others] - (ends - n), n)
        own = place[offsets[x] : offsets[x + 1]]
        mine[own] = True
        shared = np.add.reduceat(mine[place[flat]].astype(np.int64), ends - n)
        mine[own] = False
        for y in others[100 * shared >= percent * (n + sizes[x] - shared)].tolist():
            if root[y] != root[x]:
                out.append((ids[x], ids[y]))
                root[root == root[y]] = root[x]

    alone, at = np.ones(m, bool), 0
    while True:
        left = int(alone.sum())
        compare(at, np.flatnonzero(root != root[at]))
        alone &= root != root[at]
        alone[: at + 1] = False
        rest = np.flatnonzero(alone)
        if not len(rest) or (left - len(rest)) * 16 < left:
            break
        at = int(rest[0])
    if m == 2 or not (root != root[0]).any():
        return out

    count = np.bincount(place)
    order = np.lexsort((place, count[place], owner))
    within = np.arange(len(order)) - offsets[owner[order]]
    prefix = sizes - -(-percent * sizes // 100) + 1
    some = order[(within < prefix[owner[order]]) & (count[place[order]] > 1)]
    if not len(some):
        return out
    some = some[np.argsort(place[some], kind="stable")]
    token, text = place[some], owner[some]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    ends = np.r_[starts[1:], len(token)]
    mixed = np.flatnonzero(np.minimum.reduceat(root[text], starts) != np.maximum.reduceat(root[text], starts))
    held: list[np.ndarray] = []
    size = 0

    def settle() -> None:
        """Compares the pairs that are held, each once."""
        nonlocal held, size
        pairs = np.unique(np.concatenate(held))
        held, size = [], 0
        x, y = pairs // m, pairs % m
        cuts = np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            k, others = int(x[a]), y[a:z]
            others = others[(root[others] != root[k]) & (100 * np.minimum(sizes[others], sizes[k]) >= percent * np.maximum(sizes[others], sizes[k]))]
            if len(others):
                compare(k, others)

    for g in mixed.tolist():
        members = text[starts[g] : ends[g]]
        of = root[members]
        kinds, which, n = np.unique(of, return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            continue
        most = int(n.argmax())
        whole, few = members[which == most], np.flatnonzero(which != most)
        for k in few.tolist():  # with all of the largest component, and with later ones of other components
            later = few[few > k]
            against = np.concatenate([whole, members[later[of[later] != of[k]]]])
            held.append(np.minimum(members[k], against) * m + np.maximum(members[k], against))
            size += len(against)
            if size > PAIRS:
                settle()
    if held:
        settle()
    return out


def stars(links: DataFrame) -> DataFrame:
    """(rep, component) of all nodes of links (a, b): the smallest node of each connected component.

    A large-star step hangs each node's larger neighbours on the smallest node next to it, a small-star step its smaller ones
    and itself; both keep components. They alternate until every edge leads from a node to its one root. Edges of hubs are met
    by a broadcast join, so they stay spread over tasks.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")

    def hung(on: DataFrame, least: DataFrame) -> DataFrame:
        """Edges with the m of their a."""
        hub = max(1_000, n_edges // HUBS)
        few = F.broadcast(least.where(F.col("n") >= hub).select("a", "m"))
        rest = on.join(F.broadcast(least.where(F.col("n") >= hub).select("a")), "a", "left_anti").join(least.where(F.col("n") < hub).select("a", "m"), "a")
        return on.join(few, "a").unionByName(rest)

    while n_edges := edges.count():
        parents = edges.groupBy("a").agg(F.count("*").alias("n"))
        if not edges.select(F.col("b").alias("a")).join(parents, "a", "left_semi").limit(1).count() and not parents.where("n > 1").limit(1).count():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = written(hung(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "star")
        dropped(edges, least)
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = hung(large, least).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.where("a != b").distinct(), "edges")
        dropped(large, least)
    roots = edges.select(F.col("b").alias("rep")).distinct().withColumn("component", F.col("rep"))
    out = written(edges.select(F.col("a").alias("rep"), F.col("b").alias("component")).unionByName(roots), "found")
    dropped(edges)
    return out


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), shingle=4)


OP9_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i+3], 'string_agg', ' ')))
    when len(w) > 0 then [list_aggregate(w, 'string_agg', ' ')] else [] end as s
  from words
), long as (select doc_id, unnest(s) as h, len(s) as n from sets),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as inner_n, any_value(x.n) as na, any_value(y.n) as nb
  from long x join long y on x.h = y.h and x.doc_id < y.doc_id group by x.doc_id, y.doc_id
), links as (select a, b from common where 100 * inner_n >= 80 * (na + nb - inner_n)),
pairs as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from sets union select r.a, l.b from reach r join pairs l on r.b = l.a)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.b) as component_id, min(r.b) = s.doc_id as kept
from sets s join reach r on r.a = s.doc_id group by s.doc_id, len(s.s)
"""
