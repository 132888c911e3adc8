"""Removal of repeated passages: every byte in a string of 100 bytes that also starts earlier in the corpus.

Of each 100-byte window one place is chosen by its content, that of the smallest hash of 24 bytes in it, so equal windows
choose alike. Where several windows chose places of one hash, the suffixes that start there and the reversed text before them are
put in order by deep-shallow sorting; prefixes that neighbours have in common tell which windows are equal, and all but the first
are removed. Suffixes are dealt to tasks by that hash; where too many share it, by more and more of their own bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, ordered_numbers, parts, sliced, table, tidied, written
from .deep_shallow import deep_shallow
from .minhash import _BYTES, _bytes, _mixed, _powers

LENGTH, GRAM = 100, 24
#: Places in a window.
PLACES = LENGTH - GRAM + 1
#: Suffixes that one task puts in order together, at most, some 200 bytes each; where more share their bytes, they are dealt by more of them.
MOST_MEETING = 50_000
#: Documents whose ids are sent to all executors, 8 bytes each. Beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000
CHUNK = 1 << 20


def places(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """All places that windows of some texts choose: text number, place, hash of the 24 bytes there."""
    out, at = [], 0
    while at < len(texts):
        size, end = len(texts[at]), at + 1
        while end < len(texts) and size + len(texts[end]) < CHUNK:
            size += len(texts[end])
            end += 1
        out.append(_chunk(texts[at:end], at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _chunk(texts: list[bytes], first: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < LENGTH or sizes.max() < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    up, down = _powers.of(max(n + 1, CHUNK))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:n])])
    gram = _mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    # The smallest of the hashes at a window's places, by its upper bits; of equal ones the leftmost.
    low = np.uint64((1 << 31) - 1)
    best = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    reach = 1
    while reach * 2 <= PLACES:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    best = np.minimum(best[: len(best) - (PLACES - reach)], best[PLACES - reach :])
    place = (best & low).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(place)]
    inside = np.arange(len(place)) + LENGTH <= ends[owner]
    place = np.unique(place[inside])  # no window crosses texts, so a place has one owner
    owner = np.searchsorted(ends, place, side="right")
    return owner + first, place - (ends - sizes)[owner], gram[place]


def repeated_in(lefts: list[bytes], rights: list[bytes]) -> list[tuple[int, int, int]]:
    """Of places, in order of the corpus: (number, lo, hi) for runs of windows that start lo to hi bytes before the place and also
    stand around an earlier place."""
    m = len(lefts)
    first: dict[tuple[bytes, bytes], int] = {}
    heads = [first.setdefault(x, k) for k, x in enumerate(zip(lefts, rights, strict=True))]
    # What has the same text around it as an earlier place is gone as far as windows reach; the rest is put in order.
    out = [(k, lo, hi) for k, h in enumerate(heads) if h != k and (lo := max(0, LENGTH - len(rights[k]))) <= (hi := min(PLACES - 1, len(lefts[k])))]
    which = np.fromiter(first.values(), np.int64, len(first))
    m = len(which)
    if m < 2:
        return out
    lefts, rights = [lefts[k] for k in which.tolist()], [rights[k] for k in which.tolist()]
    order_r, common_r = deep_shallow(rights)
    order_l, common_l = deep_shallow([x[::-1] for x in lefts])
    size_r, size_l = (np.fromiter(map(len, x), np.int64, m) for x in (rights, lefts))
    gone = np.zeros((m, PLACES + 1), bool)
    class_r, class_l = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for back in range(PLACES):
        class_r[order_r] = np.cumsum(common_r < LENGTH - back)
        class_l[order_l] = np.cumsum(common_l < back) if back else 0
        can = np.flatnonzero((size_r >= LENGTH - back) & (size_l >= back))
        if len(can) > 1:
            _, head, of = np.unique(class_r[can] * (m + 1) + class_l[can], return_index=True, return_inverse=True)
            gone[can, back] = head[of] != np.arange(len(can))
    step = np.diff(np.pad(gone.astype(np.int8), ((0, 0), (1, 0))), axis=1)
    rows, lo = np.nonzero(step == 1)
    _, hi = np.nonzero(step == -1)
    return out + list(zip(which[rows].tolist(), lo.tolist(), (hi - 1).tolist(), strict=True))


@tidied
def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_meeting: int = MOST_MEETING) -> DataFrame:
    """One row for each row of docs: its id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256.

    Texts are their UTF-8 bytes, matches never cross texts, and what is judged is the input, not what is left. Earlier means a
    smaller id, then an earlier start; rows with one id follow by a hash of their text, then in any order; null ids come first.
    Null and empty texts have 0 bytes. Of equal texts of 100 bytes or more all but the first are removed whole.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    source = docs.select(F.col(id_col).alias("id"), raw.alias("raw"))
    facts = source.select("id", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("sha"))
    facts = written(facts, "facts")
    n, distinct, low, high, longest = facts.agg(F.count("*"), F.countDistinct("id"), F.coalesce(F.min("id"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.max("n_bytes"), F.lit(0))).first()
    bits = max(1, int(longest).bit_length())
    plain = n == distinct and low >= 0 and int(high).bit_length() + bits <= 62
    if plain:  # ids order and tell apart the texts as they are
        facts = facts.withColumn("doc", F.col("id").cast("long"))
        source = source.select(F.col("id").cast("long").alias("doc"), "raw")
    else:
        facts = ordered_numbers(facts, ["id", "sha"], "doc")
        keys = facts.groupBy("id", "sha").agg(F.min("doc").alias("doc"))
        source = source.alias("s").join(keys.alias("k"), F.expr("s.id <=> k.id and sha2(s.raw, 256) = k.sha")).select("doc", "raw").dropDuplicates(["doc"])
    firsts = facts.groupBy("sha").agg(F.min("doc").alias("first"))
    facts = written(facts.join(firsts, "sha").withColumn("copy", F.col("doc") != F.col("first")).drop("first"), "copies")

    def texts(ids: DataFrame, how: str) -> DataFrame:
        """The rows of source with, or without, these ids."""
        few = ids.count() <= MOST_BROADCAST
        return source.join(F.broadcast(ids) if few else ids, "doc", how)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            owner, place, h = places(_bytes(b.column(1)))
            doc = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((doc[owner] << bits) + place)], names=["h", "at"])

    doc_of = lambda c: F.shiftright(c, bits)
    place_of = lambda c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1))
    copies = written(facts.where(F.col("copy") & (F.col("n_bytes") >= LENGTH)).select("doc"), "copied")
    found = written(texts(copies, "left_anti").select("doc", "raw").mapInArrow(find, "h bigint, at bigint"), "places")
    sizes = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "meeting")
    # A text's own places are as many as its size allows.
    wanted = found.join(sizes, "h").groupBy(doc_of("at").alias("doc")).agg(F.collect_list(F.struct("h", place_of("at").cast("int").alias("place"))).alias("places"))
    wanted = written(wanted, "wanted")
    dropped(found)
    around = texts(wanted.select("doc"), "left_semi").join(wanted, "doc").select("doc", "raw", "places").mapInArrow(_around, "h bigint, doc bigint, place int, left binary, right binary")
    around = around.select("h", (F.shiftleft("doc", bits) + F.col("place")).alias("at"), "left", "right")
    crowds = written(sizes.where(F.col("n") > most_meeting).select("h"), "crowds")
    if crowds.limit(1).count():
        around = written(around, "around")
        gone = _in_suffix_order(around.join(F.broadcast(crowds) if crowds.count() <= MOST_BROADCAST else crowds, "h", "left_anti"))
        gone = gone.unionByName(_crowded(around.join(crowds, "h", "left_semi"), most_meeting))
    else:
        gone = _in_suffix_order(around)
    spans = written(gone.groupBy(doc_of("at").alias("doc")).agg(F.collect_list(F.struct(place_of("at").cast("int").alias("at"), "size")).alias("spans")), "spans")
    cut = texts(spans.select("doc"), "left_semi").join(spans, "doc").select("doc", "raw", "spans").mapInArrow(_cut, "doc bigint, n_removed bigint, n_spans bigint, kept string")
    whole = facts.join(cut, "doc", "left")
    copied = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    return whole.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc, raw, places): what stands around each place."""
    for b in sliced(batches):
        h, doc, place, left, right = [], [], [], [], []
        for d, t, places in zip(b.column(0).to_pylist(), _bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            for x in places:
                p = x["place"]
                h.append(x["h"])
                doc.append(d)
                place.append(p)
                left.append(t[max(0, p - PLACES + 1) : p])
                right.append(t[p : p + LENGTH])
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(place, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["h", "doc", "place", "left", "right"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc, raw, spans): what is left."""
    for b in sliced(batches):
        out = []
        for d, t, spans in zip(b.column(0).to_pylist(), _bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            kept, at, n = [], 0, 0
            for a, z in sorted((x["at"], x["at"] + x["size"]) for x in spans):
                if a > at or not n:
                    n += 1
                    kept.append(t[at:a])
                at = max(at, z)
            kept.append(t[at:])
            left = b"".join(kept)
            out.append((d, len(t) - len(left), n, hashlib.sha256(left).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc", "n_removed", "n_spans", "kept"])


def _in_suffix_order(around: DataFrame) -> DataFrame:
    """(at, size): what to remove, of suffixes (h, at, left, right) that are few for each h."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: list) -> pa.RecordBatch:
            rows = [*{r[1]: r for r in sorted(rows, key=lambda r: r[1])}.values()]  # a suffix may be in two groups
            runs = repeated_in([r[2] for r in rows], [r[3] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([rows[k][1] - hi for k, _, hi in runs], pa.int64()), pa.array([LENGTH + hi - lo for _, lo, hi in runs], pa.int32())], names=["at", "size"])

        held: list = []
        for b in sliced(batches, 3):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= 10_000 and r[0] != held[-1][0]:
                    yield judged(held)
                    held = []
                held.append(r)
        if held:
            yield judged(held)

    return around.repartition(parts(around.sparkSession), "h").sortWithinPartitions("h").mapInArrow(compare, "at bigint, size int")


def _crowded(around: DataFrame, most_meeting: int) -> DataFrame:
    """As _in_suffix_order, where very many suffixes share an h.

    Those with the same text around them count once. The others are dealt by more of their bytes: of two that share a window of
    100 bytes, and r bytes on the right and l on the left for certain, either half of what is missing is shared on the right, or
    else enough on the left. Groups that are small enough are put in order; where all 100 bytes are the key, the first one stays.
    """
    first = written(around.groupBy("h", "left", "right").agg(F.min("at").alias("first")), "first-of-crowd")
    reach = F.least(F.lit(PLACES - 1), F.octet_length("left")), F.greatest(F.lit(0), F.lit(LENGTH) - F.octet_length("right"))
    again = around.join(first, ["h", "left", "right"]).where((F.col("at") != F.col("first")) & (reach[0] >= reach[1]))
    gone = again.select((F.col("at") - reach[0]).alias("at"), (F.lit(LENGTH) + reach[0] - reach[1]).cast("int").alias("size"))
    rows = first.select("h", F.col("first").alias("at"), "left", "right", F.lit(GRAM).alias("r"), F.lit(0).alias("l"))
    while True:
        more = F.col("r") + F.ceil((F.lit(LENGTH) - F.col("r") - F.col("l")) / 2).cast("int")
        ways = F.array(F.struct(more.alias("r"), F.col("l").alias("l")), F.struct(F.col("r").alias("r"), (F.lit(LENGTH + 1) - more).alias("l")))
        dealt = rows.withColumn("way", F.explode(ways)).select("h", "at", "left", "right", "way.r", "way.l").where((F.octet_length("right") >= F.col("r")) & (F.octet_length("left") >= F.col("l")))
        key = F.concat(F.substr("left", F.octet_length("left") - F.col("l") + 1, F.col("l")), F.substr("right", F.lit(1), F.col("r")))
        dealt = written(dealt.withColumn("key", key), "dealt")
        whole = dealt.where(F.col("r") + F.col("l") == LENGTH)
        least = whole.groupBy("key", "l").agg(F.min("at").alias("first"))
        gone = gone.unionByName(whole.join(least, ["key", "l"]).where("at != first").select((F.col("at") - F.col("l")).alias("at"), F.lit(LENGTH).alias("size")))
        sizes = written(dealt.where(F.col("r") + F.col("l") < LENGTH).groupBy("key", "r", "l").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        grouped = dealt.join(sizes, ["key", "r", "l"])
        gone = gone.unionByName(_in_suffix_order(grouped.where(F.col("n") <= most_meeting).select(F.xxhash64("key", "r", "l").alias("h"), "at", "left", "right")))
        if not sizes.where(F.col("n") > most_meeting).limit(1).count():
            return gone
        rows = grouped.where(F.col("n") > most_meeting).select("h", "at", "left", "right", "r", "l")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
