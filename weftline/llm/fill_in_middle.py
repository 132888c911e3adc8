"""Fill-in-middle transformation by bit-parallel integers.

A text's UTF-8 bytes become one integer: bytes.translate maps each byte to the digit of its class, and the digits, read in base
two, are a mask with bit i for byte i. Shifts and boolean operations on whole masks mark the bytes at which units end, bit_count
says how many there are, and the unit of a given rank is found by halving the mask until one bit is left. So a text is never
cut into Python objects for its units: a mask takes an eighth of the text's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, sliced, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"


def _digits(ones) -> bytes:
    """A table for bytes.translate: the digit 1 for bytes of a class, 0 for all others."""
    return bytes(49 if b in ones else 48 for b in range(256))


LEADS = _digits([b for b in range(256) if not 0x80 <= b < 0xC0])  # first bytes of code points
WORDS = _digits([b for b in range(256) if b not in (" " + SPACES).encode()])
FEEDS = _digits([10])


def mask(text: bytes, digits: bytes) -> int:
    """Bit i tells whether byte i is of the class."""
    return int(text.translate(digits)[::-1], 2) if text else 0


def ends(text: bytes, unit: str = "code_points") -> int:
    """A mask of the bytes that end a unit. Code points; words, each with the white space behind it, the first also with that
    before it; or lines with their line feed. A text that isn't empty has one unit at least, and its last byte ends one."""
    if not text:
        return 0
    last = 1 << (len(text) - 1)
    if unit == "code_points":
        return mask(text, LEADS) >> 1 | last
    if unit == "lines":
        return mask(text, FEEDS) | last
    if unit == "words":
        inside = mask(text, WORDS)
        starts = inside & ~(inside << 1)
        return (starts & (starts - 1)) >> 1 | last  # all starts but the first: the byte before each ends a unit
    raise ValueError(f"no such unit: {unit}")


def selected(bits: int, rank: int, width: int) -> int:
    """The place of the set bit of that rank (0: the lowest) among width bits, by halving."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - n, at + half
    return at


def cut(text: bytes, marks: int, units: int) -> int:
    """How many bytes the first units take, given the mask of ends."""
    return selected(marks, units - 1, len(text)) + 1 if units else 0


def transform(text: bytes, h: tuple[int, int, int, int], unit: str = "code_points", plain_percent: int = 10, spm_percent: int = 20) -> tuple:
    """n, form, units of prefix and of middle (None if plain), output; h are four numbers that decide cuts and form."""
    marks = ends(text, unit)
    n = marks.bit_count()
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - plain_percent:
        return n, PLAIN, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = cut(text, marks, a), cut(text, marks, b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h[3] % 100 < spm_percent:
        return n, SPM, a, b - a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, PSM, a, b - a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that transform() made an output of. No mark can begin within another, so the first of each is the one that was put."""
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    a, rest = output[len(first) :].split(second, 1)
    b, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (a, b) if form == PSM else (b, a)
    return prefix + middle + suffix


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits: the first groups of eight digits of the SHA-256 of seed, a colon and the key in decimal. A null key
    has no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def filled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "code_points", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """One row for each row of docs: its id, n (units of the text), form (plain, psm or spm), prefix_chars and middle_chars (in
    units; null if plain) and output (string).

    Whole texts are cut, of any length. Null and empty texts give n 0, form plain and an empty output. Rows of equal id and text,
    and null ids, which all draw the same numbers, give equal rows; none is left out. Other columns are not read. There is no
    shuffle, and a task holds a slice of a few MB or one text.
    """
    h = draws(F.col(id_col), seed)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *(c.alias(f"h{k}") for k, c in enumerate(h)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts, drawn = b.column(1).to_pylist(), zip(*(b.column(2 + k).to_pylist() for k in range(4)), strict=True)
            made = [transform(t, d, unit, plain_percent, spm_percent) for t, d in zip(texts, drawn, strict=True)]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = rows.mapInArrow(run, f"id {kind}, {SCHEMA}")
    return out.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(outputs: DataFrame) -> DataFrame:
    """outputs (with form and output, of filled()) with restored, the text that each was made of, before all its columns. A null
    output gives an empty text, a null form counts as plain."""
    own = F.when(F.col("output").isNull(), F.lit(PLAIN)).otherwise(F.coalesce("form", F.lit(PLAIN)))
    rows = outputs.select(own.alias("its form"), F.coalesce("output", F.lit("")).cast("binary").alias("its output"), F.struct(*(F.col(f"`{c}`") for c in outputs.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [restore(o, f) for f, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), b.column(2)], names=["restored", "row"])

    back = rows.mapInArrow(run, T.StructType([T.StructField("restored", T.BinaryType()), T.StructField("row", outputs.schema)]))
    return back.select(F.col("restored").cast("string").alias("restored"), *(F.col("row").getField(c).alias(c) for c in outputs.columns))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restored(filled(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


_H = ", ".join(f"('0x' || substr(d, {1 + 8 * k}, 8))::bigint as h{k + 1}" for k in range(4))
OP13_SQL = f"""
with digests as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as d from documents),
drawn as (select doc_id, t, length(t)::bigint as n, {_H} from digests),
formed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
),
parts as (select *, substr(t, 1, a) as prefix, substr(t, a + 1, b - a) as middle, substr(t, b + 1) as suffix from formed)
select doc_id, n, form,
  case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""
