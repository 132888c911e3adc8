"""Secret scans: exact patterns, and a character convolutional network over every candidate and what surrounds it.

Candidates are all spans of the base patterns, values behind settings' names from 6 characters on, and runs of secret-like
characters (from 16 on, or 6 if they aren't words or numbers alone), whole, in parts and in windows. The network is numpy: characters are
embedded, convolved and pooled apart over the candidate and over its context. It is trained on labelled findings, its
scores are calibrated on findings held back, and each kind's threshold is the largest that keeps the recall asked for.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

#: Kinds in the order that spans of one start are listed in; net has the spans that the network adds.
KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{6,}")
#: What separates the parts of a run, and parts that are words or numbers.
PART, PLAIN = re.compile(r"[^/.=]{6,}"), re.compile(r"[A-Z]?[a-z]*|[A-Z]+|[0-9]+")
#: Values, of any characters, behind what a setting's name may end with, or behind "bearer".
SETTING = re.compile(r"""(?:(?<=[A-Za-z0-9_"'\]])\x20{0,8}[:=]>?\x20{0,8}|(?i:bearer)\x20{1,8})["'`]?(?=([^\s"'`<>]{6,}))""")
#: Characters of a run, without a setting's name before it, from which on it is a candidate even if it is plain words or numbers.
LONG = 16
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Characters of context on each side, and of a candidate's beginning and end, that the network sees.
SIDE, HALF = 24, 32
WIDTH = 2 * (SIDE + HALF)
LETTERS = {chr(c): c - 30 for c in range(32, 127)}
SIZE = 98  # of the alphabet: 0 is no character, 1 any other


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each base finding, in code points: leftmost matches of each kind that don't overlap."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base spans leave of runs and of settings' values, from 6 characters on: whole, cut at separators, and in overlapping
    windows where they are longer than the network sees. Outside settings, runs under 16 characters of words or numbers alone
    are none."""
    out: set[tuple[int, int]] = set()
    taken: list[tuple[int, int]] = []  # base spans, overlapping ones as one
    for a, _, z in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(z, taken[-1][1])
        else:
            taken.append((a, z))
    ends = [z for _, z in taken]

    def add(s: int, e: int, setting: bool) -> None:
        if e - s < 6 or not (setting or e - s >= LONG or not all(PLAIN.fullmatch(x) for x in re.split(r"[+/_=.-]", text[s:e]))):
            return
        if e - s <= 2 * HALF:
            out.add((s, e))
        else:
            out.update((max(s, min(k, e - 2 * HALF)), min(k + 2 * HALF, e)) for k in range(s, e - HALF, HALF))

    def cut(s: int, e: int, setting: bool) -> None:
        k = bisect_right(ends, s)  # the first base span that ends behind the start
        while s < e:
            a, z = taken[k] if k < len(taken) and taken[k][0] < e else (e, e)
            if s < a:
                add(s, a, setting)
                for m in PART.finditer(text, s, a):
                    add(m.start(), m.end(), setting and m.start() == s)
            s, k = max(s, z), k + 1

    for m in SETTING.finditer(text):
        cut(m.start(1), m.start(1) + len(m[1].rstrip(".,;:)]}")), True)
    for m in RUN.finditer(text):
        cut(m.start(), m.end(), False)
    return sorted(out)


def seen(text: str, start: int, end: int) -> list[int]:
    """What the network sees of a candidate: context, first and last characters, context; 0 where there is none."""
    inside = text[start:end]
    middle = inside[:HALF].ljust(HALF, "\0") + (inside[HALF:][-HALF:]).ljust(HALF, "\0")
    window = text[max(0, start - SIDE) : start].rjust(SIDE, "\0") + middle + text[end : end + SIDE].ljust(SIDE, "\0")
    return [0 if c == "\0" else LETTERS.get(c, 1) for c in window]


#: What each pooled part of the window is: the candidate, and its context.
INSIDE = np.r_[np.zeros(SIDE, bool), np.ones(2 * HALF, bool), np.zeros(SIDE, bool)]


@dataclass
class Net:
    """Embedding, one convolution of width 5, ReLU, max and mean pools of both parts, one hidden layer."""

    embed: int = 8
    filters: int = 24
    hidden: int = 16
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        r = np.random.default_rng(self.seed)
        shapes = {"e": (SIZE, self.embed), "c": (5 * self.embed, self.filters), "cb": (self.filters,), "h": (4 * self.filters, self.hidden), "hb": (self.hidden,), "o": (self.hidden,), "ob": (1,)}
        self.p = self.p or {k: r.normal(0, 1 / np.sqrt(s[0]) if len(s) > 1 and k != "e" else 0.3, s) * (k[-1] != "b") for k, s in shapes.items()}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, n = self.p, len(x)
        emb = np.pad(p["e"][x] * (x > 0)[..., None], ((0, 0), (2, 2), (0, 0)))
        cols = np.concatenate([emb[:, k : k + WIDTH] for k in range(5)], axis=2)
        conv = np.maximum(cols @ p["c"] + p["cb"], 0)
        pools, args = [], []
        for part in (INSIDE, ~INSIDE):
            mask = ((x > 0) & part)[..., None]
            masked = np.where(mask, conv, 0)
            args.append(masked.argmax(1))
            pools += [np.take_along_axis(masked, args[-1][:, None], 1)[:, 0], masked.sum(1) / np.maximum(1, mask.sum(1))]
        flat = np.concatenate(pools, 1)
        hid = np.maximum(flat @ p["h"] + p["hb"], 0)
        return hid @ p["o"] + p["ob"][0], (x, cols, conv, args, flat, hid, n)

    def backward(self, kept: tuple, dz: np.ndarray) -> dict[str, np.ndarray]:
        x, cols, conv, args, flat, hid, n = kept
        p, f = self.p, self.filters
        g = {"o": hid.T @ dz, "ob": np.array([dz.sum()])}
        dh = np.outer(dz, p["o"]) * (hid > 0)
        g["h"], g["hb"] = flat.T @ dh, dh.sum(0)
        df, dc = dh @ p["h"].T, np.zeros_like(conv)
        for k, part in enumerate((INSIDE, ~INSIDE)):
            mask = ((x > 0) & part)[..., None]
            dc += mask * (df[:, (2 * k + 1) * f : (2 * k + 2) * f] / np.maximum(1, mask.sum(1)))[:, None]
            at = np.take_along_axis(dc, args[k][:, None], 1) + df[:, 2 * k * f : (2 * k + 1) * f][:, None]
            np.put_along_axis(dc, args[k][:, None], at, 1)
        dc *= conv > 0
        g["c"], g["cb"] = np.tensordot(cols, dc, ((0, 1), (0, 1))), dc.sum((0, 1))
        de = np.zeros((n, WIDTH + 4, self.embed))
        dcols = dc @ p["c"].T
        for k in range(5):
            de[:, k : k + WIDTH] += dcols[:, :, k * self.embed : (k + 1) * self.embed]
        ge = np.zeros_like(p["e"])
        np.add.at(ge, x, de[:, 2:-2] * (x > 0)[..., None])
        return g | {"e": ge}

    def scores(self, windows: list[list[int]]) -> np.ndarray:
        """Calibrated: the share of secrets among findings of such a score."""
        if not windows:
            return np.zeros(0)
        x = np.array(windows, np.int64)
        z = np.concatenate([self.forward(x[k : k + 512])[0] for k in range(0, len(x), 512)])
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -40, 40)))


def shape(text: str) -> str:
    """The kind of candidate that a threshold holds for."""
    if len(text) < LONG:
        return "short"
    if re.fullmatch(r"[0-9a-fA-F-]+", text):
        return "digits"
    return "mixed" if any(c.isupper() for c in text) and any(c.islower() for c in text) else "plain"


def labelled_findings(n: int, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of findings made by rule: keys and tokens in public formats and passwords in settings, and what
    looks like them: identifiers, paths, versions, dates, numbers, host names, document ids and long words."""
    r = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(chars[i] for i in r.integers(0, len(chars), k))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve")
    word = lambda: "".join(syllables[i] for i in r.integers(0, len(syllables), r.integers(1, 5)))
    words = lambda k: " ".join(word() for _ in range(k))
    integer = lambda a, z: int(r.integers(a, z))
    secret = (
        lambda: pick(num + "abcdef", 16 + integer(0, 48)), lambda: pick(num + "ABCDEF", 16 + integer(0, 48)), lambda: pick(low + up + num + "+/", 20 + integer(0, 44)) + "=" * integer(0, 3), lambda: pick(low + up + num, 16 + integer(0, 32)),
        lambda: "ghp_" + pick(low + up + num, 36), lambda: "sk_live_" + pick(low + up + num, 24), lambda: "xoxb-" + pick(num, 12) + "-" + pick(low + up + num, 24), lambda: "eyJ" + pick(low + up + num + "-_", 30) + "." + pick(low + up + num + "-_", 40), lambda: "AIza" + pick(low + up + num + "-_", 35), lambda: "AKIA" + pick(up + num, 16),
    )
    benign = (
        lambda: "_".join(word() for _ in range(3)) + "_" + str(integer(1, 99)), lambda: "/".join(word() for _ in range(3)) + f"/v{integer(1, 9)}", lambda: f"{word()}.{word()}.{word()}{integer(1, 99)}.example.com", lambda: f"{integer(1990, 2030)}-{integer(10, 13)}-{integer(10, 29)}T{integer(10, 24)}.{integer(10, 60)}.{integer(10, 60)}Z", lambda: f"{word()}-{integer(0, 9)}.{integer(0, 30)}.{integer(0, 99)}-release",
        lambda: word() + word() + word() + "-" + word() + str(integer(0, 9)), lambda: word().title() + word().title() + word().title() + str(integer(0, 99)), lambda: pick(num, 16) + word()[:2], lambda: f"{integer(1, 255)}.{integer(1, 255)}.{integer(1, 255)}.{integer(1, 255)}_{word()}", lambda: word().upper() + "-" + word().upper() + "-" + pick(num, 8), lambda: "=" * 18 + word() + str(integer(0, 9)), lambda: f"{word()}{integer(1, 99)}/{word()}_{word()}.html",
    )
    keys = ("password", "passwd", "secret", "token", "api_key", "apikey", "auth", "bearer", "private_key", "credential")
    out = []
    spoken = lambda k: "".join(pick("bcdfghklmnprstvwz", 1 + integer(0, 2)) + pick("aeiou", 1 + integer(0, 2)) + pick("nrstlchm", integer(0, 2)) for _ in range(k))
    path = lambda: "/".join(word() for _ in range(integer(2, 5)))
    for k in range(n):
        label = k % 2
        if integer(0, 3) == 0:  # short values: passwords behind settings, and what else stands there or looks like them
            if label:
                value = (lambda: pick(low + up + num, 6 + integer(0, 10)), lambda: word() + word() + pick(num, 1 + integer(0, 4)) + word() * integer(0, 2), lambda: pick(low + up + num + "!@#~$%^&*", 6 + integer(0, 14)), lambda: word().title() + pick("!@#~$", 1) + pick(num, 2 + integer(0, 3)) + word(), lambda: pick(low + up, 16 + integer(0, 16)))[integer(0, 5)]()
                value = value if len(value) >= 6 else value + pick(num, 6 - len(value))
            else:
                value = (lambda: (word() + word() + word())[:15], lambda: word().title() + word() + "ing", lambda: f"{integer(1990, 2030)}-{integer(10, 13)}-{integer(10, 29)}", lambda: f"{integer(1, 99)}.{integer(0, 99)}.{integer(0, 99)}", lambda: pick(num, 6 + integer(0, 6)), lambda: word() + "_" + word() + str(integer(0, 9)), lambda: f"{word()}.{word()}@{word()}.com", lambda: f"{word()}/{word()}{integer(0, 9)}.html", lambda: word().title() + word().title(), lambda: word() + "-" + word() + "s", lambda: "=" * integer(6, 30), lambda: "-" * integer(6, 30), lambda: f"{word()}{integer(1, 30)}.{word()}", lambda: pick(num, 16 + integer(0, 8)), lambda: spoken(5), lambda: spoken(6).title(), lambda: spoken(7), lambda: "".join(word() for _ in range(8))[:30], lambda: spoken(5).upper())[integer(0, 19)]()
                value = value if len(value) >= 6 else value + "thering"[: 7 - len(value)]
            name = ("pwd", "pass", "passphrase", *keys[6:])[integer(0, 7)] if label or integer(0, 6) == 0 and value.isalpha() and value.islower() else word()
            quote = ('"', "'", "")[integer(0, 3)]
            before = f"{words(4)} {name}{(': ', ' = ', '=', ':')[integer(0, 4)]}{quote}" if label or integer(0, 2) else f"{words(5)} "
            out.append((f"{before}{value}{quote} {words(4)}", len(before), len(before) + len(value), label))
            continue
        kinds = secret if label else benign
        value = kinds[integer(0, len(kinds))]()
        value = value if len(value) >= 16 else value + "-" + word() + pick(num, 16 - len(value))
        how = integer(0, 4)
        before = f"{words(4)} {keys[integer(0, len(keys))]} = \"" if label and how == 0 else f"{words(4)} {word()}: " if how == 1 else f"{words(5)} "
        after = f" {words(4)}"
        if how == 2:  # a part of a longer run
            before, after = f"{words(2)} {path()}/", f"/{path()}{('', '.html')[integer(0, 2)]} {words(2)}"
        elif how == 3 and integer(0, 2):  # a window of a longer run, the candidate somewhere in it
            head, tail = f"{path()}/{path()}/", f"/{path()}/{path()}"
            value = (value if label else path())[: 2 * HALF]
            whole, at = head + value + tail, len(head) - integer(0, 1 + min(len(head), 2 * HALF - len(value)))
            before, value, after = f"{words(2)} {whole[:at]}", whole[at : at + 2 * HALF], f"{whole[at + 2 * HALF :]} {words(2)}"
        out.append((f"{before}{value}{after}", len(before), len(before) + len(value), label))
    return out


def train(findings: list[tuple[str, int, int, int]], recall: float = 0.95, epochs: int = 6, rate: float = 4e-3, batch: int = 64) -> Net:
    """Fits the network to eight tenths of the findings, its calibration to the ninth and the thresholds to the last: each kind's is
    the largest that keeps the recall asked for there. A kind without secrets gets 1, which next to nothing passes."""
    x = np.array([seen(t, s, e) for t, s, e, _ in findings], np.int64)
    y = np.array([f[3] for f in findings], np.float64)
    tenth = np.arange(len(x)) // 2 % 10  # labels alternate
    back = tenth == 8
    net, r = Net(), np.random.default_rng(3)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    fit, step = np.flatnonzero(tenth < 8), 0
    for _ in range(epochs):
        r.shuffle(fit)
        for at in range(0, len(fit), batch):
            some = fit[at : at + batch]
            z, kept = net.forward(x[some])
            step += 1
            for k, g in net.backward(kept, (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[some]) / len(some)).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    z, held = net.forward(x[back])[0], y[back]
    a, b = 1.0, 0.0
    for _ in range(300):  # Platt's scaling
        s = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        a, b = a - 0.05 * np.mean((s - held) * z), b - 0.05 * np.mean(s - held)
    net.scale = (float(a), float(b))
    last = np.flatnonzero(tenth == 9)
    score = net.scores(x[last].tolist())
    kinds = [shape(findings[k][0][findings[k][1] : findings[k][2]]) for k in last]
    for kind in ("digits", "mixed", "plain", "short"):
        own = np.sort([p for p, k, n in zip(score, kinds, last, strict=True) if k == kind and y[n] == 1])
        net.thresholds[kind] = float(own[int((1 - recall) * len(own))]) if len(own) else 1.0
    return net


@lru_cache(2)
def default_net(findings: int = 16000) -> Net:
    return train(labelled_findings(findings))


def found_in(texts: list[str | None], net: Net) -> list[list[tuple[int, str, int, float]]]:
    """For each text (start, kind, end, score) of its findings, by start, then kind."""
    spans, windows, owners = [], [], []
    for k, t in enumerate(texts):
        base = base_spans(t) if t else []
        spans.append([(s, KINDS[c], e) for s, c, e in base] + ([(s, "net", e) for s, e in candidates(t, base)] if t else []))
        for i, (s, _, e) in enumerate(spans[-1]):
            windows.append(seen(t, s, e))
            owners.append((k, i, shape(t[s:e])))
    out: list[list] = [[] for _ in spans]
    for (k, i, form), score in zip(owners, net.scores(windows).tolist(), strict=True):
        s, name, e = spans[k][i]
        if name != "net":
            out[k].append((s, name, e, score))
        elif score >= net.thresholds[form]:
            last = out[k][-1] if out[k] else (0, "", 0, 0.0)
            if last[1] == "net" and s < last[2]:  # candidates that overlap are one finding
                s, e, score = out[k].pop()[0], max(e, last[2]), max(score, last[3])
            out[k].append((s, name, e, score))
    return [sorted(x, key=lambda f: (f[0], KINDS.index(f[1]))) for x in out]


def scan(docs: DataFrame, net: Net | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: its id, the columns of keep, and findings: structs of kind, start, end (code points, end
    exclusive) and the network's score, by start, then kind.

    Base findings stay whatever their score; the network adds candidates that pass the threshold of their shape. Null and
    empty texts have no findings. Whole texts are read, of any length; repeated rows give a row each.
    """
    net = net or default_net()
    names = [id_col, *keep]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, len(names)):
            rows = [[{"kind": k, "start": s, "end": e, "score": p} for s, k, e, p in found] for found in found_in(b.column(len(names)).to_pylist(), net)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(rows, kind)], names=[*names, "findings"])

    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, F.col(text_col).alias("scanned text")).mapInArrow(run, f"{schema}, findings array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "<SECRET>") -> str:
    """The text with each span, overlapping ones together, replaced by the mark."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, net: Net | None = None, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with all findings of scan() replaced by a mark in their texts, and the size of changed texts put right.

    Rows, their order within a partition and all other columns stay; null texts stay null.
    """
    net = net or default_net()
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at):
            texts = b.column(at).to_pylist()
            found = [[(x[0], x[2]) for x in spans] for spans in found_in(texts, net)]
            new = [redact(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.column(at).type)
            if size_col in names:
                k = names.index(size_col)
                columns[k] = pa.array([len(t) if f else n for t, f, n in zip(new, found, b.column(k).to_pylist(), strict=True)], b.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.filter("findings", lambda f: f["kind"] != "net")), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )
