"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q, of at least ``TIMES * q`` and at
least ``LEAST`` words, that no neighbouring word extends. Each of its words occurs at least
``TIMES`` times in it. So a word that occurs fewer times in a segment belongs to no run of that
segment and splits it; the parts are split again by their own frequencies until nothing changes.
Ordinary prose falls apart at once, all texts of a batch together. Surviving segments are scanned
lag by lag: a run of period q agrees at distance q over at least ``3 * q`` words, so it holds three
neighbouring multiples of q that agree, and only such places are followed to their ends. A segment
of n words costs about n log n comparisons, so texts of any length are scanned whole.

Texts are read where they lie, in one map without a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.common import ship_package

TIMES, LEAST = 4, 6
SLICE = 2 << 20
RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def survivors(ids: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int]]:
    """Segments (start, end) that every split by rare words leaves. ``ids``: numbers of the words of some
    texts, end to end; ``cuts``: where each text ends."""
    at = np.arange(len(ids))
    seg = np.searchsorted(cuts, at, side="right")
    size = int(ids.max()) + 1 if len(ids) else 1
    while len(at):
        # words that occur too rarely in their segment go
        _, inverse, count = np.unique(seg * size + ids[at], return_inverse=True, return_counts=True)
        stay = count[inverse] >= TIMES
        split = not stay.all()
        at, seg = at[stay], seg[stay]
        if not len(at):
            break
        # segments end where words are missing or the segment before ended; short ones go
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (seg[1:] != seg[:-1])
        seg = np.cumsum(new) - 1
        stay = np.bincount(seg)[seg] >= LEAST
        split |= not stay.all()
        at, seg = at[stay], seg[stay]
        if not split:
            first = np.flatnonzero(np.diff(seg, prepend=-1))
            last = np.append(first[1:], len(at)) - 1
            return list(zip(at[first].tolist(), (at[last] + 1).tolist()))
    return []


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true start and end."""
    d = np.diff(same.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _follow(w: np.ndarray, i: int, q: int, step: int) -> int:
    """How many words from ``i`` on agree with the word q further, forwards (1) or backwards (-1, from i - 1)."""
    total, width = 0, 64
    while True:
        if step > 0:
            s, e = i + total, min(len(w) - q, i + total + width)
        else:
            s, e = max(0, i - total - width), i - total
        if s >= e:
            return total
        bad = np.flatnonzero(w[s:e] != w[s + q:e + q])
        if len(bad):
            return total + int(bad[0] if step > 0 else e - s - 1 - bad[-1])
        total, width = total + e - s, width * 2


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words with numbers ``w``."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // TIMES + 1):
        if q < 16:
            starts, ends = _stretches(w[q:] == w[:-q])
            long_ = ends - starts + q >= max(LEAST, TIMES * q)
            pairs = zip(starts[long_].tolist(), ends[long_].tolist())
        else:
            grid = w[::q]
            agree = grid[1:] == grid[:-1]
            three = agree[2:] & agree[1:-1] & agree[:-2]
            pairs, done = [], -1
            for k in np.flatnonzero(three).tolist():
                if k * q < done:
                    continue
                e = k * q + _follow(w, k * q, q, 1)
                if e <= (k + 2) * q:
                    continue
                s, done = k * q - _follow(w, k * q, q, -1), e
                if e - s + q >= TIMES * q:
                    pairs.append((s, e))
        for s, e in pairs:  # a multiple of a run's period gives the same stretch
            found.setdefault((s, e + q - s), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Every text's runs by start and period."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(x, len(number)) for words in texts for x in words], dtype=np.int64)
    ends = np.cumsum([len(words) for words in texts], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e in survivors(ids, ends):
        t = int(np.searchsorted(ends, s, side="right"))
        base = s - int(ends[t]) + len(texts[t])
        out[t] += [(base + a, n, q) for a, n, q in runs_of(ids[s:e])]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those behind the first period of a run."""
    d = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        d[s + q] += 1
        d[s + length] -= 1
    return np.cumsum(d[:-1]) == 0


def digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    keep = kept_words(len(words), runs)
    text = b" ".join(words if keep.all() else [x for x, k in zip(words, keep.tolist()) if k])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int]]:
    """Rows (start, end) of about ``size`` bytes of text."""
    first = held = 0
    for i, x in enumerate(batch.column(1)):
        held += len(x.as_buffer()) if x.is_valid else 0
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < batch.num_rows:
        yield first, batch.num_rows


def _mapped(change: Callable[[object, list[bytes]], list[bytes]] | None, out: Callable, schema: list[tuple[str, pa.DataType]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch, SLICE):
                keys = batch.column(0).slice(a, b - a)
                texts = [(x or b"").split() for x in batch.column(1).slice(a, b - a).to_pylist()]
                if change is not None:
                    texts = [change(k, words) for k, words in zip(batch.column(2).slice(a, b - a).to_pylist(), texts)]
                rows = [out(words, runs) for words, runs in zip(texts, find_runs(texts))]
                cols = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(schema)]
                yield pa.record_batch([keys, *cols], names=["packed", *[n for n, _ in schema]])

    return run


_LONG = ["n_runs", "start", "length", "period", "exponent_milli"]
_DIGEST = [(c, pa.int64()) for c in _LONG] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def _apply(docs: DataFrame, keep: list[str], text: str, change, by: str | None, out, schema, ddl: str) -> DataFrame:
    ship_package(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("packed"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"), *([F.col(f"`{by}`").alias("by")] if by else []))
    kind = T.StructType([packed.schema["packed"], *T.StructType.fromDDL(ddl).fields])
    got = packed.mapInArrow(_mapped(change, out, schema), kind)
    return got.select(*[F.col("packed").getField(c).alias(c) for c in keep], *kind.names[1:])


def run_digests(docs: DataFrame, keep: list[str], text: str = "text", change=None, by: str | None = None) -> DataFrame:
    """The columns ``keep`` and, for every text, n_runs, its longest run (start, length, period, exponent_milli; nulls
    without a run; ties: smallest start, then period), runs_sha256 of the list of runs and collapsed_sha256 of the kept words.

    Words lie between ASCII white space and are compared as they are. Null, empty and white texts have no words.
    ``change(by's value, words)`` may alter a text's words first. Repeated rows give equal results; a column of ``keep``
    that is called like a result column stays and comes first."""
    return _apply(docs, keep, text, change, by, digest, _DIGEST, RESULT)


def collapse(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, the runs of every text and its kept words, joined by one space (``collapsed``; null for null)."""
    def out(words, runs):
        keep_ = kept_words(len(words), runs)
        return [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join([x for x, k in zip(words, keep_.tolist()) if k]).decode("utf-8", "replace")

    got = _apply(docs, [*keep, *([text] if text not in keep else [])], text, None, None, out, [("runs", pa.list_(_RUN)), ("collapsed", pa.string())],
                 "runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return got.select(*[F.col(f"`{c}`") for c in keep], "runs", F.when(F.col(f"`{text}`").isNotNull(), F.col("collapsed")).alias("collapsed"))


def planted(key, words: list[bytes]) -> list[bytes]:
    """A text whose number has a hash that 10 divides becomes periodic from one of its words on."""
    if key is None or not words:
        return words
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]
