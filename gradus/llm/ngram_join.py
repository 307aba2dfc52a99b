"""N-gram Jaccard join: near-duplicate classes of documents by a grouped prefix join.

A document's set holds its distinct word n-grams as 64-bit hashes. All sets are ordered by one
global order: n-grams with an infrequent word first, then by the frequency class of their rarest
word, then by hash. Word frequencies are counted over all documents; only words in at least about
one document of ``1 / FREQUENT`` are kept, whose number is bounded by the mean number of words a
document, whatever the corpus's size. Two sets with a Jaccard similarity of at least ``num / den``
share a member of their prefixes, the first ``n - ceil(n * num / den) + 1`` members.

* Equal sets are one class. Classes with equal prefix and size are one group; groups meet through
  a prefix member that at most ``HOT`` groups hold, and pairs of groups pass the size and position
  filters before they are expanded to their classes.
* A prefix member held by more groups would give too many pairs. Its classes meet instead through
  slices: the universe is dealt to more slices than two similar sets can differ in members, so
  similar sets agree on a whole slice. This is exact, and linear in the number of sets.
* Members of a group, of a pair of groups with several classes, or of a slice, form buckets of any
  size. Each bucket first compares its members with its smallest one, then, where the links found
  leave several components, with ``PIVOTS`` members outside the largest one, picked by hash; members still
  outside are compared with the bucket's members of other components. Links inside a component
  don't change it, so none is lost.
* Prefix members are counted where they are packed: shards of the hash space get four bytes of a
  member's hash beside its place, and give back those that several groups hold.
* Pairs pass a lower bound of their difference (each member flips one of ``64 * SKETCH`` bits, so
  the sets differ in at least as many members as their sketches do in bits), then the same bound on
  parities of four bits or more a member, which holds for long sets too, and are then verified
  on the whole sets. So few sets move that aren't similar to another.
* Texts aren't shuffled. A row is named by its place, its number in its file; the places that are
  needed again are written as lists of some ten thousand rows, and another scan looks its rows up.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import IntTable, components, mix64, save, ship_package
from gradus.sources.places import Lists, listed, places
from gradus.sources.scratch import drop, scratch_tables

FREQUENT = 3e-4
HOT = 128
#: 64-bit words of a set's parity sketch.
SKETCH = 16
#: Members that every other member of a mixed bucket is compared with before the rest meet one by one.
PIVOTS = 8
#: Bits of an n-gram's hash; the others hold its frequency class in the global order.
HASH_BITS = 58
#: Members of the sets that are compared in one bucket, on average.
PLACE_MEMBERS = 250_000
#: Prefix members in a shard of the hash space on average, and those packed at once.
SHARD_MEMBERS = 1_000_000
PACKED_MEMBERS = 500_000
#: Bytes and rows of text hashed at once.
HASHED_BYTES, HASHED_ROWS = 1 << 18, 1000
#: Words of texts that are counted at once, and rows in an Arrow batch at most.
COUNTED_WORDS, BATCH_ROWS = 500_000, 2000
#: Byte tables: A-Z as a-z, and ASCII white space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_POWER = np.cumprod(np.full(1024, 0x9E6C63D0876A9A47, dtype=np.uint64), dtype=np.uint64)
_OUTER = np.concatenate([[np.uint64(1)], np.cumprod(np.full(1023, 0xD1B54A32D192ED03, dtype=np.uint64), dtype=np.uint64)])
_FAR = np.concatenate([[np.uint64(1)], np.cumprod(np.full(4095, 0x8CB92BA72F3D8DD7, dtype=np.uint64), dtype=np.uint64)])


class Words:
    """64-bit hashes of the words of some whole texts, end to end; words lie between ASCII white space,
    A-Z count as a-z. A hash is a polynomial of the word's bytes, finalised with its length."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        gap = SPACE[raw]
        first = ~gap
        first[1:] &= gap[:-1]
        starts = np.flatnonzero(first)
        at = np.flatnonzero(~gap)
        word = np.cumsum(first)[at] - 1
        k = at - starts[word]
        v = (FOLD[raw[at]] + np.uint64(1)) * _POWER[k & 1023]
        if len(k) and k.max() >= 1024:
            v *= _OUTER[(k >> 10) & 1023]  # 1 at the first 1024 bytes: a word's hash doesn't depend on its neighbours' lengths
        if len(k) and k.max() >= 1 << 20:
            v *= _FAR[k >> 20]
        begin = np.flatnonzero(first[at])
        length = np.diff(np.append(begin, len(at)))
        self.w = mix64(np.add.reduceat(v, begin) + length.astype(np.uint64)) if len(begin) else np.zeros(0, np.uint64)
        self.ends = np.searchsorted(starts, np.cumsum(sizes))
        self.lens = np.diff(self.ends, prepend=0)

    def shingles(self, width: int, lv: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes (of HASH_BITS) of all runs of ``width`` words, of the whole text where it is shorter;
        the least of ``lv`` in each run; where each text's runs end."""
        n = np.where(self.lens >= width, self.lens - width + 1, np.minimum(self.lens, 1))
        ends = np.cumsum(n)
        begin = np.repeat(self.ends - self.lens, n) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        k = np.minimum(np.repeat(self.lens, n), width)
        h, low = k.astype(np.uint64), None
        for j in range(width):
            use = k > j
            at = np.where(use, begin + j, 0)
            h = np.where(use, mix64(h + self.w[at]), h) if not use.all() else mix64(h + self.w[at])
            if lv is not None:
                x = np.where(use, lv[at], np.iinfo(lv.dtype).max)
                low = x if low is None else np.minimum(low, x)
        return h >> np.uint64(64 - HASH_BITS), low, ends


def slices_of(col: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, whole texts) of about HASHED_BYTES and at most HASHED_ROWS at a time; null is empty."""
    first, held, size = 0, [], 0
    for i, x in enumerate(col):
        t = x.as_py() or b""
        held.append(t)
        size += len(t)
        if size >= HASHED_BYTES or len(held) >= HASHED_ROWS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def distinct(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's distinct values, sorted, end to end; where the parts end. ``h`` is sorted in place."""
    s = 0
    for e in ends:
        h[s:e].sort()
        s = e
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    starts = ends[:-1]
    new[starts[starts < len(h)]] = True
    count = np.concatenate([[0], np.cumsum(new)])
    return h[new], count[ends]


def _word_counts(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size, parts, rows = [], 0, [], 0
        for batch in batches:
            rows += batch.num_rows
            for _, texts in slices_of(batch.column(0)):
                words = Words(texts)
                own.append(distinct(words.w, words.ends)[0])
                size += len(own[-1])
            if size >= COUNTED_WORDS:
                parts.append(np.unique(np.concatenate(own), return_counts=True))
                own, size = [], 0
                if sum(len(u) for u, _ in parts) >= 2 * COUNTED_WORDS:
                    yield frequent(parts, rows)
                    parts, rows = [], 0
        parts.append(np.unique(np.concatenate(own or [np.zeros(0, np.uint64)]), return_counts=True))
        yield frequent(parts, rows)

    def frequent(parts: list[tuple[np.ndarray, np.ndarray]], rows: int) -> pa.RecordBatch:
        u, at = np.unique(np.concatenate([u for u, _ in parts]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(u)).astype(np.int64)
        often = n >= share * rows / 2  # a frequent word is frequent in some part
        return pa.record_batch([pa.array(u[often].view(np.int64)), pa.array(n[often])], names=["w", "n"])

    return run


def frequent_words(docs: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(hash, frequency class 1, 2, ...) of the words in a share of the documents."""
    total = docs.count()
    n = docs.mapInArrow(_word_counts(share), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= share * total / 2)
    got = n.toPandas()  # at most 2 / share times the mean number of distinct words of a document
    level = 1 + np.floor(np.log2(np.maximum(1.0, got["n"].to_numpy() / max(1.0, share * total / 2))))
    return got["w"].to_numpy(np.int64), level.astype(np.int64)


class Order:
    def __init__(self, words: np.ndarray, level: np.ndarray):
        self.table, self.level = IntTable(words), np.minimum(np.append(level, 0), (1 << 64 - HASH_BITS) - 1)

    def classes(self, w: np.ndarray) -> np.ndarray:
        """Frequency class of every word; 0 where it isn't frequent."""
        return self.level[self.table.find(w.view(np.int64))]


def set_ids(h: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """16 bytes that name each set; its members lie end to end."""
    parts = []
    for seed in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(seed)), dtype=np.uint64)])
        parts.append(total[ends] - total[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros(0, np.uint64))
    both = np.stack(parts, axis=1).astype(">u8").tobytes()
    return [both[i:i + 16] for i in range(0, len(both), 16)]


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


def _records(order, width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o: Order = order.value
        for batch in batches:
            for first, texts in slices_of(batch.column(1)):
                words = Words(texts)
                h, low, ends = words.shingles(width, o.classes(words.w))
                # members are sorted by class and hash at once
                h, ends = distinct(h | (low.astype(np.uint64) << np.uint64(HASH_BITS)) if len(h) else h, ends)
                n = np.diff(ends, prepend=0)
                plain = h & np.uint64((1 << HASH_BITS) - 1)
                own = np.repeat(np.arange(len(n)), n)
                flips = np.bincount(own * (64 * SKETCH) + (plain % np.uint64(64 * SKETCH)).astype(np.int64), minlength=len(n) * 64 * SKETCH) & 1
                sketch = np.packbits(flips.astype(bool)).view(np.int64)
                size = np.where(n > 0, n - -(-n * num // den) + 1, 0)
                top = np.arange(len(h)) - np.repeat(ends - n, n) < np.repeat(size, n)
                prefix, tops = h[top], np.cumsum(size)
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), pa.array(n), pa.array(set_ids(plain, ends), pa.binary()), pa.array(set_ids(prefix, tops), pa.binary()),
                                       _lists(prefix.view(np.int64), tops, pa.int64()), _lists(sketch, np.arange(1, len(n) + 1) * SKETCH, pa.int64()),
                                       *[c.slice(first, len(texts)) for c in batch.columns[2:]]], names=["doc_id", "n", "cid", "grp", "prefix", "sketch", "block", "at"])

    return run


def size_classes(n: int, num: int, den: int) -> tuple[int, int, int]:
    """Class of a size, its largest size and the next class's: sizes of similar sets are of one class or of neighbours."""
    i, low = 0, 1
    while True:
        top = low * den // num
        if n <= top:
            return i, top, (top + 1) * den // num
        i, low = i + 1, top + 1


def slice_keys(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """Names of (pair of size classes, slice, content): similar sets share one.

    Similar sets differ in at most ``most`` members, so they agree on at least ``m - most`` of m
    slices. A set with fewer slices than that of less than w members keeps those of w or more: one of
    the slices they agree on is among them, for the larger w of the two sets. So empty and tiny slices,
    which many sets share, are left out without losing a pair."""
    i, top, after = size_classes(len(h), num, den)
    pairs = [(i, after)] if i == 0 else [(i, after), (i - 1, top)]
    out = []
    for c, largest in pairs:
        # |x| + |y| <= 2 * largest, and the overlap is at least num / (num + den) of it
        most = 2 * largest * (den - num) // (den + num)
        m = most + most // 3 + 4
        at = (mix64(h ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(m)).astype(np.int64)
        held = np.bincount(at, minlength=m)
        w = max(x for x in range(4) if (held < x).sum() < m - most)
        part = np.argsort(at, kind="stable")
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, at[part], mix64(h[part] ^ np.uint64(0x165667B19E3779F9)))
        out.append(mix64(mix64(sums + np.arange(m, dtype=np.uint64)) + np.uint64(c))[held >= w])
    return np.concatenate(out)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside get Arrow batches of few rows: whole texts wait in the memory of the JVM and of Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def placed(docs: DataFrame) -> DataFrame:
    """``docs``; other tables than scans, in which rows have no place or share one, are written first."""
    try:
        odd = docs.select(*places(docs)).groupBy("block", "at").agg(F.count("*").alias("k")).where("k > 1 or at is null")
    except AnalysisException:
        return save(docs, "join-docs")
    return docs if odd.isEmpty() else save(docs, "join-docs")


def _coder(folder: str):
    def code(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        lists = Lists(folder)
        for block, at in parts:
            yield pd.Series(lists.codes(block.to_numpy(), at.to_numpy()).astype(np.int32))

    return code


def _sets(folder: str, width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(folder)
        for batch in batches:
            code = lists.codes(batch.column(1).to_numpy(), batch.column(2).to_numpy())
            hot = code[code > 0] > 1
            for first, texts in slices_of(batch.column(0).filter(pa.array(code > 0))):
                h, _, ends = Words(texts).shingles(width)
                h, ends = distinct(h, ends)
                own = [x.view(np.int64) for x in np.split(h, ends[:-1])]
                keys = [slice_keys(x.view(np.uint64), num, den).view(np.int64) if k else np.zeros(0, np.int64) for x, k in zip(own, hot[first:])]
                yield pa.record_batch([pa.array(set_ids(h, ends), pa.binary()), pa.array(own, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["cid", "members", "slices"])

    return run


def _fits(a: str, b: str, num: int, den: int):
    """Sizes of similar sets."""
    return (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)


def _halves(x: np.ndarray) -> bytes:
    """Numbers of 32 bits as all low and all high halves, which are often the same."""
    return x.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes()


def _whole(halves: list[bytes]) -> np.ndarray:
    parts = [np.frombuffer(x, "<u2").astype(np.int64).reshape(2, -1) for x in halves]
    return np.concatenate([low | high << 16 for low, high in parts])


def _to_shards(folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(folder)
        for batch in batches:
            batch = batch.filter(pa.array(lists.codes(batch.column(3).to_numpy(), batch.column(4).to_numpy()) > 0))
            rid, n, prefix = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            members, size = prefix.flatten().to_numpy(), np.diff(prefix.offsets.to_numpy())
            ends = np.cumsum(size)
            cuts = np.unique(np.concatenate([np.searchsorted(ends, np.arange(0, len(members), PACKED_MEMBERS)), np.flatnonzero(np.diff(rid >> 33)) + 1, [len(rid)]]))
            for s, e in zip(np.append(0, cuts), cuts):
                if s == e:
                    continue
                own = np.repeat(np.arange(s, e), size[s:e])
                first = ends[s] - size[s]
                pos = np.arange(len(own)) + first - (ends - size)[own]
                h = mix64(members[first:ends[e - 1]].astype(np.uint64))
                shard = ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
                shard, low, at, pos = shard[order], h[order].astype("<u4"), (rid[own] & (1 << 33) - 1)[order], pos[order]
                edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
                cells = [slice(i, j) for i, j in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]], pa.int32()), pa.array([int(rid[s] >> 33)] * len(cells), pa.int64()), pa.array([low[c].tobytes() for c in cells], pa.binary()),
                                                  *[pa.array([_halves(x[c]) for c in cells], pa.binary()) for x in (at, n[own][order], pos)]], names=["shard", "part", "low", "at", "n", "pos"])

    return run


def _shared_members(table: pa.Table) -> pa.Table:
    low = np.frombuffer(b"".join(table.column("low").to_pylist()), "<u4")
    order = np.argsort(low, kind="stable")
    low = low[order].astype(np.int64)
    edges = np.flatnonzero(np.diff(low, prepend=-1, append=-1))
    df = np.repeat(np.diff(edges), np.diff(edges))
    use = df > 1
    order = order[use]
    part = np.repeat(table.column("part").to_numpy(), [len(x) // 4 for x in table.column("low").to_pylist()])[order]
    at, n, pos = (_whole(table.column(c).to_pylist())[order] for c in ("at", "n", "pos"))
    return pa.table({"tok": low[use] | table.column("shard")[0].as_py() << 32, "grp": at | part << 33, "n": n, "pos": pos, "df": df[use].astype(np.int64)})


def group_pairs(groups: DataFrame, rows: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of groups g1, g2 that may hold similar sets; groups with a hot prefix member). A group goes by the rid of its
    first row, whose prefix stands for the group's. Members go by 32 bits of their hash beside their shard, so that a
    few pairs more are found, which the filters drop."""
    total = groups.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    shards = 1 + int(total) // SHARD_MEMBERS
    lists = listed(groups.select("block", "at", F.lit(1).alias("code")))
    x = rows.select("rid", "n", "prefix", "block", "at").mapInArrow(_to_shards(lists, shards), "shard int, part long, low binary, at binary, n binary, pos binary")
    post = save(x.groupBy("shard").applyInArrow(_shared_members, "tok long, grp long, n long, pos long, df long"), "join-post")
    hot = post.where(F.col("df") > HOT).select("grp").distinct()
    near = (post.where(F.col("df") <= HOT).groupBy("tok").agg(F.array_sort(F.collect_list(F.struct("n", "grp", "pos"))).alias("x")))

    def partners(a):
        def ok(b):
            most = F.least(a["pos"], b["pos"]) + 1 + F.least(a["n"] - a["pos"], b["n"] - b["pos"]) - 1
            after = (b["n"] > a["n"]) | ((b["n"] == a["n"]) & (b["grp"] > a["grp"]))
            return after & (a["n"] * den >= b["n"] * num) & (most * (num + den) >= (a["n"] + b["n"]) * num)

        return F.transform(F.filter("x", ok), lambda b: F.struct(a["grp"].alias("g1"), b["grp"].alias("g2")))

    cand = near.select(F.explode(F.flatten(F.transform("x", partners))).alias("p")).select("p.g1", "p.g2").distinct()
    return cand, hot


def apart(a: list, b: list) -> F.Column:
    """Bits in which two sketches differ."""
    total = F.lit(0)
    for x, y in zip(a, b):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def words_of_sketch(name: str) -> list:
    return [F.col(name)[i] for i in range(SKETCH)]


def near_enough(na: str, nb: str, xa: str, xb: str, num: int, den: int):
    """Similar sets differ in at most (den - num) / (den + num) of the sum of their sizes."""
    return apart(words_of_sketch(xa), words_of_sketch(xb)) * (den + num) <= (F.col(na) + F.col(nb)) * (den - num)


def passing(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"x{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b").where(_fits("na", "nb", num, den))
    return j.where(near_enough("na", "nb", "xa", "xb", num, den)).select("a", "b")


def _dealt(folder: str, kind):
    """The sets of the listed rows as ``kind`` makes them of the members, once for each listing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(folder)
        for batch in batches:
            rows, buckets = lists.found(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            for i in range(0, len(rows), 256):
                at = pa.array(rows[i:i + 256])
                yield pa.record_batch([pa.array(buckets[i:i + 256], pa.int32()), batch.column(0).take(at), kind(batch.column(1).take(at))], names=["bucket", "cid", "set"])

    return run


def _whole_sets(members: pa.Array) -> pa.Array:
    return members


def parity(members: np.ndarray) -> np.ndarray:
    """Bytes of 2 ** k bits, four or more for each member: whether an odd number of members has that remainder."""
    bits = 1 << max(6, (4 * len(members) - 1).bit_length())
    odd = np.bincount((members & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def parities_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two parities differ; the longer one is folded. Their sets differ in as many members at least."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _parities(members: pa.Array) -> pa.Array:
    return pa.array([parity(x.values.to_numpy()).tobytes() for x in members], pa.binary())


def _compare(num: int, den: int, similar):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        row = {c: i for i, c in enumerate(sets.column("cid").to_pylist())}
        held = sets.column("set").combine_chunks()
        keep = [similar(held[row[a]], held[row[b]], na, nb, num, den) for a, b, na, nb in zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "na", "nb")))]
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _may_be_similar(x, y, nx: int, ny: int, num: int, den: int) -> bool:
    return parities_apart(*(np.frombuffer(p.as_buffer(), np.uint8) for p in (x, y))) * (den + num) <= (nx + ny) * (den - num)


def _similar(x, y, nx: int, ny: int, num: int, den: int) -> bool:
    both = np.sort(np.concatenate((x.values.to_numpy(), y.values.to_numpy())), kind="stable")  # merges the two
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared * den >= (len(both) - shared) * num


def _met(pairs: DataFrame, sets: DataFrame, kind, schema: str, share: float, similar, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets, as ``kind`` makes them, are ``similar``. Pairs that hang together are
    compared in one place, named by the smallest partner of the second set, so that a set moves once for its
    neighbourhood, not once a pair. A place of many members, of which ``share`` counts, is cut into cells of
    pairs, and cells are packed into buckets of bounded size. Sets of no pair stay where they are."""
    x = save(pairs.join(pairs.groupBy("b").agg(F.min("a").alias("place")), "b").select("a", "b", "place"), "join-places")
    own = sets.select("cid", F.size("members").cast("long").alias("n"), *places(sets))
    held = x.select("place", F.explode(F.array("a", "b")).alias("cid")).distinct().join(own.select("cid", "n"), "cid") \
        .groupBy("place").agg((F.sum("n") * F.lit(share)).alias("held"))
    cells = save(held.select("place", "held", F.floor(F.lit(1) + F.col("held") / PLACE_MEMBERS).alias("cells")), "join-cells")
    buckets = 1 + int((cells.agg(F.sum(F.col("held") * F.col("cells"))).first()[0] or 0) // PLACE_MEMBERS)
    cell = F.xxhash64("place", F.pmod(F.xxhash64("a"), "cells"), F.pmod(F.xxhash64("b"), "cells"))
    x = save(x.join(cells, "place").select("a", "b", F.pmod(cell, F.lit(buckets)).cast("int").alias("bucket"))
             .join(own.select(F.col("cid").alias("a"), F.col("n").alias("na")), "a").join(own.select(F.col("cid").alias("b"), F.col("n").alias("nb")), "b"), "join-dealt")
    ends = x.select("bucket", F.explode(F.array("a", "b")).alias("cid")).distinct()
    lists = listed(ends.join(own, "cid").select("block", "at", F.col("bucket").alias("code")))
    dealt = sets.select("cid", "members", *places(sets)).mapInArrow(_dealt(lists, kind), f"bucket int, cid binary, set {schema}")
    return x.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(_compare(num, den, similar), "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; ``sets`` is a written table. The sets' parities meet first, an eighth of
    the sets' size or less, and only the sets of pairs that they allow meet whole."""
    pairs = save(pairs.select("a", "b"), "join-pairs")
    near = save(_met(pairs, sets, _parities, "binary", 1 / 8, _may_be_similar, num, den), "join-near")
    return _met(near, sets, _whole_sets, "array<long>", 1, _similar, num, den)


def ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def across(some: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of a bucket's ``some`` with its members of other components, where sizes and sketches allow the similarity."""
    side = lambda x: (F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"), F.col("sketch").alias(f"x{x}"))
    ok = (F.col("ca") != F.col("cb")) & _fits("na", "nb", num, den) & near_enough("na", "nb", "xa", "xb", num, den)
    both = some.select("bucket", *side("a")).join(members.select("bucket", *side("b")), "bucket").where(ok)
    return both.select(*ordered(F.col("a"), F.col("b"))).distinct()


def mixed_buckets(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """(bucket, cid, c: its component under ``links``, major: the bucket's largest one) of buckets with several components."""
    labels = components(links, "a", "b")
    own = buckets.join(labels, buckets["cid"] == labels["node"], "left").select("bucket", "cid", F.coalesce("component", "cid").alias("c"))
    own = save(own, "join-labelled")
    per = own.groupBy("bucket", "c").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("parts"))
    return save(own.join(per.where("parts > 1").select("bucket", F.col("m.c").alias("major")), "bucket"), "join-mixed")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of its smallest doc_id, and where rows repeat that id,
    one of those. Rows without n-grams all stay."""
    docs = placed(docs)
    with scratch_tables() as made:
        found = save(_near(docs, width, num, den, doc_id, text), "join-found")
        won = found.where("winner").groupBy("component_id", "cid").agg(F.min(F.struct("block", "at")).alias("row")).select("row.block", "row.at")
        stay = found.where("n_shingles = 0").select("block", "at").union(won)
    lists = listed(stay.withColumn("code", F.lit(1)))
    drop(docs.sparkSession, made)
    code = F.pandas_udf(_coder(lists), "int")
    return docs.where(code(*places(docs)) > 0)


def near_classes(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words lie between ASCII white space, A-Z count as a-z; a text of fewer than ``width`` words has
    one n-gram, the whole sequence. Links: Jaccard similarity >= num / den. component_id is the
    smallest doc_id that links reach. Null and empty texts, or texts without words, have no n-gram
    and link with nothing. Repeated rows are copies of one another; a null doc_id takes part, and
    a component without any doc_id has a null component_id. Other columns aren't read."""
    return _near(placed(docs.select(doc_id, text)), width, num, den, doc_id, text).select("doc_id", "n_shingles", "component_id")


def _near(docs: DataFrame, width: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    """``near_classes`` of placed rows, with each row's place, cid, the name of its set, and winner: whether the row's set
    stands for its component."""
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), *places(docs))
    with small_batches(spark):
        order = spark.sparkContext.broadcast(Order(*frequent_words(d.select("text"), FREQUENT)))  # bounded, see there
        id_type = d.schema["doc_id"].dataType.simpleString()
        rows = save(d.mapInArrow(_records(order, width, num, den), f"doc_id {id_type}, n long, cid binary, grp binary, prefix array<long>, sketch array<long>, block long, at long").withColumn("rid", F.monotonically_increasing_id()), "join-rows")
        with scratch_tables() as made:
            named = _named(d, rows, width, num, den)
        named = save(named, "join-named")
        drop(spark, made)
    out = rows.select("doc_id", "n", "cid", "block", "at").join(named, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "cid", "block", "at",
                      F.coalesce(F.col("wins") & F.col("doc_id").eqNullSafe(F.col("component_id")), F.lit(False)).alias("winner"))


def _named(d: DataFrame, rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(cid, component_id, wins: whether the set stands for its component) of the sets of ``rows``, the records of the texts ``d``."""
    full = rows.where("n > 0")
    classes = full.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min(F.struct("rid", "block", "at")).alias("lead"), F.first("n").alias("n"), F.first("grp").alias("grp"),
                                      F.first("sketch").alias("sketch"))
    classes = save(classes.select("cid", "rep", "lead.rid", "lead.block", "lead.at", "n", "grp", "sketch"), "join-classes")
    # each group's prefix is read from its first row
    groups = classes.groupBy("n", "grp").agg(F.count("*").alias("size"), F.min("cid").alias("only"), F.min(F.struct("rid", "block", "at")).alias("lead"))
    groups = save(groups.select("n", F.xxhash64("grp", "n").alias("grp"), "size", "only", "lead.rid", "lead.block", "lead.at"), "join-groups")
    member = classes.select("cid", "n", F.xxhash64("grp", "n").alias("grp"))
    cand, hot = group_pairs(groups, full, num, den)
    end = lambda i: groups.select(F.col("rid").alias(f"r{i}"), F.col("grp").alias(f"g{i}"), F.col("size").alias(f"z{i}"), F.col("only").alias(f"o{i}"))
    cand = save(cand.select(F.col("g1").alias("r1"), F.col("g2").alias("r2")).join(end(1), "r1").join(end(2), "r2").drop("r1", "r2"), "join-cand")
    hot = hot.join(groups.select(F.col("rid").alias("first"), F.col("grp").alias("name")), F.col("grp") == F.col("first")).select(F.col("name").alias("grp"))
    single = save(passing(cand.where("z1 = 1 and z2 = 1").select(*ordered(F.col("o1"), F.col("o2"))), classes, num, den), "join-single")
    several = cand.where("z1 > 1 or z2 > 1").withColumn("bucket", F.xxhash64("g1", "g2"))
    several = several.select("bucket", F.explode(F.array("g1", "g2")).alias("grp")).union(groups.where("size > 1").select(F.xxhash64("grp"), "grp"))
    buckets = several.join(member, "grp").select("bucket", "cid")
    hot = member.join(hot, "grp").select("cid").distinct()
    need = (hot.withColumn("hot", F.lit(True)).union(single.select("a", F.lit(False))).union(single.select("b", F.lit(False)))
            .union(buckets.select("cid", F.lit(False))).groupBy("cid").agg(F.max("hot").alias("hot")))
    need = save(need.join(classes.select("cid", "block", "at", "n", "sketch"), "cid"), "join-need")
    lists = listed(need.select("block", "at", F.when(F.col("hot"), 2).otherwise(1).alias("code")))
    sets = save(d.select("text", "block", "at").mapInArrow(_sets(lists, width, num, den), "cid binary, members array<long>, slices array<long>"), "join-sets")
    slices = sets.select(F.explode("slices").alias("bucket"), "cid")
    buckets = save(buckets.union(slices), "join-buckets")
    many = buckets.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    buckets = save(buckets.join(many, "bucket"), "join-shared")
    pivots = buckets.groupBy("bucket").agg(F.min("cid").alias("pivot"))
    star = buckets.join(pivots, "bucket").where("cid <> pivot").select(*ordered(F.col("pivot"), F.col("cid"))).distinct()
    star = passing(star, need, num, den)
    first = save(verified(star.union(single).distinct(), sets, num, den), "join-links")
    # buckets whose members are in several components: first each meets some of those outside the largest one
    mixed = mixed_buckets(buckets, first).join(need.select("cid", "n", "sketch"), "cid")
    by_hash = [F.min(F.struct(F.xxhash64(F.lit(i), "cid").alias("h"), "cid")).alias(f"p{i}") for i in range(PIVOTS)]
    some = mixed.where("c <> major").groupBy("bucket").agg(*by_hash)
    some = some.select("bucket", F.explode(F.array_distinct(F.array(*[F.col(f"p{i}.cid") for i in range(PIVOTS)]))).alias("cid"))
    again = across(mixed.join(some, ["bucket", "cid"], "left_semi"), mixed, num, den)
    second = first.union(save(verified(again, sets, num, den), "join-links"))
    # then those still outside meet all members of other components
    mixed = mixed_buckets(mixed.select("bucket", "cid"), second).join(need.select("cid", "n", "sketch"), "cid")
    more = across(mixed.where("c <> major"), mixed, num, den)
    comp = components(second.union(verified(more, sets, num, den)), "a", "b")
    named = classes.select("cid", "rep").join(comp, classes["cid"] == comp["node"], "left").select("cid", "rep", F.coalesce("component", "cid").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"), F.min(F.struct(F.col("rep").isNull(), "rep", "cid")).alias("w"))
    return named.join(least, "c").select("cid", "component_id", (F.col("cid") == F.col("w.cid")).alias("wins"))
