"""Similarity clustering of sequences / texts (C1-C3, J8) as Spark jobs.

C1  shingle sets (one row per text) -> every pair that can reach the thresholds, by prefix
    filtering: shingles are ordered by how many sets hold them, rarest first, and a set whose
    coverage must be ``c`` shares a member of its first ``n - ceil(c n) + 1`` shingles with any
    partner. Equal sets enter once, their copies are linked to the smallest id (a star). Where
    only C2's result is asked for, shingles are counted in packed shards of the hash space, and
    the sets stay where they are: rows are named by their places, and only the places move.
C2  every candidate edge is verified exactly on the shingle sets
    (identity = shared / smaller set, coverage on both / query / target side).
C3  connected components of the verified edges by edge contraction, so the edge table falls every
    round; each round is written into the cluster's shared checkpoint folder, so lineage
    stays short and lost executors recompute only the current round.

Shingle identity is the first 48 bits of md5(shingle text), so the same
hashing can be reproduced in SQL for the oracle. Where no result depends on the order of the
hashes, 63 bits of a polynomial, computed for all shingles of some texts at once, name them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gradus.functions.columns import spread
from gradus.session import ship_package
from gradus.sources.places import LISTED, Lists, listed, places
from gradus.sources.scratch import written

# Fixed parameters of the clustering (defaults of the reference configuration:
# identity 0.3, coverage 0.8, coverage on both sides)
IDENTITY = 0.3
COVERAGE = 0.8
SHINGLE_WORDS = 5
MODES = ("both", "query", "target")
#: Shingles in a shard of the hash space, and of the sets, on average.
SHARD_MEMBERS = 2_000_000
#: Shingles of the sets whose pairs are counted in one place, on average.
PLACE_MEMBERS = 250_000
#: Bytes of text hashed at once.
HASHED_BYTES = 2 << 20

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, factor, np.uint64), dtype=np.uint64)])
           for size, factor in ((1024, 0x9E6C63D0876A9A47), (1024, 0xD1B54A32D192ED03), (4096, 0x8CB92BA72F3D8DD7))]


def _h48(s: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(s), 1, 12), 16, 10).cast("long")


def _text_hashes(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; words lie between white space, as in ``\\s+``."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    md5 = hashlib.md5
    if len(words) < k:
        got = md5(joined).digest()
    else:
        got = b"".join([md5(joined[i:j - 1]).digest() for i, j in zip([0, *ends], ends[k - 1:])])
    return np.unique(np.frombuffer(got, ">u8")[::2] >> np.uint64(16)).astype(np.int64)


def _mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _polynomial_hashes(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of each text's shingles, split as in ``_text_hashes``; a shingle's hash
    depends on its words alone. All words of the texts are hashed at once."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = _SPACE[raw]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, np.int64)] * len(texts)
    at = np.flatnonzero(~gap)
    place = at - starts[np.cumsum(first)[at] - 1]
    v = (raw[at].astype(np.uint64) + np.uint64(1)) * _POWERS[0][place & 1023]
    for shift, powers in zip((10, 20), _POWERS[1:]):
        if place.max() >> shift:
            v *= powers[place >> shift & len(powers) - 1]
    begin = np.flatnonzero(first[at])
    w = _mix64(np.add.reduceat(v, begin) + np.diff(begin, append=len(at)).astype(np.uint64))
    # words up to the end of each text, then shingles of each
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    words = np.diff(upto, prepend=0)
    n = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    ends = np.cumsum(n)
    begin = np.repeat(upto - words, n) + np.arange(ends[-1]) - np.repeat(ends - n, n)
    size = np.minimum(np.repeat(words, n), k)
    h = size.astype(np.uint64)
    for j in range(k):
        use = size > j
        h = np.where(use, _mix64(h + w[np.where(use, begin + j, 0)]), h)
    h = (h >> np.uint64(1)).astype(np.int64)
    out = []
    for s, e in zip(ends - n, ends):
        own = np.sort(h[s:e])
        out.append(own[np.append(True, own[1:] != own[:-1])] if e > s else own)
    return out


def _text_slices(texts: Sequence) -> Iterator[list]:
    """Texts (bytes or null) of about HASHED_BYTES at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1] or b"")
        if size >= HASHED_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def shingle_sets(df: DataFrame, id_col: str, text: str, k: int = SHINGLE_WORDS,
                 partitions: int | None = None, keep: Sequence[str] = (), md5: bool = True) -> DataFrame:
    """(id, hs ARRAY<BIGINT>[, keep...]): the distinct k-word shingles of the whole text (split on
    whitespace; a text shorter than k words is one shingle), hashed to the first 48
    bits of md5, or without ``md5`` to 63 bits of a polynomial, where the result doesn't show hashes
    or their order. One row per document: duplicates are removed inside the row,
    so building the sets needs no shuffle at all. A NULL text has one NULL shingle."""
    df = spread(df.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("_text"), *keep), partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for texts in _text_slices(batch.column(1)):
                own = [_text_hashes(t or b"", k) for t in texts] if md5 else _polynomial_hashes([t or b"" for t in texts], k)
                sets += [None if t is None else x for t, x in zip(texts, own)]
            values = np.concatenate([np.zeros(1, np.int64) if x is None else x for x in sets] or [np.zeros(0, np.int64)])
            ends = np.cumsum([0, *[1 if x is None else len(x) for x in sets]])
            null = np.zeros(len(values), bool)
            null[[e for e, x in zip(ends, sets) if x is None]] = True
            hs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64(), mask=null))
            yield pa.record_batch([batch.column(0), hs, *batch.columns[2:]], names=["id", "hs", *keep])

    hs = T.StructField("hs", T.ArrayType(T.LongType()))
    return df.mapInArrow(run, T.StructType([df.schema["id"], hs, *[df.schema[c] for c in keep]]))


def word_shingles(df: DataFrame, id_col: str, text: str, k: int = SHINGLE_WORDS,
                  distinct: bool = True, partitions: int | None = None) -> DataFrame:
    """(id, h): one row per shingle of each text. ``distinct`` explodes the per-text
    sets; otherwise every occurrence is generated and hashed by code-generated
    expressions (cheaper when a later join shrinks the rows before any dedup)."""
    if distinct:
        return shingle_sets(df, id_col, text, k, partitions).select("id", F.explode("hs").alias("h"))
    w = spread(df.select(id_col, text), partitions).select(F.col(id_col).alias("id"), F.filter(F.split(F.col(text), r"\s+"), lambda x: x != "").alias("_w"))
    n = F.size("_w")
    sh = F.when(n < k, F.when(n > 0, F.array(F.array_join("_w", " "))).otherwise(F.array().cast("array<string>"))) \
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))),
                               lambda i: F.array_join(F.slice("_w", i, k), " ")))
    return w.select("id", F.explode(sh).alias("_s")).select("id", _h48(F.col("_s")).alias("h"))


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table (e.g. the shingle table, read 3-4 times by C1-C3)
    once into the shared checkpoint folder and cut its lineage there. Readers take the columns
    they need, and joins know its size."""
    return written(df, "clusters")


def _digest(hs: F.Column) -> F.Column:
    """128 bits that name a set in joins and groups, so that its members stay where they are."""
    hs = F.sort_array(hs)
    return F.struct(F.xxhash64(hs).alias("x"), F.xxhash64(F.lit(1), hs).alias("y"))


def named(sets: DataFrame) -> DataFrame:
    """The sets with the name of each; written beside them it is computed once for all readers."""
    return sets if "set" in sets.columns else sets.withColumn("set", _digest(F.col("hs")))


def numbered(sets: DataFrame) -> DataFrame:
    """The sets with name, size and a row number, which hold where the result is written."""
    return named(sets).withColumns({"n": F.size("hs").cast("long"), "rid": F.monotonically_increasing_id()})


class Sets(NamedTuple):
    """Sets whose rows have places: ``names`` (id, set, n, block, at) is written; ``rows`` (block, at, hs, or text of whose
    shingles of ``k`` words the sets are made) is read again for the sets that are needed."""

    names: DataFrame
    rows: DataFrame
    k: int | None = None


def text_sets(docs: DataFrame, id_col: str, text: str, k: int = SHINGLE_WORDS) -> Sets:
    """The shingle sets of a scan's texts by the polynomial; the sets themselves aren't written."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"), *places(docs))
    names = numbered(shingle_sets(rows, "id", "text", k, keep=["block", "at"], md5=False))
    return Sets(materialize(names.select("id", "set", "n", "block", "at")), rows.select("block", "at", "text"), k)


def stored(sets: DataFrame | Sets) -> Sets:
    """Sets that can be read by their places; those that are no numbered, written table are written."""
    if isinstance(sets, Sets):
        return sets
    ship_package(sets.sparkSession)
    try:
        at = places(sets) if "rid" in sets.columns else None
    except AnalysisException:
        at = None
    if at is None:
        sets = materialize(numbered(sets))
        at = places(sets)
    return Sets(sets.select("id", "set", "n", *at), sets.select(*at, "hs"))


def _listed_sets(batches: Iterator[pa.RecordBatch], folder: str, k: int | None) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(codes, (block, at, hs)) of the listed rows of some sets, once for each listing."""
    lists = Lists(folder)
    for batch in batches:
        rows, codes = lists.found(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        use, row = np.unique(rows, return_inverse=True)
        some = batch.take(pa.array(use))
        hs = some.column(2)
        if k is not None:
            sets = [x for texts in _text_slices(hs) for x in _polynomial_hashes([t or b"" for t in texts], k)]
            hs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets or [np.zeros(0, np.int64)]), pa.int64()))
        some = pa.RecordBatch.from_arrays([some.column(0), some.column(1), hs], names=["block", "at", "hs"])
        if len(use) == len(row):
            yield codes, some
        else:
            for i in range(0, len(row), 256):
                yield codes[i:i + 256], some.take(pa.array(row[i:i + 256]))


def _needed(n: F.Column, coverage: float) -> F.Column:
    """Least whole number of shared shingles that covers a share of n."""
    return F.ceil(F.lit(float(coverage)) * n - F.lit(1e-9))


def _ordered_members(sets: DataFrame, coverage: float, prefix_only: bool) -> tuple[DataFrame, DataFrame]:
    """(copies: id, rep; members (id, n, h, left, first) of one set of each kind): members that several
    sets hold, in the order (number of sets, h); ``left`` of them from here on, ``first``: in the prefix."""
    s = named(sets).where(F.size("hs") > 0).select("id", "set", "hs")
    names = materialize(s.select("id", "set"))
    same = names.groupBy("set").agg(F.min("id").alias("rep"))
    copies = names.join(same, "set").where("id <> rep").select("id", "rep")
    # one row a set: the members move once, and once more to the others of their shingle
    one = s.groupBy("set").agg(F.min("id").alias("id"), F.first("hs").alias("hs"))
    x = one.select("id", F.size("hs").cast("long").alias("n"), F.explode("hs").alias("h")).where("h is not null")
    x = x.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("df > 1")
    own = Window.partitionBy("id")
    x = x.withColumn("_r", F.row_number().over(own.orderBy("df", "h"))).withColumn("_m", F.count(F.lit(1)).over(own))
    # the n - m unshared shingles are rarer than every shared one
    first = F.col("_r") <= F.col("_m") - _needed(F.col("n"), coverage) + 1
    x = x.select("id", "n", "h", (F.col("_m") - F.col("_r") + 1).alias("left"), first.alias("first"))
    return copies, x.where("first") if prefix_only else x


def _bytes(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _cut(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(key, bytes of each column's part) of every key; rows of a key keep their order."""
    order = np.argsort(keys.astype(np.uint16) if keys.max(initial=0) < 1 << 16 else keys, kind="stable")  # 16 bits are sorted by radix
    keys, columns = keys[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(keys, prepend=-1, append=-1)) if len(keys) else np.zeros(0, np.int64)
    for s, e in zip(edges[:-1], edges[1:]):
        yield int(keys[s]), *[c[s:e].tobytes() for c in columns]


def _to_shards(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, hs = batch.column(0).to_numpy(), batch.column(1)
            members = hs.flatten()
            own = np.repeat(np.arange(len(hs)), np.diff(hs.offsets.to_numpy()))[members.is_valid().to_numpy(zero_copy_only=False)]
            h = _mix64(members.drop_null().to_numpy().astype(np.uint64))
            shard = ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
            rows = []
            for part in np.unique(rid >> 33):
                use = (rid >> 33 == part)[own]
                at = (rid[own[use]] & (1 << 33) - 1).astype(np.int32)
                rows += [(k, int(part), f, a) for k, f, a in _cut(shard[use], h[use].astype(np.uint32), at)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                             names=["shard", "part", "low", "at"])

    return run


def _leads_to_shards(folder: str, k: int | None, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _to_shards(shards)
        for codes, some in _listed_sets(batches, folder, k):
            yield from pack(iter([pa.RecordBatch.from_arrays([pa.array(codes - 1), some.column(2)], names=["rid", "hs"])]))

    return run


def _count_members(deals: int):
    def run(table: pa.Table) -> pa.Table:
        low = _bytes(table, "low", "<u4")
        rid = np.concatenate([np.frombuffer(a, "<i4").astype(np.int64) | p << 33 for p, a in zip(table.column("part").to_pylist(), table.column("at").to_pylist())])
        key = np.sort(low.astype(np.uint64) << np.uint64(32) | np.arange(len(low), dtype=np.uint64))
        low, rid = (key >> np.uint64(32)).astype(np.int64), rid[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        edges = np.flatnonzero(np.diff(low, prepend=-1, append=-1))
        df = np.repeat(np.diff(edges), np.diff(edges))
        use = df > 1
        h = low[use] | table.column("shard")[0].as_py() << 32
        rows = list(_cut((rid[use] % deals).astype(np.int32), rid[use], h, df[use].astype(np.int32)))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                    names=["deal", "rid", "h", "df"])

    return run


def _rank_members(coverage: float, prefix_only: bool):
    def run(found: pa.Table, leads: pa.Table) -> pa.Table:
        rid, h, df = _bytes(found, "rid", "<i8"), _bytes(found, "h", "<i8"), _bytes(found, "df", "<i4")
        leads = leads.sort_by("rid")
        own = np.searchsorted(leads.column("rid").to_numpy(), rid)
        order = np.lexsort((h, df, own))
        own, h = own[order], h[order]
        m = np.bincount(own, minlength=leads.num_rows)
        left = np.cumsum(m)[own] - np.arange(len(own))
        n = leads.column("n").to_numpy()[own]
        first = left >= np.ceil(coverage * n - 1e-9)
        use = first if prefix_only else np.ones(len(own), bool)
        return pa.Table.from_arrays([leads.column("id").take(pa.array(own[use])), *[pa.array(c[use]) for c in (n, h, left, first)]],
                                    names=["id", "n", "h", "left", "first"])

    return run


def _packed_members(sets: DataFrame | Sets, coverage: float, prefix_only: bool) -> tuple[DataFrame, DataFrame]:
    """As ``_ordered_members``; h is 32 bits of the shingle's hash beside its
    shard, so that a few candidates more are found, which C2 drops.

    Each Arrow batch of sets packs its shingles by shards of the hash space, a shard counts the sets of
    its shingles and packs the shared ones back by sets, and a deal of sets orders them. Shards and deals
    are of bounded size: their number follows the number of shingles. One set of each kind is packed: its
    row is found by its place."""
    sets = stored(sets)
    names = sets.names.where("n > 0")
    blocks = materialize(names.select("block").distinct())  # a row for some ten thousand sets
    blocks = blocks.select("block", (F.row_number().over(Window.orderBy("block")).cast("long")).alias("part"))
    rid = F.shiftleft("part", 33) + F.col("at").bitwiseAND((1 << LISTED) - 1)
    names = names.join(blocks, "block").select("id", "set", "n", "block", "at", rid.alias("rid"))
    same = names.groupBy("set").agg(F.min("id").alias("rep"), F.min(F.struct(F.col("id").isNull(), "id", "rid"))["rid"].alias("lead"))
    each = materialize(names.join(same, "set").select("id", "rep", "n", "block", "at", "rid", (F.col("rid") == F.col("lead")).alias("leads")))
    # sets without any id make no pair, and copies are linked to the smallest id
    leads = each.where("leads and rep is not null")
    total = each.agg(F.sum("n")).first()[0] or 0
    shards, deals = 1 + total // SHARD_MEMBERS, 1 + total // (2 * SHARD_MEMBERS)
    folder = listed(leads.select("block", "at", (F.col("rid") + 1).alias("code")))
    x = sets.rows.mapInArrow(_leads_to_shards(folder, sets.k, shards), "shard int, part long, low binary, at binary")
    x = x.groupBy("shard").applyInArrow(_count_members(deals), "deal int, rid binary, h binary, df binary")
    leads = leads.select((F.col("rid") % deals).cast("int").alias("deal"), F.col("rep").alias("id"), "n", "rid")
    kind = names.schema["id"].dataType.simpleString()
    x = x.groupBy("deal").cogroup(leads.groupBy("deal")).applyInArrow(_rank_members(coverage, prefix_only),
                                                                     f"id {kind}, n long, h long, left long, first boolean")
    return each.where("id <> rep").select("id", "rep"), x


def shingle_candidates(sets: DataFrame | Sets, coverage: float = COVERAGE, mode: str = "both", positional: bool = False) -> DataFrame:
    """Candidate edges (id, rep), complete for the coverage: no pair that C2 keeps is missing.

    ``both``: undirected, id > rep, shared / larger set >= coverage; both ends look at their
    prefix and at the sizes. ``query``: id is covered by rep (shared / |id|), in either order of
    the ids; the prefix of id meets all shingles of rep. ``target``: rep is covered by id.
    Copies of a set give one edge each, to the smallest id of the set, in every mode. Shingles that
    only one set holds can't be shared: they fill the front of a prefix without being joined.

    ``positional``: a pair is emitted only at a shared shingle behind which enough of both sets is left
    to reach the thresholds. The first shingle that a qualifying pair shares always is one, so C2's
    result is the same from fewer candidates; the candidates themselves are fewer, so the plain C1
    result doesn't use it. As any order of the shingles serves C2, they are counted in packed shards."""
    if mode not in MODES:
        raise ValueError(f"unknown coverage mode: {mode}")
    if positional:
        copies, x = _packed_members(sets, coverage, mode == "both")
    else:
        copies, x = _ordered_members(sets, coverage, mode == "both")
    x = materialize(x)
    pre = x.where("first").select("id", "n", "h", "left")
    other = [F.col("id").alias("rep"), F.col("n").alias("n_rep"), "h", F.col("left").alias("left_rep")]
    least = _needed(F.col("n"), coverage)
    if mode == "both":
        least = F.greatest(least, _needed(F.col("n_rep"), coverage))
        fits = (F.col("id") > F.col("rep")) & (F.least("n", "n_rep") >= least)
        pairs = pre.join(pre.select(*other), "h").where(fits)
    else:
        pairs = pre.join(x.select(*other), "h").where((F.col("id") != F.col("rep")) & (F.col("n_rep") >= least))
    if positional:
        pairs = pairs.where(F.least("left", "left_rep") >= least)
    if mode != "both":
        if mode == "target":
            pairs = pairs.select(F.col("rep").alias("id"), F.col("id").alias("rep"))
    return pairs.select("id", "rep").distinct().unionByName(copies)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if not ((a[1:] > a[:-1]).all() and (b[1:] > b[:-1]).all()):
        a, b = np.unique(a), np.unique(b)
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # merges the two
    return np.count_nonzero(both[1:] == both[:-1])


def _count_shared(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The common members of each pair of sets; a null member is one like any other."""
    row = {name: i for i, name in enumerate(zip(sets.column("block").to_pylist(), sets.column("at").to_pylist()))}
    hs = sets.column("hs").combine_chunks()
    members, ends = hs.flatten(), hs.offsets.to_numpy() - hs.offsets[0].as_py()
    held = np.concatenate([[0], np.cumsum(members.is_valid().to_numpy(zero_copy_only=False))])[ends]
    null, members = np.diff(held) < np.diff(ends), members.drop_null().to_numpy()
    a, b = ([row[name] for name in zip(pairs.column(f"block_{k}").to_pylist(), pairs.column(f"at_{k}").to_pylist())] for k in "ab")
    shared = [_common(members[held[i]:held[i + 1]], members[held[j]:held[j + 1]]) + int(null[i] and null[j]) for i, j in zip(a, b)]
    return pairs.select(["id", "rep", "n_id", "n_rep", "rows"]).append_column("shared", pa.array(shared, pa.int64()))


def _dealt_sets(folder: str, k: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, some in _listed_sets(batches, folder, k):
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), *some.columns], names=["into", "block", "at", "hs"])

    return run


def _verified_counts(x: DataFrame, sets: Sets) -> DataFrame:
    """(id, rep, n_id, n_rep, rows, shared) of pairs of different sets. Pairs that hang together are counted
    in one place, so that a set moves once for its neighbourhood, not once a pair: places are named by one
    round of contraction, a place of many members is cut into blocks of pairs, and packed into
    buckets of bounded size. The sets go there from their rows' places; sets of no pair stay."""
    x = x.select("id", "rep", "n_id", "n_rep", (F.col("rows_id") * F.col("rows_rep")).alias("rows"), "set", "set_rep",
                 F.col("set.x").alias("xa"), F.col("set_rep.x").alias("xb"))
    labels = _contract(x.select(F.col("xa").alias("a"), F.col("xb").alias("b")).distinct(), 0)
    x = materialize(x.join(labels.select(F.col("node").alias("xb"), F.col("label").alias("place")), "xb"))
    held = x.select("place", F.explode(F.array(F.struct(F.col("xa").alias("x"), F.col("n_id").alias("n")), F.struct(F.col("xb").alias("x"), F.col("n_rep").alias("n")))).alias("m")).distinct()
    blocks = held.groupBy("place").agg(F.sum("m.n").alias("held")) \
        .select("place", "held", F.floor(F.lit(1) + F.col("held") / PLACE_MEMBERS).alias("blocks"))
    blocks = materialize(blocks)
    buckets = 1 + int(blocks.agg(F.sum(F.col("held") * F.col("blocks"))).first()[0] or 0) // PLACE_MEMBERS
    cell = F.xxhash64("place", F.pmod("xa", "blocks"), F.pmod("xb", "blocks"))
    # a row that holds the set of each end
    ends = x.select("id", "set").union(x.select("rep", "set_rep")).distinct()
    lead = materialize(sets.names.join(ends, ["id", "set"]).groupBy("id", "set").agg(F.min(F.struct("block", "at")).alias("lead")))

    def end(i: str, id_col: str, set_col: str) -> DataFrame:
        return lead.select(F.col("id").alias(id_col), F.col("set").alias(set_col), F.col("lead.block").alias(f"block_{i}"), F.col("lead.at").alias(f"at_{i}"))

    x = x.join(blocks.select("place", "blocks"), "place").withColumn("bucket", F.pmod(cell, F.lit(buckets)).cast("int"))
    x = x.join(end("a", "id", "set"), ["id", "set"]).join(end("b", "rep", "set_rep"), ["rep", "set_rep"])
    x = materialize(x.select("id", "rep", "n_id", "n_rep", "rows", "block_a", "at_a", "block_b", "at_b", "bucket"))
    into = F.col("bucket").alias("code")
    rows = x.select(into, F.col("block_a").alias("block"), F.col("at_a").alias("at")).union(x.select(into, "block_b", "at_b")).distinct()
    some = sets.rows.mapInArrow(_dealt_sets(listed(rows), sets.k), "into int, block long, at long, hs array<long>")
    kinds = T.StructType([*[x.schema[c] for c in ("id", "rep", "n_id", "n_rep", "rows")], T.StructField("shared", T.LongType())])
    return x.groupBy("bucket").cogroup(some.groupBy("into")).applyInArrow(_count_shared, kinds)


def identity_coverage_filter(cand: DataFrame, sets: DataFrame | Sets, identity: float = IDENTITY,
                             coverage: float = COVERAGE, mode: str = "both") -> DataFrame:
    """Keep candidate edges whose shared shingles satisfy
    shared / min(|A|,|B|) >= identity and coverage on ``both`` sides (shared/max),
    the ``query`` side (shared/|A|) or the ``target`` side (shared/|B|).
    Each edge first meets the sizes and digests of its two sets: equal sets share all, and pairs whose
    sizes differ too much are dropped. Only the edges left meet the sets themselves, in cells of edges
    that hang together, and count their common members. Returns (id, rep, shared, n_id, n_rep, identity, coverage)."""
    if mode not in MODES:
        raise ValueError(f"unknown coverage mode: {mode}")
    if isinstance(sets, Sets):
        names = sets.names.select("id", "set", "n")
    else:
        sets = named(sets)
        names = sets.select("id", "set", F.col("n") if "rid" in sets.columns else F.size("hs").cast("long").alias("n"))
    names = names.groupBy("id", "set", "n").agg(F.count(F.lit(1)).cast("int").alias("rows"))
    of_id = ["id", "set", F.col("n").alias("n_id"), F.col("rows").alias("rows_id")]
    of_rep = [F.col("id").alias("rep"), F.col("set").alias("set_rep"), F.col("n").alias("n_rep"), F.col("rows").alias("rows_rep")]
    ends = cand.select("id", "rep").join(names.select(*of_id), "id").join(names.select(*of_rep), "rep")
    covered = {"both": F.greatest("n_id", "n_rep"), "query": F.col("n_id"), "target": F.col("n_rep")}[mode]
    most = F.least("n_id", "n_rep")
    ends = materialize(ends.where((most > 0) & (most >= _needed(covered, coverage))))
    equal = ends.where("set = set_rep").select("id", "rep", "n_id", "n_rep", (F.col("rows_id") * F.col("rows_rep")).alias("rows"), F.col("n_id").alias("shared"))
    x = _verified_counts(ends.where("set <> set_rep"), stored(sets)).unionByName(equal)
    # repeated rows of a set give an edge each
    x = x.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("rows")))).select("id", "rep", "shared", "n_id", "n_rep")
    ident = F.col("shared") / F.least("n_id", "n_rep")
    cov = {"both": F.col("shared") / F.greatest("n_id", "n_rep"),
           "query": F.col("shared") / F.col("n_id"),
           "target": F.col("shared") / F.col("n_rep")}[mode]
    x = x.withColumn("identity", ident).withColumn("coverage", cov)
    return x.filter((F.col("identity") >= identity) & (F.col("coverage") >= coverage))


def _contract(edges: DataFrame, number: int) -> DataFrame:
    """(node, label) for every node that has an edge: the node at most two edges away with the
    smallest hash. The hash changes with the round, so a chain falls to a part of its nodes whatever
    their ids are; a hub and its leaves take one label at once."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def drawn(c: str) -> F.Column:
        return F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("h"), F.col(c).alias("node"))

    near = both.groupBy("a").agg(F.min(drawn("b")).alias("near")).select("a", F.least(drawn("a"), F.col("near")).alias("near"))
    # once more: the leaves of a hub meet in what the hub has found
    far = both.join(near.select(F.col("a").alias("b"), "near"), "b").groupBy("a").agg(F.min("near").alias("far"))
    return far.select(F.col("a").alias("node"), F.col("far")["node"].alias("label"))


def _renamed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between labels; edges inside a label are gone."""
    x = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a") \
        .join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    return x.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()


def cluster_components(items: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """(representative, member) for every item; representative = smallest id of its
    connected component. Edge contraction: each round every node takes the label of a neighbour or
    its own, and the next round sees the edges between labels alone, so nodes and edges fall
    geometrically (chains, hubs and stars included) and the tables of all rounds together are of the
    size of the first. Then labels are looked up backwards, last round first. Each round's tables are
    written into the shared checkpoint folder; one scalar action a round (is an edge left).
    Edges with a null end or to themselves link nothing."""
    nodes = items.select(F.col(id_col).alias("node")).distinct()
    left = materialize(edges.where("id is not null and rep is not null and id <> rep")
                       .select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct())
    rounds = []
    while not left.isEmpty():  # labels of a component fall to one, so this ends
        labels = materialize(_contract(left, len(rounds)))
        left = materialize(_renamed(left, labels))
        rounds.append(labels)
    found = None
    for labels in reversed(rounds):
        if found is not None:
            later = found.select(F.col("node").alias("label"), F.col("label").alias("last"))
            labels = labels.join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
        found = labels
    if found is None:
        return nodes.select(F.col("node").alias("representative"), F.col("node").alias("member"))
    found = materialize(found)
    least = found.groupBy("label").agg(F.min("node").alias("representative"))
    found = found.join(least, "label").select("node", "representative")
    return nodes.join(found, "node", "left") \
        .select(F.coalesce("representative", "node").alias("representative"), F.col("node").alias("member"))


def max_containment(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """For each query item the largest share of its shingles found in one corpus
    item and how many corpus items it touches. ``queries`` holds distinct (id, h); ``corpus`` may
    repeat. Returns (id, n_shingles, max_shared, max_containment, n_hits).

    Exact, without a row for every touching pair: of each corpus item only the shingles that a query has
    are kept, items that keep the same ones become one class with a count, and queries meet classes. So
    a passage that a third of the corpus holds, and nothing else of the queries, is one class."""
    qs = queries.groupBy("id").agg(F.count(F.lit(1)).alias("n_shingles"))
    own = corpus.select(F.col("id").alias("cid"), "h").join(queries.select("h").distinct(), "h", "left_semi")
    sets = own.groupBy("cid").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    classes = sets.groupBy("hs").agg(F.count(F.lit(1)).alias("members"))
    # a class goes by a digest of its shingles, so that the rows of the join stay narrow
    name = F.sha2(F.array_join("hs", ",").cast("binary"), 256)
    met = classes.select(name.alias("class"), "members", F.explode("hs").alias("h")).join(queries, "h")
    shared = met.groupBy("id", "class", "members").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("id").agg(F.max("shared").alias("max_shared"), F.sum("members").alias("n_hits"))
    x = qs.join(best, "id", "left").fillna(0, ["max_shared", "n_hits"])
    return x.withColumn("max_containment", F.col("max_shared") / F.col("n_shingles"))
