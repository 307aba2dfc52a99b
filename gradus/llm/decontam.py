"""Benchmark decontamination with suffix arrays over training shards.

Training documents are read in shards (Arrow batches). Each shard's words become numbers of the
benchmark's vocabulary (0 for every other word), a suffix array is built over the shard's
positions that can begin a match, and every benchmark suffix, cut to its window, is found by
binary search: the range of the suffix array holds all its occurrences. Overlapping occurrences
join into the longest verbatim matches, with their places, and give the hit words of a document.

The benchmark is searched in blocks of bounded text, each broadcast in turn against all rows, so
its size doesn't matter; a benchmark of one block (the usual case) needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.common import save, ship_package

WINDOW = 13
BLOCK_BYTES = 8 << 20
SEGMENT = 2 << 20
#: Bytes of words stay (A-Z in lower case): digits, letters and everything beyond ASCII; others part words.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Block:
    """The distinct windows of some benchmark items, as rows of word numbers."""

    def __init__(self, items: list[tuple], window: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text))
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(ids[i:i + n], set()).add(item)
        self.items = [sorted(y for y in x if y is not None) for x in found.values()]
        self.length = np.array([len(w) for w in found], dtype=np.int64)
        self.rows = np.zeros((len(found), window), dtype=np.int32)
        for i, w in enumerate(found):
            self.rows[i, :len(w)] = w
        self.least = int(self.length.min()) if len(found) else 0


def number(text: bytes, vocab: dict[bytes, int]) -> np.ndarray:
    """Word numbers of a text; a long one is split a segment at a time."""
    flat = text.translate(WORD_BYTES)
    get, out, at = vocab.get, [], 0
    while at < len(flat):
        end = flat.find(b" ", at + SEGMENT) if len(flat) - at > SEGMENT else -1
        end = len(flat) if end < 0 else end
        words = flat[at:end].split()
        out.append(np.fromiter(map(get, words, [0] * len(words)), dtype=np.int32, count=len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _bound(words: np.ndarray, order: np.ndarray, rows: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """For every row the first place of the suffix array whose suffix, cut to the row's length, is
    not less (upper: is greater) than the row."""
    lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(order), np.int64)
    cols = np.arange(rows.shape[1])
    valid = cols[None, :] < length[:, None]
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        got = words[order[mid][:, None] + cols[None, :]]
        diff = np.where(valid[open_], got - rows[open_], 0)
        first = (diff != 0).argmax(axis=1)
        sign = diff[np.arange(len(diff)), first]
        right = sign < 0 if not upper else sign <= 0
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


def search(words: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences (row of the block, position) of the block's windows in an array of word numbers;
    0 parts documents and stands for words that the benchmark doesn't have."""
    width = block.rows.shape[1]
    if not len(block.rows) or not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = words != 0
    stops = np.append(np.flatnonzero(~known), len(words))
    run = stops[np.searchsorted(stops, np.arange(len(words)))] - np.arange(len(words))
    begin = np.flatnonzero(run >= block.least)
    padded = np.append(words, np.zeros(width, np.int32))
    order = begin[np.lexsort([padded[begin + j] for j in range(width - 1, -1, -1)])] if len(begin) else begin
    lo = _bound(padded, order, block.rows, block.length, False)
    some = np.flatnonzero(lo < len(order))
    hi = lo.copy()
    hi[some] = _bound(padded, order, block.rows[some], block.length[some], True)
    count = hi - lo
    rows = np.repeat(np.arange(len(lo)), count)
    at = order[np.repeat(lo, count) + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)] if len(rows) else np.zeros(0, np.int64)
    return rows, at


def _searcher(blocks, index: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = blocks[index].value
        for batch in batches:
            docs, sizes = [], []
            for text in batch.column(1):
                raw = text.as_py()
                ids = number(raw, block.vocab) if raw else np.zeros(0, np.int32)
                docs += [ids, np.zeros(1, np.int32)]
                sizes.append(len(ids))
            words = np.concatenate(docs) if docs else np.zeros(0, np.int32)
            starts = np.cumsum([0] + [s + 1 for s in sizes])
            rows, at = search(words, block)
            doc = np.searchsorted(starts, at, side="right") - 1
            spans: list[list] = [[] for _ in sizes]
            items: list[list] = [[] for _ in sizes]
            if len(rows):
                mark = np.zeros(len(words) + 1, np.int32)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + block.length[rows], -1)
                on = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
                edge = np.flatnonzero(on[1:] != on[:-1])
                for s, e in zip(edge[::2], edge[1::2]):
                    d = int(np.searchsorted(starts, s, side="right") - 1)
                    spans[d].append({"start": int(s - starts[d]), "end": int(e - starts[d])})
                pairs = np.unique(doc * len(block.rows) + rows)
                seen: list[set] = [set() for _ in sizes]
                for d, r in zip(pairs // len(block.rows), pairs % len(block.rows)):
                    seen[d].update(block.items[r])
                items = [sorted(x) for x in seen]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()),
                                   pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                   pa.array(items, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items) of every document: the places [start, end) of its longest
    verbatim matches, in words, and the items (as strings) with a window in it.

    Null and empty texts have no words; null or empty items, and items without words, match
    nothing; an item with a null id marks words but isn't listed; repeated rows each get a result;
    other columns aren't read; an empty benchmark matches nothing."""
    spark = docs.sparkSession
    ship_package(spark)
    b = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).where("length(text) > 0")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    d = docs.select(F.col(doc_id).alias("row"), F.col(text).cast("binary").alias("text"))
    if n_blocks > 1:
        d = save(d.withColumn("row", F.struct(F.monotonically_increasing_id().alias("at"), F.col("row").alias("id"))), "decontam-docs")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([d.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("spans", spans), T.StructField("items", T.ArrayType(T.StringType()))])
    blocks, found = [], []
    for i in range(n_blocks):
        own = b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == i) if n_blocks > 1 else b
        items = [(None if r[0] is None else str(r[0]), bytes(r[1])) for r in own.toLocalIterator()]  # one block of the benchmark
        blocks.append(spark.sparkContext.broadcast(Block(items, window)))
        found.append(d.mapInArrow(_searcher(blocks, i), schema))
    if n_blocks == 1:
        return found[0].withColumnRenamed("row", "doc_id")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    out = (out.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                  F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    return out.select(F.col("row.id").alias("doc_id"), "n_words", _merged(F.col("spans")).alias("spans"), F.array_sort("items").alias("items"))


def _merged(spans):
    """Overlapping or touching spans as one."""
    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (last["end"] >= s["start"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))))\
            .otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), step)


def digest(found: DataFrame) -> DataFrame:
    """The contamination rule on the result of ``matches``: hit words are at least a twentieth."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    names = F.array_sort("items")
    d = found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                     F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), "spans")
    bad = (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", bad.alias("contaminated"), "spans")
