"""Language identification by prediction by partial matching over bytes.

Each language has a context tree: counts of the bytes that follow every context of 0 to ``ORDER``
bytes of its training texts. A byte is coded in its longest context of the tree where it was seen;
a context that hasn't seen it costs an escape, with probability distinct / (total + distinct), and
the next shorter context is tried, down to one of 256 equal bytes. The statistics are frozen after
training, so a text's code length is a sum over its bytes of one number per language and context.
The language with the shortest code wins; the score is its posterior under equal priors.

Trees are fitted on a bounded sample of labelled rows: at most ``TRAIN_ROWS`` rows and
``TRAIN_BYTES`` bytes over all languages (each language has an equal share of the bytes, and at
least one row), chosen by a hash of the id. Counting is a Spark aggregation; the compiled trees
have at most one entry per sampled byte and order, and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.common import IntTable, rename_clashes, save, ship_package

ORDER = 4
TRAIN_ROWS, TRAIN_BYTES = 2000, 6 << 20
#: Positions that are scored at once; bounds a task's memory whatever the texts' lengths.
STRIDE = 1 << 19
#: Bits a byte above which no learned language explains a text.
REJECT_BITS = 7.0
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def training_sample(labelled: DataFrame, doc_id: str, text: str, lang: str, rows: int, size: int) -> DataFrame:
    """(lang, text): whole texts, within the bounds, in the order of a hash of the id."""
    d = labelled.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0))
    d = d.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    d = d.withColumn("h", F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 40)))
    counts = save(d.groupBy("lang").agg(F.count("*").alias("n")), "langid-counts")
    langs = max(1, counts.count())
    share, most = size // langs, max(1, rows // langs)
    near = d.join(counts, "lang").where(F.col("h") <= F.lit(float(1 << 40)) * F.lit(4.0 * most + 16) / F.col("n"))
    by = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    near = near.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most)
    near = near.withColumn("before", F.sum(F.octet_length("text")).over(by) - F.octet_length("text"))
    return near.where((F.col("r") == 1) | (F.col("before") < share)).select("lang", "text")


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, k, gram, n): how often each run of k + 1 bytes ends at a byte of the texts."""
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            b = np.concatenate([np.zeros(ORDER, np.uint8), FOLD[np.frombuffer(text, np.uint8)]])
            for s in range(ORDER, len(b), STRIDE):
                g = grams(b[s - ORDER:s + STRIDE])
                for k in range(ORDER + 1):
                    u, n = np.unique(g & ((1 << 8 * (k + 1)) - 1), return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(u)), pa.array(np.full(len(u), k, np.int32)), pa.array(u), pa.array(n.astype(np.int64))], names=["lang", "k", "gram", "n"])


def grams(b: np.ndarray) -> np.ndarray:
    """For every byte after the first ``ORDER`` the number made of it and the ``ORDER`` before it."""
    n = len(b) - ORDER
    g = np.zeros(n, np.int64)
    for j in range(ORDER + 1):
        g = (g << 8) | b[j:j + n]
    return g


class Trees:
    """All languages' context trees as one table per order: a row per run of bytes, a column per language."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        """counts[k]: distinct runs of k + 1 bytes, and their counts by language."""
        self.langs, self.grams, self.cost, self.contexts, self.escape = langs, [], [], [], []
        for k in range(ORDER + 1):
            g, n = counts[k]
            ctx, at = np.unique(g >> 8, return_inverse=True)
            total, kinds = (np.zeros((len(ctx), len(langs))) for _ in range(2))
            np.add.at(total, at, n)
            np.add.at(kinds, at, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(n / (total + kinds)[at])
            lower = np.full(n.shape, 8.0) if k == 0 else self.cost[k - 1][self.grams[k - 1].find(g & ((1 << 8 * k) - 1))]
            self.grams.append(IntTable(g))
            self.cost.append(np.where(n > 0, seen, esc[at] + lower))
            self.contexts.append(IntTable(ctx))
            self.escape.append(esc)

    def bits(self, g: np.ndarray) -> np.ndarray:
        """Code length of every byte by language."""
        out = np.zeros((len(g), len(self.langs)))
        left = np.arange(len(g))
        for k in range(ORDER, -1, -1):
            key = g[left] & ((1 << 8 * (k + 1)) - 1)
            at = self.grams[k].find(key)
            hit = at >= 0
            if len(left) == len(g) and hit.all():
                return self.cost[k][at]
            out[left[hit]] += self.cost[k][at[hit]]
            left, key = left[~hit], key[~hit]
            c = self.contexts[k].find(key >> 8)
            out[left[c >= 0]] += self.escape[k][c[c >= 0]]
        out[left] += 8.0
        return out

    def code_lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits by text and language; texts lie end to end in ``data``, each coded from an empty context."""
        lens = np.diff(ends, prepend=0)
        total = np.zeros((len(ends), len(self.langs)))
        s = 0
        while s < len(data):
            e = min(len(data), s + STRIDE)
            first, last = np.searchsorted(ends, s, side="right"), np.searchsorted(ends, e - 1, side="right")
            doc = np.repeat(np.arange(first, last + 1), np.minimum(ends[first:last + 1], e) - np.maximum(ends[first:last + 1] - lens[first:last + 1], s))
            b = FOLD[data[max(0, s - ORDER):e]]
            g = grams(np.concatenate([np.zeros(ORDER - (s - max(0, s - ORDER)), np.uint8), b]))
            into = np.arange(s, e) - (ends - lens)[doc]  # bytes of the text before this one
            short = into < ORDER
            g[short] &= (np.int64(1) << (8 * (into[short] + 1))) - 1
            bits = self.bits(g)
            for j in range(len(self.langs)):
                total[first:last + 1, j] += np.bincount(doc - first, weights=bits[:, j], minlength=last + 1 - first)
            s = e
        return total


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Trees:
    """Context trees of every language with a labelled, non-empty text."""
    ship_package(labelled.sparkSession)
    sample = training_sample(labelled, doc_id, text, lang, rows, size)
    n = sample.mapInArrow(gram_counts, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    got = n.toArrow()  # at most size * (ORDER + 1) entries and one more text per language
    names = got.column("lang").combine_chunks().dictionary_encode() if got.num_rows else pa.array([], pa.string()).dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    rank = np.array([langs.index(x) for x in names.dictionary.to_pylist()], dtype=np.int64)
    column, order, gram, number = rank[names.indices.to_numpy()] if len(langs) else np.zeros(0, np.int64), *[got.column(c).to_numpy() for c in ("k", "gram", "n")]
    counts = {}
    for k in range(ORDER + 1):
        own = order == k
        g, at = np.unique(gram[own].astype(np.int64), return_inverse=True)
        c = np.zeros((len(g), len(langs)))
        c[at, column[own]] = number[own]
        counts[k] = g, c
    return Trees(langs, counts)


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees = model.value
        names = np.array([*trees.langs, "und"], dtype=object)
        for batch in batches:
            col, lettered = batch.column(1), np.array(batch.column(2).to_pylist(), dtype=bool)
            col = col.cast(pa.large_binary())
            offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
            data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
            ends, lens = offsets[1:] - offsets[0], np.diff(offsets)
            best, score, per = np.full(len(col), len(names) - 1), np.zeros(len(col)), np.zeros(len(col))
            if len(trees.langs):
                bits = trees.code_lengths(data, ends)
                pick = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), pick]
                post = 1.0 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(axis=1)
                best, score, per = np.where(lettered, pick, len(names) - 1), np.where(lettered, post, 0.0), least / np.maximum(lens, 1)
            yield pa.record_batch([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(per)], names=["row", "lang_pred", "score", "bits_per_byte"])

    return run


def predict(docs: DataFrame, trees: Trees, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) of every row, and lang_pred, score (0 to 1) and
    bits_per_byte; input columns of these names are dropped.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    Equally short codes go to the first language by name. Long texts are scored a stride at a time."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = rename_clashes(docs, ["lang_pred", "score", "bits_per_byte"])
    keep = [c for c in (docs.columns if keep is None else keep) if c in docs.columns]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), body.alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    model = spark.sparkContext.broadcast(trees)
    schema = T.StructType([d.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    out = d.mapInArrow(_predictor(model), schema)
    return out.select("row.*", "lang_pred", "score", "bits_per_byte")


def accepted():
    """Rows of ``predict`` in a learned language."""
    return (F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= REJECT_BITS)
