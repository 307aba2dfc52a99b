"""Perplexity under an interpolated modified Kneser-Ney model, with language-specific thresholds.

The model's symbols are bytes (A-Z in lower case) and its order is ``ORDER``. It is trained on all
trusted text: of trusted sources, of trusted ids, or of both. Counts, continuation counts, context totals and probabilities are tables
keyed by an n-gram packed into an integer; every level is a few aggregations and equi-joins, dealt
by n-gram, so the model has no size limit of one machine.

Texts aren't shuffled. Each file block of the documents sends its distinct n-grams (one row each,
however often they occur) to the joins and gets back their log-probabilities, written as one file a
block to the shared scratch folder; a second scan of the block adds them up per document. What is
joined grows with the number of blocks, each block's part is bounded by its text. Trusted ids go the
same way: they are joined to the ids of the documents alone, and each block gets the list of its own.

A document is kept if its log-perplexity isn't above its language's upper fence: the third quartile
plus ``FENCE`` times the distance of the quartiles, over all documents of the language.
"""

from __future__ import annotations

import io
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.common import IntTable, save, scratch_path, ship_package
from gradus.llm.tokens import open_folder, put

ORDER = 5
FENCE = 3.0
STRIDE = 1 << 19
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def packed(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, n-gram number of every byte) a stride at a time, for texts that lie end to end;
    bytes before a text count as 0."""
    lens = np.diff(ends, prepend=0)
    for s in range(0, len(data), STRIDE):
        e = min(len(data), s + STRIDE)
        first, last = np.searchsorted(ends, s, side="right"), np.searchsorted(ends, e - 1, side="right")
        begin = (ends - lens)[first:last + 1]
        into = np.arange(s, e) - np.repeat(begin, np.minimum(ends[first:last + 1], e) - np.maximum(begin, s))
        b = np.concatenate([np.zeros(max(0, ORDER - 1 - s), np.uint8), FOLD[data[max(0, s - ORDER + 1):e]]])
        g = np.zeros(e - s, np.int64)
        for j in range(ORDER):
            g = (g << 8) | b[j:j + e - s]
        short = into < ORDER - 1
        g[short] &= (np.int64(1) << (8 * (into[short] + 1))) - 1
        yield s, e, g


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ends of a binary column without nulls."""
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)), offsets[1:] - offsets[0]


def by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    b = batch.column(0).to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]) if len(b) else [0]
    for s, e in zip(cuts[:-1], cuts[1:]):
        yield int(b[s]), batch.slice(s, e - s)


def _block_grams(folder: str | None):
    """``folder``: lists of trusted ids by block, see ``trusted_by_block``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, gram, n): distinct n-grams, and how often they occur in trusted text."""
        have, ids = None, None
        for batch in batches:
            for block, part in by_block(batch):
                data, ends = flat(part.column(1))
                good = np.array(part.column(2).to_pylist(), dtype=bool)
                if folder:
                    if block != have:
                        have, ids = block, _trusted_ids(folder, block)
                    if ids is not None:
                        good |= pc.is_in(part.column(3), value_set=ids, skip_nulls=True).to_numpy(zero_copy_only=False)
                trusted = np.repeat(good, np.diff(ends, prepend=0))
                all_, some, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                for s, e, g in packed(data, ends):
                    all_ = np.union1d(all_, g)
                    u, c = np.unique(g[trusted[s:e]], return_counts=True)
                    both = np.union1d(some, u)
                    m = np.zeros(len(both), np.int64)
                    m[np.searchsorted(both, some)] += n
                    m[np.searchsorted(both, u)] += c
                    some, n = both, m
                count = np.zeros(len(all_), np.int64)
                count[np.searchsorted(all_, some)] = n
                yield pa.record_batch([pa.array(np.full(len(all_), block)), pa.array(all_), pa.array(count)], names=["block", "gram", "n"])

    return run


def _trusted_ids(folder: str, block: int) -> pa.Array | None:
    fs, base = open_folder(folder)
    path = f"{base}/trusted-{block}.arrow"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:  # no trusted id in this block
        return None
    with fs.open_input_file(path) as f:
        return pa.ipc.open_stream(f.read()).read_all().column(0).combine_chunks()


def _id_writer(folder: str):
    def write(t: pa.Table) -> pa.Table:
        block, out = t.column("block")[0].as_py(), io.BytesIO()
        ids = t.select(["id"]).sort_by("id")
        with pa.ipc.new_stream(out, ids.schema) as w:
            w.write_table(ids)
        put(folder, f"trusted-{block}.arrow", out.getvalue())
        return pa.table({"block": pa.array([block], pa.int64()), "ids": pa.array([len(ids)], pa.int64())})

    return write


def trusted_by_block(d: DataFrame, ids: DataFrame, doc_id: str) -> str:
    """The folder with the trusted ids of every block, one file a block that has any. ``ids``: one column.
    Only ids are read and joined; a block's list is bounded by its rows."""
    folder = scratch_path(d.sparkSession, "lm-trusted")
    kind = d.select(F.col(doc_id)).schema[0].dataType
    good = ids.select(F.col(ids.columns[0]).cast(kind).alias("id")).where("id is not null").distinct()
    own = d.select(F.col("_block").alias("block"), F.col(doc_id).alias("id")).distinct().join(good, "id").select("block", "id")
    own.groupBy("block").applyInArrow(_id_writer(folder), "block long, ids long").write.parquet(f"{folder}-list")
    return folder


def low(col, k: int):
    """The last k bytes of an n-gram."""
    return col.bitwiseAND(F.lit((1 << 8 * k) - 1))


def probabilities(counts: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p) of every wanted n-gram. counts: (gram, c) of the training text. Modified Kneser-Ney:
    raw counts at the top order, numbers of distinct left neighbours below, three discounts per order
    from the counts of counts, each order interpolated with the next and the first with 1/256."""
    levels = {order: counts.select("gram", F.col("c").cast("double").alias("c"))}
    for k in range(order - 1, 0, -1):
        levels[k] = save(levels[k + 1].groupBy(low(F.col("gram"), k).alias("gram")).agg(F.count("*").cast("double").alias("c")), f"lm-level{k}")
    need = {order: wanted}
    for k in range(order - 1, 0, -1):
        need[k] = need[k + 1].select(low(F.col("gram"), k).alias("gram")).distinct()
    below = None
    for k in range(1, order + 1):
        c = levels[k]
        n1, n2, n3, n4 = (float(x or 0) for x in c.agg(*[F.sum((F.col("c") == j).cast("long")) for j in (1, 2, 3, 4)]).first())
        d1, d2, d3 = discounts(n1, n2, n3, n4)
        context = F.shiftright("gram", 8)
        many = [F.sum((F.col("c") == 1).cast("double")).alias("m1"), F.sum((F.col("c") == 2).cast("double")).alias("m2"), F.sum((F.col("c") >= 3).cast("double")).alias("m3")]
        total = c.groupBy(context.alias("ctx")).agg(F.sum("c").alias("total"), *many)
        total = total.select("ctx", "total", ((F.lit(d1) * F.col("m1") + F.lit(d2) * F.col("m2") + F.lit(d3) * F.col("m3")) / F.col("total")).alias("gamma"))
        q = need[k].withColumn("ctx", context).join(total, "ctx", "left").join(c, "gram", "left")
        if below is None:
            q = q.withColumn("p_low", F.lit(1.0 / 256))
        else:
            q = q.withColumn("low", low(F.col("gram"), k - 1)).join(below.select(F.col("gram").alias("low"), F.col("p").alias("p_low")), "low")
        off = F.when(F.col("c") >= 3, F.lit(d3)).when(F.col("c") == 2, F.lit(d2)).otherwise(F.lit(d1))
        own = F.coalesce(F.greatest(F.col("c") - off, F.lit(0.0)) / F.col("total"), F.lit(0.0))
        below = q.select("gram", F.when(F.col("total").isNull(), F.col("p_low")).otherwise(own + F.col("gamma") * F.col("p_low")).alias("p"))
        below = save(below, f"lm-p{k}") if k < order else below
    return below


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Chen and Goodman's estimates, kept between 0 and the count; 1/2, 1, 3/2 where a count of counts is 0."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(x, 0.01), top) for x, top in ((1 - 2 * y * n2 / n1, 1.0), (2 - 3 * y * n3 / n2, 2.0), (3 - 4 * y * n4 / n3, 3.0)))


def _block_writer(folder: str):
    def write(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        g, p = t.column("gram").to_numpy(), t.column("logp").to_numpy()
        order = np.argsort(g)
        out = io.BytesIO()
        np.savez(out, gram=g[order], logp=p[order])
        put(folder, f"block-{block}.npz", out.getvalue())
        return pa.table({"block": pa.array([block], pa.int64()), "grams": pa.array([len(g)], pa.int64())})

    return write


def _scorer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, find, logp = None, None, None
        fs, base = open_folder(folder)
        for batch in batches:
            for block, part in by_block(batch):
                data, ends = flat(part.column(1))
                bits = np.zeros(len(ends))
                if len(data) and block != have:
                    with fs.open_input_file(f"{base}/block-{block}.npz") as f:
                        z = np.load(io.BytesIO(f.read()))
                        have, find, logp = block, IntTable(z["gram"]), z["logp"]
                for s, e, g in packed(data, ends):
                    at = find.find(g)
                    if (at < 0).any():
                        raise RuntimeError("a block changed between two scans")
                    first, last = np.searchsorted(ends, s, side="right"), np.searchsorted(ends, e - 1, side="right")
                    cut = np.concatenate([[s], ends[first:last], [e]])
                    bits[first:last + 1] += np.bincount(np.repeat(np.arange(last + 1 - first), np.diff(cut)), weights=logp[at], minlength=last + 1 - first)
                n = np.diff(ends, prepend=0)
                mean = np.where(n > 0, bits / np.maximum(n, 1), np.nan)
                yield pa.record_batch([part.column(3), pa.array(-mean, mask=n == 0)], names=["row", "log_perplexity"])

    return run


def with_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` with _block, a number of the file block that a row is read from; other tables than scans are written first."""
    block = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    try:
        return docs.withColumn("_block", block)
    except AnalysisException:
        return save(docs, "lm-docs").withColumn("_block", block)


def log_perplexities(docs: DataFrame, trusted, keep: list[str], text: str = "text", trusted_ids: DataFrame | None = None, doc_id: str = "doc_id") -> DataFrame:
    """The columns ``keep`` and log_perplexity (natural, a byte; null for null and empty texts). ``trusted``: a boolean
    column. ``trusted_ids``: a table of one column with the ids of further trusted rows."""
    spark = docs.sparkSession
    ship_package(spark)
    d = with_blocks(docs)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    marks = trusted_by_block(d, trusted_ids, doc_id) if trusted_ids is not None else None
    read = d.select("_block", body, F.coalesce(trusted, F.lit(False)).alias("trusted"), *([F.col(doc_id).alias("id")] if marks else []))
    grams = save(read.mapInArrow(_block_grams(marks), "block long, gram long, n long"), "lm-grams")
    counts = save(grams.where("n > 0").groupBy("gram").agg(F.sum("n").alias("c")), "lm-counts")
    if counts.isEmpty() and not grams.isEmpty():
        warnings.warn("no trusted text: every byte has probability 1/256 and no text is told from another", stacklevel=2)
    p = probabilities(counts, grams.select("gram").distinct())
    folder = scratch_path(spark, "lm-blocks")
    own = grams.select("block", "gram").distinct().join(p.select("gram", F.log("p").cast("float").alias("logp")), "gram")
    own.groupBy("block").applyInArrow(_block_writer(folder), "block long, grams long").write.parquet(f"{folder}-list")
    rows = d.select("_block", body, F.lit(False), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    out = rows.mapInArrow(_scorer(folder), T.StructType([rows.schema["row"], T.StructField("log_perplexity", T.DoubleType())]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "log_perplexity")


def judge(docs: DataFrame, trusted_sources: tuple[str, ...], doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", trusted_ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) of every row. Trusted are the rows of trusted sources, and
    those whose id is in the table ``trusted_ids`` (one column).

    Null and empty texts have no perplexity and aren't kept. A null language is a language of its own.
    Without any trusted text every byte has probability 1/256, all texts are kept and a warning says so. Repeated rows are
    judged alike; other columns aren't read."""
    trusted = F.col(source).isin(*trusted_sources) if trusted_sources else F.lit(False)
    s = save(log_perplexities(docs, trusted, [doc_id, lang], text, trusted_ids, doc_id), "lm-scores")
    quart = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    fence = s.where("log_perplexity is not null").groupBy(F.col(lang).alias("_lang")).agg(quart.alias("q"))
    fence = save(fence.select("_lang", (F.col("q")[1] + F.lit(FENCE) * (F.col("q")[1] - F.col("q")[0])).alias("top")), "lm-fences")
    out = s.join(fence, F.col(lang).eqNullSafe(F.col("_lang")), "left")
    kept = F.coalesce(F.col("log_perplexity") <= F.col("top"), F.lit(False))
    return out.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.exp("log_perplexity").alias("perplexity"), F.exp("top").alias("threshold"), kept.alias("kept"))
