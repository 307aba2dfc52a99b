"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are the words of a text (letters, A-Z in lower case) and their first 4, 5 and 6
characters, hashed to 64 bits. A text's score is the sum, over its distinct words, of the weights
of their features, over the logarithm of the number of distinct words. One weight vector serves
all grades: P(grade > j) = logistic(score - threshold_j) with thresholds in ascending order, so a
text has a probability for every grade and the expected severity is the sum of P(grade > j).

The model is fitted on a bounded, documented sample of labelled rows (``TRAIN_ROWS`` a grade, by a
hash of the id; rows are weighted by their grade's share, so that probabilities hold for all rows),
with the ``MAX_FEATURES`` features that depend most on the label. Prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.common import rename_clashes, save, ship_package

TRAIN_ROWS, MAX_FEATURES, MIN_DOCS = 4000, 2000, 5
PREFIXES = (4, 5, 6)
CACHE_WORDS = 200_000
#: Letters stay (A-Z in lower case, everything beyond ASCII); others part words.
LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def distinct_words(text: bytes, segment: int = 4 << 20) -> set[bytes]:
    """The words of a whole text; a long one is read a segment at a time."""
    flat, out, at = text.translate(LETTERS), set(), 0
    while at < len(flat):
        end = flat.find(b" ", at + segment) if len(flat) - at > segment else -1
        end = len(flat) if end < 0 else end
        out.update(flat[at:end].split())
        at = end
    return out


def word_features(w: bytes) -> list[int]:
    import xxhash

    t = w.decode("utf-8", "replace")
    return [xxhash.xxh3_64_intdigest(w) >> 1, *[xxhash.xxh3_64_intdigest(t[:n].encode(), seed=n) >> 1 for n in PREFIXES if len(t) > n]]


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct features, in how many distinct words each is, and the number of distinct words."""
    words = distinct_words(text)
    f = [x for w in words for x in word_features(w)]
    u, n = np.unique(np.array(f, dtype=np.int64), return_counts=True)
    return u, n, len(words)


def sample_labels(labels: DataFrame, doc_id: str = "doc_id", grade: str = "grade", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, grade, all) of at most ``rows`` labels a grade, by a hash of the id; all: how many there are.
    A written table of bounded size, so that joining texts to it moves no text."""
    d = labels.where(F.col(grade).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id), F.col(grade).cast("int").alias(grade))
    d = d.withColumn("h", F.pmod(F.xxhash64(F.lit("toxicity"), F.col(doc_id)), F.lit(1 << 40)))
    counts = save(d.groupBy(grade).agg(F.count("*").alias("all")), "toxicity-counts")
    near = d.join(F.broadcast(counts), grade).where(F.col("h") <= F.lit(float(1 << 40)) * F.lit(2.0 * rows + 32) / F.col("all"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy(grade).orderBy("h"))).where(F.col("r") <= rows)
    return save(near.select(doc_id, grade, "all"), "toxicity-sample")


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f, n, size = [], [], []
        for t in batch.column(1):
            a, b, c = text_features(t.as_py())
            f.append(a)
            n.append(b.astype(np.int32))
            size.append(c)
        yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(f, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int32())), pa.array(size, pa.int32())],
                              names=["id", "grade", "all", "f", "n", "size"])


class Model:
    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.weight = {int(f): float(w) for f, w in zip(features, weights) if w}
        self.thresholds = thresholds
        self.cache: dict[bytes, float] = {}

    def word(self, w: bytes) -> float:
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            got = self.cache[w] = sum(self.weight.get(f, 0.0) for f in word_features(w))
        return got

    def score(self, text: bytes) -> float:
        words = distinct_words(text)
        return sum(map(self.word, sorted(words))) / np.log2(2 + len(words))

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) by text and threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n_cols: int, grade: np.ndarray, weight: np.ndarray,
                steps: int = 300, rate: float = 0.1, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model by Adam on the penalised
    log-likelihood. (rows, cols, values): the sparse feature matrix; grades are 0..K."""
    top = int(grade.max())
    weight = weight / weight.sum()
    share = np.array([weight[grade > j].sum() for j in range(top)])
    first = np.log((1 - share) / np.maximum(share, 1e-9))
    # thresholds are the first one and positive steps
    par = np.concatenate([np.zeros(n_cols), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    n = len(grade)
    for t in range(1, steps + 1):
        w, th = par[:n_cols], par[n_cols] + np.concatenate([[0.0], np.cumsum(np.exp(par[n_cols + 1:]))])
        s = np.bincount(rows, weights=values * w[cols], minlength=n)
        up = 1.0 / (1.0 + np.exp(np.clip(th[None, :] - s[:, None], -50, 50)))  # P(> j)
        full = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        p = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-12)
        d = np.concatenate([np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))], axis=1)  # slopes of P(> j) in s
        ds = weight * (d[np.arange(n), grade] - d[np.arange(n), grade + 1]) / p
        gth = np.zeros(top)
        for j in range(top):  # a higher threshold lowers P(> j)
            gth[j] = (weight / p * d[:, j + 1] * ((grade == j).astype(float) - (grade == j + 1))).sum()
        gw = np.bincount(cols, weights=values * ds[rows], minlength=n_cols) - penalty * w
        g = np.concatenate([gw, [gth.sum()], [gth[j + 1:].sum() * np.exp(par[n_cols + 1 + j]) for j in range(top - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par = par + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return par[:n_cols], par[n_cols] + np.concatenate([[0.0], np.cumsum(np.exp(par[n_cols + 1:]))])


def fit(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", severity_levels: int = 0) -> Model | None:
    """The model of grades 0..K; None if fewer than two grades are labelled. ``sample``: see ``sample_labels``.

    ``severity_levels`` > 1: the labels are 0 and 1 only, and the positive rows of the sample are split
    to that many grades, at the quantiles of the share of their words that carry a feature seen with
    the label 1 at least four times as often as its share: the more such words, the severer."""
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text")).where(F.col("text").isNotNull())
    few = F.broadcast(sample.select(F.col(doc_id).alias("id"), F.col(grade).alias("grade"), "all"))  # bounded by the rows a grade
    sample = d.join(few, "id").select("id", "text", "grade", "all")
    kind = sample.schema["id"].dataType.simpleString()
    feats = save(sample.mapInArrow(_featurise, f"id {kind}, grade int, all long, f array<long>, n array<int>, size int"), "toxicity-features")
    totals = {int(r[0]): (int(r[1]), int(r[2])) for r in feats.groupBy("grade").agg(F.count("*"), F.max("all")).collect()}
    if len(totals) < 2:
        return None
    n_all = sum(x[0] for x in totals.values())
    n_pos = sum(k for g, (k, _) in totals.items() if g > 0)
    seen = feats.select(F.explode("f").alias("f"), (F.col("grade") > 0).cast("double").alias("y")).groupBy("f").agg(F.count("*").cast("double").alias("k"), F.sum("y").alias("a"))
    expected = F.col("k") * F.lit(n_pos / n_all)
    chi = (F.col("a") - expected) * (F.col("a") - expected) / (expected * (1 - F.lit(n_pos / n_all)))
    best = seen.where(F.col("k") >= MIN_DOCS).withColumn("chi", chi).orderBy(F.desc("chi"), "f").limit(MAX_FEATURES).select("f", "k", "a").toPandas()
    if not len(best):
        return None
    table = best.sort_values("f")
    keys = table["f"].to_numpy(np.int64)
    marked = table["a"].to_numpy() >= 0.8 * table["k"].to_numpy()
    chosen = spark.sparkContext.broadcast(keys)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chosen.value
        for b in batches:
            f, n = [], []
            for x, y in zip(b.column("f").to_pylist(), b.column("n").to_pylist()):
                x, y = np.array(x, np.int64), np.array(y, np.int32)
                at = np.minimum(np.searchsorted(own, x), len(own) - 1)
                hit = own[at] == x
                f.append(at[hit].astype(np.int32))
                n.append(y[hit])
            yield pa.record_batch([b.column("grade"), b.column("all"), b.column("size"), pa.array(f, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["grade", "all", "size", "f", "n"])

    got = feats.orderBy("id").mapInArrow(select, "grade int, all long, size int, f array<int>, n array<int>").toPandas()  # the bounded sample
    sizes = np.maximum(1, got["size"].to_numpy(np.float64))
    lens = got["f"].map(len).to_numpy()
    r = np.repeat(np.arange(len(got)), lens)
    c = np.concatenate([np.asarray(x, np.int64) for x in got["f"]]) if lens.sum() else np.zeros(0, np.int64)
    n = np.concatenate([np.asarray(x, np.float64) for x in got["n"]]) if lens.sum() else np.zeros(0)
    grade_ = got["grade"].to_numpy(np.int64)
    weight = np.array([totals[g][1] / totals[g][0] for g in grade_], dtype=np.float64)
    names = sorted(totals)
    y = np.searchsorted(names, grade_)
    if severity_levels > 1 and len(names) == 2:
        share = np.bincount(r, weights=n * marked[c], minlength=len(got)) / sizes
        cuts = np.quantile(share[y == 1], np.arange(1, severity_levels) / severity_levels)
        y = np.where(y == 1, 1 + np.searchsorted(cuts, share, side="left"), 0)
        y = np.searchsorted(np.unique(y), y)
    w, th = fit_ordinal(r, c, n / np.log2(2 + got["size"].to_numpy(np.float64))[r], len(keys), y, weight)
    return Model(keys, w, th)


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            s = np.array([m.score(t.as_py() or b"") for t in batch.column(1)], dtype=np.float64)
            some = np.array([x.is_valid and len(x.as_py()) > 0 for x in batch.column(1)], dtype=bool)
            up = m.above(s) * some[:, None]
            full = np.concatenate([np.ones((len(s), 1)), up, np.zeros((len(s), 1))], axis=1)
            grade = (full[:, :-1] - full[:, 1:]).argmax(axis=1)
            yield pa.record_batch([batch.column(0), pa.array(up.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(up[:, 0]), pa.array(up[:, 0] >= 0.5)],
                                  names=["row", "expected_severity", "grade", "p_toxic", "toxic"])

    return run


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and expected_severity (0 to K), grade (the likeliest), p_toxic
    (P(grade > 0)) and toxic (p_toxic >= 0.5); input columns of these names are dropped.

    Null and empty texts have severity 0. The order of words doesn't matter; repeated rows get equal results."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = rename_clashes(docs, ["expected_severity", "grade", "p_toxic", "toxic"])
    keep = [c for c in (docs.columns if keep is None else keep) if c in docs.columns]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).cast("binary").alias("text"))
    schema = T.StructType([d.schema["row"], T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()),
                           T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    out = d.mapInArrow(_predictor(spark.sparkContext.broadcast(model)), schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "expected_severity", "grade", "p_toxic", "toxic")
