"""Log-probabilities of texts under a weighted backoff automaton of word n-grams.

Tokens are a text's words (between ASCII white space, A-Z as a-z) and one end token; a begin mark
stands before the first. The model is a smoothed n-gram model of order ``ORDER``: a word's
probability after a history s is ``(c(s w) + KAPPA * P(w | s')) / (c(s) + KAPPA)``, s' being s without
its first token, down to ``(c(w) + 0.5) / (N + 0.5 * (V + 1))``. As an automaton every history that
occurs in the training text is a state; an arc (s, w) exists where s w occurs, and leads to the longest
state that ends in w; every state but the empty one has a failure arc to s' with the weight
``KAPPA / (c(s) + KAPPA)``. A traversal reads words left to right, takes failure arcs until an arc
fits, and adds up the weights. A state holds at most ``ORDER - 1`` tokens, so long texts are read as
segments that start ``ORDER - 1`` tokens early, all segments in step.

All n-grams of all training texts are counted. Each slice of a file block (``SLICE`` bytes of whole
texts) sends its distinct n-grams once, as sorted 64-bit hashes with their training counts, dealt by
hash ranges to shards; a hot n-gram comes once from a slice, so no shard is larger than others. Shards
add up and answer with the totals in the order asked. The answers are written as one file a slice; a
second scan builds the slice's part of the automaton from them and traverses its texts. Texts aren't
moved, and what is gathered grows with the text. Two n-grams in the same 64 bits would count as one.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.common import IntTable, mix64, save, scratch_path, ship_package
from gradus.llm.ngram_join import Words
from gradus.llm.perplexity import by_block
from gradus.llm.tokens import open_folder, put

ORDER = 2
#: Of 1 to 400 about the best on held-out documents of the given tables.
KAPPA = 200.0
SLICE = 8 << 20
SHARD_BYTES = 24 << 20
MIN_SHARDS = 24
#: N-grams of a shard that are added up at a time.
RANGE_GRAMS = 1 << 18
SEGMENT = 512
BEGIN, END = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _parts(texts: list[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Some whole texts at a time: what is held for every byte is held for these alone."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size or i == len(texts) - 1:
            yield texts[first:i + 1]
            first, held = i + 1, 0


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the number of every place's value in 32 bits, which any slice's places fit."""
    order = np.argsort(x).astype(np.int32)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    out = np.empty(len(x), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return x[new], out


class Grams:
    """The n-grams of every order of some texts. Sequences lie end to end: begin mark, words, end token.
    ``ids[k]``: number of the n-gram of order k that ends at each place (-1 where the sequence is too short);
    ``hashes[k]``, ``last[k]``, ``before[k]``, ``suffix[k]``: by number, its hash, last word, first k - 1 tokens and last k - 1 tokens."""

    def __init__(self, texts: list[bytes], order: int):
        read = [Words(part) for part in _parts(texts)]
        n = np.concatenate([np.zeros(0, np.int64), *[w.lens for w in read]]) + 2
        ends = np.cumsum(n)
        seq = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        seq[ends - n], seq[ends - 1] = BEGIN, END
        inner = np.ones(len(seq), bool)
        inner[ends - n] = inner[ends - 1] = False
        seq[inner] = np.concatenate([np.zeros(0, np.uint64), *[w.w for w in read]])
        del read
        del inner
        self.ends, self.sizes = ends, n
        words, word = _numbered(seq)
        size = len(seq)
        del seq
        self.into = np.arange(size, dtype=np.int32) - np.repeat((ends - n).astype(np.int32), n)
        self.ids, self.hashes, self.last, self.before, self.suffix = [None, word], [None, words], [None, np.arange(len(words), dtype=np.int32)], [None, None], [None, None]
        for k in range(2, order + 1):
            at = np.flatnonzero(self.into >= k - 1).astype(np.int32)
            key = self.ids[k - 1][at - 1].astype(np.int64)
            key *= len(words)
            key += word[at]
            u, inverse = _numbered(key)
            del key
            ids = np.full(size, -1, np.int32)
            ids[at] = inverse
            some = np.empty(len(u), np.int32)
            some[inverse] = at  # a place where each n-gram ends
            del at, inverse
            before, last = (u // max(1, len(words))).astype(np.int32), (u % max(1, len(words))).astype(np.int32)
            self.ids.append(ids)
            self.last.append(last)
            self.before.append(before)
            self.suffix.append(self.ids[k - 1][some])
            self.hashes.append(mix64(self.hashes[k - 1][before] * STEP + words[last] + np.uint64(k)))

    def asked(self, k: int) -> np.ndarray:
        """Numbers of the n-grams of order k in the order of their hashes."""
        return np.argsort(self.hashes[k], kind="stable")

    def counts(self, k: int, train: np.ndarray) -> np.ndarray:
        """How often each n-gram of order k occurs in the training texts."""
        use, out = np.repeat(train, self.sizes), np.zeros(len(self.hashes[k]), np.int64)
        for i in range(0, len(use), 1 << 18):  # bincount holds 8 bytes for each token that it counts
            own = self.ids[k][i:i + (1 << 18)]
            out += np.bincount(own[(own >= 0) & use[i:i + (1 << 18)]], minlength=len(out))
        return out


class Slices:
    """Cuts the rows of file blocks to slices; the same in every scan."""

    def __init__(self, size: int):
        self.size, self.block, self.part, self.rows, self.held = size, None, 0, [], 0

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
        """(block, part, rows); rows are (text, training row?, tag)."""
        for batch in batches:
            for block, part in by_block(batch):
                if block != self.block:
                    yield from self._close()
                    self.block, self.part = block, 0
                tags = part.column(3)
                for i, (text, train) in enumerate(zip(part.column(1), part.column(2).to_pylist())):
                    self.rows.append((text.as_py() or b"", train, tags[i]))
                    self.held += len(self.rows[-1][0])
                    if self.held >= self.size:
                        yield from self._close()
        yield from self._close()

    def _close(self):
        if self.rows:
            yield self.block, self.part, self.rows
        self.part, self.rows, self.held = self.part + 1, [], 0


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash space."""
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


_ASK = "shard int, block long, part int, k int, grams binary, counts binary"


def _requests(order: int, shards: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, rows in Slices(size).of(batches):
            g = Grams([t for t, _, _ in rows], order)
            train = np.array([x for _, x, _ in rows], bool)
            for k in range(1, order + 1):
                at = g.asked(k)
                h, n = g.hashes[k][at], g.counts(k, train)[at].astype("<u4")
                cut = np.searchsorted(_shard(h, shards), np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cut))
                cols = [some.astype(np.int32), np.full(len(some), block), np.full(len(some), part, np.int32), np.full(len(some), k, np.int32)]
                yield pa.record_batch([*map(pa.array, cols), pa.array([h[cut[s]:cut[s + 1]].astype("<u8").tobytes() for s in some], pa.binary()),
                                       pa.array([n[cut[s]:cut[s + 1]].tobytes() for s in some], pa.binary())], names=["shard", "block", "part", "k", "grams", "counts"])
            del g, rows, train, at, h, n  # before the next slice is read

    return run


_ANSWER = "block long, part int, k int, shard int, counts binary, tokens long, types long"


def _totals(t: pa.Table) -> pa.Table:
    """Answers of a shard, a range of its hashes at a time, and how many training tokens and distinct ones it has seen (a row without a block)."""
    out, tokens, types = [], 0, 0
    orders = np.array(t.column("k").to_pylist())
    for k in np.unique(orders).tolist():
        rows = t.take(np.flatnonzero(orders == k)).select(["block", "part", "shard"])
        grams, counts = ([np.frombuffer(t.column(c)[int(i)].as_buffer(), kind) for i in np.flatnonzero(orders == k)] for c, kind in (("grams", "<u8"), ("counts", "<u4")))
        total = [np.empty(len(g), "<u4") for g in grams]
        low, high = min(int(g[0]) for g in grams), max(int(g[-1]) for g in grams) + 1
        ranges = 1 + sum(map(len, grams)) // RANGE_GRAMS
        at = [0] * len(grams)
        for r in range(1, ranges + 1):
            top = np.uint64(max(0, low + (high - low) * r // ranges - 1))
            to = [int(np.searchsorted(g, top, side="right")) for g in grams]
            u, inverse = _numbered(np.concatenate([g[i:j] for g, i, j in zip(grams, at, to)]))
            n = np.bincount(inverse, weights=np.concatenate([c[i:j] for c, i, j in zip(counts, at, to)]), minlength=len(u))
            if k == 1:
                own = n[u != BEGIN]
                tokens, types = tokens + int(own.sum()), types + int((own > 0).sum())
            n, done = np.minimum(n, 2**32 - 1).astype("<u4")[inverse], 0
            for x, i, j in zip(total, at, to):
                x[i:j] = n[done:done + j - i]
                done += j - i
            at = to
        out += [(*row, x.tobytes(), 0, 0) for row, x in zip(zip(rows.column("block").to_pylist(), rows.column("part").to_pylist(), [k] * len(total), rows.column("shard").to_pylist()), total)]
    out.append((None, None, None, None, None, tokens, types))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["block", "part", "k", "shard", "counts", "tokens", "types"])


def _file(block: int, part: int) -> str:
    return f"counts-{block}-{part}.npz"


def _writer(folder: str):
    def write(t: pa.Table) -> pa.Table:
        block, part = t.column("block")[0].as_py(), t.column("part")[0].as_py()
        t = t.sort_by([("k", "ascending"), ("shard", "ascending")])
        by_order: dict[int, list[bytes]] = {}
        for k, counts in zip(t.column("k").to_pylist(), t.column("counts").to_pylist()):
            by_order.setdefault(k, []).append(counts)
        out = io.BytesIO()
        np.savez_compressed(out, **{f"k{k}": np.frombuffer(b"".join(x), "<u4") for k, x in by_order.items()})
        put(folder, _file(block, part), out.getvalue())
        return pa.table({"block": pa.array([block], pa.int64()), "part": pa.array([part], pa.int32())})

    return write


class Automaton:
    """The part of the automaton that some texts can reach. State 0 is the empty history; then come the
    n-grams of order 1, 2, ... below ``order`` that training text holds. ``table`` finds the arc of (state, word)."""

    def __init__(self, g: Grams, counts: list[np.ndarray], tokens: int, types: int, kappa: float):
        order, words = len(counts) - 1, len(g.hashes[1])
        self.words = words
        self.unknown = np.log10(0.5 / (tokens + 0.5 * (types + 1)))
        p = [None, (counts[1] + 0.5) / (tokens + 0.5 * (types + 1))]
        state, fail, weight, total = [None], [np.zeros(1, np.int64)], [np.zeros(1)], 1
        for k in range(1, order):
            known = np.flatnonzero(counts[k] > 0)
            number = np.zeros(len(counts[k]), np.int64)
            number[known] = total + np.arange(len(known))
            state.append(number)
            fail.append(np.zeros(len(known), np.int64) if k == 1 else state[k - 1][g.suffix[k][known]])
            weight.append(np.log10(kappa / (counts[k][known] + kappa)))
            total += len(known)
        self.fail, self.weight = np.concatenate(fail), np.concatenate(weight)
        keys, to, value, low, c, number, known = [], [], [], None, None, None, None
        for k in range(1, order + 1):
            if k > 1:
                low, c = p[k - 1][g.suffix[k]], counts[k - 1][g.before[k]]
                p.append(np.where(c > 0, (counts[k] + kappa * low) / (c + kappa), low))
            seen = np.flatnonzero(counts[k] > 0)
            source = np.zeros(len(seen), np.int64) if k == 1 else state[k - 1][g.before[k][seen]]
            keys.append(source * words + g.last[k][seen])
            to.append(state[k][seen] if k < order else state[k - 1][g.suffix[k][seen]] if k > 1 else np.zeros(len(seen), np.int64))
            value.append(np.log10(p[k][seen]))
        self.to, self.value, keys = np.concatenate(to), np.concatenate(value), np.concatenate(keys)
        del to, value, p, low, c, seen, source, state, number, known
        self.table = IntTable(keys)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 weight) of reading a word in every state."""
        total, out, todo = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        state = state.copy()
        while len(todo):
            arc = self.table.find(state[todo] * self.words + word[todo])
            hit = arc >= 0
            total[todo[hit]] += self.value[arc[hit]]
            out[todo[hit]] = self.to[arc[hit]]
            todo = todo[~hit]
            lost = state[todo] == 0  # a word that no training text holds
            total[todo[lost]] += self.unknown
            todo = todo[~lost]
            total[todo] += self.weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return out, total

    def traverse(self, g: Grams, order: int, segment: int) -> np.ndarray:
        """log10 probability of every text."""
        word, first = g.ids[1], g.ends - g.sizes + 1  # the begin mark isn't scored
        n = g.sizes - 1
        many = -(-n // segment)
        text = np.repeat(np.arange(len(n)), many)
        start = np.repeat(first, many) + segment * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
        stop = np.minimum(start + segment, g.ends[text])
        begin = np.maximum(start - (order - 1), first[text] - 1)
        by = np.argsort(-(stop - begin), kind="stable")
        text, start, stop, begin = text[by], start[by], stop[by], begin[by]
        out, state = np.zeros(len(n)), np.zeros(len(text), np.int64)
        score = np.zeros(len(text))
        for j in range(int((stop - begin).max()) if len(text) else 0):
            live = int(np.searchsorted(-(stop - begin), -j))  # those longer than j come first
            at = begin[:live] + j
            state[:live], w = self.step(state[:live], word[at])
            score[:live] += np.where(at >= start[:live], w, 0.0)
        np.add.at(out, text, score)
        return out


_SCORES = "n_tokens long, n_known long, base_score double, score double"


def _scorer(folder: str, order: int, kappa: float, tokens: int, types: int, size: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        for block, part, rows in Slices(size).of(batches):
            g = Grams([t for t, _, _ in rows], order)
            with fs.open_input_file(f"{base}/{_file(block, part)}") as f:
                z = np.load(io.BytesIO(f.read()))
            counts: list = [None]
            for k in range(1, order + 1):
                c = np.zeros(len(g.hashes[k]), np.int64)
                got = z[f"k{k}"]
                if len(got) != len(c):
                    raise RuntimeError("a block changed between two scans")
                c[g.asked(k)] = got
                counts.append(c)
            del z, c, got
            score = Automaton(g, counts, tokens, types, kappa).traverse(g, order, segment)
            c = counts[1][g.ids[1]]
            scored = g.into > 0
            own = np.repeat(np.arange(len(rows)), g.sizes)[scored]
            plain = np.bincount(own, weights=np.log10((c[scored] + 0.5) / (tokens + 0.5 * (types + 1))), minlength=len(rows))
            known = np.bincount(own, weights=c[scored] > 0, minlength=len(rows)).astype(np.int64)
            tags = pa.array([x.as_py() for _, _, x in rows], rows[0][2].type)
            yield pa.record_batch([tags, pa.array(g.sizes - 1), pa.array(known), pa.array(plain), pa.array(score)], names=["tag", "n_tokens", "n_known", "base_score", "score"])
            del g, rows, counts, c, scored, own, plain, known, score, tags  # before the next slice is read

    return run


def _located(docs: DataFrame, text: str, train: Column, keep: list[str]) -> DataFrame:
    """(block, text, train, tag) of every row; ``block`` names the file block a row is read from. Other tables than scans are written first."""
    packed = [F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b"")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"),
              F.struct(*[F.col(f"`{c}`") for c in keep]).alias("tag")]

    def block(df):
        meta = df.metadataColumn("_metadata")
        return F.xxhash64(meta["file_path"], meta["file_block_start"]).alias("block")

    try:
        return docs.select(block(docs), *packed)
    except AnalysisException:
        d = save(docs.select(*packed), "backoff-docs")
        return d.select(block(d), "text", "train", "tag")


def score_texts(docs: DataFrame, train: Column, keep: list[str], text: str = "text", order: int = ORDER, kappa: float = KAPPA) -> DataFrame:
    """The columns ``keep`` and, for every text, n_tokens (with the end token), n_known (tokens that training text holds),
    train_tokens, base_score (log10 probability under the order 1 model) and score (under the whole model).

    ``train``: a boolean column; rows where it holds are learned from, null counts as false. Null, empty and white texts
    have one token, the end. Without any training text every token is as likely as the unknown word, which has probability 1.
    Repeated rows are counted and scored each; an empty table has an empty result; other columns aren't read."""
    spark = docs.sparkSession
    ship_package(spark)
    d = _located(docs, text, train, keep)
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(MIN_SHARDS, int(size // SHARD_BYTES))
    asked = d.mapInArrow(_requests(order, shards, SLICE), _ASK)
    answers = save(asked.groupBy("shard").applyInArrow(_totals, _ANSWER), "backoff-answers")
    tokens, types = answers.where("block is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    folder = scratch_path(spark, "backoff-counts")
    own = answers.where("block is not null").select("block", "part", "k", "shard", "counts")
    own.groupBy("block", "part").applyInArrow(_writer(folder), "block long, part int").write.parquet(f"{folder}-list")
    kind = T.StructType([T.StructField("tag", d.schema["tag"].dataType), *T.StructType.fromDDL(_SCORES).fields])
    out = d.mapInArrow(_scorer(folder, order, kappa, int(tokens), int(types), SLICE, SEGMENT), kind)
    return out.select(*[F.col("tag").getField(c).alias(c) for c in keep], "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
