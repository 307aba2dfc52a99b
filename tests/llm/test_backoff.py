"""Backoff automaton against the smoothed model by definition and a word-by-word traversal."""
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import backoff as B
from gradus.llm import queries as Q
from tests.llm.conftest import prose

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text):
    return ["<s>", *(text or "").encode().translate(FOLD).split(), "</s>"]


class Model:
    def __init__(self, train, order, kappa):
        self.order, self.kappa = order, kappa
        self.c = Counter(tuple(t[i - k + 1:i + 1]) for t in map(tokens, train) for k in range(1, order + 1) for i in range(k - 1, len(t)))
        own = {g: n for g, n in self.c.items() if len(g) == 1 and g != ("<s>",)}
        self.n, self.v = sum(own.values()), len(own)

    def base(self, w):
        return (self.c[(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p(self, w, s):
        s = tuple(s)
        if not s:
            return self.base(w)
        low = self.p(w, s[1:])
        return (self.c[s + (w,)] + self.kappa * low) / (self.c[s] + self.kappa) if self.c[s] else low

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(t[i], t[max(0, i - self.order + 1):i])) for i in range(1, len(t)))

    def by_automaton(self, text):
        """One traversal with states and failure arcs."""
        state, total = ("<s>",) if self.order > 1 and self.c[("<s>",)] else (), 0.0
        for w in tokens(text)[1:]:
            while state and not self.c[state + (w,)]:
                total += math.log10(self.kappa / (self.c[state] + self.kappa))
                state = state[1:]
            total += math.log10(self.p(w, state))
            state = (state + (w,))[-(self.order - 1):] if self.order > 1 and self.c[(w,)] else ()
            while state and not self.c[state]:
                state = state[1:]
        return total

    def row(self, text):
        t = tokens(text)[1:]
        return len(t), sum(self.c[(w,)] > 0 for w in t), self.n, sum(math.log10(self.base(w)) for w in t), self.score(text)


def texts(rng, n):
    return [" ".join(rng.choice(["The", "the", "cat", "Sat", "on", "a", "mat", "été", "x%d" % rng.randint(0, 30)]) for _ in range(rng.choice([0, 1, 2, 9, 70]))) for _ in range(n)]


def same(got, want):
    assert got[:3] == want[:3] and got[3:] == pytest.approx(want[3:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_automaton_equals_definition(rng, order):
    train, other = texts(rng, 30), texts(rng, 20) + ["", "never seen words", "the cat never sat " * 40]
    m = Model(train, order, 3.0)
    g = B.Grams([t.encode() for t in train + other], order)
    mark = np.array([True] * len(train) + [False] * len(other))
    a = B.Automaton(g, [None, *[g.counts(k, mark) for k in range(1, order + 1)]], m.n, m.v, 3.0)
    want = [m.score(t) for t in train + other]
    for segment in (1, 5, 512):
        assert a.traverse(g, order, segment).tolist() == pytest.approx(want, rel=1e-9)
    assert [m.by_automaton(t) for t in train + other] == pytest.approx(want, rel=1e-9)
    assert len(a.fail) <= 1 + len(m.c) and (a.fail[1:] < np.arange(1, len(a.fail))).all()


def test_probabilities_add_up(rng):
    m = Model(texts(rng, 20), 3, 5.0)
    vocabulary = [g[0] for g in m.c if len(g) == 1 and g != ("<s>",)] + ["unknown"]
    for s in [(), ("<s>",), ("the",), ("the", "cat"), ("unknown", "the")]:
        assert sum(m.p(w, s) for w in vocabulary) == pytest.approx(1)


def test_query_equals_brute_force(spark, make, rng, odd_rows, tmp_path):
    rows = odd_rows + [(50 + i, t, "en", "s1", i) for i, t in enumerate(texts(rng, 80))] + [(200, "b\x1fc \x0bTHE\n", "en", "s", 1)]
    make([r + (5, "m") for r in rows], ", score int, _metadata string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    m = Model([r[1] for r in rows if not held(r[0])], B.ORDER, B.KAPPA)
    got = Q.QUERIES["op12_backoff_score"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got, want = sorted(map(tuple, got.collect()), key=str), sorted([(r[0], held(r[0]), *m.row(r[1])) for r in rows], key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want] and sum(r[1] for r in got) > 5
    key = lambda r: (str(r[:5]), round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_slices_and_shards_change_nothing(spark, make, rng, monkeypatch):
    rows = [(i, t, "en", "s1", i) for i, t in enumerate(texts(rng, 120))]
    docs, train = make(rows).repartition(3), F.col("doc_id") % 3 != 0
    m = Model([r[1] for r in rows if r[0] % 3], 3, 2.0)
    for size, shards in ((64, 1), (700, 9)):
        monkeypatch.setattr(B, "SLICE", size)
        monkeypatch.setattr(B, "MIN_SHARDS", shards)
        for r in B.score_texts(docs, train, ["doc_id", "n_chars"], order=3, kappa=2.0).collect():
            same(tuple(r[2:]), m.row(rows[r.doc_id][1]))


def test_model_beats_order_one_on_held_out_text(spark, make, rng):
    sentences = [prose(rng, 12) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(sentences) for _ in range(8)), "en", "s1", i) for i in range(60)]
    got = B.score_texts(make(rows), F.col("doc_id") < 40, ["doc_id"]).where("doc_id >= 40").collect()
    assert all(r.score > r.base_score + 10 for r in got)


def test_empty_table_and_no_training_text(spark, make):
    assert B.score_texts(make([]), F.lit(True), ["doc_id"]).count() == 0
    got = B.score_texts(make([(1, "a b", "en", "s", 1), (2, None, None, None, None)]), F.lit(None).cast("boolean"), ["doc_id"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_a_long_word_changes_no_other_word(spark, make, tmp_path):
    """Words have one hash whether or not a word of over 1,024 bytes lies in the same part of the texts."""
    big = "q" * 1024 + "x"
    rows = [(0, f"the cat {big}", "en", "s", 1), *[(i, "the cat sat", "en", "s", 1) for i in range(1, 9)], (9, f"sat {'q' * 1500} the", "en", "s", 1)]
    make(rows).repartition(10, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    m = Model([r[1] for r in rows if not held(r[0])], B.ORDER, B.KAPPA)
    got = {r.doc_id: tuple(r[2:]) for r in Q.QUERIES["op12_backoff_score"](spark, str(tmp_path)).collect()}
    for r in rows:
        same(got[r[0]], m.row(r[1]))
    long = "y" * (1 << 20)
    words = B.Words([b"a", f"a {big}".encode(), f"a{long}b{long} b{long}a{long}".encode()])
    assert words.w[0] == words.w[1] and words.w[3] != words.w[4]


def peak(f):
    """(result, MB that numpy and Python held at most)."""
    import tracemalloc

    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_shard_is_added_up_in_bounded_memory(monkeypatch):
    """Ranges of a shard's hashes give what the whole shard gives, for little memory besides the requests and answers."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    pool = np.append(r.integers(0, 1 << 64, 400_000, dtype=np.uint64), [np.uint64(0), np.uint64(2**64 - 1)])
    rows = [(0, b, 0, k, np.sort(r.choice(pool, 100_000, replace=False)), r.integers(0, 5, 100_000).astype("<u4")) for b in range(20) for k in (1, 2)]
    rows.append((0, 99, 0, 1, np.array([B.BEGIN]), np.array([7], "<u4")))
    t = pa.table({c: pa.array(v, kind) for (c, kind), v in zip((("shard", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("k", pa.int32())), zip(*rows))}
                 | {"grams": pa.array([x[4].tobytes() for x in rows], pa.binary()), "counts": pa.array([x[5].tobytes() for x in rows], pa.binary())})
    got, mb = peak(lambda: B._totals(t))
    assert mb < 80  # 159 MB in one go
    total = {k: Counter() for k in (1, 2)}
    for x in rows:
        for h, n in zip(x[4].tolist(), x[5].tolist()):
            total[x[3]][h] += n
    answers = {(a["block"], a["k"]): np.frombuffer(a["counts"], "<u4").tolist() for a in got.to_pylist() if a["block"] is not None}
    assert answers == {(x[1], x[3]): [total[x[3]][h] for h in x[4].tolist()] for x in rows}
    own = {h: n for h, n in total[1].items() if h != int(B.BEGIN)}
    last = got.to_pylist()[-1]
    assert (last["block"], last["tokens"], last["types"]) == (None, sum(own.values()), sum(n > 0 for n in own.values()))
    monkeypatch.setattr(B, "RANGE_GRAMS", 1 << 40)
    assert B._totals(t).equals(got)


def test_a_slice_is_read_in_bounded_memory():
    words = (np.random.default_rng(3).pareto(0.5, (1300, 1000)) % 50_000).astype(int).astype(str)
    texts = [" ".join(x).encode() for x in words]
    g, mb = peak(lambda: B.Grams(texts, 2))
    assert mb * 1e6 < 65 * len(g.into)  # 84 bytes a token before, 45 now
    m = g.counts(2, np.ones(len(texts), bool))
    a, mb = peak(lambda: B.Automaton(g, [None, g.counts(1, np.ones(len(texts), bool)), m], len(g.into), 50_000, 3.0))
    assert mb * 1e6 < 125 * len(m)  # 152 bytes an n-gram before, 102 now
