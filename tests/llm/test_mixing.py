import math

import pytest
from pyspark.sql import functions as F

from gradus.llm import mixing


def test_counts_are_the_inverse_distribution(spark, make):
    rows = [(i, "x" * (i % 50), "en", f"s{i % 3}", 1) for i in range(3000)]
    docs = make(rows)
    rate = {r.source: r.rate for r in mixing.source_rates(docs, {"s0": 1.0, "s1": 3.0}, epochs=2.0).collect()}
    assert rate["s2"] == 0
    n = {r.doc_id: r.n_copies for r in mixing.poisson_mix(docs, {"s0": 1.0, "s1": 3.0}, epochs=2.0).select("doc_id", "n_copies").distinct().collect()}
    u = {r.i: r.u for r in spark.range(3000).select(F.col("id").alias("i"), mixing.uniform(F.lit("17"), F.col("id").cast("string"), F.lit("1")).alias("u")).collect()}
    for i, _, _, s, _ in rows:
        k, p, c = 0, math.exp(-rate[s]), math.exp(-rate[s])
        while c <= u[i]:
            k, p = k + 1, p * rate[s] / (k + 1)
            c += p
        assert n.get(i, 0) == k
    size = {s: sum(len(r[1]) + 1 for r in rows if r[3] == s) for s in ("s0", "s1", "s2")}
    got = {s: sum(n.get(r[0], 0) * (len(r[1]) + 1) for r in rows if r[3] == s) for s in size}
    total = 2 * sum(size.values())
    assert abs(got["s0"] / total - 0.25) < 0.02 and abs(got["s1"] / total - 0.75) < 0.04


def test_large_means(make):
    docs = make([(i, "a", "en", "big" if i else "small", 1) for i in range(1001)])
    got = mixing.poisson_mix(docs, {"small": 1.0}, epochs=1.0)
    k = got.count()
    assert got.select("source").distinct().collect()[0][0] == "small" and abs(k - 1001) < 6 * math.sqrt(1001)


def test_copies_order_and_columns(spark, make, odd_rows):
    docs = make([r + ("x",) for r in odd_rows], ", copy string")
    out = mixing.poisson_mix(docs, epochs=3.0)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_copies", "copy", "mix_key"]
    rows = out.collect()
    assert rows == mixing.poisson_mix(docs.repartition(5), epochs=3.0).sort("mix_key", "lang").collect() or \
        sorted(map(str, rows)) == sorted(map(str, mixing.poisson_mix(docs.repartition(5), epochs=3.0).collect()))
    for r in rows:
        assert 1 <= r["copy"] <= r.n_copies
    plain = mixing.poisson_mix(docs, epochs=3.0, added=False)
    assert plain.columns == docs.columns and plain.count() == len(rows)
    assert mixing.poisson_mix(make([])).count() == 0
    per = {}
    for r in rows:
        per.setdefault(r.doc_id, set()).add(r.n_copies)
    assert len(per.get(1, {0})) == 1


@pytest.mark.parametrize("added", [True, False])
def test_input_columns_of_helper_names_stay(make, added):
    extra = ["_mix_source", "_mix_draws", "_mix_cdf", "_mix_copy", "_mix_n", "_mix_key", "_MIX_x", "a.b"]
    docs = make([(i, f"text {i}", "en", "s1", 1, *range(8)) for i in range(20)], "".join(f", `{c}` int" for c in extra))
    out = mixing.poisson_mix(docs, epochs=2.0, added=added)
    assert out.columns == docs.columns + (["n_copies", "copy", "mix_key"] if added else [])
    rows = out.collect()
    assert rows and all(tuple(r)[5:13] == tuple(range(8)) for r in rows)
    plain = mixing.poisson_mix(docs.select(*docs.columns[:5]), epochs=2.0)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect())
