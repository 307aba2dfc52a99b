"""Clustering, split and audit invariants; components against a brute-force union-find."""

import pytest
from pyspark.sql import functions as F

from gradus.operators import cluster as C
from gradus.operators import setops as U
from gradus.operators import split as SP


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_components_long_chain(spark):
    nodes = list(range(60))
    edges = [(i + 1, i) for i in range(0, 29)] + [(40, 59), (59, 45), (50, 45)]
    items = spark.createDataFrame([(n,) for n in nodes], "id long")
    e = spark.createDataFrame(edges, "id long, rep long")
    got = {r.member: r.representative for r in C.cluster_components(items, e).collect()}
    ref = union_find(nodes, edges)
    assert got == {n: min(m for m in nodes if ref[m] == ref[n]) for n in nodes}


def test_shingle_pipeline_finds_copies(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100 ", "x100 ")
    docs = spark.createDataFrame([(1, base), (2, near), (3, "entirely different words here and there"),
                                  (4, base), (5, "")], "doc_id long, text string")
    sh = C.shingle_sets(docs, "doc_id", "text")
    v = C.identity_coverage_filter(C.shingle_candidates(sh), sh)
    assert {r.id: len(r.hs) for r in sh.collect()}[1] == 196
    cl = {r.member: r.representative for r in C.cluster_components(docs.select(F.col("doc_id").alias("id")),
                                                                    v.select("id", "rep")).collect()}
    assert cl[1] == cl[2] == cl[4] == 1 and cl[3] == 3 and cl[5] == 5


def test_short_text_is_one_shingle(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "  a   b  ")], "doc_id long, text string")
    hs = {r.id: r.h for r in C.word_shingles(docs, "doc_id", "text").collect()}
    assert hs[1] == hs[2]
    rep = spark.createDataFrame([(1, "a b c d e a b c d e")], "doc_id long, text string")
    assert len(C.shingle_sets(rep, "doc_id", "text").first().hs) == 5  # repeated shingles count once


def test_max_containment(spark):
    q = spark.createDataFrame([(1, 10), (1, 11), (2, 99)], "id long, h long")
    corpus = spark.createDataFrame([(7, 10), (7, 11), (8, 10)], "id long, h long")
    got = {r.id: (r.max_shared, r.max_containment, r.n_hits) for r in C.max_containment(q, corpus).collect()}
    assert got[1] == (2, 1.0, 2) and got[2] == (0, 0.0, 0)


@pytest.fixture(scope="module")
def assign(spark):
    rows = [(1, "stability", "P1"), (2, "stability", "P2"), (3, "binding", "P1"), (4, "binding", "P3"),
            (5, "expression", "P9"), (6, "stability", "P3"), (7, "activity", "P4"), (8, "activity", "P5"),
            (9, "activity", "P6"), (10, "activity", "P7"), (11, "activity", "P8")]
    return spark.createDataFrame(rows, "dms_id int, category string, protein string")


def test_split_modes_and_audit(spark, assign):
    empty = spark.createDataFrame([], "representative string, member string")
    x = SP.attach_cluster(assign, empty, "protein")
    per = SP.stratified_group_split(x, 0.2, 42, "per_category")
    glob = SP.stratified_group_split(x, 0.2, 42, "global")
    for s in (per, glob):
        rows = s.collect()
        assert len(rows) == 11 and all(r.split in ("train", "test") for r in rows)
        # one-cluster category goes wholly to test; every category has >= 1 test cluster
        assert [r.split for r in rows if r.category == "expression"] == ["test"]
    a = SP.leakage_audit(glob, "dms_id", "protein", "cluster").first()
    assert a.n_cluster_overlap == 0 and a.valid
    p = SP.leakage_audit(per, "dms_id", "protein", "cluster").first()
    assert p.train_assays + p.test_assays == 11 and p.n_id_overlap == 0
    # exact count per category: max(1, int(n * 0.2)) clusters in test
    act = [r for r in per.collect() if r.category == "activity"]
    assert sum(r.split == "test" for r in act) == 1


def test_split_is_partition_count_independent(spark, assign):
    empty = spark.createDataFrame([], "representative string, member string")
    x = SP.attach_cluster(assign, empty, "protein")
    a = {(r.dms_id, r.split) for r in SP.stratified_group_split(x.repartition(7), 0.3).collect()}
    b = {(r.dms_id, r.split) for r in SP.stratified_group_split(x.coalesce(1), 0.3).collect()}
    assert a == b


def test_attach_cluster_self_when_absent(spark):
    items = spark.createDataFrame([(1, "P1"), (2, "P2")], "dms_id int, protein string")
    cl = spark.createDataFrame([("P9", "P1")], "representative string, member string")
    got = {r.dms_id: r.cluster for r in SP.attach_cluster(items, cl, "protein").collect()}
    assert got == {1: "P9", 2: "P2"}


def test_distinct_first_drops_empty_first_row(spark):
    df = spark.createDataFrame([("P1", 2, "seqB"), ("P1", 1, ""), ("P2", 5, "x")], "p string, o int, s string")
    got = {r.p: r.s for r in U.distinct_first(df, "p", ["o"], value="s").collect()}
    assert got == {"P2": "x"}


def test_manifest_check(spark):
    e = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    f = spark.createDataFrame([(2,), (4,)], "id int")
    r = U.manifest_check(e, f, "id").first()
    assert (r.expected_count, r.found_count, r.n_missing, r.all_found, r.n_unexpected) == (3, 1, 2, False, 1)
    assert sorted(x.id for x in U.set_missing(e, f).collect()) == [1, 3]


@pytest.mark.parametrize("mode", ["both", "query", "target"])
def test_no_qualifying_pair_is_missed(spark, mode):
    """Against all pairs, on random overlapping sets and their copies."""
    import random
    rng = random.Random(11)
    sets = {}
    for i in range(60):
        if i % 3 and i > 3:
            base = set(sets[rng.randrange(i)])
            for _ in range(rng.randint(0, 4)):
                base.discard(rng.choice(sorted(base))) if base and rng.random() < 0.5 else base.add(rng.randrange(500))
            sets[i] = base or {1}
        else:
            sets[i] = {rng.randrange(500) for _ in range(rng.randint(1, 30))}
    df = spark.createDataFrame([(i, sorted(v)) for i, v in sets.items()] + [(999, [])], "id long, hs array<long>")
    got = {(r.id, r.rep) for r in C.identity_coverage_filter(C.shingle_candidates(df, mode=mode), df, mode=mode).collect()}
    least = {}
    for i, v in sets.items():
        least.setdefault(frozenset(v), i)
    want = {(i, least[frozenset(v)]) for i, v in sets.items() if least[frozenset(v)] != i}
    for i in least.values():
        for j in least.values():
            m, a, b = len(sets[i] & sets[j]), len(sets[i]), len(sets[j])
            cov = {"both": m / max(a, b), "query": m / a, "target": m / b}[mode]
            if (i > j if mode == "both" else i != j) and m / min(a, b) >= 0.3 and cov >= 0.8:
                want.add((i, j))
    assert got == want and len(want) > 20
    every = {tuple(r) for r in C.shingle_candidates(df, mode=mode).collect()}
    fewer = C.shingle_candidates(df, mode=mode, positional=True)
    assert {tuple(r) for r in C.identity_coverage_filter(fewer, df, mode=mode).select("id", "rep").collect()} == want
    assert {tuple(r) for r in fewer.collect()} < every


def test_containment_with_a_hot_shingle(spark):
    """A shingle of every second corpus item, items that repeat shingles, queries that share none:
    equal to counting all pairs, without a row for each of them."""
    import random
    rng = random.Random(3)
    queries = {i: {rng.randrange(60) for _ in range(rng.randint(1, 12))} | ({0} if i % 3 else set()) for i in range(30)}
    queries[99] = {1000}
    corpus = {i: [rng.randrange(50, 400) for _ in range(rng.randint(0, 6))] + ([0, 0] if i % 2 else []) for i in range(2000)}
    q = spark.createDataFrame([(i, h) for i, v in queries.items() for h in v], "id long, h long")
    c = spark.createDataFrame([(i, h) for i, v in corpus.items() for h in v], "id long, h long")
    got = {r.id: (r.n_shingles, r.max_shared, r.n_hits) for r in C.max_containment(q, c).collect()}
    want = {}
    for i, v in queries.items():
        both = [len(v & set(x)) for x in corpus.values()]
        want[i] = (len(v), max(both), sum(n > 0 for n in both))
    assert got == want


def test_tables_of_the_rounds_are_computed_once(spark):
    """A checkpoint computes its last stage twice; a written table once."""
    rows = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    assert C.materialize(spark.range(50).mapInArrow(count, "id long")).count() == 50 and rows.value == 50


def test_only_sets_of_different_pairs_that_can_reach_coverage_are_joined(spark, monkeypatch):
    """Equal sets and pairs of too different sizes are settled by digests and sizes; repeated and null ids as before."""
    sets = spark.createDataFrame([(1, [5, 6, 7, 8]), (2, [8, 7, 6, 5]), (3, [5, 6, 7, 8, 9]), (4, [5]), (None, [5, 6, 7, 8]), (6, []), (7, [5, 6, 7, 8]), (7, [1, 2])],
                                 "id long, hs array<long>")
    cand = spark.createDataFrame([(2, 1), (3, 1), (4, 1), (6, 1), (7, 1), (None, 1)], "id long, rep long")
    kept = []
    real = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: kept.append(real(df)) or kept[-1])
    for mode, want in (("both", {(2, 1, 4), (3, 1, 4), (7, 1, 4)}), ("query", {(2, 1, 4), (3, 1, 4), (7, 1, 4), (4, 1, 1)}), ("target", {(2, 1, 4), (3, 1, 4), (7, 1, 4)})):
        kept.clear()
        got = C.identity_coverage_filter(cand, sets, mode=mode).collect()
        assert {(r.id, r.rep, r.shared) for r in got} == want and len(got) == len(want)
        assert kept[0].where("set <> set_rep").count() == (3 if mode == "query" else 1)


def test_repeated_rows_of_a_set_give_an_edge_each(spark):
    a, b = [5, 6, 7, 8], [5, 6, 7, 8, 9]
    sets = spark.createDataFrame([(1, a), (2, b), (2, b), (3, a), (3, a)], "id long, hs array<long>")
    got = C.identity_coverage_filter(spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "id long, rep long"), sets).collect()
    assert sorted((r.id, r.rep) for r in got) == [(2, 1)] * 2 + [(3, 1)] * 2 + [(3, 2)] * 4


def test_shingle_sets_of_odd_texts(spark):
    import hashlib

    texts = {1: None, 2: "", 3: " \t", 4: "a  b", 5: "a\x0bb\tc d\r\ne f", 6: "é a b c d é a b c d"}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.id: r.hs for r in C.named(C.shingle_sets(df, "doc_id", "text")).collect()}

    def h(s):
        return int(hashlib.md5(s.encode()).hexdigest()[:12], 16)

    assert (got[1], got[2], got[3], got[4]) == ([None], [], [], [h("a b")])
    assert got[5] == sorted([h("a b c d e"), h("b c d e f")])
    assert len(got[6]) == 5 and h("é a b c d") in got[6]


def test_named_sets_give_the_same_edges(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, words), (2, words[:57]), (3, words), (4, words[30:]), (5, [f"x{i}" for i in range(9)])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id int, text string")
    for mode in C.MODES:
        got = []
        for sets in (C.shingle_sets(df, "doc_id", "text"), C.materialize(C.named(C.shingle_sets(df, "doc_id", "text")))):
            cand = C.shingle_candidates(sets, mode=mode, positional=True)
            got.append(sorted(map(tuple, C.identity_coverage_filter(cand, sets, mode=mode).collect())))
        assert got[0] == got[1] and {(i, r) for i, r, *_ in got[0]} >= {(3, 1)}


def _odd_sets(spark):
    base = list(range(100, 160))
    rows = [(1, base), (2, base[:57]), (3, base), (None, base), (None, base[:55]), (5, [None]), (6, [None]), (7, base[:50] + [None]), (8, []), (9, None),
            (10, base[:4]), (2, base[:57]), (11, list(range(900, 930))), (11, list(range(900, 928))), (12, list(range(900, 929)))]
    return spark.createDataFrame(rows, "id long, hs array<long>")


@pytest.mark.parametrize("mode", ["both", "query", "target"])
def test_packed_candidates_give_the_edges_of_the_plain_ones(spark, monkeypatch, mode):
    """Shards and deals of a few shingles; null and repeated ids, copies, null members, empty and null sets."""
    monkeypatch.setattr(C, "SHARD_MEMBERS", 40)
    sets = _odd_sets(spark)
    edges = [sorted(map(tuple, C.identity_coverage_filter(C.shingle_candidates(sets, mode=mode, positional=p), sets, mode=mode)
                        .collect())) for p in (False, True)]
    assert edges[0] == edges[1] and len(edges[1]) > 5


def test_packed_candidates_move_no_row_a_shingle(spark):
    """Shingles of texts without a common passage are counted where they are packed: nothing of them goes on."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(400))) for i in range(40)], "doc_id long, text string")
    sets = C.materialize(C.numbered(C.shingle_sets(docs, "doc_id", "text", md5=False)))
    x = sets.select("rid", "hs").mapInArrow(C._to_shards(3), "shard int, part long, low binary, at binary")
    rows = x.collect()
    assert len(rows) <= 3 * 40 and sum(len(r.low) for r in rows) == 4 * 40 * 396
    _, members = C._packed_members(sets, 0.8, False)
    assert members.count() == 0


def test_polynomial_hashes_name_shingles_as_md5_does(spark):
    """The same shingles are equal and different, whatever lies beside a text and however long its words are."""
    long = "a" * 3000
    texts = [None, "", " \t", "a  b", "a\x0bb\tc d\r\ne f", "é a b c d é a b c d", "a b c d e f", f"{long} b c d e", f"{long}a b c d e", f"x {long} b c d e", "A b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    got = []
    for md5 in (True, False):
        sets = {r.id: r.hs for r in C.shingle_sets(df, "doc_id", "text", md5=md5).collect()}
        assert all(x == sorted(set(x)) for i, x in sets.items() if i)
        got.append({(i, j): len(set(sets[i]) & set(sets[j])) for i in sets for j in sets})
    assert got[0] == got[1] and got[0][0, 0] == 1
    alone = C.shingle_sets(df.where("doc_id = 7"), "doc_id", "text", md5=False).first().hs
    assert alone == sets[7]


def test_pairs_of_a_cluster_move_each_set_once(spark, monkeypatch):
    """All pairs of a cluster of near copies are counted in one bucket; cut into blocks they are the same."""
    base = list(range(1000, 1100))
    sets = spark.createDataFrame([(i, base + [i]) for i in range(30)], "id long, hs array<long>")
    cand = C.materialize(C.shingle_candidates(sets, positional=True))
    moved, got = [], []
    real = C._count_shared

    def counted(count):
        def run(pairs, sets):
            count.add(sets.num_rows)
            return real(pairs, sets)

        return run

    for most in (C.PLACE_MEMBERS, 500):
        monkeypatch.setattr(C, "PLACE_MEMBERS", most)
        count = spark.sparkContext.accumulator(0)

        monkeypatch.setattr(C, "_count_shared", counted(count))
        got.append(sorted(map(tuple, C.identity_coverage_filter(cand, sets).collect())))
        moved.append(count.value)
    assert got[0] == got[1] and len(got[0]) == 435 and {r[2] for r in got[0]} == {100}
    assert moved[0] == 30 and moved[1] <= 30 * 14


def test_sets_of_a_scan_stay_where_they_are(spark, monkeypatch, tmp_path):
    """Sets named by the places of their texts give the edges of the written ones; only places, names and counts are written,
    and nothing is joined to a row that carries a set. Null and repeated ids, copies, null and empty texts."""
    import random

    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = [(1, base), (2, base[:70]), (3, base), (None, base), (None, base[:60]), (4, base[:70]), (4, base[:70]), (7, base[40:]), (7, ["x"] * 9)]
    rows += [(10 + i, base[:rng.randrange(20, 80)] + [f"y{i}"] * rng.randrange(9)) for i in range(20)]
    rows = [(i, " ".join(w)) for i, w in rows] + [(8, None), (9, None), (50, ""), (51, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = []
    real = C.materialize
    plain = C.materialize(C.numbered(C.shingle_sets(docs, "doc_id", "text", md5=False)))
    for mode in C.MODES:
        want = sorted(map(tuple, C.identity_coverage_filter(C.shingle_candidates(plain, mode=mode), plain, mode=mode).collect()))
        monkeypatch.setattr(C, "materialize", lambda df: kept.append(df.schema.simpleString()) or real(df))
        sets = C.text_sets(docs, "doc_id", "text")
        out = C.identity_coverage_filter(C.shingle_candidates(sets, mode=mode, positional=True), sets, mode=mode)
        monkeypatch.setattr(C, "materialize", real)
        assert sorted(map(tuple, out.collect())) == want and len(want) > 20
        plan = out._jdf.queryExecution().analyzed().toString()
        assert not [line for line in plan.splitlines() if "Join" in line and "hs#" in line]
    assert not [k for k in kept if "hs:" in k]
