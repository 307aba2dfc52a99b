import random

import numpy as np
import pytest

from gradus.llm import ngram_join as J
from tests.llm.conftest import prose


def shingles(t, width):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            m = len(sets[i] & sets[j])
            if m and den * m >= num * (len(sets[i]) + len(sets[j]) - m):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(k, least[r])
    return sorted(((k, len(s), least[root(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(rng, n=120):
    """Copies, chains of near copies, shared passages, short texts."""
    passage = prose(rng, 40)
    rows = []
    for i in range(n // 6):
        base = prose(rng, rng.choice([4, 9, 30, 60])).split()
        if i % 3 == 0:
            base += passage.split()
        for j in range(6):
            rows.append((len(rows), " ".join(base)))
            if j % 2:
                base[rng.randrange(len(base))] = "x" + str(rng.randrange(1000))
            if j == 3:
                base = base[1:] or base
    return rows


ODD = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "ONE\ttwo x"), (1007, "one two"), (1008, "À b c d e f"), (1009, "à b c d e f")]


@pytest.mark.parametrize("hot,width,num,den", [(64, 3, 90, 100), (1, 3, 90, 100), (2, 5, 8, 10)])
def test_equals_brute_force(spark, rng, monkeypatch, hot, width, num, den):
    monkeypatch.setattr(J, "HOT", hot)
    rows = corpus(rng) + ODD + [(None, "one two"), (None, prose(rng, 50)), (5, "one two"), (2000, prose(rng, 20_000))]
    rows += [(2001, rows[-1][1] + " more")]
    docs = spark.createDataFrame([(*r, "z", b"z") for r in rows], "doc_id long, text string, n_shingles string, cid binary")
    out = J.near_classes(docs, width, num, den)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, width, num, den)


def test_large_near_copy_group(spark, rng, monkeypatch):
    """Buckets whose members don't all resemble the smallest: a chain that drifts away from it."""
    monkeypatch.setattr(J, "HOT", 2)
    base, rows = prose(rng, 100).split(), []
    for i in range(80):
        rows.append((i, " ".join(base)))
        base[rng.randrange(100)] = f"n{i}"
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.near_classes(docs).collect()), key=str) == brute(rows, 5, 8, 10)


def test_slices_never_part_similar_sets():
    rng = random.Random(5)
    for num, den in ((9, 10), (8, 10)):
        for _ in range(300):
            n = rng.randint(1, 80)
            a = {rng.getrandbits(64) for _ in range(n)}
            b = set(a)
            for _ in range(rng.randint(0, n // 4)):
                b.discard(next(iter(b)))
            b |= {rng.getrandbits(64) for _ in range(rng.randint(0, n // 8))}
            if b and len(a & b) * den >= len(a | b) * num:
                x, y = (set(J.slice_keys(np.array(sorted(s), np.uint64), num, den)) for s in (a, b))
                assert x & y


def test_one_of_each(spark, rng, make, odd_rows):
    rows = odd_rows + [(50 + k, t, "en", "s", 1) for k, t in corpus(rng, 30)] + [(4, "other words of the same id altogether", "en", "s", 1)]
    docs = make([r + (1,) for r in rows], ", cid int")
    out = J.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    texts = [r[1] for r in rows]
    assert sum(t is None or not t.split() for _, t in got) == sum(t is None or not t.split() for t in texts)
    full = [x for x in got if x[1] and x[1].split()]
    sets = [shingles(t, 5) for _, t in full]
    for i in range(len(full)):  # no two that stay are similar
        for j in range(i):
            assert 10 * len(sets[i] & sets[j]) < 8 * len(sets[i] | sets[j])
    assert len(full) == len(components_of(rows))
    assert J.one_of_each(make([])).count() == 0


def components_of(rows):
    """The components of the rows with words."""
    named = [(i, r[1]) for i, r in enumerate(rows) if r[1] and r[1].split()]
    return {c for _, _, c in brute(named, 5, 8, 10)}


def test_empty(spark, make):
    assert J.near_classes(make([])).count() == 0
    assert [tuple(r) for r in J.near_classes(make([(1, None, "en", "s", 1)])).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("num, den", [(90, 100), (8, 10)])
def test_similar_sets_share_a_slice(num, den):
    """Sets at the threshold, of every size, share a key; few keys are of empty slices."""
    r = np.random.default_rng(5)
    for n in [*range(1, 40), 75, 200, 777, 3000]:
        for _ in range(6):
            x = r.integers(0, 1 << 58, n, dtype=np.uint64)
            lost = r.integers(0, n + 1)
            while True:  # as different as the threshold allows
                new = r.integers(0, n + 1)
                both, union = n - lost, n + new
                if both * den >= union * num or lost == 0:
                    break
                lost -= 1
            y = np.concatenate([x[lost:], r.integers(0, 1 << 58, new if both * den >= (n + new) * num else 0, dtype=np.uint64)])
            if len(y):
                assert set(J.slice_keys(x, num, den).tolist()) & set(J.slice_keys(np.sort(y), num, den).tolist())


def test_no_text_is_moved(spark, make, rng, odd_rows, tmp_path):
    """Rows that stay are found by their places: the result scans the documents without a join or shuffle. Tables
    whose rows have no places, or share them, give the same rows."""
    rows = odd_rows + [(50 + k, t, "en", "s", 1) for k, t in corpus(rng, 24)]
    make(rows).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = J.one_of_each(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    want = sorted(map(str, out.collect()))
    again = docs.join(spark.range(2), how="cross").drop("id")
    assert J.placed(docs) is docs and J.placed(again) is not again
    empty = [str(r) for r in docs.collect() if not (r.text or "").split()]
    assert sorted(map(str, J.one_of_each(again).collect())) == sorted(want + empty)


def test_sets_move_once_for_their_neighbourhood(spark, monkeypatch, tmp_path):
    """Pairs of a clique, a star and single ones in cells and buckets of every size; a set goes to few buckets."""
    r = np.random.default_rng(5)
    sets = []
    for i in range(60):
        base = r.integers(0, 1 << 58, 50) if i % 20 == 0 else sets[i // 20 * 20]
        sets.append(np.unique(np.concatenate([base[i % 20:], r.integers(0, 1 << 58, i % 4)])))
    name = [f"{i:016d}".encode() for i in range(60)]
    pairs = [(i, j) for i in range(20) for j in range(i + 1, 20)] + [(20, j) for j in range(21, 40)] + [(40 + i, 41 + i) for i in range(0, 20, 2)]
    table = spark.createDataFrame([(c, s.tolist()) for c, s in zip(name, sets)], "cid binary, members array<long>")
    table.repartition(3).write.parquet(str(tmp_path / "sets"))
    table = spark.read.parquet(str(tmp_path / "sets"))
    want = [(name[i], name[j]) for i, j in pairs if 10 * len(x := np.intersect1d(sets[i], sets[j])) >= 8 * (len(sets[i]) + len(sets[j]) - len(x))]
    assert 5 < len(want) < len(pairs)
    moved = []
    real = J.listed
    monkeypatch.setattr(J, "listed", lambda rows: (moved.append(rows.count()), real(rows))[1])
    for most in (250_000, 400, 60):
        monkeypatch.setattr(J, "PLACE_MEMBERS", most)
        got = J.verified(spark.createDataFrame([(name[i], name[j]) for i, j in pairs], "a binary, b binary"), table, 8, 10)
        assert sorted((bytes(x.a), bytes(x.b)) for x in got.collect()) == sorted(want)
    assert moved[0] == 60  # 2 * 219 sets of pairs before
    assert J.verified(spark.createDataFrame([], "a binary, b binary"), table, 8, 10).count() == 0


def test_parities_are_a_bound():
    """Sets of every pair of sizes differ in as many members as their parities do in bits, and unlike ones in many."""
    r = np.random.default_rng(8)
    for n in (1, 15, 16, 17, 900, 5000):
        for share in (0.0, 0.1, 0.25, 1.0):
            x = np.unique(r.integers(0, 1 << 58, n))
            y = np.unique(np.concatenate([x[int(share * n):], r.integers(0, 1 << 58, int(share * n) // 2)]))
            both, apart = len(np.union1d(x, y)) - len(np.intersect1d(x, y)), J.parities_apart(J.parity(x), J.parity(y))
            assert apart <= both and J.parities_apart(J.parity(y), J.parity(x)) == apart
            assert n < 900 or apart >= both / 2  # the 1,024 bits of a sketch show 550 of 7,500 at most


def test_only_sets_of_similar_pairs_move_whole(spark, monkeypatch, tmp_path):
    """Long sets that share half of their members: their sketches allow the pair, their parities don't."""
    r = np.random.default_rng(6)
    half = r.integers(0, 1 << 58, 3000)
    sets = [np.unique(np.concatenate([half, r.integers(0, 1 << 58, 3000)])) for _ in range(12)]
    sets.append(sets[0][100:])
    name = [f"{i:016d}".encode() for i in range(13)]
    spark.createDataFrame([(c, s.tolist()) for c, s in zip(name, sets)], "cid binary, members array<long>").write.parquet(str(tmp_path / "sets"))
    table = spark.read.parquet(str(tmp_path / "sets"))
    pairs = [(name[i], name[j]) for i in range(13) for j in range(i + 1, 13)]
    moved = []
    real = J.listed
    monkeypatch.setattr(J, "listed", lambda rows: (moved.append(rows.count()), real(rows))[1])
    got = J.verified(spark.createDataFrame(pairs, "a binary, b binary"), table, 8, 10)
    assert [(bytes(x.a), bytes(x.b)) for x in got.collect()] == [(name[0], name[12])]
    assert moved == [13, 2]  # whole sets: 13 before


def test_scratch_tables_go_with_the_join(spark, make, rng):
    """Of the join's tables only what the result reads is left, and no shuffle files."""
    import os

    from gradus.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    out = J.one_of_each(make([(k, t, "en", "s", 1) for k, t in corpus(rng, 24)]))
    left = {x.split("-", 1)[1].rsplit("-", 1)[0] for x in set(os.listdir(base)) - before if x.startswith("gradus-")}
    assert left <= {"join-docs", "join-lists", "join-listed"} and out.count()
