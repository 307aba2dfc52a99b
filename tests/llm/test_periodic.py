"""Periodic runs against their definition."""
import hashlib
import zlib

import numpy as np
import pytest

from gradus.llm import periodic as P
from gradus.llm import queries as Q
from tests.llm.conftest import prose


def brute(w):
    """Every stretch, period by period, by definition."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            s, end = i, e + q
            if e > i and end - s >= max(6, 4 * q):
                part = w[s:end]
                if all(any(part[j] != part[j + d] for j in range(len(part) - d)) for d in range(1, q)):
                    out.append((s, end - s, q))
            i = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def changed(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = changed(doc_id, (text or "").encode().split())
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    s, n, q = top[0] if top else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def woven(rng, words):
    """Words with stretches of many periods, some inside one another."""
    out = []
    while len(out) < words:
        unit = [rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.choice([1, 1, 2, 3, 5, 17, 23, 40]))]
        if rng.random() < 0.3:
            unit = unit * 4 + ["z"]
        out += (unit * rng.randint(1, 7))[:rng.randint(1, 200)]
        out += [rng.choice("abcdefgh") for _ in range(rng.choice([0, 0, 1, 4]))]
    return out


def test_runs_equal_definition(rng):
    texts = [woven(rng, rng.choice([0, 3, 7, 60, 400])) for _ in range(60)] + [list("aaaaaa"), list("aaaaa"), list("abababab"), list("abababa"), [], ["A", "a"] * 9, list("aaaaaaabababababaaaaaaa")]
    texts += [["x%d" % i for i in range(k)] * 4 + ["x0"] * r for k in (16, 31, 50) for r in (0, 1, 9)]
    got = P.find_runs([[x.encode() for x in t] for t in texts])
    assert got == [brute(t) for t in texts] and sum(map(len, got)) > 100


def test_splitting_keeps_every_run(rng):
    w = woven(rng, 500)
    ids = np.array([hash(x) % 997 for x in w])
    kept = P.survivors(ids, np.array([len(ids)]))
    assert all(any(a <= s and s + n <= b for a, b in kept) for s, n, _ in brute(ids.tolist()))
    for a, b in kept:
        assert b - a >= 6 and all((ids[a:b] == x).sum() >= 4 for x in set(ids[a:b].tolist()))


def test_query_equals_brute_force(spark, make, rng, odd_rows, tmp_path):
    rows = [r for r in odd_rows if r[0] != 5]
    rows += [(100 + i, " ".join(woven(rng, rng.choice([5, 40, 300]))) + rng.choice(["", " \n", "\x0b\x1f"]), "en", "s1", i) for i in range(60)]
    rows += [(300 + i, prose(rng, 200), "en", "s1", i) for i in range(40)]
    make([r + (9,) for r in rows], ", start int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", *[c for c, _ in P._DIGEST]]
    key = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(r[0], *expected(r[0], r[1])) for r in rows], key=key)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5


def test_collapsed_texts_and_long_text(spark, make, rng):
    long = prose(rng, 150_000) + " one two three" * 60_000 + " end"
    rows = [(1, long, "en", "s", 1), (2, "no no no no no no yes", "en", "s", 1), (3, None, "en", "s", 1), (4, "", None, None, None)]
    got = {r.doc_id: r for r in P.collapse(make(rows), ["doc_id", "lang"]).collect()}
    assert [tuple(r) for r in got[1].runs] == [(150_000, 180_000, 3)] and got[1].collapsed == " ".join(long.split()[:150_003] + ["end"])
    assert got[2].collapsed == "no yes" and got[3].collapsed is None and got[4].collapsed == "" and got[4].runs == []


@pytest.mark.parametrize("change", [None, P.planted])
def test_empty_table(spark, make, change):
    assert P.run_digests(make([]), ["doc_id"], change=change, by="doc_id").count() == 0
