import math
from collections import Counter

import pytest

from gradus.llm import perplexity as P


def brute(train, order=5):
    """Modified Kneser-Ney by definition: a function of (context bytes, byte)."""
    top = Counter()
    for t in train:
        t = bytes(order - 1) + t.lower()
        for i in range(order - 1, len(t)):
            top[t[i - order + 1:i + 1]] += 1
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {k: P.discounts(*[sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]) for k, c in levels.items()}

    def prob(g):
        if not g:
            return 1 / 256
        k, c = len(g), levels[len(g)]
        after = [v for h, v in c.items() if h[:-1] == g[:-1]]
        if not after:
            return prob(g[1:])
        cut = lambda v: cuts[k][min(v, 3) - 1] if v else 0
        return (max(c[g] - cut(c[g]), 0) + sum(cut(v) for v in after) * prob(g[1:])) / sum(after)

    def logp(text):
        t = bytes(order - 1) + text.lower()
        return sum(math.log(prob(t[i - order + 1:i + 1])) for i in range(order - 1, len(t)))

    return logp, prob


def test_equals_brute_force_with_odd_rows(spark, make, rng, tmp_path, monkeypatch):
    train = ["The cat sat on the mat, the cat ran.", "another cat on a hat", "", "this and that and the other thing"] + ["".join(rng.choice("abcd ") for _ in range(60)) for _ in range(6)]
    rows = [(i, t, "en", "good", 1) for i, t in enumerate(train)] + [(100, "the hat", "en", "web", 1), (100, "the hat", "en", "web", 1), (101, None, None, "good", None), (102, "", "fr", None, 1), (103, "été Ωx", None, "web", 1),
                                                                   (104, "zq" * 400, "en", "web", 1), (None, "the", "fr", "web", 1)]
    logp, prob = brute([t.encode() for t in train])
    assert abs(sum(prob(b"the " + bytes([x])) for x in range(256)) - 1) < 1e-9
    docs = make([r + (1,) for r in rows], ", kept int")
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    for stride in (1 << 19, 13):
        monkeypatch.setattr(P, "STRIDE", stride)
        for d in (docs, spark.read.parquet(str(tmp_path / "d"))):  # any table, and a scan
            out = P.judge(d, ("good",))
            assert out.columns == ["doc_id", "lang", "perplexity", "threshold", "kept"]
            got = sorted(out.collect(), key=str)
            assert len(got) == len(rows)
            for k, t, lang, _, _ in rows:
                r = next(x for x in got if x.doc_id == k and x.lang == lang)
                if t:
                    assert r.perplexity == pytest.approx(math.exp(-logp(t.encode()) / len(t.encode())), rel=1e-5)
                    assert r.kept == (r.perplexity <= r.threshold)
                else:
                    assert r.perplexity is None and not r.kept
        assert not any(r.kept for r in got if r.doc_id == 104) and len({(r.perplexity, r.kept) for r in got if r.doc_id == 100}) == 1


def test_nothing_to_train_on(make):
    got = P.judge(make([(1, "abc", "en", "s", 1), (2, "x", None, "s", 1)]), ("none",)).collect()
    assert [round(r.perplexity, 3) for r in got] == [256, 256] and all(r.kept for r in got)
    assert P.judge(make([]), ("s",)).count() == 0


def test_trusted_ids_train_the_model(spark, make, rng, tmp_path):
    train = [(i, "".join(rng.choice("abcd ") for _ in range(60)), "en", "web", 1) for i in range(8)]
    rows = train + [(9, "zq&&" * 30, "en", "web", 1), (3, "same id, too", "fr", "s", 1), (None, "no id", "en", "web", 1), (11, "abcd", "en", "good", 1)]
    rng.shuffle(rows)
    make(rows).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    ids = spark.createDataFrame([(i,) for i in range(8)] + [(3,), (None,), (77,)], "doc_id int")
    for sources, more in (((), []), (("good",), ["abcd"])):
        logp, _ = brute([r[1].encode() for r in rows if r[0] in range(8)] + [t.encode() for t in more])
        got = P.judge(docs, sources, trusted_ids=ids).collect()
        want = sorted(math.exp(-logp(r[1].encode()) / len(r[1].encode())) for r in rows)
        assert sorted(r.perplexity for r in got) == pytest.approx(want, rel=1e-5)
    with pytest.warns(UserWarning, match="no trusted text"):
        assert all(r.kept for r in P.judge(docs, (), trusted_ids=ids.where("doc_id > 50")).collect())


def test_query_trains_on_good_labels_only(spark, make, rng, tmp_path):
    from gradus.llm.queries import QUERIES

    good = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(30)), "en", "src2", 1) for i in range(60)]
    junk = [(100 + i, "".join(rng.choice("&*%#@|<>{}") for _ in range(120)), "en", "src1", 1) for i in range(6)]
    make(good + junk).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(3)] + [(103, 1, 0), (103, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op4_perplexity"](spark, str(tmp_path)).collect()
    assert len(got) == 66 and all(r.kept == (r.doc_id < 100) for r in got)
