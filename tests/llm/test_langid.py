import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from gradus.llm import langid


def brute_bits(train: list[bytes], text: bytes) -> float:
    counts = defaultdict(Counter)
    for t in train:
        t = bytes(4) + t.lower()
        for i in range(4, len(t)):
            for k in range(5):
                counts[t[i - k:i], k][t[i]] += 1
    t, bits = bytes(4) + text.lower(), 0.0
    for i in range(4, len(t)):
        for k in range(4, -1, -1):
            c = counts.get((t[i - k:i], k))
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if t[i] in c:
                bits -= math.log2(c[t[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def small(spark, make):
    en = ["the cat and the dog", "this is the house of the man", "and then the other one"]
    fr = ["le chat et la souris", "c'est la maison de l'été", "et puis une autre élève"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(en)] + [(10 + i, t, "fr", "s", 1) for i, t in enumerate(fr)]
    return en, fr, langid.fit(make(rows))


def test_code_lengths_equal_brute_force(spark, make, monkeypatch):
    en, fr, trees = small(spark, make)
    assert trees.langs == ["en", "fr"]
    texts = [x.encode() for x in ("The dog is there", "été", "", "z", "une maison\x00ÿ", "the the the " * 30)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    want = np.array([[brute_bits([x.encode() for x in own], t) for own in (en, fr)] for t in texts])
    assert np.allclose(trees.code_lengths(data, ends), want)
    monkeypatch.setattr(langid, "STRIDE", 7)
    assert np.allclose(trees.code_lengths(data, ends), want)


def test_odd_rows(spark, make, odd_rows):
    _, _, trees = small(spark, make)
    rows = [r + (5,) for r in odd_rows]
    out = langid.predict(make(rows, ", score int"), trees)
    assert "n_chars" in out.columns and dict(out.dtypes)["score"] == "double"
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)), r.text
    assert langid.predict(make([]), trees).count() == 0
    nothing = langid.fit(make([(1, None, "en", "s", 1), (2, "", "fr", "s", 1), (3, "abc", None, "s", 1)]))
    assert nothing.langs == [] and {r.lang_pred for r in langid.predict(make(odd_rows), nothing).collect()} == {"und"}


def test_sample_is_bounded(spark, make):
    rows = [(i, f"text number {i}", "en", "s", 1) for i in range(300)] + [(1000 + i, "texte numéro", "fr", "s", 1) for i in range(3)]
    got = langid.training_sample(make(rows), "doc_id", "text", "lang", rows=40, size=1 << 20).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 20, "fr": 3}
    got = langid.training_sample(make(rows), "doc_id", "text", "lang", rows=1000, size=8).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 1, "fr": 1}


def test_held_out_accuracy(spark):
    from gradus.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    p = QUERIES["op2_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    p = p.where("held_out and lang is not null")
    assert p.where(F.col("lang") == F.col("lang_pred")).count() >= 0.97 * p.count() > 20


def test_columns_with_dots_and_helper_names(make):
    docs = make([(1, "hello there", "en", "s1", 1, 5, "x"), (2, "bonjour", "fr", "s1", 1, 6, "y")], ", `a.b` int, lettered string")
    out = langid.predict(docs, langid.fit(docs))
    assert out.columns == docs.columns + ["lang_pred", "score", "bits_per_byte"]
    assert sorted((r.doc_id, r["a.b"], r.lettered, r.lang_pred) for r in out.collect()) == [(1, 5, "x", "en"), (2, 6, "y", "fr")]
