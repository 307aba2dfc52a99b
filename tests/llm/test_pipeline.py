import os
import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from gradus.llm import mixing
from tests.llm.conftest import prose

pytest.importorskip("public_tokenizers")


@pytest.fixture
def folder(spark, tmp_path, rng):
    bench = [(i, prose(rng, 20)) for i in range(3)] + [(3, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), [b[1] for b in bench[:3]]


def test_stages(spark, make, rng, odd_rows, folder):
    from tests.llm.test_ngram_join import components_of
    from tests.llm.test_tokens import whole

    sf, passages = folder
    near = prose(rng, 100).split()
    rows = odd_rows + [(20 + i, prose(rng, 50), "en", "s1", 1) for i in range(10)] + [(40, " ".join(near), "en", "s2", 1), (41, " ".join(near[:99] + ["zz"]), "en", "s2", 1)]
    rows += [(50, prose(rng, 30) + " " + passages[0], "en", "s1", 1), (51, prose(rng, 600) + " " + passages[1], "en", "s2", 1)]
    docs = make([r + ("a", "b") for r in rows], ", score string, `odd.name` string")
    at = dict(C.STAGES)
    assert len(C.STAGES) == 5
    one = at["language_id"](spark, docs, sf)
    assert one.columns == docs.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, docs.where(r"text rlike '\\p{L}'").collect()))
    two = at["ngram_join"](spark, one, sf)
    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert two.columns == docs.columns and two.count() == len(components_of(lettered))
    ids = [r.doc_id for r in two.collect()]
    assert 40 in ids and 41 not in ids and ids.count(1) == 1 and 2 not in ids and None not in ids
    three = at["decontamination"](spark, two, sf)
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == sorted(set(ids) - {50})
    four = at["mixing"](spark, three, sf)
    drawn = {r.doc_id: r.n_copies for r in mixing.poisson_mix(three).collect()}
    assert four.columns == docs.columns and sorted(r.doc_id for r in four.collect()) == sorted(k for k, n in drawn.items() for _ in range(n))
    last = at["token_output"](spark, four, sf).collect()
    texts = {r[0]: r[1] for r in rows}
    want = sorted((r.doc_id, len(w := whole(texts[r.doc_id])), zlib.crc32(np.array(w, "<u4").tobytes())) for r in four.collect())
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in last) == want


def test_empty_and_unlabelled(spark, make, folder):
    sf, _ = folder
    empty = make([])
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, empty, sf).count() == 0
    assert C.STAGES[-1][1](spark, empty, sf).count() == 0
    bare = make([(1, "some words", None, None, None), (2, "12", None, None, None)])
    assert [r.doc_id for r in C.language(spark, bare, sf).collect()] == [1]


def test_run_keeps_what_brute_force_keeps(spark):
    """On a driver table: the rows that reach the output follow from the operators' own results."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no driver tables")
    from tests.llm.test_decontam import brute as hits
    from tests.llm.test_ngram_join import brute as classes

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    keep = {k for k, _, c in classes(docs, 5, 8, 10) if k == c}
    keep -= {r[0] for r in hits([d for d in docs if d[0] in keep], items) if r[5]}
    got = {r.doc_id for r in C.run(spark, sf).collect()}
    assert got <= keep and len(got) >= 0.4 * len(keep)
