import zlib

import numpy as np
import pytest

from gradus.llm import tokens
from gradus.llm.common import scratch_path

P = pytest.importorskip("public_tokenizers")
FILE = P.path("word_bpe_49k.json")
HARD = ["<|endoftext|>a,B <|ENDOFTEXT|> don't 'S \"'s x'll. é, É! … foo…. á,  x y \x1c z\x85q Σας ΣΑΣ. İI ﬁ İ. 1,2.3 a.b.c -- '' --'t ,'s", "", "  ", ".", "A.", "a_B_c_", "ß.", "𝔘x.", "日本。語.",
        "ab'.", "ab.'s.", "q'S.", "ÀÉÎÕÜ Ÿ ŉa ǰb ĲĿŒ ſs ÅÅ é ǆ Ǆ", "straße. ÑANDÚ, ß", "a\x00b c\x0bd"]


def whole(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_give_the_whole_texts_ids(monkeypatch):
    enc = tokens.WordEncoder(open(FILE).read())
    for t in HARD * 2:
        assert [*np.frombuffer(enc.encode(t.encode()), enc.kind), 1] == whole(t)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    for t in HARD:
        assert b"".join(enc.encode(s) for s in tokens.text_segments(t.encode(), 8)) == np.array(whole(t)[:-1], enc.kind).tobytes()


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 1000):
        keys = tokens.mix64(np.arange(n, dtype=np.uint64))
        levels, ranks = tokens.mph_build(keys)
        assert sorted(ranks) == list(range(n))
        assert (tokens.Mph(levels).index(keys) == ranks).all()
        assert sum(map(len, levels)) * 8 < 6 * n + 600


def check(spark, rows, docs):
    folder = scratch_path(spark, "test-tokens")
    m = tokens.write_tokens(docs, folder, FILE, 1).orderBy("shard").collect()
    got = tokens.read_tokens(tokens.row_keys(docs), folder, "<u2").collect()
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(whole(r[1]))
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    for key, want in ids.items():
        have = sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == key)
        assert have == sorted((len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want)
    assert sum(r.n_ids for r in m) == at
    return folder, m


def test_round_trip_with_odd_rows(spark, make, odd_rows, monkeypatch):
    rows = odd_rows + [(100 + i, t, "en", "s", 1) for i, t in enumerate(HARD)] + [(-5, "minus", "en", "s", 1), (2**62, "far", "en", "s", 1)]
    docs = make([r + ("x",) for r in rows], ", n_tokens string")
    folder, _ = check(spark, rows, docs)
    strangers = spark.createDataFrame([(i, 0) for i in range(10_000, 12_000)] + [(1, 2), (None, 9)], "doc_id long, k int")
    assert tokens.locate(strangers, folder).count() == 0
    check(spark, [], make([]))


def test_shards_roll_and_indexes_split(spark, make, rng, monkeypatch):
    rows = [(i, f"word{i} " * 20, "en", "s", 1) for i in range(400)]
    monkeypatch.setattr(tokens, "SHARD_IDS", 500)
    monkeypatch.setattr(tokens, "PART_KEYS", 60)
    _, m = check(spark, rows, make(rows))
    assert len(m) > 20


def test_equal_hashes_are_told_apart(spark, make, monkeypatch):
    monkeypatch.setattr(tokens, "mix64", lambda x: x.astype(np.uint64) & np.uint64(7))
    keys = tokens.key64(np.arange(3), np.zeros(3, bool), np.zeros(3, np.int64))
    assert keys.tolist() == [0, 1, 2]


def test_white_space_is_kept_where_the_tokenizer_encodes_it(spark, make):
    from tokenizers import Tokenizer

    file = P.path("byte_bpe_50k.json")
    enc, by_space = tokens.WordEncoder(open(file).read()), tokens.WordEncoder(open(FILE).read())
    assert by_space.splits and not enc.splits
    own = Tokenizer.from_file(file)
    texts = HARD + ["a b", "a\tb", "a\n\nb  c ", "def f(x):\n    return x\n", "word " * 2_000_000]
    want = {i: own.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    for i, t in enumerate(texts[:-1]):
        assert np.frombuffer(enc.encode(t.encode()), enc.kind).tolist() == want[i]
    folder = scratch_path(spark, "test-tokens-space")
    docs = make([(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    tokens.write_tokens(docs, folder, file, 1)
    for r in tokens.read_tokens(tokens.row_keys(docs), folder, tokens.id_type(file)).collect():
        ids = np.array([*want[r.doc_id], 1], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
