import hashlib
import re

from gradus.llm import decontam
from tests.llm.conftest import prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=13):
    grams = {}
    for item, t in items:
        w = words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[i:i + k]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i:i + k])) in grams:
                    hit.update(range(i, i + k))
                    found |= {str(x) for x in grams[g] if x is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases(rng):
    items = [(i, prose(rng, rng.choice([3, 12, 13, 14, 40]))) for i in range(12)] + [(100, "One"), (101, "it's É2!"), (102, None), (103, ""), (104, " ... "), (None, "no id here"), (105, "one")]
    items += [(200, items[4][1]), (9, items[5][1])]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 30)) for _ in range(3)]
        for j in range(rng.randint(0, 2)):
            w = (items[rng.randrange(12)][1]).split()
            a = rng.randint(0, max(0, len(w) - 5))
            parts.insert(1, " ".join(w[a:a + rng.choice([5, 13, 20, 50])]).upper())
        docs.append((i, "-".join(parts)))
    docs += [(70, "ONE two"), (71, "it s É2"), (72, None), (73, ""), (74, "no id here"), (75, prose(rng, 30_000) + " " + items[3][1]), (None, items[7][1]), (0, docs[0][1])]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    out = decontam.digest(decontam.matches(d, b))
    rows = out.collect()
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in rows)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str)


def test_equals_brute_force(spark, rng, monkeypatch):
    docs, items = cases(rng)
    assert run(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)  # several blocks
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark, rng):
    docs, items = cases(rng)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_long_texts_in_segments(rng, monkeypatch):
    t = prose(rng, 500).encode()
    vocab = {w: i + 1 for i, w in enumerate(set(t.split()))}
    whole = decontam.number(t, vocab).tolist()
    monkeypatch.setattr(decontam, "SEGMENT", 50)
    assert decontam.number(t, vocab).tolist() == whole == [vocab[w] for w in t.split()]
