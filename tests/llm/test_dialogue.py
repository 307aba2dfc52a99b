"""Conversation repair against a shortest-path search over every edit script, and by definition."""
import hashlib
import heapq
import re
import zlib

import pytest

from gradus.llm import dialogue as D
from gradus.llm import queries as Q

GOOD = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def best_script(rows):
    """(cost, audit, repaired) of the least script over (row number, output) by (cost, audit)."""
    faults = faults_of(rows)
    heap, done = [(0, "", 0, ())], set()
    most = 2 * len(rows) + 4
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        shape = "".join(r[:1] if r[:1] in "sua" and r else "o" for r, _ in out)
        state = (i, shape[-1:], len(shape) == 1)
        if (state, "final") in done:
            continue
        if i == len(rows) and GOOD.match(shape):
            return cost, audit, out
        done.add((state, "final"))
        step = []
        if i < len(rows):
            role, text = rows[i]
            more = 5 * (faults[i] == "truncated")
            step.append((2, "D", 1, ()))
            if faults[i] not in ("blank", "duplicate"):
                step.append((more, "K", 1, ((role, text),)))
                step += [(1 + more, "R", 1, ((x, text),)) for x in ("user", "assistant")]
        step += [(5, "I", 0, ((x, ""),)) for x in ("user", "assistant")]
        for c, op, n, new in step:
            o = out + new
            s = "".join(r[:1] or "o" for r, _ in o)
            if re.match(r"s?(ua)*u?\Z", s) and len(o) <= most:
                heapq.heappush(heap, (cost + c, audit + op, i + n, o))
    raise AssertionError


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(" \t\n\v\f\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def brute(rows, ids):
    out = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        talk = [(r[2], r[3]) for r in own]
        f = faults_of(talk)
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        cost, audit, fixed = best_script(talk)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), bad, cost, audit, sha)
    return out


def values(df):
    return {r.conv_id: tuple(r[1:]) for r in df.collect()}


def talks(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            turn = None if rng.random() < 0.05 else t + 3 * (rng.random() < 0.1)
            rows.append((c if c else None, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                         rng.choice(["Yes.", "No!", "What?", "cut off", " ", "", None, "Ends. \n", f"text {t}.", "é.", " ", "a b\x1f"])))
    return rows


def test_cells_equal_every_split_and_search(rng):
    assert D.EMPTY[0] == {0: (0, ""), 2: (5, "I"), 3: (10, "II")} and D.EMPTY[3] == {3: (0, ""), 2: (5, "I")}
    for _ in range(150):
        kinds = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 7)))
        # classic CYK: every span, every split
        table = {}
        for size in range(1, len(kinds) + 1):
            for i in range(len(kinds) - size + 1):
                if size == 1:
                    table[i, 1] = D.row_cell(kinds[i])
                    continue
                cell = {}
                for k in range(1, size):
                    for p, to in D.combine(table[i, k], table[i + k, size - k]).items():
                        for q, (c, a) in to.items():
                            D.least(cell, p, q, c, a)
                table[i, size] = cell
        whole = table.get((0, len(kinds)), D.EMPTY)
        assert D.parse(kinds) == whole
        text = {"x": " "}
        rows = [({"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[k.lower()], text.get(k, f"row {i}" + ("." if k.islower() else ""))) for i, k in enumerate(kinds)]
        cost, audit, out = best_script(rows)
        assert D.cheapest(whole) == (cost, audit)
        assert D.edited(audit, [r for r, _ in rows], [t for _, t in rows], 0, False)[0] == list(out)


@pytest.mark.parametrize("block, fan", [(512, 64), (2, 2)])
def test_query_equals_brute_force(spark, rng, tmp_path, monkeypatch, block, fan):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "FAN", fan)
    rows = talks(rng, 40)
    rows += rows[5:9]  # repeated rows
    df = spark.createDataFrame([r + (1, "x") for r in rows], SCHEMA + ", cost int, `row.x` string").repartition(5)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    want = brute(damage(rows), {r[0] for r in rows})
    if block == 512:
        got = Q.QUERIES["op11_conversation_repair"](spark, str(tmp_path))
        assert got.columns == D.RESULT
    else:  # blocks of two rows
        talk = Q.damaged(spark.read.parquet(str(tmp_path / "conversations.parquet")))
        blocks = D.blocks_of(talk)
        got = D.repair(talk, ids=df.select("conv_id"))
        assert blocks.where("not whole").count() > 40
    assert values(got) == want
    rows = D.repaired_rows(Q.damaged(df)).collect()
    for conv, w in want.items():
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.turn)
        assert [r.turn for r in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == w[-1]


def test_one_long_conversation(spark, rng):
    """Thousands of rows and of equal rows: blocks, rounds and the streamed hash."""
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", f"text {i}.", f"text {i}", ""])) for i in range(5000)]
    rows += [(7, 3000, "user", "same.")] * 1500 + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hi.")]
    got = values(D.repair(spark.createDataFrame(rows, SCHEMA)))
    own = sorted((r for r in rows if r[0] == 7), key=lambda r: (r[1], r[2], hashlib.md5(r[3].encode()).hexdigest()))
    talk = [(r[2], r[3]) for r in own]
    f = faults_of(talk)
    kinds = "".join("x" if x in ("blank", "duplicate") else r[:1].upper() if x else r[:1] for (r, _), x in zip(talk, f))
    cost, audit = D.cheapest(D.parse(kinds))
    fixed = D.edited(audit, [r for r, _ in talk], [t for _, t in talk], 0, False)[0]
    assert GOOD.match("".join(r[:1] for r, _ in fixed))
    assert got[7][1:4] == (f.count("blank"), f.count("duplicate"), f.count("truncated")) and got[7][5:7] == (cost, audit)
    assert got[7][0] == 3001 - len({r[1] for r in own}) and got[7][-1] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
    assert got[8] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Hi.").hexdigest())


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert D.repair(none).count() == 0 and D.repaired_rows(none).count() == 0
    ids = spark.createDataFrame([(1,), (None,), (1,)], "conv_id long")
    assert values(D.repair(none, ids=ids)) == {k: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in (1, None)}
