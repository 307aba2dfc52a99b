"""Repair of the role structure of conversations by weighted CYK interval parsing.

The repaired roles must read ``(s?(ua)+)?`` by their initials. The repair grammar is in Chomsky
normal form: a nonterminal ``A[p, q]`` stands for the edits that take the structure from state p to
state q, with the rules ``A[p, q] -> A[p, r] A[r, q]``, one terminal rule for every edit of a row,
and inserted rows, which cost no row of the input and are closed over the empty span. A cell holds
the minimum (cost, audit) of each nonterminal over a span of rows; cells are combined bottom-up by
span length, each span from its two halves: with a nonterminal for every pair of states one split
of a span gives the same minimum as all of them. Audits of one span and one cost are never prefixes
of one another (the other would have further insertions), so the least audit of a whole is made of
least audits of its parts.

Rows are range-sorted by conversation and turn; a task parses the conversations that lie within its
range, in blocks of at most ``BLOCK`` rows and ``BYTES`` of text. Longer conversations, and those
at the ends of a range, are combined from their blocks' cells in Spark rounds of ``FAN`` blocks; the
edits go back to the blocks. So a conversation that holds a third of all rows is parsed by many
tasks; only its SHA-256, which is sequential by definition, is one task's stream of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.common import save, ship_package

BLOCK = 512
BYTES = 4 << 20
FAN = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Structure states: nothing yet, after s, after u, after a. A structure may end in the first and the last.
STATES, ENDS = range(4), (0, 3)
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
WHITE = " \t\n\v\f\r"

Cell = dict[int, dict[int, tuple[int, str]]]


# ---------------------------------------------------------------- grammar and cells
def least(cell: Cell, p: int, q: int, cost: int, audit: str) -> None:
    old = cell.setdefault(p, {}).get(q)
    if old is None or (cost, audit) < old:
        cell[p][q] = (cost, audit)


def combine(left: Cell, right: Cell) -> Cell:
    """A[p, q] -> A[p, r] A[r, q]."""
    out: Cell = {}
    for p, to in left.items():
        best: dict[int, tuple[int, str]] = {}
        for r, (c, a) in to.items():
            for q, (d, b) in right[r].items():
                old = best.get(q)
                if old is None or c + d < old[0] or (c + d == old[0] and a + b < old[1]):
                    best[q] = (c + d, a + b)
        out[p] = best
    return out


def _inserted() -> Cell:
    cell: Cell = {}
    for p in STATES:
        least(cell, p, p, 0, "")
    while True:
        more = {p: dict(to) for p, to in cell.items()}
        for p, to in cell.items():
            for q, (c, a) in to.items():
                for x in "ua":
                    if (x, q) in STEP:
                        least(more, p, STEP[x, q], c + INSERT, a + "I")
        if more == cell:
            return cell
        cell = more


EMPTY = _inserted()


@lru_cache(maxsize=None)
def row_cell(kind: str) -> Cell:
    """The cell of one row. kind: x (must go), or the role's initial s, u, a, or o for any other; in
    upper case where the text is truncated."""
    cell: Cell = {}
    for p in STATES:
        least(cell, p, p, DELETE, "D")
        if kind != "x":
            more = TRUNCATED if kind.isupper() else 0
            if (kind.lower(), p) in STEP:
                least(cell, p, STEP[kind.lower(), p], KEEP + more, "K")
            for x in "ua":
                if (x, p) in STEP:
                    least(cell, p, STEP[x, p], REROLE + more, "R")
    return combine(combine(EMPTY, cell), EMPTY)


@lru_cache(maxsize=1 << 14)
def _short(kinds: str) -> Cell:
    return row_cell(kinds) if len(kinds) == 1 else combine(_short(kinds[:len(kinds) // 2]), _short(kinds[len(kinds) // 2:]))


def merged(cells: list[Cell]) -> Cell:
    """Spans of equal length, two by two, until one is left."""
    while len(cells) > 1:
        pairs = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + (cells[-1:] if len(cells) % 2 else [])
    return cells[0] if cells else EMPTY


def parse(kinds: str) -> Cell:
    return merged([_short(kinds[i:i + 8]) for i in range(0, len(kinds), 8)])


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[0][q] for q in ENDS if q in cell[0])


def edited(audit: str, roles: list[str], texts: list[str], made: int, system: bool) -> tuple[list[tuple[str, str]], bool]:
    """The repaired (role, text) of a block's rows under its part of the audit. ``made``: repaired rows
    before the block; ``system``: whether the first of them is a system row. Also returns the latter behind the block."""
    out, i = [], 0
    for op in audit:
        if op == "D":
            i += 1
            continue
        if op == "K":
            role, text = roles[i], texts[i]
            system = system if made else role[:1] == "s"
        else:
            role, text = ("user", "assistant")[(made - system) % 2], texts[i] if op == "R" else ""
        out.append((role, text))
        i += op != "I"
        made += 1
    return out, system


# ---------------------------------------------------------------- rows in order -> blocks
STATS = ["n", "tmin", "tmax", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last"]


class _Block:
    def __init__(self):
        self.kinds, self.roles, self.texts, self.size = [], [], [], 0
        self.turns, self.blank, self.duplicate, self.truncated = [], 0, 0, 0

    def add(self, turn, role: str, text: str, seen: bool):
        last = text.rstrip(WHITE)[-1:]
        kind = "x"
        if not last:
            self.blank += 1
        elif seen:
            self.duplicate += 1
        else:
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if last not in ".!?":
                kind, self.truncated = kind.upper(), self.truncated + 1
        self.kinds.append(kind)
        self.roles.append(role)
        self.texts.append("" if kind == "x" else text)  # goes anyway
        self.size += len(self.texts[-1])
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def record(self) -> dict:
        initials = [r[:1] for r in self.roles]
        return {"kinds": "".join(self.kinds), "roles": self.roles, "texts": self.texts, "n": len(self.kinds), "tmin": min(self.turns, default=None), "tmax": max(self.turns, default=None),
                "turns": len(self.turns), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1]}


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _blocks(schema: pa.Schema, most: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One record per block, numbered by (part, seq). ``whole``: the block is a conversation of its own."""
        from pyspark import TaskContext

        part, seq, out, held = TaskContext.get().partitionId(), 0, [], 0
        now, block, blocks, first = None, None, 0, True

        def close(whole: bool):
            nonlocal seq, block, blocks, held
            r = block.record()
            r.update(conv_id=now[0], part=part, seq=seq, whole=whole)
            if whole:
                r["cost"], r["audit"] = cheapest(parse(r["kinds"]))
            out.append(r)
            held += block.size + 64 * r["n"]
            seq, blocks, block = seq + 1, blocks + 1, _Block()

        for batch in batches:
            for conv, turn, role, text, copies, seen in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now[0] != conv:
                    if now is not None and block.kinds:
                        close(blocks == 0 and not first)
                    first = now is None
                    now, block, blocks = (conv,), _Block(), 0
                for k in range(copies):
                    if len(block.kinds) >= most or block.size >= size:
                        close(False)
                    block.add(turn, role, text, seen or k > 0)
                if held >= size:
                    yield _emit(out, schema)
                    out, held = [], 0
        if block is not None and block.kinds:
            close(False)
        if out:
            yield _emit(out, schema)

    return run


def ordered_rows(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text, copies, seen), range-sorted: equal rows of a turn are one row with their
    number, counted before they are moved; ``seen``: role and text have occurred in an earlier turn.
    Rows of one turn come by role, then by a hash of the text."""
    r = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
                    F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"))
    r = save(r.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("h", F.md5("text")), "talk-rows")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = r.groupBy("conv_id", "role", "h").agg(F.min(at).alias("start"), F.count("*").alias("k")).where("k > 1")
    again = again.select(F.col("conv_id").alias("c2"), F.col("role").alias("r2"), F.col("h").alias("h2"), "start")
    j = r.join(again, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("role") == F.col("r2")) & (F.col("h") == F.col("h2")), "left")
    seen = F.col("start").isNotNull() & ~F.col("start.turn").eqNullSafe(F.col("turn"))
    j = save(j.select("conv_id", "turn", "role", "text", "copies", seen.alias("seen"), "h"), "talk-marked")
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h"]
    return j.repartitionByRange(*key).sortWithinPartitions(*key).drop("h")


def blocks_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Parsed blocks, see ``_Block.record``; ``idx`` numbers the blocks of a conversation that isn't whole."""
    spark = rows.sparkSession
    ship_package(spark)
    r = ordered_rows(rows, conv_id, turn, role, text)
    turn_type, long_, text_ = r.schema["turn"].dataType, T.LongType(), T.StringType()
    fields = [("conv_id", r.schema["conv_id"].dataType), ("part", long_), ("seq", long_), ("whole", T.BooleanType()), ("cost", long_), ("audit", text_), ("kinds", text_),
              ("roles", T.ArrayType(text_)), ("texts", T.ArrayType(text_))]
    fields += [(c, turn_type if c in ("tmin", "tmax") else text_ if c in ("first", "last") else long_) for c in STATS]
    schema = T.StructType([T.StructField(*f) for f in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    return save(r.mapInArrow(_blocks(to_arrow_schema(schema), BLOCK, BYTES), schema), "talk-blocks")


# ---------------------------------------------------------------- long conversations
def _packed_cell(cell: Cell) -> tuple[list[int], list[str]]:
    flat = [cell.get(p, {}).get(q, (-1, "")) for p in STATES for q in STATES]
    return [c for c, _ in flat], [a for _, a in flat]


def _cell(costs: list[int], audits: list[str]) -> Cell:
    out: Cell = {p: {} for p in STATES}
    for i, (c, a) in enumerate(zip(costs, audits)):
        if c >= 0:
            out[i // 4][i % 4] = (c, a)
    return out


def _join_stats(a: dict, b: dict) -> dict:
    """Statistics of two neighbouring spans together."""
    out = {k: a[k] + b[k] for k in ("n", "turns", "blank", "duplicate", "truncated", "illegal")}
    out["turns"] -= a["tmax"] is not None and a["tmax"] == b["tmin"]
    out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    out["tmin"] = b["tmin"] if a["tmin"] is None else a["tmin"]
    out["tmax"] = a["tmax"] if b["tmax"] is None else b["tmax"]
    return {**out, "first": a["first"], "last": b["last"]}


def _combine_spans(schema: pa.Schema, fan: int):
    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("idx").to_pylist()
        cell = merged([_cell(r["costs"], r["audits"]) for r in rows])
        stats = rows[0]
        for r in rows[1:]:
            stats = _join_stats(stats, r)
        costs, audits = _packed_cell(cell)
        out = {**{k: stats[k] for k in STATS}, "conv_id": rows[0]["conv_id"], "idx": rows[0]["idx"] // fan, "costs": costs, "audits": audits, "sizes": [n for r in rows for n in r["sizes"]]}
        return pa.Table.from_pylist([out], schema=schema)

    return run


def _block_cells(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                costs, audits = _packed_cell(parse(r.pop("kinds")))
                out.append({**r, "costs": costs, "audits": audits, "sizes": [r["n"]]})
            yield _emit(out, schema)

    return run


def _cut(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whole audit of a conversation, cut to its blocks."""
        for batch in batches:
            for r in batch.to_pylist():
                cost, audit = cheapest(_cell(r["costs"], r["audits"]))
                at = made = 0
                out, sizes = [], r["sizes"]
                for i, n in enumerate(sizes):
                    s, left = at, n
                    while left:
                        left -= audit[at] != "I"
                        at += 1
                    if i == len(sizes) - 1:
                        at = len(audit)
                    out.append({"conv_id": r["conv_id"], "idx": i, "part_audit": audit[s:at], "made": made})
                    made += sum(op != "D" for op in audit[s:at])
                    if len(out) == 4096:
                        yield _emit(out, schema)
                        out = []
                if out:
                    yield _emit(out, schema)

    return run


def _first_kept(audit: str) -> int:
    """The number of the row that becomes the first repaired one, -1 where that is new or has a new role, -2 without any."""
    i = 0
    for op in audit:
        if op != "D":
            return i if op == "K" else -1
        i += 1
    return -2


def combine_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a conversation with its cells and statistics; the numbered blocks) of conversations of several blocks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.window import Window

    order = Window.partitionBy("conv_id").orderBy("part", "seq")
    parts = blocks.where("not whole")
    number = parts.select("conv_id", "part", "seq").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    number = number.select(F.col("part").alias("p2"), F.col("seq").alias("s2"), "idx")
    parts = save(parts.drop("cost", "audit").join(number, (F.col("part") == F.col("p2")) & (F.col("seq") == F.col("s2"))).drop("p2", "s2"), "talk-parts")
    src = parts.select("conv_id", "idx", "kinds", *STATS)
    long_, text_ = T.LongType(), T.StringType()
    schema = T.StructType([f for f in src.schema.fields if f.name != "kinds"]
                          + [T.StructField("costs", T.ArrayType(long_)), T.StructField("audits", T.ArrayType(text_)), T.StructField("sizes", T.ArrayType(long_))])
    arrow = to_arrow_schema(schema)
    level = save(src.mapInArrow(_block_cells(arrow), schema), "talk-cells")
    while not level.where("idx > 0").isEmpty():
        up = level.withColumn("up", F.floor(F.col("idx") / FAN)).groupBy("conv_id", "up").applyInArrow(_combine_spans(arrow, FAN), schema)
        level = save(up, "talk-cells")
    return level, parts


def cut_audits(level: DataFrame, parts: DataFrame) -> DataFrame:
    """The blocks of ``parts`` with their part of the audit, how many repaired rows come before, and
    whether the first repaired row of the conversation is a system row (``system``)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    key = level.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", key), T.StructField("idx", T.LongType()), T.StructField("part_audit", T.StringType()), T.StructField("made", T.LongType())])
    cut = level.select("conv_id", "costs", "audits", "sizes").mapInArrow(_cut(to_arrow_schema(schema)), schema)
    cut = cut.select(F.col("conv_id").alias("c2"), F.col("idx").alias("i2"), "part_audit", "made")
    j = save(parts.join(cut, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("idx") == F.col("i2"))).drop("c2", "i2"), "talk-cut")
    # the block that makes the first repaired row tells whether that is a system row
    lead = F.udf(_starts_with_system, "boolean", useArrow=False)
    head = j.where((F.col("made") == 0) & F.col("part_audit").rlike("[KRI]"))
    head = head.select(F.col("conv_id").alias("c2"), lead("part_audit", "roles").alias("system"))
    return j.join(head, F.col("conv_id").eqNullSafe(F.col("c2")), "left").drop("c2").withColumn("system", F.coalesce("system", F.lit(False)))


def _starts_with_system(audit: str, roles: list[str]) -> bool:
    i = _first_kept(audit)
    return i >= 0 and roles[i][:1] == "s"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, position, role, text) of every repaired row."""
    for batch in batches:
        for tag, made, audit, system, roles, texts in zip(*[c.to_pylist() for c in batch.columns]):
            rows, _ = edited(audit, roles, texts, made, system)
            yield pa.record_batch([pa.array([tag["conv_id"]] * len(rows), batch.schema.field(0).type.field("conv_id").type), pa.array(range(made, made + len(rows)), pa.int64()),
                                   pa.array([r for r, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["conv_id", "turn", "role", "text"])


def _whole_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = []
        for audit, roles, texts in zip(*[batch.column(n).to_pylist() for n in ("audit", "roles", "texts")]):
            rows, _ = edited(audit, roles, texts, 0, False)
            sha.append(hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest())
        yield pa.record_batch([batch.column("row"), pa.array(sha, pa.string())], names=["row", "sha"])


def _streamed_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of conversations whose blocks come one after the other, in order."""
    now, sha = None, None
    for batch in batches:
        done = []
        for conv, made, audit, system, roles, texts in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or now[0] != conv:
                done += [(now[0], sha.hexdigest())] if now else []
                now, sha = (conv,), hashlib.sha256()
            rows, _ = edited(audit, roles, texts, made, system)
            if rows:
                sha.update(("\n" if made else "").encode() + "\n".join(f"{r}:{t}" for r, t in rows).encode())
        kind = batch.schema.field(0).type
        yield pa.record_batch([pa.array([c for c, _ in done], kind), pa.array([s for _, s in done], pa.string())], names=["conv_id", "sha"])
    if now is not None:
        yield pa.record_batch([pa.array([now[0]], kind), pa.array([sha.hexdigest()], pa.string())], names=["conv_id", "sha"])


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _edits(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    level, parts = combine_blocks(blocks)
    return blocks.where("whole"), level, cut_audits(level, parts)


def repaired_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: (conv_id, turn, role, text), turns numbered from 0. See ``repair``."""
    whole, _, cut = _edits(blocks_of(rows, conv_id, turn, role, text))
    tag = F.struct("conv_id").alias("tag")
    both = whole.select(tag, F.lit(0).cast("long").alias("made"), "audit", F.lit(False).alias("system"), "roles", "texts") \
        .union(cut.select(tag, "made", "part_audit", "system", "roles", "texts"))
    schema = T.StructType([T.StructField("conv_id", whole.schema["conv_id"].dataType), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return both.mapInArrow(_repaired, schema)


def repair(rows: DataFrame, ids: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, null turns first; a null role or text is one space. A row's first fault counts:
    blank (nothing but ASCII white space), duplicate (role and text seen earlier), truncated (its last other
    character isn't . ! or ?). Blank and duplicate rows are deleted (2); others are kept (0), given the role user or
    assistant (1) or deleted; rows with empty text may be inserted anywhere (5); a truncated row that isn't
    deleted costs 5 more. ``audit``: the initials of the cheapest edits whose result's role initials read
    ``(s?(ua)+)?``, the least string of those that cost the same. gaps: turns missing between the first and the
    last; illegal: neighbours whose initials aren't su, ua or au, before the repair.
    ``ids``: a table of one column; its conversations without any row have zeros, an empty audit and the hash of the
    empty text. A null conversation id is a conversation. Repeated rows are duplicates; other columns aren't read."""
    blocks = blocks_of(rows, conv_id, turn, role, text)
    whole, level, cut = _edits(blocks)
    gaps = F.coalesce(F.col("tmax") - F.col("tmin") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    stats = ["blank", "duplicate", "truncated", "illegal"]
    row = F.struct("conv_id", gaps, *stats, "cost", "audit").alias("row")
    src = whole.select(row, "audit", "roles", "texts")
    done = src.mapInArrow(_whole_digest, T.StructType([src.schema["row"], T.StructField("sha", T.StringType())]))
    done = done.select("row.*", F.col("sha").alias("repaired_sha256"))
    pick = F.udf(lambda c, a: cheapest(_cell(c, a)), T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]), useArrow=False)
    long_ones = level.withColumn("best", pick("costs", "audits")).select("conv_id", gaps, *stats, "best.cost", "best.audit")
    kind = T.StructType([T.StructField("c2", blocks.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())])
    stream = cut.repartition("conv_id").sortWithinPartitions("conv_id", "idx").select("conv_id", "made", "part_audit", "system", "roles", "texts")
    sha = stream.mapInArrow(_streamed_digest, T.StructType([T.StructField("conv_id", kind[0].dataType), T.StructField("sha", T.StringType())])).toDF("c2", "repaired_sha256")
    long_ones = long_ones.join(sha, F.col("conv_id").eqNullSafe(F.col("c2"))).drop("c2")
    out = done.union(long_ones).select(*RESULT)
    if ids is None:
        return out
    every = ids.select(F.col(f"`{ids.columns[0]}`").alias("c2")).distinct()
    out = every.join(out, F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *stats, "cost")]
    return out.select(F.col("c2").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
