"""Token-id shards with a minimal perfect hash index.

``write_tokens`` range-partitions the documents by id, encodes them with a public tokenizer and
writes raw little-endian ids (unsigned 16-bit where the vocabulary allows, else 32-bit) in
ascending doc_id order, rolling to a new ``ids-<partition>-<roll>.bin`` at ``SHARD_IDS``.
A document's key is (doc_id, k): k counts the rows that repeat a doc_id. Keys are dealt by hash
to index parts; each part holds a minimal perfect hash over its keys (levels of bit arrays: a key
that is alone at its place of a level stays there, its index is the rank of that bit; the others go
on) and at that index a 32-bit fingerprint, the shard number, the offset and the length.
``read_tokens`` answers keys from the files: part by hash, index by the levels, fingerprint check,
one range read of the shard.

Files are written under another name and renamed, with contents that don't depend on the attempt,
so a task that runs again after a lost executor, or twice, leaves the same file. The folder must be
one that all executors reach through ``pyarrow.fs``.
"""

from __future__ import annotations

import io
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.common import mix64, save, ship_package
from gradus.sources.scratch import open_folder, put

SHARD_IDS = 8_000_000
PART_KEYS = 500_000
BYTES_A_PARTITION = 32 << 20
CACHE_WORDS = 400_000
NULL_KEY = np.uint64(0xA5A5_0F0F_3C3C_9999)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _byte_letters() -> dict[int, int]:
    """Byte-level spelling: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class WordEncoder:
    """Encodes texts whose tokenizer lowers case and drops white space: the ids of a text are those of
    its pieces between ASCII white space, so pieces met lately are looked up. A piece that is new only
    by capitals or by the punctuation at its end is put together from known ones. Two generations of
    at most ``CACHE_WORDS`` pieces bound the memory. A tokenizer that encodes white space, as probes
    tell, gets whole texts instead (``splits`` is false)."""

    #: ASCII punctuation that never starts a piece of its own together with the letters after it.
    TAIL = b"!\"#$%&()*+,-./:;=?@[]^_`{|}~"

    def __init__(self, json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.model = self.tokenizer.model
        probe = [b"Word", b"word", b"word,", b",", *(x.encode() for x in ("straße", "señor", "été", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"))]
        whole = self._encode_all(probe)
        self.joins = whole[0] == whole[1] and whole[2] == whole[1] + whole[3]
        try:
            self.plain = self.joins and [self._merge(w) for w in probe[4:]] == whole[4:] and self._merge(b"word") == whole[1]
        except Exception:  # the model doesn't take byte-level letters: every piece goes the whole way
            self.plain = False
        self.splits = self._drops_space()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode_all(self, words: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in got]

    def _drops_space(self) -> bool:
        """Whether a text's ids are those of its pieces, for every kind of white space between and around them."""
        words = [b"a", b"b", b"word", b"."]
        one = dict(zip(words, self._encode_all(words)))
        for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c", b"\r\n", b"  ", b"\n\n"):
            texts = [(c, ()), (c + b"a" + c, (b"a",)), *[(x + c + y, (x, y)) for x in words for y in words]]
            if self._encode_all([t for t, _ in texts]) != [b"".join(one[w] for w in ws) for _, ws in texts]:
                return False
        return True

    def segments(self, text: bytes) -> Iterator[bytes]:
        """The parts of a text that may be encoded apart."""
        return text_segments(text) if self.splits else iter([text])

    def _merge(self, w: bytes) -> bytes:
        """The ids of a piece of lower-case Latin letters by the tokenizer's merges alone: such a piece is
        neither normalised nor split. Bytes are spelled as in byte-level tokenizers."""
        if not w.isascii():
            w = w.decode().lower().encode()
        spelled = w.decode("latin-1").translate(BYTE_LETTERS)
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _is_plain(self, w: bytes) -> bool:
        if w.isascii():
            return w.isalpha()
        try:
            t = w.decode()
        except UnicodeDecodeError:
            return False
        return t.isalpha() and max(t) < "\u0250" and "\u0130" not in t and "\u0149" not in t and "\u01f0" not in t

    def _known(self, w: bytes) -> bytes | None:
        return self.new.get(w) or self.old.get(w)

    def _parts(self, w: bytes) -> tuple[bytes, bytes]:
        """A piece in lower case, and the punctuation at its end where it stands apart from a letter or digit."""
        if not self.joins or b"<" in w:  # special tokens are spelled with <
            return w, b""
        low = w.lower()
        core = low.rstrip(self.TAIL)
        return (core, low[len(core):]) if core and core[-1:].isalnum() else (low, b"")

    def _learn(self, words: set[bytes]) -> None:
        parts, missing = {}, set()
        for w in words:
            if (got := self.old.get(w)) is not None:
                self.new[w] = got
            else:
                parts[w] = p = self._parts(w)
                missing.update(x for x in p if x and self._known(x) is None)
        missing = list(missing)
        if self.plain:
            rest = []
            for x in missing:
                if self._is_plain(x):
                    self.new[x] = self._merge(x)
                else:
                    rest.append(x)
            missing = rest
        for i in range(0, len(missing), 4096):
            self.new.update(zip(missing[i:i + 4096], self._encode_all(missing[i:i + 4096])))
        for w, p in parts.items():
            self.new[w] = b"".join(self._known(x) or b"" for x in p if x)

    def encode(self, text: bytes) -> bytes:
        if not self.splits:
            return self._encode_all([text])[0]
        words = text.split()
        got = list(map(self.new.get, words))
        if None in got:
            at = [i for i, g in enumerate(got) if g is None]
            self._learn({words[i] for i in at})
            for i in at:
                got[i] = self.new[words[i]]
            if len(self.new) > CACHE_WORDS:
                self.old, self.new = self.new, {}
        return b"".join(got)


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(json: str) -> WordEncoder:
    """One per Python worker: workers serve many tasks."""
    k = zlib.crc32(json.encode())
    if k not in _ENCODERS:
        _ENCODERS[k] = WordEncoder(json)
    return _ENCODERS[k]


def text_segments(text: bytes, most: int = 4 << 20) -> Iterator[bytes]:
    """Pieces of a very long text, cut at spaces or line ends."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(b" ", at, at + most), text.rfind(b"\n", at, at + most))
        cut = cut + 1 if cut >= 0 else min([x for x in (text.find(b" ", at), text.find(b"\n", at)) if x >= 0], default=len(text) - 1) + 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _writer(folder: str, tokenizer, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer.value)
        end = np.array([end_id], dtype=enc.kind).tobytes()
        width, part, roll = len(end), TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        rows: list[tuple] = []
        held, last, k = 0, object(), 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, rows, held, roll
            put(folder, f"ids-{part:07d}-{roll:05d}.bin", b"".join(parts))
            cols = list(zip(*rows))
            shard = part * 100_000 + roll
            parts, rows, held, roll = [], [], 0, roll + 1
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array([shard] * len(cols[0]), pa.int64()),
                                    pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "k", "shard", "offset", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                k = k + 1 if doc == last else 0
                last = doc
                raw = text.as_py() or b""
                ids = [enc.encode(s) for s in enc.segments(raw)] + [end]
                n = sum(map(len, ids)) // width
                parts += ids
                rows.append((doc, k, held, n))
                held += n
                if held >= SHARD_IDS:
                    yield flush()
        if rows:
            yield flush()

    return write


# ---- minimal perfect hash over uint64 keys -------------------------------------------------

def mph_build(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of packed bits for distinct keys, and every key's index (0..n-1)."""
    levels, ranks, base = [], np.zeros(len(keys), dtype=np.int64), 0
    left = np.arange(len(keys))
    while len(left):
        size = max(64, 2 * len(left))
        at = _place(keys[left], len(levels), size)
        count = np.bincount(at, minlength=size)
        bits = count == 1
        levels.append(np.packbits(bits))
        alone = bits[at]
        ranks[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        base += int(bits.sum())
        left = left[~alone]
    return levels, ranks


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys + np.uint64((int(GOLDEN) * (level + 1)) % (1 << 64))) % np.uint64(size)).astype(np.int64)


class Mph:
    def __init__(self, levels: list[np.ndarray]):
        self.bits = [np.unpackbits(x).astype(bool) for x in levels]
        self.ranks, base = [], 0
        for b in self.bits:
            c = np.cumsum(b) - 1 + base
            self.ranks.append(c)
            base += int(b.sum())
        self.n = base

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key; a key that isn't in the set gets any index or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, n = np.arange(len(keys)), self.n
        for level, b in enumerate(self.bits):
            at = _place(keys[left], level, max(64, 2 * n))
            hit = b[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left, n = left[~hit], n - int(b.sum())
        return out


def key64(doc_id: np.ndarray, null: np.ndarray, k: np.ndarray) -> np.ndarray:
    h = mix64(doc_id.astype(np.int64).view(np.uint64)) ^ np.where(null, NULL_KEY, np.uint64(0))
    return np.where(k == 0, h, mix64(h + GOLDEN * k.astype(np.uint64)))


def fingerprint(key: np.ndarray) -> np.ndarray:
    return (mix64(key ^ np.uint64(0x5BD1E995C2B2AE35)) >> np.uint64(32)).astype(np.uint32)


def _keys(pdf) -> np.ndarray:
    null = pdf["doc_id"].isna().to_numpy()
    return key64(pdf["doc_id"].fillna(0).to_numpy(dtype=np.int64), null, pdf["k"].to_numpy(dtype=np.int64))


def _index_writer(folder: str):
    def build(pdf):
        import pandas as pd

        keys = _keys(pdf)
        order = np.argsort(keys, kind="stable")
        twice = np.zeros(len(keys), dtype=bool)  # two keys with one 64-bit hash are kept as they are
        twice[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        main = ~twice
        levels, rank = mph_build(keys[main])
        data = {}
        for name, col, kind in (("print", fingerprint(keys), np.uint32), ("shard", pdf["shard"], np.int64), ("offset", pdf["offset"], np.int64), ("n", pdf["n"], np.int64)):
            a = np.zeros(int(main.sum()), dtype=kind)
            a[rank] = np.asarray(col, dtype=kind)[main]
            data[name] = a
        rest = pdf[twice]
        data["rest"] = np.stack([rest["doc_id"].fillna(0).to_numpy(np.int64), rest["doc_id"].isna().to_numpy(np.int64), rest["k"].to_numpy(np.int64),
                                 rest["shard"].to_numpy(np.int64), rest["offset"].to_numpy(np.int64), rest["n"].to_numpy(np.int64)], axis=1)
        out = io.BytesIO()
        np.savez(out, **data, **{f"level{i:03d}": x for i, x in enumerate(levels)})
        part = int(pdf["part"].iloc[0])
        put(folder, f"index-{part:06d}.npz", out.getvalue())
        return pd.DataFrame({"part": [part], "keys": [len(pdf)]})

    return build


def part_of(n_parts: int):
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "k"), F.lit(n_parts)).cast("int")


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write shards and index below ``folder`` and return the manifest (shard, base, n_ids): one row a shard.

    Null and empty texts are the end id alone; null doc_ids come first; rows that repeat a doc_id lie
    side by side, ordered by a hash of their text; an empty table writes nothing. Other columns are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_file) as f:
        tokenizer = spark.sparkContext.broadcast(f.read())  # one file of a few MB
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // BYTES_A_PARTITION))
    d = d.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    entries = save(d.mapInArrow(_writer(f"{folder}/ids", tokenizer, end_id), "doc_id long, k int, shard long, offset long, n long"), "token-entries")
    n_parts = max(1, -(-entries.count() // PART_KEYS))
    parts = entries.withColumn("part", part_of(n_parts)).groupBy("part").applyInPandas(_index_writer(f"{folder}/index"), "part int, keys long")
    parts.write.parquet(f"{folder}/parts")
    by = entries.groupBy("shard").agg(F.sum("n").alias("n_ids"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by.select("shard", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"), "n_ids").write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("shard long, base long, n_ids long").parquet(f"{folder}/manifest")


def _index_reader(folder: str):
    def look(pdfs):
        import pandas as pd

        fs, base = open_folder(folder)
        have, z, mph = None, None, None
        for pdf in pdfs:
            for part, g in pdf.groupby("part", sort=True):
                if part != have:
                    with fs.open_input_file(f"{base}/index-{int(part):06d}.npz") as f:
                        z = dict(np.load(io.BytesIO(f.read())))
                    have, mph = part, Mph([z[x] for x in sorted(z) if x.startswith("level")])
                keys = _keys(g)
                at = mph.index(keys)
                ok = at >= 0
                ok[ok] = z["print"][at[ok]] == fingerprint(keys[ok])
                got = {c: np.where(ok, z[c][np.where(ok, at, 0)] if mph.n else 0, -1) for c in ("shard", "offset", "n")}
                for r in z["rest"]:
                    same = (g["doc_id"].fillna(0).to_numpy(np.int64) == r[0]) & (g["doc_id"].isna().to_numpy() == bool(r[1])) & (g["k"].to_numpy() == r[2])
                    for c, v in zip(("shard", "offset", "n"), r[3:]):
                        got[c][same] = v
                out = pd.DataFrame({"doc_id": g["doc_id"].astype("Int64"), "k": g["k"], **got})
                yield out[out["shard"] >= 0]

    return look


def _payload_reader(folder: str, kind: str):
    def read(pdfs):
        import pandas as pd

        fs, base = open_folder(folder)
        width, have, f = np.dtype(kind).itemsize, None, None
        for pdf in pdfs:
            crc = np.zeros(len(pdf), dtype=np.int64)
            for i, (shard, offset, n) in enumerate(zip(pdf["shard"], pdf["offset"], pdf["n"])):
                if shard != have:
                    if f is not None:
                        f.close()
                    have, f = shard, fs.open_input_file(f"{base}/ids-{shard // 100_000:07d}-{shard % 100_000:05d}.bin")
                raw = f.read_at(n * width, offset * width)
                crc[i] = zlib.crc32(np.frombuffer(raw, dtype=kind).astype("<u4").tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "k": pdf["k"], "shard": pdf["shard"], "offset": pdf["offset"], "n_tokens": pdf["n"], "ids_crc32": crc})
        if f is not None:
            f.close()

    return read


def locate(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, k) -> (doc_id, k, shard, offset, n) by the index; keys that it doesn't hold give no row
    (a foreign key passes the fingerprint once in 2**32)."""
    spark = keys.sparkSession
    ship_package(spark)
    n_parts = spark.read.schema("part int, keys long").parquet(f"{folder}/parts").count()
    if not n_parts:
        return spark.createDataFrame([], "doc_id long, k int, shard long, offset long, n long")
    k = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("k").cast("int").alias("k")).withColumn("part", part_of(n_parts))
    return (k.repartition("part", (F.xxhash64("doc_id") % 64)).sortWithinPartitions("part")
            .mapInPandas(_index_reader(f"{folder}/index"), "doc_id long, k int, shard long, offset long, n long"))


def read_tokens(keys: DataFrame, folder: str, kind: str) -> DataFrame:
    """(doc_id, k, start, n_tokens, ids_crc32) of the keys, read from the shards by their index."""
    at = locate(keys, folder).repartition("shard").sortWithinPartitions("shard", "offset")
    rows = at.mapInPandas(_payload_reader(f"{folder}/ids", kind), "doc_id long, k int, shard long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(manifest(keys.sparkSession, folder), "shard").select("doc_id", "k", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def id_type(tokenizer_file: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else "<u4"


def row_keys(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, k) of every row of a table."""
    n = docs.groupBy(F.col(doc_id).cast("long").alias("doc_id")).count()
    return n.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))).alias("k"))
