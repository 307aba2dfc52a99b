"""Sources and sinks (S1-S9): explicit schemas, multi-file scans, partitioned writes.

Nothing here collects data to the driver: writers use Spark's commit protocol
(dynamic partition overwrite for re-runs), readers never infer schemas.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from gradus.functions.columns import spread

# ------------------------------------------------------------------ schemas
REFERENCE_SCHEMA = StructType([
    StructField("DMS_id", StringType()), StructField("DMS_filename", StringType()),
    StructField("UniProt_ID", StringType()), StructField("target_seq", StringType()),
    StructField("coarse_selection_type", StringType()), StructField("raw_DMS_phenotype_name", StringType()),
    StructField("selection_assay", StringType()), StructField("selection_type", StringType()),
    StructField("molecule_name", StringType()), StructField("title", StringType()),
    StructField("DMS_total_number_mutants", LongType()),
])
VARIANT_SCHEMA = StructType([
    StructField("mutant", StringType()), StructField("mutated_sequence", StringType()),
    StructField("DMS_score", DoubleType()), StructField("DMS_score_bin", IntegerType()),
])
CLUSTER_SCHEMA_SQL = "representative {t}, member {t}"


# ------------------------------------------------------------------ S1
def scan_reference(spark: SparkSession, path: str, schema: StructType = REFERENCE_SCHEMA,
                   fmt: str = "csv") -> DataFrame:
    """The assay reference table with an explicit schema (never inferred)."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return r.format(fmt).load(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header via the commit protocol (S9): as many files as the result has partitions.
    A rebalance after the last stage folds a small result into few files; the stages above it
    keep their own parallelism."""
    df.hint("rebalance").write.mode("overwrite").option("header", True).csv(path)


# ------------------------------------------------------------------ S2
def scan_variants(spark: SparkSession, paths: str | list[str], reference: DataFrame,
                  schema: StructType = VARIANT_SCHEMA, file_col: str = "DMS_filename",
                  id_col: str = "DMS_id") -> DataFrame:
    """One multi-file scan of every variant CSV; each row is tagged with the
    assay id by joining its file name (``_metadata.file_name``) to the reference.
    Files not listed in the reference are dropped; listed-but-missing files are
    reported by ``manifest_check``."""
    df = spark.read.schema(schema).option("header", True).csv(paths)
    df = df.withColumn("_file", F.col("_metadata.file_name"))
    ref = reference.select(F.col(file_col).alias("_file"), F.col(id_col).alias("dms_id"))
    return df.join(ref, "_file", "inner").drop("_file")


def scan_variant_folders(spark: SparkSession, root: str, id_col: str = "dms_id",
                         schema: StructType = VARIANT_SCHEMA) -> DataFrame:
    """S2 for a partitioned layout ``<root>/<id_col>=<id>/*.csv``: one scan, the assay id
    comes from partition discovery (and prunes to the assays a filter asks for)."""
    full = StructType(list(schema.fields) + [StructField(id_col, LongType())])
    return spark.read.schema(full).option("header", True) \
        .option("basePath", root).csv(root)


def scan_variant_buckets(spark: SparkSession, root: str, id_col: str = "dms_id",
                         schema: StructType = VARIANT_SCHEMA) -> DataFrame:
    """S2 for many assays a file, ``<root>/bucket=<n>/*.csv`` with the assay id as the first column."""
    full = StructType([StructField(id_col, LongType()), *schema.fields, StructField("bucket", IntegerType())])
    return spark.read.schema(full).option("header", True).option("basePath", root).csv(root).drop("bucket")


# ------------------------------------------------------------------ S3
def manifest_files(spark: SparkSession, folder: str, expected: DataFrame, file_col: str) -> DataFrame:
    """S3 over real files: ``expected`` (with the file name in ``file_col``) against the files below
    ``folder``. Returns every expected row and every file: ``status`` found / missing / unexpected,
    ``path`` and ``n_bytes`` of the file. The scan lists files; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder) \
        .select(F.element_at(F.split("path", "/"), -1).alias("_file"), "path", F.col("length").alias("n_bytes"))
    j = expected.join(files, expected[file_col] == files["_file"], "full")
    status = F.when(F.col("path").isNull(), F.lit("missing")).when(F.col(file_col).isNull(), F.lit("unexpected")).otherwise(F.lit("found"))
    return j.select(*[c for c in expected.columns if c != file_col], F.coalesce(F.col(file_col), F.col("_file")).alias(file_col),
                    status.alias("status"), "path", "n_bytes")


# ------------------------------------------------------------------ S4
def fasta_lines(seqs: DataFrame, id_col: str, seq: str, desc: str, width: int = 60,
                partitions: int | None = None) -> DataFrame:
    """FASTA text as rows (id, line_no, line): header ``>id description`` then the
    whole sequence wrapped at ``width`` characters (line breaks inside become spaces)."""
    x = spread(seqs.filter(F.col(seq).isNotNull() & (F.length(seq) > 0)).select(id_col, seq, desc), partitions)
    head = x.select(id_col, F.lit(0).alias("line_no"),
                    F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit(" "), F.col(desc)).alias("line"))
    n = F.floor((F.length(seq) + (width - 1)) / width).cast("int")
    t = x.select(id_col, F.regexp_replace(F.col(seq), "[\\r\\n]", " ").alias("_t"), n.alias("_n"))
    # the line array is built once per sequence by the generator, which reads the
    # projected text column; output rows carry only (id, line_no, line)
    lines = F.transform(F.sequence(F.lit(0), F.col("_n") - 1),
                        lambda i: F.col("_t").substr(i * width + 1, F.lit(width)))
    body = t.select(id_col, F.posexplode(lines).alias("_i", "line")) \
        .select(id_col, (F.col("_i") + 1).alias("line_no"), "line")
    return head.unionByName(body)


def write_fasta(lines: DataFrame, path: str, id_col: str) -> None:
    """Write FASTA lines in (id, line_no) order as text files."""
    lines.repartitionByRange(id_col).sortWithinPartitions(id_col, "line_no").select("line") \
         .write.mode("overwrite").text(path)


# ------------------------------------------------------------------ S5
def write_cluster_tsv(clusters: DataFrame, path: str) -> None:
    """(representative, member) as tab-separated text with a header."""
    clusters.select("representative", "member").write.mode("overwrite") \
        .option("sep", "\t").option("header", True).csv(path)


def read_cluster_tsv(spark: SparkSession, path: str, id_type: str = "string", header: bool = True) -> DataFrame:
    """A 2-column TSV (``representative``, ``member``) with an explicit schema."""
    return spark.read.schema(CLUSTER_SCHEMA_SQL.format(t=id_type)).option("sep", "\t") \
        .option("header", header).csv(path)


# ------------------------------------------------------------------ S6
def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row (scales; the nested one-document form is a
    driver-side rendering of tiny results only)."""
    df.write.mode("overwrite").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ------------------------------------------------------------------ S7
def write_scored(df: DataFrame, path: str, partition_col: str = "dms_id") -> None:
    """Per-assay score files; re-running an assay replaces only its partition
    (dynamic partition overwrite), and a failed attempt never leaves a visible
    partial file (task commit protocol). Rows are rebalanced on the assay: small assays share a
    task, and one that is larger than the advisory partition size is split over several."""
    df.hint("rebalance", partition_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(partition_col).parquet(path)


# ------------------------------------------------------------------ S8
WEIGHT_ROW_SCHEMA = StructType([
    StructField("path", StringType()), StructField("name", StringType()), StructField("row", IntegerType()),
    StructField("vals", ArrayType(DoubleType())),
])
_DTYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": None, "I64": "<i8", "I32": "<i4"}


RANGE_SCHEMA = StructType([
    StructField("path", StringType()), StructField("name", StringType()), StructField("kind", StringType()),
    StructField("width", LongType()), StructField("at", LongType()), StructField("first", LongType()),
    StructField("rows", LongType())])


def _opened(path: str):
    import re

    import pyarrow.fs as pafs
    fs, file = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.open_input_file(file)


def _stored(kind: str) -> np.dtype:
    return np.dtype("<u2" if kind == "BF16" else _DTYPES[kind])


def _tensor_ranges(f, keep: str, block: int) -> Iterator[tuple[str, str, int, int, int, int]]:
    """(name, kind, width, place in the file, first row, rows) of a file's kept tensors, from its
    header alone, about ``block`` bytes each."""
    n = struct.unpack("<Q", f.read_at(8, 0))[0]
    for name, meta in json.loads(f.read_at(n, 8).decode("utf-8")).items():
        if name == "__metadata__" or keep not in name:
            continue
        shape = meta["shape"] or [1]
        rows, width = (shape[0], int(np.prod(shape[1:]))) if len(shape) > 1 else (1, shape[0])
        long = width * _stored(meta["dtype"]).itemsize
        step = max(1, block // max(1, long))
        for r in range(0, rows, step):
            yield name, meta["dtype"], width, 8 + n + meta["data_offsets"][0] + r * long, r, min(step, rows - r)


def _read_range(f, kind: str, width: int, at: int, rows: int) -> np.ndarray:
    store = _stored(kind)
    a = np.frombuffer(f.read_at(rows * width * store.itemsize, at), dtype=store)
    if kind == "BF16":
        a = (a.astype(np.uint32) << 16).view(np.float32)
    return a.astype("float64").reshape(rows, width)


def weights_ingest(spark: SparkSession, path: str, keep: str = "lora_", block: int = 8 << 20) -> DataFrame:
    """Read many ``.safetensors`` files as row blocks (path, name, row, vals);
    only tensors whose name contains ``keep``. The scan lists the files (no content); tasks read the
    headers and name the ranges of about ``block`` bytes to read; the ranges, not the files, are dealt
    over ``spark.sql.shuffle.partitions`` tasks, so one large file is read by many of them and
    memory doesn't grow with a file. Nothing passes through the driver."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").load(path).select("path")

    def plan(batches: Iterator) -> Iterator:
        for b in batches:
            for p in b.column(0).to_pylist():
                with _opened(p) as f:
                    found = [(p, *r) for r in _tensor_ranges(f, keep, block)]
                for i in range(0, len(found), 4096):
                    yield pa.record_batch([pa.array(c) for c in zip(*found[i:i + 4096])], names=RANGE_SCHEMA.names)

    def read(batches: Iterator) -> Iterator:
        for b in batches:
            last, f = None, None
            for r in sorted(b.to_pylist(), key=lambda r: (r["path"], r["at"])):
                if r["path"] != last:
                    if f is not None:
                        f.close()
                    last, f = r["path"], _opened(r["path"])
                a = _read_range(f, r["kind"], r["width"], r["at"], r["rows"])
                k, width = a.shape
                vals = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * width), pa.array(a.ravel()))
                yield pa.record_batch([pa.array([last] * k), pa.array([r["name"]] * k),
                                       pa.array(np.arange(r["first"], r["first"] + k, dtype=np.int32)), vals],
                                      names=["path", "name", "row", "vals"])
            if f is not None:
                f.close()

    # a stated number of partitions: adaptive execution would join these few bytes to one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.mapInArrow(plan, RANGE_SCHEMA).repartition(tasks, "path", "name", "first").mapInArrow(read, WEIGHT_ROW_SCHEMA)


def encode_safetensors(tensors: dict[str, np.ndarray]) -> bytes:
    """Serialise float64 tensors to the safetensors layout (8-byte header size,
    JSON header, raw little-endian data)."""
    header, chunks, off = {}, [], 0
    for name, a in tensors.items():
        b = np.ascontiguousarray(a, dtype="<f8").tobytes()
        header[name] = {"dtype": "F64", "shape": list(a.shape), "data_offsets": [off, off + len(b)]}
        chunks.append(b)
        off += len(b)
    h = json.dumps(header).encode("utf-8")
    return struct.pack("<Q", len(h)) + h + b"".join(chunks)


def write_safetensors_files(long: DataFrame, file_key: str, tensor: str, folder: str, file_name) -> None:
    """Write one safetensors file per ``file_key`` from long rows (key, tensor, r, c, v).
    Files go through pyarrow's filesystem layer (local, HDFS, object stores), each to a
    temporary name first and then moved into place, so a retried task rewrites it whole."""
    key_type = long.schema[file_key].dataType.simpleString()

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        import pyarrow.fs as pafs
        key = pdf[file_key].iloc[0]
        tensors = {}
        for name, g in pdf.groupby(tensor, sort=True):
            m = np.zeros((int(g["r"].max()) + 1, int(g["c"].max()) + 1))
            m[g["r"].to_numpy(), g["c"].to_numpy()] = g["v"].to_numpy()
            tensors[name] = m
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root.rstrip('/')}/{file_name(key)}"
        with fs.open_output_stream(path + ".tmp") as out:
            out.write(encode_safetensors(tensors))
        fs.move(path + ".tmp", path)
        return pd.DataFrame({file_key: [key], "n_tensors": [len(tensors)]})

    long.groupBy(file_key).applyInPandas(write, f"{file_key} {key_type}, n_tensors long") \
        .write.format("noop").mode("overwrite").save()


def weight_stats(rows: DataFrame) -> DataFrame:
    """S8 summary per file: parameters, tensors and layers (``layers.N`` / ``layer.N``)."""
    layer = F.regexp_extract("name", r"layers?\.([0-9]+)\.", 1)
    return rows.groupBy("path").agg(F.sum(F.size("vals")).cast("long").alias("n_params"),
                                    F.countDistinct("name").alias("n_tensors"),
                                    F.countDistinct(F.when(layer != "", layer)).alias("n_layers"))
