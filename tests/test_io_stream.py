"""Sources, sinks and streams: round trips with explicit schemas, idempotent re-runs."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from gradus.sources import io
from gradus.streaming import incremental as ST


def test_safetensors_round_trip(spark):
    d = tempfile.mkdtemp(prefix="gradus-st-")
    t = {"m.layer.0.q.lora_A.weight": np.arange(6.0).reshape(2, 3),
         "m.layer.0.q.lora_B.default.weight": np.ones((3, 2)), "head.weight": np.zeros((1, 1))}
    with open(os.path.join(d, "a.safetensors"), "wb") as fh:
        fh.write(io.encode_safetensors(t))
    rows = io.weights_ingest(spark, d).collect()
    names = {r.name for r in rows}
    assert names == {"m.layer.0.q.lora_A.weight", "m.layer.0.q.lora_B.default.weight"}
    a = sorted((r.row, r.vals) for r in rows if "lora_A" in r.name)
    assert a == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]
    st = io.weight_stats(io.weights_ingest(spark, d)).first()
    assert st.n_params == 12 and st.n_tensors == 2 and st.n_layers == 1


def test_one_file_is_read_by_many_tasks(spark):
    d = tempfile.mkdtemp(prefix="gradus-st-")
    big = np.arange(64000.0).reshape(1000, 64)
    with open(os.path.join(d, "a.safetensors"), "wb") as fh:
        fh.write(io.encode_safetensors({"x.lora_A.weight": big, "x.bias": np.ones((5, 2)), "y.lora_B.weight": np.ones((0, 3))}))
    rows = io.weights_ingest(spark, d, block=8192).withColumn("task", F.spark_partition_id()).collect()
    assert [r.vals for r in sorted(rows, key=lambda r: r.row)] == big.tolist()
    assert len({r.task for r in rows}) > 1


def test_reference_csv_and_cluster_tsv(spark):
    d = tempfile.mkdtemp(prefix="gradus-csv-")
    with open(os.path.join(d, "ref.csv"), "w") as fh:
        fh.write("DMS_id,DMS_filename,UniProt_ID,target_seq,coarse_selection_type,raw_DMS_phenotype_name,"
                 "selection_assay,selection_type,molecule_name,title,DMS_total_number_mutants\n")
        fh.write("A_1,A_1.csv,P1,MKV,Stability,tm,,,,,120\nB_2,B_2.csv,P2,MKA,Binding,kd,,,,,\n")
    ref = io.scan_reference(spark, os.path.join(d, "ref.csv")).collect()
    assert [(r.DMS_id, r.DMS_total_number_mutants) for r in ref] == [("A_1", 120), ("B_2", None)]
    cl = spark.createDataFrame([("P1", "P1"), ("P1", "P3")], "representative string, member string")
    io.write_cluster_tsv(cl, os.path.join(d, "tsv"))
    back = io.read_cluster_tsv(spark, os.path.join(d, "tsv")).collect()
    assert sorted(tuple(r) for r in back) == [("P1", "P1"), ("P1", "P3")]


def test_variant_files_tagged_by_name(spark):
    d = tempfile.mkdtemp(prefix="gradus-var-")
    for name, rows in {"A_1.csv": ["A1P,,0.5,1", "D2N,,0.1,0"], "B_2.csv": ["C3D,,1.5,1"], "X.csv": ["A1C,,9,1"]}.items():
        with open(os.path.join(d, name), "w") as fh:
            fh.write("mutant,mutated_sequence,DMS_score,DMS_score_bin\n" + "\n".join(rows) + "\n")
    ref = spark.createDataFrame([("A_1", "A_1.csv"), ("B_2", "B_2.csv"), ("C_3", "C_3.csv")],
                                "DMS_id string, DMS_filename string")
    got = io.scan_variants(spark, d, ref).groupBy("dms_id").count().collect()
    assert {r.dms_id: r["count"] for r in got} == {"A_1": 2, "B_2": 1}


def test_fasta_lines(spark):
    df = spark.createDataFrame([(1, "x" * 130, "d"), (2, "", "e")], "id int, s string, desc string")
    lines = sorted((r.id, r.line_no, r.line) for r in io.fasta_lines(df, "id", "s", "desc").collect())
    assert lines == [(1, 0, ">1 d"), (1, 1, "x" * 60), (1, 2, "x" * 60), (1, 3, "x" * 10)]


def test_scored_sink_rerun_replaces(spark):
    d = tempfile.mkdtemp(prefix="gradus-sink-")
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.0)], "item int, dms_id string, s double")
    io.write_scored(df, d)
    io.write_scored(df.filter(F.col("dms_id") == "a"), d)
    assert spark.read.parquet(d).count() == 2


def test_incremental_scoring_is_idempotent(spark):
    src = tempfile.mkdtemp(prefix="gradus-src-")
    spark.createDataFrame([(i, "t" + str(i % 2), float(i)) for i in range(10)], "id long, k string, v double") \
        .write.mode("overwrite").parquet(os.path.join(src, "batch1"))
    static = spark.createDataFrame([("t0", 1.0), ("t1", 2.0)], "k string, w double")
    schema = spark.read.parquet(os.path.join(src, "batch1")).schema
    out, ck = tempfile.mkdtemp(prefix="gradus-out-"), tempfile.mkdtemp(prefix="gradus-ck-")

    def run():
        s = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
        return ST.incremental_scoring(s, static, "k", F.col("v") * F.col("w"), out, ck, ["id"])

    run()
    assert spark.read.parquet(out).count() == 10
    run()  # nothing new: no rows added
    assert spark.read.parquet(out).count() == 10
    spark.createDataFrame([(10, "t0", 10.0)], "id long, k string, v double").write.parquet(os.path.join(src, "batch2"))
    run()
    assert spark.read.parquet(out).count() == 11


def test_training_monitor(spark):
    src = tempfile.mkdtemp(prefix="gradus-mon-")
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), "p" + str(i % 2), float((i * 7) % 5)) for i in range(10)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double") \
        .write.parquet(os.path.join(src, "b1"))
    schema = spark.read.parquet(os.path.join(src, "b1")).schema
    out, ck = tempfile.mkdtemp(prefix="gradus-mo-"), tempfile.mkdtemp(prefix="gradus-mc-")
    ST.training_monitor(spark.readStream.schema(schema).parquet(os.path.join(src, "*")),
                        "event_type", "ts", "value", "event_id", out, ck)
    got = {r.property: r for r in ST.latest_table(spark, out).collect()}
    assert got["p1"].n_events == 5 and got["p1"].latest_value == float((9 * 7) % 5)
    assert got["p0"].best_value == max(float((i * 7) % 5) for i in range(0, 10, 2))
    for i in range(2, 5):
        spark.createDataFrame(rows[:i], "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(os.path.join(src, f"b{i}"))
        ST.training_monitor(spark.readStream.schema(schema).parquet(os.path.join(src, "*")), "event_type", "ts", "value", "event_id", out, ck)
    assert sorted(ST._batches(spark, out)) == [2, 3]
    assert sum(r.n_events for r in ST.latest_table(spark, out).collect()) == 10 + 2 + 3 + 4


def test_early_stop_monitor_across_batches(spark):
    from gradus.operators import log as LG
    vals = [0.1, 0.3, 0.2, 0.25, 0.3, 0.29, 0.28, 0.5, 0.9]
    rows = [("p", i + 1, v) for i, v in enumerate(vals)] + [("q", i + 1, float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "property string, epoch int, val double")
    src = tempfile.mkdtemp(prefix="gradus-es-")
    df.filter("epoch <= 4").write.parquet(os.path.join(src, "b1"))
    df.filter("epoch > 4").write.parquet(os.path.join(src, "b2"))
    out, ck = tempfile.mkdtemp(prefix="gradus-eso-"), tempfile.mkdtemp(prefix="gradus-esc-")
    stream = ST.file_stream(spark, os.path.join(src, "*"), df.schema, max_files=1)
    ST.early_stop_monitor(stream, "property", "epoch", "val", 3, out, ck)
    got = {r.property: (r.best_epoch, r.best_val, r.stop_epoch, r.epochs_run) for r in ST.latest_status(spark, out).collect()}
    ref = {r.property: (r.best_epoch, r.best_val, r.stop_epoch, r.epochs_run)
           for r in LG.best_epoch_early_stop(df, patience=3).collect()}
    assert got == ref and got["p"] == (2, 0.3, 5, 5)


def test_monitor_folders_stay_few(spark):
    """Twelve batches, epochs out of order and replayed, properties that report once only, a NULL
    property: the status equals the rule over all rows, and folders of old batches are gone."""
    from gradus.operators import log as LG
    rng = np.random.default_rng(5)
    rows = [(p, e, float(rng.integers(0, 40))) for p in ("p", "q", None) for e in range(1, 49)] + [("once", 1, 0.5)]
    late = {(p, e): e + int(rng.integers(0, 6)) for p, e, _ in rows}
    order = sorted(rows, key=lambda r: (late[r[0], r[1]], str(r[0])))
    schema = "property string, epoch int, val double"
    src, out, ck = (tempfile.mkdtemp(prefix=f"gradus-{x}-") for x in ("few", "few-out", "few-ck"))
    for i in range(12):
        part = order[i * len(order) // 12:(i + 1) * len(order) // 12]
        spark.createDataFrame(part + part[:1], schema).coalesce(1).write.parquet(os.path.join(src, f"b{i:02d}"))
        stream = ST.file_stream(spark, os.path.join(src, "*"), spark.createDataFrame([], schema).schema)
        ST.early_stop_monitor(stream, "property", "epoch", "val", 30, out, ck, lateness=8, compact_every=3)
    fields = ("property", "best_epoch", "best_val", "stop_epoch", "epochs_run")
    got = {tuple(r[f] for f in fields) for r in ST.latest_status(spark, out).collect()}
    want = LG.best_epoch_early_stop(spark.createDataFrame(rows, schema), patience=30)
    assert got == {tuple(r[f] for f in fields) for r in want.collect()} and len(got) == 4
    assert sorted(ST._batches(spark, out)) == [8, 9, 10, 11]


def test_patience_state_is_bounded():
    """Epochs one by one: the rule's result is that of the whole history, what is held stays within
    the lateness, and a replay of a final epoch changes nothing."""
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    fn, state, vals = ST._early_stop_fn("epoch", "val", 5, 4), State(), [1.0, 3.0, 2.0, 2.5, 4.0, 1.0, 1.0, 1.0, 1.0, 1.0, 9.0, 9.5]
    for i, v in enumerate(vals):
        for sent in ([(i + 1, v)], [(max(1, i - 6), 99.0)] if i > 7 else []):
            frame = pd.DataFrame(sent, columns=["epoch", "val"])
            out = list(fn(("p",), iter([frame] if sent else []), state))[0].iloc[0]
        seen = list(enumerate(vals[:i + 1], 1))
        best, last, stop, run = None, None, None, 0
        for e, x in seen:
            run += 1
            if best is None or x > best:
                best, last = x, e
            elif e - last >= 5:
                stop = e
                break
        assert (out.best_epoch, out.best_val, out.stop_epoch, out.epochs_run, out.last_epoch) == (last, best, stop, run, i + 1)
        assert len(state.get[6]) <= 4 and len(state.get[7]) <= 4


def test_replayed_rows_are_scored_once(spark):
    """Replays in the same batch, in a later file and with a changed value; new rows pass; a row
    behind the watermark or without a time does not break the stream."""
    import datetime as dt
    src, out, ck = (tempfile.mkdtemp(prefix=f"gradus-{x}-") for x in ("replay", "replay-out", "replay-ck"))
    schema = "id long, ts timestamp, k string, v double"
    static = spark.createDataFrame([("a", 2.0)], "k string, w double")

    def deliver(rows):
        spark.createDataFrame([(i, ts, "a", v) for i, ts, v in rows], schema).coalesce(1).write.mode("append").parquet(src)
        s = ST.without_replays(spark.readStream.schema(schema).parquet(src), "id", "ts", "2 hours")
        ST.incremental_scoring(s, static, "k", F.col("v") * F.col("w"), out, ck, ["id"])
        return sorted((r.id, r.score) for r in spark.read.parquet(out).collect())

    t = dt.datetime(2024, 1, 1, 12)
    hour = dt.timedelta(hours=1)
    assert deliver([(1, t, 1.0), (1, t, 1.0), (2, t + hour, 2.0)]) == [(1, 2.0), (2, 4.0)]
    assert deliver([(1, t, 9.0), (2, t + hour, 9.0)]) == [(1, 2.0), (2, 4.0)]
    assert deliver([(3, t + 9 * hour, 3.0)]) == [(1, 2.0), (2, 4.0), (3, 6.0)]
    assert deliver([(1, t, 1.0), (4, t + 8 * hour, 4.0), (5, None, 5.0)])[:4] == [(1, 2.0), (2, 4.0), (3, 6.0), (4, 8.0)]


def test_list_documents_are_bounded(spark):
    """A hot list is split into parts, a NULL list and null entries are kept, all rows come back."""
    from pyspark.sql.types import StructType
    from gradus.sources import documents as D
    rows = [(i, "hot" if i % 3 else None, f"x{i}" if i % 5 else None) for i in range(900)]
    x = spark.createDataFrame(rows, "id long, side string, note string")
    lists = D.list_documents(x, ["side"], "id", ["id", "note"], rows=50)
    sizes = [(r.side, len(r.entries)) for r in lists.collect()]
    assert len([s for s in sizes if s[0] == "hot"]) == 12 and max(n for _, n in sizes) < 100
    path = tempfile.mkdtemp(prefix="gradus-lists-")
    D.write_documents(lists, path)
    back = D.read_lists(spark, path, StructType.fromDDL("side string").fields, StructType.fromDDL("id bigint, note string"))
    assert sorted((r.id, r.side, r.note) for r in back.collect()) == rows
    assert D.list_documents(x.limit(0), ["side"], "id", ["id"]).count() == 0


def test_split_outputs_name_their_leaks(spark):
    from pyspark.sql.types import StructType
    from gradus.sources import documents as D
    split = spark.createDataFrame([(1, "c", "p1", "k1", "train"), (2, "c", "p2", "k1", "test"), (3, "c", "p3", "k2", "test")],
                                  "dms_id long, category string, protein string, cluster string, split string")
    path = tempfile.mkdtemp(prefix="gradus-split-")
    D.write_split(split, path, {"random_seed": 42})
    leaks = D.read_lists(spark, path + "/leaks", StructType.fromDDL("level string").fields, StructType.fromDDL("cluster string"))
    assert [tuple(r) for r in leaks.collect()] == [("cluster", "k1")]
    meta = spark.read.json(path + "/metadata").first()
    assert meta.random_seed == 42 and not meta.validation.valid and meta.validation.n_cluster_overlap == 1
