"""Rows that are found again by their place, their number in their file: what moves is a list of places, not the rows."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.session import scratch_path
from gradus.sources.scratch import keep, open_folder, put, written

#: Rows of a file whose numbers are listed together, as a power of two.
LISTED = 16


def places(docs: DataFrame) -> list[Column]:
    """(block: some rows of a file, at: number in the file) of every row of a scan."""
    meta = docs.metadataColumn("_metadata")
    return [F.xxhash64(meta["file_path"], F.shiftright(meta["row_index"], LISTED)).alias("block"), meta["row_index"].alias("at")]


def _list_writer(folder: str):
    def write(t: pa.Table) -> pa.Table:
        block, at, code = t.column("block")[0].as_py(), t.column("at").to_numpy(), t.column("code").to_numpy()
        order = np.argsort(at)
        out = io.BytesIO()
        np.savez_compressed(out, at=at[order], code=code[order])
        put(folder, f"rows-{block}.npz", out.getvalue())
        return pa.table({"block": pa.array([block], pa.int64())})

    return write


def listed(rows: DataFrame) -> str:
    """The folder with the lists of ``rows`` (block, at, code), one file a block that has any."""
    folder = scratch_path(rows.sparkSession, "join-lists")
    written(rows.select("block", "at", "code").groupBy("block").applyInArrow(_list_writer(folder), "block long"), "join-listed")
    return keep(folder)


class Lists:
    """Looks rows up in the lists of a folder, which are read as their blocks come."""

    def __init__(self, folder: str):
        self.fs, self.base = open_folder(folder)
        self.block, self.at, self.code = None, None, None

    def found(self, block: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, code) of every listing of every row, in the order of the rows."""
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist() + [len(block)] if len(block) else []
        rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(edges[:-1], edges[1:]):
            if block[s] != self.block:
                self._read(int(block[s]))
            last = np.searchsorted(self.at, at[s:e], side="right")
            n = last - np.searchsorted(self.at, at[s:e])
            rows.append(np.repeat(np.arange(s, e), n))
            codes.append(self.code[np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())])
        return np.concatenate(rows), np.concatenate(codes)

    def codes(self, block: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The code of every row, 0 where it isn't listed."""
        out = np.zeros(len(at), np.int64)
        rows, code = self.found(block, at)
        out[rows] = code
        return out

    def _read(self, block: int) -> None:
        path = f"{self.base}/rows-{block}.npz"
        self.block, self.at, self.code = block, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.fs.get_file_info(path).type == pafs.FileType.File:
            with self.fs.open_input_file(path) as f:
                z = np.load(io.BytesIO(f.read()))
                self.at, self.code = z["at"], z["code"]
