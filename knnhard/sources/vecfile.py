"""Raw float32 vector files as a Spark Python Data Source.

``spark.read.format("vecfile")`` reads headerless ``.bin`` files (row-major
float32, dimension from the ``dim`` option or the file name
``name-[metric]-features-samples.bin``) and ``.fbin`` files (int32 ``n``,
int32 ``dim`` header). A path may be one file or a folder of part files
(read in name order, rows numbered across them). Partitions are row ranges
(``rows_per_partition``); the options ``start`` and ``limit`` plan only the
ranges that hold the rows asked for, and each partition reads its bytes alone
and yields Arrow batches ``(id, v)``.

``df.write.format("vecfile")`` streams each task's Arrow batches to one file
of a staging folder beside the parts; ``commit`` publishes them under the names of
their first ids, so a failed job leaves nothing. With the input range-partitioned and
sorted by id (``write_vectors`` does this) the parts concatenate to the full
matrix, as there is no header; a task whose ids do not ascend is refused.
Overwriting replaces all parts of the folder, appending adds parts behind them. Paths are read and
written with Arrow's file systems: local shared folders or URIs of a store they know.
"""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "id bigint, v array<float>"


# name-[...-metric-]features-samples, samples with an optional unit
_DESCRIPTOR = re.compile(r"(?P<name>[^-]+)(?:-(?:[^-]+-)*(?P<metric>[^-]+))?-(?P<features>\d+)-(?P<number>\d+)(?P<unit>[KMB]?)", re.I)
_UNITS = {"": 1, "K": 10 ** 3, "M": 10 ** 6, "B": 10 ** 9}


def parse_name(path: str) -> tuple[str, int, int, str]:
    """``(name, samples, features, metric)`` from a file name; the metric defaults to euclidean."""
    found = _DESCRIPTOR.fullmatch(os.path.basename(path).partition(".")[0])
    if found is None:
        raise ValueError(f"cannot parse descriptor from {path!r}")
    samples = int(found["number"]) * _UNITS[found["unit"].upper()]
    return found["name"], samples, int(found["features"]), found["metric"] or "euclidean"


_PART = re.compile(r"^part-\d+\.(f?bin)$")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it, of a URI or a plain path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [info]
    return sorted((f for f in fs.get_file_info(pafs.FileSelector(path)) if _PART.match(f.base_name)), key=lambda f: f.base_name)


class _Range(InputPartition):
    def __init__(self, file: str, offset: int, start_row: int, first_id: int, count: int, dim: int):
        self.file, self.offset, self.start_row, self.first_id, self.count, self.dim = (
            file, offset, start_row, first_id, count, dim)


class VecFileReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.limit = int(options.get("limit", -1))
        self.rows_per_partition = int(options.get("rows_per_partition", 262144))
        self.dim_opt = int(options["dim"]) if "dim" in options else None

        self.start = int(options.get("start", 0))
        # Rows wanted: from the first to before the second; None: no end. They are options and no pushed filters, as Spark
        # 4.1 keeps the partitions of a pushed filter for later plans of the same frame.
        self.first, self.stop = self.start, None if self.limit < 0 else self.start + self.limit

    def _layout(self):
        out, next_id = [], 0
        fs, path = _open(self.path)
        for info in _files(fs, path):
            f, size = info.path, info.size
            if f.endswith(".fbin"):
                with fs.open_input_file(f) as fh:
                    n, dim = (int(x) for x in np.frombuffer(fh.read(8), dtype=np.int32))
                header = 8
                if size != header + 4 * n * dim:
                    raise ValueError(f"{f}: {size} bytes, but its header says {n} x {dim} values of 4 bytes")
            else:
                dim = self.dim_opt or parse_name(f if f == path else path)[2]
                header = 0
                n, rest = divmod(size, 4 * dim)
                if rest:
                    raise ValueError(f"{f}: {size} bytes are no whole number of vectors of {dim} values")
            out.append((f, header, n, dim, next_id))
            next_id += n
        return out

    def partitions(self):
        parts = []
        for f, header, n, dim, first in self._layout():
            lo = max(0, self.first - first)
            hi = n if self.stop is None else min(n, self.stop - first)
            for s in range(lo, hi, self.rows_per_partition):
                parts.append(_Range(f, header, s, first + s, min(self.rows_per_partition, hi - s), dim))
        return parts or [_Range("", 0, 0, 0, 0, 1)]

    def read(self, partition: _Range):
        if partition.count <= 0:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.file) as fh:
            fh.seek(partition.offset + partition.start_row * partition.dim * 4)
            data = np.frombuffer(fh.read(partition.count * partition.dim * 4), dtype="<f4")
        step = 65536
        for a in range(0, partition.count, step):
            b = min(partition.count, a + step)
            block = data[a * partition.dim:b * partition.dim]
            offs = np.arange(0, (b - a + 1) * partition.dim, partition.dim, dtype=np.int32)
            vals = pa.ListArray.from_arrays(pa.array(offs), pa.array(block, type=pa.float32()))
            ids = pa.array(np.arange(partition.first_id + a, partition.first_id + b, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([ids, vals], names=["id", "v"])


class _Written(WriterCommitMessage):
    def __init__(self, file: str, first: int, rows: int):
        self.file, self.first, self.rows = file, first, rows


class VecFileWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"  # of this job: the writer is made once, on the driver

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = _open(self.path)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)
        name = f"{root}/{self.staging}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}.bin"
        first = last = dim = None
        rows = 0
        with fs.open_output_stream(name) as out:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False).astype(np.int64)
                v = batch.column(batch.schema.get_field_index("v"))
                lens = np.diff(v.offsets.to_numpy())
                dim = int(lens[0]) if dim is None else dim
                if v.null_count or (lens != dim).any() or v.flatten().null_count:
                    raise ValueError("vectors to be written must be whole and of one dimension")
                if (np.diff(ids) <= 0).any() or (last is not None and ids[0] <= last):
                    raise ValueError("rows to be written must ascend by id within a task")
                first, last = (int(ids[0]) if first is None else first), int(ids[-1])
                out.write(np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), dtype="<f4").tobytes())
                rows += len(ids)
        return _Written(name, first or 0, rows)

    def commit(self, messages):
        fs, root = _open(self.path)
        held = [m for m in messages if m is not None and m.rows]
        fs.create_dir(root, recursive=True)
        old = _files(fs, root)
        if self.overwrite:
            for f in old:
                fs.delete_file(f.path)
        elif old and held and min(m.first for m in held) <= max(int(f.base_name[5:].partition(".")[0]) for f in old):
            self.abort(messages)
            raise ValueError("rows to be appended must lie behind the parts that are there")
        for m in held:
            fs.move(m.file, f"{root}/part-{m.first:020d}.bin")
        self.abort(messages)

    def abort(self, messages):
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


class VecFileDataSource(DataSource):
    @classmethod
    def name(cls):
        return "vecfile"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return VecFileReader(self.options)

    def writer(self, schema, overwrite):
        return VecFileWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(VecFileDataSource)


def read_vectors(spark, path: str, dim: int | None = None, limit: int | None = None,
                 rows_per_partition: int = 262144, start: int = 0):
    """``(id, v)`` of a file or a folder of parts: the ``limit`` rows from row ``start`` on, or all."""
    register(spark)
    r = spark.read.format("vecfile").option("path", path).option("rows_per_partition", rows_per_partition)
    if dim is not None:
        r = r.option("dim", dim)
    if limit is not None:
        r = r.option("limit", limit)
    return r.option("start", start).load()


def write_vectors(df, path: str, parts: int | None = None, mode: str = "overwrite") -> None:
    """Write ``(id, v)`` as raw float32 parts that concatenate in id order:
    range-partition by id, sort within partitions, one part per task (as many as a shuffle has, unless given).
    ``mode`` 'append' adds rows whose ids lie behind those that are there."""
    register(df.sparkSession)
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.select("id", df["v"].cast("array<float>").alias("v")).repartitionByRange(n, "id").sortWithinPartitions("id")
     .write.format("vecfile").mode(mode).option("path", path).save())


def write_fbin(df, path: str) -> None:
    """Single ``.fbin`` file (header + rows) for query sets (A2): the rows go
    through the driver, so the row count is checked first."""
    if df.count() > 1_000_000:
        raise ValueError("write_fbin is for query sets; use write_vectors for tables")
    pdf = df.select("id", df["v"].cast("array<float>").alias("v")).orderBy("id").toPandas()
    mat = np.stack([np.asarray(v, dtype="<f4") for v in pdf["v"]]) if len(pdf) else np.zeros((0, 0), "<f4")
    with open(path, "wb") as fh:
        np.array(mat.shape, dtype="<i4").tofile(fh)
        mat.tofile(fh)
