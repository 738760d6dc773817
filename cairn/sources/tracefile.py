"""Flat binary trace files, read in parts that begin and end at record bounds.

``spark.read.format("flat_records").option("path", folder).load()`` gives
(path, at, record): the file, the record's number in it and its bytes. Files
are cut every ``split`` bytes (option, 16 MB), rounded to whole records of
``size`` bytes (option), so one file is read by several tasks. What follows the
last whole record of a file is given too, as a shorter record: decoding leaves
it out and counts it. Paths are those of any store that Arrow opens (local,
HDFS, S3, GCS); files whose names begin with ``_`` or ``.`` are none.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.sources.packages import RECORD

#: Records in one Arrow batch.
BATCH = 4096


def opened(path: str):
    """A store and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class Part(InputPartition):
    """Records first..end of a file of ``length`` bytes."""

    def __init__(self, path: str, first: int, end: int, length: int):
        self.path, self.first, self.end, self.length = path, first, end, length


class FlatRecordsReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("size", RECORD))
        self.each = max(1, int(options.get("split", 16 << 20)) // self.size)

    def partitions(self):
        from pyarrow import fs

        store, path = opened(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Part(p, a, min(a + self.each, records), size) for p, size in files for records in [-(-size // self.size)] for a in range(0, records, self.each)]

    def read(self, part):
        if part is None:  # no file has a record
            return
        store, _ = opened(self.path)
        with store.open_input_file(part.path) as file:
            for a in range(part.first, part.end, BATCH):
                b = min(a + BATCH, part.end)
                file.seek(a * self.size)
                data = file.read(min(b * self.size, part.length) - a * self.size)
                records = [data[k : k + self.size] for k in range(0, len(data), self.size)]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(records)), pa.array(range(a, b), pa.int64()), pa.array(records, pa.binary())], ["path", "at", "record"])


class FlatRecords(DataSource):
    @classmethod
    def name(cls):
        return "flat_records"

    def schema(self):
        return "path string, at long, record binary"

    def reader(self, schema):
        return FlatRecordsReader(self.options)


def records(spark: SparkSession, path: str, split: int = 16 << 20, size: int = RECORD) -> DataFrame:
    """(path, at, record) of the trace files of a folder."""
    spark.dataSource.register(FlatRecords)
    return spark.read.format("flat_records").option("path", path).option("split", split).option("size", size).load()


def write_flat(rows: DataFrame, path: str, name: str = "first") -> None:
    """Write sorted ``rows`` (``name``: a number, record) as one flat file for each partition, named after its first number; what recorders do."""

    def run(batches):
        file = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                store, folder = opened(path)
                store.create_dir(folder, recursive=True)
                file = store.open_output_stream(f"{folder}/{batch.column(name)[0].as_py():020d}.bin")
            for record in batch.column("record"):
                file.write(record.as_py())
        if file is not None:
            file.close()
        yield from ()

    rows.select(name, "record").mapInArrow(run, "done boolean").collect()
