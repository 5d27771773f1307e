"""Monthly on-time files in ZIP archives (SRC-01, UDF-03), in batch and as a stream.

ZIP is not a Spark format, so Spark's ``binaryFile`` source lists the archives (their contents
are not loaded), packs the list into partitions by file size, prunes ``Year=/Month=`` folders and,
as a stream, keeps in its checkpoint which archives it has handed out. Tasks open one archive at
a time and stream its CSV into Arrow batches.

Every archive is decompressed once: its batches are held back until the last member's checksum
has been verified, so a corrupt archive contributes no rows. Only where the archive's directory
states more than ``HOLD`` bytes is it verified by a pass of its own first, which bounds memory.

The result has a row per flight, with the archive's path, and one row per corrupt archive with
its ``fault`` and nothing else. Text that doesn't parse as its column's type, storage errors and
missing columns fail the task: nothing is turned into null or lost silently. A month without
archives gives no rows; an archive without CSV members, or without rows, gives none either.
"""

from __future__ import annotations

import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

LIST_SCHEMA = "path string, modificationTime timestamp, length long, content binary, Year int, Month int"
BLOCK = 4 << 20
HOLD = 32 << 20
ROWS_PER_ARCHIVE = 250_000
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError)


def open_uri(uri: str):
    """(file system, path) for a URI from the listing."""
    from urllib.parse import urlparse

    from pyarrow import fs as pafs

    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def archive_schema(flights: T.StructType) -> T.StructType:
    return T.StructType([*flights.fields, T.StructField("archive", T.StringType()), T.StructField("fault", T.StringType())])


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])


def _member(stream, flights: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Typed batches of one CSV member; whole numbers may be written with a decimal point."""
    read = {f.name: pa.float64() if pa.types.is_integer(f.type) else f.type for f in flights}
    try:
        # Spark runs a task per core; threads of Arrow's own would read ahead and hold more blocks
        reader = pc.open_csv(stream, pc.ReadOptions(use_threads=False, block_size=BLOCK), convert_options=pc.ConvertOptions(
            column_types=read, include_columns=flights.names, null_values=[""], strings_can_be_null=True))
    except pa.ArrowInvalid as e:
        if "Empty CSV file" in str(e):
            return
        raise
    for batch in reader:
        # a fraction in a whole-number column is an error
        yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type, safe=True) for f in flights], schema=flights)


def _verified(z: zipfile.ZipFile) -> None:
    bad = z.testzip()
    if bad is not None:
        raise zipfile.BadZipFile(f"bad checksum of {bad}")


def _rows(fh, flights: pa.Schema) -> Iterator[pa.RecordBatch]:
    """All batches of an intact archive; raises one of BROKEN before the first batch otherwise."""
    if fh.size() < 22:  # less than an empty directory
        raise zipfile.BadZipFile("no archive directory")
    z = zipfile.ZipFile(fh)
    members = [m for m in z.infolist() if m.filename.lower().endswith(".csv")]
    if sum(m.file_size for m in members) > HOLD:
        _verified(z)
        for m in members:
            with z.open(m) as stream:
                yield from _member(stream, flights)
        return
    held = []
    for m in members:
        with z.open(m) as stream:
            try:
                held += _member(stream, flights)
                while stream.read(BLOCK):  # to the end, where the checksum is compared
                    pass
            except pa.ArrowInvalid:
                while stream.read(BLOCK):  # damaged bytes are a fault of the archive, not of the text
                    pass
                raise
    yield from held


def decoder(schema: T.StructType):
    """The function of ``mapInArrow`` from archive paths to ``archive_schema(schema)``."""
    flights, full = _arrow(schema), _arrow(archive_schema(schema))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                filesystem, path = open_uri(uri)
                with filesystem.open_input_file(path) as fh:
                    try:
                        for b in _rows(fh, flights):
                            extra = [pa.array([uri] * b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.string())]
                            yield pa.RecordBatch.from_arrays([*b.columns, *extra], schema=full)
                    except BROKEN as e:
                        row = [pa.nulls(1, f.type) for f in flights]
                        yield pa.RecordBatch.from_arrays([*row, pa.array([uri]), pa.array([f"{type(e).__name__}: {e}"])], schema=full)
    return decode


def read_archives(spark: SparkSession, path: str, schema: T.StructType, year: int | None = None,
                  month: int | None = None) -> DataFrame:
    """Flights and faults of all archives below ``path``, or of one year or month (pruned folders)."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").schema(LIST_SCHEMA).load(path)
    if year is not None:
        listed = listed.where(F.col("Year") == year)
    if month is not None:
        listed = listed.where(F.col("Month") == month)
    return listed.select("path").mapInArrow(decoder(schema), archive_schema(schema))


def stream_archives(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 200) -> DataFrame:
    """The same as a stream: each archive once, when it has landed (archives appear by rename)."""
    listed = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.zip").schema(LIST_SCHEMA) \
        .option("maxFilesPerTrigger", files_per_batch).load(path)
    return listed.select("path").mapInArrow(decoder(schema), archive_schema(schema))


# ------------------------------------------------------------ landing
def _writer(path: str, names: list[str]):
    """One archive per run of rows of one month and salt; the rows arrive sorted."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        pid, attempt = (ctx.partitionId(), ctx.attemptNumber()) if ctx else (0, 0)
        filesystem, root = pafs.FileSystem.from_uri(path)
        month, rows, open_ = None, 0, []
        tmp = final = ""

        def close() -> pa.RecordBatch:
            for x in reversed(open_):
                x.close()
            filesystem.move(tmp, final)
            return pa.RecordBatch.from_pydict({"Year": [month[0]], "Month": [month[1]], "rows": [rows]},
                                              pa.schema([("Year", pa.int32()), ("Month", pa.int32()), ("rows", pa.int64())]))

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("Year", "Month", "_salt")], strict=True))
            at = 0
            while at < len(keys):
                key, end = keys[at], at + 1
                while end < len(keys) and keys[end] == key:
                    end += 1
                if key != month:
                    if month is not None:
                        yield close()
                    month, rows = key, 0
                    d = f"{root}/Year={key[0]}/Month={key[1]}"
                    filesystem.create_dir(d, recursive=True)
                    # one name per partition, month and salt, which fix the rows: a retried or speculative
                    # attempt replaces the file instead of adding a duplicate; written under another
                    # name, then moved
                    name = f"part-{pid:05d}-{key[2]}.zip"
                    final = f"{d}/{name}"
                    tmp = f"{d}/.{name}.{attempt}-{uuid.uuid4().hex[:6]}"
                    sink = filesystem.open_output_stream(tmp)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                    member = archive.open(f"On_Time_{key[0]}_{key[1]}.csv", "w", force_zip64=True)
                    out = pc.CSVWriter(member, pa.schema([batch.schema.field(n) for n in names]),
                                       write_options=pc.WriteOptions(quoting_style="needed"))
                    open_ = [sink, archive, member, out]
                out.write_batch(batch.select(names).slice(at, end - at))
                rows += end - at
                at = end
        if month is not None:
            yield close()
    return write


def land_archives(df: DataFrame, path: str, names: list[str], rows_per_archive: int = ROWS_PER_ARCHIVE) -> DataFrame:
    """Write ZIP'd monthly CSV archives of about ``rows_per_archive`` rows; rows are dealt out by
    month and a salt as wide as the month's rows ask for, so a month is as many tasks as it needs;
    months and salts that meet in a task keep archives of their own. Rows must name their year and
    month."""
    months = df.groupBy("Year", "Month").agg(F.count(F.lit(1)).alias("_n"))
    salts = F.ceil(F.col("_n") / F.lit(rows_per_archive)).cast("int")
    # a row per month, sent to the flights: they are shuffled once, for the archives
    d = df.join(F.broadcast(months), ["Year", "Month"]).withColumn("_salt", F.pmod(F.xxhash64(*names), salts))
    d = d.repartition("Year", "Month", "_salt").select(*names, "_salt").sortWithinPartitions("Year", "Month", "_salt")
    return d.mapInArrow(_writer(path, names), "Year int, Month int, rows long")
