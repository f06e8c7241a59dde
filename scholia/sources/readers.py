"""Readers for tables, text, JSON, log and binary files."""

from __future__ import annotations

import _hashlib
import ctypes
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.text import rstrip
from scholia.session import scratch_path
from scholia.sources.tables import NAMES, Tables


def scan(tables: Tables, name: str, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of a catalogued table."""
    if name not in NAMES:
        raise ValueError(f"unknown table {name}")
    return getattr(tables, name).orderBy(*order).offset(offset).limit(limit)


def catalog(tables: Tables) -> DataFrame:
    """Names of the Parquet tables in the folder, from the files that are there; a table is one file or a folder of files."""
    files = tables.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tables.sf_dir).select("path")
    below = re.escape(tables.sf_dir.rstrip("/").rsplit("/", 1)[-1]) + r"/([^/]+)\.parquet(?:/|$)"
    return files.select(F.regexp_extract("path", below, 1).alias("table_name")).filter("table_name <> ''").distinct().orderBy("table_name")


def jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, n: int, **options: str) -> DataFrame:
    """Parallel read of a database table, one range of the key per task; filters are pushed to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower),
                                               upperBound=str(upper), numPartitions=str(n), fetchsize="10000", pushDownPredicate="true")
    return reader.options(**options).load()


def stem(path: Column) -> Column:
    """File name without folders and ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole text."""
    return (spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def json_column(df: DataFrame, id_col: str, col: str, schema: str) -> DataFrame:
    return df.select(id_col, F.from_json(col, schema).alias("parsed"))


REPORT = "timestamp string, summary struct<files_processed:bigint,average_score:double>, _bad string"


def reports(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Run reports from JSON files; unreadable ones are skipped."""
    raw = spark.read.schema(REPORT).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", multiLine=multi_line)
    return raw.filter(F.col("_bad").isNull()).select("timestamp", "summary.*")


CORRECTIONS = ("file string, corrections array<struct<type:string,`from`:string,`to`:string,line:bigint,text:string,image_path:string>>")


def corrections(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Correction files with their list unrolled."""
    return (spark.read.schema(CORRECTIONS).json(path, multiLine=multi_line)
            .select("file", F.explode("corrections").alias("c")).select("file", "c.*"))


LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d+)\s+\[(\w+)\]\s+([\w\.]+):\s+(.*)"


def parse_log(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``ts [LEVEL] logger: message``; a line of another shape is kept as the message alone."""
    line = rstrip("value")
    ok = line.rlike(LOG_LINE)
    part = lambda i: F.when(ok, F.regexp_extract(line, LOG_LINE, i))
    return lines.select(*(keep or []), part(1).alias("timestamp"), part(2).alias("level"), part(3).alias("logger"),
                        F.when(ok, F.regexp_extract(line, LOG_LINE, 4)).otherwise(line).alias("message"))


def log_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw lines of several logs with the file each came from."""
    return spark.read.option("recursiveFileLookup", "true").text(paths).select(
        "value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1).alias("source"))


def entity_trail(lines: DataFrame, entity_id: str, limit: int = 200) -> DataFrame:
    """Newest lines of any log that name an entity, without access noise, oldest first."""
    hits = lines.filter(F.col("value").contains(entity_id) & ~F.col("value").contains("uvicorn.access"))
    p = parse_log(hits, ["source"])
    bad = F.col("timestamp").isNull()
    p = p.withColumn("level", F.when(bad, "INFO").otherwise(F.col("level"))).withColumn("logger", F.when(bad, F.col("source")).otherwise(F.col("logger")))
    order = [F.coalesce("timestamp", F.lit("")), F.col("source"), F.col("message")]
    return p.orderBy(*[c.desc() for c in order]).limit(limit).orderBy(*order)


def search_log(lines: DataFrame, needle: str) -> DataFrame:
    cols = ["timestamp", "level", "logger", "message"]
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return lines.filter(hit)


def file_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Names and sizes, newest first; the content column is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return (files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size_bytes"),
                         F.col("modificationTime").alias("modified_at")).orderBy(F.col("modified_at").desc(), "name"))


#: Files up to ``WHOLE`` bytes are hashed as one value; of longer ones ``TURN`` bytes at a time, and Spark's splits should not be longer.
WHOLE, TURN = 512 << 20, 256 << 20
#: Bytes are stored in runs of at most so many, and sent to Python in batches of so many lines or runs.
RUN, ROWS = 256 << 10, 500
#: Spark's line reader would unpack these.
PACKED = r"(?i)[.](gz|bz2|deflate|snappy|lz4|zst|zstd|xz|passthrough)$"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """MD5 of each file. Long files are read in splits, and their digest goes on from task to task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    long = (F.col("_metadata.file_size") > WHOLE) & ~F.col("_metadata.file_path").rlike(PACKED)  # known without reading a file
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    digests = files.filter(~long).select(name.alias("path"), F.md5("content").alias("md5"))
    names = {r.file: r for r in files.filter(long).select(F.col("_metadata.file_path").alias("file"), name.alias("name"), "length").collect()}
    if not names:
        return digests
    found = _long_digests(spark, path, glob, {file: r.length for file, r in names.items()})
    return digests.unionByName(spark.createDataFrame([(names[file].name, md5) for file, md5 in found.items()], "path string, md5 string"))


def _long_digests(spark: SparkSession, path: str, glob: str, sizes: dict[str, int]) -> dict[str, str]:
    """File: digest, for files of the given sizes. Spark reads their bytes as lines, in its splits; these are stored in runs by the turn in which they are hashed,
    and each turn takes up the digests' states where the one before left them, so no task reads more than a turn of each of its files."""
    lines = spark.read.option("pathGlobFilter", glob).text(path, lineSep="\n").filter(F.col("_metadata.file_path").isin(*sizes))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    at, schema, rows = scratch_path(spark, "bytes"), "file string, block bigint, no bigint, size bigint, bytes binary", spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, ROWS)
    try:
        lines.mapInArrow(line_runs, schema).withColumn("turn", F.expr(f"block div {TURN}").cast("int")).write.partitionBy("turn").parquet(at)
        runs = spark.read.schema(schema + ", turn int").parquet(at)
        totals = {r.file: r for r in runs.groupBy("file").agg(F.sum("size").alias("size"), F.max("turn").alias("turn")).collect()}
        # A byte order mark at the start was left out; a line end after the last line may be too many.
        marked = {file for file, r in totals.items() if sizes[file] - r.size >= 2}
        states: dict[str, tuple[int, bytes]] = {}
        for turn in range(max(r.turn for r in totals.values()) + 1):
            step = runs.filter(F.col("turn") == turn).select("file", "block", "no", "bytes").repartition("file").sortWithinPartitions("file", "block", "no")
            done = step.mapInArrow(digest_step(sizes, marked, states), "file string, done bigint, state binary")
            states |= {r.file: (r.done, bytes(r.state)) for r in done.collect()}
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    if {file: done for file, (done, _) in states.items()} != sizes:
        raise RuntimeError("files changed while they were read")
    return {file: Md5(state).hexdigest() for file, (_, state) in states.items()}


def line_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, value) in their order as runs of bytes, numbered within each block."""
    last, no = None, 0
    for batch in batches:
        files, blocks, lines = (c.to_pylist() for c in batch.columns)
        for key, group in itertools.groupby(range(len(lines)), lambda i: (files[i], blocks[i])):
            no = no + 1 if key == last else 0
            last, run = key, b"".join([lines[i] + b"\n" for i in group])
            parts = [run[i:i + RUN] for i in range(0, len(run), RUN)]
            for no, part in enumerate(parts, no):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, no, len(part))] + [pa.array([part], pa.binary())], ["file", "block", "no", "size", "bytes"])


def digest_step(sizes: dict[str, int], marked: set[str], states: dict[str, tuple[int, bytes]]):
    """A function that takes sorted runs and gives each file's bytes done and state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if Md5(Md5().update(b"a").state()).update(b"b").hexdigest() != hashlib.md5(b"ab", usedforsecurity=False).hexdigest():
            raise RuntimeError("the library keeps the state of an MD5 in another form")
        now: dict[str, tuple[int, Md5]] = {}
        for batch in batches:
            for file, part in zip(batch.column(0).to_pylist(), batch.column(3)):
                if file not in now:
                    done, state = states.get(file, (0, None))
                    now[file] = done, Md5(state)
                    if not done and file in marked:
                        now[file] = 3, now[file][1].update(b"\xef\xbb\xbf")
                done, md5 = now[file]
                part = part.as_py()[:sizes[file] - done]
                now[file] = done + len(part), md5.update(part)
        done, state = [d for d, _ in now.values()], [m.state() for _, m in now.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(now), pa.string()), pa.array(done, pa.int64()), pa.array(state, pa.binary())], ["file", "done", "state"])

    return run


class Md5:
    """An MD5 whose state can be handed on, as the one of ``hashlib`` can not: by the library that Python itself hashes with."""

    def __init__(self, state: bytes | None = None) -> None:
        self.library, self.context = ctypes.CDLL(_hashlib.__file__), ctypes.create_string_buffer(state or bytes(92), 92)
        if state is None:
            self.library.MD5_Init(self.context)

    def update(self, data: bytes) -> "Md5":
        self.library.MD5_Update(self.context, data, ctypes.c_size_t(len(data)))
        return self

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        digest = ctypes.create_string_buffer(16)
        self.library.MD5_Final(digest, ctypes.create_string_buffer(self.context.raw, 92))
        return digest.raw.hex()
