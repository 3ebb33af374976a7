"""One read path and one write path for every supported format."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tabwright.functions import convert
from tabwright.operators import logs
from tabwright.session import cut_lineage
from tabwright.sources import records, splits

# File extensions of each format.
EXTENSIONS = {
    "csv": ("csv", "txt"),
    "tsv": ("tsv",),
    "parquet": ("parquet", "pq"),
    "feather": ("feather", "arrow", "ipc"),
    "json": ("json",),
    "jsonl": ("jsonl", "ndjson"),
    "xml": ("xml",),
    "ofx": ("ofx", "qfx"),
    "qif": ("qif",),
    "ical": ("ics", "ical"),
    "vcard": ("vcf", "vcard"),
    "log": ("log",),
    "excel": ("xlsx", "xls"),
    "yaml": ("yaml", "yml"),
    "toml": ("toml",),
}
NOT_READ = ("excel", "yaml", "toml")
DELIMITERS = (",", ";", "\t", "|")
DETECTION_BYTES = 8192
#: Bytes of Arrow record batches that one task reads, about.
ARROW_BYTES = 64 << 20
HEALTH_DATES = ("startDate", "endDate", "creationDate")


@dataclass(frozen=True)
class ReadOptions:
    """``schema`` turns inference off; ``text_column`` names the raw text for record formats."""

    delimiter: str | None = None
    has_header: bool = True
    skip_rows: int = 0
    encoding: str = "UTF-8"
    null_values: tuple[str, ...] = convert.NULL_MARKERS
    sample_rows: int | None = None
    schema: T.StructType | str | None = None
    record_key: str | None = None
    xml_record_tag: str | None = None
    log_pattern: str | None = None
    infer: bool = True
    multiline: bool = False  # quoted line breaks; such files cannot be split


@dataclass(frozen=True)
class WriteOptions:
    delimiter: str = ","
    include_header: bool = True
    compression: str | None = None
    rows_per_file: int | None = None
    mode: str = "errorifexists"
    partition_by: tuple[str, ...] = field(default_factory=tuple)


def detect_format(path: str) -> str:
    extension = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    for name, known in EXTENSIONS.items():
        if extension in known:
            return name
    raise ValueError(f"unsupported file format: .{extension}")


def read_any(spark: SparkSession, path: str, fmt: str | None = None, options: ReadOptions | None = None, **given) -> DataFrame:
    """Read ``path`` (a file, folder or glob) by its extension or the given format."""
    options = replace(options or ReadOptions(), **given)
    fmt = fmt or detect_format(path)
    if fmt not in READERS:
        raise ValueError(f"no reader for {fmt}")
    df = READERS[fmt](spark, path, options)
    return df.limit(options.sample_rows) if options.sample_rows else df


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent candidate in the first bytes of the first file by name; the earlier one on ties."""
    files = sorted(spark.read.text(path).inputFiles())
    # as many lines as these bytes can hold at most
    lines = spark.read.text(files[0]).limit(DETECTION_BYTES).select(F.substring("value", 1, DETECTION_BYTES)) if files else None
    sample = "\n".join(r[0] for r in (lines.collect() if files else []))[:DETECTION_BYTES]
    return max(DELIMITERS, key=sample.count)


def read_csv(spark: SparkSession, path: str, options: ReadOptions) -> DataFrame:
    """All columns as text, then null markers, then the narrowest type that fits every row."""
    sep = options.delimiter or detect_delimiter(spark, path)
    reader = spark.read.option("sep", sep).option("encoding", options.encoding).option("mode", "PERMISSIVE")
    reader = reader.option("multiLine", options.multiline).option("quote", '"').option("escape", '"')
    reader = reader.option("header", options.has_header and not options.skip_rows)
    if options.schema is not None:
        if options.skip_rows:
            raise ValueError("skip_rows cannot be combined with a schema")
        # the markers are not valid numbers, so PERMISSIVE parsing already turns them into nulls
        return convert.null_markers(reader.schema(options.schema).csv(path), markers=options.null_values)
    df = _skipped(spark, path, sep, options) if options.skip_rows else reader.option("inferSchema", False).csv(path)
    if options.sample_rows:
        df = df.limit(options.sample_rows)
    df = convert.null_markers(df, markers=options.null_values)
    return convert.infer_types(df) if options.infer else df


def _skipped(spark: SparkSession, path: str, sep: str, options: ReadOptions) -> DataFrame:
    """Drop the first lines of every file. Files are still split: only lines of a file's first block are counted."""
    lines = spark.read.option("encoding", options.encoding).text(path)
    lines = lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # consecutive within a block, as a task reads it in order
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    start_of = lines.groupBy("file").agg(F.min(F.when(F.col("block") == 0, F.col("at"))).alias("begin"))
    place = F.when(F.col("block") == 0, F.col("at") - F.col("begin")).otherwise(F.lit(2**62))
    lines = lines.join(start_of, "file").select("file", "line", place.alias("pos"))
    head = lines.filter(F.col("pos") == options.skip_rows).agg(F.min_by("line", "file")).first()
    if head is None or head[0] is None:
        return spark.createDataFrame([], T.StructType())
    first = head[0]
    names = next(iter(_split_line(first, sep)))
    if not options.has_header:
        names = [f"column_{i + 1}" for i in range(len(names))]
    start = options.skip_rows + (1 if options.has_header else 0)
    body = lines.filter((F.col("pos") >= start) & (F.length("line") > 0)).select("line")
    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = F.from_csv("line", quoted, {"sep": sep, "escape": '"'})
    return body.select(parsed.alias("r")).select("r.*")


def _split_line(line: str, sep: str) -> Iterator[list[str]]:
    import csv

    yield from csv.reader([line], delimiter=sep)


def read_tsv(spark: SparkSession, path: str, options: ReadOptions) -> DataFrame:
    return read_csv(spark, path, replace(options, delimiter=options.delimiter or "\t"))


def read_parquet(spark: SparkSession, path: str, options: ReadOptions) -> DataFrame:
    reader = spark.read if options.schema is None else spark.read.schema(options.schema)
    return reader.parquet(path)


def read_json(spark: SparkSession, path: str, options: ReadOptions) -> DataFrame:
    """An array of records, an object holding one array of records, or one record per document."""
    reader = spark.read.option("multiLine", True).option("encoding", options.encoding)
    df = (reader if options.schema is None else reader.schema(options.schema)).json(path)
    lists = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
    ]
    key = options.record_key
    if key is None:
        if not lists:
            return df
        if len(lists) > 1:
            raise ValueError(f"several record lists ({', '.join(lists)}): pass record_key")
        key = lists[0]
    return df.select(F.inline(F.col(key)))


def read_jsonl(spark: SparkSession, path: str, options: ReadOptions) -> DataFrame:
    reader = spark.read if options.schema is None else spark.read.schema(options.schema)
    return reader.json(path)


def read_feather(spark: SparkSession, path: str, options: ReadOptions) -> DataFrame:
    """Arrow IPC files by record batch: runs of batches of about ``ARROW_BYTES`` are tasks of their own.

    Tasks read the footers, and then only their batches. A file system that Arrow does not know is read by Spark, where
    a file is one row of a task, 2 GB at most.
    """
    # the listing has the content only where it is asked for
    found = spark.read.format("binaryFile").load(path)
    try:
        for name in found.inputFiles()[:1]:
            arrow_place(name)
    except (ValueError, OSError, pa.ArrowException):
        return _read_feather_whole(spark, found, path, options)
    schema, most = options.schema, ARROW_BYTES

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                files, place = arrow_place(name)
                with files.open_input_file(place) as source, pa.ipc.open_file(source) as reader:
                    n = reader.num_record_batches
                    step = max(1, n * most // max(length, 1))
                    low = list(range(0, n, step)) or [0]
                    high = [min(x + step, n) for x in low]
                    described = [reader.schema.serialize().to_pybytes()] * len(low)
                    arrays = [pa.array([name] * len(low)), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(described, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["path", "low", "high", "schema"])

    parts = cut_lineage(found.select("path", "length").mapInArrow(footers, "path string, low int, high int, schema binary"))
    if schema is None:
        first = parts.orderBy("path", "low").select("schema").first()
        if first is None:
            raise ValueError(f"no files in {path}")
        schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(first[0]))))
    count = parts.where("high > low").count()

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, low, high in zip(*(batch.column(c).to_pylist() for c in ("path", "low", "high")), strict=True):
                files, place = arrow_place(name)
                with files.open_input_file(place) as source, pa.ipc.open_file(source) as reader:
                    for i in range(low, high):
                        yield reader.get_batch(i)

    # one task for each run of batches
    spread = parts.where("high > low").select("path", "low", "high").repartitionByRange(max(1, count), "path", "low")
    return spread.mapInArrow(batches_of, schema)


def arrow_place(uri: str):
    """Arrow's file system of a qualified path, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        raise ValueError(f"{uri} names no file system")
    return fs.FileSystem.from_uri(uri)


def _read_feather_whole(spark: SparkSession, found: DataFrame, path: str, options: ReadOptions) -> DataFrame:
    if options.schema is None:

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column("content"):
                    with _ipc(content.as_py()) as reader:
                        yield pa.RecordBatch.from_arrays([pa.array([reader.schema.serialize().to_pybytes()])], ["schema"])

        first = found.select("content").limit(1).mapInArrow(describe, "schema binary").first()
        if first is None:
            raise ValueError(f"no files in {path}")
        schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(first[0]))))
    else:
        schema = options.schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with _ipc(content.as_py()) as reader:
                    for i in range(reader.num_record_batches):
                        yield reader.get_batch(i)

    return found.select("content").mapInArrow(parse, schema)


def _ipc(content: bytes) -> pa.ipc.RecordBatchFileReader:
    return pa.ipc.open_file(pa.py_buffer(content))


def read_xml(spark: SparkSession, path: str, options: ReadOptions) -> DataFrame:
    """Attributes and child texts of the record elements as columns."""
    tag = options.xml_record_tag or detect_xml_tag(spark, path)
    if tag in ("Record", "Workout"):
        return read_health(spark, path, tag)
    reader = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "")
    df = (reader if options.schema is None else reader.schema(options.schema)).load(path)
    return df.drop("_VALUE")


def detect_xml_tag(spark: SparkSession, path: str) -> str:
    """The most frequent element directly under the root, counted over the whole input.

    Tasks read the pieces of files between ``<``, each with one whole tag, and report how many elements open at which depth within their
    block; the depths of the blocks before it are added in Spark, so large files are split. A comment or CDATA
    section that holds tags and runs over the border of two blocks is not recognised in the second.
    """
    pieces = spark.read.option("lineSep", "<").text(path)
    # a task reads its blocks one after the other, each in order
    pieces = pieces.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    found = pieces.mapInArrow(_count_elements, "file string, block long, depth int, name string, n long, net int")
    found = found.persist()
    ends = found.where("name is null").select("file", "block", "net")
    before = F.coalesce(F.sum("net").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select("file", "block", before.alias("start"))
    placed = found.where("name is not null").drop("net").join(starts, ["file", "block"]).withColumn("at", F.col("depth") + F.col("start"))
    rows = placed.where("at between 0 and 1").groupBy("at", "name").agg(F.sum("n").alias("n")).collect()
    found.unpersist()
    counts = {r["name"]: r["n"] for r in rows if r["at"] == 1}
    roots = {r["name"] for r in rows if r["at"] == 0}
    if not counts:
        raise ValueError("could not detect the record element: pass xml_record_tag")
    for health in ("Record", "Workout"):
        if health in counts and (health == "Record" or "HealthData" in roots):
            return health
    return min(counts, key=lambda n: (-counts[n], n))


def _count_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements opened by depth and name of each block, and a row without a name with the block's net depth."""
    import re

    tag = re.compile(r"(/?)([^\s<>/!?]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
    ends = {"!--": "-->", "![CDATA[": "]]>", "?": "?>"}
    names = ["file", "block", "depth", "name", "n", "net"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32()]
    here, depth, counts, until = None, 0, {}, ""

    def rows():
        out = [(*here, d, name, n, 0) for (d, name), n in counts.items()] + [(*here, 0, None, 0, depth)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    for batch in batches:
        for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, block) != here:
                if here is not None:
                    yield rows()
                here, depth, counts, until = (file, block), 0, {}, ""
            # inside a comment, a CDATA section or an instruction nothing counts
            until = until or next((end for mark, end in ends.items() if value.startswith(mark)), "")
            if until:
                until = "" if until in value else until
            elif found := tag.match(value):
                if found[1]:
                    depth -= 1
                else:
                    counts[depth, found[2]] = counts.get((depth, found[2]), 0) + 1
                    depth += not found[3].endswith("/")
    if here is not None:
        yield rows()


def read_health(spark: SparkSession, path: str, tag: str = "Record") -> DataFrame:
    """Health export rows as text; the dates lose their time zone and keep the wall-clock time."""
    inferred = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "").load(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in inferred.fields if f.name != "_VALUE"])
    df = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "").schema(schema).load(path)
    if tag != "Record":
        return df
    return df.select(*[F.substring(c, 1, 19).alias(c) if c in HEALTH_DATES else F.col(c) for c in df.columns])


def _documents(spark: SparkSession, path: str, options: ReadOptions) -> DataFrame:
    return spark.read.format("text").option("wholetext", True).option("encoding", options.encoding).load(path)


def _record_reader(kind: str):
    def read(spark: SparkSession, path: str, options: ReadOptions) -> DataFrame:
        if options.encoding.lower() in splits.SPLITTABLE:
            documents = splits.record_documents(spark, path, kind, options.encoding)
        else:
            documents = _documents(spark, path, options)
        return getattr(records, kind)(documents, "value").drop("position")

    return read


def read_log(spark: SparkSession, path: str, options: ReadOptions) -> DataFrame:
    """A custom pattern with named groups, else a known format, else the numbered lines."""
    lines = spark.read.option("encoding", options.encoding).text(path)
    if options.log_pattern:
        return logs.named_groups(lines, "value", options.log_pattern)
    kind = logs.detect_format(lines, "value")
    if kind:
        return logs.parse_lines(lines, "value", kind)
    if options.encoding.lower() in splits.SPLITTABLE:
        numbered = splits.numbered_lines(spark, path, options.encoding)
    else:
        whole = _documents(spark, path, options)
        # the line end of the last line starts no further line
        numbered = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("pos", "line"))
        numbered = numbered.select((F.col("pos") + 1).cast("long").alias("line_number"), "line")
    return numbered.select("line_number", F.trim("line").alias("content"))


READERS = {
    "csv": read_csv,
    "tsv": read_tsv,
    "parquet": read_parquet,
    "json": read_json,
    "jsonl": read_jsonl,
    "feather": read_feather,
    "xml": read_xml,
    "ofx": _record_reader("ofx"),
    "qif": _record_reader("qif"),
    "ical": _record_reader("ical"),
    "vcard": _record_reader("vcard"),
    "log": read_log,
}


def parse_binary(df: DataFrame, content: str, fmt: str, schema: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows out of a binary column (uploaded files): CSV and JSON need a schema, record formats do not."""
    text = F.decode(F.col(content), "UTF-8")
    named = df.select(*keep, text.alias("__text"))
    if fmt in ("ofx", "qif", "ical", "vcard"):
        return getattr(records, fmt)(named, "__text", keep)
    if schema is None:
        raise ValueError(f"{fmt} content needs a schema")
    if fmt == "csv":
        lines = named.select(*keep, F.posexplode(F.split("__text", "\r?\n")).alias("__pos", "__line"))
        body = lines.filter((F.col("__pos") > 0) & (F.length("__line") > 0))
        return body.select(*keep, F.from_csv("__line", schema).alias("__r")).select(*keep, "__r.*")
    if fmt == "jsonl":
        lines = named.select(*keep, F.explode(F.split("__text", "\n")).alias("__line")).filter(F.length("__line") > 0)
        return lines.select(*keep, F.from_json("__line", schema).alias("__r")).select(*keep, "__r.*")
    if fmt == "json":
        body = F.trim("__text")
        as_list = F.when(F.startswith(body, F.lit("[")), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
        return named.select(*keep, F.inline(F.from_json(as_list, f"array<struct<{schema}>>")))
    raise ValueError(f"no content parser for {fmt}")


def file_listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Path, name, size and modification time; the contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size_bytes"),
        F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb"),
        "modificationTime",
    )


def file_info(spark: SparkSession, path: str, **given) -> DataFrame:
    """Format, size and columns: the footer for parquet, a five-row read otherwise."""
    fmt = detect_format(path)
    options = {} if fmt == "parquet" else {"sample_rows": 5}
    schema = read_any(spark, path, fmt, **{**options, **given}).schema
    size = file_listing(spark, path).agg(F.sum("size_bytes")).first()[0]
    rows = [(path, fmt, size, len(schema), f.name, f.dataType.simpleString()) for f in schema.fields]
    return spark.createDataFrame(
        rows, "path string, format string, size_bytes long, num_columns int, column string, dtype string"
    )


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def content_groups(df: DataFrame, content: str, key: str) -> DataFrame:
    """Rows with equal content: the lowest key to keep and the number of copies.

    Only the 64-character digest is shuffled, and copies are combined before the shuffle.
    """
    out = df.select(checksum(F.col(content)).alias("checksum"), key).groupBy("checksum")
    return out.agg(
        F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("copies"), (F.count(F.lit(1)) - 1).alias("extra_copies")
    )


# --- writers -----------------------------------------------------------------------------------


def write_any(df: DataFrame, path: str, fmt: str | None = None, options: WriteOptions | None = None, **given) -> None:
    options = replace(options or WriteOptions(), **given)
    fmt = fmt or detect_format(path)
    if fmt not in WRITERS:
        raise ValueError(f"no writer for {fmt}")
    WRITERS[fmt](df, path, options)


def _writer(df: DataFrame, options: WriteOptions, default: str | None = None):
    writer = df.write.mode(options.mode)
    if options.compression or default:
        writer = writer.option("compression", options.compression or default)
    if options.rows_per_file:
        writer = writer.option("maxRecordsPerFile", options.rows_per_file)
    return writer.partitionBy(*options.partition_by) if options.partition_by else writer


def write_csv(df: DataFrame, path: str, options: WriteOptions) -> None:
    # a quote inside a field is doubled, as the reader expects
    writer = _writer(df, options).option("sep", options.delimiter).option("header", options.include_header)
    # blanks at the ends of a value belong to it
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("escape", '"').option("emptyValue", "").csv(path)


def write_tsv(df: DataFrame, path: str, options: WriteOptions) -> None:
    write_csv(df, path, replace(options, delimiter="\t"))


def write_parquet(df: DataFrame, path: str, options: WriteOptions) -> None:
    _writer(df, options, "snappy").parquet(path)


def write_jsonl(df: DataFrame, path: str, options: WriteOptions) -> None:
    _writer(df, options).option("ignoreNullFields", False).json(path)


def write_json(df: DataFrame, path: str, options: WriteOptions) -> None:
    """One JSON array per output file: each task streams its own rows between brackets."""
    if options.rows_per_file or options.partition_by:
        raise ValueError("json writes one array for each task: repartition the table instead")

    def bracket(batches):
        import pandas as pd

        first = True
        for pdf in batches:
            if len(pdf):
                lines = "," + pdf["value"]
                if first:
                    lines.iloc[0] = "[" + pdf["value"].iloc[0]
                    first = False
                yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    writer = rows.mapInPandas(bracket, "value string").write.mode(options.mode).option("maxRecordsPerFile", 0)
    if options.compression:
        writer = writer.option("compression", options.compression)
    writer.text(path)


def write_feather(df: DataFrame, path: str, options: WriteOptions) -> None:
    """One Arrow IPC file per partition in a folder every executor can reach."""
    codec = options.compression or "zstd"
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target) and options.mode != "overwrite":
        raise ValueError(f"{path} exists")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    # written aside: the old files go only when the new ones are whole, so a table may replace what it reads
    aside = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"))
    # driver and tasks write by one name, scheme included; one that Arrow cannot write to is refused here
    folder = aside.toString()
    arrow_place(folder)
    fs.mkdirs(aside)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = arrow_place(folder)
        context = TaskContext.get()
        part = context.partitionId()
        # attempts write apart and the finished file is moved into place
        temp = f"{base}/_part-{part:05d}-{context.taskAttemptId()}.tmp"
        rows = 0
        with files.open_output_stream(temp) as out:
            with pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as writer:
                for batch in batches:
                    writer.write_batch(pa.RecordBatch.from_arrays(batch.columns, schema=schema))
                    rows += batch.num_rows
        files.move(temp, f"{base}/part-{part:05d}.arrow")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows], pa.int64())], ["part", "rows"])

    try:
        df.mapInArrow(save, "part int, rows long").agg(F.sum("rows")).collect()
        for left in fs.listStatus(aside):
            if left.getPath().getName().startswith("_part-"):
                fs.delete(left.getPath(), False)
    except BaseException:
        fs.delete(aside, True)
        raise
    if fs.exists(target):
        fs.delete(target, True)
    fs.rename(aside, target)


WRITERS = {
    "csv": write_csv,
    "tsv": write_tsv,
    "parquet": write_parquet,
    "json": write_json,
    "jsonl": write_jsonl,
    "feather": write_feather,
}


def as_text(df: DataFrame, fmt: str, keep: Sequence[str] = ()) -> DataFrame:
    """Each row as one CSV or JSON text, for downloads of already small results."""
    cols = [c for c in df.columns if c not in keep]
    if fmt == "csv":
        return df.select(*keep, F.to_csv(F.struct(*cols)).alias("value"))
    if fmt in ("json", "jsonl"):
        return df.select(*keep, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))
    raise ValueError(f"cannot write {fmt} as text")


def save_version(
    df: DataFrame, root: str, name: str, catalog: str, parent: tuple[str, int] | None, history: Sequence[str]
) -> DataFrame:
    """Write the next version of a dataset and append its catalog row; returns that row.

    ``parent`` is the (id, version) it was made from.
    """
    spark = df.sparkSession
    version = parent[1] + 1 if parent else 1
    path = f"{root.rstrip('/')}/{name}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    row = spark.createDataFrame(
        [(f"{name}@{version}", name, parent[0] if parent else None, version, path, list(history), df.columns)],
        "id string, name string, parent_id string, version int, path string, operation_history array<string>, columns array<string>",
    ).withColumn("created_at", F.current_timestamp())
    row.write.mode("append").parquet(catalog)
    return row
