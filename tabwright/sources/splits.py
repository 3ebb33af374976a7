"""Text files whose records span lines, read in blocks: one large file is many tasks.

Spark hands out the lines of each file block. A task joins them again, some lines at a time, and cuts them where a record
ends, so it holds a chunk and no block; what lies between the first and the last cut of a block is whole records. The text before the first cut and after the last one is set
together with that of the neighbouring blocks: one or two short pieces for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.session import cut_lineage

#: Text of whole records that is parsed as one document, about.
CHUNK = 1 << 20
#: Where a record ends; lines may have blanks around them.
ENDS = {
    "qif": r"(?m)^[^\S\n]*\^[^\n]*\n?",
    "ical": r"(?m)^[^\S\n]*END:VEVENT[^\S\n]*$\n?",
    "vcard": r"(?m)^[^\S\n]*END:VCARD[^\S\n]*$\n?",
    "ofx": r"(?i)</STMTTRN>",
    # files without closing tags: a record ends where the next one begins
    "ofx_open": r"(?i)(?=<STMTTRN>)",
}
#: Encodings in which a line end is one byte, so that blocks can be read apart.
SPLITTABLE = ("utf-8", "utf8", "ascii", "us-ascii", "iso-8859-1", "latin-1", "latin1", "cp1252", "windows-1252")


def file_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(line, file, block, at): ``at`` counts up by one from line to line of a block, as one task reads it in order."""
    lines = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return lines.select(F.col("value").alias("line"), *place).withColumn("at", F.monotonically_increasing_id())


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, line_number, line): line numbers from 1 in each file, from the number of lines in each block."""
    lines = file_lines(spark, path, encoding)
    blocks = cut_lineage(lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("at").alias("first")))
    # one row for each block of a file
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block")) - F.col("lines")
    blocks = blocks.select("file", "block", "first", before.alias("before"))
    joined = lines.join(blocks, ["file", "block"])
    return joined.select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_number"), "line")


def _pieces(ends: dict[str, str], chunk: int):
    """Lines of blocks to pieces (file, block, part, closed, text): 0 before the first cut, 1 whole records, 2 after the last cut."""
    patterns = {k: re.compile(v) for k, v in ends.items()}
    names = ["file", "block", "part", "closed", "text"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    class Block:
        """The text of a block as it comes in: whole records leave once they fill a chunk."""

        def __init__(self, file: str, block: int, kind: str) -> None:
            self.place, self.kind, self.head, self.rest, self.closed = (file, block), kind, [], "", None

        def add(self, text: str) -> Iterator[tuple]:
            """Of some more whole lines; ``rest`` is what follows the last piece, ``closed`` how much of it is whole records."""
            begin, base = 0, 0
            if self.closed is not None:
                base = len(self.rest)
            ends = [base + m.end() for m in patterns[self.kind].finditer(text)]
            if self.closed is None:
                if not ends:
                    self.head.append(text)
                    return
                yield (*self.place, 0, True, "".join(self.head) + text[: ends[0]])
                self.head, self.closed, begin, ends = [], 0, ends[0], ends[1:]
                whole, last = text, begin
            else:
                whole, last = self.rest + text, self.closed
            for end in ends:
                last = end
                if end - begin >= chunk:
                    yield (*self.place, 1, True, whole[begin:end])
                    begin = end
            self.rest, self.closed = whole[begin:], last - begin

        def end(self) -> Iterator[tuple]:
            if self.closed is None:
                # nothing ends here: the whole block lies between two neighbours
                yield (*self.place, 2, False, "".join(self.head))
                return
            if self.closed:
                yield (*self.place, 1, True, self.rest[: self.closed])
            yield (*self.place, 2, True, self.rest[self.closed :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None

        def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for row in found:
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], names)

        for batch in batches:
            lines, lo = batch.column("line").to_pylist(), 0
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "block", "kind")), strict=True))
            while lo < len(lines):
                hi = lo + 1
                while hi < len(lines) and places[hi] == places[lo]:
                    hi += 1
                if here is None or (*here.place, here.kind) != places[lo]:
                    if here is not None:
                        yield from rows(here.end())
                    here = Block(*places[lo])
                yield from rows(here.add("\n".join(lines[lo:hi]) + "\n"))
                lo = hi
        if here is not None:
            yield from rows(here.end())

    return run


def record_documents(spark: SparkSession, path: str, kind: str, encoding: str = "UTF-8", chunk: int = CHUNK) -> DataFrame:
    """``value``: texts of whole records, in which every record of the files stands once."""
    lines = file_lines(spark, path, encoding)
    if kind == "ofx":
        # a file with closing tags ends its records by them; one row for each file is sent to the lines, which stay in order
        closed = lines.where(F.lower("line").contains("</stmttrn>")).select("file").distinct().withColumn("kind", F.lit("ofx"))
        lines = lines.join(F.broadcast(closed), "file", "left").withColumn("kind", F.coalesce("kind", F.lit("ofx_open")))
    else:
        lines = lines.withColumn("kind", F.lit(kind))
    pieces = lines.select("line", "file", "block", "kind").mapInArrow(_pieces(ENDS, chunk), "file string, block long, part int, closed boolean, text string")
    pieces = cut_lineage(pieces)
    # nothing comes before the first piece of a file, so it is whole and stays in front of the records that follow it
    whole = (F.col("part") == 1) | (F.col("part") == 0) & (F.col("block") == 0)
    # the text after a block's last cut belongs to the next block that has a cut, to which its first piece belongs too
    ends = pieces.where(~whole)
    next_cut = F.first(F.when(F.col("part") == 0, F.col("block")), ignorenulls=True)
    later = Window.partitionBy("file").orderBy("block", "part").rowsBetween(1, Window.unboundedFollowing)
    goal = F.when(F.col("part") == 0, F.col("block")).otherwise(next_cut.over(later))
    # at most two rows for each block of a file
    joined = ends.withColumn("goal", goal).groupBy("file", "goal").agg(F.sort_array(F.collect_list(F.struct("block", "part", "text"))).alias("parts"))
    stitched = joined.select(F.array_join(F.col("parts.text"), "").alias("value"))
    return pieces.where(whole).select(F.col("text").alias("value")).unionByName(stitched)
