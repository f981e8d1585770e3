"""Genealogy files as DataFrames of lines."""

from __future__ import annotations

import codecs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heirloom.functions.text import ANY, NO_SPACE, SPACE
from heirloom.operators.ids import dense_ids
from heirloom.sources.encodings import ANSEL_MARKS, decode_column, decode_pieces, encoding_of, hint_of
from heirloom.sources.store import file_system, settle

LINE = rf"\A([0-9]+){SPACE}+(?:(@[^@\s\x{{A0}}]+@){SPACE}+)?({NO_SPACE}+)(?:{SPACE}({ANY}*))?\z"
UNPARSED = "_UNPARSED"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, encoding, unmappable_bytes of each file that ``path`` names."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", decode_column("content").alias("d")).select("path", "d.text", "d.encoding", "d.unmappable_bytes")


def one_file(spark: SparkSession, path: str) -> tuple[str, int, bytes]:
    """Name, size and first bytes of the only file that ``path`` names; several, or none, are an error."""
    pattern, fs = file_system(spark, path)
    found = [f for s in fs.globStatus(pattern) or [] for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    if not found:
        raise FileNotFoundError(path)
    if len(found) > 1:
        raise ValueError(f"{path} names more than one file; ingest each into a store of its own")
    stream = fs.open(found[0].getPath())
    try:
        return found[0].getPath().toString(), found[0].getLen(), bytes(stream.readNBytes(4096))
    finally:
        stream.close()


def _numbered_pieces(spark: SparkSession, name: str) -> DataFrame:
    """gid (from 0), piece, first: what stands between line feed bytes of a file, in order, and the offset of each.

    Spark's text source cuts the file into byte ranges and gives whole pieces of each; their bytes are kept as they are.  Pieces and bytes of each range are counted, so a piece's number
    is its place in its range and the pieces of the ranges before.
    """
    raw = spark.read.option("lineSep", "\n").text(name).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    pieces = settle(raw, "pieces")
    size = F.octet_length("piece") + 1
    blocks = pieces.groupBy("block").agg(F.min("n").alias("n0"), F.count(F.lit(1)).alias("count"), F.sum(size).alias("bytes"))
    before = W.Window.orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)  # a row for each range
    starts = blocks.select("block", "n0", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("g0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"))
    inside = W.Window.partitionBy("block").orderBy("n").rowsBetween(W.Window.unboundedPreceding, -1)
    return pieces.join(starts, "block").select((F.col("n") - F.col("n0") + F.col("g0")).alias("gid"), "piece", "block", (F.col("b0") + F.coalesce(F.sum(size).over(inside), F.lit(0))).alias("first"))


def _whole_units(pieces: DataFrame, big: bool, length: int) -> DataFrame:
    """gid and piece of the lines of a UTF-16 file: pieces that a byte of another character cut are joined again.

    A line feed is two bytes at an even place.  Whether the byte 0A ahead of a piece (little-endian) or behind it (big-endian) is one follows from the piece's
    offset and the byte next to it; lines are numbered by the line feeds before them, again with a count for each range.
    """
    end = F.col("first") + F.octet_length("piece")
    followed = end < length
    feed = F.lit(b"\n")
    if big:
        ends = followed & (end % 2 == 1) & (F.substring("piece", -1, 1) == F.lit(b"\0"))
        t = pieces.withColumn("mark", F.coalesce(ends, F.lit(False)))
        t = t.withColumn("piece", F.when(F.col("mark"), F.expr("substring(piece, 1, octet_length(piece) - 1)")).when(followed, F.concat("piece", feed)).otherwise(F.col("piece")))
        upto = W.Window.partitionBy("block").orderBy("gid").rowsBetween(W.Window.unboundedPreceding, -1)
    else:
        begins = (F.col("first") > 0) & (F.col("first") % 2 == 1) & (F.substring("piece", 1, 1) == F.lit(b"\0"))
        t = pieces.withColumns({"mark": F.coalesce(begins, F.lit(False)), "tail": F.when(followed & (end == length - 1), feed).otherwise(F.lit(b""))})
        body = F.when(F.col("mark"), F.expr("substring(piece, 2)")).when(F.col("first") > 0, F.concat(feed, "piece")).otherwise(F.col("piece"))
        t = t.withColumn("piece", F.concat(body, "tail"))
        upto = W.Window.partitionBy("block").orderBy("gid").rowsBetween(W.Window.unboundedPreceding, 0)
    t = settle(t.select("gid", "block", "mark", "piece"), "units")
    marks = F.col("mark").cast("long")
    before = W.Window.orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = t.groupBy("block").agg(F.sum(marks).alias("m")).select("block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"))
    line = (F.col("m0") + F.coalesce(F.sum(marks).over(upto), F.lit(0))).alias("line")
    joined = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("gid", "piece"))), lambda x: x["piece"]), F.lit(b""), lambda a, x: F.concat(a, x))
    lines = t.join(starts, "block").select("gid", "piece", line).groupBy("line").agg(joined.alias("piece")).select(F.col("line").alias("gid"), "piece")
    if big:
        return lines
    last = lines.agg(F.max("gid").alias("last"))
    return lines.join(F.broadcast(last), (F.col("gid") == F.col("last")) & (F.octet_length("piece") == 0) & (F.col("gid") > 0), "left_anti")


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """line_no (from 1), raw and bad (bytes without meaning) of the lines of one file, and its encoding.

    The file may be of any size: it is read in byte ranges, and no task holds more than a range and its longest line.  The encoding is decided once, from the first 4096 bytes.  Rows are those that
    ``split_lines`` gives for the file as one text: CRLF, LF and CR end lines, a byte order mark and one empty last line don't count, and in ANSEL marks before a line feed come after it.
    """
    name, length, head = one_file(spark, path)
    kind = encoding_of(head, hint_of(head))
    big = head[:2] == codecs.BOM_UTF16_BE
    pieces = _numbered_pieces(spark, name)
    if kind == "UTF-16":
        pieces = _whole_units(pieces, big, length)
        pieces = pieces.withColumn("piece", F.when(F.col("gid") == 0, F.expr("substring(piece, 3)")).otherwise(F.col("piece")))
        if length == 2:
            pieces = pieces.limit(0)  # nothing but the mark of its order
    pieces = pieces.select("gid", "piece")
    if kind == "ANSEL":
        # whatever stands before a line feed is text of a line or marks; a file's last piece keeps its marks
        shape = F.regexp_extract(F.decode("piece", "ISO-8859-1"), f"[{''.join(chr(b) for b in ANSEL_MARKS)}]+\\z", 0)
        cut = settle(pieces.withColumn("n", F.length(shape)), "marks")
        open_end = -1 if _ends_with_feed(spark, name, length) else cut.agg(F.max("gid")).first()[0] or 0
        moved = cut.withColumn("n", F.when(F.col("gid") == open_end, 0).otherwise(F.col("n")))
        body, marks = F.expr("substring(piece, 1, octet_length(piece) - n)"), F.expr("substring(piece, octet_length(piece) - n + 1)")
        carried = moved.where("n > 0").select((F.col("gid") + 1).alias("gid"), marks.alias("marks"))
        pieces = moved.select("gid", body.alias("piece")).join(carried, "gid", "full_outer").select("gid", F.coalesce("piece", F.lit(b"")).alias("piece"), "marks")
    else:
        pieces = pieces.withColumn("marks", F.lit(None).cast("binary"))
    read = pieces.select("gid", decode_pieces(kind, big)(F.col("piece"), F.col("marks")).alias("d")).select("gid", "d.text", "d.bad")
    text = F.when(F.col("gid") == 0, F.regexp_replace("text", r"\A\x{FEFF}", "")).otherwise(F.col("text"))
    parts = F.split(F.regexp_replace(text, r"\r\z", ""), r"\r")
    lines = read.select("gid", "bad", F.posexplode(parts).alias("sub", "raw")).withColumn("bad", F.when(F.col("sub") == 0, F.col("bad")).otherwise(0))
    return dense_ids(lines, "gid", "line_no", ties=["sub"]).select("line_no", "raw", "bad"), kind


def _ends_with_feed(spark: SparkSession, name: str, length: int) -> bool:
    """Whether the last byte of a file is a line feed."""
    path, fs = file_system(spark, name)
    stream = fs.open(path)
    try:
        stream.seek(max(0, length - 1))
        return bytes(stream.readNBytes(1)) == b"\n"
    finally:
        stream.close()


def split_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``files`` with line_no (from 1) and raw for each line.

    CRLF, LF and CR end lines; a leading byte order mark and one empty last line don't count.
    """
    lines = F.split(F.regexp_replace(text, r"\A\x{FEFF}", ""), r"\r\n|\n|\r")
    kept = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.posexplode(kept).alias("n", "raw")).select(*others, (F.col("n") + 1).cast("long").alias("line_no"), "raw")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add level, xref, tag (upper case) and value to lines; what is no line is one of level 0 with tag _UNPARSED and itself as value.

    Exactly one white space stands between tag and value; more belong to the value.
    """
    told = F.regexp_replace("raw", LINE, "\n$1\n$2\n$3\n$4")  # what is no line stays as it is; no line begins with a line feed
    part = lambda n: F.get("__parts", F.lit(n + 1))
    # columns of their own, so that Spark matches each line once, and not for each part or to tell whether it is one
    cut = lines.withColumn("__told", told).withColumn("__parts", F.when(F.col("__told").startswith("\n") & ~F.col("raw").startswith("\n"), F.split("__told", "\n", 5)))
    fits = F.col("__parts").isNotNull()
    return cut.withColumns({
        "level": F.when(fits, part(0).cast("decimal(38,0)").try_cast("int")).otherwise(0),
        "xref": F.nullif(part(1), F.lit("")),
        "tag": F.when(fits, F.upper(part(2))).otherwise(UNPARSED),
        "value": F.when(fits, part(3)).otherwise(F.col("raw")),
    }).drop("__told", "__parts")
