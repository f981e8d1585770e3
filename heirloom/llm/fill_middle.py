"""Fill-in-middle: every document is cut where an Elias-Fano list of its text's token boundaries says."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirloom.llm.common import chunks, unused, with_columns

#: Marks before prefix, suffix and middle; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Of a hundred documents those that are cut, and of a hundred of these those with the suffix first.
CUT, SUFFIX_FIRST = 90, 20


def token_ends(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of each text of a run the code points up to the end of each token; tokens are runs of A-Z and a-z, and single other code points."""
    lower = data | 0x20
    letter = (lower >= 0x61) & (lower <= 0x7A)
    lead = (data & 0xC0) != 0x80
    start = lead.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = True
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum(lead)])
    at = np.flatnonzero(start)
    bounds = np.searchsorted(at, offsets)
    out = []
    for a, b, x, y in zip(bounds[:-1], bounds[1:], offsets[:-1], offsets[1:], strict=True):
        ends = np.empty(b - a, np.int64)
        if b > a:
            ends[:-1] = points[at[a + 1 : b]]
            ends[-1] = points[y]
        out.append(ends - points[x])
    return out


def packed(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Elias-Fano form of rising integers: width of the low parts, the low parts, and the high parts in unary.

    A list of n values up to u takes about 2 + log2(u / n) bits for each.
    """
    n = len(values)
    if not n:
        return 0, b"", b""
    top = int(values[-1])
    width = max(0, (top // n).bit_length() - 1)
    low = np.packbits(((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little")
    high = np.zeros((top >> width) + n, np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return width, low.tobytes(), np.packbits(high, bitorder="little").tobytes()


def selected(width: int, low: bytes, high: bytes, i: int) -> int:
    """The i-th value of an Elias-Fano list, from 0: the place of the i-th one bit, less i, before the low part."""
    bits = np.frombuffer(high, np.uint8)
    ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
    at = int(np.searchsorted(ones, i, "right"))
    left = i - (int(ones[at - 1]) if at else 0)
    one = 8 * at + int(np.flatnonzero(np.unpackbits(bits[at : at + 1], bitorder="little"))[left])
    part = int.from_bytes(low[i * width // 8 : ((i + 1) * width + 7) // 8], "little") >> (i * width % 8)
    return ((one - i) << width) | (part & ((1 << width) - 1))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the boundary list of each text."""
    for batch, data, offsets in chunks(batches, "t"):
        ends = token_ends(data, offsets)
        lists = [packed(x) for x in ends]
        yield with_columns(
            batch, n=pa.array([len(x) for x in ends], pa.int64()), width=pa.array([x[0] for x in lists], pa.int32()), low=pa.array([x[1] for x in lists], pa.binary()), high=pa.array([x[2] for x in lists], pa.binary()),
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Form, lengths and output of each document from its text, its text's boundaries and its four draws."""
    for batch, _, _ in chunks(batches, "t"):
        names = ["t", "n", "width", "low", "high", "h1", "h2", "h3", "h4"]
        forms, before, between, outputs = [], [], [], []
        for t, n, width, low, high, h1, h2, h3, h4 in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if not t or h3 % 100 >= CUT or any(m in t for m in (PREFIX, SUFFIX, MIDDLE)):
                forms.append("plain")
                before.append(None)
                between.append(None)
                outputs.append(t)
                continue
            units = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = (selected(width, low, high, u - 1) if u else 0 for u in units)
            first = h4 % 100 < SUFFIX_FIRST
            forms.append("spm" if first else "psm")
            before.append(a)
            between.append(b - a)
            outputs.append(f"{SUFFIX}{t[b:]}{PREFIX}{t[:a]}{MIDDLE}{t[a:b]}" if first else f"{PREFIX}{t[:a]}{SUFFIX}{t[b:]}{MIDDLE}{t[a:b]}")
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), batch.column("n"), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(outputs, pa.string())],
            names=["k", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def restored(output: str, form: str) -> Column:
    """The text that ``fill_middle`` made an output of a form from."""
    part = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2])).when(F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output))


def fill_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1") -> DataFrame:
    """A row for each row of ``docs``: its key, n (tokens), form, prefix_chars, middle_chars and output.

    Tokens are runs of A-Z and a-z and single other code points.  Four draws, the first four groups of eight digits of the sha256 of
    ``seed:key``, choose two boundaries, whether the text is cut and whether the suffix comes first (``spm``, else ``psm``).  Texts that are empty or hold a
    mark stay ``plain``, as one in ten does, and have null lengths.  Null texts are empty, a null key is the empty text.  Texts may be
    of any length; repeated rows each give a row, as do rows of one key; an empty table gives none.  Columns other than key and text are
    not looked at, so their names don't matter.

    Equal texts are grouped by the text itself, with partial groups before the shuffle, so a text that a third of all rows hold moves
    once a task.  Each distinct text has its boundary list made once.  A text of one row is cut where its list is; lists of texts with several
    rows are joined back to keys by the sha256 of the text, where Spark splits a hot text's rows.  So texts move once, copies as
    eight bytes and a digest.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = docs.select(F.col(f"`{key}`").alias("k"), t.alias("t"))
    texts = given.groupBy("t").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("k"))
    schema = f"t string, rows long, k {given.schema['k'].dataType.simpleString()}, n long, width int, low binary, high binary"
    names = ["k", "t", "n", "width", "low", "high"]
    alone = texts.where("rows = 1").mapInArrow(_indexed, schema).select(*names)
    digest = F.unhex(F.sha2(F.col("t"), 256)).alias("digest")
    lists = texts.where("rows > 1").mapInArrow(_indexed, schema).drop("k").select("*", digest)
    shared = given.select("k", digest).join(lists, "digest").select(*names)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256)
    draws = {f"h{i + 1}": F.conv(F.substring(drawn, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)}
    schema = f"k {given.schema['k'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return alone.unionByName(shared).withColumns(draws).mapInArrow(_cut, schema).withColumnRenamed("k", key)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_middle(docs)
    digests = {"output_sha256": F.sha2(F.col("output"), 256), "restored_sha256": F.sha2(restored("output", "form"), 256)}
    return made.withColumns(digests).drop("output")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, len(w)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM g),
p AS (SELECT *, array_to_string(list_slice(w, 1, a), '') AS pre, array_to_string(list_slice(w, a + 1, b), '') AS mid, array_to_string(list_slice(w, b + 1, n), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
