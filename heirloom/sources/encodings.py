"""Bytes of genealogy files to text: legacy character sets that Spark has no decoder for, in Arrow batches."""

from __future__ import annotations

import codecs
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ANSEL characters (Z39.47 with the common extensions), and the marks that precede their base letter.
ANSEL = {
    0xA1: "Ł", 0xA2: "Ø", 0xA3: "Đ", 0xA4: "Þ", 0xA5: "Æ", 0xA6: "Œ", 0xA7: "ʹ", 0xA8: "·", 0xA9: "♭", 0xAA: "®", 0xAB: "±", 0xAC: "Ơ", 0xAD: "Ư", 0xAE: "ʼ",
    0xB0: "ʻ", 0xB1: "ł", 0xB2: "ø", 0xB3: "đ", 0xB4: "þ", 0xB5: "æ", 0xB6: "œ", 0xB7: "ʺ", 0xB8: "ı", 0xB9: "£", 0xBA: "ð", 0xBC: "ơ", 0xBD: "ư",
    0xC0: "°", 0xC1: "ℓ", 0xC2: "℗", 0xC3: "©", 0xC4: "♯", 0xC5: "¿", 0xC6: "¡", 0xC7: "ß", 0xC8: "€",
}
ANSEL_MARKS = {
    0xE0: 0x0309, 0xE1: 0x0300, 0xE2: 0x0301, 0xE3: 0x0302, 0xE4: 0x0303, 0xE5: 0x0304, 0xE6: 0x0306, 0xE7: 0x0307, 0xE8: 0x0308, 0xE9: 0x030C, 0xEA: 0x030A, 0xEB: 0x0361, 0xEC: 0x0315, 0xED: 0x030B,
    0xEE: 0x0310, 0xEF: 0x0327, 0xF0: 0x0328, 0xF1: 0x0323, 0xF2: 0x0324, 0xF3: 0x0325, 0xF4: 0x0333, 0xF5: 0x0332, 0xF6: 0x0326, 0xF7: 0x031C, 0xF8: 0x032E, 0xF9: 0x0360, 0xFA: 0x0317, 0xFB: 0x0316, 0xFE: 0x0313,
}

BAD = "\ufffd"
DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("unmappable_bytes", T.LongType())])


def _counting(step: int):
    """An error handler that puts one mark for each bad unit of ``step`` bytes, and its name."""

    def handle(error):
        handle.count += 1
        return BAD, min(error.start + step, len(error.object))

    handle.count = 0
    return handle


def _with_handler(data: bytes, codec: str, step: int) -> tuple[str, int]:
    handle = _counting(step)
    codecs.register_error("heirloom", handle)
    text = data.decode(codec, errors="heirloom")
    return text, handle.count


def _ansel(data: bytes) -> tuple[str, int]:
    out, marks, bad = [], "", 0
    for b in data:
        if b in ANSEL_MARKS:
            marks += chr(ANSEL_MARKS[b])
            continue
        c = chr(b) if b < 0x80 else ANSEL.get(b, BAD)
        bad += c == BAD
        out.append(c + marks)
        marks = ""
    if marks:
        out.append(BAD + marks)
        bad += 1
    return "".join(out), bad


def hint_of(data: bytes) -> str:
    """Encoding that a byte order mark names, else ``unknown``."""
    if data.startswith(codecs.BOM_UTF8):
        return "UTF-8"
    return "UTF-16" if data[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else "unknown"


def encoding_of(data: bytes, hint: str = "unknown") -> str:
    """The hint, else by byte order mark, else by the CHAR line among the first 4096 bytes, else UTF-8."""
    if hint != "unknown":
        return hint
    if data[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        return "UTF-16"
    head = "".join(chr(b) if b < 0x80 else " " for b in data[:4096]).upper()
    if re.search(r"(?a:\b)1 CHAR ANSEL(?a:\b)", head):
        return "ANSEL"
    return "CP1252" if re.search(r"(?a:\b)1 CHAR (ANSI|WINDOWS|CP1252)(?a:\b)", head) else "UTF-8"


def decode_as(kind: str, data: bytes, big: bool = False) -> tuple[str, int]:
    """Text of bytes without a mark of their order, and how many bytes (or code units) had no meaning."""
    if kind == "UTF-16":
        return _with_handler(data, "utf-16-be" if big else "utf-16-le", 2)
    if kind == "UTF-8":
        return _with_handler(data, "utf-8", 1)
    text, bad = _ansel(data) if kind == "ANSEL" else _with_handler(data, "cp1252", 1)
    return unicodedata.normalize("NFC", text), bad


def decode(data: bytes, hint: str = "unknown") -> tuple[str, str, int]:
    """Text, encoding, and how many bytes (or code units) had no meaning; each of these is one U+FFFD in the text."""
    kind = encoding_of(data, hint)
    if kind == "UTF-16":
        big = data[:2] == codecs.BOM_UTF16_BE
        body = data[2:] if big or data[:2] == codecs.BOM_UTF16_LE else data
    else:
        big, body = False, data.removeprefix(codecs.BOM_UTF8)
    text, bad = decode_as(kind, body, big)
    return text, kind, bad


@F.pandas_udf(DECODED)
def decode_column(content: pd.Series) -> pd.DataFrame:
    """Struct text, encoding, unmappable_bytes of a binary column; null counts as no bytes."""
    rows = [decode(b := bytes(x or b""), hint_of(b)) for x in content]
    return pd.DataFrame(rows, columns=["text", "encoding", "unmappable_bytes"])


def decode_pieces(kind: str, big: bool):
    """A UDF for lines of one file: struct text, bad of the bytes of a line and of the ANSEL marks that stood before the line feed ahead of it."""

    @F.pandas_udf("text string, bad long")
    def run(piece: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = [decode_as(kind, bytes(x), big) for x in piece]
        ahead = ["".join(chr(ANSEL_MARKS[b]) for b in m) if m else "" for m in marks]
        return pd.DataFrame({"text": [m + t for m, (t, _) in zip(ahead, rows, strict=True)], "bad": [n for _, n in rows]})

    return run
