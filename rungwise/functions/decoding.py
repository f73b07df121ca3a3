"""Wire formats as column expressions: recognition and text decoding on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rungwise.functions.coded import MARK

#: Bytes that have no character in code page 1252; a file that holds one is Latin-1.
UNDEFINED_1252 = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


def is_coded(content: Column) -> Column:
    return F.startswith(content, F.lit(MARK))


def text_of(content: Column) -> Column:
    """Bytes as text: UTF-8, else code page 1252, else Latin-1; line ends become LF."""
    latin = F.decode(content, "ISO-8859-1")
    raw = [b for b in range(0x80, 0xA0) if b not in UNDEFINED_1252]
    western = F.translate(latin, "".join(map(chr, raw)), "".join(bytes([b]).decode("cp1252") for b in raw))
    undefined = latin.rlike("[" + "".join(map(chr, UNDEFINED_1252)) + "]")
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(undefined, latin).otherwise(western)
    return F.regexp_replace(text, "\r\n?", "\n")
