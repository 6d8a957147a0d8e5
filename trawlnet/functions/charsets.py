"""Content types, charsets and decoding of bodies."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels the web reads as another charset than their name says.
WEB_LABELS = {
    **dict.fromkeys("ascii us-ascii latin1 iso-8859-1 iso8859-1 l1 ansi_x3.4-1968 cp819 ibm819".split(), "cp1252"),
    **dict.fromkeys("iso-8859-9 latin5 l5".split(), "cp1254"),
    **dict.fromkeys("tis-620 iso-8859-11".split(), "cp874"),
    **dict.fromkeys("gb2312 gbk gb_2312-80 x-gbk chinese".split(), "gb18030"),
    **dict.fromkeys("shift_jis sjis shift-jis x-sjis ms_kanji windows-31j".split(), "cp932"),
    **dict.fromkeys("euc-kr ks_c_5601-1987 korean".split(), "cp949"),
    "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "x-mac-cyrillic": "mac_cyrillic", "macintosh": "mac_roman", "x-user-defined": "latin-1",
}
#: The codecs of the charsets that the web knows.
WEB_CODECS = frozenset(
    "utf-8 utf-16-le utf-16-be cp866 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 "
    "koi8-r koi8-u mac-roman cp874 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 mac-cyrillic gb18030 big5 big5hkscs euc_jp iso2022_jp cp932 cp949 iso8859-1".split()
)
_PRESCAN = r"(?i)<meta[^>]+\bcharset\s*=\s*[\"']?\s*([^\s\"'/>;]+)"


def codec_of(label: str | None) -> str | None:
    """The codec for a charset label as the web reads it; None for labels the web doesn't know, whatever else has them."""
    if not label:
        return None
    name = label.strip().strip("\"'").lower()
    name = {"utf-16": "utf-16-le", "big5-hkscs": "big5hkscs"}.get(name, WEB_LABELS.get(name, name))
    try:
        codec = codecs.lookup(name).name
    except (LookupError, ValueError):
        return None
    return codec if codec in WEB_CODECS else None


def prescan(body: Column) -> Column:
    """The charset label that a page declares in a meta tag within its first 1,024 bytes, or null."""
    return F.nullif(F.regexp_extract(F.decode(F.substring(body, 1, 1024), "ISO-8859-1"), _PRESCAN, 1), F.lit(""))


def content_type(header: Column) -> Column:
    """(mime, charset) of a Content-Type value; what is missing or no type is application/octet-stream."""
    essence = F.lower(F.trim(F.substring_index(F.coalesce(header, F.lit("")), ";", 1)))
    charset = F.nullif(F.regexp_extract(header, r"(?i);\s*charset\s*=\s*\"?([^\s\";]+)", 1), F.lit(""))
    ok = essence.rlike(r"^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$")
    return F.struct(F.when(ok, essence).otherwise("application/octet-stream").alias("mime"), F.when(ok, charset).alias("charset"))


def resolved_charset(forced: Column, header: Column, declared: Column, mime: Column, suggested: Column) -> Column:
    """The charset label to decode by: forced, else of the header, else declared in the page (HTML and XML), else suggested, else UTF-8."""
    marked = mime.isin("text/html", "application/xhtml+xml", "application/xml", "text/xml")
    return F.coalesce(forced, header, F.when(marked, declared), suggested, F.lit("utf-8"))


@F.pandas_udf(T.StringType())
def decode_body(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """decode_body(bytes, label): the text; a byte order mark goes before the label, what can't be decoded is U+FFFD."""
    marks = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
    for bodies, labels in parts:
        out = []
        for b, label in zip(bodies, labels):
            if b is None:
                out.append(None)
                continue
            codec = codec_of(label) or "utf-8"
            for mark, of_mark in marks:
                if b.startswith(mark):
                    b, codec = b[len(mark) :], of_mark
                    break
            out.append(b.decode(codec, "replace"))
        yield pd.Series(out, dtype=object)
