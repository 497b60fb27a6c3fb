"""Normalisers that need Unicode tables or byte decoding, as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ONLY_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~+ -])+")
_UNSAFE = re.compile(r'[\x00-\x1f\x7f<>:"/\\|?*]+')
_ENCODED_CJK = re.compile(r"(?i)%E[4-9](?:%[89AB][0-9A-F]){2}")


def cjk(text: str) -> int:
    return sum("一" <= c <= "鿿" or "㐀" <= c <= "䶿" for c in text)


def decode_escapes(text: str, passes: int = 2) -> str:
    """Percent-decode where that brings ideographs to light; ``+`` stays, bad UTF-8 becomes U+FFFD."""
    best = text
    for _ in range(passes):
        text = _ESCAPES.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), text)
        if cjk(text) > cjk(best):
            best = text
    return best


def clean_filename(value: str | None, limit: int = 200) -> str:
    """Decoded, composed (NFC), unsafe characters as ``_``."""
    return _UNSAFE.sub("_", unicodedata.normalize("NFC", decode_escapes((value or "").strip())))[:limit]


def clean_metadata(value: str | None) -> str:
    return " ".join(unicodedata.normalize("NFC", decode_escapes((value or "").strip())).split())


def clean_content(value: str | None) -> str:
    """Decoded only where the whole text is percent-encoded and holds encoded ideographs."""
    t = value or ""
    return decode_escapes(t) if t and _ENCODED_CJK.search(t) and _ONLY_ESCAPES.fullmatch(t.strip()) else t


@F.pandas_udf(StringType())
def normalize_filename(c: pd.Series) -> pd.Series:
    return c.map(clean_filename)


@F.pandas_udf(StringType())
def normalize_metadata_text(c: pd.Series) -> pd.Series:
    return c.map(clean_metadata)


@F.pandas_udf(StringType())
def normalize_content(c: pd.Series) -> pd.Series:
    return c.map(clean_content)
