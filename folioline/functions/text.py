"""Text functions: whitespace and marker normalisation."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioline.functions.once import add_once

# Unicode white space plus the four separator controls that text tools strip as well.
_SPACE = r"[\s\x1c-\x1f]"

# What a scanner confuses, mapped to one spelling.
CONFUSABLES = {"-": " ", "_": " ", "0": "o", "1": "l"}

# Letters up to here are normalised with one built-in translate call.
_TRANSLATE_LIMIT = 0x250


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"(?U)[^\\s\\x1c-\\x1f]")


# The characters of _SPACE one by one, for the cheaper translate.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def visible_chars(text: Column) -> Column:
    """Number of characters that are not white space."""
    return F.char_length(F.translate(text, _SPACES, ""))


_SPACE_CODES = [c.encode() for c in _SPACES]
_SHOWS = np.array([byte & 0xC0 != 0x80 and bytes([byte]) not in _SPACE_CODES for byte in range(256)])
_WIDE = {n: np.array([int.from_bytes(c, "big") for c in _SPACE_CODES if len(c) == n]) for n in (2, 3)}
_LEADS = np.isin(np.arange(256), [c[0] for c in _SPACE_CODES if len(c) > 1])


def count_visible(texts: pa.Array) -> np.ndarray:
    """``visible_chars`` of each string of an Arrow array; null has none."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, bounds, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(len(texts), dtype=np.int64)
    bounds = np.frombuffer(bounds, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    shows = _SHOWS[data]
    # White space beyond ASCII has two or three bytes.
    at = np.flatnonzero(_LEADS[data])
    code, after = data[at].astype(np.int64), np.concatenate([data, np.zeros(2, np.uint8)])
    for step, length in ((1, 2), (2, 3)):
        code = code << 8 | after[at + step]
        shows[at[np.isin(code, _WIDE[length])]] = False
    running = np.concatenate([[0], np.cumsum(shows)])
    return np.diff(running[bounds - bounds[0]])


def number_text(text: Column) -> Column:
    """The text unless it ends in a Java type suffix, as in "90d", which a cast would read."""
    return F.when(~text.rlike(r"(?i)[0-9.][df]\s*$"), text)


def clean_value(value: Column, kind: Column) -> Column:
    """Stripped text, or null when it is no string or blank."""
    return F.when(kind == "STRING", F.nullif(strip(value), F.lit("")))


def blank_to_null(value: Column, kind: Column) -> Column:
    """Null for a blank string, every other value unchanged."""
    return F.when(~((kind == "STRING") & is_blank(value)), value)


class _Spelling(dict):
    """What each character becomes: itself, its confusable's spelling, a space or nothing.

    Letters and numbers (categories L and N) stay, separators and control spaces divide words,
    everything else, combining marks included, disappears. Filled as characters turn up.
    """

    def __missing__(self, code: int) -> str:
        char = chr(code)
        group = unicodedata.category(char)[0]
        divides = group == "Z" or char in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"
        made = CONFUSABLES.get(char) or (char if group in "LN" else " " if divides else "")
        self[code] = made
        return made


_SPELLING = _Spelling()


def normalize_text(text: str) -> str:
    """Lower case in compatibility form, spelled with letters and digits, one space between."""
    decomposed = unicodedata.normalize("NFKD", text.lower())
    return " ".join(decomposed.translate(_SPELLING).split())


def _translate_table() -> tuple[str, str, str]:
    """Characters to replace, their replacements, and those translate cannot handle."""
    same, changed, dropped, other = [], [], [], []
    for code in range(_TRANSLATE_LIMIT):
        char = chr(code)
        kept = unicodedata.normalize("NFKD", char.lower()).translate(_SPELLING)
        if len(kept) > 1 or len(char.lower()) > 1:
            other.append(char)
        elif not kept:
            dropped.append(char)
        elif kept != char:
            changed.append((char, kept))
        else:
            same.append(char)
    source = "".join(c for c, _ in changed) + "".join(dropped)
    return source, "".join(k for _, k in changed), "".join(other)


_FROM, _TO, _HARD = _translate_table()
_NEEDS_PYTHON = (
    f"[\\x{{{_TRANSLATE_LIMIT:x}}}-\\x{{10ffff}}" + "".join(f"\\x{{{ord(c):x}}}" for c in _HARD) + "]"
)


@F.pandas_udf(T.StringType())
def _normalize_udf(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_text, na_action="ignore")


def normalize_column(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the normalised text; only rows with characters beyond extended Latin visit Python."""
    slow = f"{name}_slow"
    visited = add_once(df, **{f"{name}_hard": F.col(text).rlike(_NEEDS_PYTHON)}).withColumn(
        slow, _normalize_udf(F.when(F.col(f"{name}_hard"), F.col(text)))
    )
    fast = F.trim(F.regexp_replace(F.translate(text, _FROM, _TO), "  +", " "))
    return add_once(
        visited, **{name: F.when(F.col(f"{name}_hard"), F.col(slow)).otherwise(fast)}
    ).drop(slow, f"{name}_hard")
