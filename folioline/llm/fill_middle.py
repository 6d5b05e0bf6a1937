"""Fill-in-middle: a text is cut into prefix, middle and suffix, and these change places.

A unit is a word with the separators before it, or separators that no word follows. One
``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of its group:
``match.ends(1)`` is the number of units and the offset of every possible cut at once.

A match holds some 250 bytes a unit. So a text of more than ``STRETCH`` characters is matched
in stretches that end before a separator that follows a word's character: there a unit begins
whatever comes before, so the ends are those of one match, in bounded memory.

Defined results: null text is empty text; an empty text, or one that holds a sentinel already,
stays plain; a null id is hashed as the seed alone; equal ids get equal draws, each row its own
result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and the separators before them; separators at the end.
UNITS = regex.compile(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)*")
_FREE_CUT = regex.compile(r"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")
#: Characters of a text that one match takes.
STRETCH = 1 << 22
SENTINELS = ("<P>", "<S>", "<M>")


def unit_ends(text: str, stretch: int = STRETCH) -> list[int]:
    """Where each unit of the text ends."""
    if len(text) <= stretch:
        return UNITS.fullmatch(text).ends(1)
    ends, begin = [], 0
    while begin < len(text):
        cut = _FREE_CUT.search(text, begin + stretch)
        end = cut.start() if cut else len(text)
        # The pattern sees the stretch alone; a long run of one kind is one unit anyway.
        ends += UNITS.fullmatch(text, begin, end).ends(1)
        begin = end
    return ends


def _transformed(percent: int, spm_percent: int):
    def cut(text: str, draws: tuple[int, ...]) -> tuple:
        ends = unit_ends(text)
        n = len(ends)
        if not text or draws[2] % 100 >= percent or any(s in text for s in SENTINELS):
            return n, "plain", None, None, text
        first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (first, second))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if draws[3] % 100 < spm_percent:
            return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
        return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
        for batch in batches:
            draws = zip(*[batch.column(f"h{i}").to_pylist() for i in range(1, 5)], strict=True)
            rows = [cut(t.as_py() or "", d) for t, d in zip(batch.column("text"), draws, strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            made[-1] = made[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *made],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of (doc_id, text).

    ``percent`` of the texts are cut, and ``spm_percent`` of these put the suffix first. The
    draws are those of a SHA-256 of seed and id, so a lost task repeats them.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)
    ]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *draws)
    return rows.mapInArrow(
        _transformed(percent, spm_percent),
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(form: str = "form", output: str = "output"):
    """The text that ``output`` was made from."""
    # A text that holds a sentinel is plain, so the sentinels found are the transformation's own.
    part = F.split(F.col(output), "<[PSM]>")
    return (
        F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
        .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(F.col(output))
    )
