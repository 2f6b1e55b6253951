"""Fill-in-middle: cut a text in three and put its middle last, so that a model learns to fill gaps.

A text is matched once, by the regex library's fullmatch of ``(unit)*``, a unit being a code point. The match keeps
every repetition of its group: ``ends(1)`` has the place after each unit, so its length is the number of units and
both cuts are looked up in it, without a loop over the text. The library keeps about 130 bytes for each repetition,
so a text of more than PIECE code points is matched in that many at a time.

Cuts and form follow from the SHA-256 of ``seed:id`` (h1 to h4, its first four 8-digit groups): prefix to the smaller
of h1 % (n + 1) and h2 % (n + 1), middle to the larger; plain where h3 % 100 >= ``rate``, else spm where
h4 % 100 < ``spm``, else psm. One pass in Arrow batches, no shuffle. ``restore`` is the way back, in the JVM.

Defined cases: a null text counts as empty and is plain, as is a text that holds one of the three marks, which could
not be restored. A null id draws as the empty text; rows of one id draw alike. Every row gives one row, an empty
table none. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.llm.common import chunks, text_or_empty, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM = 90, 20  # of a hundred texts
SEED = "1"
PIECE = 1 << 20

UNITS = regex.compile("(.)*", regex.DOTALL)
MARKS = regex.compile("|".join((PREFIX, SUFFIX, MIDDLE)))


def unit_ends(text: str) -> list[int]:
    """The place after each unit."""
    ends: list[int] = []
    for at in range(0, len(text), PIECE):
        ends += UNITS.fullmatch(text, at, min(len(text), at + PIECE)).ends(1)
    return ends


def cut(text: str, draws: list[int], rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, units of the prefix and of the middle (None if plain), and the output."""
    ends = unit_ends(text)
    n = len(ends)
    if not n or draws[2] % 100 >= rate or MARKS.search(text):
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = RATE, spm: int = SPM,
                   seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            made = [cut(t, [int(d[k:k + 8], 16) for k in (0, 8, 16, 24)], rate, spm)
                    for t, d in zip(texts(batch), batch.column("draw").to_pylist())]
            columns = list(zip(*made)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    id_text = F.coalesce(docs[doc_id].cast("string"), F.lit(""))
    given = docs.select(docs[doc_id].alias("doc_id"), text_or_empty(docs, text).alias("text"),
                        F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256).alias("draw"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(make, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """Add ``restored``: the text from ``output`` and ``form`` alone. No part holds a mark, so splitting at them is exact."""
    rest = F.substring(F.col("output"), len(PREFIX) + 1, 2_147_483_647)
    parts = F.split(rest, MARKS.pattern, -1)
    places = {"psm": (0, 2, 1), "spm": (1, 2, 0)}
    text = F.col("output")
    for form, order in places.items():
        text = F.when(F.col("form") == form, F.concat(*[parts[k] for k in order])).otherwise(text)
    return made.withColumn("restored", text)
