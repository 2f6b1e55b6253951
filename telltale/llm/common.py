"""What the text operators share."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of all contracts: the space and the five controls U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)), F.lit(0))


def text_or_empty(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as the empty one."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds about ``limit`` bytes, or a single row."""
    for batch in batches:
        n, size = batch.num_rows, batch.nbytes
        step = max(1, n if size <= limit else n * limit // size)
        for at in range(0, n, step):
            yield batch.slice(at, step)


def words(text: str) -> list[bytes]:
    """Runs of other than the six white-space characters as UTF-8, A-Z in lower case."""
    return text.encode().lower().split()  # on bytes, both know ASCII alone


class Numbered(defaultdict):
    """Numbers each new key by its order."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__
