"""Ranked lexical search by pipelined term partitioning, in integers.

The words of the items are dealt to OWNERS owners by how frequent they are, the rarest to the first. The postings
of an owner lie in ranges of documents, so that no owner has to hold a list whole. Items travel in bundles (a group
of items, a range of documents) through the owners one after the other: each stage is a cogroup of the bundles with
the owner's postings of the same range; it adds every posting's integer contribution to the bundle's accumulators
and hands on the documents met so far, packed. What the stages after it can add to an item at most is known, so
documents are left behind that cannot reach the k-th best of their range any more; results stay exact. The last
owner, who has the most frequent words and meets most documents, hands on k documents an item and range, and these
are ranked over all ranges.

With N documents that have a term, L terms in all, n terms in the document, df documents that hold the term and tf
occurrences: weight w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 75 + (25 * n * N) div L, and a document scores the
sum of w * ((10^9 * tf) div (1000 * tf + 12 * m)) over the item's terms, repeats included. Scores add as 64-bit
integers, so they depend neither on the order of stages nor on ranges. Terms: runs of letters A-Z (in lower
case), digits and characters above U+007F.

A range is RANGE_BYTES of text or RANGE_ROWS documents at most, a group ITEMS items; the tables of terms follow from
the items alone and are broadcast only where their counted size allows it.

Defined cases: null has no terms; such documents are never found, such items find nothing. Each row of the
items is answered on its own, also where ids repeat or are null. Documents with one id are found each; those without an id are last
among equal scores. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.llm.common import Numbered, chunks, texts
from telltale.session import broadcast_if_small, materialized

K = 20
OWNERS = (1 / 256, 1 / 32, 1 / 6)  # largest share of documents that a term of each owner but the last is in
ITEMS = 256
RANGE_BYTES, RANGE_ROWS = 16 << 20, 8192
NO_ID = np.iinfo(np.int64).max
LARGEST = 1_000_000  # a contribution's bound for weight 1

# Letters and digits as they are, A-Z in lower case, other bytes below 0x80 as spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BUNDLES = "range long, bunch long, item long, found binary, scores binary"
RESULTS = "item long, doc_id long, score long"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per range without a term (ids and lengths of its documents), and one per range and term (documents, counts)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in chunks(batches, RANGE_BYTES):
            for at in range(0, batch.num_rows, RANGE_ROWS):
                yield postings(batch.slice(at, RANGE_ROWS), next(number))

    def postings(batch: pa.RecordBatch, here: int) -> pa.RecordBatch:
        known, n = Numbered(), batch.num_rows
        rows = [np.fromiter((known[w] for w in terms(t)), np.int64) for t in texts(batch)]
        length = np.array([len(r) for r in rows], np.int64)
        key, tf = np.unique(np.concatenate(rows) * n + np.repeat(np.arange(n), length), return_counts=True)
        ends = np.searchsorted(key, np.arange(len(known) + 1) * n)
        # the first row is that of the documents: no term, all documents
        offsets = np.concatenate([[0, n], n + ends[1:]]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x).astype(np.int32)))
                 for x in ((np.arange(n), key % n), (length, tf))]
        ids = pa.array([batch.column("doc_id").to_pylist()] + [None] * len(known), pa.list_(pa.int64()))
        names = pa.array([None] + [w.decode() for w in known], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), here)), names, ids, *lists],
                                          ["range", "term", "ids", "docs", "counts"])

    given = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return given.mapInArrow(index, "range long, term string, ids array<long>, docs array<int>, counts array<int>")


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, term, times), written; ``item`` numbers the rows of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [Counter(terms(t)) for t in texts(batch)]
            of = np.repeat(np.arange(batch.num_rows), [len(c) for c in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(of)), batch.column("item_id").take(pa.array(of)),
                 pa.array([w.decode() for c in found for w in c], pa.string()),
                 pa.array([x for c in found for x in c.values()], pa.int64())], ["item", "item_id", "term", "times"])

    given = items.select(F.monotonically_increasing_id().alias("item"), items[item_id].alias("item_id"),
                         items[text].cast("string").alias("text"))
    kind = given.schema["item_id"].dataType.simpleString()
    return materialized(given.mapInArrow(count, f"item long, item_id {kind}, term string, times long"), "item-terms")


def _owner(share: Column) -> Column:
    return sum((F.when(share > F.lit(s), 1).otherwise(0) for s in OWNERS), F.lit(0))


def asked_terms(asked: DataFrame, sizes: DataFrame, n_docs: int) -> DataFrame:
    """Per term and bunch of items: weight, owner, and the items that ask for it, how often, and what the owners
    after this one can add to them at most."""
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * n_docs + 2) / (F.col("df") * 2 + 1)))
    rows = asked.join(sizes, "term").select(
        "item", "term", "times", weight.cast("long").alias("weight"), _owner(F.col("df") / F.lit(n_docs)).alias("owner"))
    rest = F.coalesce(F.sum(F.col("weight") * F.col("times") * LARGEST).over(
        Window.partitionBy("item").orderBy("owner").rangeBetween(1, Window.unboundedFollowing)), F.lit(0))  # terms of one item
    return (rows.withColumn("rest", rest)
            .groupBy("owner", "term", "weight", F.floor(F.col("item") / ITEMS).alias("bunch"))
            .agg(F.collect_list(F.struct("item", "times", "rest")).alias("askers")))  # ITEMS at most


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    whole = column.combine_chunks()
    return np.split(whole.values.to_numpy().astype(np.int64), whole.offsets.to_numpy()[1:-1]) if len(whole) else []


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _packed(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def _stage(n_docs: int, n_terms: int, k: int, last: bool):
    """The work of one owner on one bundle: its accumulators, then what goes on."""

    def add(key: tuple, bundles: pa.Table, postings: pa.Table) -> pa.Table:
        terms, weights, askers, ids = (postings.column(c).to_pylist() for c in ("term", "weight", "askers", "ids"))
        docs, counts = _lists(postings.column("docs")), _lists(postings.column("counts"))
        head = terms.index(None)
        n = len(ids[head])
        m12 = 12 * (75 + (25 * counts[head] * n_docs) // n_terms)
        sums: dict[int, np.ndarray] = {}
        rest: dict[int, int] = {}
        for r in bundles.to_pylist():
            sums[r["item"]] = own = np.zeros(n, np.int64)
            own[np.cumsum(_unpacked(r["found"], "<u4").astype(np.int64))] = _unpacked(r["scores"], "<i8")
        for i, (at, tf) in enumerate(zip(docs, counts)):
            if i == head:
                continue
            part = weights[i] * ((1_000_000_000 * tf) // (1000 * tf + m12[at]))
            for a in askers[i]:
                own = sums.setdefault(a["item"], np.zeros(n, np.int64))
                own[at] += a["times"] * part  # a list has a document once
                rest[a["item"]] = a["rest"]
        if last:
            ids = np.array([NO_ID if i is None else i for i in ids[head]], np.int64)
            found = [_best(own, ids, k) for own in sums.values()]
            at = np.concatenate([np.zeros(0, np.int64), *found])
            scores = np.concatenate([np.zeros(0, np.int64), *(own[x] for own, x in zip(sums.values(), found))])
            of = np.repeat(np.array(list(sums), np.int64), [len(x) for x in found])
            return pa.table({"item": of, "doc_id": pa.array(ids[at], mask=ids[at] == NO_ID), "score": scores})
        out = {c: [] for c in ("range", "bunch", "item", "found", "scores")}
        for item, own in sums.items():
            met = np.flatnonzero(own)
            if len(met) > k and item in rest:  # k of this range are this good already
                least = np.partition(own[met], len(met) - k)[len(met) - k]
                met = met[own[met] + rest[item] >= least]
            if len(met):
                for c, x in zip(out, (*(v.as_py() for v in key), item, _packed(np.diff(met, prepend=0), "<u4"), _packed(own[met], "<i8"))):
                    out[c].append(x)
        return pa.table(out, pa.schema([("range", pa.int64()), ("bunch", pa.int64()), ("item", pa.int64()),
                                        ("found", pa.binary()), ("scores", pa.binary())]))

    return add


def _best(own: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The documents with the k highest scores above 0, of equal ones those with the smallest ids."""
    met = np.flatnonzero(own)
    if len(met) > k:
        met = met[own[met] >= np.partition(own[met], len(met) - k)[len(met) - k]]
    return met[np.lexsort((ids[met], -own[met]))][:k]


def ranked(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    asked = item_terms(items, item_id, item_text)
    vocabulary = asked.select("term").distinct().withColumn("asked", F.lit(True))
    index = materialized(build_index(docs, doc_id, text).join(broadcast_if_small(vocabulary), "term", "left")
                         .where(F.col("term").isNull() | F.col("asked")).drop("asked"), "postings")
    ranges = index.where(F.col("term").isNull())
    n_docs, n_terms = ranges.select(F.explode("counts").alias("n")).where(F.col("n") > 0).agg(
        F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    sizes = index.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    plan = materialized(asked_terms(asked, sizes, n_docs), "plan")
    # ids and lengths go along with the postings, so that a stage has what it needs of its range
    visits = index.select("range", "term").join(broadcast_if_small(plan.select("term", "bunch")), "term").select("range", "bunch").distinct()
    headers = materialized(ranges.join(visits, "range"), "headers")
    bundles: DataFrame | None = None
    for owner in range(len(OWNERS) + 1):
        last = owner == len(OWNERS)
        mine = index.join(broadcast_if_small(plan.where(F.col("owner") == owner).drop("owner")), "term")
        mine = mine.unionByName(headers, allowMissingColumns=True)
        before = bundles if bundles is not None else spark.createDataFrame([], BUNDLES)
        bundles = (before.groupBy("range", "bunch").cogroup(mine.groupBy("range", "bunch"))
                   .applyInArrow(_stage(n_docs, n_terms, k, last), RESULTS if last else BUNDLES))
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    names = asked.select("item", "item_id").distinct()
    return (bundles.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .join(broadcast_if_small(names), "item").select("item_id", "rank", "doc_id", "score"))
