"""Exact top-k search: BM25 over sharded inverted indexes with block-max pruning.

Documents are indexed in shards of about SHARD_BYTES, each written as one row: terms, and for each term
the documents with their counts. Terms of more than a DENSE-th of a shard's documents are a matrix there, so their
sums for many queries are one product. Within a shard, documents are numbered by their most
frequent word and their length, so that a block holds documents of one language and like size and its bounds are close. Scores use statistics of the whole table (documents, mean length, document
frequency of each query term), so shard results merge exactly. Postings are grouped in blocks of
BLOCK document numbers. A query's bound for a block is the best sum of frequent terms there plus the largest
contribution of each of its other terms; only blocks whose sum can reach the k-th best score so far are scored, most promising ones first. The k-th
score carries over from shard to shard within a task, and every task hands on k rows a query.

Queries are a table of texts, taken in blocks of at most QUERY_BYTES that are sent to all shards; all
distinct words of a query count once. Contribution of a term: ln(1 + (N - df + 0.5) / (df + 0.5)) *
tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)). Only documents with a word in common are
returned, ordered by score (to DIGITS digits, so that equal texts tie), then id.

Defined cases: null and empty texts are never found and find nothing; rows with the same id are
found each; rows without an id are indexed with id null last among ties; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telltale.llm.common import Numbered, chunks, texts, words
from telltale.session import materialized

K1, B, K = 1.2, 0.75, 10
SHARD_BYTES, QUERY_BYTES = 16 << 20, 16 << 20
BLOCK = 32
DENSE = 32
DIGITS = 6
TOGETHER = 256  # queries whose frequent terms are summed in one product
NO_ID = np.iinfo(np.int64).max


def build_index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per shard: ids, lengths, terms, and compressed postings by term."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in chunks(batches, SHARD_BYTES):
            known = Numbered()
            rows = [[known[w] for w in words(t)] for t in texts(batch)]
            if not rows:
                continue
            length = np.array([len(r) for r in rows], np.int64)
            flat = np.concatenate([np.array(r, np.int64) for r in rows])
            order = _alike(flat, length)
            number = np.empty(len(rows), np.int64)
            number[order] = np.arange(len(rows))
            key, tf = np.unique(flat * len(rows) + np.repeat(number, length), return_counts=True)
            df = np.bincount(key // len(rows), minlength=len(known))
            yield pa.RecordBatch.from_pydict({
                "ids": [batch.column("doc_id").take(pa.array(order)).to_pylist()], "lengths": [length[order].tolist()], "terms": [zip_.compress(b"\n".join(known))],
                "df": [zip_.compress(df.astype("<u4").tobytes())], "docs": [zip_.compress((key % len(rows)).astype("<u4").tobytes())],
                "tf": [zip_.compress(tf.astype("<u4").tobytes())], "n": [len(rows)], "total": [int(length.sum())]}, kinds)

    kinds = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.binary()), ("df", pa.binary()),
                       ("docs", pa.binary()), ("tf", pa.binary()), ("n", pa.int64()), ("total", pa.int64())])
    given = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return given.mapInArrow(index, "ids array<long>, lengths array<long>, terms binary, df binary, docs binary, tf binary, n long, total long")


def _alike(flat: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order of documents by how often the shard has their most frequent word, then by length."""
    most = np.zeros(len(length), np.int64)
    full = np.flatnonzero(length)
    if len(full):
        most[full] = np.maximum.reduceat(np.bincount(flat)[flat], (np.cumsum(length) - length)[full])
    return np.lexsort((length, most))


class Shard:
    """A shard's postings with contributions (without idf) and block maxima."""

    def __init__(self, row: dict, mean: float):
        unzip = zstandard.ZstdDecompressor()
        self.ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        blob = unzip.decompress(row["terms"])
        self.terms = {w: i for i, w in enumerate(blob.split(b"\n"))} if blob else {}
        df = np.frombuffer(unzip.decompress(row["df"]), "<u4").astype(np.int64)
        self.docs = np.frombuffer(unzip.decompress(row["docs"]), "<u4").astype(np.int64)
        tf = np.frombuffer(unzip.decompress(row["tf"]), "<u4").astype(float)
        length = np.array(row["lengths"], float)
        self.part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.docs] / mean))
        self.start = np.cumsum(df) - df
        # (term, block) groups of postings
        term = np.repeat(np.arange(len(df)), df)
        group = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (self.docs[1:] // BLOCK != self.docs[:-1] // BLOCK)][:len(term)])
        self.block, self.first = self.docs[group] // BLOCK, np.r_[group, len(term)]
        self.most = np.maximum.reduceat(self.part, group) if len(group) else np.zeros(0)
        self.groups = np.searchsorted(group, np.r_[self.start, len(term)])
        self.n, self.blocks = len(self.ids), -(-len(self.ids) // BLOCK)
        frequent = np.flatnonzero(df * DENSE > self.n)
        self.row = np.full(len(df) + 1, -1)  # the last one stands for words that the shard lacks
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.n))
        posting, of = _ranges(self.start[frequent], self.start[frequent] + df[frequent])
        self.dense[of, self.docs[posting]] = self.part[posting]

    def sums(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each query (terms, idf) and document, the sum over the query's frequent terms."""
        weight = np.zeros((len(queries), len(self.dense)))
        for i, (terms, idf) in enumerate(queries):
            row = self.row[terms]
            weight[i, row[row >= 0]] = idf[row >= 0]
        used = np.flatnonzero(weight.any(axis=0))
        return weight[:, used] @ self.dense[used]

    def search(self, terms: np.ndarray, idf: np.ndarray, base: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and scores that may be among the best k, given k scores of at least ``least``."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        rare = self.row[terms] < 0
        terms, idf = terms[rare], idf[rare]
        group, of = _ranges(self.groups[terms], self.groups[terms + 1])
        block, weight = self.block[group], idf[of]
        bound = (np.bincount(block, weight * self.most[group], self.blocks)
                 + np.maximum.reduceat(base, np.arange(0, self.n, BLOCK)))
        order = np.flatnonzero((bound > 0) & (bound * (1 + 1e-9) + 10.0 ** -DIGITS >= least))  # a rounded score may lie half a digit above its bound
        order = order[np.argsort(-bound[order], kind="stable")]
        scores = np.zeros(0)
        found = np.zeros(0, np.int64)
        # the best blocks alone give a first k-th score; where there is one, all blocks that can reach it are taken at once
        step = len(order) if least > 0 else -(-2 * k // BLOCK) + 1
        at = 0
        while at < len(order):
            part = order[at:at + step]
            part = part[bound[part] * (1 + 1e-9) + 10.0 ** -DIGITS >= least]
            if not len(part):
                break
            wanted = np.zeros(self.blocks, bool)
            wanted[part] = True
            use = np.flatnonzero(wanted[block])
            here = group[use]
            posting, which = _ranges(self.first[here], self.first[here + 1])
            total = base + np.bincount(self.docs[posting], weight[use][which] * self.part[posting], self.n)
            hit = np.flatnonzero(total >= least - 10.0 ** -DIGITS if least > 0 else total)
            hit = hit[wanted[hit // BLOCK] & (total[hit] > 0)]
            found, scores = np.concatenate([found, hit]), np.concatenate([scores, np.round(total[hit], DIGITS)])
            if len(scores) > k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= cut
                found, scores, least = found[keep], scores[keep], max(least, cut)
            at, step = at + step, len(order)
        return found, scores


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the half-open ranges, and which range each is from."""
    size = end - start
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + np.repeat(start - (np.cumsum(size) - size), size), of


def _query_blocks(queries: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Queries with their distinct words in order, in blocks of at most QUERY_BYTES of text (one query at least)."""
    block, size = [], 0
    for row in queries.select("query_id", "text").toLocalIterator(prefetchPartitions=False):
        if block and size + len(row.text or "") > QUERY_BYTES:
            yield block
            block, size = [], 0
        block.append((row.query_id, sorted(set(words(row.text or "")))))
        size += len(row.text or "")
    if block:
        yield block


def search(docs: DataFrame, queries: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the best k documents of every query (query_id, text)."""
    spark = docs.sparkSession
    index = materialized(build_index(docs, doc_id, text), "index")
    n, total = index.agg(F.sum("n"), F.sum("total")).first()
    schema = "query_id long, doc_id long, score double"
    results = spark.createDataFrame([], schema)
    if n:
        for block in _query_blocks(queries):
            results = results.unionByName(_search_block(index, block, n, max(total / n, 1e-9), k, schema))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (results.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "score"))


def _search_block(index: DataFrame, block: list[tuple[int, list[bytes]]], n: int, mean: float, k: int, schema: str) -> DataFrame:
    """The rows that each task hands on for a block of queries, written."""
    numbers = Numbered()
    asked = [(q, np.array([numbers[w] for w in ws], np.int64)) for q, ws in block]
    listed = b"\n".join(numbers)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        terms = {w: i for i, w in enumerate(listed.split(b"\n"))}
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for blob, count in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist()):
                own = unzip.decompress(blob).split(b"\n")
                at = np.fromiter((terms.get(w, -1) for w in own), np.int64, len(own))
                count = np.frombuffer(unzip.decompress(count), "<u4")
                if len(count):
                    df[at[at >= 0]] += count[at >= 0]
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], ["term", "df"])

    df = np.zeros(len(numbers), np.int64)
    counts = index.select("terms", "df").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df[counts["term"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    # queries with the same most frequent word are taken together: their products use the same few rows
    asked.sort(key=lambda x: (int(x[1][idf[x[1]].argmin()]) if len(x[1]) else -1))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0, np.int64), np.zeros(0)) for _ in asked]
        terms = listed.split(b"\n")
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, mean)
                own = np.fromiter((shard.terms.get(w, -1) for w in terms), np.int64, len(terms))
                for begin in range(0, len(asked), TOGETHER):
                    part = [(here[here >= 0], idf[ts[here >= 0]]) for _, ts in asked[begin:begin + TOGETHER] for here in (own[ts],)]
                    for i, (query, base) in enumerate(zip(part, shard.sums(part)), begin):
                        ids, scores = kept[i]
                        found, more = shard.search(*query, base, k, scores.min() if len(scores) >= k else 0.0)
                        if len(found):
                            ids, scores = np.r_[ids, shard.ids[found]], np.r_[scores, more]
                            order = np.lexsort((ids, -scores))[:k]
                            kept[i] = ids[order], scores[order]
        ids, scores = np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept])
        of = np.repeat([q for q, _ in asked], [len(x[0]) for x in kept])
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores)],
                                         ["query_id", "doc_id", "score"])

    return materialized(index.mapInArrow(best, schema), "found")
