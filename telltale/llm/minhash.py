"""Near-duplicates: universal hash minima, banding, signature check, full sets, star components.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit key of the
   whole set, and ``hashes`` minima of universal hashes. Documents with equal sets form a class that
   its smallest id stands for.
2. The minima are cut into bands of ``rows``. Representatives that agree on a band share a bucket.
3. Links are confirmed in two steps: each representative with the smallest id among its buckets'
   smallest; then, in buckets that hold several components after that, all pairs of different
   components, in tiles of bounded size. Pairs inside one component can't change the result, so
   nothing is lost by leaving them out, and a large group of near copies costs a few comparisons a
   member.
4. A pair is dropped early only if its signatures (8 bits of each minimum) agree on fewer than
   ``threshold - MARGIN`` of the places, more than four standard deviations; all others are confirmed
   on the full sets of shingles made from both whole texts.
5. Components of the links come from alternating large-star and small-star steps.

With 36 bands of 4 a pair at the threshold 0.75 shares no bucket with probability 1e-6, and a closer
one less often.

Defined cases: null and empty texts have no shingles and are linked with nothing; a text of fewer
than ``width`` words is one shingle; rows without an id are kept and have no component; rows with the same id are
one document; repeated rows are each returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.llm.common import Numbered, chunks, texts, unused, words
from telltale.llm.components import components
from telltale.session import materialized

BANDS, ROWS = 36, 4
MARGIN = 0.16
TILE = 500  # rows of one bucket that are compared with as many others in one task
WORDS_KEPT = 1_000_000
MEMBERS = 200  # texts confirmed against one other in one task


class Shingles:
    """64-bit hashes of the distinct word shingles of texts."""

    def __init__(self, width: int, seed: int = 1):
        self.width = width
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        self.known, self.hashes = Numbered(), np.zeros(0, np.uint64)

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        if len(self.known) > WORDS_KEPT:
            self._forget()
        known, before = self.known, len(self.known)
        at = [known[w] for w in words(text)]
        if not at:
            return np.zeros(0, np.uint64)
        if len(known) > before:
            if len(known) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(len(known) + 65_536, np.uint64)])
            new = [w for w, _ in zip(reversed(known), range(len(known) - before))][::-1]
            self.hashes[before:len(known)] = [xxhash.xxh3_64_intdigest(w) for w in new]
        h = self.hashes[at]
        n = max(1, len(h) - self.width + 1)
        mixed = np.full(n, min(len(h), self.width), np.uint64)
        for k in range(min(self.width, len(h))):
            mixed += h[k:k + n] * self.factors[k]
        return np.unique(mix(mixed))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (multiply and fold, twice)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


class Minima:
    """Minima of ``count`` hashes a * x + b over a set; the upper 32 bits are kept."""

    def __init__(self, count: int, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(1, 2**63, (count, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 2**63, (count, 1), dtype=np.uint64)

    def of(self, shingles: np.ndarray, step: int = 512) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint64).max)
        for at in range(0, len(shingles), step):  # small enough for the cache
            best = np.minimum(best, (self.a * shingles[at:at + step] + self.b).min(axis=1))
        return (best >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, width: int, hashes: int) -> DataFrame:
    """doc_id, n_shingles, set_key, minima (little-endian 32-bit), sketch (their lowest bytes)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, minima = Shingles(width), Minima(hashes)
        for batch in chunks(batches):
            size, key, sig = [], [], []
            for t in texts(batch):
                s = shingles.of(t)
                size.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(minima.of(s).astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()),
                                              pa.array(sig, pa.binary()), pa.array([x and x[::4] for x in sig], pa.binary())],
                                             ["doc_id", "n_shingles", "set_key", "minima", "sketch"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, minima binary, sketch binary")


def banded(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, sketch, keys): keys holds the bucket of each band (little-endian 64-bit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column("minima"), "<u4").reshape(-1, bands, rows).astype(np.uint64)
            key = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1)
            for r in range(rows):
                key = mix(key + sig[:, :, r] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sketch"),
                                              pa.array([k.astype("<u8").tobytes() for k in key], pa.binary())], ["id", "sketch", "keys"])

    return docs.select("id", "sketch", "minima").mapInArrow(cut, "id long, sketch binary, keys binary")


def buckets(reps: DataFrame) -> DataFrame:
    """(bucket, id): one row for each band of a representative."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _matrix(batch.column("keys"), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), keys.shape[1]))],
                                                 ["bucket", "id"])

    return reps.select("id", "keys").mapInArrow(cut, "bucket long, id long")


def _matrix(column: pa.Array, kind: str = "u1") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _alike(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b), those whose signatures agree on a share of at least ``least``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = (_matrix(batch.column("sig_a")) == _matrix(batch.column("sig_b"))).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    both = (pairs.join(reps.select(F.col("id").alias("b"), F.col("sketch").alias("sig_b")), "b")
            .join(reps.select(F.col("id").alias("a"), F.col("sketch").alias("sig_a")), "a"))
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(compare, "a long, b long").distinct()


def _pool(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed): the compressed texts of documents that share a bucket with another."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [zip_.compress(t.encode()) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "packed"])

    return docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(pack, "doc_id long, packed binary")


def _confirmed(pairs: DataFrame, pool: DataFrame, width: int, threshold: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= threshold * union on the full sets.

    The members b of one a are split over tasks of about MEMBERS texts; a's text goes to each.
    """
    # written: the number of parts of each a is counted from these very rows
    pairs = materialized(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    asked = (pairs.join(parts, "a")
             .select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("doc_id")))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, unzip = Shingles(width), zstandard.ZstdDecompressor()
        heads: list[np.ndarray] = []
        now = None
        for batch in batches:
            a, b = [], []
            for key, part, one, head, packed in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "doc_id", "head", "packed"))):
                if now != (key, part):
                    now, heads = (key, part), []
                s = shingles.of(unzip.decompress(packed).decode())
                if head:
                    heads.append(s)
                elif any(_linked(h, s, threshold) for h in heads):
                    a.append(key)
                    b.append(one)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = (pool.join(asked.unionByName(heads), "doc_id").withColumn("head", F.col("doc_id") == F.col("a"))
            .repartition("a", "part").sortWithinPartitions("a", "part", F.desc("head")))
    return rows.select("a", "part", "doc_id", "head", "packed").mapInArrow(check, "a long, b long").distinct()


def _linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= threshold * (len(a) + len(b) - both)


def _across(all_buckets: DataFrame, parts: DataFrame, reps: DataFrame, pool: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links (a, b) that join different components of a bucket: enough of them to connect what is connected.

    A bucket's rows are dealt over tiles of about TILE rows by a hash of the id; each pair of tiles meets
    in one group, with sketches, bucket keys and texts. There a pair is confirmed on its full sets unless
    its components are connected already, most similar partners first; a pair that shares several
    buckets is looked at in the first of them, by the very keys that make the buckets. No group hands on
    more links than it has rows.
    """
    placed = (all_buckets.select("bucket", "id").join(parts, "id", "left")
              .select("bucket", "id", F.coalesce("component", "id").alias("component")))
    several = (placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
               .where("lo < hi").select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    spread = (placed.join(several, "bucket").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
              .withColumn("x", F.least("tile", "other")).withColumn("y", F.greatest("tile", "other")).drop("tiles", "other"))
    least = threshold / 100 - MARGIN

    def pair(table: pa.Table) -> pa.Table:
        ids, comp, tile = (table.column(c).to_numpy() for c in ("id", "component", "tile"))
        x, y, bucket = (table.column(c)[0].as_py() for c in ("x", "y", "bucket"))
        sig, keys, packed = _matrix(table.column("sketch")), _matrix(table.column("keys"), "<i8"), table.column("packed")
        shingles, unzip = Shingles(width), zstandard.ZstdDecompressor()
        sets: dict[int, np.ndarray] = {}
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        def shingled(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles.of(unzip.decompress(packed[i].as_py()).decode())
            return sets[i]

        out = []
        for i in np.flatnonzero(tile == x).tolist():
            js = np.flatnonzero((comp != comp[i]) & (tile == y) & ((ids > ids[i]) | (x != y)))
            alike = (sig[js] == sig[i]).mean(axis=1)
            keep = alike >= least
            js, alike = js[keep], alike[keep]
            shared = keys[js] == keys[i]
            here = shared.any(axis=1) & (keys[i][shared.argmax(axis=1)] == bucket)
            for j in js[here][np.argsort(-alike[here], kind="stable")].tolist():
                a, b = find(int(comp[i])), find(int(comp[j]))
                if a != b and _linked(shingled(i), shingled(j), threshold):
                    root[max(a, b)] = min(a, b)
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    rows = (spread.join(reps, "id").join(pool.withColumnRenamed("doc_id", "id"), "id")
            .select("bucket", "x", "y", "id", "component", "tile", "sketch", "keys", "packed"))
    return rows.groupBy("bucket", "x", "y").applyInArrow(pair, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 75, bands: int = BANDS, rows: int = ROWS,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    given = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    signed = materialized(signatures(given, width, bands * rows), "signatures")
    classes = (signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key")
               .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    members = materialized(signed.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "rep"), "set_key", "left"),
                           "members")
    chosen = (signed.where("doc_id is not null")
              .join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
              .withColumnRenamed("doc_id", "id"))
    reps = materialized(banded(chosen.select("id", "sketch", "minima").distinct(), bands, rows), "reps")
    least = threshold / 100 - MARGIN

    all_buckets = materialized(_shared(buckets(reps)), "buckets")
    pool = materialized(_pool(given, all_buckets.select("id").distinct()), "pool")
    first = (all_buckets.where(F.col("id") != F.col("least"))
             .groupBy(F.col("id").alias("b")).agg(F.min("least").alias("a")))
    links = materialized(_confirmed(_alike(first, reps, least), pool, width, threshold), "links")
    more = _across(all_buckets, materialized(components(links), "parts"), reps, pool, width, threshold)
    links = materialized(links.unionByName(more), "links")
    # rows with one id are one document, so its sets are linked as well
    same = members.where("rep is not null and doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    own = members.groupBy("doc_id").agg(F.countDistinct("set_key").alias("sets")).where("sets > 1").select(F.col("doc_id").alias("b"))
    joined = links.unionByName(same.join(own, "b").select("a", "b")).distinct()
    final = components(joined)
    return (members.join(final.withColumnRenamed("id", "rep"), "rep", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _shared(rows: DataFrame) -> DataFrame:
    """Bucket rows with the bucket's least id, of buckets with two members or more."""
    least = rows.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    return rows.join(least.select("bucket", "least"), "bucket")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns."""
    gone = unused("_gone", docs.columns)
    dropped = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped[gone], "left_anti")
