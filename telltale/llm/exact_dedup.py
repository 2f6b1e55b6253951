"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only.

Rows are dealt over ``runs`` runs by a hash of their identity, and each run is sorted by digest and
pre-aggregated: however often a text occurs, a run holds it once. The runs then meet in binomial
rounds. With fan-in f, round r sends every entry from run i to the run whose r-th base-f digit is
the r-th digit of the entry's digest and whose other digits are those of i; there f sorted runs are
merged and, of entries with the same digest, the best identifier is retained. After log_f(runs)
rounds the run number equals the digest's low digits, so every digest has met all its copies, and no
run ever holds more than its share: there is no root that gathers everything. Entries compare by the
64-bit digest (the sort key) and the SHA-256 of the text (the verification), so texts that only share
the short digest stay apart. Decisions go back over the first runs, never over one hot digest.

Defined cases: a null text counts as empty. Of rows equal in text, length and id, exactly one stays.
Null ids are allowed and stay only where no row of that length in the group has an id. An empty
table gives an empty result. Extra columns, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telltale.llm.common import SPACE, text_or_empty, unused
from telltale.session import materialized

FAN_IN_BITS = 3  # runs merged at once: 8
ROWS_PER_RUN = 200_000
KEY = ["run", "digest", "text_sha256"]


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, length in code points, and both digests of the text without white space."""
    plain = text_or_empty(docs, text)
    norm = docs.select(docs[doc_id].alias("doc_id"), plain.alias("raw"), F.regexp_replace(plain, SPACE, "").alias("norm"))
    return norm.select("doc_id", F.length("raw").alias("n_points"), F.xxhash64("norm").alias("digest"),
                       F.sha2(F.col("norm"), 256).alias("text_sha256"))


def _rounds(rows: int) -> int:
    """Rounds so that a run holds about ROWS_PER_RUN rows; three at least, which is 512 runs."""
    n = 3
    while rows > ROWS_PER_RUN << (FAN_IN_BITS * n):
        n += 1
    return n


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_points."""
    first = materialized(signatures(docs, doc_id, text), "digests")
    rounds = _rounds(first.count())
    runs = 1 << (FAN_IN_BITS * rounds)
    mask = F.lit((1 << FAN_IN_BITS) - 1)
    dealt = first.withColumn("run", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(runs)))
    same_row = Window.partitionBy(*KEY, "doc_id", "n_points").orderBy("n_points")
    rows = materialized(dealt.repartition(runs_in(first, runs), "run").withColumn("copy", F.row_number().over(same_row)),
                        "rows")

    best = F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    start = materialized(rows.groupBy(*KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n")), "runs")
    merged = start
    for r in range(rounds):
        shift = FAN_IN_BITS * r
        mine = F.col("run").bitwiseAND(mask * (1 << shift))
        theirs = F.shiftright("digest", shift).bitwiseAND(mask) * (1 << shift)
        merged = (merged.withColumn("run", F.col("run") - mine + theirs)
                  .repartition(runs_in(first, runs), "run").sortWithinPartitions(*KEY)
                  .groupBy(*KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n")))
    decided = merged.select("digest", "text_sha256", F.col("best.doc_id").alias("keep_id"),
                            (-F.col("best.shorter")).alias("keep_points"), F.col("n").alias("group_size"))
    back = start.select(*KEY).join(decided, ["digest", "text_sha256"])
    return rows.join(back, KEY).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
         & (F.col("copy") == 1)).alias("kept"),
        "text_sha256", "n_points")


def runs_in(df: DataFrame, runs: int) -> int:
    """Partitions for that many runs: several short runs share a task."""
    return min(runs, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    sha, n, row = (unused(c, docs.columns) for c in ("_sha", "_n", "_row"))
    keep_id, keep_sha, keep_n = (unused(c, docs.columns) for c in ("_keep_id", "_keep_sha", "_keep_n"))
    kept = exact_duplicates(docs).where("kept").select(
        F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_sha), F.col("n_points").alias(keep_n))
    plain = text_or_empty(docs)
    keyed = docs.withColumns({sha: F.sha2(F.regexp_replace(plain, SPACE, ""), 256), n: F.length(plain)})
    found = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[keep_id]) & (F.col(sha) == F.col(keep_sha)) & (F.col(n) == F.col(keep_n)))
    one = Window.partitionBy(keep_id, keep_sha, keep_n).orderBy(keep_n)  # rows equal in all three count once
    return found.withColumn(row, F.row_number().over(one)).where(F.col(row) == 1).select(*docs.columns)
