"""Benchmark decontamination by a positional inverted index: which documents hold phrases of test items, and where.

``build_index`` writes the postings (term, row, pos) of every word of the documents that some phrase holds, sorted
by term within each file; no other list can be asked for. Beside them it has one row per document with its id and
number of words. A phrase is looked up from its rarest terms: the list of the rarest one gives the places where the
phrase could begin, the list of the second rarest, adjusted by the distance of the two, is intersected with them
(phrases with the same two terms and distance share this), and the few places left are held against the lists of
all other terms. All intersections are joins on (row, position, term), of which no two postings are equal, so a word
of any frequency is dealt evenly. With ``slop`` above 0 a term may stand that many words from its place: proximity
instead of exact phrases.

Everything is DataFrame operations. Term and phrase tables come from the items alone and are broadcast only where
their counted size allows it.

Defined cases: null has no words, nor has a text without letters, digits or other characters above U+007F: such
documents hold nothing and such items are found nowhere. Rows of one item id are one item; an item without id
marks words but is not counted or listed. Every document row gives one row, also with null or repeated ids. An empty
table of documents gives an empty result, an empty table of items marks nothing. Other columns, whatever
their names, are not touched.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.session import broadcast_if_small, materialized

LENGTH = 10
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Words with A-Z in lower case; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)  # where lower() knows A-Z alone
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, BETWEEN, -1), "")  # three times as fast as extracting all matches


@dataclass(frozen=True)
class Phrases:
    """Distinct phrases of the items, numbered."""

    items: DataFrame  # phrase, item_id
    terms: DataFrame  # phrase, length, place, term (the word itself)


def phrases_of(tests: DataFrame, length: int = LENGTH, item_id: str = "item_id", text: str = "text") -> Phrases:
    """Every run of ``length`` words of an item; an item of fewer words is one phrase."""
    words = tests.select(tests[item_id].alias("item_id"), word_list(tests[text]).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - length, F.lit(0))
    runs = words.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(0), last), lambda at: F.slice("words", at + 1, length))).alias("run"))
    numbered = materialized(runs.select("run").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    return Phrases(runs.join(numbered, "run").select("phrase", "item_id").distinct(),
                   numbered.select("phrase", F.size("run").alias("length"), F.posexplode("run").alias("place", "term")))


@dataclass(frozen=True)
class Index:
    terms: DataFrame  # term (the word), number, n (its postings)
    postings: DataFrame  # number, row, pos
    documents: DataFrame  # row, doc_id, n_words


def build_index(docs: DataFrame, phrases: Phrases, doc_id: str = "doc_id", text: str = "text") -> Index:
    """One pass over the texts; documents are numbered in it, and a row without a number closes each document."""
    terms = materialized(phrases.terms.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "terms")
    numbered = docs.select(docs[doc_id].alias("doc_id"), word_list(docs[text]).alias("words"),
                           F.monotonically_increasing_id().alias("row"))  # before the words are dealt out, not after
    closing = F.concat(F.lit(" "), F.col("row").cast("string"))  # no word has a space
    each = numbered.select("row", "doc_id", F.posexplode(F.concat("words", F.array(closing))).alias("pos", "term"))
    closes = F.col("term").startswith(" ")
    found = (each.join(broadcast_if_small(terms), "term", "left").where(F.col("number").isNotNull() | closes)
             .select("number", "row", "pos", F.when(closes, F.col("doc_id")).alias("doc_id")))
    written = materialized(found.sortWithinPartitions("number", "row", "pos"), "postings")
    postings = written.where(F.col("number").isNotNull()).select("number", "row", "pos")
    sizes = postings.groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    return Index(materialized(terms.join(sizes, "number"), "sizes"), postings,
                 written.where(F.col("number").isNull()).select("row", "doc_id", F.col("pos").cast("long").alias("n_words")))


def occurrences(index: Index, phrases: Phrases, slop: int = 0) -> DataFrame:
    """Distinct (phrase, row, start, length): where every term of a phrase stands within ``slop`` words of its place,
    the places being counted from an occurrence of the rarest term."""
    by_phrase = Window.partitionBy("phrase").orderBy("n", "place")  # at most ``length`` rows
    ranked = (phrases.terms.join(index.terms, "term")
              .withColumns({"rank": F.row_number().over(by_phrase),
                            "present": F.count(F.lit(1)).over(Window.partitionBy("phrase"))})
              .where(F.col("present") == F.col("length")).select("phrase", "length", "place", "number", "rank"))
    ranked = materialized(ranked, "ranked")
    seeds = (ranked.groupBy("phrase", "length").agg(
        *[F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("number", "place")])
        .select("phrase", "length", "place1", "number1", F.coalesce("number2", F.lit(-1)).alias("number2"),
                F.coalesce(F.col("place2") - F.col("place1"), F.lit(0)).alias("apart")))
    seeds = materialized(seeds, "seeds")
    pairs = seeds.select("number1", "number2", "apart").distinct()

    # lists of the rarest terms, and of them the places that the second rarest confirms
    rare = (index.postings.withColumnRenamed("number", "number1").join(broadcast_if_small(pairs), "number1")
            .withColumnRenamed("pos", "at"))
    second = index.postings.join(broadcast_if_small(pairs.select(F.col("number2").alias("number")).distinct()), "number", "left_semi")
    both = _confirmed(rare.where(F.col("number2") >= 0), second, F.col("at") + F.col("apart"), "number2", slop)
    places = materialized(both.unionByName(rare.where(F.col("number2") < 0)), "places")
    begun = (places.join(broadcast_if_small(seeds), ["number1", "number2", "apart"])
             .select("phrase", "length", "row", (F.col("at") - F.col("place1")).alias("start")))

    # of the documents left, the lists of all other terms
    rest = ranked.where(F.col("rank") > 2).select("phrase", "place", "number")
    postings = index.postings.join(broadcast_if_small(places.select("row").distinct()), "row", "left_semi")
    asked = begun.where(F.col("length") > 2).join(broadcast_if_small(rest), "phrase")
    met = (_confirmed(asked, postings, F.col("start") + F.col("place"), "number", slop)
           .groupBy("phrase", "length", "row", "start").agg(F.count(F.lit(1)).alias("met"))
           .where(F.col("met") == F.col("length") - 2).drop("met"))
    return met.unionByName(begun.where(F.col("length") <= 2))


def _confirmed(asked: DataFrame, postings: DataFrame, pos: Column, number: str, slop: int) -> DataFrame:
    """Rows of ``asked`` whose term ``number`` stands in the same document within ``slop`` of ``pos``."""
    wanted = asked.withColumn("_pos", pos)
    if slop:  # a fixed number of places to look at for each row
        wanted = wanted.withColumn("_pos", F.explode(F.sequence(F.col("_pos") - slop, F.col("_pos") + slop)))
    have = postings.select(F.col("row").alias("_row"), F.col("pos").alias("_at"), F.col("number").alias("_number"))
    met = wanted.join(have, (F.col("row") == F.col("_row")) & (F.col("_pos") == F.col("_at"))
                      & (F.col(number) == F.col("_number")), "left_semi").drop("_pos")
    return met.distinct() if slop else met


def words_hit(found: DataFrame) -> DataFrame:
    """(row, n_hit): words inside any occurrence, each counted once."""
    spans = found.select("row", "start", (F.col("start") + F.col("length")).alias("end")).groupBy("row", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # spans of one document
    reached = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    return (spans.withColumn("fresh", F.greatest(F.col("end") - reached, F.lit(0)))
            .groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit")))


def contamination(docs: DataFrame, tests: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids as strings, in order), contaminated."""
    phrases = phrases_of(tests, length, item_id, item_text)
    index = build_index(docs, phrases, doc_id, text)
    found = materialized(occurrences(index, phrases), "occurrences")
    items = (found.join(broadcast_if_small(phrases.items), "phrase").where(F.col("item_id").isNotNull())
             .groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    hits = words_hit(found).join(items, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return index.documents.join(hits, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"))
