"""Toxicity by weak supervision: many weak voters, a generative label model, a linear classifier.

Voters are lexicon words (a fixed list, and words mined from training labels that occur in many
different contexts, nearly all of them toxic) and patterns (several insults, repeats, shouting near an
insult, insults per word, and one voter for the clean class). Each may abstain. The label model is a
mixture of two classes with one accuracy per voter and class, fitted by expectation maximisation on
the votes of the sampled training rows, where the label given there is one more, fallible, voter.
Voters that go together beyond what the class explains would be counted twice: the residual
correlation of each pair under the posterior is estimated, and each voter's evidence is divided by the
correlated voters it stands for. The posteriors, as soft labels, train a logistic regression over the
voters' counts; its slope and intercept are then set on the training labels (Platt scaling).

Only the training sample reaches the driver: at most ``max_rows`` (20,000) labelled rows outside the
held-out third, the same ones each time (smallest hash of the id). Scoring covers every row and text.

Defined cases: null and empty texts get the classifier's value for no votes; repeated rows are scored
each; with no labelled rows, or labels of one class, the fixed lexicon alone decides; an empty table
gives an empty result. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.llm.common import remainder, texts, unused

# Fixed seed lexicon.
LEXICON = ("idiot", "moron", "stupid", "pathetic", "scum", "loser", "clown", "trash", "worthless", "disgusting",
           "imbecile", "garbage", "dumbass", "bastard", "bitch", "asshole", "fuck", "shithead", "vermin", "retard")
PATTERNS = ("two_hits", "three_kinds", "same_again", "shouted", "dense", "none")
HELD_OUT = 3
_LETTERS = re.compile(r"[^\W\d_]+")


class Voters:
    """Counts per text: one per lexicon word, then the patterns."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = lexicon
        self.names = [*lexicon, *PATTERNS]
        self.find = ahocorasick.Automaton()
        for i, w in enumerate(lexicon):
            self.find.add_word(w, (i, len(w)))
        self.find.make_automaton()

    def counts(self, text: str) -> np.ndarray:
        out = np.zeros(len(self.names))
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when lowered
            text = low
        k = len(self.lexicon)
        shouted = again = 0
        last = -1
        for end, (i, size) in self.find.iter(low):
            start = end - size + 1
            if (start and low[start - 1].isalpha()) or (end + 1 < len(low) and low[end + 1].isalpha()):
                continue
            out[i] += 1
            shouted += text[start:end + 1].isupper() or low[end + 1:end + 2] == "!"
            again += i == last
            last = i
        hits, kinds = out[:k].sum(), (out[:k] > 0).sum()
        out[k:] = (hits >= 2, kinds >= 3, again > 0, shouted, hits * 200 >= 1 + low.count(" "), hits == 0)
        return out


def votes_of(counts: np.ndarray) -> np.ndarray:
    """1 where a voter speaks, 0 where it abstains."""
    return (counts > 0).astype(float)


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, text and toxic of at most ``max_rows`` labelled rows that are not held out: one for an id, its greatest text."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .where(remainder(F.col("doc_id"), HELD_OUT) != 1)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # at most max_rows rows of two numbers: the broadcast has a fixed bound
    return (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where(F.col("text").isNotNull())
            .groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")))


def mined_words(sample: DataFrame, least: int = 10, share: float = 0.9, most: int = 50) -> list[str]:
    """Words met in at least ``least`` different contexts in toxic rows, and in few others.

    A context is the pair of neighbours, so a passage copied many times counts once.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, c, y = [], [], []
            for t, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
                ws = ["", *(x.group() for x in _LETTERS.finditer(t.lower())), ""]
                at = {(b, f"{a} {d}") for a, b, d in zip(ws, ws[1:], ws[2:]) if len(b) > 3}
                w += [b for b, _ in at]
                c += [x for _, x in at]
                y += [toxic] * len(at)
            yield pa.RecordBatch.from_pydict({"word": w, "context": c, "toxic": y},
                                             pa.schema([("word", pa.string()), ("context", pa.string()), ("toxic", pa.int32())]))

    rows = (sample.select("text", "toxic").mapInArrow(contexts, "word string, context string, toxic int")
            .groupBy("word", "context").agg(F.max("toxic").alias("toxic"))
            .groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
            .where((F.col("bad") >= least) & (F.col("bad") >= share * F.col("n")))
            .orderBy(F.desc("bad"), "word").limit(most))
    return [r.word for r in rows.collect()]


class LabelModel:
    """Two classes, voters with an accuracy per class, and correlated voters sharing their evidence."""

    def fit(self, votes: np.ndarray, given: np.ndarray, rounds: int = 50) -> "LabelModel":
        n = len(votes)
        all_votes = np.c_[votes, given]
        q = np.where(given > 0, 0.9, 0.05)
        share = np.ones(all_votes.shape[1])
        for r in range(rounds):
            self.prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
            self.p1 = (q @ all_votes + 1) / (q.sum() + 2)
            self.p0 = ((1 - q) @ all_votes + 1) / (n - q.sum() + 2)
            if r == 5:
                share = 1 / self._stands_for(all_votes, q)
            odds = (all_votes @ (share * np.log(self.p1 / self.p0))
                    + (1 - all_votes) @ (share * np.log((1 - self.p1) / (1 - self.p0))))
            new = 1 / (1 + np.exp(-np.clip(odds + np.log(self.prior / (1 - self.prior)), -30, 30)))
            if np.abs(new - q).max() < 1e-6:
                break
            q = new
        self.posterior = q
        return self

    def _stands_for(self, votes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """1 plus the squared residual correlations with the other voters."""
        rest = votes - np.outer(q, self.p1) - np.outer(1 - q, self.p0)
        size = np.sqrt((rest ** 2).mean(0)) + 1e-9
        self.correlation = rest.T @ rest / len(votes) / np.outer(size, size)
        return (self.correlation ** 2).sum(1)


class Classifier:
    """Logistic regression on log counts, fitted by Newton steps with a small penalty."""

    def __init__(self, n: int):
        self.w, self.scale = np.zeros(n + 1), (1.0, 0.0)

    @staticmethod
    def features(counts: np.ndarray) -> np.ndarray:
        return np.log1p(np.minimum(counts, 20))

    @staticmethod
    def newton(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
        x = np.c_[x, np.ones(len(x))]
        w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty
        ridge[-1, -1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
            w = w + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        return w

    def fit(self, counts: np.ndarray, posterior: np.ndarray, given: np.ndarray) -> "Classifier":
        x = self.features(counts)
        self.w = self.newton(x, posterior, 1.0)
        a, b = self.newton(self._raw(x)[:, None], given.astype(float), 1e-3)
        self.scale = (max(a, 1e-3), b)
        return self

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]

    def score(self, counts: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self._raw(self.features(counts)) + b, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> tuple[list[str], Classifier]:
    """The lexicon in use and the fitted classifier."""
    sample = training_sample(docs, labels, max_rows)
    lexicon = list(dict.fromkeys([*LEXICON, *mined_words(sample)]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for batch in batches:
            rows = [voters.counts(t).tolist() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "counts"])

    got = sample.select("text", "toxic").mapInArrow(count, "toxic int, counts array<double>").toPandas()
    width = len(lexicon) + len(PATTERNS)
    counts = np.array(got["counts"].tolist()).reshape(-1, width)
    given = got["toxic"].to_numpy()
    model = Classifier(width)
    if len(set(given.tolist())) < 2:
        model.w[:len(lexicon)], model.w[-1] = 4.0, -4.0
        return lexicon, model
    votes = votes_of(counts)
    posterior = LabelModel().fit(votes, (given > 0).astype(float)).posterior
    return lexicon, model.fit(counts, posterior, given > 0)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 20_000) -> DataFrame:
    """``docs`` with a score in [0, 1] and the decision (1 at ``threshold`` or above), in the last two columns.

    They are called _score and _toxic, with more underscores where ``docs`` has such columns.
    """
    lexicon, model = train(docs, labels, max_rows)
    names = [unused(c, docs.columns) for c in ("_score", "_toxic")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for batch in batches:
            counts = np.array([voters.counts(t) for t in texts(batch)]).reshape(-1, len(voters.names))
            s = model.score(counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             [*batch.schema.names, *names])

    added = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *added]))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    scored = score_toxicity(docs, labels, **options)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns)
