"""Byte-pair encoding of whole texts by batched merge rounds, and decoding.

The vocabulary file's tokens mark word ends, so a word's ids depend on the word alone. A task cuts its
texts into words, numbers each distinct word, and encodes the new ones together: the symbols of all
words lie in one flat array. In a round every word finds its lowest-ranked adjacent pair (ranks come
from a binary search over the sorted pair keys) and merges it; only pairs next to a merge are looked
up again, and words without a pair leave the array. A pair is merged at all its places at once where
no later merge can come before it; else only at its leftmost place, as one-by-one merging would do.

Text is brought to NFC and lower case character by character; strings with other than ASCII characters are
folded and cut by the library's own normalizer and pattern engine, since Unicode versions differ in what is a letter.
White space ends words and is dropped;
the file's special tokens are found in the text as it came. Decoding joins the tokens' strings by
blanks, as the file defines no decoder. Defined cases: null and empty texts have no tokens; rows may
repeat and are encoded each; a text may have any length, its memory is a small multiple of it; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from telltale.llm.common import Numbered, chunks, texts

# Fixed word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD = regex.compile(PATTERN)
SPACES = regex.compile(r"\s+")
_NOT_SPACE = regex.compile("[\x1c-\x1f]")
NONE = np.int32(2**31 - 1)
WORDS_KEPT = 1_000_000  # distinct words a task remembers before it starts anew; results don't depend on it


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


FOLD = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
CUT = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)


class WordBpe:
    """Encoder and decoder for a vocabulary with word ends, as stored by the tokenizers library."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, self.end = data["model"], data["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = np.array([""] * size, dtype=object)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.first = np.array([self.vocab[c] for c in letters], np.int32)
        self.last = np.array([self.vocab[c + self.end] for c in letters], np.int32)
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs))
        order = np.argsort(left << 32 | right, kind="stable")
        self.keys, self.ranks, self.made = (left << 32 | right)[order], order.astype(np.int32), made.astype(np.int32)
        # a merge is safe to apply everywhere at once when what it makes takes part in later merges only
        soonest = np.full(size, NONE, np.int64)
        np.minimum.at(soonest, left, np.arange(len(left)))
        np.minimum.at(soonest, right, np.arange(len(left)))
        self.safe = soonest[made] > np.arange(len(made))
        self.twin = left == right
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    # -- words -------------------------------------------------------------------------------
    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and each word's number of ids."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym, ends = self.first[flat], np.cumsum(size)
        sym[ends[size > 0] - 1] = self.last[flat[ends[size > 0] - 1]]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        rank = np.full(len(sym), NONE, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:]) if len(word) else np.zeros(0, np.int64)
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            stop = np.repeat(best == NONE, length)
            if stop.any():
                done.append((word[stop], sym[stop]))
                sym, word, rank = sym[~stop], word[~stop], rank[~stop]
                length, best = length[best != NONE], best[best != NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, length))
            hit = self._apart(hit, rank[hit], word[hit])
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank, hit = sym[keep], word[keep], rank[keep], moved[hit]
            touched = np.zeros(len(sym) + 1, bool)
            touched[hit] = touched[hit - 1] = True  # place -1 is the spare one at the end
            near = np.flatnonzero(touched[:-1])
            inside = near[near + 1 < len(sym)]
            inside = inside[word[inside] == word[inside + 1]]
            rank[near] = NONE
            rank[inside] = self._rank(sym[inside], sym[inside + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(raw), np.int64)
        word, sym = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(raw))

    def _apart(self, hit: np.ndarray, rank: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of the places found, those to merge in this round."""
        first = np.r_[True, word[1:] != word[:-1]]
        ok = first | self.safe[rank]
        if self.twin[rank].any():  # of x x x, pairs at even steps from the run's start
            run = np.r_[True, (hit[1:] != hit[:-1] + 1) | first[1:]]
            step = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            ok &= ~self.twin[rank] | (step % 2 == 0)
        return hit[ok]

    # -- texts -------------------------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """The words of a text, and its special tokens marked by a leading NUL."""
        if self.split is None or "<|" not in text:
            return self._words(text)
        out: list[str] = []
        at = 0
        for m in self.split.finditer(text):
            out += [*self._words(text[at:m.start()]), "\0" + m.group()]
            at = m.end()
        return out + self._words(text[at:])

    @staticmethod
    def _words(text: str) -> list[str]:
        if text.isascii():
            return WORD.findall(text.lower())
        return [w for w, _ in CUT.pre_tokenize_str(FOLD.normalize_str(text))]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.tokens[ids].tolist())


class TextEncoder:
    """Encodes texts, remembering the strings between white space that it has met."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self._forget()

    def _forget(self) -> None:
        self.known = Numbered()
        self.ids, self.count, self.start = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, batch: list[str]) -> Iterator[np.ndarray]:
        if len(self.known) > WORDS_KEPT:
            self._forget()
        known, before = self.known, len(self.known)
        rows = [np.array([known[w] for w in self._strings(t)], np.int64) for t in batch]
        if len(known) > before:
            self._learn(list(islice(known, before, None)))
        for row in rows:
            yield gather(self.ids, self.start[row], self.count[row])

    @staticmethod
    def _strings(text: str) -> list[str]:
        if _NOT_SPACE.search(text):  # str.split() would cut there
            return [w for w in SPACES.split(text) if w]
        return text.split()

    def _learn(self, strings: list[str]) -> None:
        """Encode new strings: their distinct words first, then the strings from those."""
        words = Numbered()
        pieces = [[words[w] for w in self.bpe.pieces(s)] for s in strings]
        marked = {i: self.bpe.special[w[1:]] for w, i in words.items() if w[0] == "\0" and w[1:] in self.bpe.special}
        ids, count = self.bpe.encode_words([w if i not in marked else "!" for w, i in words.items()])
        start = np.cumsum(count) - count
        for i, token in marked.items():
            ids[start[i]] = token
        of = np.fromiter(chain.from_iterable(pieces), np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = np.r_[0, np.cumsum(count[of])]
        ends = np.cumsum(size)
        self.ids = np.r_[self.ids, gather(ids, start[of], count[of])]
        self.count = np.r_[self.count, total[ends] - total[ends - size]]
        self.start = np.cumsum(self.count) - self.count


def gather(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices values[start:start + count], one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - (ends - count), count) + np.arange(total)]


def _with_ids(docs: DataFrame, vocabulary: str, doc_id: str, text: str, schema: str, finish) -> DataFrame:
    """Run ``finish(bpe, ids)`` over every text; the vocabulary file travels with the job."""
    spec = open(vocabulary, encoding="utf-8").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(spec)
        encoder = TextEncoder(bpe)
        for batch in chunks(batches, 4 << 20):
            rows = [finish(bpe, ids) for ids in encoder.encode(texts(batch))]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, kept + names)

    kept = [doc_id]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[c.split()[1]] for c in schema.split(", ")]
    given = docs.select(docs[doc_id].cast("long").alias(doc_id), docs[text].cast("string").alias("text"))
    return given.mapInArrow(run, f"{doc_id} long, {schema}")


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the ids of its whole text."""
    return _with_ids(docs, vocabulary, doc_id, text, "ids array<int>", lambda bpe, ids: (ids,))


def decode(encoded: DataFrame, vocabulary: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the text that the ids stand for."""
    spec = open(vocabulary, encoding="utf-8").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(spec)
        for batch in batches:
            rows = [bpe.decode(np.array(r or [], np.int64)) for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], [doc_id, "text"])

    given = encoded.select(encoded[doc_id].cast("long").alias(doc_id), encoded[ids].alias("ids"))
    return given.mapInArrow(run, f"{doc_id} long, text string")


def round_trip(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text, encoded and decoded in one pass."""

    def finish(bpe: WordBpe, ids: np.ndarray) -> tuple:
        return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(bpe.decode(ids).encode()).hexdigest())

    return _with_ids(docs, vocabulary, doc_id, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish)
