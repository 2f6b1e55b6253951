"""Secrets: fixed shapes, and strings in a sensitive place that a primed compressor can't shorten.

The base scan finds assignments, access keys and long hexadecimal runs. The novelty scan looks at
every further token of ``min_length`` characters or more, with letters and digits, in a sensitive place:
up to REACH code points before or after a sensitive word, whatever lines lie between, and the whole of a
private-key block from its header to its END line (to the end of the text, if there is none). A
zstandard compressor is primed with the identifiers that the corpus
itself uses around sensitive words, and the text around the candidate is compressed with and
without it: the difference is the candidate's marginal size. Prose, paths and identifiers cost a
fraction of a byte per character there; a key costs nearly what its alphabet demands. Candidates at
or above ``min_cost`` bytes per character are reported as kind ``novel``.

Spans are code points, end exclusive. Defined cases: a null or empty text has no spans; repeated rows
are reported each; a text of any length is scanned whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.llm.common import texts

# Fixed patterns of the base scan, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

# Fixed words that make a place sensitive.
SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "credential", "private", "bearer")
_PLACE = re.compile("|".join(SENSITIVE), re.I | re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_IDENTIFIER = re.compile(r"[^\W\d]\w{2,}")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?=-----END|\Z)", re.S)
NEAR = 80  # code points on either side that count as surrounding text
REACH = 400  # code points before and after a sensitive word that its place covers

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed shapes, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Spans:
    """Disjoint spans made of overlapping ones."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meet(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end


def places(text: str) -> Spans:
    """What counts as near a sensitive word, or lies in a private-key block."""
    if not _shown(text):
        return Spans([])
    near = [(max(0, m.start() - REACH), m.end() + REACH) for m in _PLACE.finditer(text)]
    blocks = [m.span() for m in _KEY_BLOCK.finditer(text)] if "PRIVATE KEY-----" in text else []
    return Spans(near + blocks)


def candidates(text: str, taken: list[tuple[int, int, int]], where: Spans) -> Iterator[tuple[int, int]]:
    """Whole tokens with letters and digits that lie in or reach into ``where``, outside ``taken``."""
    if not where.starts:
        return
    used = Spans([(a, b) for a, _, b in taken])
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        if where.meet(start, end) and not used.meet(start, end) and _mixed(m.group()):
            yield start, end


class Novelty:
    """Marginal compressed size of a string, given its surroundings and a dictionary."""

    def __init__(self, identifiers: list[str]):
        # most useful content last, where zstandard's window finds it cheapest
        content = " ".join(reversed(identifiers)).encode() or b" "
        prime = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.pack = zstandard.ZstdCompressor(level=3, dict_data=prime, write_content_size=False, write_checksum=False)

    def cost(self, before: str, token: str, after: str) -> float:
        """Bytes that the token adds, per character of it."""
        around = len(self.pack.compress((before + after).encode()))
        return (len(self.pack.compress((before + token + after).encode())) - around) / len(token)


def identifier_dictionary(docs: DataFrame, size: int = 2000, text: str = "text") -> list[str]:
    """The ``size`` most frequent identifiers around sensitive words, over all documents."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = {}
            for t in texts(batch):
                for m in _PLACE.finditer(t):
                    for w in _IDENTIFIER.findall(t[max(0, m.start() - NEAR):m.end() + NEAR]):
                        if not any(c.isdigit() for c in w):
                            counts[w] = counts.get(w, 0) + 1
            yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())},
                                             pa.schema([("word", pa.string()), ("n", pa.int64())]))

    shown = docs.select(F.col(text).alias("text")).where(F.lower("text").rlike("|".join(SENSITIVE)))
    top = (shown.mapInArrow(near, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(size))
    return [r.word for r in top.collect()]


def scan_secrets(docs: DataFrame, min_cost: float = 0.5, min_length: int = 16, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per document with its counts, a digest of the base spans, and all spans."""
    known = identifier_dictionary(docs, text=text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")}
            for t in texts(batch):
                base = base_spans(t)
                more = []
                for start, end in candidates(t, base, places(t)):
                    if end - start >= min_length and novelty.cost(t[max(0, start - NEAR):start], t[start:end],
                                                                  t[end:end + NEAR]) >= min_cost:
                        more.append((start, 3, end))
                listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(s[1] == k for s in base))
                out["n_novel"].append(len(more))
                out["base_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
                out["spans"].append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more)) if more else listed)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds))],
                                             ["doc_id", *out])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(scan, SCHEMA)


def _shown(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in SENSITIVE)


def _mixed(token: str) -> bool:
    return re.search("[0-9]", token) is not None and re.search("[A-Za-z]", token) is not None
