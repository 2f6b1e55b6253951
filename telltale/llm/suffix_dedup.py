"""Repeated passages by column-wise construction of collection Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id is
removed. Equal strings must meet, so positions are dealt by content: the smallest hash among a window's
``KMER``-byte pieces is its key, neighbouring windows with one key form a run, and a run's text (at
most ``length + RUN - 1`` bytes) goes to its key's bucket. Equal run texts of a chunk of documents
are sent once, with the smallest id that holds them.

1. Texts are packed into chunks and written once, compressed.
2. Per key bucket, keys that occur in one document alone are found and left out.
3. Per bucket, the run texts under one key are the documents of a small collection. Its Burrows-Wheeler
   transform and common prefixes grow by one symbol per run text and round, from the ends to the starts;
   a round reads the columns of the round before in order and writes new ones. Windows whose common
   prefixes reach ``length`` are equal, and each learns the smallest id of its group. A key with one
   run text needs no order, nor does a text whose surroundings of the key's piece no other text has.
4. Chunks get the ids back and cut their documents.

A collection is bounded, so its columns stay in the task's memory instead of in files; what outlives a
task lies in the written tables. A key in at least ``hot_docs`` documents is split: there every window is
a run of its own and is dealt by the hash of the window, so a passage that a third of all documents
share spreads over all buckets.

Defined cases: null and empty texts are 0 bytes; texts under ``length`` bytes lose nothing; rows
with equal ids don't remove from each other; a null id counts as larger than all others; texts of any
length are whole, and one text is the least a chunk can hold; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.llm.common import chunks
from telltale.llm.minhash import mix
from telltale.session import materialized

LENGTH, KMER, RUN = 50, 16, 36
CHUNK_BYTES = 8 << 20
GROUP_BYTES = 64 << 10
BUCKET_BYTES = 2 << 20
HOT_DOCS = 2000
COLLECTION = 4000  # run texts ordered together
PLACE = 48  # bits of a place, below its symbol
PLACES = (1 << PLACE) - 1
NO_ID = np.iinfo(np.int64).max

ANSWER = [("row", "<i4"), ("at", "<i4"), ("size", "u1"), ("first", "u1"), ("windows", "u1"), ("least", "<i8")]


# -- windows and runs ----------------------------------------------------------------------------
def eight_bytes(raw: bytes) -> np.ndarray:
    """The eight bytes from every place on as a number."""
    return np.ndarray(len(raw) - 7, np.uint64, raw, 0, (1,)).copy()


def hashed_pieces(eight: np.ndarray) -> np.ndarray:
    """The hash of the piece of ``KMER`` bytes at every place."""
    return mix(eight[:8 - KMER] + mix(eight[KMER - 8:]))


def runs_of(raw: bytes, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, text, first window and number of windows of each run of the texts that follow each other in ``raw``."""
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = hashed_pieces(eight_bytes(raw))
    width, span = length - KMER + 1, 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if width > span:
        low = np.minimum(low[:span - width], low[width - span:])
    # runs begin where the smallest hash changes and where a text does; its last window ends them
    row = np.flatnonzero(windows)
    begin = (np.cumsum(sizes) - sizes)[row]
    stop = begin + windows[row]
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    of = np.searchsorted(begin, change, "right") - 1
    start = np.sort(np.concatenate([begin, change[(change > begin[of]) & (change < stop[of]) & (of >= 0)]]))
    of = np.searchsorted(begin, start, "right") - 1
    size = np.minimum(np.append(start[1:], stop[-1]), stop[of]) - start
    low, row, place = low[start], row[of], start - begin[of]
    if size.max() <= RUN:
        return mix(low), row, place, size
    # a long run of one key is cut from its start
    parts = -(-size // RUN)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    key, row, place, rest = (np.repeat(x, parts) for x in (mix(low), row, place, size))
    return key, row, place + step * RUN, np.minimum(rest - step * RUN, RUN)


class Chunk:
    """The texts of a chunk with the runs of all of them."""

    def __init__(self, packed: bytes, ids: list, sizes: list, length: int):
        raw = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
        sizes = np.array(sizes, np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        self.texts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        # short texts are looked at together, as many as the processor's cache holds
        cuts = [0, *(np.flatnonzero(np.diff((ends - 1) // GROUP_BYTES)) + 1).tolist(), len(sizes)]
        found = [runs_of(raw[starts[a]:ends[b - 1]], sizes[a:b], length) for a, b in zip(cuts, cuts[1:])]
        self.key, self.start, self.size = (np.concatenate([f[k] for f in found]) for k in (0, 2, 3))
        self.row = np.concatenate([f[1] + a for f, a in zip(found, cuts)])


def packed_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Chunk rows: chunk, ids, sizes and the compressed bytes of all their texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, task = zstandard.ZstdCompressor(level=3), TaskContext.get()
        for n, batch in enumerate(chunks(batches, CHUNK_BYTES)):
            raw = [t or b"" for t in batch.column("text").to_pylist()]
            if raw:
                yield pa.RecordBatch.from_pydict({"chunk": [task.partitionId() << 32 | n], "ids": [batch.column("doc_id").to_pylist()],
                                                  "sizes": [[len(t) for t in raw]], "packed": [zip_.compress(b"".join(raw))]}, kinds)

    kinds = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("packed", pa.binary())])
    given = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").cast("binary").alias("text"))
    return given.mapInArrow(pack, "chunk long, ids array<long>, sizes array<long>, packed binary")


def _each(batch: pa.RecordBatch, *columns: str):
    return zip(*(batch.column(c).to_pylist() for c in columns))


def _cuts(home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, and where each bucket's part begins."""
    order = np.argsort(home, kind="stable")
    return order, np.flatnonzero(np.r_[True, home[order][1:] != home[order][:-1], True]) if len(home) else np.zeros(1, np.int64)


# -- keys of several documents -----------------------------------------------------------------
def shared_keys(packed: DataFrame, buckets: int, length: int, hot_docs: int) -> DataFrame:
    """(chunk, bucket, hot, keys): each chunk's keys that two documents hold; hot if ``hot_docs`` or more do.

    Keys are compared by 32 bits within a bucket: a chance match only sends a run in vain.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, sizes, raw in _each(batch, "chunk", "ids", "sizes", "packed"):
                c = Chunk(raw, ids, sizes, length)
                order = np.argsort(c.key, kind="stable")
                key, row = c.key[order], c.row[order]
                first = np.r_[True, key[1:] != key[:-1]][:len(key)]
                docs = np.add.reduceat((first | np.r_[True, row[1:] != row[:-1]][:len(row)]).astype(np.int64), np.flatnonzero(first)) \
                    if len(key) else np.zeros(0, np.int64)
                key = key[first]
                part, cut = _cuts((key % np.uint64(buckets)).astype(np.int64))
                rest = (key // np.uint64(buckets)).astype("<u4")
                for a, b in zip(cut, cut[1:]):
                    i = part[a:b]
                    yield pa.RecordBatch.from_pydict({"chunk": [chunk], "bucket": [int(key[i[0]] % np.uint64(buckets))], "keys": [rest[i].tobytes()],
                                                      "docs": [np.minimum(docs[i], 255).astype("u1").tobytes()]}, sent)

    def find(table: pa.Table) -> pa.Table:
        chunk, keys, docs = (table.column(c).to_pylist() for c in ("chunk", "keys", "docs"))
        key = np.frombuffer(b"".join(keys), "<u4")
        n = np.bincount(np.unique(key, return_inverse=True)[1], np.frombuffer(b"".join(docs), "u1"))
        value = np.unique(key)
        bucket = table.column("bucket")[0].as_py()
        out = {"chunk": [], "bucket": [], "hot": [], "keys": []}
        for c, k in zip(chunk, keys):
            k = np.frombuffer(k, "<u4")
            total = n[np.searchsorted(value, k)]
            for hot, part in ((False, k[(total >= 2) & (total < hot_docs)]), (True, k[total >= hot_docs])):
                if len(part):
                    for name, v in (("chunk", c), ("bucket", bucket), ("hot", hot), ("keys", part.tobytes())):
                        out[name].append(v)
        return pa.Table.from_pydict(out, got)

    sent = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])
    got = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("hot", pa.bool_()), ("keys", pa.binary())])
    return (packed.mapInArrow(send, "chunk long, bucket long, keys binary, docs binary").groupBy("bucket")
            .applyInArrow(find, "chunk long, bucket long, hot boolean, keys binary"))


# -- run texts -------------------------------------------------------------------------------------
def run_texts(packed: DataFrame, shared: DataFrame, key_buckets: int, buckets: int, length: int) -> DataFrame:
    """(chunk, bucket, n, runs): the different run texts of a chunk under shared keys, with their smallest ids.

    A bucket compares keys by 32 bits: keys that agree by chance are ordered together, which changes nothing.
    """

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in kinds.names}
        if left.num_rows and right.num_rows:
            head = left.to_pylist()[0]
            c, zip_ = Chunk(head["packed"], head["ids"], head["sizes"], length), zstandard.ZstdCompressor(level=1)
            state = _states(c.key, right, key_buckets)
            found: dict[bytes, list[int]] = {}
            hit = np.flatnonzero(state)
            row_ids = c.ids.tolist()
            for row, start, size, key_, kind in zip(*(x[hit].tolist() for x in (c.row, c.start, c.size, c.key, state))):
                text, doc = c.texts[row], row_ids[row]
                if kind == 1:
                    spans = [(start, size + length - 1, key_)]
                else:  # each window on its own, under a key of its own
                    spans = [(at, length, xxhash.xxh3_64_intdigest(text[at:at + length])) for at in range(start, start + size)]
                for at, n, k in spans:
                    had = found.setdefault(text[at:at + n], [doc, row, at, k])
                    had[0] = min(had[0], doc)
            texts = list(found)
            least, rows, at, keys = (np.array([v[j] for v in found.values()], kind)
                                     for j, kind in enumerate(("<i8", "<i4", "<i4", "<u8")))
            home = (mix(keys) % np.uint64(buckets)).astype(np.int64)
            order, cuts = _cuts(home)
            for a, b in zip(cuts, cuts[1:]):
                i = order[a:b]
                sizes = np.array([len(texts[j]) for j in i], "u1")
                blob = [sizes.tobytes(), (keys[i] >> np.uint64(32)).astype("<u4").tobytes(), least[i].tobytes(), rows[i].tobytes(),
                        at[i].tobytes(), *(texts[j] for j in i)]
                for name, value in (("chunk", head["chunk"]), ("bucket", int(home[i[0]])), ("n", len(i)),
                                    ("runs", zip_.compress(b"".join(blob)))):
                    out[name].append(value)
        return pa.Table.from_pydict(out, kinds)

    kinds = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("runs", pa.binary())])
    return packed.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(cut, "chunk long, bucket long, n long, runs binary")


def _unpacked(n: int, raw: bytes) -> tuple[list[bytes], list[int], list[int], list[int], list[int]]:
    """Texts, keys, ids, rows and places of n run texts."""
    sizes, out, at = np.frombuffer(raw, "u1", n), [], n
    for kind in ("<u4", "<i8", "<i4", "<i4"):
        out.append(np.frombuffer(raw, kind, n, at).tolist())
        at += n * int(kind[2])
    ends = (at + np.cumsum(sizes, dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([at, *ends], ends)], *out


def _states(key: np.ndarray, shared: pa.Table, buckets: int) -> np.ndarray:
    """0 for keys of one document, 1 for shared and 2 for hot ones."""
    known, state = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)]
    for bucket, hot, keys in zip(*(shared.column(x).to_pylist() for x in ("bucket", "hot", "keys"))):
        known.append(np.frombuffer(keys, "<u4").astype(np.uint64) | np.uint64(bucket << 32))
        state.append(np.full(len(known[-1]), 1 + hot))
    known, state = np.concatenate(known), np.concatenate(state)
    order = np.lexsort((state, known))
    known, state = known[order], state[order]
    whole = (key % np.uint64(buckets)) << np.uint64(32) | (key // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)
    at = np.maximum(np.searchsorted(known, whole, "right") - 1, 0)
    return np.where(known[at] == whole, state[at], 0)


# -- the transform -----------------------------------------------------------------------------------
def _inserted(column: np.ndarray, old: np.ndarray, at: np.ndarray, value) -> np.ndarray:
    """The column with a value at each place of ``at``; ``old`` marks all other places."""
    made = np.empty(len(old), column.dtype)
    made[old] = column
    made[at] = value
    return made


def collection_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all texts in order, as (text number, suffix length, prefix shared with the one before).

    Column-wise construction: round j puts the symbol before each text's suffix of length j - 1 into
    the transform and inserts the suffix of length j. Its place follows from the transform itself (the
    order of its symbols, then of their places, which is kept and grows by the round's symbols), its common
    prefixes from the least one between the two places with the same symbol. Ends of texts sort first and are all different.
    """
    m = len(texts)
    size = np.fromiter(map(len, texts), np.int64, m)
    flat, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size)
    longest = int(size.max(initial=0))
    prefix = np.r_[np.zeros(m, np.uint8), np.uint8(255)]  # with an end that no range counts
    # symbol and place of every suffix with a symbol before it, sorted: the i-th is before the suffix that stands at m + i
    symbols = np.zeros(0, np.int64)
    new, added = np.arange(m), np.arange(m)  # where the suffixes of the round before stand, and whose they are
    for j in range(1, longest + 1):
        live = size[added] >= j
        new, added = new[live], added[live]
        symbol = flat[ends[added] - j]
        by = np.argsort(symbol, kind="stable")
        added = added[by]
        given = symbol[by].astype(np.int64) << PLACE | new[by]
        gap = np.searchsorted(symbols, given)
        at = gap + np.arange(len(gap))
        moved = np.repeat(np.arange(len(gap) + 1), np.diff(np.r_[0, gap + m, m + len(symbols)]))
        old = np.ones(m + len(symbols) + len(given) + 1, bool)
        new = at + m
        old[new] = False
        symbols = _inserted(symbols, old[m:-1], at, given)
        # common prefixes change at the new places and right after them
        k = np.repeat(at, 2)
        k[1::2] += 1
        k = k[np.r_[True, k[1:] != k[:-1]]]
        k = k[:-1] if k[-1] == len(symbols) else k
        here, above = symbols[k], symbols[np.maximum(k - 1, 0)]
        joined = np.flatnonzero((k > 0) & (here >> PLACE == above >> PLACE))
        shared = np.zeros(len(k), np.uint8)
        if len(joined):
            first, last = ((x[joined] & PLACES) + 1 for x in (above, here))
            # from the back, so that no range is reduced between one pair's end and the next one's start
            back = np.argsort(-first)
            pairs = np.empty(2 * len(back), np.int64)
            pairs[::2], pairs[1::2] = first[back], last[back]
            shared[joined[back]] = np.minimum.reduceat(prefix, pairs)[::2] + np.uint8(1)
        prefix = _inserted(prefix, old, new, 0)
        prefix[k + m] = shared
        symbols += moved.take(symbols & PLACES)
    # every suffix stands where the symbol before the next shorter one says
    follows = np.zeros(m + len(symbols), np.int64)
    follows[symbols & PLACES] = np.arange(m, len(follows))
    text, suffix = np.arange(len(follows)), np.zeros(len(follows), np.int64)
    at, own = np.arange(m), np.arange(m)
    for j in range(1, longest + 1):
        live = size[own] >= j
        own, at = own[live], follows[at[live]]
        text[at], suffix[at] = own, j
    return text, suffix, prefix[:-1]


def may_share(texts: list[bytes], keys: np.ndarray, length: int) -> np.ndarray:
    """False for run texts that share no window with another text under their key, by more bytes than the key tells.

    A text's windows all hold its key's piece. A window reaches ``before`` bytes to the left of the first such piece in it, or
    else ``after`` bytes to the right of it; texts with a window in common agree in that stretch, whatever piece of theirs it is.
    """
    before = (length - KMER) // 2
    after = length - KMER - before + 1
    of, stretch = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, len(texts), COLLECTION):
        some = texts[at:at + COLLECTION]
        size = np.fromiter(map(len, some), np.int64, len(some))
        ends = np.cumsum(size)
        eight = eight_bytes(b"".join(some))
        value = hashed_pieces(eight)
        owner = np.repeat(np.arange(len(some)), size)[:len(value)]
        inside = np.arange(KMER, ends[-1] + 1) <= ends[owner]  # a piece lies within one text
        value[~inside] = np.uint64(2 ** 64 - 1)
        least = np.minimum.reduceat(value, ends - size)
        place = np.flatnonzero((value == least[owner]) & inside)
        owner = owner[place]
        for side, (low, high) in enumerate(((-before, KMER), (0, KMER + after))):
            fits = (place + low >= (ends - size)[owner]) & (place + high <= ends[owner])
            p, t = place[fits], owner[fits] + at
            code = mix(keys[t] + np.uint64(side))
            for step in (*range(low, high - 8, 8), high - 8):
                code = mix(code + eight[p + step])
            of.append(t)
            stretch.append(code)
    of, stretch = np.concatenate(of), np.concatenate(stretch)
    order = np.lexsort((of, stretch))
    of, stretch = of[order], stretch[order]
    # texts stand in order within a stretch: the first and the last differ if two of them do
    edge = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1], True]) if len(of) else np.zeros(1, np.int64)
    out = np.zeros(len(texts), bool)
    out[of[np.repeat(of[edge[:-1]] != of[edge[1:] - 1], np.diff(edge))]] = True
    return out


def least_ids(texts: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each text, the smallest id among all texts that hold it; and where each text's windows begin."""
    text, suffix, prefix = collection_order(texts)
    full = np.flatnonzero(suffix >= length)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    windows = size - length + 1
    starts = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    group = np.flatnonzero(prefix[full] < length)
    least = np.minimum.reduceat(ids[text[full]], group)
    out[starts[text[full]] + size[text[full]] - suffix[full]] = np.repeat(least, np.diff(np.r_[group, len(full)]))
    return out, starts


def _stretches(ids: list[int]) -> list[tuple[int, int, int]]:
    """(first, number, id) of each stretch of one id."""
    out, first = [], 0
    for id_, same in groupby(ids):
        n = sum(1 for _ in same)
        out.append((first, n, id_))
        first += n
    return out


def answers(runs: DataFrame, length: int) -> DataFrame:
    """(chunk, found): windows of a chunk's run texts that a smaller id than the chunk's own holds."""

    def order(table: pa.Table) -> pa.Table:
        found: dict[bytes, list[int]] = {}
        asked = []
        unzip = zstandard.ZstdDecompressor()
        for chunk, n, blob in zip(*(table.column(c).to_pylist() for c in ("chunk", "n", "runs"))):
            run, keys, ids, rows, at = _unpacked(n, unzip.decompress(blob))
            own = []
            for t, doc, k in zip(run, ids, keys):
                had = found.setdefault(t, [doc, k, len(found)])
                if doc < had[0]:
                    had[0] = doc
                own.append(had[2])
            asked.append((chunk, own, ids, rows, at))
        texts = list(found)
        ids = np.array([v[0] for v in found.values()], np.int64)
        key = np.array([v[1] for v in found.values()], np.uint64)
        best: list[list[tuple[int, int, int]] | None] = [None] * len(texts)  # (first window, windows, smallest id)
        by_key = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.r_[True, key[by_key][1:] != key[by_key][:-1], True])
        size = np.diff(cut)
        grouped = by_key[np.repeat(size > 1, size)]  # texts under keys that have several
        grouped = grouped[may_share([texts[i] for i in grouped], key[grouped], length)]
        ends = np.flatnonzero(np.r_[key[grouped][1:] != key[grouped][:-1], len(grouped) > 0]) + 1
        # whole keys together, about COLLECTION texts at a time
        last = np.flatnonzero(np.diff((ends - 1) // COLLECTION, append=-1) != 0)
        for part in np.split(grouped, ends[last][:-1]) if len(grouped) else []:
            windows, starts = least_ids([texts[i] for i in part], ids[part], length)
            low, high = np.minimum.reduceat(windows, starts), np.maximum.reduceat(windows, starts)
            ids[part] = low
            for i in np.flatnonzero(low < high):  # the others have one id for all windows
                best[part[i]] = _stretches(windows[starts[i]:starts[i + 1] if i + 1 < len(starts) else None].tolist())
        chunk_of, blobs, least = [], [], ids.tolist()
        for chunk, own, mine, rows, at in asked:
            lines = []
            for i, doc, row, place in zip(own, mine, rows, at):
                n = len(texts[i])
                if least[i] >= doc:
                    continue
                if best[i] is None:
                    lines.append((row, place, n, 0, n - length + 1, least[i]))
                else:
                    lines += [(row, place, n, a, windows, least_) for a, windows, least_ in best[i] if least_ < doc]
            if lines:
                chunk_of.append(chunk)
                blobs.append(np.array(lines, ANSWER).tobytes())
        return pa.Table.from_pydict({"chunk": chunk_of, "found": blobs}, pa.schema([("chunk", pa.int64()), ("found", pa.binary())]))

    return runs.groupBy("bucket").applyInArrow(order, "chunk long, found binary")


# -- cutting -------------------------------------------------------------------------------------------
def removed(packed: DataFrame, shared: DataFrame, answered: DataFrame, key_buckets: int, length: int) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left)."""

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in kinds.names}
        for head in left.to_pylist():
            c = Chunk(head["packed"], head["ids"], head["sizes"], length)
            mask = np.array([f is None for f in right.column("found").to_pylist()], bool)
            hot = _states(c.key, right.filter(pa.array(mask)), key_buckets) == 2
            lines = [x for f in right.filter(pa.array(~mask)).column("found").to_pylist() for x in np.frombuffer(f, ANSWER).tolist()]
            marks = covered(c, hot, lines, length)
            for i, text, spans in zip(head["ids"], c.texts, marks):
                kept, end, n_spans = [], 0, 0
                for a, b in sorted(spans):
                    if a > end or not n_spans:
                        kept.append(text[end:a])
                        n_spans += 1
                    end = max(end, b)
                kept = b"".join([*kept, text[end:]]) if spans else text
                for name, v in (("doc_id", i), ("n_bytes", len(text)), ("n_removed", len(text) - len(kept)), ("n_spans", n_spans),
                                ("kept", kept)):
                    out[name].append(v)
        return pa.Table.from_pydict(out, kinds)

    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    help_ = (answered.selectExpr("chunk", "found", "cast(null as long) bucket", "cast(null as boolean) hot", "cast(null as binary) keys")
             .unionByName(shared.where("hot").selectExpr("chunk", "cast(null as binary) found", "bucket", "hot", "keys")))
    return packed.groupBy("chunk").cogroup(help_.groupBy("chunk")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def covered(c: Chunk, hot: np.ndarray, lines: list[tuple], length: int) -> list[list[tuple[int, int]]]:
    """For each text of a chunk, the byte ranges that windows of smaller ids cover."""
    marks: list[list[tuple[int, int]]] = [[] for _ in c.texts]
    units = list(_units(c, hot, lines, length))
    least: dict[bytes, int] = {}
    for text, doc, _, _ in units:
        if doc < least.get(text, NO_ID):
            least[text] = doc
    better: dict[bytes, np.ndarray] = {}
    for row, at, n, first, windows, doc in lines:
        text = c.texts[row][at:at + n]
        if windows == n - length + 1:
            least[text] = min(doc, least.get(text, NO_ID))
            continue
        if text not in better:
            better[text] = np.full(n - length + 1, least.get(text, NO_ID))
        better[text][first:first + windows] = doc
    for text, doc, row, at in units:
        if text in better:
            hit = better[text] < doc
            if hit.all():
                marks[row].append((at, at + len(text)))
            else:
                marks[row] += [(at + a, at + a + n - 1 + length) for a, n, gone in _stretches(hit.tolist()) if gone]
        elif least.get(text, NO_ID) < doc:
            marks[row].append((at, at + len(text)))
    return marks


def _units(c: Chunk, hot: np.ndarray, lines: list[tuple], length: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(text, id, row, place) of the runs to look at: keys of several rows, keys with an answer, and hot windows."""
    base = np.cumsum([0, *map(len, c.texts)])
    begin = base[c.row] + c.start
    answered = np.zeros(len(c.key), bool)
    if lines:
        rows, at = np.array([x[:2] for x in lines], np.int64).T
        answered[np.searchsorted(begin, base[rows] + at, "right") - 1] = True
    value, of = np.unique(c.key, return_inverse=True)
    lo, hi = np.full(len(value), len(c.texts)), np.full(len(value), -1)
    np.minimum.at(lo, of, c.row)
    np.maximum.at(hi, of, c.row)
    wanted = lo < hi
    wanted[of[answered]] = True
    i, ids = np.flatnonzero(wanted[of] | hot), c.ids.tolist()
    for row, start, n, alone in zip(*(x[i].tolist() for x in (c.row, c.start, c.size, hot))):
        text, doc = c.texts[row], ids[row]
        if alone:
            for at in range(start, start + n):
                yield text[at:at + length], doc, row, at
        else:
            yield text[start:start + n + length - 1], doc, row, start


def drop_repeats(docs: DataFrame, length: int = LENGTH, hot_docs: int = HOT_DOCS, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left)."""
    packed = materialized(packed_texts(docs, doc_id, text), "packed")
    size = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    key_buckets, buckets = 64 + size // (8 * BUCKET_BYTES), 64 + size // BUCKET_BYTES
    shared = materialized(shared_keys(packed, key_buckets, length, hot_docs), "shared")
    answered = materialized(answers(run_texts(packed, shared, key_buckets, buckets, length), length), "answers")
    return removed(packed, shared, answered, key_buckets, length)
