"""Fill-in-middle, decontamination and ranked search against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from telltale.llm import bm25, decontaminate, fill_middle, ranked_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


def table(spark, pairs, schema=SCHEMA):
    return spark.createDataFrame([(*p, "en", "s", 1)[:len(schema.split(","))] for p in pairs], schema)


def odd_rows():
    r = random.Random(3)
    long = " ".join(r.choice("abc") + str(r.randrange(300)) for _ in range(40_000))
    return [(1, None), (2, ""), (3, " \t\n.-"), (4, "a b c"), (4, "a b c"), (5, long), (6, long), (None, "a b c"), (7, None),
            (8, "é ß İ Σ ſ K \U0001F600́"), (None, None), (9, long[:100_000]), (10, "<P>x"), (11, "x<S"), (12, "M>ab<")]


@pytest.fixture(scope="module")
def odd(spark):
    docs = table(spark, odd_rows())
    for c in ("row", "term", "number", "pos", "words", "draw", "output", "form", "item", "range", "ids", "n", "item_id", "score"):
        docs = docs.selectExpr("*", f"'x' as {c}")
    return docs.repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -- fill-in-middle ---------------------------------------------------------------------------------------
def middle_by_hand(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_middle_as_by_hand(spark, odd):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab<>PSM\n\U0001F600é") for _ in range(r.randrange(40)))) for i in range(600)]
    got = fill_middle.restore(fill_middle.fill_in_middle(table(spark, rows))).collect()
    assert {x.doc_id: (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got} == {i: middle_by_hand(i, t) for i, t in rows}
    assert {x.doc_id: x.restored for x in got} == dict(rows) and {x.form for x in got} == {"plain", "psm", "spm"}
    made = Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in fill_middle.fill_in_middle(odd).collect())
    assert made == Counter((i, *middle_by_hand(i, t)) for i, t in odd_rows())
    kept = fill_middle.restore(fill_middle.fill_in_middle(odd)).collect()
    assert Counter((x.doc_id, x.restored) for x in kept) == Counter((i, t or "") for i, t in odd_rows())


def test_units_of_long_texts_in_pieces(monkeypatch):
    text = "é\n\U0001F600a" * 50
    assert fill_middle.unit_ends(text) == list(range(1, 201)) and fill_middle.unit_ends("") == []
    monkeypatch.setattr(fill_middle, "PIECE", 7)
    assert fill_middle.unit_ends(text) == list(range(1, 201))


def test_middle_of_nothing(none):
    assert fill_middle.restore(fill_middle.fill_in_middle(none)).count() == 0


# -- decontamination --------------------------------------------------------------------------------------
def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def hits_by_hand(docs, items, length):
    runs = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - length + 1)) if w else ():
            runs.setdefault(tuple(w[s:s + length]), set()).update([] if i is None else [str(i)])
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(r) for r in runs}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in runs:
                    hit.update(range(s, s + n))
                    ids |= runs[tuple(w[s:s + n])]
        out.append((i, len(w), len(hit), tuple(sorted(ids)), bool(hit)))
    return Counter(out)


def passages(seed=5):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice(["a", "the", "B", "é", "Σa", f"w{r.randrange(30)}"]) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 3, 9, 10, 11, 30]))) for i in range(40)] + [(3, text(12)), (None, text(5)), (41, None), (42, "the the the the")]
    docs = [(i % 190, text(r.randrange(60)) + (r.choice(items)[1] or "").upper().replace("É", "é").replace("Σ", "Σ") + text(r.randrange(20))) for i in range(200)]
    return docs + [(None, items[7][1]), (500, None), (501, "")], items


def found(df):
    return Counter((x.doc_id, x.n_words, x.n_hit, tuple(x["items"]), x.contaminated) for x in df.collect())


@pytest.mark.parametrize("length", [10, 4])
def test_phrases_as_by_hand(spark, length):
    docs, items = passages()
    want = hits_by_hand(docs, items, length)
    assert found(decontaminate.contamination(table(spark, docs).repartition(4), table(spark, items, ITEMS), length)) == want
    assert sum(x[2] > 0 for x in want) > 50


def test_phrases_without_broadcasts(spark, no_broadcast):
    docs, items = passages(6)
    assert found(decontaminate.contamination(table(spark, docs).repartition(4), table(spark, items, ITEMS))) == hits_by_hand(docs, items, 10)


def test_phrases_on_odd_rows(spark, odd, none):
    items = [(1, "A b"), (2, "é ß"), (None, "c"), (3, None), (4, odd_rows()[5][1][500:900])]
    tests = table(spark, items, ITEMS).selectExpr("*", "1 as row", "2 as phrase", "3 as term")
    assert found(decontaminate.contamination(odd, tests)) == hits_by_hand(odd_rows(), items, 10)
    assert decontaminate.contamination(none, tests).count() == 0
    clean = decontaminate.contamination(odd, tests.where("false"))
    assert clean.count() == len(odd_rows()) and clean.where("contaminated").count() == 0


@pytest.mark.parametrize("slop", [1, 3])
def test_proximity_as_by_hand(spark, slop):
    docs, items = passages(7)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    phrases = decontaminate.phrases_of(table(spark, items, ITEMS), 4)
    index = decontaminate.build_index(table(spark, docs).repartition(4), phrases)
    ids = {x.row: x.doc_id for x in index.documents.collect()}
    terms, rank = {}, {x.term: x.n for x in index.terms.collect()}
    for x in phrases.terms.collect():
        terms.setdefault(x.phrase, {})[x.place] = x.term
    want = set()
    for p, by_place in terms.items():
        if any(t not in rank for t in by_place.values()):
            continue
        anchor = min(by_place, key=lambda k: (rank[by_place[k]], k))
        for i, t in docs:
            w = words(t)
            for at in range(len(w)):
                near = lambda k: w[max(0, at - anchor + k - slop):max(0, at - anchor + k + slop + 1)]
                if w[at] == by_place[anchor] and all(t in near(k) for k, t in by_place.items()):
                    want.add((p, i, at - anchor))
    got = {(x.phrase, ids[x.row], x.start) for x in decontaminate.occurrences(index, phrases, slop).collect()}
    exact = {(x.phrase, ids[x.row], x.start) for x in decontaminate.occurrences(index, phrases).collect()}
    assert got == want and exact < got


# -- ranked search ----------------------------------------------------------------------------------------
def ranks_by_hand(docs, items, k=20):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counts = [Counter(split(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total, df = sum(s > 0 for s in sizes), sum(sizes), Counter(w for c in counts for w in c)
    out = Counter()
    for item, t in items:
        rows = []
        for (i, _), c, size in zip(docs, counts, sizes):
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * (75 + 25 * size * n // total))) for w, x in Counter(split(t)).items() if w in c)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out.update((item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(rows, key=lambda x: x[:3])[:k]))
    return out


def ranks(df):
    return Counter((x.item_id, x["rank"], x.doc_id, x.score) for x in df.collect())


def corpus(seed=9):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "A", "é"] + [f"w{int(r.paretovariate(0.4)) % 500}" for _ in range(5)])
    docs = [(i, " ".join(word() for _ in range(r.choice([0, 1, 2, 5, 30, 30, 200])))) for i in range(700)]
    docs += [(800 + i, docs[40][1]) for i in range(30)] + [(5, docs[5][1]), (None, docs[40][1]), (900, None)]
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 3, 20])))) for i in range(60)] + [(7, "the the w1"), (7, "é"), (None, "w2 A"), (70, None)]
    return docs, items


def test_ranks_as_by_hand(spark, monkeypatch):
    docs, items = corpus()
    want = ranks_by_hand(docs, items)
    asked = table(spark, items, ITEMS).repartition(2)
    assert ranks(ranked_search.ranked(table(spark, docs).repartition(4), asked)) == want
    monkeypatch.setattr(ranked_search, "RANGE_ROWS", 50)  # many ranges, several bunches, early pruning
    monkeypatch.setattr(ranked_search, "ITEMS", 7)
    assert ranks(ranked_search.ranked(table(spark, docs).repartition(4), asked)) == want
    assert ranks(ranked_search.ranked(table(spark, docs).repartition(4), asked, k=3)) == ranks_by_hand(docs, items, 3)


def test_ranks_without_broadcasts(spark, no_broadcast):
    docs, items = corpus(10)
    assert ranks(ranked_search.ranked(table(spark, docs).repartition(4), table(spark, items, ITEMS))) == ranks_by_hand(docs, items)


def test_ranks_on_odd_rows(spark, odd, none):
    items = [(1, "A b"), (2, "é"), (None, "c"), (3, None), (4, odd_rows()[5][1][500:900])]
    asked = table(spark, items, ITEMS).selectExpr("*", "1 as item", "2 as term", "3 as times")
    got = ranks(ranked_search.ranked(odd, asked))
    assert got == ranks_by_hand(odd_rows(), items) and len(got) > 5
    assert ranked_search.ranked(none, asked).count() == 0
    assert ranked_search.ranked(odd, asked.where("false")).count() == 0


def test_documents_of_a_shard_are_numbered_by_likeness():
    rows = [[0, 0, 1], [], [2, 3], [0], [2, 2, 3, 4], []]  # word 0 and word 2 are met three times each
    length = np.array([len(r) for r in rows])
    order = bm25._alike(np.concatenate([np.array(r, np.int64) for r in rows]), length)
    assert order.tolist() == [1, 5, 3, 2, 0, 4] and sorted(order) == list(range(6))
    assert bm25._alike(np.zeros(0, np.int64), np.zeros(2, np.int64)).tolist() == [0, 1]
