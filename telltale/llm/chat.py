"""Chat formatting: roles of transcript lines by a hidden Markov model, then one canonical form.

A conversation is its rows in order of turn. Each line of a row's text is an observation: a row's first
line shows the row's length and number of lines, and any line may open with a speaker marker such as
``User:`` or ``### Assistant:``. The hidden state is the speaker. It may change at a row's first line and
at a marker, and is kept on all other lines. Start, transition and length probabilities are counted on rows whose
role is known, conversations of the held-out third aside; what a marker says is right with MARKED.
Viterbi's path gives every line its speaker; lines of one speaker in a row form a turn.

Rows are range-partitioned by conversation and turn, so a conversation of any size is spread over
parts of equal depth. Scores along a path add up, so a part hands on, for the conversations at its two
borders, the best score from each state before it to each state at its end; the borders' states follow
from these few rows, and all parts are decoded on their own with the same result as in one piece.

Defined cases: a null text is one empty line; a null turn sorts first; a null conversation id is one
conversation; rows equal in id and turn are ordered by a hash of role and text; repeated rows are each
returned; roles are not looked at unless ``use_roles``; with no known roles all probabilities are equal; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.llm.common import remainder
from telltale.session import materialized

ROLES = ("system", "user", "assistant")
# Fixed names under which speakers appear.
NAMES = {"system": 0, "user": 1, "human": 1, "customer": 1, "q": 1, "question": 1, "prompter": 1,
         "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "a": 2, "answer": 2, "agent": 2, "model": 2}
MARKER = re.compile(r"^\s*(?:#{1,6}\s*|\*{2}|<\|)?(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")(?:\*{2})?\s*(?::(?:\*{2})?|\|>|>)\s*", re.I)
MARKED = 0.95
LENGTHS, LINES = 20, 8
HELD_OUT = 3
ROWS_PER_PART = 20_000
SMALL = -1e9


def _bucket(n: int, most: int) -> int:
    return min(most - 1, int(n).bit_length())


class Row:
    """A row's lines with their markers, and its two size features."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.features = (_bucket(len(text), LENGTHS), _bucket(len(self.lines), LINES))
        self.marks: list[int | None] = []
        for i, line in enumerate(self.lines):
            m = MARKER.match(line)
            self.marks.append(NAMES[m[1].lower()] if m else None)
            if m:
                self.lines[i] = line[m.end():]


class Model:
    """Log probabilities, from counts with one added."""

    def __init__(self, start, move, length, lines):
        norm = lambda x: np.log((x + 1) / (x + 1).sum(-1, keepdims=True))
        self.start, self.move, self.length, self.lines = (norm(np.asarray(x, float)) for x in (start, move, length, lines))
        right, wrong = np.log(MARKED), np.log((1 - MARKED) / (len(ROLES) - 1))
        self.mark = np.where(np.eye(len(ROLES), dtype=bool), right, wrong)

    def steps(self, row: Row, role: int | None) -> list[np.ndarray | None]:
        """Emission of each line where the speaker may change; None where it is kept."""
        out: list[np.ndarray | None] = []
        for i, mark in enumerate(row.marks):
            e = np.zeros(len(ROLES))
            if i == 0:
                e = e + self.length[:, row.features[0]] + self.lines[:, row.features[1]]
                if role is not None:
                    e = e + self.mark[role]
            if mark is not None:
                e = e + self.mark[mark]
            out.append(e if i == 0 or mark is not None else None)
        return out


def _sorted(table: pa.Table) -> list[dict]:
    return table.sort_by([("no_id", "ascending"), ("conv_id", "ascending"), ("no_turn", "descending"), ("turn", "ascending"),
                          ("tie", "ascending")]).to_pylist()


def _conversations(rows: list[dict]) -> Iterator[tuple[int | None, list[dict]]]:
    at = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i]["conv_id"] != rows[at]["conv_id"]:
            yield rows[at]["conv_id"], rows[at:i]
            at = i


def in_parts(conversations: DataFrame) -> DataFrame:
    """Rows with their part: ranges of (conversation, turn) of equal depth, written."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.lower(F.col("role").cast("string")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"no_id": F.col("conv_id").isNull(), "no_turn": F.col("turn").isNull(), "tie": F.xxhash64("role", "text"),
                             "train": remainder(F.col("conv_id"), HELD_OUT) != 1})
    n = rows.count()
    placed = rows.repartitionByRange(max(1, -(-n // ROWS_PER_PART)), "no_id", "conv_id", F.desc("no_turn"), "turn", "tie")
    return materialized(placed.withColumn("part", F.spark_partition_id()), "parts")


def learn(parts: DataFrame) -> Model:
    """Count starts, moves and sizes over all rows with a known role outside the held-out third."""

    def count(table: pa.Table) -> pa.Table:
        counts: dict[tuple, int] = {}
        rows = _sorted(table)
        part = table.column("part")[0].as_py()

        def add(*key) -> None:
            counts[key] = counts.get(key, 0) + 1

        for conv, turns in _conversations(rows):
            before = None
            for i, r in enumerate(turns):
                role = NAMES.get(r["role"])
                if r["train"] and role is not None:
                    row = Row(r["text"])
                    add("length", role, row.features[0])
                    add("lines", role, row.features[1])
                    if i == 0:
                        add("start", role, 0)
                    elif before is not None:
                        add("move", before, role)
                before = role if r["train"] else None
        # the part's borders: the last role of the part before continues here if the conversation does
        for name, r in (("head", rows[0]), ("tail", rows[-1])):
            role = NAMES.get(r["role"])
            counts[(f"{name} {r['conv_id']}", part, -1 if role is None or not r["train"] else role)] = 1
        kind, a, b = zip(*counts)
        return pa.table({"kind": kind, "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    got = (parts.groupBy("part").applyInArrow(count, "kind string, a long, b long, n long")
           .groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).toPandas())  # fixed counts, and two rows a part
    size = {"start": (3, 1), "move": (3, 3), "length": (3, LENGTHS), "lines": (3, LINES)}
    tables = {k: np.zeros(s) for k, s in size.items()}
    tails, heads = {}, {}
    for kind, a, b, n in got.itertuples(index=False):
        if kind in tables:
            tables[kind][a, b] += n
        else:
            name, conv = kind.split(" ")
            (tails if name == "tail" else heads)[a] = (conv, b)
    for before, part in zip(sorted(heads), sorted(heads)[1:]):
        (conv, a), (own, b) = tails[before], heads[part]
        if conv == own and b >= 0:
            tables["start"][b, 0] -= 1  # not a start after all
            if a >= 0:
                tables["move"][a, b] += 1
    return Model(np.maximum(tables["start"][:, 0], 0), tables["move"], tables["length"], tables["lines"])


def _path(model: Model, steps: list[np.ndarray | None], begin: np.ndarray, last: int | None) -> list[int]:
    """Best states of the steps, given log scores of the state at the first step (emission aside) and the last state."""
    back, score = [], begin + steps[0]
    for e in steps[1:]:
        if e is None:
            back.append(None)
            continue
        ways = score[:, None] + model.move
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + e
    state = int(score.argmax()) if last is None else last
    path = [state]
    for b in reversed(back):
        state = state if b is None else int(b[state])
        path.append(state)
    return path[::-1]


def _through(model: Model, steps: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """Best score from each state before to each state after the steps; and from the start of a conversation."""
    ways = np.vstack([model.move, model.start[None, :]]) + steps[0]
    for e in steps[1:]:
        if e is not None:
            ways = (ways[:, :, None] + model.move[None]).max(axis=1) + e
    return ways[:-1], ways[-1]


def _role(r: dict, use_roles: bool) -> int | None:
    return NAMES.get(r["role"]) if use_roles else None


def borders(parts: DataFrame, model: Model, use_roles: bool) -> dict[tuple, tuple[int | None, int]]:
    """(part, conversation) of conversations that span parts: the state before the part and the state at its end."""

    def ends(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        groups = list(_conversations(_sorted(table)))
        out = {"part": [], "conv_id": [], "score": []}
        for conv, turns in groups[:1] + groups[1:][-1:]:
            steps = [s for r in turns for s in model.steps(Row(r["text"]), _role(r, use_roles))]
            ways, start = _through(model, steps)
            out["part"].append(part)
            out["conv_id"].append(conv)
            out["score"].append([*ways.ravel().tolist(), *start.tolist()])
        return pa.table(out, pa.schema([("part", pa.int64()), ("conv_id", pa.int64()), ("score", pa.list_(pa.float64()))]))

    rows = parts.groupBy("part").applyInArrow(ends, "part long, conv_id long, score array<double>").collect()  # two rows a part
    chains: dict[int | None, list] = {}
    for r in sorted(rows, key=lambda r: r.part):
        chains.setdefault(r.conv_id, []).append((r.part, np.array(r.score)))
    out: dict[tuple, tuple[int | None, int]] = {}
    k = len(ROLES)
    for conv, chain in chains.items():
        if len(chain) < 2:
            continue
        scores = [chain[0][1][k * k:]]
        for _, s in chain[1:]:
            scores.append((scores[-1][:, None] + s[:k * k].reshape(k, k)).max(axis=0))
        state = int(scores[-1].argmax())
        for i in range(len(chain) - 1, -1, -1):
            before = int((scores[i - 1] + chain[i][1][:k * k].reshape(k, k)[:, state]).argmax()) if i else None
            out[chain[i][0], conv] = (before, state)
            state = before
    return out


def format_chats(conversations: DataFrame, use_roles: bool = True) -> DataFrame:
    """One row per turn found: conv_id, turn, segment, given (the row's role), role, n_lines, text, rendered."""
    parts = in_parts(conversations)
    model = learn(parts)
    known = borders(parts, model, use_roles)

    def decode(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        out: dict[str, list] = {c: [] for c in kinds.names}
        for conv, turns in _conversations(_sorted(table)):
            rows = [Row(r["text"]) for r in turns]
            steps = [s for r, row in zip(turns, rows) for s in model.steps(row, _role(r, use_roles))]
            before, last = known.get((part, conv), (None, None))
            path = _path(model, steps, model.start if before is None else model.move[before], last)
            at = 0
            for r, row in zip(turns, rows):
                states = path[at:at + len(row.lines)]
                at += len(row.lines)
                cut = [0, *(i for i in range(1, len(states)) if states[i] != states[i - 1]), len(states)]
                for segment, (a, b) in enumerate(zip(cut, cut[1:])):
                    role, text = ROLES[states[a]], "\n".join(row.lines[a:b])
                    for name, v in (("conv_id", conv), ("turn", r["turn"]), ("segment", segment), ("given", r["role"]), ("role", role),
                                    ("n_lines", b - a), ("text", text), ("rendered", f"<|{role}|>\n{text.strip()}\n<|end|>\n")):
                        out[name].append(v)
        return pa.table(out, kinds)

    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.int32()), ("given", pa.string()), ("role", pa.string()),
                       ("n_lines", pa.int32()), ("text", pa.string()), ("rendered", pa.string())])
    return parts.groupBy("part").applyInArrow(
        decode, "conv_id long, turn long, segment int, given string, role string, n_lines int, text string, rendered string")
