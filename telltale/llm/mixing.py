"""Mixing sources to target weights by iterative proportional fitting, then sampling documents.

Token counts are summed per cell (source, language, topic). Raking scales the cells' weights to the
source, language and topic targets in turn until no weight moves by TOLERANCE; only the cells move, never
the documents. Where no weights meet all targets, moves shrink ever more slowly: raking also ends when, after
SETTLING rounds, a round's largest move is still over STALLED of the one before. Cells that may be
broadcast are raked in one task, more of them in a written table a round. A cell's inclusion probability is proportional to its raked weight over its share of tokens,
at most 1; the common factor is set so that the expected tokens kept are ``rate`` of all. Cells that reach 1
fall short of their weights, at high rates most small ones; ``rate`` None is the largest without. A document stays
if its uniform draw (from a hash of its id) is below its cell's probability, so results don't depend
on partitions or retries.

Targets not given are the observed shares to the power ``alpha``, normalised: 0.5 lifts small sources,
languages and topics towards the large ones.

Defined cases: null source or language is a value of its own; null and empty texts have no tokens and
topic ``prose``; cells without tokens have ratio 1; rows with the same id are drawn alike; a single cell is
sampled at ``rate``; an empty table gives an empty result. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.llm.common import text_or_empty, unused
from telltale.session import broadcast_if_small, materialized, within_broadcast_bound

SIDES = ("source", "lang", "topic")
ALPHA, RATE, SEED = 0.5, 0.9, "mix"
TOLERANCE = 1e-12
SETTLING, STALLED = 100, 0.999


def _ended(n: int, moved: float, before: float, tolerance: float) -> bool:
    """Whether raking ends after round ``n``, given its largest move and that of the round before."""
    return moved < tolerance or (n > SETTLING and moved > STALLED * before)


def topic_of(text: Column) -> Column:
    """A coarse topic from the text's form."""
    low = F.lower(text)
    return (F.when(low.contains("license"), "legal").when(text.contains(" | "), "table")
            .when(text.contains("!!"), "shouted").when(text.contains("***") | text.contains("$$$"), "noise")
            .when(text.contains("@"), "contact").otherwise("prose"))


def measured(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with source, language, topic, tokens and draw in new columns, and those columns' names."""
    text = text_or_empty(docs)
    name = [unused(c, docs.columns) for c in ("_source", "_lang", "_topic", "_tokens", "_draw")]
    return docs.withColumns(dict(zip(name, (
        F.coalesce(docs["source"].cast("string"), F.lit("\x00none")),
        F.coalesce(docs["lang"].cast("string"), F.lit("\x00none")),
        topic_of(text),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")))), 1, 13),
               16, 10).cast("double") / F.lit(float(1 << 52)))))), name


def _shares(cells: DataFrame, side: str, given: dict[str, float] | None, alpha: float) -> DataFrame:
    """(side, target): the given weights, or smoothed shares of tokens; normalised over values that have tokens."""
    sums = cells.groupBy(side).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    raw = F.pow("tokens", F.lit(alpha))
    if given is not None:
        wanted = cells.sparkSession.createDataFrame(list(given.items()), f"{side} string, wanted double")
        sums = sums.join(wanted, side)
        raw = F.col("wanted")
    sums = sums.withColumn("raw", raw)
    return sums.join(sums.agg(F.sum("raw").alias("all_raw"))).select(side, (F.col("raw") / F.col("all_raw")).alias("target"))


def _raked_at_once(cells: DataFrame, targets: dict[str, dict[str, float]], alpha: float, tolerance: float) -> DataFrame:
    """``raked`` in one task, over arrays."""

    def rake(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        tokens = table.column("tokens").to_numpy().astype(float)
        weight, sides = tokens / max(tokens.sum(), 1.0), []
        for side in SIDES:
            code, values = pd.factorize(table.column(side).to_pandas())
            sums, given = np.bincount(code, tokens, len(values)), targets.get(side)
            raw = np.where(sums > 0, sums ** alpha if given is None else [given.get(v, 0.0) for v in values], 0.0)
            sides.append((code, raw / (raw.sum() or 1.0)))
        moved = np.inf
        for n in count(1):
            before, last = weight, moved
            for code, target in sides:
                have = np.bincount(code, weight, len(target))
                weight = weight * np.divide(target, have, out=np.zeros(len(have)), where=have > 0)[code]
            moved = float(np.abs(weight - before).max())
            if _ended(n, moved, last, tolerance):
                break
        yield from table.append_column("weight", pa.array(weight)).to_batches()

    return (cells.select(*SIDES, F.col("tokens").cast("long")).coalesce(1)
            .mapInArrow(rake, "source string, lang string, topic string, tokens long, weight double"))


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA,
          tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with weight, the raked share of tokens."""
    if within_broadcast_bound(cells):
        return _raked_at_once(cells, targets or {}, alpha, tolerance)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = materialized(cells.withColumn("weight", F.col("tokens") / F.lit(float(max(total, 1)))), "cells")
    wanted = {s: materialized(_shares(cells, s, (targets or {}).get(s), alpha), "targets") for s in SIDES}
    moved = float("inf")
    for n in count(1):
        last, step = moved, now.withColumn("before", F.col("weight"))
        for side in SIDES:
            sums = step.groupBy(side).agg(F.sum("weight").alias("have")).join(wanted[side], side)
            scaled = step.join(sums, side, "left")  # values without a target fall to 0
            step = scaled.withColumn("weight", F.when(F.col("have") > 0, F.col("weight") * F.col("target") / F.col("have"))
                                     .otherwise(F.lit(0.0))).drop("have", "target")
        now = materialized(step.withColumn("moved", F.abs(F.col("weight") - F.col("before"))).drop("before"), "cells")
        moved = now.agg(F.max("moved")).first()[0] or 0.0
        if _ended(n, moved, last, tolerance):
            break
        now = now.drop("moved")
    return now.select(*SIDES, "tokens", "weight")


def probabilities(cells: DataFrame, rate: float | None = RATE) -> DataFrame:
    """(source, lang, topic, p): least(1, factor * ratio), expected tokens being ``rate`` of all.

    With ``rate`` None the factor is the largest at which no cell with tokens needs p > 1, so the expected
    shares are the raked ones.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") * total / F.col("tokens")).otherwise(F.lit(1.0))
    cells = materialized(cells.withColumn("ratio", ratio), "ratios")
    if rate is None:
        most = cells.where("tokens > 0").agg(F.max("ratio")).first()[0]
        return cells.select(*SIDES, F.least(F.lit(1.0), F.col("ratio") / F.lit(most or 1.0)).alias("p"))
    factor = rate
    while True:
        full = F.col("ratio") * factor >= 1
        sums = cells.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"),
                         F.sum(F.when(~full, F.col("tokens") * F.col("ratio"))).alias("rest")).first()
        new = max(factor, (rate * total - (sums["full"] or 0)) / sums["rest"]) if sums["rest"] else factor
        if new - factor <= TOLERANCE * factor:
            break
        factor = new
    return cells.select(*SIDES, F.least(F.lit(1.0), F.col("ratio") * factor).alias("p"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA,
          rate: float | None = RATE) -> DataFrame:
    """``docs`` with topic, tokens, inclusion probability and whether it is kept, in the last four columns.

    They are called _topic, _tokens, _p and _kept, with more underscores where ``docs`` has such columns.
    """
    rows, (source, lang, topic, tokens, draw) = measured(docs)
    p, kept = (unused(c, docs.columns) for c in ("_p", "_kept"))
    cells = materialized(rows.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(topic).alias("topic"))
                         .agg(F.sum(tokens).alias("tokens")), "cells")
    chances = probabilities(raked(cells, targets, alpha), rate).select(
        F.col("source").alias(source), F.col("lang").alias(lang), F.col("topic").alias(topic), F.col("p").alias(p))
    found = rows.join(broadcast_if_small(materialized(chances, "chances")), [source, lang, topic])
    return found.select(*docs.columns, topic, tokens, p, (F.col(draw) < F.col(p)).alias(kept))


def sample_mixed(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with all their columns."""
    found = mixed(docs, **options)
    return found.where(F.col(found.columns[-1])).select(*docs.columns)


def oracle() -> str:
    """The same in SQL: raking and the common factor by recursion, each to its tolerance."""
    scaled, steps = "weight", []
    for i, side in enumerate(SIDES):
        steps.append(f"select *, {scaled} * t_{side} / nullif(sum({scaled}) over (partition by {side}), 0) as w{i}")
        scaled = f"coalesce(w{i}, 0)"
    inner = "k where not ended"
    for step in steps:
        inner = f"({step} from {inner})"
    targets = "".join(f"""
t_{side} as (select {side}, r / sum(r) over () as t_{side}
             from (select {side}, pow(sum(tokens), {ALPHA}) as r from c group by 1 having sum(tokens) > 0)),""" for side in SIDES)
    joins = " ".join(f"left join t_{side} using ({side})" for side in SIDES)
    given = ", ".join(f"coalesce(t_{side}, 0) as t_{side}" for side in SIDES)
    held = ", ".join(f"t_{side}" for side in SIDES)
    return rf"""
with recursive d as (
      select doc_id, coalesce(source, chr(0) || 'none') as source, coalesce(lang, chr(0) || 'none') as lang,
             case when lower(t) like '%license%' then 'legal' when t like '% | %' then 'table' when t like '%!!%' then 'shouted'
                  when t like '%***%' or t like '%$$$%' then 'noise' when t like '%@%' then 'contact' else 'prose' end as topic,
             len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as n_tokens,
             ('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 13))::ubigint / 4503599627370496.0 as draw
      from (select *, coalesce(text, '') as t from documents)),
c as (select source, lang, topic, sum(n_tokens)::bigint as tokens from d group by all),
total as (select sum(tokens)::double as n from c),{targets}
k as (select source, lang, topic, tokens, n, {given}, tokens / n as weight, 0 as i, cast('inf' as double) as moved, false as ended
        from c {joins}, total
      union all
      select source, lang, topic, tokens, n, {held}, weight, i, moved,
             moved < {TOLERANCE} or (i > {SETTLING} and moved > {STALLED} * before) as ended
        from (select source, lang, topic, tokens, n, {held}, {scaled} as weight, i + 1 as i, moved as before,
                     max(abs({scaled} - weight)) over () as moved from {inner})),
r as (select source, lang, topic, tokens, n, case when tokens > 0 then weight * n / tokens else 1 end as ratio from k where ended),
g as (select *, cast({RATE} as double) as f, false as ended from r
      union all
      select source, lang, topic, tokens, n, ratio, new, new - f <= {TOLERANCE} * f
        from (select *, greatest(f, coalesce(({RATE} * n - coalesce(sum(case when ratio * f >= 1 then tokens end) over (), 0))
                                            / sum(case when ratio * f < 1 then tokens * ratio end) over (), f)) as new from g where not ended)),
p as (select source, lang, topic, least(1.0, ratio * f) as p from g where ended)
select doc_id, d.topic, n_tokens, round(p, 6) as p, draw < p as kept
from d join p on d.source = p.source and d.lang = p.lang and d.topic = p.topic"""
