"""The operators as registered queries, with SQL twins where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.llm import (bm25, bpe, chat, class_lm, decontaminate, exact_dedup, fill_middle, minhash, mixing, ranked_search, secret_scan,
                          suffix_dedup, toxicity)
from telltale.llm.common import documents, remainder

VOCABULARY = "word_bpe_49k.json"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), toxicity.HELD_OUT) == 1).alias("held_out"),
                         F.col("_score").alias("score"), F.col("_toxic").alias("predicted"))


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    asked = docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return bm25.search(docs, asked).withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.drop_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
                        F.round("_p", 6).alias("p"), F.col("_kept").alias("kept"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles recovered from the transcript alone; the role column only trains, on two thirds of the conversations."""
    turns = chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"), use_roles=False)
    return turns.select("conv_id", "turn", "segment", "given", "role", "n_lines", "rendered")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.fill_in_middle(documents(spark, sf_dir)))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_search, op4_exact_dedup, op5_class_lm, op6_minhash, op7_suffix_dedup, op8_mixing, op9_chat, op10_bpe, op11_fill_middle,
                                   op12_decontaminate, op13_ranked_search)}

ORACLES = {
    "op4_exact_dedup": r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm,
                  length(coalesce(text, '')) as n from documents),
     k as (select doc_id, norm, row_number() over w as rn, first_value(doc_id) over w as keep_id,
                  count(*) over (partition by norm) as group_size
           from d window w as (partition by norm order by n desc, doc_id))
select doc_id, keep_id, group_size, rn = 1 as kept, sha256(norm) as text_sha256 from k""",
    "op8_mixing": mixing.oracle(),
    "op3_search": r"""
with d as (select doc_id, list_filter(string_split_regex(regexp_replace(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D]', ' ', 'g'), ' +'), lambda x: x <> '') as w from documents),
     s as (select count(*) as n, avg(len(w)) as mean from d),
     t as (select doc_id, w, count(*) as tf, any_value(l) as l from (select doc_id, len(w) as l, unnest(w) as w from d) group by 1, 2),
     f as (select w, count(*) as df from t group by 1),
     q as (select doc_id as query_id, w from t where doc_id % 100 = 0),
     r as (select query_id, t.doc_id,
                  sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) as score
           from q join t using (w) join f using (w), s group by 1, 2)
select query_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank, doc_id,
       round(score, 6) as score from r
qualify rank <= 10""",
    "op11_fill_middle": r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
     n as (select doc_id, t, length(t) as n, list_transform([1, 9, 17, 25], lambda k: cast('0x' || substr(h, k, 8) as bigint)) as h from d),
     c as (select doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
                  case when n = 0 or regexp_matches(t, '<[PSM]>') or h[3] % 100 >= 90 then 'plain'
                       when h[4] % 100 < 20 then 'spm' else 'psm' end as form from n),
     p as (select *, substring(t, 1, a) as x, substring(t, a + 1, b - a) as y, substring(t, b + 1) as z from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y
              else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256, sha256(t) as restored_sha256 from p""",
    "op12_decontaminate": r"""
with raw as (select 'd' as kind, row_number() over () as row, doc_id as id, text from documents
             union all select 'b', row_number() over (), item_id, text from benchmark),
     w as (select kind, row, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from raw),
     runs as (select distinct id, w[s:s + least(len(w), 10) - 1] as run from
                (select id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from w where kind = 'b' and len(w) > 0)),
     sizes as (select distinct len(run) as n from runs),
     found as (select row, s, n, run from (select row, s, n, w[s:s + n - 1] as run from
                (select row, w, n, unnest(range(1, len(w) - n + 2)) as s from w, sizes where kind = 'd' and len(w) >= n))
               where run in (select run from runs)),
     hit as (select row, count(distinct p) as n_hit from (select row, unnest(range(s, s + n)) as p from found) group by 1),
     items as (select row, list_sort(list(distinct cast(id as varchar))) as ids from found join runs using (run) group by 1)
select w.id as doc_id, len(w.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(ids), 0) as n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, n_hit is not null as contaminated
from w left join hit using (row) left join items using (row) where kind = 'd'""",
    "op13_ranked_search": r"""
with raw as (select 'd' as kind, row_number() over () as row, doc_id as id, text from documents
             union all select 'b', row_number() over (), item_id, text from benchmark),
     t as (select kind, row, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from raw),
     g as (select kind, row, id, term, count(*) as times from t group by all),
     n as (select row, cast(sum(times) as bigint) as n from g where kind = 'd' group by 1),
     s as (select count(*) as docs, cast(sum(n) as bigint) as l from n),
     w as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from g, s where kind = 'd' group by 1),
     p as (select b.row, b.id as item_id, d.row as at, d.id as doc_id,
                  cast(sum(b.times * w * ((1000000000 * d.times) // (1000 * d.times + 12 * (75 + (25 * n * docs) // l)))) as bigint) as score
           from g b join w using (term) join g d using (term) join n on n.row = d.row, s
           where b.kind = 'b' and d.kind = 'd' group by all)
select item_id, cast(row_number() over (partition by row order by score desc, doc_id) as int) as rank, doc_id, score
from p where score > 0 qualify rank <= 20""",
}
