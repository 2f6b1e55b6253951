import hashlib
import random

import pytest
from conftest import stream_rows
from pyspark.sql import functions as F

from telltale.operators import attack, metrics as mt, rules, sampling as sp

GOLDEN = [  # published metric rows: counts, ranking scores, then f1, mcc, fpr, fnr, composite
    ((79577, 61904, 31092, 13418), (0.8560006064154883, 0.851054966250196),
     (0.7814537669887658, 0.5310541600728115, 0.33433696072949376, 0.14428732727566, 0.8135091049227139)),
    ((78880, 61275, 31721, 14115), (0.8475178628166055, 0.8409939037833633),
     (0.7748678755967701, 0.5164564018003651, 0.34110069250290337, 0.1517823538899941, 0.8054019607742303)),
    ((477, 92464, 532, 92518), (0.5011835914721229, 0.4997618158564393),
     (0.01014850431896515, -0.004025404537067577, 0.005720676158114327, 0.9948706919726867, None)),
]


@pytest.mark.parametrize("counts,ranks,want", GOLDEN)
def test_golden_metric_rows(spark, counts, ranks, want):
    cm = spark.createDataFrame([(*counts, *ranks)], "tp long, tn long, fp long, fn long, roc_auc double, avg_precision double")
    row = mt.fpr_fnr(mt.f1_mcc(cm)).withColumn("composite", mt.composite_score()).first()
    got = (row.f1, row.mcc, row.fpr, row.fnr)
    assert got == pytest.approx(want[:4], abs=5e-5)
    if want[4] is not None:
        assert row.composite == pytest.approx(want[4], abs=5e-5)


def scored(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, int(rng.random() < 0.3), rng.randint(0, 20) / 20) for i in range(n)]
    return rows, spark.createDataFrame([(*r, int(r[2] >= 0.5)) for r in rows], "seq long, label int, score double, pred int")


def check_ranking(rows, df):
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    ap, last = 0.0, 0.0
    for t in sorted({s for *_, s in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(q >= t for q in neg)
        ap, last = ap + (tp / len(pos) - last) * tp / (tp + fp), tp / len(pos)
    assert mt.roc_auc(df).first().roc_auc == pytest.approx(auc)
    assert mt.average_precision(df).first().avg_precision == pytest.approx(ap)


def test_ranking_metrics_match_brute_force(spark):
    check_ranking(*scored(spark))


def test_ranking_metrics_in_blocks(spark, small_blocks):
    check_ranking(*scored(spark))


def test_one_class_gives_zero(spark):
    df = spark.createDataFrame([(0, 0, 0.2, 0), (1, 0, 0.7, 1)], "seq long, label int, score double, pred int")
    assert mt.roc_auc(df).first().roc_auc == 0.0
    row = mt.precision_recall(mt.f1_mcc(mt.confusion_matrix(df))).first()
    assert (row.recall, row.f1, row.mcc) == (0.0, 0.0, 0.0)


def rule_row(spark, **values):
    base = {c: 0.0 for c in rules.INPUTS} | values
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{c} double" for c in base))


def test_rule_boundary(spark):
    limit = spark.createDataFrame([(1e9,)], "io_threshold double")
    exact = rules.rule_score(rule_row(spark, cpu=81.0, children_rate=4.0), limit).first()
    above = rules.rule_score(rule_row(spark, cpu=81.0, children_rate=4.0, cpu_burst=1.0), limit).first()
    assert (exact.score, exact.pred) == (3.0, 0) and (above.score, above.pred) == (4.5, 1)
    assert exact.probability == 3.0 / 16 and rules.TOTAL_WEIGHT == 16.0


def attacked(spark, metrics, **info):
    base = dict(cpu=0.0, mem=0.0, num_children=0, num_threads=0, num_fds=0, num_connections=0, io_write_rate=0.0, proc_age=0.0) | info
    row = stream_rows(spark, [{}]).select("seq").withColumns({k: F.lit(v) for k, v in base.items()})
    row = row.withColumn("suspicious_metrics", F.array(*[F.lit(m) for m in metrics]).cast("array<string>"))
    return attack.attack_lookup(attack.classify_attack(row).withColumn("indicators", attack.indicators())).first()


def test_io_matches_inside_connections(spark):
    got = attacked(spark, ["num_connections=5.00"], num_fds=101, num_connections=5)
    assert got.attack_type == "Data Exfiltration"
    assert got.indicators[1] == "Network connections: 5" and len(got.recommendations) == 4


def test_confidence_ties_go_to_mining(spark):
    assert attacked(spark, ["cpu_spike=4.00"], cpu=71.0, num_threads=101).attack_type == "Cryptocurrency Mining"


def test_every_attack_type(spark):
    cases = {
        "Process Injection / Hollowing": (["num_children=6.00"], dict(num_children=6)),
        "Fork Bomb / DoS": ([], dict(num_threads=101)),
        "Ransomware": ([], dict(io_write_rate=5_000_001.0)),
        "Network Scanning / C2": ([], dict(num_connections=11)),
        "Memory Scraping": (["mem_burst=1.00"], dict(mem=61.0)),
        "File Descriptor Leak": ([], dict(num_fds=201)),
        "Unknown Anomaly": ([], {}),
    }
    for want, (metrics, info) in cases.items():
        assert attacked(spark, metrics, **info).attack_type == want


def test_top_metrics_order_and_floor(spark):
    df = spark.createDataFrame([(50.0, -3.0, 0.0, 50.0)], "a double, b double, c double, d double")
    got = df.select(attack.top_metrics(["a", "b", "c", "d"], {"a": 0.3, "b": 0.4, "c": 0.2, "d": 0.3}).alias("m")).first().m
    assert got == ["b=-3.00", "a=50.00", "d=50.00"] or got == ["a=50.00", "d=50.00", "b=-3.00"]
    assert got.index("a=50.00") < got.index("d=50.00") and "c=0.00" not in got
    assert df.select(attack.top_metrics(["a", "b", "c", "d"]).alias("m")).first().m == ["a=50.00", "d=50.00"]


def test_draws_are_selected_digit_by_digit(spark, small_blocks, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("seq"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).cast("int").alias("label"))
    wanted = spark.createDataFrame([(0, 400), (1, 0), (2, 10_000), (None, 17)], "label int, k long")
    want = {}
    for r in df.collect():
        want.setdefault(r.label, []).append((hashlib.md5(f"42:{r.seq}".encode()).hexdigest(), r.seq))
    lowest = {s for label, k in ((0, 400), (2, 10_000), (None, 17)) for _, s in sorted(want[label])[:k]}
    for digits in (4, 1):  # one digit a round: slots above six rows are looked into again
        monkeypatch.setattr(sp, "PREFIX", digits)
        edges = sp._edge_slots(df.withColumn("_d", sp.draw(42, "seq")), wanted, "label", 6)
        sizes = df.withColumn("_d", sp.draw(42, "seq")).join(edges, F.col("label").eqNullSafe(F.col("_by")) & F.col("_d").startswith(F.col("_slot")))
        assert max(r["count"] for r in sizes.groupBy("_by").count().collect()) <= 6
        picked = sp.lowest_draws(df, wanted, keep_rest=True)
        assert picked.count() == 3000 and {r.seq for r in picked.where("picked").collect()} == lowest
    assert {r.seq for r in sp.lowest_draws(df, wanted).collect()} == lowest


def test_a_split_reads_wide_rows_once(spark, tmp_path):
    spark.range(500).select(F.col("id").alias("seq"), (F.col("id") % 3).cast("int").alias("label"), F.rand(1).alias("wide")).write.parquet(str(tmp_path / "in"))
    cut = sp.stratified_split(spark.read.parquet(str(tmp_path / "in")))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("wide#") and "Union" not in plan and "Window" not in plan
    assert {(r.label, r.split): r["count"] for r in cut.groupBy("label", "split").count().collect()} == {
        (0, "test"): 42, (0, "train"): 125, (1, "test"): 42, (1, "train"): 125, (2, "test"): 42, (2, "train"): 124}


def test_draws_that_many_rows_share(spark):
    rows = [(s, 0) for s in (None, None, None, 4, 4, 4, 4, 5, 5, 6)] + [(7, 1)] * 9 + [(8, None)] * 5
    df = spark.createDataFrame(rows, "seq long, label int")
    wanted = spark.createDataFrame([(0, k) for k in (6,)] + [(1, 4), (None, 5)], "label int, k long")
    picked = sp.lowest_draws(df, wanted, keep_rest=True)
    assert sorted(map(str, ((r.seq, r.label) for r in picked.collect()))) == sorted(map(str, rows))
    got = [(r.seq, r.label) for r in picked.where("picked").collect()]
    draws = sorted((hashlib.md5(b"42" if s is None else f"42:{s}".encode()).hexdigest(), s) for s, label in rows if label == 0 and s is not None) \
        + [(hashlib.md5(b"42").hexdigest(), None)] * 3
    assert sorted(str(s) for s, label in got if label == 0) == sorted(str(s) for _, s in sorted(draws, key=lambda x: x[0])[:6])
    assert [label for _, label in got].count(1) == 4 and [label for _, label in got].count(None) == 5


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(2000).select(F.col("id").alias("seq"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    even = sp.balance_classes(df)
    assert {r.label: r["count"] for r in even.groupBy("label").count().collect()} == {0: 200, 1: 200}
    again = sp.balance_classes(df.repartition(9))
    assert {r.seq for r in even.collect()} == {r.seq for r in again.collect()}
    cut = sp.stratified_split(df)
    counts = {(r.label, r.split): r["count"] for r in cut.groupBy("label", "split").count().collect()}
    assert counts == {(0, "test"): 450, (0, "train"): 1350, (1, "test"): 50, (1, "train"): 150}
    inner = sp.validation_split(cut.where("split = 'train'"))
    assert inner.where("split = 'validation'").count() == 270 + 30
    share = sp.sample_fraction(df, 0.5).count() / 2000
    assert 0.45 < share < 0.55 and sp.sample_fraction(df, 1.0).count() == 2000
