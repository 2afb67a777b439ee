import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import classify, dist, labels
from tracewell.operators import budget, compare, contracts, ranking, report, selectors, train
from tracewell.sources import jsonl, sinks
from tracewell.streaming import ledger


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "token, category",
    [(" 42", "number"), (" +", "operator"), (" =", "equals"), ("a\n", "newline"), (" x", "variable"), ("####", "final_answer_marker"), ("going", "currency_or_unit"), ("percent", "currency_or_unit"), ("$5", "currency_or_unit"), ("", "other"), (None, "other"), ("  ", "space"), (" ", "space"), ("!?", "punctuation"), ("word", "word"), ("٣", "number"), ("½", "other"), ("Therefore", "final_answer_marker")],
)
def test_token_categories(spark, token, category):
    assert one(spark, token, classify.classify_token) == category


@pytest.mark.parametrize(
    "prefix, token, kind, confidence",
    [("Let x be the total cost", "", "setup", 0.70), ("Now 2 +", " 3", "calculation", 0.75), ("Therefore the answer is", " 5", "final_answer", 0.85), ("Therefore we", "", "transformation", 0.65), ("because of", "", "verification", 0.60), ("Hello", "", "other", 0.30), (None, None, "other", 0.30), ("####" + "a" * 300, "", "other", 0.30)],
)
def test_step_types(spark, prefix, token, kind, confidence):
    r = spark.createDataFrame([(prefix, token)], "p string, t string").select(classify.classify_step(F.col("p"), F.col("t")).alias("s")).first()["s"]
    assert (r["step_type"], r["step_type_confidence"]) == (kind, confidence)


def test_distribution_features(spark):
    df = spark.createDataFrame([([0.7, 0.2, 0.1], [0.2, 0.7, 0.1], 0), ([1.0], [1.0], 5), ([0.5, 0.5], [0.5, 0.5, 0.0], None)], "e array<double>, a array<double>, t int")
    a, b, c = [r["f"] for r in df.select(dist.distribution_features(F.col("e"), F.col("a"), F.col("t")).alias("f")).collect()]
    assert math.isclose(a["kl_expert_amateur"], 0.6263814842476838) and not a["top1_match"] and a["target_prob_gap"] > 0
    assert b["expert_top2_margin"] == 1.0 and b["target_expert_prob"] is None and b["kl_expert_amateur"] == 0
    assert c["expert_top1_id"] == 0 and abs(c["kl_expert_amateur"]) < 1e-9 and c["target_prob_gap"] is None


def test_target_filter(spark):
    t = "struct<token_ids:array<int>,tokens:array<string>,weights:array<double>>"
    df = spark.createDataFrame([(([10, 151643], ["a", "b"], [0.25, 0.75]),), (([151643], ["b"], [1.0]),), (([], [], []),), (None,)], f"t {t}")
    r = [x["f"] for x in df.select(dist.filter_target(F.col("t"), 151643).alias("f")).collect()]
    assert r[0]["token_ids"] == [10] and r[0]["weights"] == [1.0] and r[0]["dropped"] == 1 and r[1:] == [None, None, None]


@pytest.mark.parametrize(
    "text, answer",
    [("\\boxed{42}", "42"), ("The final answer is: $1,234.", "1234"), ("2 + 3 = 5, so answer is 5", "5"), ("#### 7\n#### 8", "8"), ("", ""), ("none", ""), (None, None), ("\\boxed{ } answer is 3", "3")],
)
def test_predicted_answers(spark, text, answer):
    assert one(spark, text, classify.predicted_answer) == answer


def test_gold_and_normalised_answers(spark):
    assert one(spark, "We compute it.\n#### 42", classify.gold_answer) == "42"
    assert one(spark, "$1,234.", classify.normalize_answer) == "1234"


def test_degeneration(spark):
    line = "this line is long enough to count"
    rows = [("clean text", "q", []), ("", "q", ["empty_generation"]), ("ager ager agers", "q", ["repeated_artifact:ager"]), ("so so so so so", "q", []), ("sum sum sum sum sum", "q", ["repeated_word"]), ("sum sum sum sum", "q", []), ("\n".join([line] * 3), "q", ["repeated_line"]), ("x" * 80, "x" * 80, ["copies_question"]), ("x" * 79, "x" * 79, [])]
    df = spark.createDataFrame([(i, g, q) for i, (g, q, _) in enumerate(rows)], "i int, g string, q string")
    got = {r["i"]: r["r"] for r in df.select("i", classify.degeneration_reasons(F.col("g"), F.col("q"), F.lit("Please reason")).alias("r")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for *_, w in rows]


@pytest.mark.parametrize("value", ["Final-answer", " final_answer", "FINAL_ANSWER", "FinalAnswer", "final answer "])
def test_labels(spark, value):
    assert one(spark, value, lambda c: labels.canonical_label(c, ["final_answer"])) == "final_answer"


def test_prompt_keys(spark):
    same = ["gsm8k-train-00000007", "GSM8K:train:7", "gsm8k train 07", " Gsm8k-Train-7\n", "gsm8k/train/00000007", "gsm8k_train_7"]
    assert {one(spark, v, labels.prompt_key) for v in same} == {"id:gsm8k-train-7"}
    assert one(spark, "What  is\nX?", labels.prompt_key) == one(spark, "what is x?", labels.text_key)
    assert one(spark, "  ", labels.prompt_key) is None


@pytest.mark.parametrize("n", [0, 1, 50])
def test_ranked_positions(spark, n):
    random.seed(n)
    data = [(random.choice("ab"), random.choice([1.0, 2.0, None]), i) for i in range(n)]
    df = spark.createDataFrame(data, "g string, v double, i int")
    got = {r["i"]: (r["position"], r["group_size"]) for r in ranking.ranked(df, ["g"], [F.col("v").desc_nulls_last(), F.col("i")]).collect()}
    for g in "ab":
        rows = sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        assert [got[x[2]] for x in rows] == [(k + 1, len(rows)) for k in range(len(rows))]


def greedy(rows, limit):
    out, used = set(), 0
    for i, s, z in sorted(rows, key=lambda r: (-(r[1] if r[1] is not None and r[1] == r[1] else 0.0), r[0])):
        if used + (z or 0) <= limit:
            out.add(i)
            used += z or 0
    return out


@pytest.mark.parametrize("limit", [0, 1, 8, 40, 10**6])
def test_greedy_budget(spark, limit):
    random.seed(limit)
    rows = [(i, random.choice([None, float("nan"), 0.5, random.random()]), random.choice([0, 1, 2, 5, 9, 30])) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, s double, z int").repartition(5)
    assert {r["i"] for r in budget.greedy_budget(df, limit, "z", "s", "i").collect()} == greedy(rows, limit)


def test_greedy_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([(k, float(-k), z) for k, z in enumerate([5, 4, 3, 2, 1])], "i int, s double, z int")
    assert sorted(r["z"] for r in budget.greedy_budget(df.withColumn("s", F.col("s") + 10), 8, "z", "s", "i").collect()) == [3, 5]


def test_top_percent_keeps_one(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(3)], "i int, s double")
    assert [r["i"] for r in budget.top_percent(df, 1, "s", "i").collect()] == [0]
    with pytest.raises(ValueError, match="percent"):
        budget.top_percent(df, 0, "s", "i")


def test_selectors_on_nan_and_null(spark):
    d = "struct<kl_expert_amateur:double>"
    df = spark.createDataFrame([((0.4,),), ((0.39,),), ((float("nan"),),), ((None,),)], f"distribution_features {d}")
    assert [r["x"]["selected"] for r in df.select(selectors.FixedKL(0.4).decide(df).alias("x")).collect()] == [True, False, False, False]


def test_sgd_matches_a_plain_loop():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 2, 40).astype(float)
    w, b = [0.0] * 3, 0.0
    for _, (row, label) in itertools.product(range(3), zip(x, y, strict=True)):
        p = 1 / (1 + math.exp(-(b + sum(a * c for a, c in zip(w, row, strict=True)))))
        b -= 0.05 * (p - label)
        w = [a - 0.05 * ((p - label) * c + 1e-4 * a) for a, c in zip(w, row, strict=True)]
    got, bias = train.sgd(x, y, epochs=3)
    assert np.allclose(got, w) and math.isclose(bias, b)


def test_run_comparison(spark):
    run = lambda a, b: spark.createDataFrame([("a", a), ("b", b)], "key string, correct boolean")
    c = compare.common_runs({"base": run(True, False), "fixed": run(False, True), "rule": run(True, True)}, "key")
    r = compare.run_overlap(c, "base", "fixed", "rule").first()
    assert r["accuracy_rule"] == 1.0 and r["fixed_improves_over_base"] == 1 and r["fixed_regresses_from_base"] == 1


def test_jsonl_errors(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n[1]\n{"a": \n{"a": null, "b": 2}\n')
    assert jsonl.read_jsonl(spark, str(p), "a int", "drop").count() == 2
    assert jsonl.broken_lines(spark, str(p)).count() == 2
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.read_jsonl(spark, str(p), "a int").collect()
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), "a int", "drop").count() == 0
    assert sinks.write_jsonl(spark.createDataFrame([("ü", None)], "a string, b int"), str(tmp_path / "out")) == 1
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))


def test_stream_resumes_without_duplicates(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    make = lambda b: b.select("prompt_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("step"))
    run = lambda: ledger.log_candidates(spark, str(src), "prompt_id string, question string", *(str(tmp_path / x) for x in ("c", "l", "k")), make).awaitTermination()
    (src / "a.json").write_text('{"prompt_id": "a"}\n{"prompt_id": "b"}\n')
    run()
    (src / "b.json").write_text('{"prompt_id": "b"}\n{"prompt_id": "c"}\n')
    run()
    run()
    got = sorted((r["prompt_id"], r["step"]) for r in spark.read.parquet(str(tmp_path / "c")).collect())
    assert got == [(p, s) for p in "abc" for s in (1, 2)]


def test_features_of_unequal_vocabularies(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2], [0.2, 0.3, 0.1, 0.4], 3), ([0.5, 0.5], [0.25, 0.75], 1), ([1.0], [1.0], 0), ([], [1.0], 0), (None, [1.0], 0)], "e array<double>, a array<double>, t int")
    r = [x["f"] for x in df.select(dist.distribution_features(F.col("e"), F.col("a"), F.col("t")).alias("f")).collect()]
    p = np.array([0.2, 0.3, 0.1]) / 0.6
    assert r[0]["amateur_top1_id"] == 1 and math.isclose(r[0]["amateur_entropy"], -(p * np.log(p)).sum()) and r[0]["target_amateur_prob"] is None and r[0]["target_expert_prob"] is None
    assert (r[1]["expert_top1_id"], r[1]["expert_top2_margin"], r[1]["target_prob_gap"]) == (0, 0.0, -0.25)
    assert r[2]["expert_top2_margin"] == 1.0 and r[2]["expert_entropy"] == 0.0
    assert r[3] is None and r[4] is None


def test_dense_label_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [([int(x) for x in rng.integers(-2, 12, n)], [float(x) for x in rng.random(n)]) for n in (0, 1, 3, 6, 9, 9, 9)] + [(None, None), ([0, 9, 0], [1.0, 2.0, 3.0])]
    got = [r["v"] for r in spark.createDataFrame(rows, "i array<int>, w array<double>").select(dist.dense_label(F.col("i"), F.col("w"), 10).alias("v")).collect()]
    for (ids, ws), v in zip(rows, got, strict=True):
        want = [0.0] * 10
        for i, w in zip(ids or [], ws or [], strict=True):
            if 0 <= i < 10:
                want[i] = w
        assert v == want


def test_medians_spread_over_tasks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, float("nan"), 1.0, 1.0, rng.random()])) for _ in range(400)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    made = report.medians(df, ["g"], "v")
    got = {r["g"]: r["median"] for r in made.collect()}
    want = {g: float(np.median(v)) for g in ("hot", "a", None) if (v := [x for k, x in rows if k == g and x is not None and x == x])}
    assert got == want and "percentile" not in made._jdf.queryExecution().executedPlan().toString()
    assert report.summary(df.limit(0), {"v": F.col("v")}).count() == 0
    s = report.summary(df, {"v": F.col("v"), "none": F.lit(None).cast("double")})
    r = {x["metric"]: x for x in s.collect()}
    assert r["none"]["n"] == 0 and r["none"]["median"] is None and r["v"]["n"] == sum(x is not None and x == x for _, x in rows)


def test_driver_side_loaders(tmp_path):
    (tmp_path / "c.json").write_text('{"selector": {"beta": 0.7}}')
    assert selectors.load_config(str(tmp_path / "c.json")) == {"beta": 0.7}
    (tmp_path / "d.json").write_text('{"beta": 0.2}')
    assert selectors.load_config(str(tmp_path / "d.json")) == {"beta": 0.2}
    train.save_artifact({"feature_names": ["unknown"], "weights": [1.0]}, str(tmp_path / "x" / "a.json"))
    a = train.load_artifact(str(tmp_path / "x" / "a.json"))
    assert (a["name"], a["threshold"], a["standardization"], a["weights"]) == ("learned_linear", 0.5, None, [1.0])
    for name in ("checkpoint-20", "checkpoint-3", "checkpoint-x", "other"):
        (tmp_path / name).mkdir()
    assert jsonl.checkpoint_dirs(str(tmp_path)) == [("checkpoint-20", 20), ("checkpoint-3", 3)]
    assert jsonl.csv_set(" a, ,b,a") == {"a", "b"} and jsonl.csv_set(None) == set()
    assert jsonl.token_cutoff(0, 9) == 0 and jsonl.token_cutoff(None, 9) == 9 and jsonl.token_cutoff(None, None) is None
    assert contracts.dtype("BF16") == "bfloat16"
    with pytest.raises(ValueError, match="unsupported"):
        contracts.dtype("int8")
