import base64
import math
import random
import statistics
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.llm import capping, components, cutoff, lookup, mixing, overlap, percentiles, queries, splits, subjects, target_sample, tokens, truncation

DATA = "/root/testdata/sf0.001"
NAN = float("nan")


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# 1: caps
def plain_cap(rows, cap):
    by = defaultdict(list)
    for k, c, q, _ in rows:
        by[c].append((q is None or math.isnan(q), -(q or 0) if q is not None and not math.isnan(q) else 0, k))
    return sorted((k,) for v in by.values() for *_, k in sorted(v)[:cap])


@pytest.mark.parametrize("cap", [0, 1, 16, 1500])
def test_cap_takes_the_best(spark, cap):
    random.seed(cap)
    rows = [(i, random.choice(["hot", "hot", "a", None]), random.choice([None, NAN, 0.5, 0.5, random.random()]), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, q double, t string").withColumns({"_rank": F.lit(1), "stratum": F.lit("z")}).repartition(7)
    assert ids(capping.cap_contributors(df, "id", ["c"], "q", cap), "id") == plain_cap(rows, cap)


def test_strata_share_the_cap(spark):
    rows = [(i, "p", float(i), "big") for i in range(40)] + [(100 + i, "p", 0.0, "small") for i in range(2)] + [(200 + i, "p", 0.0, "mid") for i in range(9)]
    df = spark.createDataFrame(rows, "id long, c string, q double, t string")
    kept = Counter(r["t"] for r in capping.cap_contributors(df, "id", ["c"], "q", 16, "t").join(df, "id").collect())
    assert kept == {"big": 12, "small": 1, "mid": 3}


def test_quotas_against_a_loop(spark):
    random.seed(12)
    rows, want = [], {}
    for c in range(60):
        sizes = {f"s{k}": random.randrange(1, random.choice([3, 30, 900])) for k in range(random.randrange(1, 7))}
        weights = {k: random.choice([1, 2, 7, n]) for k, n in sizes.items()}
        rows += [(c, k, n, weights[k]) for k, n in sizes.items()]
        quota, left, live = {}, 16, dict(weights)
        while live:
            rest = sum(live.values())
            full = [k for k in live if sizes[k] * rest <= left * live[k]]
            if not full:
                parts = {k: left * w // rest for k, w in live.items()}
                for k in sorted(live, key=lambda k: (-(left * live[k] % rest), -sizes[k], k))[: left - sum(parts.values())]:
                    parts[k] += 1
                quota |= parts
                break
            for k in full:
                quota[k] = sizes[k]
                left -= sizes[k]
                del live[k]
        want |= {(c, k): q for k, q in quota.items()}
    df = spark.createDataFrame(rows, "c long, stratum string, n long, w long")
    got = {(r["c"], r["stratum"]): r["quota"] for r in capping.stratum_quotas(df, ["c"], 16, F.col("w")).collect()}
    assert got == want
    by_size = {(r["c"], r["stratum"]): r["quota"] for r in capping.stratum_quotas(df, ["c"], 16).collect()}
    assert all(sum(q for (c, _), q in by_size.items() if c == k) == min(16, sum(n for c, _, n, _ in rows if c == k)) for k in range(60))


def test_cap_of_an_empty_table(spark):
    assert capping.cap_contributors(spark.createDataFrame([], "id long, c string, q double"), "id", ["c"], "q", 3).count() == 0


# 2: overlaps
PAIRS = [
    ("A box has 28 rows of 46 jars. 8 jars fall. How many are left?", "[Problem 7] A box has 28 rows of 46 jars. Eight jars fall. How many are left? Show all steps.", True),
    ("A shop sells 1875 mugs and 2888 cups. 921 are returned. How many stay sold?", "A shop sells 1,875 mugs and 2,888 cups. It was windy. 921 are returned. How many stay sold?", True),
    ("A farm sells 3875 eggs and 4888 hens. 721 are returned. How many stay sold?", "A farm sells 3876 eggs and 4888 hens. 721 are returned. How many stay sold?", False),
    ("Give the capital of France and say why it is the capital", "Give the capital of  france and say why it is the capital", True),
    ("Anna buys 1 book for 5 dollars at the fair", "Anna buys one book for 5 dollars at the fair", True),
    ("The hall has 25 seats in front of the stage", "The hall has twenty-five seats in front of the stage", True),
    ("A basket holds 12 eggs from the farm near us", "A basket holds a dozen eggs from the farm near us", True),
    ("A farmer with 9 cows sells half of them today", "It is Monday. The weather was calm and nobody was about. A farmer with 9 cows sells half of them today", True),
    ("The hall has 25 seats in front of a stage", "The hall has 26 seats in front of a stage", False),
    ("A train has 12 cars with 30 seats and 40 places are empty.", "Mix 12 spoons, 30 grams, 40 drops of any oil you like today", False),
]


def test_overlaps(spark):
    rows = [(side, f"{side}-{i}", t) for i, (a, b, _) in enumerate(PAIRS) for side, t in (("eval", a), ("train", b))]
    rows += [("eval", "eval-null", None), ("train", "train-blank", "  "), ("train", None, "x"), rows[0]]
    df = spark.createDataFrame(rows, "side string, id string, text string").withColumn("class", F.lit("clash"))
    got = {(a, b) for a, b in ids(overlap.overlapping_pairs(df), "id_a", "id_b")}
    assert got == {(f"eval-{i}", f"train-{i}") for i, (_, _, same) in enumerate(PAIRS) if same}


def same_problem(x, y):
    """The definition, on the sets of two records."""
    jac = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
    told = lambda p, q: all(d.split("#")[0] in q[2] for d in set(p[1]) - set(q[1]))
    a, b = [set(v) for v in x], [set(v) for v in y]
    quantities = min(len(a[0]), len(b[0])) > 1 and jac(a[0], b[0]) >= overlap.QUANTITY_SIMILARITY - 1e-9 and jac(a[3], b[3]) >= overlap.WORDING
    least = min(len(a[4]), len(b[4]))
    words = max(len(a[0]), len(b[0])) <= overlap.FEW and least > 0 and len(a[4] & b[4]) >= overlap.WORD_SIMILARITY * least - 1e-9
    return told(x, y) and told(y, x) and (quantities or words)


@pytest.mark.parametrize("hot", [1000, 1])
def test_prefix_join_misses_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT_KEY", hot)
    random.seed(3)
    texts = [" ".join(f"{random.randrange(2, 7)} {random.choice(['alpha', 'beta', 'two'])}" for _ in range(random.randrange(1, 5))) for _ in range(150)]
    texts += [" ".join(random.choice(["red", "blue"]) for _ in range(7)) for _ in range(20)]
    long = [str(random.randrange(2, 90)) for _ in range(66)]
    texts += [" ".join(long[: random.randrange(44, 67)] + ["x"] * random.randrange(3)) for _ in range(24)]
    rows = [("eval" if i % 2 else "train", f"k{i:03}", t) for i, t in enumerate(texts)]
    feats = {i: overlap.features(t) for _, i, t in rows}
    ev, tr = [i for s, i, _ in rows if s == "eval"], [i for s, i, _ in rows if s == "train"]
    want = sorted((min(a, b), max(a, b)) for a in ev for b in tr if same_problem(feats[a], feats[b]))
    got = ids(overlap.overlapping_pairs(spark.createDataFrame(rows, "side string, id string, text string")), "id_a", "id_b")
    assert got == want and want


def test_problems_against_all_pairs(spark):
    """Every fifth test problem of the small tables against all training problems."""
    rows = queries._problems(spark, DATA).where("text is not null").collect()
    feats = {(r["side"], r["id"]): overlap.features(r["text"]) for r in rows}
    ev = sorted(i for s, i in feats if s == "eval")[::5]
    want = {(min(a, b), max(a, b)) for a in ev for s, b in feats if s == "train" and same_problem(feats["eval", a], feats["train", b])}
    got = {p for p in ids(queries.p2_found(spark, DATA), "id_a", "id_b") if p[0] in ev or p[1] in ev}
    assert got == want


def test_spelled_numbers():
    cases = {"twenty five": 25, "two hundred and six": 206, "three thousand": 3000, "a dozen": 12, "half a dozen": 6, "two dozen": 24, "one hundred five": 105, "nineteen": 19, "a hundred": 100}
    for text, n in cases.items():
        assert overlap.spelled_number(text.split(), 0) == (n, len(text.split()))
    assert overlap.spelled_number(["five", "six"], 0) == (5, 1) and overlap.spelled_number(["a", "book"], 0) is None


# 3: truncation
def test_truncation(spark):
    random.seed(2)
    rows = []

    def add(writer, response, prediction="12", gold="12", correct=True):
        rows.append((len(rows), writer, gold, prediction, correct, response))

    for i in range(400):
        body = " ".join(random.choice(["We add the terms here.", "Then it is right."]) for _ in range(random.randrange(2, 8)))
        whole = f"{body} The answer is {100 + i}."
        add("w", whole, str(100 + i), str(100 + i))
    n = len(rows)
    add("w", "We add the te", "5", "5")
    add("w", "We add the terms here. Then it is", "5", "5")
    add("w", "Then it is right. The answer is 1234.", "12", "1234")
    add("w", None, None)
    add("w", "", "")
    add("w", "We add the terms here. The answer is \\boxed{43", "43", "43")
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "eval_id long, writer string, gold string, prediction string, correct boolean, response string").withColumn("w1", F.lit(1))
    assert set(ids(truncation.cut_values(df), "eval_id", "field")) == {(n, "response"), (n + 1, "response"), (n + 2, "prediction"), (n + 5, "response")}


EVALS = "eval_id long, writer string, gold string, prediction string, correct boolean, response string"


def test_length_hazard(spark):
    random.seed(5)
    rows = [(i, "w", None, None, None, "x" * max(1, min(50, int(random.gauss(45, 12))))) for i in range(1500)]
    found = {(r["unit"], r["length"]) for r in truncation.significant_lengths(truncation.measured(spark.createDataFrame(rows, EVALS))).collect()}
    assert ("chars", 50) in found and ("bytes", 50) in found and not any(u == "chars" and z < 45 for u, z in found)


def limited_rows(n=600, limit=120, mark=""):
    """Whole replies and, where they are longer than the limit, what is left of them."""
    random.seed(11)
    rows, cut = [], set()
    for i in range(n):
        body = " ".join(random.choice(["We add the terms here.", "Then it is right.", "Every value is used once."]) for _ in range(random.randrange(2, 9)))
        whole = f"{body} The answer is {100 + i}."
        if len(whole) > limit:
            cut.add((i, "response"))
        rows.append((i, "w", str(100 + i), None, None, whole[:limit] + mark if len(whole) > limit else whole))
    return rows, cut


@pytest.mark.parametrize("mark", ["", " <snip>", "..."])
def test_significant_lengths_decide(spark, monkeypatch, mark):
    rows, cut = limited_rows(mark=mark)
    df = spark.createDataFrame(rows, EVALS)
    got = set(ids(truncation.cut_values(df), "eval_id", "field"))
    assert got <= cut and len(got) > 0.9 * len(cut)
    real = truncation.significant_lengths
    monkeypatch.setattr(truncation, "significant_lengths", lambda rows: real(rows).limit(0))
    without = set(ids(truncation.cut_values(df), "eval_id", "field"))
    assert without <= got and (len(without) < len(got) or not mark)


def test_stock_replies_have_no_mark(spark):
    rows, _ = limited_rows(200, 1000)
    rows += [(1000 + i, "w", "1", None, None, "No idea, sorry") for i in range(60)]
    assert truncation.cut_values(spark.createDataFrame(rows, EVALS)).count() == 0


def test_long_last_word(spark):
    word = "x+y=" * 60
    rows = [(i, "w", None, None, None, f"So we get {word}z.") for i in range(60)] + [(99, "w", None, None, None, f"So we get {word}"), (100, None, None, "", None, "")]
    assert ids(truncation.cut_values(spark.createDataFrame(rows, EVALS)), "eval_id") == [(99,)]
    assert truncation.cut_values(spark.createDataFrame([], EVALS)).count() == 0


def test_continued_counts(spark):
    random.seed(6)
    keys = sorted({"".join(random.choice("ab ") for _ in range(random.randrange(1, 7))) for _ in range(200)})
    counted = spark.createDataFrame([(k, i % 5 + 1) for i, k in enumerate(keys)], "key string, n long")
    got = {r["key"]: r["goes_on"] for r in truncation._continued(counted, counted.select("key")).collect()}
    assert got == {k: sum(i % 5 + 1 for i, x in enumerate(keys) if x != k and x.startswith(k)) for k in keys}


# 4: target shares
def candidates(spark, rows):
    schema = "candidate_id long, token_features struct<token_category:string>, step_features struct<step_type:string>, distribution_features struct<kl_expert_amateur:double,expert_entropy:double,entropy_gap:double>, prompt_id string, question string, dataset string, logged_at timestamp"
    return spark.createDataFrame(rows, schema)


def test_target_sample(spark):
    random.seed(9)
    rows = [(i, (random.choice(["word", "Word ", "number", None]),), (random.choice(["setup", "SETUP", "other"]),), (1.0, 1.0, 1.0), "p", "q", "d", None) for i in range(800)]
    rows += [(900, ("number",), ("final_answer",), (1.0, 1.0, 1.0), "p", "q", "d", None)] * 2
    targets = spark.createDataFrame([("word", "setup", 0.5, 2), ("number", "setup", 0.3, 5), ("number", "final_answer", 0.1, 3), ("equals", "setup", 0.1, 1)], "token_category string, step_type string, target_share double, min_rows long").withColumn("available", F.lit(1))
    cells, t = target_sample.candidate_cells(candidates(spark, rows), targets)
    report = target_sample.cell_report(t)
    assert ids(report.where("short"), "token_category", "step_type") == [("equals", "setup"), ("number", "final_answer")]
    drawn = target_sample.draw_sample(cells, report)
    n = Counter(r["cell"] for r in drawn.collect())
    # one row of the third cell, none of the fourth: the rest of the 100 goes to the first two, five to three
    assert abs(n["word/setup"] - 99 * 5 / 8) <= 1 and abs(n["number/setup"] - 99 * 3 / 8) <= 1 and n["number/finalanswer"] == 1
    assert drawn.select("candidate_id").distinct().count() == sum(n.values())


def test_systematic_sample_against_a_loop(spark):
    """Short cells give all rows, their shortfall goes to the others, and crossings are exact."""
    random.seed(2)
    available = {"a": 3, "b": 400, "c": 90, "d": 0, "e": 7}
    share = {"a": 0.2, "b": 0.3, "c": 0.3, "d": 0.1, "e": 0.1}
    report = spark.createDataFrame([(c, n, 0, share[c], 150) for c, n in available.items()], "cell string, available long, min_rows long, target_share double, size long")
    rows = spark.createDataFrame([(i * 10 + k, c) for k, (c, n) in enumerate(available.items()) for i in range(n)], "candidate_id long, cell string")
    got = Counter(r["cell"] for r in target_sample.draw_sample(rows, report).collect())
    left, live, want = 150.0, {c: s for c, s in share.items() if available[c]}, {}
    while any(available[c] * sum(live.values()) <= left * s for c, s in live.items()):
        for c in [c for c, s in live.items() if available[c] * sum(live.values()) <= left * s][:1]:
            want[c] = available[c]
            left -= available[c]
            del live[c]
    want |= {c: left * s / sum(live.values()) for c, s in live.items()}
    assert abs(sum(got.values()) - 150) <= 1 and all(abs(got[c] - x) <= 1 for c, x in want.items())
    least = report.withColumn("min_rows", F.when(F.col("cell") == "e", 7).otherwise(5).cast("long")).withColumn("target_share", F.when(F.col("cell") == "a", 0.0).otherwise(F.col("target_share")))
    got = Counter(r["cell"] for r in target_sample.draw_sample(rows, least).collect())
    assert got["a"] == 3 and got["e"] == 7


def test_only_short_cells_stay_below_what_is_wanted(spark):
    """Half rows are rounded up in every cell that has them; two targets of one cell count together."""
    report = spark.createDataFrame([("a", "a", "a", 30, 0, 0.3, 15), ("b", "b", "b", 30, 2, 0.3, 15), ("c", "c", "c", 30, 7, 0.1, 15), ("c2", "c", "c", 30, 31, 0.1, 15), ("d", "d", "d", 2, 0, 0.2, 15), ("e", "e", "e", 0, 1, 0.0, 15)], "token_category string, step_type string, cell string, available long, min_rows long, target_share double, size long")
    report = target_sample.cell_report(report)
    rows = spark.createDataFrame([(i * 10 + k, c) for k, c in enumerate("abcd") for i in range(2 if c == "d" else 30)], "candidate_id long, cell string")
    drawn = target_sample.draw_sample(rows, report)
    assert drawn.count() == drawn.select("candidate_id").distinct().count()
    for r in target_sample.sample_report(drawn, report).collect():
        assert r["drawn"] >= min(r["available"], r["wanted"]) and r["short"] == (r["drawn"] < r["wanted"])
    assert ids(target_sample.unmet_cells(drawn, report), "token_category") == [("c2",), ("d",), ("e",)]


def test_unmet_cells_come_from_the_draw(spark, monkeypatch):
    whole = spark.read.parquet(f"{DATA}/category_targets.parquet").where("min_rows > 0").count()
    draw = target_sample.draw_sample
    monkeypatch.setattr(target_sample, "draw_sample", lambda rows, report: draw(rows, report).limit(0))
    assert queries.p4_found(spark, DATA).count() == whole


# 5: splits
def test_components(spark):
    random.seed(4)
    links = [(f"n{random.randrange(60):03}", f"n{random.randrange(60):03}") for _ in range(45)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"h{i}") for i in range(30)] + [(None, "x"), ("y", "y")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "u string, v string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_prompt_pairs(spark):
    rows = [("gsm8k-train-7", "Q one"), ("GSM8K:train:0007", None), ("x-1", "q  ONE"), ("q one", "zz"), ("other", " "), (None, "q one"), ("", "q"), ("solo", None), ("b", ""), ("late", "ZZ")]
    pairs = ids(splits.same_prompt_pairs(spark.createDataFrame(rows, "prompt_id string, question string")), "prompt_id_a", "prompt_id_b")
    group = sorted(["gsm8k-train-7", "GSM8K:train:0007", "x-1", "q one", "late"])
    assert pairs == sorted((a, b) for i, a in enumerate(group) for b in group[i + 1 :])


@pytest.mark.parametrize("seed", range(3))
def test_quotas(seed):
    random.seed(seed)
    bundles = [(((lab, z),), random.randrange(1, 40)) for z in (1, 2, 3, 7, 50) for lab in ("a", "b")] + [((("a", 3), ("b", 4)), 5), ((("a", 850), ("b", 50)), 1)]
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = splits.settle_quotas(bundles, shares)
    rows, by_label, of = Counter(), Counter(), Counter()
    for p, n in bundles:
        assert sum(got[p].values()) == n and min(got[p].values()) >= 0
        for lab, c in p:
            of[lab] += c * n
            for s, x in got[p].items():
                rows[s] += x * c
                by_label[lab, s] += x * c
    total = sum(of.values())
    assert all(abs(rows[s] - shares[s] * total) <= 3 for s in shares)
    assert all(abs(by_label[lab, s] - shares[s] * of[lab]) <= 60 for lab in of for s in shares)


def test_splits_keep_prompts_together(spark):
    random.seed(1)
    rows = [(i, None, None, None, random.choice([f"gsm8k-train-{i % 60}", f"GSM8K/train/{i % 60:04}", None]), f"question {i % 60}", "gsm8k", None) for i in range(700)]
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    got = splits.assign_splits(candidates(spark, rows + rows[:50]).withColumn("component", F.lit(0)), t).collect()
    assert len(got) == 700
    by = defaultdict(set)
    for r in got:
        by[r["candidate_id"] % 60].add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    assert abs(sum(r["split"] == "train" for r in got) / 700 - 0.8) < 0.03
    assert splits.assign_splits(candidates(spark, []), t).count() == 0


# 6 and 7: cutoffs and percentiles
def test_cutoff_and_percentiles(spark):
    random.seed(6)
    rows = []
    for i in range(500):
        v = random.choice([None, NAN, 0.0, -0.0, 0.5, 1e12, random.random()])
        rows.append((i, (random.choice(["word", "WORD", "number", None]),), (random.choice(["setup", " Setup", "other"]),), (v, v, v), "p", "q", "d", datetime(2025, 3, 1 + i % 3)))
    rows += rows[:60]
    df = candidates(spark, rows)
    scored = cutoff.scored_candidates(df, spark.createDataFrame([("setup", 0.25), ("other", 0.0), ("none", 0.5)], "step_type string, keep_fraction double").withColumn("score", F.lit(1)))
    good = {r[0]: r[3][0] for r in rows if r[2][0].strip().lower() == "setup" and r[3][0] is not None and not math.isnan(r[3][0])}
    k = math.ceil(0.25 * len(good))
    line = sorted(good.values(), reverse=True)[k - 1]
    (c,) = cutoff.cutoffs(scored).collect()
    assert (c["m"], c["target"], c["cutoff"], c["kept"]) == (len(good), k, line, sum(v >= line for v in good.values()))
    assert ids(cutoff.kept_candidates(scored), "candidate_id") == sorted((i,) for i, v in good.items() if v >= line)
    daily = percentiles.daily_counts(df)
    whole = percentiles.percentiles(daily.where("day < '2025-03-02'").unionByName(daily.where("day >= '2025-03-02'")))
    words = sorted(r[3][0] for r in {x[0]: x for x in rows}.values() if (r[1][0] or "").lower() == "word" and r[3][0] is not None and not math.isnan(r[3][0]))
    med = whole.where("token_category = 'word' and metric = 'entropy_gap' and q = 0.5").first()
    assert med["value"] == statistics.median(words) and med["rows"] == len(words)
    assert percentiles.percentiles(percentiles.daily_counts(candidates(spark, []))).count() == 0
    assert cutoff.cutoffs(cutoff.scored_candidates(candidates(spark, []), spark.createDataFrame([("setup", 0.25)], "step_type string, keep_fraction double"))).count() == 0


# 8: tokens
@pytest.fixture(scope="module")
def voc():
    return tokens.vocabulary(open(tokens.DEFAULT_VOCABULARY, "rb").read())


@pytest.fixture(scope="module")
def public(voc):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokens.WORDS, mergeable_ranks=voc.rank, special_tokens={})


def test_encoding_matches_the_library(voc, public):
    random.seed(8)
    parts = list(voc.rank)
    words = [b"".join(random.choice(parts) for _ in range(random.randint(1, 6))) for _ in range(5000)]
    assert [list(x) for x in voc.encode_words(words)] == [public._encode_single_piece(w) for w in words]


def test_encoding_of_texts(spark, public):
    texts = [None, "", " \n\t ", "Hello world's  <|endoftext|> 42", "ñandú 中文 العربية 👩‍👩‍👧 \x00\x1c", "a" * 30000, "Let $x_2 \\neq 5$.\r\n\r\n  ok", "aaaa bbbb" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df).collect()}
    assert [got[i] for i in range(len(texts))] == [public.encode_ordinary(t or "") for t in texts]
    assert tokens.encoded(df.limit(0)).count() == 0
    sizes = {r["doc_id"]: r["tokens"] for r in tokens.encoded(df, sizes_only=True).collect()}
    assert sizes == {i: len(got[i]) for i in got}


def test_vocabularies_are_kept_apart():
    enc = lambda pairs: b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in pairs)
    common = [(bytes([i]), i) for i in range(256)]
    one, two = tokens.vocabulary(enc([*common, (b"ab", 256)])), tokens.vocabulary(enc([*common, (b"bc", 256)]))
    both = [[int(x) for ids in tokens.encode_batch(v, ["abc"])[0] for x in ids] for v in (one, two)]
    assert both == [[256, 99], [97, 256]]


# 9: mixing
@pytest.mark.parametrize("seed", range(6))
def test_budget_fit(seed):
    random.seed(seed)
    lengths = {random.randrange(1, 400): random.randrange(1, 9) for _ in range(40)}
    own = sum(z * n for z, n in lengths.items())
    for budget in (0, 1, own // 3, own - 1, own, own + 5):
        take = mixing.fit_budget(budget, lengths)
        size = sum(z * k for z, k in take.items())
        assert all(0 <= k <= lengths[z] for z, k in take.items()) and size <= budget
        reach = 1
        for z, n in lengths.items():
            for _ in range(n):
                reach |= reach << z
        assert size == (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1


def test_budget_fit_without_exact_sums():
    random.seed(7)
    for _ in range(300):
        lengths = {random.randrange(1, random.choice([9, 60, 400])): random.randrange(1, 7) for _ in range(random.randrange(1, 6))}
        own, reach = sum(z * n for z, n in lengths.items()), 1
        for z, n in lengths.items():
            for _ in range(n):
                reach |= reach << z
        budget = random.randrange(0, own + 2)
        take = mixing.fit_budget(budget, lengths)
        assert sum(z * k for z, k in take.items()) == (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1


def test_mixture(spark):
    docs = [(i, "word " * (1 + i % 7), ["a", "A ", "b", "c", None][i % 5]) for i in range(200)] + [(900, None, "a"), (901, "", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(3))
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.4, 1)], "source string, target_weight double, max_repeats int")
    sized = mixing.source_sizes(df, targets)
    plan = mixing.plan_for(sized, targets)
    mix = mixing.mixed(sized, plan)
    report = {r["source"]: r for r in mixing.mix_report(mix, plan).collect()}
    assert report["c"]["short"] and not report["a"]["short"] and report["c"]["mixed_tokens"] == plan["c"]["own"]
    assert report["a"]["mixed_tokens"] == int(plan["a"]["budget"]) and report["b"]["mixed_tokens"] == int(plan["b"]["budget"])
    assert mix.where("source = 'b'").agg(F.max("repeats")).first()[0] <= 3
    assert ids(mix, "doc_id") == ids(mixing.mixed(sized.repartition(3), plan), "doc_id")
    empty = mixing.source_sizes(df.limit(0), targets)
    assert mixing.mixed(empty, mixing.plan_for(empty, targets)).count() == 0


# 10: subjects
@pytest.fixture(scope="module")
def examples(spark):
    return spark.read.parquet(f"{DATA}/subject_examples.parquet")


def test_subjects_of_held_out_examples(spark, examples):
    """A third of the examples labels documents made of the others, one to three texts each."""
    rest = [(r["text"], r["subject"]) for r in examples.where("example_id % 3 <> 0").orderBy("example_id").collect()]
    random.seed(4)
    want, docs = set(), []
    for i in range(500):
        chosen = random.sample(rest, random.choice([1, 1, 2, 3]))
        docs.append((i, "\n\n".join(t for t, _ in chosen), None))
        want |= {(i, s) for t, _ in chosen for u, s in rest if u == t}
    found = subjects.document_subjects(spark.createDataFrame(docs, "doc_id long, text string, subject string"), examples.where("example_id % 3 = 0"))
    got = set(ids(found, "doc_id", "subject"))
    assert len(got & want) / len(want) > 0.75 and len(got & want) / len(got) > 0.85


def test_subjects_need_labelled_leaves(spark, examples, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    monkeypatch.setattr(subjects, "settled_labels", lambda labels, beside: {})
    assert subjects.document_subjects(docs, examples).count() == 0


def test_subjects_of_nothing(spark, examples):
    docs = spark.createDataFrame([(1, None), (2, " "), (3, "1 2 3"), (4, "")], "doc_id long, text string")
    assert subjects.document_subjects(docs, examples).count() == 0
    assert subjects.document_subjects(docs.limit(0), examples.limit(0)).count() == 0
    assert subjects.document_subjects(spark.createDataFrame([(1, "the chef stirs")], "doc_id long, text string"), examples.limit(0)).count() == 0


def test_labels_of_leaves():
    assert subjects.term_labels([(1, "law", 0.3), (2, "law", 0.05), (3, "law", 0.2), (3, "sport", 0.2)]) == {1: "law"}
    beside = [(4, 1, 30), (4, 5, 10), (5, 1, 10), (5, 2, 10), (5, 6, 200), (1, 1, 50), (2, 2, 50), (7, 1, 2), (7, 6, 98), (8, 1, 95), (8, 2, 5)]
    out = subjects.settled_labels({1: "law", 2: "sport", 7: "law", 8: "sport"}, beside)
    # 4 stands beside law; 5 beside anything; 7 is not among few; 8 is outvoted
    assert out[4] == "law" and 5 not in out and out[8] == "law" and out[1] == "law" and out[2] == "sport"


def test_surroundings_beyond_chance(spark):
    """Two subjects and a part (0) that stands beside everything: it is nobody's company; a repeated corpus keeps the proportions."""
    random.seed(6)
    docs = [(d, [x for k in random.choices([1, 2, 3] if d % 2 else [4, 5, 6], k=4) for x in (k, 0)]) for d in range(200)]

    def beside(times):
        placed = spark.createDataFrame([(d + 1000 * t, at, shape) for t in range(times) for d, v in docs for at, shape in enumerate(v)], "id long, at int, shape long")
        sizes = placed.groupBy("shape").agg(F.count("*").alias("n"))
        return {(r["a"], r["b"]): r["n"] for r in subjects.surroundings(placed, sizes, placed.count()).collect()}

    once, often = beside(1), beside(9)
    assert {(a > 3, b > 3) for a, b in once if a and b} == {(False, False), (True, True)}
    pairs = [p for p in once if 0 not in p]
    assert len({p for p in pairs if p[0] < p[1]}) == 6 and max([n for p, n in once.items() if 0 in p], default=0) < min(once[p] for p in pairs) / 2
    assert all(often[p] / once[p] == pytest.approx(3, rel=0.1) for p in pairs)


def test_leaves_around_tell_too():
    """Leaf 2 has few telling words but stands beside 1; 3 has some of another subject but stands beside 1 as well."""
    told = [(1, "law", 0.3), (2, "law", 0.01), (3, "sport", 0.15)]
    both = subjects.told_around(told, [(2, 1, 8.0), (2, 4, 2.0), (3, 1, 5.0), (1, 2, 5.0)])
    assert {k: s for k, s, v in both if v == max(w for j, _, w in both if j == k)} == {1: "law", 2: "law", 3: "law"}
    assert subjects.term_labels(both) == {1: "law", 2: "law", 3: "law"} and subjects.term_labels(told) == {1: "law", 3: "sport"}


def test_names_and_numbers_leave_the_shape(spark):
    df = spark.createDataFrame([(1, "Anna told Bob 12 things. we saw told things. Then we saw Anna.\nStill going"), (2, "Der Richter hört 3 Fälle")], "doc_id long, text string")
    made = {r["part"]: r["words"] for r in subjects.parts(df, "doc_id").join(subjects.shapes_of(subjects.parts(df, "doc_id")), "part_key").collect()}
    assert made == {"Anna told Bob # things": ["things", "told"], "we saw told things": ["saw", "things", "told", "we"], "Then we saw Anna": ["saw", "we"], "Der Richter hört # Fälle": ["der", "fälle", "hört", "richter"], "Still going": ["going"]}


def test_hot_keys_are_looked_up_whole(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(900)] + [(-1, None)], "id long, k long")
    table = spark.createDataFrame([(k, k * 2) for k in range(0, 900, 2)] + [(7, 14)], "k long, v long")
    want = ids(rows.join(table, "k"), "id", "k", "v")
    assert ids(lookup.looked_up(rows, table, "k"), "id", "k", "v") == ids(lookup.looked_up(rows, table, "k", 0), "id", "k", "v") == want


# the queries
@pytest.fixture(scope="module")
def duck():
    from llm_oracle import connect

    return connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    from llm_oracle import same

    same(duck, queries.SQL[name], queries.QUERIES[name](spark, DATA))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
