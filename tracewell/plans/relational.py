"""Queries over filters, selectors, budgets, aggregates, joins, sets, training and the model boundary."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import classify, dist
from tracewell.functions.labels import label_key
from tracewell.operators import budget, compare, features, project, report, scorer, selectors, train
from tracewell.operators.records import finite_or_null
from tracewell.plans.common import c_sql, candidates, distributions, evals, gold_sql, key_sql, predicted_sql, samples
from tracewell.plans.scalar import _CUT, FEATURE_ROWS, _KEPT
from tracewell.session import table
from tracewell.sources import jsonl, sinks
from tracewell.streaming import ledger

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_KL = "distribution_features.kl_expert_amateur"
_NEED = ("distribution_features", "token_features", "step_features", "normalized_position", "contrastive_target", "fixed_kl_selected")


def _c(s: SparkSession, d: str) -> DataFrame:
    return candidates(s, d, *_NEED)


_E1 = "select eval_id, any_value(id) id, any_value(index) index, any_value(model) model, any_value(gold) gold, any_value(correct) correct, any_value(response) response, any_value(dataset) dataset, any_value(question) question from eval_outputs group by eval_id"


@query("FIL-01_unprocessed_prompts", "select distinct id as prompt_id from gsm8k_train where id not in (select prompt_id from checkpoint_ledger where prompt_id is not null)")
def fil01(s, d):
    p = table(s, d, "gsm8k_train").select(F.col("id").alias("prompt_id")).distinct()
    return compare.unprocessed(p, table(s, d, "checkpoint_ledger"), "prompt_id")


@query("FIL-02_kl_threshold", f"select candidate_id from ({c_sql(k=_KL)}) where not isnan(k) and k >= 0.4")
def fil02(s, d):
    return _c(s, d).where(selectors.reaches(F.col(_KL), 0.4)).select("candidate_id")


@query("FIL-03_correctness_gate", f"select model, count(*) as n, count(*) filter ({gold_sql('gold')} = {predicted_sql('response')}) as passed from ({_E1}) group by model")
def fil03(s, d):
    ok = F.coalesce(classify.gold_answer(F.col("gold")) == classify.predicted_answer(F.col("response")), F.lit(False))
    return evals(s, d).groupBy("model").agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"))


@query("FIL-04_degeneration_gate")
def fil04(s, d):
    g = evals(s, d).select(F.col("eval_id").alias("prompt_id"), "question", F.col("gold").alias("gold_text"), F.col("response").alias("generation"))
    accepted, rejected = ledger.gated(g, project.SYSTEM_PROMPT)
    return accepted.select("prompt_id", "rejection_reason").union(rejected.select("prompt_id", "rejection_reason"))


_EXCL = "coalesce(token_features.token_category, 'unknown') in ('punctuation', 'space') or coalesce(step_features.step_type, 'unknown') = 'verification' or coalesce(normalized_position, 0) < 0.33 or coalesce(distribution_features.entropy_gap, 0) >= 1.0"
_excl = partial(compare.excluded, categories=("punctuation", "space"), steps=("verification",), positions=("early",), confidence=("high_entropy_gap",))


@query("FIL-05_excluded_candidates", f"select candidate_id from ({c_sql(x=_EXCL)}) where x")
def fil05(s, d):
    return _c(s, d).where(_excl()).select("candidate_id")


@query("FIL-06_bucket_ablation", f"select candidate_id, round(k, 9) as kl, cast(len(t.token_ids) as bigint) as size from ({c_sql(x=_EXCL, k=_KL, t='contrastive_target')}) where not x and not isnan(k) and k >= 0.4 and len(t.token_ids) > 0")
def fil06(s, d):
    c = candidates(s, d, "question", "prompt_id", "step", "prefix", *_NEED).where(~_excl())
    c = c.where(selectors.FixedKL(0.4).decide(c)["selected"])
    return project.selected_sample(c, "fixed_kl", F.col(_KL), keep=("candidate_id",)).where(F.size("token_ids") > 0).select("candidate_id", F.round("kl_divergence", 9).alias("kl"), F.size("token_ids").cast("long").alias("size"))


def _runs(s: SparkSession, d: str, last: bool = True) -> dict[str, DataFrame]:
    """The outputs of the three models by key, the last of each key."""
    e = table(s, d, "eval_outputs")
    return {m: jsonl.outputs(e.where(F.col("model") == m), "eval_id") for m in ("base", "fixed_kl", "rule_v1")}


def _run_sql(m: str) -> str:
    return f"select coalesce(id, cast(index as varchar)) k, coalesce(arg_max(struct_pack(p := correct), eval_id).p, false) c from eval_outputs where model = '{m}' and coalesce(id, cast(index as varchar)) is not null group by 1"


_COMMON = f"with b as ({_run_sql('base')}), f as ({_run_sql('fixed_kl')}), r as ({_run_sql('rule_v1')}), j as (select b.k, b.c b, f.c f, r.c r from b join f using (k) join r using (k))"


@query("FIL-07_improved_cases", f"with b as ({_run_sql('base')}), f as ({_run_sql('fixed_kl')}) select f.k as \"key\" from f left join b using (k) where f.c and not coalesce(b.c, false)")
def fil07(s, d):
    r = _runs(s, d)
    return compare.improved_cases(r["base"], r["fixed_kl"], "key")


@query("FIL-08_slice", "select distinct id, question from gsm8k_test order by id limit 20 offset 10")
def fil08(s, d):
    return jsonl.first_rows(table(s, d, "gsm8k_test").dropDuplicates(["id"]), "id", 10, 20).select("id", "question")


@query("FIL-09_dropped_targets", f"select count(*) as rows, count(*) filter (coalesce(len({_KEPT}), 0) = 0) as dropped from ({c_sql(t='contrastive_target')})")
def fil09(s, d):
    z = dist.filtered_size(F.col("contrastive_target"), _CUT)
    return _c(s, d).agg(F.count("*").alias("rows"), F.count_if(z == 0).alias("dropped"))


@query("FIL-10_trainable_rows", f"select candidate_id from ({c_sql(t='contrastive_target', k=_KL)}) where len({_KEPT}) > 0 and not isnan(k) and k >= 0.4")
def fil10(s, d):
    c = _c(s, d)
    return c.where(selectors.FixedKL(0.4).decide(c)["selected"] & (dist.filtered_size(F.col("contrastive_target"), _CUT) > 0)).select("candidate_id")


def _rule_sql(r: selectors.Rule) -> str:
    """SQL of a rule's reason over category c, step t and struct d."""
    q = lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")"
    need = "case t " + " ".join(f"when '{k}' then {v}" for k, v in r.step_type_thresholds.items()) + f" else {r.step_type_thresholds['other']} end"
    good = lambda f, op, v: f"coalesce(not isnan(d.{f}) and d.{f} {op} {v}, false)"
    return f"""case when c in {q(r.denied_token_categories)} then 'denied_token_category:' || c when c not in {q(r.allowed_token_categories)} then 'token_category_not_allowed:' || c
      when not {good('expert_top1_prob', '>=', r.min_expert_confidence)} then 'expert_confidence_too_low' when not {good('expert_entropy', '<=', r.max_expert_entropy)} then 'expert_entropy_too_high'
      when not {good('entropy_gap', '>=', r.min_entropy_gap)} then 'entropy_gap_too_low' when not {good('kl_expert_amateur', '>=', need)} then 'kl_below_step_threshold:' || t else 'selected:' || t || ':' || c end"""


_DECIDE = c_sql(d="distribution_features", c="coalesce(token_features.token_category, 'other')", t="coalesce(step_features.step_type, 'other')", tg="contrastive_target", p="normalized_position", rc="token_features.token_category", rs="step_features.step_type")
_FIXED = "case when coalesce(not isnan(d.kl_expert_amateur) and d.kl_expert_amateur >= 0.4, false) then 'kl_above_beta' else 'kl_below_beta' end"


@query("FIL-11_selected_pairs", f"select candidate_id, reason from (select candidate_id, {_rule_sql(selectors.shipped('rule_balanced'))} reason from ({_DECIDE})) where reason like 'selected:%'")
def fil11(s, d):
    c = _c(s, d)
    return c.withColumn("decision", selectors.shipped("rule_balanced").decide(c)).where("decision.selected").select("candidate_id", "decision.reason")


@query("SEL-01_fixed_kl", f"select {_FIXED} as reason, count(*) as n from ({_DECIDE}) group by 1")
def sel01(s, d):
    c = _c(s, d)
    return report.reasons(c.withColumn("decision", selectors.FixedKL(0.4).decide(c)))


@query("SEL-02_rule", f"select candidate_id, {_rule_sql(selectors.Rule())} as reason from ({_DECIDE})")
def sel02(s, d):
    c = _c(s, d)
    return c.select("candidate_id", selectors.Rule().decide(c)["reason"].alias("reason"))


_OWN = {"min_expert_confidence": 0.2, "step_type_thresholds": {"setup": 0.1, "final_answer": 0.9}, "allowed_token_categories": ["number", "word"]}


@query("SEL-03_rule_from_config", f"select {_rule_sql(selectors.Rule.from_config(_OWN))} as reason, count(*) as n from ({_DECIDE}) group by 1")
def sel03(s, d):
    c = _c(s, d)
    return report.reasons(c.withColumn("decision", selectors.Rule.from_config(_OWN).decide(c)))


_ARTIFACT = {"feature_names": ["kl_expert_amateur", "entropy_gap", "token_category=number", "step_type=calculation", "unknown"], "weights": [0.8, 0.05, 0.7, 0.4, 9.0], "bias": -1.2, "threshold": 0.5, "standardization": {"means": [0.4, 0.3, 0.2, 0.3, 0.0], "scales": [0.5, 0.6, 0.4, 0.5, 1.0]}}
_LOGIT = "-1.2 + 0.8 * (coalesce(d.kl_expert_amateur, 0) - 0.4) / 0.5 + 0.05 * (coalesce(d.entropy_gap, 0) - 0.3) / 0.6 + 0.7 * ((c = 'number')::double - 0.2) / 0.4 + 0.4 * ((t = 'calculation')::double - 0.3) / 0.5"


@query("SEL-04_linear", f"select candidate_id, round(s, 6) as score, coalesce(not isnan(s) and s >= 0.5, false) as selected from (select candidate_id, case when z >= 0 then 1 / (1 + exp(-z)) else exp(z) / (1 + exp(z)) end s from (select candidate_id, {_LOGIT} z from ({_DECIDE}))) where not isnan(s)")
def sel04(s, d):
    c = _c(s, d)
    return c.withColumn("x", selectors.build_selector("learned", _ARTIFACT).decide(c)).where(~F.isnan("x.score")).select("candidate_id", F.round("x.score", 6).alias("score"), "x.selected")


@query("SEL-05_built_selector", f"select case when coalesce(not isnan(d.kl_expert_amateur) and d.kl_expert_amateur >= 0.9, false) then 'kl_above_beta' else 'kl_below_beta' end as reason, count(*) as n from ({_DECIDE}) group by 1")
def sel05(s, d):
    """The configuration's beta goes before the argument's."""
    c = _c(s, d)
    return report.reasons(c.withColumn("decision", selectors.build_selector("fixed_kl", {"beta": 0.9}, beta=0.1).decide(c)))


_SHIPPED = ("fixed_kl", "rule", "rule_balanced", "rule_focus")


def _decided(s: SparkSession, d: str) -> DataFrame:
    return selectors.with_decisions(_c(s, d), {n: selectors.shipped(n) for n in _SHIPPED})


_REASONS = {n: _FIXED if n == "fixed_kl" else _rule_sql(selectors.shipped(n)) for n in _SHIPPED}
_ALL = f"c0 as ({_DECIDE}), dec as (" + " union all ".join(f"select candidate_id, c, t, d, tg, rc, rs, '{n}' selector, {r} reason from c0" for n, r in _REASONS.items()) + "), dd as (select *, reason = 'kl_above_beta' or reason like 'selected:%' sel from dec)"


@query("SEL-06_shipped_configurations", f"with {_ALL} select selector, reason, count(*) as n from dd group by all")
def sel06(s, d):
    return _decided(s, d).groupBy("selector", F.col("decision.reason").alias("reason")).agg(F.count("*").alias("n"))


@query("SEL-07_many_selectors", f"with {_ALL} select candidate_id, selector, sel as selected from dd")
def sel07(s, d):
    return _decided(s, d).select("candidate_id", "selector", "decision.selected")


class _LongPrefix:
    """An own selector, as a user of the engine would plug one in."""

    name = "margin"

    def decide(self, df: DataFrame):
        m = df["distribution_features"]["expert_top2_margin"]
        ok = F.coalesce(~F.isnan(m) & (m >= 0.5), F.lit(False))
        return F.struct(ok.alias("selected"), m.alias("score"), F.when(ok, "wide").otherwise("narrow").alias("reason"))


@query("UDF-01_own_selector", f"select case when coalesce(not isnan(d.expert_top2_margin) and d.expert_top2_margin >= 0.5, false) then 'wide' else 'narrow' end as reason, count(*) as n from ({_DECIDE}) group by 1")
def udf01(s, d):
    c = _c(s, d)
    return report.reasons(c.withColumn("decision", _LongPrefix().decide(c)))


@query("UDF-02_record_transform", "select candidate_id, cast(len(contrastive_target.token_ids) as bigint) as n from (select candidate_id, any_value(contrastive_target) contrastive_target from candidate_records group by 1) where len(contrastive_target.token_ids) > 1")
def udf02(s, d):
    """A record transform applied as a DataFrame function that may drop records."""
    return _c(s, d).transform(lambda t: t.withColumn("n", F.size("contrastive_target.token_ids").cast("long")).where("n > 1").select("candidate_id", "n"))


_K0 = "case when k is null or isnan(k) then 0 else k end"


@query("TOP-01_top_percent", f"select candidate_id from (select candidate_id, row_number() over (order by {_K0} desc, candidate_id) rn, count(*) over () n from ({c_sql(k=_KL)})) where rn <= greatest(1, floor(n * 0.125))")
def top01(s, d):
    return budget.top_percent(_c(s, d).select("candidate_id", F.col(_KL).alias("k")), 12.5, "k", "candidate_id").select("candidate_id")


@query("TOP-02_max_samples", f"select candidate_id from ({c_sql(k=_KL)}) order by {_K0} desc, candidate_id limit 300")
def top02(s, d):
    return budget.max_samples(_c(s, d).select("candidate_id", F.col(_KL).alias("k")), 300, "k", "candidate_id").select("candidate_id")


@query("TOP-03_greedy_token_budget")
def top03(s, d):
    t = _c(s, d).select("candidate_id", F.col(_KL).alias("k"), F.size("contrastive_target.token_ids").alias("z"))
    return budget.greedy_budget(t, 1000, "z", "k", "candidate_id").select("candidate_id", "z")


@query("TOP-04_budgets_in_order")
def top04(s, d):
    t = _c(s, d).select("candidate_id", F.col(_KL).alias("k"), F.size("contrastive_target.token_ids").alias("z"))
    return budget.with_budgets(t, "k", "candidate_id", "z", 50.0, 500, 600).select("candidate_id", "z")


_TOP5 = "select {g}, {v} as v, count(*) n, min(candidate_id) f, row_number() over (partition by {g} order by count(*) desc, min(candidate_id)) rn from dd where sel and len(tg.token_ids) > 0 group by {g}, {v}"


@query("TOP-05_most_common_text", f"with {_ALL} select selector, string_agg(v || ':' || n, ', ' order by rn) as text from ({_TOP5.format(g='selector', v='c')}) where rn <= 5 group by selector")
def top05(s, d):
    t = _decided(s, d).where(F.col("decision.selected") & (F.size("contrastive_target.token_ids") > 0)).select("selector", F.coalesce("token_features.token_category", F.lit("other")).alias("c"), "candidate_id")
    return budget.common_text(t, ["selector"], "c", "candidate_id")


@query("TOP-06_most_common_order", f"select t as v, count(*) as n, cast(row_number() over (order by count(*) desc, min(candidate_id), t) as bigint) as rank from ({_DECIDE}) group by t")
def top06(s, d):
    t = _c(s, d).select(F.coalesce("step_features.step_type", F.lit("other")).alias("v"), "candidate_id")
    return budget.most_common(t, [], "v", "candidate_id").withColumn("rank", F.col("rank").cast("long"))


_KINDS = {"fixed_improves_over_base": "f and not b", "fixed_regresses_from_base": "b and not f", "rule_improves_over_base": "r and not b", "rule_regresses_from_base": "b and not r", "rule_correct_fixed_wrong": "r and not f", "fixed_correct_rule_wrong": "f and not r"}


@query("TOP-07_run_examples", _COMMON + " select category, k as \"key\", cast(rn as bigint) as rank from (select *, row_number() over (partition by category order by k) rn from (" + " union all ".join(f"select '{n}' category, k from j where {c}" for n, c in _KINDS.items()) + ")) where rn <= 5")
def top07(s, d):
    c = compare.common_runs(_runs(s, d), "key")
    return compare.run_examples(c, "key", "base", "fixed_kl", "rule_v1").select("category", "key", F.col("rank").cast("long").alias("rank"))


@query("TOP-08_prompt_limit", "select distinct id from math_train order by id limit 50")
def top08(s, d):
    return table(s, d, "math_train").select("id").distinct().orderBy("id").limit(50)


def _stat_sql(v: str) -> str:
    return f"count(v) as n, round(avg(v), 6) as mean, round(median(v), 6) as median, round(min(v), 6) + 0 as min, round(max(v), 6) as max from (select metric, case when isnan(v) then null else v end v from ({v})) group by metric"


def _rounded(df: DataFrame, *skip: str, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


_METRICS = ("kl_expert_amateur", "expert_entropy", "amateur_entropy", "entropy_gap")


@query("AGG-01_summaries", "select metric, " + _stat_sql(f"select unnest({list(_METRICS)}) metric, unnest([{', '.join('d.' + m for m in _METRICS)}]) v from ({_DECIDE})"))
def agg01(s, d):
    return _rounded(report.summary(_c(s, d), {m: F.col(f"distribution_features.{m}") for m in _METRICS}))


_MIXED = f"""c as ({c_sql(tc='token_features.token_category', st='step_features.step_type', np='normalized_position', f='fixed_kl_selected', m='distribution_features.top1_match', d='distribution_features')}),
  s as (select sample_id, any_value(selection_metadata) m, any_value(kl_divergence) k from selected_samples group by sample_id)"""
_COUNTED = """select unnest(['token_categories', 'step_types', 'prefix_position_buckets', 'fixed_kl_selected_flags', 'top1_match_flags', 'selected_by_rule']) as counter,
    unnest([coalesce(tc, 'None'), coalesce(st, 'None'), case when np is null then 'unknown' when np < 0.33 then 'early' when np < 0.66 then 'middle' else 'late' end, case when f then 'True' else 'False' end, case when m then 'True' else 'False' end, case when f then 'fixed_kl_selected' else 'fixed_kl_rejected' end]) as value from c
  union all select unnest(['token_categories', 'step_types', 'prefix_position_buckets', 'selector_names']), unnest([case when m is null then 'unknown' else coalesce(m.token_category, 'None') end, case when m is null then 'unknown' else coalesce(m.step_type, 'None') end, 'unknown', case when m is null then 'unknown' else coalesce(m.selector_name, 'None') end]) from s"""


@query("AGG-02_selection_report", f"with {_MIXED} select counter, value, count(*) as n from ({_COUNTED}) group by all")
def agg02(s, d):
    return report.selection_counters(candidates(s, d, *_NEED), samples(s, d))


@query("AGG-02_report_summaries", f"with {_MIXED} select metric, " + _stat_sql("select unnest(['kl', 'expert_entropy', 'amateur_entropy', 'entropy_gap']) metric, unnest([d.kl_expert_amateur, d.expert_entropy, d.amateur_entropy, d.entropy_gap]) v from c union all select 'kl', k from s"))
def agg02c(s, d):
    return _rounded(report.selection_summaries(candidates(s, d, *_NEED), samples(s, d)))


@query("AGG-02_mixed_totals", "with c as (select any_value(fixed_kl_selected) f from candidate_records group by candidate_id), s as (select count(distinct sample_id) n from selected_samples) select count(*) + any_value(s.n) as total_records, count(*) as candidate_records, any_value(s.n) as selected_sample_records, round(count(*) filter (f) / count(*), 9) as selection_rate from c, s")
def agg02b(s, d):
    return _rounded(report.mixed_totals(_c(s, d), samples(s, d)), digits=9)


@query("AGG-03_selection_summary", f"select count(*) as candidates_seen, count(*) filter (ok) as selected, round(count(*) filter (ok) / count(*), 9) as selection_rate, cast(coalesce(sum(len(tg.token_ids)) filter (ok), 0) as bigint) as target_tokens, round(avg(k) filter (ok), 9) as score_mean, round(median(k) filter (ok), 9) as score_median from (select *, d.kl_expert_amateur k, coalesce(not isnan(d.kl_expert_amateur) and d.kl_expert_amateur >= 0.4, false) ok from ({_DECIDE}))")
def agg03(s, d):
    c = _c(s, d)
    out = report.selection_summary(c.withColumn("decision", selectors.FixedKL(0.4).decide(c)), F.size("contrastive_target.token_ids"))
    return _rounded(out, digits=9).withColumn("target_tokens", F.col("target_tokens").cast("long"))


@query("AGG-03_reasons", f"select {_rule_sql(selectors.Rule())} as reason, count(*) as n from ({_DECIDE}) group by 1")
def agg03b(s, d):
    c = _c(s, d)
    return report.reasons(c.withColumn("decision", selectors.Rule().decide(c)))


def _main_sql(v: str) -> str:
    return f"(select selector, string_agg(v || ':' || n, ', ' order by rn) x from (select selector, coalesce({v}, 'None') v, count(*) n, row_number() over (partition by selector order by count(*) desc, min(candidate_id)) rn from y where ok group by selector, {v}) where rn <= 5 group by selector)"


_MILE = f"""with {_ALL}, z as (select *, len(list_filter(tg.token_ids, lambda x: x >= 0 and x < {_CUT})) n, case when isnan(d.kl_expert_amateur) then null else d.kl_expert_amateur end k from dd), y as (select *, coalesce(sel and n > 0, false) ok from z),
  b as (select selector, count(*) filter (ok) as samples, count(*) filter (sel) as samples_before_vocab_filter, count(*) filter (sel) - count(*) filter (ok) as samples_dropped_by_vocab_filter, cast(coalesce(sum(n) filter (ok), 0) as bigint) as target_tokens, round(count(*) filter (ok) / count(*), 9) as selection_rate, round(coalesce(avg(k) filter (ok), 0), 6) as kl_mean, round(coalesce(median(k) filter (ok), 0), 6) as kl_median from y group by selector)
  select b.*, coalesce(a.x, '') as main_token_types, coalesce(e.x, '') as main_step_types from b left join {_main_sql('rc')} a on a.selector = b.selector left join {_main_sql('rs')} e on e.selector = b.selector"""


@query("AGG-04_milestone_table", _MILE)
def agg04(s, d):
    m = report.milestone(_decided(s, d), _CUT, "candidate_id")
    return m.select("selector", "samples", "samples_before_vocab_filter", "samples_dropped_by_vocab_filter", F.col("target_tokens").cast("long").alias("target_tokens"), F.round("selection_rate", 9).alias("selection_rate"), F.round("kl_mean", 6).alias("kl_mean"), F.round("kl_median", 6).alias("kl_median"), "main_token_types", "main_step_types")


@query("SNK-06_markdown_table", f"select selector, '| ' || selector || ' | ' || samples || ' | ' || target_tokens || ' | ' || printf('%.2f', selection_rate * 100) || '% | ' || printf('%.4f', kl_mean) || ' | ' || printf('%.4f', kl_median) || ' | ' || main_token_types || ' | ' || main_step_types || ' |' as line from ({_MILE})")
def snk06(s, d):
    """The lines of the written markdown file."""
    from tracewell.plans.common import scratch

    path = scratch(s, "snk06")
    sinks.markdown_rows(report.milestone(_decided(s, d), _CUT, "candidate_id")).write.json(path)
    return s.read.schema("selector string, line string").json(path)


@query("SNK-05_report_json", "select count(*) as total, count(*) filter (correct) as correct from (" + _E1 + ")")
def snk05(s, d):
    """The report as it is written to JSON and read back."""
    from tracewell.plans.common import scratch

    path = scratch(s, "snk05")
    report.accuracy(evals(s, d), []).select("total", "correct").coalesce(1).write.json(path)
    return s.read.schema("total long, correct long").json(path)


_CASES = f"with b as ({_run_sql('base')}), f as ({_run_sql('fixed_kl')}), k as (select 'base: ' || coalesce('{{\"correct\":' || b.c || '}}', 'null') || chr(10) || 'tuned: {{\"correct\":' || f.c || '}}' || chr(10) || repeat('=', 40) as block from f left join b using (k) where f.c and not coalesce(b.c, false))"


@query("SNK-07_case_report", f"{_CASES} select line, count(*) as n from (select unnest(string_split(block, chr(10))) line from k) group by line")
def snk07(s, d):
    """The lines of the written text file: the improved cases, also those without a base record."""
    from tracewell.plans.common import scratch

    r, path = _runs(s, d), scratch(s, "snk07")
    one = lambda n: r[n].select("key", F.struct(F.coalesce("correct", F.lit(False)).alias("correct")).alias("base" if n == "base" else "tuned"))
    cases = compare.improved_cases(r["base"], r["fixed_kl"], "key")
    sinks.case_report(cases.join(one("fixed_kl"), "key").join(one("base"), "key", "left"), "key").select("block").write.text(path)
    return s.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("SNK-08_fan_out", f"with {_ALL} select selector, count(*) as n from dd where sel group by selector")
def snk08(s, d):
    from tracewell.plans.common import scratch

    path = scratch(s, "snk08")
    sinks.fan_out(_decided(s, d).where("decision.selected").select("selector", "candidate_id"), path)
    return s.read.schema("candidate_id long, selector string").json(path).groupBy("selector").agg(F.count("*").alias("n"))


@query("AGG-05_sample_summary", """with s as (select any_value(prompt_id) p, any_value(kl_divergence) k, any_value(token_ids) t from selected_samples group by sample_id), v as (select p, case when isnan(k) then null else k end k, len(t) z from s)
  select count(*) as records, count(distinct p) as prompts, round(count(p) / count(distinct p), 6) as records_per_prompt_mean, round(avg(k), 6) as kl_mean, round(median(k), 6) as kl_median, round(min(k), 6) + 0 as kl_min, round(max(k), 6) as kl_max, cast(sum(z) as bigint) as target_tokens_total, round(avg(z), 6) as target_tokens_mean from v""")
def agg05(s, d):
    return _rounded(report.sample_summary(samples(s, d))).withColumn("target_tokens_total", F.col("target_tokens_total").cast("long"))


@query("AGG-06_supporting_statistics", f"""select count(*) as total, round(count(*) filter (m) * 100.0 / count(*), 6) as match_pct, round(avg(k) filter (m), 6) as match_kl, round(count(*) filter (not m) * 100.0 / count(*), 6) as mismatch_pct, round(avg(k) filter (not m), 6) as mismatch_kl, count(*) filter (c) as confidence_mismatch, round(avg(k) filter (c), 6) as confidence_mismatch_kl, count(*) filter (k > 1) as high_kl, round(count(*) filter (k > 1) * 100.0 / count(*), 6) as high_kl_pct from (
  select case when isnan(d.kl_expert_amateur) then null else d.kl_expert_amateur end k, d.expert_top1_id is not distinct from d.amateur_top1_id m, coalesce(not isnan(d.expert_entropy) and d.expert_entropy < 1 and not isnan(d.amateur_entropy) and d.amateur_entropy > 3, false) c from ({_DECIDE}))""")
def agg06(s, d):
    f = F.col("distribution_features")
    log = _c(s, d).select(f["kl_expert_amateur"].alias("kl_divergence"), f["expert_entropy"].alias("expert_entropy"), f["amateur_entropy"].alias("amateur_entropy"), f["expert_top1_id"].alias("expert_top1_token"), f["amateur_top1_id"].alias("amateur_top1_token"))
    return _rounded(report.supporting_statistics(log))


@query("AGG-07_kl_histogram", f"with b as (select cast(case when isnan(k) or k >= 5 then 50 else floor(k / 0.1::double) end as bigint) b, count(*) n from ({c_sql(k=_KL)}) where k is not null group by 1), a as (select coalesce(b, r) bin, coalesce(n, 0) n from b full join (select unnest(range(51)) r) on b = r) select bin, cast(n as bigint) as n, round(n * 100.0 / sum(n) over (), 6) as pct from a")
def agg07(s, d):
    return _rounded(report.histogram(_c(s, d).select(F.col(_KL).alias("k")), "k"))


@query("AGG-08_accuracy", f"select model, dataset, count(*) as total, count(*) filter (coalesce(correct, false)) as correct, round(avg(coalesce(correct, false)::double), 9) as accuracy from ({_E1}) group by model, dataset")
def agg08(s, d):
    return _rounded(report.accuracy(evals(s, d), ["model", "dataset"]), digits=9)


@query("AGG-09_moments", f"select metric as feature, round(avg(v), 5) as mean, round(case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end, 5) as scale from (select unnest({list(_METRICS)}) metric, unnest([{', '.join('d.' + m for m in _METRICS)}]) v from ({_DECIDE})) where not isnan(v) group by metric")
def agg09(s, d):
    return _rounded(report.moments(_c(s, d).select("distribution_features.*"), list(_METRICS)), digits=5)


@query("AGG-10_run_counters", "select count(*) as processed, count(*) filter (accepted) as accepted, count(*) filter (rejection_reason is not distinct from 'incorrect') as rejected_incorrect, count(*) filter (rejection_reason is not distinct from 'degenerate') as rejected_degenerate, cast(coalesce(sum(num_candidates), 0) as bigint) as candidates_written from checkpoint_ledger")
def agg10(s, d):
    return report.run_counters(table(s, d, "checkpoint_ledger")).withColumn("candidates_written", F.col("candidates_written").cast("long"))


@query("AGG-11_ablation_counters", f"select count(*) as seen, count(*) filter (x) as excluded, count(*) filter (not x and not isnan(k) and k >= 0.4) as selected from ({c_sql(x=_EXCL, k=_KL)})")
def agg11(s, d):
    x = _excl()
    return _c(s, d).agg(F.count("*").alias("seen"), F.count_if(x).alias("excluded"), F.count_if(~x & selectors.reaches(F.col(_KL), 0.4)).alias("selected"))


@query("AGG-12_repeated_lines", "with l as (select eval_id, trim(lower(unnest(string_split(r, chr(10))))) line from (select eval_id, any_value(response) r from eval_outputs group by 1)) select eval_id, line, count(*) as n from l where length(line) >= 24 group by all having count(*) >= 3")
def agg12(s, d):
    t = evals(s, d).select("eval_id", F.explode(F.split("response", "\n")).alias("l")).select("eval_id", F.trim(F.lower("l")).alias("line")).where(F.length("line") >= 24)
    return t.groupBy("eval_id", "line").agg(F.count("*").alias("n")).where("n >= 3")


@query("JN-01_left_outer_base", f"with b as ({_run_sql('base')}), f as ({_run_sql('fixed_kl')}) select f.k as \"key\", f.c as tuned, coalesce(b.c, false) as base from f left join b using (k)")
def jn01(s, d):
    r = _runs(s, d)
    b = r["base"].select("key", F.coalesce("correct", F.lit(False)).alias("base"))
    return r["fixed_kl"].select("key", F.coalesce("correct", F.lit(False)).alias("tuned")).join(b, "key", "left").fillna(False, ["base"])


@query("JN-02_three_runs", _COMMON + " select k as \"key\", b as base, f as fixed_kl, r as rule_v1 from j")
def jn02(s, d):
    return compare.common_runs(_runs(s, d), "key")


@query("JN-03_anti_join", "select distinct id as prompt_id from math_train where id not in (select prompt_id from checkpoint_ledger where prompt_id is not null)")
def jn03(s, d):
    p = table(s, d, "math_train").select(F.col("id").alias("prompt_id")).distinct()
    return compare.unprocessed(p, table(s, d, "checkpoint_ledger"), "prompt_id")


@query("JN-04_aligned_steps", "select a.vec_id, a.vec_id + 1 as step, round(a.e::double - b.e::double, 6) as gap from (select vec_id, embedding[1] e from embeddings) a join (select vec_id, embedding[1] e from embeddings) b on a.vec_id = b.vec_id")
def jn04(s, d):
    """Expert rows at step t meet the amateur's position t - 1 of one sequence."""
    v = table(s, d, "embeddings")
    e = v.select(F.lit("q").alias("prompt_id"), (F.col("vec_id") + 1).alias("step"), F.col("embedding").alias("expert"))
    a = v.select(F.lit("q").alias("prompt_id"), F.col("vec_id").alias("position"), F.col("embedding").alias("probabilities"))
    return compare.aligned(e, a).select((F.col("step") - 1).alias("vec_id"), "step", F.round(F.col("expert")[0].cast("double") - F.col("amateur")[0].cast("double"), 6).alias("gap"))


def _vocabularies(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two vocabularies: part names by id, and the same with the names of every 97th id changed."""
    a = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("token"))
    return a, a.select("id", F.when(F.col("id") % 97 == 5, F.concat("token", F.lit("~"))).otherwise(F.col("token")).alias("token"))


_VOC = "a as (select p_partkey id, p_name || ' ' || p_partkey token from part), b as (select id, case when id % 97 = 5 then token || '~' else token end token from a)"


@query("JN-05_vocabulary_audit", f"with {_VOC}, j as (select a.id, a.token ta, b.token tb, a.token is not distinct from b.token same from a full join b on a.id = b.id) select count(ta) as size_a, count(tb) as size_b, count(*) filter (not same and id < 100) = 0 as prefix_equal, count(*) filter (not same) = 0 and count(ta) = count(tb) as fully_equal, count(*) filter (not same) as differences, min(id) filter (not same) as first_difference, (select string_agg(id || ': ' || coalesce(ta, '') || ' | ' || coalesce(tb, ''), '; ' order by id) from (select * from j where not same order by id limit 5)) as samples from j")
def jn05(s, d):
    return compare.vocabulary_audit(*_vocabularies(s, d), 100)


QUERIES["VAL-06_vocabulary_alignment"] = QUERIES["JN-05_vocabulary_audit"]
SQL["VAL-06_vocabulary_alignment"] = SQL["JN-05_vocabulary_audit"]


@query("JN-06_shared_vocabulary", f"with {_VOC} select a.token, a.id as id_a, b.id as id_b from a join b on a.token = b.token")
def jn06(s, d):
    return compare.shared_vocabulary(*_vocabularies(s, d))


_LEVELS = ("algebra", "geometry", "number_theory", "prealgebra", "precalculus", "intermediate_algebra", "counting_and_probability")


@query("SET-01_union_of_subjects", "select problem as id, problem, solution, n as level from math_train, (select unnest(" + str(list(_LEVELS)) + f") n) where {key_sql('level')} = {key_sql('n')}")
def set01(s, d):
    t = table(s, d, "math_train")
    return project.union_subjects({n: t.where(label_key("level") == n.replace("_", "")) for n in _LEVELS})


@query("SET-02_sample_overlap", "with k as (select prompt_id, step, prefix, bool_or(run_id = (select min(run_id) from selected_samples)) a, bool_or(run_id <> (select min(run_id) from selected_samples)) b from selected_samples group by all) select count(*) filter (a and b) as matching, count(*) filter (a and not b) as original_only, count(*) filter (b and not a) as selected_only, round(count(*) filter (a and b) / count(*) filter (a), 9) as original_overlap_rate, round(count(*) filter (a and b) / count(*) filter (b), 9) as selected_overlap_rate from k")
def set02(s, d):
    t = table(s, d, "selected_samples")
    first = t.agg(F.min("run_id").alias("r")).first()["r"]
    return _rounded(compare.overlap_of_keys(t.where(F.col("run_id") == first), t.where(F.col("run_id") != first), ["prompt_id", "step", "prefix"]), digits=9)


@query("SET-03_run_overlap", _COMMON + " select count(*) as total_common, round(avg(b::double), 9) as accuracy_base, round(avg(f::double), 9) as accuracy_fixed_kl, round(avg(r::double), 9) as accuracy_rule_v1, count(*) filter (b and f and r) as all_correct, count(*) filter (not (b or f or r)) as all_wrong, " + ", ".join(f"count(*) filter ({c}) as {n}" for n, c in _KINDS.items()) + " from j")
def set03(s, d):
    return _rounded(compare.run_overlap(compare.common_runs(_runs(s, d), "key"), "base", "fixed_kl", "rule_v1"), digits=9)


@query("SET-04_vocabulary_difference", f"with {_VOC} select token from b where token not in (select token from a) order by token limit 5")
def set04(s, d):
    a, b = _vocabularies(s, d)
    return compare.vocabulary_difference(b, a)


@query("SET-05_bucket_overlap", f"select candidate_id from ({_DECIDE}) where coalesce(d.entropy_gap, 0) >= 1 or not coalesce(d.top1_match, false)")
def set05(s, d):
    return _c(s, d).where(compare.excluded(confidence=("high_entropy_gap", "top1_mismatch"))).select("candidate_id")


@query("ML-01_weak_labels", f"select candidate_id, (r like 'selected:%')::int as by_rule, coalesce(not isnan(k) and k >= 0.4, false)::int as by_kl, coalesce(f, false)::int as by_flag from (select x.candidate_id, {_rule_sql(selectors.Rule())} r, d.kl_expert_amateur k, y.f from ({_DECIDE}) x join (select candidate_id, any_value(fixed_kl_selected) f from candidate_records group by 1) y using (candidate_id))")
def ml01(s, d):
    c = _c(s, d)
    return c.select("candidate_id", train.weak_label(c, "rule").alias("by_rule"), train.weak_label(c, "fixed_kl").alias("by_kl"), train.weak_label(c, "candidate_fixed_kl_flag").alias("by_flag"))


@query("ML-02_trained_selector")
def ml02(s, d):
    c = _c(s, d)
    return report.reasons(c.withColumn("decision", selectors.Linear.from_artifact(train.train_linear(c, "rule")).decide(c)))


@query("ML-02_distributed_selector")
def ml02b(s, d):
    c = _c(s, d)
    return report.reasons(c.withColumn("decision", selectors.Linear.from_artifact(train.train_distributed(c, "rule")).decide(c)))


@query("ML-03_standardised_vectors", f"with f as (select candidate_id, case when isnan(v) then 0 else v end v, i from (select candidate_id, unnest(f) v, unnest(range(33)) i from ({FEATURE_ROWS})) where i in (12, 13, 17, 25)), m as (select i, avg(v) a, case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end s from f group by i) select candidate_id, cast(f.i as bigint) as i, round((v - a) / s, 6) as v from f join m on f.i = m.i")
def ml03(s, d):
    """The four positions of the whole vectors that the SQL checks."""
    return ml03_all(s, d).where(F.col("i").isin(12, 13, 17, 25))


@query("ML-03_all_standardised_vectors")
def ml03_all(s, d):
    """All 33 positions, with the moments of the whole table; NaN counts as zero, as in training."""
    x = train.features_and_labels(_c(s, d), "rule", 0.4, "candidate_id").select("candidate_id", "x")
    at = range(len(features.FEATURE_NAMES))
    m = x.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in at], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in at]).first()
    if m["m0"] is None:
        return x.select("candidate_id", F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("v")).limit(0)
    z = features.standardized(F.col("x"), [m[f"m{i}"] for i in at], [m[f"s{i}"] or 1.0 for i in at])
    return x.select("candidate_id", F.posexplode(z).alias("i", "v")).select("candidate_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query("MDL-01_greedy_generation")
def mdl01(s, d):
    p = table(s, d, "gsm8k_test").dropDuplicates(["id"]).select(F.col("id").alias("prompt_id"), "question")
    return scorer.greedy_generation(p, partial(scorer.hashed_scorer, 16, "expert"), 4).select("prompt_id", "step", "token_id")


@query("MDL-02_prefix_distributions")
def mdl02(s, d):
    c = candidates(s, d, "prefix")
    t = scorer.scored(c, partial(scorer.hashed_scorer, 16, "amateur"))
    return t.select("candidate_id", F.round(dist.entropy(F.col("probabilities")), 9).alias("entropy"))


@query("MDL-03_evaluation_generation")
def mdl03(s, d):
    p = table(s, d, "math_test").dropDuplicates(["id"]).select(F.col("id").alias("prompt_id"), project.plain_prompt(F.col("problem")).alias("question"))
    t = scorer.greedy_generation(p, partial(scorer.hashed_scorer, 16, "eval"), 3)
    return t.groupBy("prompt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "token_id"))), lambda x: x["token_id"].cast("string")), " ").alias("response"))


@query("MDL-02_precomputed_distributions", "select vec_id, round(list_max(embedding)::double, 6) as top from embeddings")
def mdl02b(s, d):
    v = table(s, d, "embeddings")
    known = v.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("probabilities"))
    return scorer.precomputed(v.select("vec_id"), known, ["vec_id"]).select("vec_id", F.round(F.array_max("probabilities"), 6).alias("top"))


@query("MDL-04_checkpoint_perplexity", f"select run_id, count(p) as tokens, round(exp(sum(-ln(p)) / count(p)), 6) as ppl from ({c_sql(run_id='run_id', p='distribution_features.target_expert_prob')}) where p > 0 and not isnan(p) group by run_id")
def mdl04(s, d):
    """Perplexity of each run's model on its logged target tokens; training and merging adapters is model work."""
    p = F.col("distribution_features.target_expert_prob")
    t = candidates(s, d, "run_id", "distribution_features").where(~F.isnan(p) & (p > 0))
    return t.groupBy("run_id").agg(F.count(p).alias("tokens"), F.round(F.exp(F.sum(-F.log(p)) / F.count(p)), 6).alias("ppl"))


@query("MDL-05_two_model_trace")
def mdl05(s, d):
    t = table(s, d, "gsm8k_test").dropDuplicates(["id"]).select("id", F.col("question").alias("prefix"))
    t = scorer.scored(t, partial(scorer.hashed_scorer, 16, "expert"), output="e")
    t = scorer.scored(t, partial(scorer.hashed_scorer, 16, "amateur"), output="a")
    return t.select("id", F.round(dist.kl(F.col("e"), F.col("a")), 9).alias("kl"))


@query("STR-01_windowed_counts", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events where ts is not null group by all")
def str01(s, d):
    return ledger.windowed_counts(table(s, d, "events"), "ts", "1 hour", "2 hours", ["event_type"])
