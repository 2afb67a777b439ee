"""Queries of the training-data problems and the SQL they can be checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import capping, cutoff, mixing, overlap, percentiles, splits, subjects, target_sample, tokens, truncation
from tracewell.session import table


def _samples(s: SparkSession, d: str) -> DataFrame:
    problems = table(s, d, "gsm8k_train").select("id", "question").union(table(s, d, "math_train").select("id", F.col("problem")))
    return capping.samples_with_prompt(table(s, d, "selected_samples"), table(s, d, "candidate_records"), problems)


CAP = 16


def p1_found(s: SparkSession, d: str) -> DataFrame:
    """Samples beyond the first 16 of their prompt in a run."""
    rows = _samples(s, d)
    return capping.beyond_cap(rows, capping.cap_contributors(rows, "sample_id", ["run_id", "prompt"], "kl_divergence", CAP), "sample_id").select("sample_id")


def p1_kept_by_step(s: SparkSession, d: str) -> DataFrame:
    """Samples kept when each prompt's 16 slots are split over its step types."""
    rows = _samples(s, d)
    return capping.cap_contributors(rows, "sample_id", ["run_id", "prompt"], "kl_divergence", CAP, "step_type")


def p1_report(s: SparkSession, d: str) -> DataFrame:
    """Rows, kept and dropped per run and prompt."""
    rows = _samples(s, d)
    kept = capping.cap_contributors(rows, "sample_id", ["run_id", "prompt"], "kl_divergence", CAP)
    return capping.cap_report(rows, kept, "sample_id", ["run_id", "prompt"])


def _problems(s: SparkSession, d: str) -> DataFrame:
    out = None
    for name, text in (("gsm8k_test", "question"), ("math_test", "problem"), ("gsm8k_train", "question"), ("math_train", "problem")):
        one = table(s, d, name).select(F.lit("eval" if name.endswith("test") else "train").alias("side"), "id", F.lit(name.partition("_")[0]).alias("source"), F.col(text).alias("text"))
        out = one if out is None else out.union(one)
    return out


def p2_found(s: SparkSession, d: str) -> DataFrame:
    """Test and train records that are the same problem."""
    return overlap.overlapping_pairs(_problems(s, d))


def p2_report(s: SparkSession, d: str) -> DataFrame:
    """Overlaps per data set of the test and the train side."""
    return overlap.overlap_report(overlap.overlapping_records(_problems(s, d)))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    """Responses and predictions that were cut."""
    return truncation.cut_values(table(s, d, "eval_outputs")).select("eval_id", "field")


def p3_lengths(s: SparkSession, d: str) -> DataFrame:
    """Lengths at which a writer's values end significantly often."""
    return truncation.significant_lengths(truncation.measured(table(s, d, "eval_outputs"))).select("writer", "field", "unit", "length", "n", "risk")


def p3_report(s: SparkSession, d: str) -> DataFrame:
    """Rate of cut values per writer and field."""
    return truncation.truncation_report(table(s, d, "eval_outputs"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    """Target cells of which the sample drawn can't hold enough."""
    rows, targets = target_sample.candidate_cells(table(s, d, "candidate_records"), table(s, d, "category_targets"))
    report = target_sample.cell_report(targets)
    return target_sample.unmet_cells(target_sample.draw_sample(rows, report), report).select("token_category", "step_type")


def p4_sample(s: SparkSession, d: str) -> DataFrame:
    """The sample drawn."""
    rows, targets = target_sample.candidate_cells(table(s, d, "candidate_records"), table(s, d, "category_targets"))
    return target_sample.draw_sample(rows, target_sample.cell_report(targets))


def p4_report(s: SparkSession, d: str) -> DataFrame:
    """Shares wanted and reached per cell."""
    rows, targets = target_sample.candidate_cells(table(s, d, "candidate_records"), table(s, d, "category_targets"))
    report = target_sample.cell_report(targets)
    return target_sample.sample_report(target_sample.draw_sample(rows, report), report)


def p5_found(s: SparkSession, d: str) -> DataFrame:
    """Pairs of prompt ids that denote the same prompt."""
    return splits.same_prompt_pairs(table(s, d, "candidate_records"))


def p5_assigned(s: SparkSession, d: str) -> DataFrame:
    """The split of every candidate."""
    return splits.assign_splits(table(s, d, "candidate_records"), table(s, d, "split_targets")).select("candidate_id", "split")


def p5_report(s: SparkSession, d: str) -> DataFrame:
    """Shares of the splits, wanted and reached."""
    t = table(s, d, "split_targets")
    return splits.split_report(splits.assign_splits(table(s, d, "candidate_records"), t), t)


def _scored(s: SparkSession, d: str) -> DataFrame:
    return cutoff.scored_candidates(table(s, d, "candidate_records"), table(s, d, "keep_targets"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    """Candidates at or above the cutoff of their step type."""
    return cutoff.kept_candidates(_scored(s, d))


def p6_cutoffs(s: SparkSession, d: str) -> DataFrame:
    """The cutoffs and the kept sizes."""
    return cutoff.cutoffs(_scored(s, d))


def p7_percentiles(s: SparkSession, d: str) -> DataFrame:
    """Percentiles per token category and metric over all days."""
    return percentiles.percentiles(percentiles.daily_counts(table(s, d, "candidate_records"))).withColumn("value", F.round("value", 9))


def p7_daily(s: SparkSession, d: str) -> DataFrame:
    """The same of single days."""
    return percentiles.percentiles(percentiles.daily_counts(table(s, d, "candidate_records")), ("day", "token_category", "metric")).withColumn("value", F.round("value", 9))


def p8_ids(s: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encoded(table(s, d, "documents"))


def _mix(s: SparkSession, d: str) -> tuple[DataFrame, dict]:
    targets = table(s, d, "mix_targets")
    sized = mixing.source_sizes(table(s, d, "documents"), targets)
    return sized, mixing.plan_for(sized, targets)


def p9_found(s: SparkSession, d: str) -> DataFrame:
    """Sources too small for their weight."""
    _, plan = _mix(s, d)
    return s.createDataFrame([(k,) for k, p in plan.items() if p["short"]], "source string")


def p9_mix(s: SparkSession, d: str) -> DataFrame:
    """The mixture: documents and their repeats."""
    return mixing.mixed(*_mix(s, d))


def p9_report(s: SparkSession, d: str) -> DataFrame:
    """Shares reached per source."""
    sized, plan = _mix(s, d)
    return mixing.mix_report(mixing.mixed(sized, plan), plan)


def p10_found(s: SparkSession, d: str) -> DataFrame:
    """The subjects of each document."""
    return subjects.document_subjects(table(s, d, "documents"), table(s, d, "subject_examples"))


def p10_report(s: SparkSession, d: str) -> DataFrame:
    """Documents per subject."""
    docs = table(s, d, "documents")
    return subjects.subject_report(docs, subjects.document_subjects(docs, table(s, d, "subject_examples")))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "p" and k[1].isdigit()}

_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_CELL = "select candidate_id, any_value(" + _KEY.format("token_features.token_category") + ") a, any_value(" + _KEY.format("step_features.step_type") + ") b from candidate_records group by candidate_id"
_REPORT = f"""with c as ({_CELL}), s as (select floor(count(*) / 8) s from c),
  h as (select a, b, count(*) n from c group by a, b)
  select t.token_category, t.step_type, t.target_share, t.min_rows,
    cast(greatest(t.min_rows, ceil(t.target_share * s.s)) as bigint) wanted, cast(coalesce(h.n, 0) as bigint) available
  from category_targets t cross join s left join h on h.a = {_KEY.format("t.token_category")} and h.b = {_KEY.format("t.step_type")}"""
_SCORED = f"""select t.step_type, t.keep_fraction, candidate_id, kl from (
    select candidate_id, any_value({_KEY.format("step_features.step_type")}) k, any_value(distribution_features.kl_expert_amateur) kl from candidate_records group by candidate_id) c
  join keep_targets t on c.k = {_KEY.format("t.step_type")} where kl is not null and not isnan(kl)"""
_CUTS = f"""with s as ({_SCORED}), m as (select step_type, count(*) m, cast(ceil(any_value(keep_fraction) * count(*)) as bigint) k from s group by step_type),
  r as (select *, row_number() over (partition by step_type order by kl desc, candidate_id) rn from s),
  x as (select m.step_type, m.m, m.k as target, r.kl cutoff from r join m on m.step_type = r.step_type and r.rn = m.k)"""


def _categories() -> str:
    from tracewell.operators.features import TOKEN_CATEGORIES

    whens = " ".join(f"when '{n.replace('_', '')}' then '{n}'" for n in TOKEN_CATEGORIES)
    return f"case {_KEY.format('c')} {whens} else trim(c) end"


def _percentile_sql(day: bool) -> str:
    g = ("day, " if day else "") + "token_category, metric"
    return f"""with r as (select candidate_id, any_value(cast(logged_at as date)) "day", any_value(token_features.token_category) c, any_value(distribution_features) d from candidate_records group by candidate_id),
      l as (select "day", {_categories()} token_category, unnest(['kl_expert_amateur', 'expert_entropy', 'entropy_gap']) metric, unnest([d.kl_expert_amateur, d.expert_entropy, d.entropy_gap]) v from r),
      f as (select * from l where v is not null and not isnan(v)),
      q as (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::double q),
      o as (select {g}, v, row_number() over (partition by {g} order by v) - 1 i, count(*) over (partition by {g}) n from f),
      h as (select distinct {g}, n, q, (n - 1) * q h from o, q)
    select {', '.join('h.' + x for x in g.split(', '))}, h.q, cast(h.n as bigint) "rows", round(a.v + (b.v - a.v) * (h.h - floor(h.h)), 9) "value"
    from h join o a on {' and '.join(f'a.{x} is not distinct from h.{x}' for x in g.split(', '))} and a.i = floor(h.h)
    join o b on {' and '.join(f'b.{x} is not distinct from h.{x}' for x in g.split(', '))} and b.i = ceil(h.h)"""


SQL = {
    "p4_found": f"select token_category, step_type from ({_REPORT}) where available < wanted",
    "p6_found": _CUTS + " select s.candidate_id from s join x on x.step_type = s.step_type and s.kl >= x.cutoff",
    "p6_cutoffs": _CUTS + " select x.step_type, cast(x.m as bigint) m, x.target, x.cutoff, cast((select count(*) from s where s.step_type = x.step_type and s.kl >= x.cutoff) as bigint) kept from x",
    "p7_percentiles": _percentile_sql(False),
    "p7_daily": _percentile_sql(True),
}
