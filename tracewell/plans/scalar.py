"""Queries over sources, contracts, projections, arrays and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import classify, dist
from tracewell.functions.labels import label_key
from tracewell.operators import compare, contracts, features, project
from tracewell.operators.records import finite_or_null
from tracewell.plans.common import DIST, c_sql, candidates, cut_amateur, distributions, evals, gold_sql, key_sql, norm_sql, predicted_sql, samples, scratch, step_sql, strip_sql, token_sql
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


def _round_trip(s: SparkSession, df: DataFrame, name: str, mode: str = "strict") -> DataFrame:
    path = scratch(s, name)
    sinks.write_jsonl(df, path)
    return jsonl.read_jsonl(s, path, df.schema, mode)


@query("SRC-01_read_jsonl", "select id, question, answer from gsm8k_train")
def src01(s, d):
    return _round_trip(s, table(s, d, "gsm8k_train").select("id", "question", "answer"), "src01").drop("ord")


@query("SRC-02_load_jsonl_skipping_broken_lines", "select id, question, answer from gsm8k_test")
def src02(s, d):
    path = scratch(s, "src02")
    t = table(s, d, "gsm8k_test").select("id", "question", "answer")
    good = t.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    bad = s.createDataFrame([('{"id": ',), ("   ",), ("[1]",), ('[{"id": "a"}, {"id": "b"}]',)], "value string")
    good.union(bad).write.text(path)
    return jsonl.read_jsonl(s, path, t.schema, "drop").drop("ord")


@query("SRC-03_load_prompts", "select distinct coalesce(nullif(id, ''), question) as id, question from gsm8k_train where question is not null")
def src03(s, d):
    t = table(s, d, "gsm8k_train").where("question is not null").dropDuplicates(["id"])
    return jsonl.prompts(t, order="id")


@query("SRC-04_legacy_prompt_slice", "select distinct id, question from gsm8k_test order by id limit 25")
def src04(s, d):
    return jsonl.first_rows(table(s, d, "gsm8k_test").dropDuplicates(["id"]), "id", 0, 25).select("id", "question")


@query("SRC-05_processed_ids", "select distinct prompt_id from checkpoint_ledger where prompt_id is not null")
def src05(s, d):
    return jsonl.processed_ids(table(s, d, "checkpoint_ledger"))


@query("SRC-06_outputs_last_wins", "select coalesce(id, cast(index as varchar)) as \"key\", arg_max(struct_pack(p := prediction), eval_id).p as prediction, arg_max(struct_pack(p := gold), eval_id).p as gold, arg_max(struct_pack(p := correct), eval_id).p as correct from eval_outputs where coalesce(id, cast(index as varchar)) is not null group by 1")
def src06(s, d):
    return jsonl.outputs(table(s, d, "eval_outputs"), "eval_id")


@query("SRC-07_report_by_index", "select index, arg_max(struct_pack(p := correct), eval_id).p as correct from eval_outputs where index is not null group by 1")
def src07(s, d):
    from tracewell.operators.compare import last_per_key

    return last_per_key(table(s, d, "eval_outputs"), "index", "eval_id", ["correct"])


@query("SRC-08_perplexity_samples", f"select distinct id, {strip_sql('question')} as question, {strip_sql('''ltrim(''' + strip_sql('''list_extract(string_split(answer, '####'), -1)''') + ''', '$')''')} as gold from gsm8k_test")
def src08(s, d):
    return table(s, d, "gsm8k_test").dropDuplicates(["id"]).select("id", classify.strip(F.col("question")).alias("question"), classify.perplexity_gold(F.col("answer")).alias("gold"))


_KL = "distribution_features.kl_expert_amateur"


@query("SRC-14_kl_log_round_trip", f"select candidate_id, prompt_id, step, kl_divergence from ({c_sql(prompt_id='prompt_id', step='step', kl_divergence=f'case when isnan({_KL}) then null else {_KL} end')})")
def src14(s, d):
    t = candidates(s, d, "prompt_id", "step", "distribution_features").select("candidate_id", "prompt_id", "step", finite_or_null(F.col(_KL)).alias("kl_divergence"))
    return _round_trip(s, t, "src14").drop("ord")


@query("SRC-15_training_samples", "select sample_id, len(any_value(token_ids)) as n_ids, round(list_sum(any_value(weights)), 6) as total from selected_samples group by sample_id")
def src15(s, d):
    t = _round_trip(s, samples(s, d).select("sample_id", "token_ids", "weights"), "src15")
    return t.select("sample_id", F.size("token_ids").alias("n_ids"), F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SRC-18_vocabulary", "select id, min(token) as token from (select unnest(contrastive_target.token_ids) id, unnest(contrastive_target.tokens) token from candidate_records) group by id")
def src18(s, d):
    t = table(s, d, "candidate_records").select(F.explode(F.arrays_zip("contrastive_target.token_ids", "contrastive_target.tokens")).alias("x"))
    return t.groupBy(F.col("x.token_ids").alias("id")).agg(F.min("x.tokens").alias("token"))


@query("SNK-01_write_jsonl_count", "select count(*) as written, count(*) as read from math_train")
def snk01(s, d):
    path, t = scratch(s, "snk01"), table(s, d, "math_train")
    n = sinks.write_jsonl(t, path)
    return s.read.schema(t.schema).json(path).agg(F.lit(n).cast("long").alias("written"), F.count("*").alias("read"))


@query("SNK-02_append", "select id, 2 * count(*) as n from math_test group by id")
def snk02(s, d):
    path, t = scratch(s, "snk02"), table(s, d, "math_test")
    sinks.write_jsonl(t, path)
    sinks.write_jsonl(t, path, "append")
    return s.read.schema(t.schema).json(path).groupBy("id").agg(F.count("*").alias("n"))


@query("SNK-03_ledger_stream", "select id as prompt_id, cast(greatest(len(string_split(any_value(question), ' ')) - 1, 1) as bigint) as num_candidates from gsm8k_test where question is not null and id is not null group by id")
def snk03(s, d):
    """The stream is run twice over the same folder; the second run finds nothing new."""
    base, t = scratch(s, "snk03"), table(s, d, "gsm8k_test").where("question is not null and id is not null").select(F.col("id").alias("prompt_id"), "question")
    sinks.write_jsonl(t, f"{base}/in")
    make = lambda b: b.select("prompt_id", F.explode(project.text_prefixes(F.split("question", " "))).alias("x")).select("prompt_id", "x.step", "x.prefix")
    for _ in range(2):
        ledger.log_candidates(s, f"{base}/in", t.schema, f"{base}/candidates", f"{base}/ledger", f"{base}/checkpoint", make).awaitTermination()
    return s.read.parquet(f"{base}/ledger").select("prompt_id", "num_candidates")


@query("SNK-04_overwrite", "select distinct id, problem from math_test")
def snk04(s, d):
    path, t = scratch(s, "snk04"), table(s, d, "math_test").dropDuplicates(["id"]).select("id", "problem")
    sinks.write_jsonl(t.limit(1), path)
    sinks.write_jsonl(t, path)
    return s.read.schema(t.schema).json(path)


_VAL = ("schema_version", "prompt_id", "step", "prefix", "distribution_features", "token_features", "step_features", "contrastive_target")


@query("VAL-01_missing_keys", "select missing, count(*) as n from (select array_to_string(list_sort(list_filter([" + ", ".join(f"case when {f} is null then '{f}' end" for f in _VAL) + "], lambda x: x is not null)), ',') missing from candidate_records) group by missing")
def val01(s, d):
    t = table(s, d, "candidate_records").select(F.to_json(F.struct(*_VAL)).alias("j"))
    return t.groupBy(F.array_join(contracts.missing_keys(F.col("j"), contracts.CANDIDATE_FIELDS), ",").alias("missing")).agg(F.count("*").alias("n"))


_SAMPLE_ERR = """case when prompt_id is null or step is null or prefix is null or tokens is null or token_ids is null or weights is null or kl_divergence is null then 'missing: ' || array_to_string(list_sort(list_filter(
  [case when prompt_id is null then 'prompt_id' end, case when step is null then 'step' end, case when prefix is null then 'prefix' end, case when tokens is null then 'tokens' end, case when token_ids is null then 'token_ids' end, case when weights is null then 'weights' end, case when kl_divergence is null then 'kl_divergence' end], lambda x: x is not null)), ',')
  when len(token_ids) <> len(weights) then 'token_ids and weights differ in length' when len(tokens) <> len(token_ids) then 'tokens and token_ids differ in length' end"""


@query("VAL-02_sample_contract", f"select error, count(*) as n from (select {_SAMPLE_ERR} error from selected_samples) group by error")
def val02(s, d):
    t = table(s, d, "selected_samples")
    return t.groupBy(contracts.sample_error(t).alias("error")).agg(F.count("*").alias("n"))


@query("VAL-03_candidate_contract", "select error, count(*) as n from (select case when m <> '' then 'missing: ' || m when schema_version <> 'candidate_v1' then 'unsupported version' when t.token_ids is null or t.tokens is null or t.weights is null then 'incomplete target' when len(t.token_ids) <> len(t.weights) or len(t.tokens) <> len(t.token_ids) then 'target arrays differ in length' end error from (select schema_version, contrastive_target t, array_to_string(list_sort(list_filter([" + ", ".join(f"case when {f} is null then '{f}' end" for f in _VAL) + "], lambda x: x is not null)), ',') m from candidate_records)) group by error")
def val03(s, d):
    t = table(s, d, "candidate_records")
    return t.groupBy(contracts.candidate_error(t).alias("error")).agg(F.count("*").alias("n"))


@query("VAL-04_trainer_report", f"""with x as (select *, coalesce({_SAMPLE_ERR}, case when trim(prompt_id) = '' then 'blank prompt_id' when abs(list_sum(weights) - 1) > 1e-3 then 'weights don''t sum to 1' when len(token_ids) = 0 then 'no token ids' when list_max(token_ids) >= 151643 then 'token id beyond the vocabulary' end) e from selected_samples)
  select count(*) as records_checked, count(selection_metadata) as metadata_records, cast(coalesce(max(list_max(token_ids)), 0) as bigint) as max_token_id, count(e) as error_count, coalesce((select string_agg(sample_id || ': ' || e, '; ' order by sample_id, e) from (select sample_id, e from x where e is not null order by sample_id, e limit 20)), '') as errors, count(e) = 0 as compatible from x""")
def val04(s, d):
    return contracts.trainer_report(table(s, d, "selected_samples"), "sample_id", 151643).withColumn("max_token_id", F.col("max_token_id").cast("long"))


@query("VAL-07_valid_samples", f"select run_id, count(*) as n, count({_SAMPLE_ERR}) > 0 as aborts from selected_samples group by run_id")
def val07(s, d):
    """Each run's file is loaded as a whole; its first invalid record aborts the load."""
    from pyspark.errors import PySparkException

    t, out = table(s, d, "selected_samples"), []
    for run, n in t.groupBy("run_id").count().collect():  # one load per file
        one = t.where(F.col("run_id").eqNullSafe(F.lit(run)))
        try:
            out.append((run, contracts.all_valid(one, contracts.sample_error(one)).count(), False))
        except PySparkException:
            out.append((run, n, True))
    return s.createDataFrame(out, "run_id string, n long, aborts boolean")


@query("PRJ-01_word_problems", "select question as id, question, answer from gsm8k_train")
def prj01(s, d):
    return project.word_problems(table(s, d, "gsm8k_train"))


@query("PRJ-02_subject_problems", f"select problem as id, problem, solution, 'algebra' as level from math_train where {key_sql('level')} = 'algebra'")
def prj02(s, d):
    return project.subject_problems(table(s, d, "math_train").where(label_key("level") == "algebra"), "algebra")


@query("PRJ-03_assembled_candidates", f"""select category, bucket, fixed, count(*) as n from (select {token_sql('t')} category, fixed, case when p < 0.33 then 'early' when p < 0.66 then 'middle' else 'late' end bucket from (
  {c_sql(t='target_token_text', p='case when sequence_length > 0 then step / sequence_length else 0.0 end', fixed=f'coalesce(not isnan({_KL}) and {_KL} >= 0.4, false)')})) group by all""")
def prj03(s, d):
    t = project.assembled_candidate(candidates(s, d))
    b = F.when(F.col("position_features.is_early"), "early").when(F.col("position_features.is_middle"), "middle").otherwise("late")
    return t.groupBy(F.col("token_features.token_category").alias("category"), b.alias("bucket"), F.col("fixed_kl_selected").alias("fixed")).agg(F.count("*").alias("n"))


_CUT = 20000
_KEPT = f"list_filter(t.token_ids, lambda x: x >= 0 and x < {_CUT})"
_KEPT_W = f"list_sum(list_filter(list_transform(range(1, len(t.token_ids) + 1), lambda i: case when t.token_ids[i] >= 0 and t.token_ids[i] < {_CUT} then t.weights[i] end), lambda x: x is not null))"


@query("PRJ-04_selected_samples", f"""select candidate_id, coalesce(nullif(q, ''), p) as prompt_id, array_to_string({_KEPT}, ',') as ids, cast(len(t.token_ids) - len({_KEPT}) as bigint) as dropped from (
  {c_sql(q='question', p='prompt_id', t='contrastive_target')}) where len({_KEPT}) > 0 and {_KEPT_W} > 0""")
def prj04(s, d):
    c = candidates(s, d, "question", "prompt_id", "step", "prefix", "contrastive_target", "distribution_features", "token_features", "step_features")
    t = project.selected_sample(c, "fixed_kl", F.col(_KL), max_token_id_exclusive=_CUT, keep=("candidate_id",))
    return t.select("candidate_id", "prompt_id", F.array_join("token_ids", ",").alias("ids"), F.col("selection_metadata.dropped_out_of_vocab_target_tokens").cast("long").alias("dropped"))


@query("PRJ-05_position_features", f"select candidate_id, round(p, 9) as p, p < 0.33 as is_early, p >= 0.33 and p < 0.66 as is_middle, p >= 0.66 as is_late from ({c_sql(p='case when sequence_length > 0 then step / sequence_length else 0.0 end')})")
def prj05(s, d):
    t = candidates(s, d, "step", "sequence_length").select("candidate_id", features.position_features(F.col("step"), F.col("sequence_length")).alias("f"))
    return t.select("candidate_id", F.round("f.normalized_position", 9).alias("p"), "f.is_early", "f.is_middle", "f.is_late")


@query("PRJ-06_position_buckets", f"select case when p is null then 'unknown' when p < 0.33 then 'early' when p < 0.66 then 'middle' else 'late' end as bucket, count(*) as n from ({c_sql(p='normalized_position')}) group by 1")
def prj06(s, d):
    return candidates(s, d, "normalized_position").groupBy(features.position_bucket(F.col("normalized_position")).alias("bucket")).agg(F.count("*").alias("n"))


@query("PRJ-07_confidence_buckets", f"""select bucket, count(*) as n from (select unnest([case when coalesce(h, 0) <= 1 then 'low_expert_entropy' else 'high_expert_entropy' end, case when coalesce(g, 0) >= 1 then 'high_entropy_gap' end, case when not coalesce(m, false) then 'top1_mismatch' end]) bucket from (
  {c_sql(h='distribution_features.expert_entropy', g='distribution_features.entropy_gap', m='distribution_features.top1_match')})) where bucket is not null group by bucket""")
def prj07(s, d):
    return candidates(s, d, "distribution_features").select(F.explode(features.confidence_buckets(F.col("distribution_features"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("PRJ-08_token_features", f"select candidate_id, category, category = 'number' as is_number, category = 'operator' as is_operator from (select candidate_id, {token_sql('t')} category from ({c_sql(t='target_token_text')}))")
def prj08(s, d):
    t = candidates(s, d, "target_token_text").select("candidate_id", features.token_features(F.col("target_token_text")).alias("f"))
    return t.select("candidate_id", F.col("f.token_category").alias("category"), "f.is_number", "f.is_operator")


@query("PRJ-09_step_features", f"select candidate_id, step_type, case step_type when 'final_answer' then 0.85 when 'calculation' then 0.75 when 'setup' then 0.7 when 'transformation' then 0.65 when 'verification' then 0.6 else 0.3 end::double as confidence from (select candidate_id, {step_sql('p', 't')} step_type from ({c_sql(p='prefix', t='target_token_text')}))")
def prj09(s, d):
    t = candidates(s, d, "prefix", "target_token_text").select("candidate_id", classify.classify_step(F.col("prefix"), F.col("target_token_text")).alias("f"))
    return t.select("candidate_id", "f.step_type", F.col("f.step_type_confidence").alias("confidence"))


_D = "distribution_features"
_FEATURE_SQL = "[" + ", ".join([f"coalesce({_D}.{n}, 0)" for n in features.NUMERIC[:-1]] + ["coalesce(normalized_position, 0)", f"coalesce({_D}.top1_match, false)::double"] + [f"(coalesce(token_features.token_category, 'other') = '{c}')::double" for c in features.TOKEN_CATEGORIES] + [f"(coalesce(step_features.step_type, 'other') = '{c}')::double" for c in features.STEP_TYPES] + ["(coalesce(normalized_position, 0) < 0.33)::double", "(coalesce(normalized_position, 0) >= 0.33 and coalesce(normalized_position, 0) < 0.66)::double", "(coalesce(normalized_position, 0) >= 0.66)::double"]) + "]"
#: SQL with the vector ``f`` of each candidate.
FEATURE_ROWS = f"select candidate_id, {_FEATURE_SQL} f from ({c_sql(distribution_features='distribution_features', token_features='token_features', step_features='step_features', normalized_position='normalized_position')})"


@query("PRJ-10_feature_vectors", f"select candidate_id, i, v from (select candidate_id, unnest(f) v, unnest(range(33)) i from ({FEATURE_ROWS})) where v is not null and not isnan(v) and v <> 0")
def prj10(s, d):
    t = candidates(s, d, "distribution_features", "token_features", "step_features", "normalized_position")
    f = features.feature_array(F.col("distribution_features"), F.col("token_features.token_category"), F.col("step_features.step_type"), F.col("normalized_position"))
    return t.select("candidate_id", F.posexplode(f).alias("i", "v")).where(~F.isnan("v") & (F.col("v") != 0)).select("candidate_id", F.col("i").cast("long").alias("i"), "v")


@query("PRJ-11_example_summary", "select id, question, gold, prediction, substring(response, 1, 300) as response from (select eval_id, any_value(id) id, any_value(question) question, any_value(gold) gold, any_value(prediction) prediction, any_value(response) response from eval_outputs group by eval_id)")
def prj11(s, d):
    return project.example_summary(evals(s, d))


@query("PRJ-12_target_sizes", f"select candidate_id, cast(coalesce(len(t.token_ids), 0) as bigint) as size, cast(coalesce(len({_KEPT}), 0) as bigint) as kept from ({c_sql(t='contrastive_target')})")
def prj12(s, d):
    t = candidates(s, d, "contrastive_target")
    c = F.col("contrastive_target")
    return t.select("candidate_id", dist.filtered_size(c, None).cast("long").alias("size"), dist.filtered_size(c, _CUT).cast("long").alias("kept"))


@query("PRJ-13_sample_keys", "select distinct prompt_id, step, prefix from selected_samples")
def prj13(s, d):
    t = table(s, d, "selected_samples")
    return t.select(project.sample_key(t).alias("k")).distinct().select("k.*")


@query("PRJ-14_sample_metadata", "select case when m is null then 'unknown' else coalesce(m.selector_name, 'None') end as selector_name, case when m is null then 'unknown' else coalesce(m.token_category, 'None') end as token_category, count(*) as n from (select selection_metadata m from selected_samples) group by 1, 2")
def prj14(s, d):
    return project.sample_metadata(table(s, d, "selected_samples")).groupBy("selector_name", "token_category").agg(F.count("*").alias("n"))


@query("PRJ-15_eval_rows", f"select eval_id, coalesce(id, question) as id, {predicted_sql('response')} as predicted, coalesce(gold = {predicted_sql('response')}, false) as correct from (select eval_id, any_value(id) id, any_value(question) question, any_value(gold) gold, any_value(response) response from eval_outputs group by eval_id)")
def prj15(s, d):
    t = project.eval_row(evals(s, d), F.col("gold"), classify.predicted_answer(F.col("response")), ("eval_id",))
    return t.select("eval_id", "id", F.col("prediction").alias("predicted"), "correct")


_VOCABULARY = "select id, min(token) as token from (select unnest(contrastive_target.token_ids) id, unnest(contrastive_target.tokens) token from candidate_records) group by id"


@query("PRJ-16_kl_log", f"with v as ({_VOCABULARY}) select prompt_id, step, trim(a.token) as token, trim(b.token) as amateur_top1_token, kl_divergence from ({c_sql(prompt_id='prompt_id', step='step', e='distribution_features.expert_top1_id', a='distribution_features.amateur_top1_id', kl_divergence=f'case when isnan({_KL}) then null else {_KL} end')}) c left join v a on a.id = c.e left join v b on b.id = c.a")
def prj16(s, d):
    """The token is the text of the expert's most likely id, as far as the log has that id's text."""
    c = candidates(s, d, "prompt_id", "step", "distribution_features")
    v = src18(s, d)
    for side in ("expert", "amateur"):
        known = v.select(F.col("id").alias(f"_{side}_id"), F.col("token").alias(f"_{side}"))
        c = c.join(known, F.col(f"distribution_features.{side}_top1_id") == F.col(f"_{side}_id"), "left")
    return project.kl_log_row(c, F.col("_expert"), F.col("_amateur")).select("prompt_id", "step", "token", "amateur_top1_token", finite_or_null(F.col("kl_divergence")).alias("kl_divergence"))


@query("PRJ-17_plain_prompts", "select distinct id, 'System: Please reason step by step, and put your final answer within \\boxed{}.' || chr(10) || 'User: ' || question || chr(10) || 'Assistant: ' as prompt from gsm8k_test")
def prj17(s, d):
    return table(s, d, "gsm8k_test").dropDuplicates(["id"]).select("id", project.plain_prompt(F.col("question")).alias("prompt"))


_CLIP = f"{DIST}, c as (select vec_id, i, greatest(pe, 1e-12) / sum(greatest(pe, 1e-12)) over (partition by vec_id) pe, greatest(pa, 1e-12) / sum(greatest(pa, 1e-12)) over (partition by vec_id) pa from j)"


@query("ARR-01_normalise", f"with {_CLIP} select vec_id, cast(i as bigint) as i, round(pe, 9) as p from c")
def arr01(s, d):
    return distributions(s, d).select("vec_id", F.posexplode(dist.clipped(F.col("expert"))).alias("i", "p")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("p", 9).alias("p"))


@query("ARR-02_entropy", f"with {_CLIP} select vec_id, round(-sum(pe * ln(pe)), 9) as entropy from c group by vec_id")
def arr02(s, d):
    return distributions(s, d).select("vec_id", F.round(dist.entropy(F.col("expert")), 9).alias("entropy"))


@query("ARR-03_kl", f"with {_CLIP} select vec_id, round(sum(pe * (ln(pe) - ln(pa))), 9) as kl from c group by vec_id")
def arr03(s, d):
    return distributions(s, d).select("vec_id", F.round(dist.kl(F.col("expert"), F.col("amateur")), 9).alias("kl"))


_TOP = "r as (select vec_id, i, pe, row_number() over (partition by vec_id order by pe desc, i) rn from c)"


@query("ARR-04_top2", f"with {_CLIP}, {_TOP} select a.vec_id, cast(a.i as bigint) as id1, round(a.pe, 9) as p1, cast(b.i as bigint) as id2, round(b.pe, 9) as p2 from r a join r b on a.vec_id = b.vec_id and a.rn = 1 and b.rn = 2")
def arr04(s, d):
    t = distributions(s, d).select("vec_id", dist.top2(dist.clipped(F.col("expert"))).alias("t"))
    return t.select("vec_id", F.col("t.id1").cast("long").alias("id1"), F.round("t.p1", 9).alias("p1"), F.col("t.id2").cast("long").alias("id2"), F.round("t.p2", 9).alias("p2"))


def _features_sql(k: str, ka: str) -> str:
    """SQL of all 14 features; the amateur lacks its last four ids in every third row."""
    return f"""with n as (select count(*) n from embeddings), e as (select vec_id, len(embedding) z, unnest(range(len(embedding))) i, unnest(embedding)::double x from embeddings),
      sm as (select vec_id, z, i, exp({k}*x)/sum(exp({k}*x)) over (partition by vec_id) p, exp({ka}*x)/sum(exp({ka}*x)) over (partition by vec_id) q from e),
      j as (select a.vec_id, a.i, a.p pe, b.q pa from sm a, n, sm b where b.vec_id = (a.vec_id + 1) % n.n and a.i = b.i and (a.vec_id % 3 <> 0 or a.i < b.z - 4)),
      c as (select vec_id, i, greatest(pe, 1e-12) / sum(greatest(pe, 1e-12)) over (partition by vec_id) pe, greatest(pa, 1e-12) / sum(greatest(pa, 1e-12)) over (partition by vec_id) pa from j),
      a as (select vec_id, sum(pe * (ln(pe) - ln(pa))) kl, -sum(pe * ln(pe)) he, -sum(pa * ln(pa)) ha, arg_max(i, pe) e1, arg_max(i, pa) a1, max(pe) pe1, max(pa) pa1, max(pe) filter (i = vec_id % 64) te, max(pa) filter (i = vec_id % 64) ta, list_sort(list(pe), 'DESC')[2] e2 from c group by vec_id)
      select vec_id, round(kl, 8) as kl_expert_amateur, round(he, 8) as expert_entropy, round(ha, 8) as amateur_entropy, round(ha - he, 8) as entropy_gap, cast(e1 as bigint) as expert_top1_id, cast(a1 as bigint) as amateur_top1_id, round(pe1, 8) as expert_top1_prob, round(pa1, 8) as amateur_top1_prob,
        round(pe1 - e2, 8) as expert_top2_margin, e1 = a1 as top1_match, round(pe1 - pa1, 8) as expert_amateur_top1_prob_gap, round(te, 8) as target_expert_prob, round(ta, 8) as target_amateur_prob, round(te - ta, 8) as target_prob_gap from a"""


def _features(s, d, k, ka):
    t = cut_amateur(distributions(s, d, k, ka)).select("vec_id", dist.distribution_features(F.col("expert"), F.col("amateur"), F.col("target")).alias("f")).select("vec_id", "f.*")
    return t.select(*[F.round(c, 8).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in t.dtypes])


@query("ARR-05_distribution_features", _features_sql("5.0", "5.0"))
def arr05(s, d):
    return _features(s, d, 5.0, 5.0)


@query("ARR-06_distribution_features_double", _features_sql("8.0", "5.0"))
def arr06(s, d):
    """The same from logits at another temperature of the expert."""
    return _features(s, d, 8.0, 5.0)


@query("ARR-07_kl_additive", f"with {DIST} select vec_id, round(sum((pe + 1e-12) * (ln(pe + 1e-12) - ln(pa + 1e-12))), 9) as kl from j group by vec_id")
def arr07(s, d):
    return distributions(s, d).select("vec_id", F.round(dist.kl(F.col("expert"), F.col("amateur"), "additive"), 9).alias("kl"))


@query("ARR-08_kl_raw", f"with {DIST} select vec_id, round(sum(pe * (ln(pe) - ln(pa))), 9) as kl from j group by vec_id")
def arr08(s, d):
    return distributions(s, d).select("vec_id", F.round(dist.kl(F.col("expert"), F.col("amateur"), "raw"), 9).alias("kl"))


_OTHER_ID = "(t.i * 29 + 7) % 64"


@query("ARR-09_kl_shared_vocabulary", f"""with {DIST}, t as (select distinct i from e), v as (select i id_a, {_OTHER_ID} id_b from t where i % 5 <> 2), x as (select e.vec_id, v.id_a, e.p pe from sm e join v on e.i = v.id_a),
  y as (select (a.vec_id - 1 + n.n) % n.n vec_id, v.id_a, a.p pa from sm a, n, v where v.id_b = a.i), z as (select x.vec_id, pe / sum(pe) over (partition by x.vec_id) pe, pa / sum(pa) over (partition by x.vec_id) pa from x join y on x.vec_id = y.vec_id and x.id_a = y.id_a),
  k as (select vec_id, greatest(pe, 1e-6) pe, greatest(pa, 1e-6) pa from z), m as (select vec_id, pe / sum(pe) over (partition by vec_id) pe, pa / sum(pa) over (partition by vec_id) pa from k) select vec_id, round(sum(pe * (ln(pe) - ln(pa))), 8) as kl from m group by vec_id""")
def arr09(s, d):
    """Two vocabularies give the same token strings different ids, and each has strings of its own."""
    t = distributions(s, d)
    ids = t.select(F.explode(F.sequence(F.lit(0), F.size("expert") - 1)).alias("id")).distinct()
    a = ids.select("id", F.concat(F.lit("tok"), F.col("id").cast("string")).alias("token"))
    b = ids.where("id % 5 <> 2").select(F.expr("(id * 29 + 7) % 64").alias("id"), F.concat(F.lit("tok"), F.col("id").cast("string")).alias("token"))
    return compare.shared_vocabulary_kl(t, a, b, ["vec_id"]).select("vec_id", F.round("kl", 8).alias("kl"))


@query("ARR-10_contrastive_target", f"with {DIST}, m as (select *, max(pe) over (partition by vec_id) t from j), k as (select vec_id, i, ln(pe + 1e-12) - ln(pa + 1e-12) x from m where pe >= 0.2 * t) select vec_id, cast(i as bigint) as id, round(exp(x) / sum(exp(x)) over (partition by vec_id), 8) as w from k")
def arr10(s, d):
    t = distributions(s, d).select("vec_id", dist.contrastive_target(F.col("expert"), F.col("amateur")).alias("t"))
    return t.select("vec_id", F.explode(F.arrays_zip("t.token_ids", "t.weights")).alias("x")).select("vec_id", F.col("x.token_ids").cast("long").alias("id"), F.round("x.weights", 8).alias("w"))


@query("ARR-11_filtered_target", f"with x as (select candidate_id, unnest(t.token_ids) id, unnest(t.weights) w from ({c_sql(t='contrastive_target')})), k as (select *, sum(w) over (partition by candidate_id) z from x where id >= 0 and id < {_CUT}) select candidate_id, id, round(w / z, 8) as w from k where z > 0")
def arr11(s, d):
    t = candidates(s, d, "contrastive_target").select("candidate_id", dist.filter_target(F.col("contrastive_target"), _CUT).alias("t"))
    return t.select("candidate_id", F.explode(F.arrays_zip("t.token_ids", "t.weights")).alias("x")).select("candidate_id", F.col("x.token_ids").alias("id"), F.round("x.weights", 8).alias("w"))


@query("ARR-12_dense_labels", f"with x as (select candidate_id, unnest(t.token_ids) % 32 id, unnest(t.weights) w, unnest(range(len(t.token_ids))) pos from ({c_sql(t='contrastive_target')})) select candidate_id, cast(id as bigint) as i, round(arg_max(w, pos), 9) as w from x group by candidate_id, id having arg_max(w, pos) <> 0")
def arr12(s, d):
    c = F.col("contrastive_target")
    t = candidates(s, d, "contrastive_target").select("candidate_id", F.posexplode(dist.dense_label(F.transform(c["token_ids"], lambda x: x % 32), c["weights"], 32)).alias("i", "w"))
    return t.where("w <> 0").select("candidate_id", F.col("i").cast("long").alias("i"), F.round("w", 9).alias("w"))


@query("ARR-13_softmax", "with e as (select vec_id, unnest(range(len(embedding))) i, unnest(embedding)::double x from embeddings) select vec_id, cast(i as bigint) as i, round(exp(x) / sum(exp(x)) over (partition by vec_id), 9) as p from e")
def arr13(s, d):
    t = table(s, d, "embeddings").select("vec_id", F.posexplode(dist.softmax(F.transform("embedding", lambda x: x.cast("double")))).alias("i", "p"))
    return t.select("vec_id", F.col("i").cast("long").alias("i"), F.round("p", 9).alias("p"))


@query("ARR-14_top_k_tokens", f"with {DIST}, r as (select vec_id, i, pe, pa, row_number() over (partition by vec_id order by pe desc, i) rn from j) select vec_id, cast(rn as bigint) as rank, cast(i as bigint) as id, round(pe, 9) as p, round(pe - pa, 9) as delta from r where rn <= 5")
def arr14(s, d):
    t = distributions(s, d).select("vec_id", "amateur", F.posexplode(dist.top_k(F.col("expert"), 5)).alias("r", "x"))
    return t.select("vec_id", (F.col("r") + 1).cast("long").alias("rank"), F.col("x.id").cast("long").alias("id"), F.round("x.p", 9).alias("p"), F.round(F.col("x.p") - dist.probability_of(F.col("amateur"), F.col("x.id")), 9).alias("delta"))


@query("ARR-15_soft_label_loss", f"with {DIST}, e2 as (select vec_id, i, ln(sum(exp(x)) over (partition by vec_id)) - x nl from e) select round(avg(l), 8) as loss from (select j.vec_id, sum(pe * (ln(pe) + nl)) l from j join e2 on j.vec_id = e2.vec_id and j.i = e2.i group by j.vec_id)")
def arr15(s, d):
    t = distributions(s, d).join(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    return t.agg(F.round(F.avg(dist.soft_label_loss(F.col("expert"), F.transform("embedding", lambda x: x.cast("double")))), 8).alias("loss"))


@query("ARR-16_perplexity", f"select dataset, round(exp(sum(-ln(p)) / count(p)), 6) as ppl from ({c_sql(dataset='dataset', p='distribution_features.target_expert_prob')}) where p > 0 and not isnan(p) group by dataset")
def arr16(s, d):
    p = F.col("distribution_features.target_expert_prob")
    t = candidates(s, d, "dataset", "distribution_features").where(~F.isnan(p) & (p > 0))
    return t.groupBy("dataset").agg(F.round(F.exp(F.sum(-F.log(p)) / F.count(p)), 6).alias("ppl"))


@query("ARR-17_padding", "with x as (select sample_id, any_value(token_ids) t from selected_samples group by sample_id), m as (select max(len(t)) m from x) select sample_id, array_to_string(list_concat(t, list_transform(range(m - len(t)), lambda i: 0)), ',') as ids, cast(len(t) as bigint) as real from x, m")
def arr17(s, d):
    from pyspark.sql import Window

    t = samples(s, d).select("sample_id", "token_ids")
    longest = t.agg(F.max(F.size("token_ids")).alias("m")).first()["m"] or 0
    p = t.select("sample_id", dist.padded(F.col("token_ids"), F.lit(longest)).alias("p"))
    return p.select("sample_id", F.array_join("p.ids", ",").alias("ids"), F.aggregate("p.mask", F.lit(0), lambda a, x: a + x).cast("long").alias("real"))


@query("TXT-01_token_categories", f"select {token_sql('target_token_text')} as category, count(*) as n from candidate_records group by 1")
def txt01(s, d):
    return table(s, d, "candidate_records").groupBy(classify.classify_token(F.col("target_token_text")).alias("category")).agg(F.count("*").alias("n"))


@query("TXT-01_word_categories", f"select {token_sql('w')} as category, count(*) as n from (select unnest(string_split(text, ' ')) w from documents) group by 1")
def txt01b(s, d):
    return table(s, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).groupBy(classify.classify_token(F.col("w")).alias("category")).agg(F.count("*").alias("n"))


@query("TXT-02_step_types", f"select {step_sql('prefix', 'target_token_text')} as step_type, count(*) as n from candidate_records group by 1")
def txt02(s, d):
    t = table(s, d, "candidate_records").select(classify.classify_step(F.col("prefix"), F.col("target_token_text")).alias("f"))
    return t.groupBy("f.step_type").agg(F.count("*").alias("n"))


@query("TXT-03_normalised_text", "select distinct eval_id, trim(regexp_replace(lower(response), '[\\s\\v\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+', ' ', 'g')) as t from eval_outputs")
def txt03(s, d):
    return evals(s, d).select("eval_id", classify.for_matching(F.col("response")).alias("t"))


@query("TXT-04_degeneration_reasons")
def txt04(s, d):
    t = evals(s, d).select("eval_id", F.explode(classify.degeneration_reasons(F.col("response"), F.col("question"), F.lit(project.SYSTEM_PROMPT))).alias("reason"))
    return t


@query("TXT-05_normalised_answers", f"select distinct eval_id, {norm_sql('prediction')} as answer from eval_outputs")
def txt05(s, d):
    return evals(s, d).select("eval_id", classify.normalize_answer(F.col("prediction")).alias("answer"))


@query("TXT-06_gold_answers", f"select distinct id, {gold_sql('answer')} as gold from gsm8k_train")
def txt06(s, d):
    return table(s, d, "gsm8k_train").dropDuplicates(["id"]).select("id", classify.gold_answer(F.col("answer")).alias("gold"))


@query("TXT-07_predicted_answers", f"select distinct eval_id, {predicted_sql('response')} as answer from eval_outputs")
def txt07(s, d):
    return evals(s, d).select("eval_id", classify.predicted_answer(F.col("response")).alias("answer"))


@query("TXT-08_manual_answers", f"select distinct eval_id, case when response is null then null when regexp_matches(response, '\\\\boxed\\{{([^}}]+)\\}}') then {strip_sql('''regexp_extract(response, '\\\\boxed\\{([^}]+)\\}', 1)''')} else coalesce(list_extract(regexp_extract_all(response, '-?[0-9]+\\.?[0-9]*'), -1), '') end as answer from eval_outputs")
def txt08(s, d):
    return evals(s, d).select("eval_id", classify.manual_answer(F.col("response")).alias("answer"))


@query("TXT-10_safe_names", "select distinct writer, translate(lower(writer), ' -', '__') as name from eval_outputs where writer is not null")
def txt10(s, d):
    return table(s, d, "eval_outputs").where("writer is not null").select("writer", classify.safe_name(F.col("writer")).alias("name")).distinct()


@query("TXT-11_text_prefixes", "with w as (select id, string_split(any_value(question), ' ') w from gsm8k_test where question is not null group by id), s as (select id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) step from w) select id, cast(step as bigint) as step, array_to_string(w[1:step], ' ') as prefix from s")
def txt11(s, d):
    t = table(s, d, "gsm8k_test").where("question is not null").dropDuplicates(["id"])
    return t.select("id", F.explode(project.text_prefixes(F.split("question", " "))).alias("x")).select("id", F.col("x.step").cast("long").alias("step"), "x.prefix")
