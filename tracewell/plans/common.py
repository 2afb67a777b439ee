"""What the query modules share: tables, scratch folders and SQL parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.dist import softmax
from tracewell.session import ensure_checkpoint_dir, table


_LEAVES = ("distribution_features", "token_features", "step_features", "position_features")


def candidates(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per candidate; with ``columns`` only these besides the key."""
    t = table(s, d, "candidate_records")
    t = t.select("candidate_id", *columns) if columns else t
    flat, made = [], []
    for f in t.schema.fields:
        if f.name in _LEAVES:
            # the leaves are made distinct one by one, so the scan and the shuffle carry those alone that are used;
            # a null struct becomes one of nulls, which these features don't tell apart
            flat += [F.col(f"{f.name}.{x.name}").alias(f"{f.name}__{x.name}") for x in f.dataType.fields]
            made.append(F.struct(*[F.col(f"{f.name}__{x.name}").alias(x.name) for x in f.dataType.fields]).alias(f.name))
        else:
            flat.append(F.col(f.name))
            made.append(F.col(f.name))
    return t.select(*flat).dropDuplicates(["candidate_id"]).select(*made)


def samples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "selected_samples").dropDuplicates(["sample_id"])


def evals(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_outputs").dropDuplicates(["eval_id"])


def scratch(s: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint storage."""
    ensure_checkpoint_dir(s)
    return f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut_amateur(t: DataFrame) -> DataFrame:
    """The amateur of every third row lacks its last four ids: vocabularies of unequal length."""
    return t.withColumn("amateur", F.when(F.col("vec_id") % 3 == 0, F.slice("amateur", 1, F.greatest(F.size("amateur") - 4, F.lit(0)))).otherwise(F.col("amateur")))


def distributions(s: SparkSession, d: str, k: float = 5.0, k_amateur: float = 5.0) -> DataFrame:
    """``vec_id``, ``expert``, ``amateur``, ``target``: softmax of each embedding and of the next one.

    A deterministic stand-in for two models over a vocabulary of the embedding's size.
    """
    v = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    n = v.agg(F.count("*").alias("n")).first()["n"]
    a = v.select(F.pmod(F.col("vec_id") + n - 1, F.lit(n)).alias("vec_id"), softmax(F.transform("x", lambda x: x * k_amateur)).alias("amateur"))
    return v.select("vec_id", softmax(F.transform("x", lambda x: x * k)).alias("expert"), (F.col("vec_id") % 64).cast("int").alias("target")).join(a, "vec_id")


def c_sql(**fields: str) -> str:
    """SQL for one row per candidate with the given expressions."""
    return "select candidate_id, " + ", ".join(f"any_value({e}) as {n}" for n, e in fields.items()) + " from candidate_records group by candidate_id"


#: Long form of the distributions: vec_id, i, pe, pa.
P_SQL = """n as (select count(*) n from embeddings), e as (select vec_id, unnest(range(len(embedding))) i, unnest(embedding)::double x from embeddings),
  sm as (select vec_id, i, exp({k}*x)/sum(exp({k}*x)) over (partition by vec_id) p from e),
  j as (select a.vec_id, a.i, a.p pe, b.p pa from sm a, n, sm b where b.vec_id = (a.vec_id + 1) % n.n and a.i = b.i)"""
DIST = P_SQL.format(k="5.0")
SPACES = r"[\s\v\p{Z}\x{85}\x{1c}-\x{1f}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def token_sql(t: str) -> str:
    """SQL of the token categories."""
    s = strip_sql(t)
    return f"""case when {t} is null or {t} = '' then 'other' when contains({t}, chr(10)) then 'newline' when {s} = '' then 'space'
      when regexp_matches({t}, '(?i)(####|boxed|final answer|answer is|therefore)') then 'final_answer_marker'
      when regexp_matches({t}, '(?i)(\\$|%|cent|dollar|kg|g|cm|mm|meter|mile|hour|minute)') then 'currency_or_unit'
      when regexp_matches({s}, '[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]') then 'number' when {s} in ('=', '==') then 'equals' when {s} in ('+', '-', '*', '/', '^', '<', '>') then 'operator'
      when regexp_matches({s}, '^[A-Za-z]$') then 'variable' when not regexp_matches({s}, '[\\p{{L}}\\p{{N}}]') then 'punctuation' when regexp_matches({s}, '\\p{{L}}') then 'word' else 'other' end"""


def step_sql(prefix: str, token: str) -> str:
    """SQL of the step types."""
    t = f"lower(right(coalesce({prefix}, ''), 240) || coalesce({token}, ''))"
    return f"""case when regexp_matches({t}, '####|boxed|final answer|answer is') then 'final_answer'
      when regexp_matches({t}, '[0-9][0-9,.\\s]*([-+*/=%^]| times | divided by | equals )') then 'calculation'
      when regexp_matches({t}, '\\b(let|suppose|we need|given|define|denote|total number|cost|rate|assume)\\b') then 'setup'
      when regexp_matches({t}, '\\b(so|therefore|then|thus|which means|simplify|substitute|rearrange|combine)\\b') then 'transformation'
      when regexp_matches({t}, '\\b(check|verify|since|because|confirm)\\b') then 'verification' else 'other' end"""


def key_sql(x: str) -> str:
    """SQL of a label without case, white space and punctuation."""
    return f"nullif(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"


NUM = r"-?\$?[0-9][0-9,]*(?:\.[0-9]+)?"


def norm_sql(x: str) -> str:
    """SQL of the answer normaliser."""
    return strip_sql(f"rtrim(translate({strip_sql(x)}, ',$%', ''), '.')")


def gold_sql(x: str) -> str:
    return f"case when {x} is null then null when contains({x}, '####') then {norm_sql(f'''list_extract(string_split({x}, '####'), -1)''')} else coalesce({norm_sql(f'''list_extract(regexp_extract_all(replace({x}, ',', ''), '-?[0-9]+(?:\\.[0-9]+)?'), -1)''')}, '') end"


def predicted_sql(x: str) -> str:
    box = f"nullif({strip_sql(f'''regexp_extract({x}, '\\\\boxed\\{{([^{{}}]+)\\}}', 1)''')}, '')"
    said = f"list_extract(regexp_extract_all({x}, '(?i)(?:final answer|answer is)\\s*[:=]?\\s*({NUM})', 1), -1)"
    mark = f"list_extract(regexp_extract_all({x}, '####\\s*({NUM})', 1), -1)"
    last = f"list_extract(regexp_extract_all({x}, '{NUM}'), -1)"
    return f"case when {x} is null then null else coalesce({norm_sql(f'coalesce({box}, {said}, {mark}, {last})')}, '') end"
