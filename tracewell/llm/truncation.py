"""Problem 3: text cut off by field limits or in transfer.

Two families of cuts have different evidence. A field limit, or a limit on the model's output, makes
values of one length far too frequent: discrete hazards per length, each tested against those of the
neighbouring lengths, give the significant lengths, and a value of such a length is cut if its ending
looks incomplete. A cut in transfer may happen at any length: there the ending has to be much more
clearly incomplete, or another field has to show how the value went on. Every case names its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.labels import label_key
from tracewell.operators.ranking import block_offsets, sorted_blocks, with_offsets
from tracewell.operators.records import one_per_key
from tracewell.session import bounded, cut

#: Lengths on either side that a length's hazard is held against.
NEIGHBOURS = 8
#: Share of false discoveries among the significant lengths of a writer's field, over all units.
FALSE_DISCOVERIES = 0.01
#: An ending is incomplete at a significant length if it ends a text in less than this share of its occurrences, and at any other length below the second share.
COMPLETE_AT_LIMIT, COMPLETE = 0.5, 0.05
#: Occurrences that the shorter form of an ending counts for beside the longer one.
PRIOR = 10.0

#: A writer's cut mark: most characters, least share of the values of a significant length, and most share of the writer's other values.
MARK_LENGTH, MARKED, UNMARKED = 16, 0.5, 0.02
# What a response states its answer after.
_STATED = ("####", "nswer is", "NSWER IS", "hus ", "hus:")
#: Greater than every text that begins with the text before it.
_AFTER = "\U0010ffff"


#: The units that a limit may be counted in; tokens are words, marks and line breaks.
UNITS = ("chars", "bytes", "words", "tokens")


def _lengths(c: Column, masked: Column) -> Column:
    """The lengths of a text in ``UNITS``; in ``masked`` each word is one letter."""
    words = F.size(F.filter(F.split(masked, r"\s+"), lambda x: x != ""))
    return F.array(*[x.cast("long") for x in (F.length(c), F.octet_length(c), words, F.length(F.translate(masked, " \t\r", "")))])


def measured(records: DataFrame, fields: tuple[str, ...] = ("response", "prediction")) -> DataFrame:
    """One row per record: ``eval_id``, ``writer`` (key), the other fields, and ``_<field>`` with the lengths of a value by unit (null without one), materialised."""
    rows = one_per_key(records.select("eval_id", "writer", "gold", "prediction", "correct", "response"), "eval_id")
    rows = rows.select("*", *[F.regexp_replace(f, r"[\p{L}\p{N}_]+", "a").alias(f"_m_{f}") for f in fields])
    lengths = [F.when(F.col(f).isNotNull() & (F.col(f) != ""), _lengths(F.col(f), F.col(f"_m_{f}"))).alias(f"_{f}") for f in fields]
    return cut(rows.select("eval_id", F.coalesce(label_key("writer"), F.lit("")).alias("writer"), "gold", "prediction", "correct", "response", *lengths))


def significant_lengths(rows: DataFrame, neighbours: int = NEIGHBOURS, rate: float = FALSE_DISCOVERIES, fields: tuple[str, ...] = ("response", "prediction")) -> DataFrame:
    """``writer``, ``field``, ``unit``, ``length`` at which values end far more often than at the lengths around.

    ``rows`` as from :func:`measured`. Units are characters, bytes, words and tokens. The hazard of a length
    is its count over the number of values at least as long. It is held against the pooled hazard of the
    neighbouring lengths by the Chernoff bound of the binomial tail, an upper bound of the p-value;
    Benjamini and Hochberg's rule over all units and lengths of a writer's field keeps the false discoveries
    at ``rate``. One row per length.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(u).alias("unit"), F.col(f"_{f}")[k].alias("length")) for f in fields for k, u in enumerate(UNITS)])
    counts = rows.select("writer", F.explode(each).alias("x")).where("x.length is not null").groupBy("writer", "x.field", "x.unit", "x.length").agg(F.count("*").alias("n"))
    by = Window.partitionBy("writer", "field", "unit")
    down = by.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = by.orderBy("length").rangeBetween(-neighbours, neighbours)
    h = counts.withColumn("risk", F.sum("n").over(down))
    h = h.withColumn("_n", F.sum("n").over(near) - F.col("n")).withColumn("_r", F.sum("risk").over(near) - F.col("risk"))
    whole = F.sum("n").over(by)
    # without a neighbour, or with none that ended: half an event, or the mean hazard of the field
    p0 = F.least(F.lit(0.5), F.greatest((F.col("_n") + 0.5) / (F.col("_r") + 1.0), F.lit(1.0) / (whole + 1.0)))
    q = F.least(F.lit(1 - 1e-9), F.col("n") / F.col("risk"))
    kl = q * F.log(q / p0) + (1 - q) * F.log((1 - q) / (1 - p0))
    tested = h.withColumn("log_p", F.when(q > p0, -F.col("risk") * kl).otherwise(0.0))
    family = Window.partitionBy("writer", "field")
    rank = F.row_number().over(family.orderBy("log_p", "unit", "length"))
    passed = F.when(F.col("log_p") <= F.log(F.lit(rate) * rank / F.count("*").over(family)), rank)
    found = tested.withColumn("_rank", rank).withColumn("_pass", passed)
    return found.withColumn("_last", F.max("_pass").over(family)).where("_rank <= _last").select("writer", "field", "unit", "length", "n", "risk", "log_p")


def _clauses(c: Column) -> Column:
    """The lines and sentences of a text, with digits as #."""
    return F.filter(F.split(F.regexp_replace(c, r"\d+", "#"), r"(?<=[.!?]) +|\n+"), lambda x: x != "")


def _form(word: Column) -> Column:
    """The form of an ending: its last word with runs of letters as a."""
    return F.regexp_replace(word, r"[\p{L}\p{M}]+", "a")


def _continued(counted: DataFrame, ends: DataFrame) -> DataFrame:
    """``key``, ``goes_on``: the occurrences of longer keys that begin with each key of ``ends``.

    ``counted`` has ``key`` and ``n``. Keys that begin with a text stand together in the sorted order, so
    the number is a difference of two running sums, taken over a range-partitioned sort.
    """
    marks = ends.select("key", F.explode(F.array(F.struct(F.col("key").alias("at"), F.lit(0).alias("side")), F.struct(F.concat("key", F.lit(_AFTER)).alias("at"), F.lit(1).alias("side")))).alias("m"))
    rows = counted.select(F.col("key").alias("at"), F.lit(-1).alias("side"), F.lit(None).cast("string").alias("key"), "n").union(marks.select("m.at", "m.side", "key", F.lit(0).cast("long")))
    blocks = sorted_blocks(rows, [], [F.col("at"), F.col("side")])
    run = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = with_offsets(blocks, block_offsets(blocks, [], F.col("n")), []).withColumn("run", F.col("_before") + F.sum("n").over(run))
    return sums.where("key is not null").groupBy("key").agg((F.max(F.when(F.col("side") == 1, F.col("run"))) - F.max(F.when(F.col("side") == 0, F.col("run")))).alias("goes_on"))


def ending_shares(texts: DataFrame) -> DataFrame:
    """``clause`` (last of a text), ``share``: how far an occurrence of this ending ends a text.

    ``texts``: clauses. Counted on whole texts, over distinct clauses: how often the clause ends a text,
    against how often it stands inside one or a longer clause begins with it; the same for its last two
    words, and for the form of its last word. The longer form starts from the share of the shorter one,
    which counts as ``PRIOR`` occurrences. So an ending that is seen nowhere else has the share of its form.
    """
    n = F.size("clauses")
    each = texts.where(n > 0).select(n.alias("n"), F.posexplode("clauses").alias("i", "clause"))
    seen = cut(each.groupBy("clause").agg(F.count_if(F.col("i") == F.col("n") - 1).alias("ends"), F.count_if(F.col("i") < F.col("n") - 1).alias("inside")))
    words = F.split(F.concat(F.lit("^ "), F.col("clause")), " +")
    last = seen.where("ends > 0").withColumn("_w", words).select("clause", "ends", "inside", F.expr("concat(_w[size(_w)-2], ' ', _w[size(_w)-1])").alias("pair"), _form(F.expr("_w[size(_w)-1]")).alias("form"))
    last = cut(last)
    # all places of all clauses: the word before and the word, and whether the text may end there
    w = seen.withColumn("_w", words)
    at = w.select("ends", "inside", F.size("_w").alias("k"), "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("i"))
    here = F.col("i") == F.col("k") - 1
    places = at.select(F.expr("concat(_w[i-1], ' ', _w[i])").alias("key"), F.expr("_w[i]").alias("word"), F.when(here, F.col("ends")).otherwise(F.lit(0)).alias("e"), (F.col("inside") + F.when(here, F.lit(0)).otherwise(F.col("ends"))).alias("g"))
    pairs = cut(places.groupBy("key", "word").agg(F.sum("e").alias("e"), F.sum("g").alias("g")))
    wanted = last.select(F.col("pair").alias("key")).distinct()
    longer2 = _continued(pairs.select("key", (F.col("e") + F.col("g")).alias("n")), wanted)
    two = pairs.join(wanted, "key", "left_semi").groupBy("key").agg(F.sum("e").alias("e"), F.sum("g").alias("g")).join(longer2, "key", "left").select(F.col("key").alias("pair"), F.col("e").alias("e2"), (F.col("g") + F.coalesce("goes_on", F.lit(0))).alias("g2"))
    forms = pairs.groupBy(_form(F.col("word")).alias("form")).agg(F.sum("e").alias("e1"), F.sum("g").alias("g1"))
    longer3 = _continued(seen.select(F.col("clause").alias("key"), (F.col("ends") + F.col("inside")).alias("n")), last.select(F.col("clause").alias("key")))
    all3 = last.join(longer3.withColumnRenamed("key", "clause"), "clause", "left").join(two, "pair", "left").join(forms, "form", "left")
    s1 = F.try_divide("e1", F.col("e1") + F.col("g1"))
    s2 = (F.col("e2") + PRIOR * s1) / (F.col("e2") + F.col("g2") + PRIOR)
    goes3 = F.col("inside") + F.coalesce("goes_on", F.lit(0))
    return all3.select("clause", ((F.col("ends") + PRIOR * s2) / (F.col("ends") + goes3 + PRIOR)).alias("share"))


def _balanced(c: Column, a: str, b: str) -> Column:
    return F.length(F.translate(c, a, "")) == F.length(F.translate(c, b, ""))


def final_answer(c: Column) -> Column:
    """The answer a whole response states last, without outer punctuation; null if none is stated."""
    tails = F.array(*[F.when(F.contains(c, F.lit(m)), F.substring_index(c, m, -1)) for m in _STATED])
    last = F.array_min(F.transform(F.array_compact(tails), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    line = F.regexp_extract(last, r"^[:\s]*([^\n]*)", 1)
    boxed = F.regexp_extract(line, r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}", 1)
    math = F.regexp_extract(line, r"^\$([^$]*)\$", 1)
    bare = F.regexp_extract(line, r"^(-?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?(?:\\sqrt\{\p{Nd}+\})?|\\frac\{\p{Nd}+\}\{\p{Nd}+\}|[(\[]-?\p{Nd}+, ?-?\p{Nd}+[)\]])", 1)
    out = F.when(boxed != "", boxed).when(math != "", math).when(bare != "", bare)
    return F.nullif(F.trim(out), F.lit(""))


def limit_marks(rows: DataFrame, limits: DataFrame, field: str) -> DataFrame:
    """``writer``, ``marks``: what a writer puts at the end of the values of this field that it cuts.

    A mark is an ending of up to ``MARK_LENGTH`` characters that at least half of the values of a significant
    length share, but next to none of the writer's values of other lengths; of several the longest. It
    must start with a character that is neither letter nor digit. Only values of significant lengths give
    candidates, at most two for each length and number of characters.
    """
    v = rows.where(F.col(f"_{field}").isNotNull()).select("writer", F.col(field).alias("value"), F.col(f"_{field}")[0].alias("n"))
    at = limits.where((F.col("field") == field) & (F.col("unit") == "chars")).select("writer", F.col("length").alias("n"))
    # equal texts, such as a stock reply, are one value
    there = v.join(bounded(at), ["writer", "n"]).distinct()
    whole = there.groupBy("writer", "n").agg(F.count("*").alias("all"))
    ends = there.select("writer", "n", F.explode(F.transform(F.sequence(F.lit(1), F.lit(MARK_LENGTH)), lambda k: F.when(F.length("value") > k, F.substring(F.col("value"), F.length("value") - k + 1, k)))).alias("mark"))
    ends = ends.where(F.col("mark").rlike(r"^[^\p{L}\p{N}]"))
    shared = ends.groupBy("writer", "n", "mark").agg(F.count("*").alias("k")).join(whole, ["writer", "n"]).where(F.col("k") >= MARKED * F.col("all")).where("all >= 3")
    few = bounded(shared.groupBy("writer").agg(F.collect_set("mark").alias("_marks")))
    have = v.join(few, "writer").join(bounded(at.withColumn("_at", F.lit(True))), ["writer", "n"], "left")
    others = have.where("_at is null").select("writer", F.explode(F.transform("_marks", lambda m: F.struct(m.alias("mark"), F.endswith(F.col("value"), m).cast("int").alias("has")))).alias("x")).groupBy("writer", "x.mark").agg(F.avg("x.has").alias("share"))
    marks = shared.select("writer", "mark").distinct().join(others, ["writer", "mark"], "left").where(F.coalesce("share", F.lit(0.0)) <= UNMARKED)
    return marks.groupBy("writer").agg(F.array_sort(F.collect_list("mark"), lambda a, b: F.length(b) - F.length(a)).alias("marks"))


def cut_values(records: DataFrame) -> DataFrame:
    """``eval_id``, ``writer``, ``field``, ``reason`` of each cut value.

    The reasons for a response: ``limit`` (its length is significant and it ends in the writer's cut mark, or
    its ending is incomplete: the ending ends few of the texts that it occurs in, or a bracket is open, or it
    ends in white space), and otherwise ``transfer`` (the ending is clearly incomplete, or open, or the stored
    prediction goes on from the number at the end). For a prediction: ``limit`` or ``transfer``, by its length,
    if the answer that its response states, or the gold answer of a record marked correct, goes on from it, or
    if its form is incomplete; at a significant length it is enough that a result of the response goes on from it.
    Null and empty values are no cases, a record delivered again is one record.
    """
    rows = measured(records)
    sig = cut(significant_lengths(rows))

    def limited(field: str) -> DataFrame:
        keys = sig.where(F.col("field") == field).groupBy("writer").agg(F.collect_set(F.concat_ws(":", "unit", F.col("length").cast("string"))).alias("_limits"))
        own = F.array(*[F.concat_ws(":", F.lit(u), F.col(f"_{field}")[k].cast("string")) for k, u in enumerate(UNITS)])
        found = rows.where(F.col(f"_{field}").isNotNull()).join(bounded(keys), "writer", "left")
        return found.withColumn("at_limit", F.coalesce(F.arrays_overlap(own, "_limits"), F.lit(False))).drop("_limits").withColumn("field", F.lit(field))

    reason = F.when(F.col("at_limit"), "limit").otherwise("transfer")
    r = limited("response").join(bounded(limit_marks(rows, sig, "response")), "writer", "left")
    mark = F.try_element_at(F.filter("marks", lambda m: F.endswith(F.col("response"), m)), F.lit(1))
    r = r.withColumn("mark", F.coalesce(mark, F.lit(""))).withColumn("bare", F.when(F.col("mark") == "", F.col("response")).otherwise(F.substring(F.col("response"), F.lit(1), F.length("response") - F.length("mark"))))
    r = cut(r.select("eval_id", "writer", "field", "at_limit", "prediction", "mark", F.substring_index("bare", "\n", -1).alias("tail"), _clauses(F.col("bare")).alias("clauses")))
    r = r.withColumn("clause", F.try_element_at("clauses", F.lit(-1))).join(ending_shares(r.select("clauses")), "clause", "left")
    tail = F.col("tail")
    answer = F.regexp_extract(tail, r"(?:####|(?i:answer\s+is):?)\s*\$?(\p{Nd}+(?:\.\p{Nd}*)?)$", 1)
    goes_on = (answer != "") & (F.length("prediction") > F.length(answer)) & F.startswith(F.col("prediction"), answer)
    open_end = tail.rlike(r"\s\z") | (tail == "") | (~_balanced(tail, "(", ")") & ~tail.rlike(r"[(\[]-?\p{Nd}+, ?-?\p{Nd}+[)\]]")) | ~_balanced(tail, "{", "}")
    marked = F.col("at_limit") & (F.col("mark") != "")
    incomplete = F.col("share") < F.when(F.col("at_limit"), COMPLETE_AT_LIMIT).otherwise(COMPLETE)
    responses = r.where(marked | F.coalesce(open_end, F.lit(False)) | F.coalesce(goes_on, F.lit(False)) | F.coalesce(incomplete, F.lit(False))).select("eval_id", "writer", "field", reason.alias("reason"))
    p = limited("prediction").withColumnRenamed("prediction", "value")
    said = final_answer(F.col("response"))
    longer = lambda c: (F.length(c) > F.length("value")) & F.startswith(c, F.col("value"))
    odd = ~_balanced("value", "{", "}") | F.col("value").rlike(r"(?:\\\p{L}*|[.,(\[\s-])$") | (F.col("value").rlike(r"^[(\[]") & ~F.col("value").rlike(r"[)\]]$"))
    result = F.exists(F.regexp_extract_all(F.coalesce("response", F.lit("")), F.lit(r"= ?(-?\p{Nd}+(?:\.\p{Nd}+)?)"), 1), longer)
    stated = F.coalesce(longer(said), F.lit(False)) | F.coalesce(F.col("correct") & longer(F.col("gold")), F.lit(False))
    predictions = p.where(stated | odd | (F.col("at_limit") & said.isNull() & result)).select("eval_id", "writer", "field", reason.alias("reason"))
    return responses.union(predictions)


def truncation_report(records: DataFrame) -> DataFrame:
    """Per writer and field: non-empty values, cut values and their rate."""
    each = F.array(*[F.when(F.col(f).isNotNull() & (F.col(f) != ""), F.lit(f)) for f in ("response", "prediction")])
    one = one_per_key(records.select("eval_id", "writer", "response", "prediction"), "eval_id")
    whole = one.select(F.coalesce(label_key("writer"), F.lit("")).alias("writer"), F.explode(F.array_compact(each)).alias("field")).groupBy("writer", "field").agg(F.count("*").alias("values"))
    cuts = cut_values(records).groupBy("writer", "field").agg(F.count("*").alias("cut"))
    return whole.join(cuts, ["writer", "field"], "left").fillna(0, ["cut"]).withColumn("rate", F.col("cut") / F.col("values"))
