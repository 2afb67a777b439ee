"""Problem 4: a sample whose cells have target shares and minimum sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.labels import label_key
from tracewell.operators.ranking import ranked
from tracewell.operators.records import one_per_key
from tracewell.session import bounded


def candidate_cells(records: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct candidates (``candidate_id``, ``cell``), and the targets with ``cell``, ``available`` and ``size`` s.

    ``cell`` is the pair of label keys, null for a candidate without one of the two labels.
    s = floor(distinct candidates / 8), over all candidates, with and without a cell.
    """
    cell = lambda a, b: F.concat_ws("/", label_key(a), label_key(b))
    a, b = F.col("token_features.token_category"), F.col("step_features.step_type")
    rows = one_per_key(records.select("candidate_id", F.when(a.isNotNull() & b.isNotNull(), cell(a, b)).alias("cell")), "candidate_id")
    t = targets.where("token_category is not null and step_type is not null").select("token_category", "step_type", "target_share", "min_rows")
    t = t.withColumn("cell", cell(F.col("token_category"), F.col("step_type")))
    # one row per label pair, also for the targets without candidates, so that the whole is a sum over few rows
    counts = rows.groupBy("cell").agg(F.count("*").alias("n")).union(t.select("cell", F.lit(0).cast("long"))).groupBy("cell").agg(F.sum("n").alias("available"))
    counts = counts.withColumn("size", F.floor(F.sum("available").over(Window.partitionBy(F.lit(0))) / 8))
    return rows, t.join(counts, "cell")


def _wanted() -> Column:
    return F.greatest("min_rows", F.ceil(F.col("target_share") * F.col("size")).cast("long"))


def cell_report(targets: DataFrame) -> DataFrame:
    """Per target cell: ``wanted`` = max(min_rows, ceil(share x s)), ``available``, ``short``."""
    return targets.withColumn("wanted", _wanted()).withColumn("short", F.col("available") < F.col("wanted"))


#: Parts of one row in which inclusion probabilities are counted, so that all sums are whole numbers.
UNIT = 1 << 20


def expected_sizes(report: DataFrame) -> DataFrame:
    """The report's cells with rows, with ``units``: the rows expected of each, in parts of 1 / ``UNIT``.

    A cell gives share x size rows. A cell with fewer gives all of them, and what it can't give is spread over
    the others in proportion to their shares, so the sample has its size as long as there are enough rows.
    Cells fill up in order of rows for their share, so windows over the cells (one per target) do all rounds.
    """
    cells = report.where("available > 0 and target_share > 0").select("cell", "available", "min_rows", "target_share", "size")
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("available") / F.col("target_share"), "cell")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.col("size") - F.coalesce(F.sum("available").over(before), F.lit(0))
    rest = F.sum("target_share").over(whole) - F.coalesce(F.sum("target_share").over(before), F.lit(0.0))
    c = cells.withColumn("_full", F.col("available") * rest <= left * F.col("target_share")).withColumn("_full", F.min("_full").over(order))
    c = c.withColumn("_left", F.col("size") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("available"))).over(whole), F.lit(0)))
    c = c.withColumn("_rest", F.sum(F.when(~F.col("_full"), F.col("target_share"))).over(whole))
    rows = F.when(F.col("_full"), F.col("available").cast("double")).otherwise(F.greatest(F.lit(0.0), F.try_divide(F.col("_left") * F.col("target_share"), "_rest")))
    return c.select("cell", "available", "min_rows", F.least(F.floor(rows * UNIT), F.col("available") * UNIT).cast("long").alias("units"))


def draw_sample(rows: DataFrame, report: DataFrame, seed: int = 11) -> DataFrame:
    """``candidate_id``, ``cell`` of a systematic unequal-probability sample with the floors repaired.

    Rows stand in order of cell and, within it, of a hash; every row of a cell has the same inclusion
    probability (:func:`expected_sizes`). One random start and the running sum of the probabilities, both in
    whole units, select the rows at which the sum crosses a whole row. Cells below what the report wants of
    them (the minimum, or the share rounded up) then get their next rows in hash order, as far as there are
    any, so only a cell with too few rows stays below. The report has one row per target; targets of one
    cell count together.
    """
    floors = report.withColumn("min_rows", _wanted())
    report = floors.groupBy("cell").agg(F.max("available").alias("available"), F.max("min_rows").alias("min_rows"), F.sum("target_share").alias("target_share"), F.max("size").alias("size"))
    before = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = bounded(expected_sizes(report).withColumn("base", F.coalesce(F.sum("units").over(before), F.lit(0))))
    minimal = report.where("available > 0 and coalesce(target_share, 0) <= 0").select("cell", "available", "min_rows", F.lit(0).cast("long").alias("units"), F.lit(0).cast("long").alias("base"))
    cells = F.broadcast(cells.union(minimal))  # one row per target
    start = F.pmod(F.xxhash64(F.lit(seed)), F.lit(UNIT))
    framed = ranked(rows.where("cell is not null").join(cells.select("cell"), "cell", "left_semi"), ["cell"], [F.xxhash64(F.lit(seed), "candidate_id"), F.col("candidate_id")])
    hit = framed.join(cells, "cell").withColumn("_start", start)
    crossed = lambda k: f"floor((_start + base + (cast({k} as decimal(19,0)) * cast(units as decimal(19,0))) div cast(available as decimal(19,0))) / {UNIT})"
    hit = hit.withColumn("_to", F.expr(crossed("position"))).withColumn("_from", F.expr(crossed("(position - 1)"))).withColumn("_none", F.expr(crossed("0"))).withColumn("picked", F.col("_to") > F.col("_from"))
    got = hit.where("picked").groupBy("cell").agg(F.count("*").alias("got"))
    # repair: the first rows in hash order that the crossings left out; their rank among those follows from the crossings so far
    fixed = hit.join(bounded(got), "cell", "left").withColumn("_left_out", F.col("position") - (F.col("_to") - F.col("_none")))
    need = F.greatest(F.lit(0), F.col("min_rows") - F.coalesce("got", F.lit(0)))
    return fixed.where(F.col("picked") | (F.col("_left_out") <= need)).select("candidate_id", "cell", "picked").withColumnRenamed("picked", "systematic")


def unmet_cells(sample: DataFrame, report: DataFrame) -> DataFrame:
    """The targets of which the sample holds fewer rows than wanted."""
    return sample_report(sample, report).where("drawn < wanted")


def sample_report(sample: DataFrame, report: DataFrame) -> DataFrame:
    """The cell report with the rows drawn and the share reached."""
    got = sample.groupBy("cell").agg(F.count("*").alias("drawn"))
    whole = F.sum("drawn").over(Window.partitionBy(F.lit(0)))  # one row per target
    return report.join(got, "cell", "left").fillna(0, ["drawn"]).select("token_category", "step_type", "target_share", "min_rows", "wanted", "available", "short", "drawn", F.try_divide(F.col("drawn"), whole).alias("share"))
