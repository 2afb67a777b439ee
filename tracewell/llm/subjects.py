"""Problem 10: the subject areas of each document.

A document is a mixture of passages, so its parts (sentences, lines, members of a configuration) are
the items. Equal parts, apart from names and numbers, are one shape. A shape's vector holds its own
words and, twice as much, the words of the parts it stands beside more often than chance would have
it, so that wordings of one subject lie together even if they share no word, and parts that stand
beside everything tell nothing. Bisecting k-means over the shapes of all documents gives the leaves.
A leaf is labelled by its discriminative terms, as the labelled examples tell them, together with
those of the mixture of leaves around it, and is then held against the labels of that mixture. A document has the subjects of the leaves that it mixes.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tracewell.llm.lookup import looked_up
from tracewell.session import cut, ensure_checkpoint_dir

#: Leaves of the clustering, passes per bisection, and dimensions that words are hashed into.
LEAVES, PASSES, DIMENSIONS = 512, 5, 2048
#: Parts on either side that count as the surroundings, their rarest words that are used, and the weight of the surroundings.
NEAR, RAREST, SURROUNDINGS = 2, 3, 2.0
#: Added to the times that two parts would stand together by chance, so that a single time tells little.
PRIOR = 0.5
#: Weight of what the terms of the leaves around a leaf tell; its own have 1.
AROUND = 2.0
#: A word tells a subject by its share of the examples with the word beyond this one.
CHANCE = 0.3
#: A leaf is labelled by its terms if these tell so much and the first subject has this share of what they tell.
LEAST_TOLD, LEAST_PURITY = 0.12, 0.6
#: A leaf without a label gets that of its surroundings if this part of them is labelled and this share of these agrees.
LEAST_AROUND, LEAST_AGREED = 0.25, 0.7
#: A label is dropped if fewer of the surroundings have one, or agree, and changed if so many agree on another.
LONELY, DIVIDED, OUTVOTED = 0.1, 0.35, 0.8
#: Rounds of labelling by surroundings.
ROUNDS = 3
#: Shapes of one subject that a passage holds at least.
LEAST_SHAPES = 2

_BREAK = r"[.!?]+\s+|[\r\n]+(?!\s*\p{Ll})|,\s*(?=\x22)"
_MARKERS = r"<\|[^|>]*\|>|\[UNK\]|</?s>|[\x{200b}-\x{200d}\x{2060}\x{feff}]"
#: Words by which a part is read as German, where a capital doesn't tell a name.
GERMAN = r"(?i)\b(?:der|das|und|dem|ein|eine|je|für|mit|wird|hat)\b"


def parts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``id``, ``at``, ``part`` (numbers masked) and ``part_key`` for each part of a text.

    Null texts give no row. Texts are read whole; a line break before a lower-case word is layout.
    ``part_key`` is a 64-bit hash.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.posexplode(F.split(text, _BREAK)).alias("at", "part"))
    masked = rows.select("id", "at", F.regexp_replace("part", r"\d+", "#").alias("part"))
    return masked.withColumn("part_key", F.xxhash64("part"))


def _capital(w: Column) -> Column:
    first = F.substring(w, 1, 1)
    return first != F.lower(first)


def shapes_of(distinct_parts: DataFrame) -> DataFrame:
    """``part_key``, ``shape`` (a 64-bit hash), ``words`` (sorted, distinct) of distinct parts.

    Capitalised words inside a part are names and are left out, but in German; the first word of a
    part is kept if the corpus has it in lower case inside parts at least as often as capitalised.
    Parts without words are left out.
    """
    text = F.regexp_replace("part", _MARKERS, " ")
    w = distinct_parts.select("part_key", text.alias("part")).select("part_key", F.regexp_extract_all("part", F.lit(r"[\p{L}_]{2,}"), 0).alias("w"), F.col("part").rlike(GERMAN).alias("german"))
    w = cut(w.where(F.size("w") > 0))
    inner = w.where("not german").select(F.explode(F.slice("w", 2, 1 << 30)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    cap = _capital(F.col("word"))
    usual = inner.groupBy(F.lower("word").alias("first")).agg(F.sum(F.when(~cap, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(cap, F.col("n")).otherwise(0)).alias("cap")).where("low >= 1 and low >= cap")
    first = w.withColumn("first", F.lower(F.element_at("w", 1))).join(usual.select("first", F.lit(True).alias("usual")), "first", "left")
    keep = F.filter("w", lambda x, i: F.col("german") | ~_capital(x) | ((i == 0) & F.coalesce("usual", F.lit(False))))
    words = F.array_sort(F.array_distinct(F.transform(keep, F.lower)))
    return first.select("part_key", words.alias("words")).where(F.size("words") > 0).withColumn("shape", F.xxhash64(F.array_join("words", " ")))


def surroundings(placed: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """``a``, ``b``, ``n``: by how much shape b stands within ``NEAR`` parts of shape a beyond chance, both ways.

    The root of the count times the log of its ratio to the count expected of two shapes of these sizes;
    pairs that are no commoner than expected are left out. If the whole corpus is repeated, the pairs keep
    their proportions but for ``PRIOR``.
    """
    order = Window.partitionBy("id").orderBy("at")
    ahead = placed.select(F.col("shape").alias("a"), *[F.lead("shape", k).over(order).alias(f"_{k}") for k in range(1, NEAR + 1)])
    near = ahead.select("a", F.explode(F.array(*[f"_{k}" for k in range(1, NEAR + 1)])).alias("b")).where("b is not null")
    one_way = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    for side in ("a", "b"):
        one_way = looked_up(one_way, sizes.select(F.col("shape").alias(side), F.col("n").alias(f"_{side}")), side)
    # a part has NEAR parts on either side
    chance = F.col("_a") * F.col("_b") * (2.0 * NEAR / total)
    beyond = one_way.withColumn("n", F.sqrt("n") * F.log(F.col("n") / (chance + PRIOR))).where("n > 0")
    return beyond.select(both.alias("p"), "n").select("p.a", "p.b", "n")


def _vectors(terms: DataFrame, pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``shape``, ``weight``, ``features``: the normalised vectors, stored in the checkpoint folder.

    Words are hashed into signed buckets before they are summed, so a row has at most ``DIMENSIONS`` entries.
    """
    bucket = F.pmod(F.xxhash64("word"), F.lit(DIMENSIONS)).cast("int").alias("bucket")
    sign = F.when(F.pmod(F.xxhash64("word", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    own = terms.select("shape", bucket, (sign * F.col("x")).alias("own"), F.lit(0.0).alias("ctx"))
    rarest = terms.where(F.col("place") <= RAREST).select(F.col("shape").alias("b"), bucket, (sign * F.col("x_rare")).alias("x"))
    ctx = pairs.join(rarest, "b").groupBy(F.col("a").alias("shape"), "bucket").agg(F.sum(F.col("n") * F.col("x")).alias("ctx"))
    both = own.union(ctx.select("shape", "bucket", F.lit(0.0).alias("own"), "ctx")).groupBy("shape", "bucket").agg(F.sum("own").alias("own"), F.sum("ctx").alias("ctx"))
    rows = both.groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("bucket", "own", "ctx"))).alias("e"), F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("no"), F.sqrt(F.sum(F.col("ctx") * F.col("ctx"))).alias("nc"))
    x = F.transform("e", lambda e: e["own"] / F.greatest("no", F.lit(1e-9)) + F.lit(SURROUNDINGS) * e["ctx"] / F.greatest("nc", F.lit(1e-9)))
    rows = rows.select("shape", F.transform("e", lambda e: e["bucket"]).alias("i"), x.alias("x")).withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)))
    unit = F.transform("x", lambda v: v / F.greatest("norm", F.lit(1e-9)))
    # a sparse vector is stored as this struct, so the table read again with the vector type needs no Python
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(DIMENSIONS).alias("size"), F.col("i").alias("indices"), unit.alias("values"))
    spark = terms.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/vectors-{uuid.uuid4().hex}"
    rows.join(sizes, "shape").select("shape", F.sqrt("n").alias("weight"), vector.alias("features")).write.parquet(path)
    return spark.read.schema(StructType([StructField("shape", LongType()), StructField("weight", DoubleType()), StructField("features", VectorUDT())])).parquet(path)


def telling_words(examples: DataFrame) -> DataFrame:
    """``word``, ``subject``, ``tells``: the share of the examples with the word that has the subject, beyond ``CHANCE``.

    ``examples``: text_key, subject, word, w (1 / number of the text's subjects).
    """
    by = examples.groupBy("word", "subject").agg(F.sum("w").alias("v"))
    whole = by.groupBy("word").agg(F.sum("v").alias("all"))
    tells = (F.col("v") + 0.05) / (F.col("all") + 0.5) - CHANCE
    return by.join(whole, "word").select("word", "subject", tells.alias("tells")).where("tells > 0")


def term_labels(scores: list[tuple[int, str, float]]) -> dict[int, str]:
    """Labels of the leaves whose discriminative terms tell enough, from (leaf, subject, told)."""
    by: dict[int, dict[str, float]] = defaultdict(dict)
    for leaf, subject, told in scores:
        by[leaf][subject] = told
    out = {}
    for leaf, v in by.items():
        best = max(sorted(v), key=lambda s: v[s])
        if v[best] >= LEAST_TOLD and v[best] >= LEAST_PURITY * sum(v.values()):
            out[leaf] = best
    return out


def told_around(scores: list[tuple[int, str, float]], beside: list[tuple[int, int, float]]) -> list[tuple[int, str, float]]:
    """What the terms of each leaf tell and, ``AROUND`` times, what those of the mixture of leaves around it tell."""
    told: dict[int, dict[str, float]] = defaultdict(dict)
    for leaf, subject, v in scores:
        told[leaf][subject] = v
    whole: dict[int, float] = defaultdict(float)
    for leaf, _, n in beside:
        whole[leaf] += n
    both: dict[tuple[int, str], float] = defaultdict(float, {(leaf, subject): v for leaf, subject, v in scores})
    for leaf, other, n in beside:
        for subject, v in told.get(other, {}).items():
            both[leaf, subject] += AROUND * v * n / whole[leaf]
    return [(leaf, subject, v) for (leaf, subject), v in both.items()]


def settled_labels(labels: dict[int, str], beside: list[tuple[int, int, float]]) -> dict[int, str]:
    """Labels after the rounds that hold each leaf against the leaves around it, from (leaf, other leaf, n)."""
    subjects = sorted(set(labels.values()))
    if not subjects or not beside:
        return labels
    at = {s: i for i, s in enumerate(subjects)}
    a, b, n = (np.array(x) for x in zip(*beside, strict=True))
    leaves = int(max(a.max(), b.max(), *labels)) + 1
    whole = np.bincount(a, n, leaves)
    for _ in range(ROUNDS):
        mark = np.array([at.get(labels.get(leaf, ""), len(subjects)) for leaf in range(leaves)])
        near = np.zeros((leaves, len(subjects) + 1))
        np.add.at(near, (a, mark[b]), n)
        known = near[:, :-1].sum(1)
        share = near[:, :-1].max(1) / np.maximum(known, 1)
        part = known / np.maximum(whole, 1)
        new = dict(labels)
        for leaf in range(leaves):
            if known[leaf] < 5:
                continue
            top = subjects[int(near[leaf, :-1].argmax())]
            if leaf not in labels:
                if part[leaf] >= LEAST_AROUND and share[leaf] >= LEAST_AGREED:
                    new[leaf] = top
            elif share[leaf] < DIVIDED or part[leaf] < LONELY:
                del new[leaf]
            elif share[leaf] >= OUTVOTED:
                new[leaf] = top
        if new == labels:
            break
        labels = new
    return labels


def shape_subjects(documents: DataFrame, examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``shape`` of all parts of all documents) and (``shape``, ``subject``) of the shapes in labelled leaves.

    The driver holds what the leaves bound: a score per leaf and subject and a count per pair of leaves.
    """
    spark = documents.sparkSession
    found = cut(parts(documents, "doc_id"))
    ex = examples.where("text is not null and subject is not null").select("subject", "text").distinct()
    ex_parts = parts(ex.select(F.xxhash64("text").alias("t"), "text").dropDuplicates(["t"]), "t")
    both = found.select("part_key", "part").union(ex_parts.select("part_key", "part")).dropDuplicates(["part_key"])
    table = cut(shapes_of(both))
    narrow = cut(table.select("part_key", "shape"))
    placed = cut(looked_up(found.select("id", "at", "part_key"), narrow, "part_key").select("id", "at", "shape"))
    none = placed.select("id", "shape"), spark.createDataFrame([], "shape long, subject string")
    sizes = cut(placed.groupBy("shape").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return none
    words = table.dropDuplicates(["shape"]).join(sizes, "shape").select("shape", "n", F.explode("words").alias("word"))
    df = words.groupBy("word").agg((F.log(F.lit(float(total + 1)) / (F.sum("n") + 1.0))).alias("idf"))
    rare = Window.partitionBy("shape").orderBy(F.col("idf").desc(), "word")
    t = words.join(df, "word").withColumn("place", F.row_number().over(rare)).withColumn("sq", F.col("idf") * F.col("idf"))
    t = t.withColumn("norm", F.sqrt(F.sum("sq").over(Window.partitionBy("shape")))).withColumn("norm_rare", F.sqrt(F.sum(F.when(F.col("place") <= RAREST, F.col("sq"))).over(Window.partitionBy("shape"))))
    terms = cut(t.select("shape", "word", "n", "place", F.try_divide("idf", "norm").alias("x"), F.try_divide("idf", "norm_rare").alias("x_rare")).fillna(0.0, ["x", "x_rare"]))
    pairs = cut(surroundings(placed, sizes, total))
    vectors = _vectors(terms, pairs, sizes)
    model = BisectingKMeans(k=LEAVES, maxIter=PASSES, seed=3, weightCol="weight", minDivisibleClusterSize=4.0).fit(vectors)
    leaves = cut(model.transform(vectors).select("shape", F.col("prediction").alias("leaf")))
    # the discriminative terms of a leaf: its words by weight and by how far they exceed the mean of all leaves
    per_leaf = terms.join(leaves, "shape").groupBy("leaf", "word").agg(F.sum(F.log1p("n") * F.col("x")).alias("m"))
    share = per_leaf.withColumn("m", F.try_divide("m", F.sum("m").over(Window.partitionBy("leaf"))))
    mean = share.groupBy("word").agg((F.sum("m") / float(max(1, leaves.select("leaf").distinct().count()))).alias("mean"))
    excess = share.join(mean, "word").withColumn("d", F.col("m") * F.greatest(F.lit(0.0), F.log(F.try_divide("m", "mean")))).withColumn("d", F.try_divide("d", F.sum("d").over(Window.partitionBy("leaf"))))
    k = ex.groupBy(F.xxhash64("text").alias("id")).agg(F.count_distinct("subject").alias("k"))
    heard = ex.select(F.xxhash64("text").alias("id"), "subject").join(k, "id").join(ex_parts.select("id", "part_key"), "id").join(table, "part_key")
    heard = heard.select("id", "subject", (1.0 / F.col("k")).alias("w"), F.explode("words").alias("word")).distinct()
    scores = excess.join(telling_words(heard), "word").groupBy("leaf", "subject").agg(F.sum(F.col("d") * F.col("tells")).alias("told"))
    of = lambda c: leaves.select(F.col("shape").alias(c), F.col("leaf").alias(f"leaf_{c}"))
    beside = pairs.join(of("a"), "a").join(of("b"), "b").groupBy("leaf_a", "leaf_b").agg(F.sum("n").alias("n")).toPandas()
    beside = list(beside.itertuples(index=False, name=None))
    own = [(r["leaf"], r["subject"], r["told"]) for r in scores.where("told > 0").collect()]
    labels = settled_labels(term_labels(told_around(own, beside)), beside)
    named = spark.createDataFrame(sorted(labels.items()), "leaf int, subject string")
    return placed.select("id", "shape"), cut(leaves.join(F.broadcast(named), "leaf").select("shape", "subject"))


def document_subjects(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """``doc_id``, ``subject`` for every subject that the document's mixture of leaves holds.

    A subject needs ``LEAST_SHAPES`` different parts from leaves of that label, so that a stray word or
    figure of speech doesn't count. Repeated parts of a document count once. Null, blank and wordless
    texts have no subject; without documents, examples or labelled leaves the result is empty.
    """
    placed, told = shape_subjects(documents, examples)
    per = looked_up(placed.distinct(), told, "shape").groupBy("id", "subject").agg(F.count("*").alias("n"))
    return per.where(F.col("n") >= LEAST_SHAPES).select(F.col("id").alias("doc_id"), "subject")


def subject_report(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``subject``, ``documents``: documents per subject; null stands for documents without one."""
    all_docs = documents.select("doc_id").distinct().join(found, "doc_id", "left")
    return all_docs.groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"))
