"""Array math on next-token distributions; an array's position (from 0) is the token id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def clipped(p: Column, eps: float = EPS) -> Column:
    """Probabilities raised to at least ``eps`` and divided by their sum; null for a null or empty array."""
    c = F.transform(p, lambda x: F.greatest(x, F.lit(eps)))
    # one lambda per array: the sum is an argument, so it is computed once per row
    return F.when(F.size(p) > 0, F.element_at(F.transform(F.array(F.struct(c.alias("c"), _sum(c).alias("s"))), lambda o: F.transform(o["c"], lambda x: x / o["s"])), 1))


def softmax(logits: Column) -> Column:
    """exp(x - max) over its sum; null for a null or empty array."""
    e = F.transform(F.array(F.struct(logits.alias("l"), F.array_max(logits).alias("m"))), lambda o: F.transform(o["l"], lambda x: F.exp(x - o["m"])))[0]
    return F.when(F.size(logits) > 0, F.element_at(F.transform(F.array(F.struct(e.alias("e"), _sum(e).alias("s"))), lambda o: F.transform(o["e"], lambda x: x / o["s"])), 1))


def entropy(p: Column, eps: float = EPS) -> Column:
    """Entropy in nats of the clipped distribution."""
    return -_sum(F.transform(clipped(p, eps), lambda x: x * F.log(x)))


def kl(expert: Column, amateur: Column, mode: str = "clip") -> Column:
    """KL(expert || amateur) over the ids both have.

    ``clip``: both clipped and renormalised. ``additive``: 1e-12 added to both, no renormalisation.
    ``raw``: as they are, where a zero of the amateur gives infinity and a zero of the expert NaN.
    """
    n = F.least(F.size(expert), F.size(amateur))
    e, a = F.slice(expert, 1, n), F.slice(amateur, 1, n)
    if mode == "clip":
        e, a = clipped(e), clipped(a)
        term = lambda x, y: x * (F.log(x) - F.log(y))
    elif mode == "additive":
        term = lambda x, y: (x + EPS) * (F.log(x + EPS) - F.log(y + EPS))
    elif mode == "raw":
        term = lambda x, y: F.when(x == 0, F.lit(float("nan"))).when(y == 0, F.lit(float("inf"))).otherwise(x * (F.log(x) - F.log(y)))
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.when(n > 0, _sum(F.zip_with(e, a, term)))


def top1_id(p: Column) -> Column:
    """Least id of the greatest probability."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top2(p: Column) -> Column:
    """The two greatest: ids and probabilities, ties to the lower id; of one element the second is (null, 0). No sort."""
    first = F.struct(p.alias("p"), F.array_max(p).alias("m"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("i"))
    rest = lambda o: F.struct(o["m"].alias("m"), o["i"].alias("i"), F.filter(o["p"], lambda _, k: k != o["i"]).alias("r"))
    second = F.transform(F.transform(F.array(first), rest), lambda o: F.struct(o["m"].alias("m"), o["i"].alias("i"), F.array_max(o["r"]).alias("m2"), (F.array_position(o["r"], F.array_max(o["r"])) - 1).cast("int").alias("i2")))
    return F.transform(second, lambda o: F.struct(
        o["i"].alias("id1"), o["m"].alias("p1"), F.when(o["m2"].isNotNull(), o["i2"] + F.when(o["i2"] >= o["i"], 1).otherwise(0)).cast("int").alias("id2"), F.coalesce(o["m2"], F.lit(0.0)).alias("p2"),
    ))[0]


def top_k(p: Column, k: int) -> Column:
    """The k greatest as (id, p), ties to the lower id."""
    order = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("neg"), i.alias("id"))))
    return F.transform(F.slice(order, 1, k), lambda o: F.struct(o["id"].alias("id"), (-o["neg"]).alias("p")))


def probability_of(p: Column, token_id: Column) -> Column:
    """The probability of an id; null if the id is null or outside the array."""
    return F.when(token_id >= 0, F.try_element_at(p, (token_id + 1).cast("int")))


def distribution_features(expert: Column, amateur: Column, target: Column) -> Column:
    """The 14 features of one step as a struct.

    Both distributions are cut to the length that they have in common, clipped and renormalised once, before
    anything else; a target id beyond it has null probabilities. Null without a common id.
    """
    n = F.least(F.size(expert), F.size(amateur))
    pair = F.struct(clipped(F.slice(expert, 1, n)).alias("e"), clipped(F.slice(amateur, 1, n)).alias("a"), target.alias("t"))
    nats = lambda p: -_sum(F.transform(p, lambda x: x * F.log(x)))
    # computed once as fields of an inner struct, then combined
    base = F.transform(F.array(pair), lambda o: F.struct(
        _sum(F.zip_with(o["e"], o["a"], lambda x, y: x * (F.log(x) - F.log(y)))).alias("kl"), nats(o["e"]).alias("he"), nats(o["a"]).alias("ha"), top2(o["e"]).alias("e2"), top2(o["a"]).alias("a2"),
        probability_of(o["e"], o["t"]).alias("te"), probability_of(o["a"], o["t"]).alias("ta"),
    ))
    return F.when((n > 0) & expert.isNotNull() & amateur.isNotNull(), F.transform(base, lambda b: F.struct(
        b["kl"].alias("kl_expert_amateur"), b["he"].alias("expert_entropy"), b["ha"].alias("amateur_entropy"), (b["ha"] - b["he"]).alias("entropy_gap"),
        b["e2"]["id1"].alias("expert_top1_id"), b["a2"]["id1"].alias("amateur_top1_id"), b["e2"]["p1"].alias("expert_top1_prob"), b["a2"]["p1"].alias("amateur_top1_prob"),
        (b["e2"]["p1"] - b["e2"]["p2"]).alias("expert_top2_margin"), (b["e2"]["id1"] == b["a2"]["id1"]).alias("top1_match"), (b["e2"]["p1"] - b["a2"]["p1"]).alias("expert_amateur_top1_prob_gap"),
        b["te"].alias("target_expert_prob"), b["ta"].alias("target_amateur_prob"), (b["te"] - b["ta"]).alias("target_prob_gap"),
    ))[0])


def contrastive_target(expert: Column, amateur: Column, alpha: float = 0.2) -> Column:
    """Soft labels (token_ids ascending, weights): ids with at least ``alpha`` of the expert's maximum,
    weighted by the softmax of ln expert - ln amateur (1e-12 added to each). Null if none is kept."""
    n = F.least(F.size(expert), F.size(amateur))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(i.alias("id"), expert[i].alias("e"), amateur[i].alias("a")))
    top = F.array_max(F.slice(expert, 1, n))
    kept = F.transform(F.array(F.struct(pairs.alias("p"), top.alias("t"))), lambda o: F.filter(o["p"], lambda x: x["e"] >= alpha * o["t"]))[0]
    scores = F.transform(kept, lambda x: F.log(x["e"] + EPS) - F.log(x["a"] + EPS))
    return F.when((n > 0) & (F.size(kept) > 0), F.struct(F.transform(kept, lambda x: x["id"]).alias("token_ids"), softmax(scores).alias("weights")))


def filter_target(target: Column, max_token_id_exclusive: int | None) -> Column:
    """(token_ids, tokens, weights, dropped) with ids in [0, cutoff) only and weights renormalised.

    Without a cutoff the target stands as it is. Null if nothing is left or the weights don't sum above zero.
    """
    if max_token_id_exclusive is None:
        return F.when(target.isNotNull(), F.struct(target["token_ids"].alias("token_ids"), target["tokens"].alias("tokens"), target["weights"].alias("weights"), F.lit(0).alias("dropped")))
    zipped = F.arrays_zip(target["token_ids"].alias("i"), target["tokens"].alias("t"), target["weights"].alias("w"))
    kept = F.filter(zipped, lambda x: (x["i"] >= 0) & (x["i"] < max_token_id_exclusive))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x["w"])
    made = F.transform(F.array(F.struct(kept.alias("k"), total.alias("s"))), lambda o: F.struct(
        F.transform(o["k"], lambda x: x["i"]).alias("token_ids"), F.transform(o["k"], lambda x: x["t"]).alias("tokens"), F.transform(o["k"], lambda x: x["w"] / o["s"]).alias("weights"),
    ))[0]
    dropped = F.size(target["token_ids"]) - F.size(kept)
    return F.when((F.size(kept) > 0) & (total > 0), F.struct(made["token_ids"].alias("token_ids"), made["tokens"].alias("tokens"), made["weights"].alias("weights"), dropped.alias("dropped")))


def filtered_size(target: Column, max_token_id_exclusive: int | None) -> Column:
    """Number of target tokens that the cutoff leaves."""
    ids = target["token_ids"]
    kept = ids if max_token_id_exclusive is None else F.filter(ids, lambda x: (x >= 0) & (x < max_token_id_exclusive))
    return F.coalesce(F.size(kept), F.lit(0))


def dense_label(token_ids: Column, weights: Column, vocabulary: int) -> Column:
    """Dense vector of the vocabulary's size; the last of equal ids wins, ids outside are ignored.

    One pass over the pairs makes runs of zeros between the ids in order, so the work is that of the
    output and a sort of the few ids, not of their product.
    """
    pairs = F.transform(F.arrays_zip(token_ids.alias("i"), weights.alias("w")), lambda x, k: F.struct(x["i"].cast("int").alias("i"), k.alias("k"), x["w"].alias("w")))
    inside = F.array_sort(F.filter(pairs, lambda x: (x["i"] >= 0) & (x["i"] < vocabulary)))
    last = F.transform(F.array(inside), lambda s: F.filter(s, lambda x, k: (k == F.size(s) - 1) | (F.try_element_at(s, k + 2)["i"] != x["i"])))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    filled = F.transform(last, lambda s: F.concat(
        F.flatten(F.transform(s, lambda x, k: F.concat(zeros(x["i"] - F.when(k == 0, 0).otherwise(F.try_element_at(s, k)["i"] + 1)), F.array(x["w"])))),
        zeros(F.lit(vocabulary) - F.coalesce(F.try_element_at(s, F.lit(-1))["i"] + 1, F.lit(0))),
    ))
    return F.when(token_ids.isNotNull(), filled[0]).otherwise(zeros(F.lit(vocabulary)))


def soft_label_loss(target: Column, logits: Column) -> Column:
    """KL(target || softmax(logits)) of one row; zero target entries count zero."""
    return _sum(F.zip_with(target, softmax(logits), lambda t, q: F.when(t > 0, t * (F.log(t) - F.log(q))).otherwise(0.0)))


def padded(a: Column, length: Column, pad: int = 0) -> Column:
    """``a`` with ``pad`` on the right up to ``length``, and the mask of real positions."""
    fill = F.greatest(length - F.size(a), F.lit(0)).cast("int")
    return F.struct(F.concat(a, F.array_repeat(F.lit(pad), fill)).alias("ids"), F.concat(F.transform(a, lambda _: F.lit(1)), F.array_repeat(F.lit(0), fill)).alias("mask"))
