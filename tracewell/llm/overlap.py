"""Problem 2: the same or nearly the same records across splits.

A prefix-filter join between the evaluation and the training side on two kinds of rare shingles. The
quantities of a record, in digits or words, are an order-free shingle set whose pairs are the keys;
records with few quantities are also compared by shingles of five words, in which numbers stand in
digits. Every candidate pair is verified on the whole sets.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.labels import text_key
from tracewell.llm.lookup import looked_up
from tracewell.session import cut

#: Least Jaccard similarity of the quantities, and least containment of the five-word shingles.
QUANTITY_SIMILARITY, WORD_SIMILARITY = 0.7, 0.8
#: Least Jaccard similarity of all words of a pair whose quantities agree.
WORDING = 0.5
#: Records with up to so many quantities are compared by words too.
FEW = 3
#: Records with more quantities than this are indexed by single quantities, not pairs of them.
MANY = 64
#: A key that more evaluation records than this hold is joined together with a rare word.
HOT_KEY = 1000

# Number words.
_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_TIMES = {"dozen": 12, "hundred": 100, "thousand": 1000, "million": 1000000}

_VALUE = {w: i for i, w in enumerate(_SMALL)} | {w: 20 + 10 * i for i, w in enumerate(_TENS)}
_GROUPED = re.compile(r"(?<!\d)(\d{1,3}(?:(?:,|\{,\}|\\,|'| )\d{3})+)(?!\d)")
_HEADING = re.compile(r"^\W*(?:problem|question|exercise|example|item|task|no|nr|q|p)\W*\d+\W", re.I)
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[^\W\d_]+")


def _number(s: str) -> str:
    s = s.rstrip("0").rstrip(".") if "." in s else s
    return s.lstrip("0") or "0"


def _indexed(items: list[str]) -> list[str]:
    seen: Counter = Counter()
    out = []
    for x in items:
        seen[x] += 1
        out.append(f"{x}#{seen[x]}")
    return out


def spelled_number(words: list[str], i: int) -> tuple[int, int] | None:
    """The number that the words from ``i`` on spell, and where it ends; None if there is none.

    ``twenty five``, ``two hundred and six``, ``three thousand``, ``a dozen``, ``half a dozen``.
    """
    n = len(words)
    if words[i : i + 3] == ["half", "a", "dozen"]:
        return 6, i + 3
    start = i
    if words[i] in ("a", "an") and i + 1 < n and words[i + 1] in _TIMES:
        start = i + 1
    elif words[i] not in _VALUE and words[i] not in _TIMES:
        return None
    done, now, last = 0, 0, ""
    j = start
    while j < n:
        w = words[j]
        if w == "and" and last == "times" and j + 1 < n and words[j + 1] in _VALUE:
            j += 1
            continue
        v = _VALUE.get(w)
        if v is not None:
            if last == "small" or (last == "tens" and not 0 < v < 10):
                break
            now, last = now + v, "tens" if v >= 20 else "small"
        elif w in _TIMES:
            if last == "times" and w == "dozen":
                break
            t = _TIMES[w]
            if t >= 1000:
                done, now = done + max(now, 1) * t, 0
            else:
                now = max(now, 1) * t
            last = "times"
        else:
            break
        j += 1
    return done + now, j


def features(text: str) -> tuple[list[str], list[str], list[str], list[str], list[str]]:
    """Quantities other than one (in digits or words, with the number of their occurrence), all those in digits,
    the values of those in words, the set of words, and the five-word shingles with numbers in digits.

    A one is left out of the first, as ``one`` is mostly a pronoun; where it stands in digits it still has
    to be told on the other side.
    """
    t = unicodedata.normalize("NFKC", text).lower().replace("​", "").replace("−", "-")
    t = _HEADING.sub("", t)
    t = _GROUPED.sub(lambda m: re.sub(r"\D", "", m[0]), t)
    found = _TOKEN.findall(t)
    digits, spelled, both, words, plain = [], [], [], [], []
    i = 0
    while i < len(found):
        tok = found[i]
        if tok[0].isdigit():
            n = _number(tok)
            if i + 1 < len(found) and found[i + 1] in _TIMES and "." not in n:
                n = str(int(n) * _TIMES[found[i + 1]])
                spelled.append(n)
                words.append(found[i + 1])
                i += 1
            else:
                digits.append(n)
            both.append(n)
            plain.append(n)
            i += 1
            continue
        number = spelled_number(found, i)
        if number is None:
            words.append(tok)
            plain.append(tok)
            i += 1
            continue
        n, end = str(number[0]), number[1]
        words += found[i:end]
        spelled.append(n)
        both.append(n)
        plain.append(n)
        i = end
    shingles = sorted({" ".join(plain[k : k + 5]) for k in range(max(1, len(plain) - 4))}) if plain else []
    return _indexed([n for n in both if n != "1"]), _indexed(digits), sorted(set(spelled)), sorted(set(words)), shingles


_SETS = ("tokens", "digits", "spelled", "words", "shingles")


def _featured(classes: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([features(t) for t in f["text"]], columns=list(_SETS))
            out.insert(0, "class", f["class"].to_numpy())
            out.insert(0, "side", f["side"].to_numpy())
            yield out

    made = classes.select("side", "class", "text").mapInPandas(run, "side string, class string, " + ", ".join(f"{c} array<string>" for c in _SETS))
    # words and shingles go on as 64-bit hashes
    return made.select("side", "class", "tokens", "digits", "spelled", *[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in ("words", "shingles")])


def _rare_first(rows: DataFrame, items: str) -> DataFrame:
    """``side``, ``class``, ``s`` (items from rare to common over both sides), ``n`` of the rows with items."""
    each = rows.select("side", "class", F.explode(items).alias("item"))
    counts = cut(each.groupBy("item").agg(F.count("*").alias("df")))
    ordered = looked_up(each, counts, "item").groupBy("side", "class").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("s"))
    return ordered.select("side", "class", F.col("s.item").alias("s"), F.size("s").alias("n"))


def _quantity_keys(rows: DataFrame) -> DataFrame:
    """``side``, ``class``, ``n``, ``key``, ``p`` (position of the key's last quantity), ``l`` from the prefix.

    Two sets as similar as asked share at least ``l`` quantities in the first n - ceil(t n) + l of each; l is 2,
    so that a key is a pair of them, and 1 for very long lists. Sizes that may meet on either side of the limit
    have both kinds. Records with less than two quantities are compared by words alone.
    """
    t = QUANTITY_SIMILARITY
    rare = _rare_first(rows.where(F.size("tokens") > 1), "tokens").withColumn("prefix", F.expr(f"n - cast(ceil(round(n * {t}D, 6)) as int)"))
    one = rare.where(f"n >= {int(MANY * t)}").select("side", "class", "n", F.posexplode(F.expr("slice(s, 1, least(n, prefix + 1))")).alias("i", "key"))
    one = one.select("side", "class", "n", F.xxhash64("key", F.lit(1)).alias("key"), (F.col("i") + 1).alias("p"), F.lit(1).alias("l"))
    two = rare.where(f"n <= {MANY}").withColumn("s", F.expr("slice(s, 1, least(n, prefix + 2))"))
    pairs = F.expr("flatten(transform(s, (a, i) -> transform(slice(s, 1, i), (b, j) -> struct(least(a, b) as a, greatest(a, b) as b, i + 1 as p))))")
    two = two.select("side", "class", "n", F.explode(pairs).alias("x")).select("side", "class", "n", F.xxhash64("x.a", "x.b", F.lit(2)).alias("key"), F.col("x.p").alias("p"), F.lit(2).alias("l"))
    return one.union(two)


def _by_quantities(rows: DataFrame) -> DataFrame:
    """Candidate pairs ``a``, ``b`` whose quantities may be similar enough.

    A key that very many evaluation records hold, such as two small numbers, is joined together with a rare
    word: a pair with half of its words in common shares one within the first n - ceil(n / 2) + 1 words of each.
    """
    keys = cut(_quantity_keys(rows))
    t = QUANTITY_SIMILARITY
    hot = keys.where("side = 'eval'").groupBy("key", "l").agg(F.count("*").alias("c")).where(F.col("c") > HOT_KEY).select("key", "l")
    hot = cut(hot)

    def met(one: DataFrame, on: list[str]) -> DataFrame:
        index = one.where("side = 'eval'").select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), *on)
        probe = one.where("side = 'train'").select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), *on)
        need = f"ceil(round({t / (1 + t)}D * (na + nb), 6))"
        return probe.join(index, on).where(f"na >= {t}D * nb - 1e-6 and nb >= {t}D * na - 1e-6").where(f"l + least(na - pa, nb - pb) >= {need}").select("a", "b")

    if hot.isEmpty():
        return met(keys, ["key", "l"]).distinct()
    concerned = cut(keys.join(hot, ["key", "l"], "left_semi").select("side", "class").distinct())
    words = _rare_first(rows.where(F.size("words") > 0).join(concerned, ["side", "class"], "left_semi"), "words").select("side", "class", F.explode(F.expr("slice(s, 1, n - cast(ceil(n / 2.0) as int) + 1)")).alias("word"))
    warm = keys.join(hot, ["key", "l"], "left_semi").join(words, ["side", "class"])
    return met(keys.join(hot, ["key", "l"], "left_anti"), ["key", "l"]).union(met(warm, ["key", "l", "word"])).distinct()


def _by_words(rows: DataFrame) -> DataFrame:
    """Candidate pairs ``a``, ``b`` of records with few quantities of which one may hold the other's shingles.

    If ``WORD_SIMILARITY`` of the smaller set is in the larger, one of the smaller set's rarest
    n - ceil(t n) + 1 shingles is there; either side may be the smaller.
    """
    rare = cut(_rare_first(rows.where((F.size("tokens") <= FEW) & (F.size("shingles") > 0)), "shingles"))
    first = f"slice(s, 1, n - cast(ceil(round(n * {WORD_SIMILARITY}D, 6)) as int) + 1)"
    out = None
    for small, large, a, b in (("eval", "train", "a", "b"), ("train", "eval", "b", "a")):
        x = rare.where(F.col("side") == small).select(F.col("class").alias(a), F.col("n").alias("small"), F.explode(F.expr(first)).alias("key"))
        y = rare.where(F.col("side") == large).select(F.col("class").alias(b), F.col("n").alias("large"), F.explode("s").alias("key"))
        one = y.join(x, "key").where("small <= large").select("a", "b")
        out = one if out is None else out.union(one)
    return out.distinct()


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs that are the same problem, with ``sim``, the similarity of the quantities."""
    side = lambda s, k: rows.where(F.col("side") == s).select(F.col("class").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in _SETS])
    both = pairs.join(side("eval", "a"), "a").join(side("train", "b"), "b")
    for c in ("tokens", "words", "shingles"):
        both = both.withColumn(f"i_{c}", F.size(F.array_intersect(f"a_{c}", f"b_{c}")))
    whole = lambda c: F.size(f"a_{c}") + F.size(f"b_{c}") - F.col(f"i_{c}")
    both = both.withColumn("sim", F.coalesce(F.try_divide("i_tokens", whole("tokens")), F.lit(1.0)))
    told = "forall(array_except({0}_digits, {1}_digits), d -> array_contains({1}_spelled, substring_index(d, '#', 1)))"
    quantities = (F.col("sim") >= QUANTITY_SIMILARITY - 1e-9) & (F.least(F.size("a_tokens"), F.size("b_tokens")) > 1) & (F.col("i_words") >= WORDING * whole("words"))
    held = F.col("i_shingles") >= WORD_SIMILARITY * F.least(F.size("a_shingles"), F.size("b_shingles")) - 1e-9
    words = (F.greatest(F.size("a_tokens"), F.size("b_tokens")) <= FEW) & (F.least(F.size("a_shingles"), F.size("b_shingles")) > 0) & held
    return both.where(told.format("a", "b")).where(told.format("b", "a")).where(quantities | words)


def matched_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (``class_a`` of the evaluation side, ``class_b`` of the training side) and the membership.

    ``records``: side ('eval' or 'train'), id, text, and source if there is one. Texts equal apart from case and
    white space are one class. Null and blank texts match nothing. Evaluation prefixes are the index, training
    prefixes probe it, length and position filters drop hopeless pairs, and what is left is verified:

    * every quantity that only one side has in digits is spelled out on the other side;
    * and the quantities are similar to 0.7, with half of all words in common; or, for records with up to three
      quantities, the larger has four fifths of the smaller's five-word shingles.
    """
    source = F.col("source") if "source" in records.columns else F.lit(None).cast("string")
    member = cut(records.where("id is not null").select("side", "id", source.alias("source"), "text", text_key(F.col("text")).alias("class")).where("class is not null").dropDuplicates(["side", "id"]))
    classes = member.groupBy("side", "class").agg(F.min("text").alias("text"))
    rows = cut(_featured(classes))
    ok = _verified(_by_quantities(rows).union(_by_words(rows)).distinct(), rows)
    return ok.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "sim"), member.drop("text")


def overlapping_records(records: DataFrame) -> DataFrame:
    """``test``, ``test_source``, ``train``, ``train_source`` of every evaluation and training record that are the same problem."""
    pairs, member = matched_classes(records)
    side = lambda s, name, c: member.where(F.col("side") == s).select(F.col("id").alias(name), F.col("source").alias(f"{name}_source"), F.col("class").alias(c))
    return pairs.join(side("eval", "test", "class_a"), "class_a").join(side("train", "train", "class_b"), "class_b").select("test", "test_source", "train", "train_source").distinct()


def overlapping_pairs(records: DataFrame) -> DataFrame:
    """``id_a`` < ``id_b`` of every evaluation and training record that are the same problem."""
    return overlapping_records(records).select(F.least("test", "train").alias("id_a"), F.greatest("test", "train").alias("id_b")).distinct()


def overlap_report(found: DataFrame) -> DataFrame:
    """Pairs and distinct records per source of the evaluation and of the training side, from :func:`overlapping_records`."""
    by = found.groupBy(F.col("test_source").alias("test_dataset"), F.col("train_source").alias("train_dataset"))
    return by.agg(F.count("*").alias("pairs"), F.countDistinct("test").alias("test_records"), F.countDistinct("train").alias("train_records"))
