"""Text classifiers and answer extraction as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers, units and cue words of the token and step categories.
FINAL_MARKERS = ("####", "boxed", "final answer", "answer is")
UNITS = ("$", "%", "cent", "cents", "dollar", "dollars", "kg", "g", "cm", "mm", "meter", "meters", "mile", "miles", "hour", "hours", "minute", "minutes")
OPERATORS = ("+", "-", "*", "/", "^", "<", ">")
SETUP_CUES = ("let", "suppose", "we need", "given", "define", "denote", "total number", "cost", "rate", "assume")
TRANSFORMATION_CUES = ("so", "therefore", "then", "thus", "which means", "simplify", "substitute", "rearrange", "combine")
VERIFICATION_CUES = ("check", "verify", "since", "because", "confirm")
ARTIFACTS = {"ager": r"\bager\w*", "highlight": r"\bhighlight\b"}
#: Digits in the sense of Unicode's digit property: decimal, superscript, subscript and circled ones.
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]"
BLANK = r"(?U)[\s\x1c-\x1f]"
NUMBER = r"-?\$?\d[\d,]*(?:\.\d+)?"


def _any_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(w.replace("$", r"\$") for w in words) + ")"


def strip(c: Column) -> Column:
    """``c`` without white space at its ends, any kind of it."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def classify_token(token: Column) -> Column:
    """One of eleven categories; the first that holds. Units are found as substrings, also the letter g,
    so ``going`` and ``percent`` are units. Null has the category other."""
    s = strip(token)
    return (
        F.when(token.isNull() | (token == ""), "other")
        .when(token.contains("\n"), "newline")
        .when(s == "", "space")
        .when(token.rlike("(?i)" + _any_of((*FINAL_MARKERS, "therefore"))), "final_answer_marker")
        .when(token.rlike("(?i)" + _any_of(UNITS)), "currency_or_unit")
        .when(s.rlike(DIGIT), "number")
        .when(s.isin("=", "=="), "equals")
        .when(s.isin(*OPERATORS), "operator")
        .when(s.rlike("^[A-Za-z]$"), "variable")
        .when(~s.rlike(r"[\p{L}\p{N}]"), "punctuation")
        .when(s.rlike(r"\p{L}"), "word")
        .otherwise("other")
    )


def classify_step(prefix: Column, token: Column, window: int = 240) -> Column:
    """(step_type, step_type_confidence) of the last ``window`` characters before a token, with the token."""
    recent = F.when(F.length(prefix) > window, F.substr(prefix, F.length(prefix) - window + 1)).otherwise(F.coalesce(prefix, F.lit("")))
    t = F.lower(F.concat(recent, F.coalesce(token, F.lit(""))))
    cue = lambda words: r"\b" + _any_of(words) + r"\b"
    kinds = (
        ("final_answer", 0.85, _any_of(FINAL_MARKERS)),
        ("calculation", 0.75, r"\d[\d,.\s]*(?:[-+*/=%^]| times | divided by | equals )"),
        ("setup", 0.70, cue(SETUP_CUES)),
        ("transformation", 0.65, cue(TRANSFORMATION_CUES)),
        ("verification", 0.60, cue(VERIFICATION_CUES)),
    )
    out = F.struct(F.lit("other").alias("step_type"), F.lit(0.30).alias("step_type_confidence"))
    for name, confidence, pattern in reversed(kinds):
        out = F.when(t.rlike(pattern), F.struct(F.lit(name).alias("step_type"), F.lit(confidence).alias("step_type_confidence"))).otherwise(out)
    return out


def for_matching(c: Column) -> Column:
    """Lower case with runs of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), rf"{BLANK}+", " "))


def degeneration_reasons(generation: Column, question: Column, system_prompt: Column) -> Column:
    """Why a generation counts as degenerate, in a fixed order; an empty array if it doesn't.

    Null counts as empty text. The whole text is searched.
    """
    raw = F.coalesce(generation, F.lit(""))
    g, q, s = for_matching(raw), F.coalesce(for_matching(question), F.lit("")), F.coalesce(for_matching(system_prompt), F.lit(""))
    lines = F.filter(F.transform(F.split(raw, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip), lambda x: F.length(x) >= 24)
    keys = F.transform(lines, for_matching)
    repeated = F.exists(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x == k)) >= 3)
    checks = [
        (g == "", "empty_generation"),
        ((s != "") & F.contains(g, F.substring(s, 1, 80)), "copies_system_prompt"),
        ((F.length(q) >= 80) & F.contains(g, F.substring(q, 1, 80)), "copies_question"),
        *[(F.regexp_count(g, F.lit(p)) >= 3, f"repeated_artifact:{n}") for n, p in ARTIFACTS.items()],
        (g.rlike(r"\b([a-zA-Z]{3,})\b(?:\s+\1\b){4,}"), "repeated_word"),
        (repeated, "repeated_line"),
    ]
    return F.array_compact(F.array(*[F.when(c, n) for c, n in checks]))


def normalize_answer(c: Column) -> Column:
    """Without commas, dollar and per cent signs, ending dots and outer white space."""
    return strip(F.regexp_replace(F.translate(strip(c), ",$%", ""), r"\.+$", ""))


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def gold_answer(c: Column) -> Column:
    """The text after the last ``####``, else the last number, else an empty text."""
    tail = F.element_at(F.split(c, "####"), -1)
    number = _last(F.regexp_extract_all(F.translate(c, ",", ""), F.lit(r"-?\d+(?:\.\d+)?"), 0))
    return F.when(c.contains("####"), normalize_answer(tail)).when(c.isNotNull(), F.coalesce(normalize_answer(number), F.lit("")))


def predicted_answer(c: Column) -> Column:
    """The answer a response gives: first box, else last ``answer is`` number, else last ``####`` number, else last number."""
    box = F.nullif(strip(F.regexp_extract(c, r"\\boxed\{([^{}]+)\}", 1)), F.lit(""))
    said = _last(F.regexp_extract_all(c, F.lit(rf"(?i)(?:final answer|answer is)\s*[:=]?\s*({NUMBER})"), 1))
    marked = _last(F.regexp_extract_all(c, F.lit(rf"####\s*({NUMBER})"), 1))
    number = _last(F.regexp_extract_all(c, F.lit(NUMBER), 0))
    return F.when(c.isNotNull(), F.coalesce(normalize_answer(F.coalesce(box, said, marked, number)), F.lit("")))


def manual_answer(c: Column) -> Column:
    """The variant of the manual check: first box of anything but a closing brace, else last number, not normalised."""
    box = F.regexp_extract(c, r"\\boxed\{([^}]+)\}", 1)
    number = _last(F.regexp_extract_all(c, F.lit(r"-?\d+\.?\d*"), 0))
    return F.when(c.rlike(r"\\boxed\{([^}]+)\}"), strip(box)).when(c.isNotNull(), F.coalesce(number, F.lit("")))


def perplexity_gold(c: Column) -> Column:
    """Gold answer of the perplexity samples: after the last ``####`` or the whole, without leading dollar signs."""
    return strip(F.regexp_replace(strip(F.element_at(F.split(c, "####"), -1)), r"^\$+", ""))


def safe_name(c: Column) -> Column:
    """A name usable as a file name: lower case, spaces and dashes as underscores."""
    return F.translate(F.lower(c), " -", "__")
