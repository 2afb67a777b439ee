"""Canonical forms of labels, prompt ids and texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every kind of white space, also no-break, zero-width and line separators (Java regex class).
SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{200b}-\x{200d}\x{2060}\x{feff}]"


def label_key(c: Column) -> Column:
    """What is left of a label once case, white space and punctuation are gone; null stays null.

    ``Final-answer``, `` final_answer`` and ``FinalAnswer`` share the key ``finalanswer``. A label
    without any letter or digit has the key null.
    """
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), F.lit(""))


def canonical_label(c: Column, names: list[str] | tuple[str, ...]) -> Column:
    """The member of ``names`` that ``c`` spells, else the label as it stands without outer space."""
    key = label_key(c)
    out = F.trim(c)
    for name in reversed(list(names)):
        out = F.when(key == name.replace("_", "").lower(), F.lit(name)).otherwise(out)
    return out


def squeeze(c: Column) -> Column:
    """A text without case and white space; null and blank texts are null."""
    return F.nullif(F.regexp_replace(F.lower(c), SPACE + "+", ""), F.lit(""))


_ID = (
    "^" + SPACE + r"*(\p{L}[\p{L}\p{N}]*?)[^\p{L}\p{N}]*(train|test|validation|valid|val|dev)"
    r"[^\p{L}\p{N}]*0*(\p{Nd}+)" + SPACE + "*$"
)


def prompt_key(c: Column) -> Column:
    """Key of the prompt that an id denotes; null for null or blank ids.

    An id made of data set, split and number is identified by these three, whatever the case,
    separators, padding and outer white space: ``GSM8K:train:0007`` and ``gsm8k train 7`` share a
    key. Any other value is keyed by its text without case and white space, the form that
    :func:`text_key` gives to a question, so an id that is a question meets that question.
    """
    low = F.lower(c)
    parsed = F.concat_ws(
        "-", F.regexp_extract(low, _ID, 1), F.regexp_extract(low, _ID, 2), F.regexp_extract(low, _ID, 3)
    )
    return F.when(low.rlike(_ID), F.concat(F.lit("id:"), parsed)).otherwise(text_key(c))


def text_key(c: Column) -> Column:
    """Key of a text apart from case and white space; 128 bits of hash, so of fixed size."""
    s = squeeze(c)
    return F.when(
        s.isNotNull(),
        F.concat(F.lit("t:"), F.hex(F.xxhash64(s)), F.hex(F.xxhash64(F.lit(17), F.reverse(s)))),
    )
