"""Text functions with Unicode white space and Python's notion of splitting, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's \s is ASCII. Fixed value.
SPACE = r"\u0009-\u000d\u001c-\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A sentence stop with closing marks behind it. Fixed value.
STOPS, CLOSERS = r".!?。！？", r"\"'»”’)*\]"


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{SPACE}]+\z", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+", "")


def strip(text: Column) -> Column:
    return lstrip(rstrip(text))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]+"))


def char_slice(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] by code points, 0-based; empty where end is not behind start."""
    return F.substring(text, start + 1, F.greatest(F.lit(0), end - start))


def normal_label(label: Column) -> Column:
    """A risk label without case and white space at the ends; `uncertain` means controversial; empty is null."""
    bare = F.lower(F.regexp_replace(label, rf"\A[{SPACE}\u200b\ufeff]+|[{SPACE}\u200b\ufeff]+\z", ""))
    return F.when(bare == "uncertain", "controversial").when(bare != "", bare)


def guard_verdict(raw: Column) -> Column:
    """The label of a guard's raw output: the last <answer> element, else a first line that names exactly one label; null if neither.

    `uncertain` means controversial; an answer that is no label is null.
    """
    answers = F.regexp_extract_all(raw, F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1))
    first_line = F.regexp_extract(lstrip(raw), r"\A([^\n]*)", 1)
    named = F.array_distinct(F.transform(F.regexp_extract_all(first_line, F.lit(r"(?i)\b(safe|unsafe|uncertain|controversial)\b"), F.lit(1)), F.lower))
    # try_element_at: an empty list has no last element
    found = F.when(F.size(answers) > 0, strip(F.lower(F.try_element_at(answers, F.lit(-1))))).when((F.size(named) == 1) & ~F.contains(first_line, F.lit("<")), F.try_element_at(named, F.lit(1)))
    label = F.when(found == "uncertain", "controversial").otherwise(found)
    return F.when(label.isin("safe", "unsafe", "controversial"), label)


def strict_label(label: Column) -> Column:
    """normal_label; a label that is none of the three fails the query, null stays null."""
    known = normal_label(label)
    return F.when(known.isNull() | known.isin("safe", "controversial", "unsafe"), known).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)))


def guard_output(level: Column, probability: Column, category: Column) -> Column:
    """(risk_label, risk_categories, confidence, error) of a guard's lists of levels, probabilities and categories, of which the last ones count.

    No level, a blank or an unknown one is an error, with a null label. A probability that is no number is null; the
    category `None`, an empty one and no category are no category.
    """
    last = lambda c: F.try_element_at(c, F.lit(-1))
    label = strip(F.lower(last(level)))
    error = F.when(level.isNull(), "missing level").when(F.size(level) == 0, "empty level").when(F.coalesce(label, F.lit("")) == "", "blank level").when(~label.isin("safe", "controversial", "unsafe"), F.concat(F.lit("unknown level: "), last(level)))
    named = last(category)
    categories = F.when(error.isNull(), F.when(named.isNull() | named.isin("", "None"), F.array().cast("array<string>")).otherwise(F.array(named)))
    return F.struct(F.when(error.isNull(), label).alias("risk_label"), categories.alias("risk_categories"), F.when(error.isNull(), last(probability).try_cast("double")).alias("confidence"), error.alias("error"))


def padded(number: Column, width: int, prefix: str = "") -> Column:
    """A whole number with zeros in front, behind a prefix."""
    return F.format_string(f"{prefix.replace('%', '%%')}%0{width}d", number)


def template(pattern: str, *columns: Column) -> Column:
    """An instruction text with %s filled."""
    return F.format_string(pattern, *columns)


def last_index_of(text: Column, needle: str) -> Column:
    """0-based position of the last occurrence, -1 if there is none."""
    at = F.locate(needle[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at - len(needle) + 1).otherwise(-1)


def whole_word_tokens(text: Column) -> Column:
    """A lossless split: a word with the white space behind it, and white space before the first word."""
    return F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]+[{SPACE}]*|\A[{SPACE}]+"), F.lit(0))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def argmax(scores: Column) -> Column:
    """0-based place of the greatest score, the first of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1
