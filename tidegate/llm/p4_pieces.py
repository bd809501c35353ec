"""Problem 4: items over a size limit, cut into overlapping pieces at natural boundaries.

Balanced targets: the fewest pieces that can hold the text are computed, equal targets are laid out, each target is
moved to the strongest boundary near it, and where a piece would pass the limit the whole is laid out again with one
piece more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.tokens import TOKEN_RE, token_count

#: Fixed value: a boundary lies after each of these and after white space.
MARKS = ".!?…。！？।.,;:、，；："
_BOUNDARY = re.compile(rf"(?P<blank>\n[^\S\n]*\n\s*)|(?P<line>\n[^\S\n]*)|(?P<end>[.!?…。！？।])|(?P<clause>[,;:、，；：])|(?P<space>[\u0009-\u000d\u0020\u00a0\u3000])")
_STRENGTH = {"blank": 5, "line": 4, "end": 2, "clause": 2, "space": 1}


def boundaries(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place between tokens k-1 and k (k = 1..n-1): the strength of the strongest boundary there, 0 for none.

    A sentence end followed by white space counts 3, with a line break 4, with a blank line 5; marks inside a text
    without spaces count 2 (3 for full-width sentence ends), plain spaces 1.
    """
    n = len(starts)
    strength = np.zeros(n + 1, np.int8)
    for m in _BOUNDARY.finditer(text):
        kind, end = m.lastgroup, m.end()
        k = int(np.searchsorted(starts, end))  # tokens that begin before the boundary
        if 0 < k < n:
            s = _STRENGTH[kind]
            if kind == "end" and (m[0] in "。！？।" or (text[end : end + 1].isspace())):
                s = 3
            if s > strength[k]:
                strength[k] = s
    return strength, np.flatnonzero(strength)


def lay_out(strength: np.ndarray, n: int, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces as (first token, end token, how it ends): none ends off a boundary while one is in reach."""
    if n <= limit:
        return [(0, n, "end")]
    step = limit - overlap
    least = 1 + -(-(n - limit) // step)
    places = np.flatnonzero(strength)
    for pieces in range(least, least + n):
        width = (n + (pieces - 1) * overlap) / pieces  # tokens of a piece if all are equal
        out, start, ok = [], 0, True
        for k in range(1, pieces):
            target = min(round(k * (width - overlap) + overlap), start + limit)
            reach = max(1, round(width * 0.25))
            low, high = max(start + overlap + 1, target - reach), min(start + limit, target + reach, n - 1)
            near = places[np.searchsorted(places, low) : np.searchsorted(places, high, "right")]
            if len(near):
                cut = int(near[np.lexsort((np.abs(near - target), -strength[near]))[0]])
                how = "natural"
            else:  # none near the target: the last one in reach of the limit, else a forced cut
                low, high = start + overlap + 1, min(start + limit, n - 1)
                any_ = places[np.searchsorted(places, low) : np.searchsorted(places, high, "right")]
                if len(any_):
                    cut, how = int(any_[np.argmin(np.abs(any_ - target))]), "natural"
                else:
                    cut, how = min(start + limit, n - 1), "forced"
            out.append((start, cut, how))
            start = cut - overlap
            left = pieces - k
            if n - start > limit + (left - 1) * step:  # the rest can't be held any more
                ok = False
                break
        if ok and n - start <= limit:
            return [*out, (start, n, "end")]
    raise AssertionError("no layout")  # pragma: no cover


def widest_gap(strength: np.ndarray, n: int) -> int:
    """Most tokens between two neighbouring boundaries or an end."""
    return int(np.diff(np.concatenate(([0], np.flatnonzero(strength), [n]))).max()) if n else 0


def cut_text(text: str, limit: int, overlap: int) -> tuple[int, list[tuple[int, int, int, int, str]]]:
    """Widest gap in tokens, and the pieces as (start and end character, first and end token, how it ends)."""
    spans = [m.span() for m in TOKEN_RE.finditer(text)]
    n = len(spans)
    if not n:
        return 0, []
    starts = np.fromiter((a for a, _ in spans), np.int64, n)
    strength, _ = boundaries(text, starts)
    return widest_gap(strength, n), [(spans[a][0], spans[b - 1][1], a, b, how) for a, b, how in lay_out(strength, n, limit, overlap)]


def pieces(df: DataFrame, key: str, text: str, limit: int = 200, overlap: int = 20) -> DataFrame:
    """One row per piece of each text of more than limit tokens; smaller, null and blank texts give none.

    Columns: key, piece_no (from 1), start_character, end_character, first_token (from 0), end_token, tokens,
    cut (natural, forced or end), widest_gap. Every token is in a piece, no piece passes the limit, and neighbours
    share exactly overlap tokens. A cut is forced only where no boundary lies in a piece's reach. No shuffle; the
    filter on size runs in the JVM, so short texts never reach Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    schema = "_key string, piece_no int, start_character int, end_character int, first_token int, end_token int, tokens int, cut string, widest_gap int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["_key"], batch["_text"], strict=True):
                gap, cuts = cut_text(t, limit, overlap)
                rows += [(k, i + 1, a, b, x, y, y - x, how, gap) for i, (a, b, x, y, how) in enumerate(cuts)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    long = df.where(F.length(text) > limit).where(token_count(F.col(text)) > limit).select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    return long.mapInPandas(run, schema).withColumnRenamed("_key", key)


def cut_kinds(cut: DataFrame, key: str, limit: int = 200) -> DataFrame:
    """(key, cut_kind) of each text that was cut: forced if more than limit tokens stand between two neighbouring boundaries.

    Read from widest_gap, which every piece carries, not from `cut`: with an overlap a piece may have to be cut off a
    boundary although none are further apart than limit (limit - overlap is what it reaches).
    """
    return cut.where("piece_no = 1").select(key, F.when(F.col("widest_gap") > limit, "forced").otherwise("natural").alias("cut_kind"))
