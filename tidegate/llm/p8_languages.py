"""Problem 8: the language of every text and of every segment of a mixed one, with a confidence.

Sparse multinomial logistic regression on TF-IDF character n-grams (1 to 3, hashed), trained with
follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled rows, then calibrated with a
temperature on held-out sentences. Document frequencies are counted over all documents. A text is classified by
sentence unit; a Viterbi pass over the units of a text decides where the language changes. What stands in quotation
marks inside a sentence doesn't decide its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.sentences import sentence_spans

DIM_BITS = 17
NO_LANGUAGE = "zxx"
_SLICE = 1 << 18
_MOST_CODES = 10_000

_LETTER, _HEAD, _CHARACTER = 1, 2, 4  # classes of code points: letters and their marks, letters, characters that are words
#: No words: hexadecimal numbers, tags, JSON keys and the like.
_NOISE = re.compile(r"0x[0-9a-fA-F]+|<(\p{L}+)>[^<\n]{0,40}</\1>|</?\p{L}+>|\"\w\":|https?://\S+|^\s*(?:\d{1,3}[.)]|\[\d+\]|\p{L}{1,9}:(?=\s))", re.M)
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|»[^«]*«|「[^」]*」|『[^』]*』|\"[^\"]*\"|\([^()]*\)|（[^（）]*）")
_DENSE = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_WORD = re.compile(r"\p{L}[\p{L}\p{M}]+|[\p{Han}\p{Hiragana}\p{Katakana}]")
_QUOTES = frozenset('"“„«»「『(（')
_SCRIPTS = {"Latn": re.compile(r"\p{Latin}"), "Cyrl": re.compile(r"\p{Cyrillic}"), "Hani": re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]"), "Deva": re.compile(r"\p{Devanagari}"), "Thai": re.compile(r"\p{Thai}")}


def language_label(label: Column, codes: DataFrame) -> Column:
    """A label as code: codes, ISO 639-3, names and locales are understood, `mul` stays, everything else is null.

    codes: code, iso3, name; a short list kept by hand, so it becomes part of the expression.
    """
    known: dict[str, str] = {"mul": "mul"}
    rows = codes.select("code", "iso3", "name").limit(_MOST_CODES + 1).collect()
    if len(rows) > _MOST_CODES:
        raise ValueError(f"more than {_MOST_CODES} language codes")
    for r in rows:
        for word in (r["code"], r["iso3"], r["name"]):
            if word:
                known[word.strip().lower()] = r["code"]
    bare = F.lower(F.trim(F.regexp_replace(label, r"[\s\u00a0]+", " ")))
    table = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])
    return F.coalesce(table[bare], table[F.regexp_extract(bare, r"^([a-z]{2,3})[-_]", 1)])


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class bits of every code point."""
    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 32
    every = points.tobytes().decode("utf-32-le")
    out = np.zeros(len(every), np.uint8)
    for bit, pattern in ((_LETTER, r"[\p{L}\p{M}]+"), (_HEAD, r"\p{L}+"), (_CHARACTER, r"[\p{Han}\p{Hiragana}\p{Katakana}]+")):
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] |= bit
    return out


def telling_text(unit: str) -> str:
    """What of a sentence unit tells its language: noise removed, quotations and asides removed if enough stays."""
    if "\n" in unit or "<" in unit or '":' in unit or "0x" in unit or "//" in unit or unit[:1] in "[ \t" or unit[:1].isdecimal() or ":" in unit[:11]:
        unit = _NOISE.sub(" ", unit)
    if not _QUOTES.isdisjoint(unit):
        outside = _QUOTED.sub(" ", unit)
        if letters_in(outside) >= 6:
            return outside
    return unit


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, each between spaces and behind a 0, and the text each belongs to."""
    joined = "".join(f"\0 {t.lower()} " for t in texts) if not any("\0" in t for t in texts) else "".join("\0 " + t.lower().replace("\0", " ") + " " for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.cumsum(cp == 0) - 1


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: letters of its words (two letters or more; one of a script without alphabet counts as three), and whether it has a word."""
    if not texts:
        return np.zeros(0), np.zeros(0, bool)
    cp, owner = _code_points(texts)
    kind = _classes()[cp]
    letter, dense = (kind & _LETTER) > 0, (kind & _CHARACTER) > 0
    beside = np.zeros(len(cp), bool)
    beside[1:] = letter[:-1]
    beside[:-1] |= letter[1:]
    word = (letter & beside) | dense
    n = np.bincount(owner[word], minlength=len(texts)) + 2 * np.bincount(owner[dense], minlength=len(texts))
    return n.astype(np.float64), n > 0


SCRIPTS = ("Latn", "Cyrl", "Hani", "Kana", "Thai", "Deva")


@lru_cache(maxsize=1)
def _script_numbers() -> np.ndarray:
    """Of every code point: 1 + the place of its script in SCRIPTS, 0 for others."""
    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 32
    every = points.tobytes().decode("utf-32-le")
    out = np.zeros(len(every), np.uint8)
    for k, name in enumerate(("Latin", "Cyrillic", "Han", "Hiragana", "Thai", "Devanagari")):
        for m in re.finditer(rf"[\p{{{name}}}{r'\p{Katakana}' if name == 'Hiragana' else ''}]+", every):
            out[m.start() : m.end()] = k + 1
    return out & ((_classes() & _HEAD) > 0) * np.uint8(255)


def script_letters(texts: list[str]) -> np.ndarray:
    """Letters of each script of SCRIPTS, a row a text."""
    if not texts:
        return np.zeros((0, len(SCRIPTS)), np.int64)
    cp, owner = _code_points(texts)
    width = len(SCRIPTS) + 1
    return np.bincount(owner * width + _script_numbers()[cp], minlength=len(texts) * width).reshape(len(texts), width)[:, 1:]


def letters_in(text: str) -> int:
    """letters_of one text."""
    return sum(map(len, _WORD.findall(text))) + 2 * len(_DENSE.findall(text))


def evidence(letters: np.ndarray | float) -> np.ndarray | float:
    """How much a text's log-probabilities count: scores are scaled to the length of the text, so 20 letters count once, up to 60 in proportion."""
    return np.minimum(3.0, letters / 20.0)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, text by text, and the text each belongs to. Digits and marks count as space; one text may be of any length."""
    cp, owner = _code_points(texts)
    gap = ((_classes()[cp] & _LETTER) == 0) & (cp != 0)
    first = np.ones(len(cp), bool)
    first[1:] = ~(gap[1:] & gap[:-1])  # of neighbouring gaps the first stays, as one space
    cp = np.where(gap, np.uint32(32), cp)[first].astype(np.uint64)
    owner = owner[first].astype(np.int32)
    out, own = [], []
    h = np.zeros(len(cp), np.uint64)
    inside = np.ones(len(cp), bool)
    for n in (1, 2, 3):
        if len(cp) < n:
            break
        here = cp[n - 1 :]
        h = h[: len(here)] * np.uint64(0x9E3779B97F4A7C15) + here * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)
        inside = inside[: len(here)] & (here != 0)
        keep = inside & (here != 32) if n == 1 else inside
        x = h[keep]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((x >> np.uint64(64 - DIM_BITS)).astype(np.int32))
        own.append(owner[: len(here)][keep])
    whose = np.concatenate(own)
    by_text = np.argsort(whose, kind="stable")  # three ascending runs
    return np.concatenate(out)[by_text], whose[by_text]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """A bounded amount of text at a time; a long text is a slice by itself."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < _SLICE):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # DIM x languages, TF-IDF folded in
    idf: np.ndarray
    temperature: float

    @cached_property
    def squares(self) -> np.ndarray:
        return self.idf.astype(np.float64) ** 2

    def log_probabilities(self, texts: list[str]) -> np.ndarray:
        """Calibrated log-probabilities, a row a text."""
        scores = np.zeros((len(texts), len(self.languages)), np.float64)
        norms = np.zeros(len(texts), np.float64)
        at = 0
        for part in _slices(texts):
            codes, own = _codes(part)
            for i in range(0, len(codes), _SLICE):
                c, o = codes[i : i + _SLICE], own[i : i + _SLICE]
                cuts = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
                scores[at + o[cuts]] += np.add.reduceat(self.weights[c], cuts, axis=0)
                norms[at + o[cuts]] += np.add.reduceat(self.squares[c], cuts)
            at += len(part)
        logits = (scores / np.sqrt(np.maximum(norms, 1e-12))[:, None]) / self.temperature
        top = logits.max(axis=1, keepdims=True)
        return logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))


def train(texts: list[str], labels: list[str], idf: np.ndarray, epochs: int = 2, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 1) -> LanguageModel:
    """FTRL-proximal with elastic net, a softmax over all languages; rows whose label a model of the other half of the rows rejects are left out.

    A fifth of the rows (every fifth of the shuffled ones) is held out and sets the temperature.
    """
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in labels])
    order = np.random.default_rng(seed).permutation(len(texts))
    held = set(order[::5].tolist())
    rows = []
    for part in _slices(texts):
        codes, own = _codes(part)
        for of_text in np.split(codes, np.searchsorted(own, np.arange(1, len(part)))):
            ids, n = np.unique(of_text, return_counts=True)
            v = n * idf[ids]
            rows.append((ids, (v / max(1e-12, np.sqrt((n * idf[ids] ** 2).sum()))).astype(np.float64)))
    half = np.zeros(len(texts), bool)
    half[order[::2]] = True
    good = np.ones(len(texts), bool)
    for side in (half, ~half):  # what the other half rejects is not learned
        other = _ftrl(rows, y, languages, [i for i in order if not side[i]], idf, 1, alpha, beta, l1, l2)
        at = np.flatnonzero(side)
        if len(at):
            good[at] = other.log_probabilities([texts[i] for i in at]).argmax(axis=1) == y[at]
    model = _ftrl(rows, y, languages, [i for i in order if good[i] and i not in held], idf, epochs, alpha, beta, l1, l2)
    check = [i for i in held if good[i]]
    if check:
        logits = model.log_probabilities([texts[i] for i in check])
        model.temperature = _temperature(logits, y[check])
    return model


def _ftrl(rows: list, y: np.ndarray, languages: list[str], order: list[int], idf: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float, together: int = 16) -> LanguageModel:
    """FTRL-proximal; `together` rows make one step, by the sum of their gradients."""
    k, dim = len(languages), 1 << DIM_BITS
    z, n = np.zeros((dim, k)), np.zeros((dim, k))

    def solved(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) > l1, w, 0.0)

    order = [i for i in order if len(rows[i][0])]
    for at in [*range(0, len(order), together)] * epochs:
        step = order[at : at + together]
        sizes = np.array([len(rows[i][0]) for i in step])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        codes, v = (np.concatenate([rows[i][x] for i in step]) for x in (0, 1))
        ids, where = np.unique(codes, return_inverse=True)
        zi, ni = z[ids], n[ids]
        w = solved(zi, ni)
        s = np.add.reduceat(v[:, None] * w[where], starts, axis=0)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(step)), y[step]] -= 1.0
        by_code = np.argsort(where, kind="stable")
        each = (v[:, None] * np.repeat(p, sizes, axis=0))[by_code]
        g = np.add.reduceat(each, np.searchsorted(where[by_code], np.arange(len(ids))), axis=0)
        root = np.sqrt(ni)
        ni += g * g
        z[ids] = zi + g - (np.sqrt(ni) - root) / alpha * w
        n[ids] = ni
    w = solved(z, n)
    return LanguageModel(languages, (w * idf[:, None]).astype(np.float32), idf.astype(np.float32), 1.0)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least loss, by golden-section search over its logarithm.

    Labels are smoothed (Platt) as if one row more could be of any language: rows without a single error would put no
    bound to the confidence, and a unit told wrongly by a hair would then count as certain.
    """
    unsure = 1.0 / (len(y) + 1)

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (1 - unsure) * s[np.arange(len(y)), y] - unsure * s.mean(axis=1)).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs, over all rows, and the number of texts. At most 2^17 counts reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, place = np.zeros(1 << DIM_BITS, np.int64), np.zeros(1 << DIM_BITS, np.int64)
        texts = 0
        for batch in batches:
            rows = batch["_text"].tolist()
            for part in _slices(rows):
                codes, own = _codes(part)
                cuts = [*np.searchsorted(own, np.arange(len(part))).tolist(), len(codes)]
                numbers = np.arange(len(codes))
                for a, b in zip(cuts, cuts[1:]):  # each code of a text once: the place that was written last
                    place[codes[a:b]] = numbers[a:b]
                    total[codes[a:b][place[codes[a:b]] == numbers[a:b]]] += 1
                texts += len(part)
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"code": np.append(ids, -1), "n": np.append(total[ids], texts)})

    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << DIM_BITS, np.int64)
    codes, n = rows.column("code").to_numpy(), rows.column("n").to_numpy()
    out[codes[codes >= 0]] = n[codes >= 0]
    return out, int(n[codes < 0].sum())


def fit_languages(df: DataFrame, key: str, text: str, label: str, codes: DataFrame, rows_per_language: int = 400, longest: int = 20_000, units_per_language: int = 1600, units_per_text: int = 12, seed: int = 1) -> LanguageModel:
    """Train on about rows_per_language labelled texts of each language, drawn by a hash of the key.

    Bounds of the sample: rows_per_language rows a language in expectation (three times that at most), texts of at
    most `longest` characters, units_per_language sentence units, units_per_text of them from one text. Document frequencies are those of all rows.
    """
    frequencies, texts = document_frequencies(df, text)
    idf = (np.log((1 + texts) / (1 + frequencies)) + 1).astype(np.float64)
    known = language_label(F.col(label), codes)
    labelled = df.where(F.length(text) <= longest).select(F.col(key).alias("_key"), F.col(text).alias("_text"), known.alias("_lang")).where(F.col("_lang").isNotNull() & ~F.col("_lang").isin("mul", NO_LANGUAGE))
    counts = {r["_lang"]: r["count"] for r in labelled.groupBy("_lang").count().collect()}  # a row a language
    if not counts:
        raise ValueError("no labelled text to learn from")
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows_per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < share[F.col("_lang")]).orderBy(draw, "_key").limit(3 * rows_per_language * len(counts)).toArrow().to_pandas().sort_values(["_lang", "_key"])
    used: dict[str, int] = {}
    units, labels = [], []
    for t, lang in zip(sample["_text"], sample["_lang"], strict=True):
        for a, b in sentence_spans(t)[:units_per_text]:
            u = telling_text(t[a:b])
            if used.get(lang, 0) < units_per_language and letters_in(u) >= 8:
                used[lang] = used.get(lang, 0) + 1
                units.append(u)
                labels.append(lang)
    return train(units, labels, idf, seed=seed)


def _script(text: str) -> str | None:
    best = max(_SCRIPTS, key=lambda s: len(_SCRIPTS[s].findall(text)))
    return best if _SCRIPTS[best].search(text) else None


def units_of(text: str) -> list[tuple[int, int]]:
    """Sentence units, cut once more at line breaks where the script changes."""
    out = []
    for a, b in sentence_spans(text):
        if "\n" in text[a:b]:
            at, before = a, None
            for m in re.finditer(r"[^\n]+", text[a:b]):
                s = _script(telling_text(m[0]))
                if before and s and s != before:
                    end = a + m.start()
                    out.append((at, end))
                    at = end + len(m[0]) - len(m[0].lstrip())
                before = s or before
            out.append((at, b))
        else:
            out.append((a, b))
    return out


def decode(log_p: np.ndarray, weight: np.ndarray, change: float) -> np.ndarray:
    """Best language of each unit of one text (Viterbi); changing the language costs `change`."""
    n, k = log_p.shape
    score = log_p[0] * weight[0]
    back = np.zeros((n, k), np.int32)
    for i in range(1, n):
        j = int(score.argmax())
        moved = score[j] - change
        stay = score >= moved
        back[i] = np.where(stay, np.arange(k), j)
        score = np.where(stay, score, moved) + log_p[i] * weight[i]
    out = np.empty(n, np.int32)
    out[-1] = int(score.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def classify(texts: list[str], model: LanguageModel, change: float = 5.5) -> list[list[tuple[int, int, str, float]]]:
    """Segments (start, end, language, confidence) of each text, in order."""
    spans = [units_of(t) for t in texts]
    telling = [telling_text(t[a:b]) for t, units in zip(texts, spans, strict=True) for a, b in units]
    letters, worded = letters_of(telling)
    log_p = model.log_probabilities(telling) if telling else np.zeros((0, len(model.languages)))
    best = log_p.argmax(axis=1) if telling else np.zeros(0, np.int64)
    weight = np.where(worded, evidence(letters), 0.0)
    out, at = [], 0
    for t, units in zip(texts, spans, strict=True):
        n = len(units)
        p, w, has = log_p[at : at + n], weight[at : at + n], worded[at : at + n]
        at += n
        if not n:
            out.append([])
            continue
        if not has.any():
            out.append([(units[0][0], units[-1][1], NO_LANGUAGE, 1.0)])
            continue
        own = best[at - n : at][has]
        lang = np.full(n, own[0]) if (own == own[0]).all() else decode(p, w, change)  # one best language everywhere is the best path
        for i in range(n - 2, -1, -1):  # a heading without words goes with what it heads
            if w[i] < 0.75 and lang[i] != lang[i + 1] and "\n" in t[units[i][1] : units[i + 1][0]] and not t[units[i][0] : units[i][1]].endswith((".", "!", "?", "…", "。", "！", "？", ">")):
                lang[i] = lang[i + 1]
        segments, i = [], 0
        while i < n:
            j = i
            while j < n and lang[j] == lang[i]:
                j += 1
            heavy = w[i:j] if w[i:j].sum() > 0 else np.ones(j - i)
            confidence = float(np.average(np.exp(p[i:j, lang[i]]), weights=heavy))
            segments.append((units[i][0], units[j - 1][1], model.languages[lang[i]], confidence))
            i = j
        out.append(segments)
    return out


def segments(df: DataFrame, key: str, text: str, model: LanguageModel, change: float = 5.5) -> DataFrame:
    """(key, segment_no, segments, start_char, end_char, lang, confidence): every language segment of every text.

    Null and blank texts have no row. A text without words is one segment of `zxx`. Narrow: a scan and one Python stage.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    schema = f"_key {kind}, segment_no int, segments int, start_char int, end_char int, lang string, confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                rows = [(k, n + 1, len(found), *s) for k, found in zip(part["_key"], classify(part["_text"].tolist(), known, change), strict=True) for n, s in enumerate(found)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(run, schema).withColumnRenamed("_key", key)


def wrong_labels(df: DataFrame, key: str, text: str, label: str, codes: DataFrame, model: LanguageModel) -> DataFrame:
    """Segments of every text whose label is missing, a placeholder, names another language, or can't be right since the text is mixed."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    schema = f"_key {kind}, start_char int, lang string, confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                rows = []
                for k, said, found in zip(part["_key"], part["_lang"], classify(part["_text"].tolist(), known), strict=True):
                    if len(found) != 1 or said != found[0][2]:
                        rows += [(k, s[0], s[2], s[3]) for s in found]
                yield pd.DataFrame(rows, columns=["_key", "start_char", "lang", "confidence"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), language_label(F.col(label), codes).alias("_lang"))
    return rows.mapInPandas(run, schema).withColumnRenamed("_key", key)
