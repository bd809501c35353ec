import random

import numpy as np
import pytest

from tidegate.llm import p8_languages as P

WORDS = {
    "en": "the guard reads every answer before it is shown and keeps a short record of each check that it makes",
    "de": "der Wächter liest jede Antwort vor der Freigabe und speichert eine kurze Notiz über jede einzelne Prüfung",
    "ru": "страж читает каждый ответ до показа и хранит короткую запись о каждой проверке которую делает",
    "zh": "审核模型在显示之前读取每段回答并保存每次检查的简短记录",
}


def sentence(lang, rnd):
    if lang == "zh":
        at = rnd.randint(0, 8)
        return WORDS["zh"][at:] + WORDS["zh"][:at] + "。"
    w = WORDS[lang].split()
    rnd.shuffle(w)
    return " ".join(w[:9]).capitalize() + "."


def rows(n=240, wrong=0.15):
    rnd = random.Random(8)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 4]
        text = ("" if lang == "zh" else " ").join(sentence(lang, rnd) for _ in range(4))
        said = rnd.choice(list(WORDS)) if rnd.random() < wrong else lang
        out.append((i, text, said, lang))
    return out


@pytest.fixture(scope="module")
def model(spark):
    codes = spark.createDataFrame([("en", "eng", "English"), ("de", "deu", "German"), ("ru", "rus", "Russian"), ("zh", "zho", "Chinese"), ("zxx", "zxx", "no linguistic content")], "code string, iso3 string, name string")
    df = spark.createDataFrame([r[:3] for r in rows()], "doc_id long, text string, lang string")
    return codes, P.fit_languages(df, "doc_id", "text", "lang", codes)


def test_held_out_accuracy(model):
    rnd = random.Random(77)
    made = [(lang, sentence(lang, rnd)) for lang in WORDS for _ in range(60)]
    best = model[1].log_probabilities([t for _, t in made]).argmax(axis=1)
    right = np.mean([model[1].languages[k] == lang for k, (lang, _) in zip(best, made)])
    assert right > 0.97 and (model[1].weights == 0).mean() > 0.5 and model[1].temperature > 0


def test_segments_and_labels(spark, model):
    codes, m = model
    rnd = random.Random(3)
    en, de, zh = (" ".join(sentence(x, rnd) for _ in range(3)) for x in ("en", "de", "zh"))
    quote = f'The reader wrote "{sentence("de", rnd)}" in the margin and left it there. ' + en
    data = [(1, en, "EN"), (2, en, "de"), (3, f"{en}\n\n  {de}", "en"), (4, "0x12ab; 0.5\n### 17", "en"), (5, None, None), (6, "  ", None), (7, quote, "en-US"), (8, de + zh, "mul"), (9, zh, None), (10, zh, "mul"), (11, de, "German"), (12, zh, "??")]
    df = spark.createDataFrame([(*r, 5) for r in data], "doc_id long, text string, lang string, start_char int")
    got = sorted((r.doc_id, r.start_char, r.lang) for r in P.wrong_labels(df, "doc_id", "text", "lang", codes, m).collect())
    assert got == [(2, 0, "en"), (3, 0, "en"), (3, len(en) + 4, "de"), (4, 0, "zxx"), (8, 0, "de"), (8, len(de), "zh"), (9, 0, "zh"), (10, 0, "zh"), (12, 0, "zh")]
    segs = P.segments(df, "doc_id", "text", m).collect()
    assert all(0 < r.confidence <= 1 for r in segs) and {r.doc_id for r in segs} == {1, 2, 3, 4, 7, 8, 9, 10, 11, 12}
    assert P.segments(df.limit(0), "doc_id", "text", m).count() == 0


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(30):
        p, w = np.log(rng.dirichlet([1, 1, 1], 5)), rng.random(5)
        cost = lambda path: sum(p[i, x] * w[i] for i, x in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
        assert np.isclose(cost(P.decode(p, w, 0.7)), max(map(cost, product(range(3), repeat=5))))


def test_long_text_in_slices(model, monkeypatch):
    text = "the guard reads every answer " * 2000
    whole = model[1].log_probabilities([text])
    monkeypatch.setattr(P, "_SLICE", 1000)
    assert np.allclose(whole, model[1].log_probabilities([text]), atol=1e-4)


def test_temperature_without_errors():
    """Held-out rows without an error put no bound to the confidence; a unit told wrongly by a hair must not become a segment."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 3000)
    logits = rng.normal(0, 0.3, (3000, 3))
    logits[np.arange(3000), y] = logits.max(axis=1) + 3
    t = P._temperature(logits, y)
    assert 0.3 < t < 2
    hair = np.array([[3.0, 0.0, 0.0], [0.0, 0.5, 0.0], [3.0, 0.0, 0.0]]) / t
    log_p = hair - np.log(np.exp(hair).sum(axis=1, keepdims=True))
    assert P.decode(log_p, np.full(3, 1.5), 5.5).tolist() == [0, 0, 0]
