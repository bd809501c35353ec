import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.llm.p3_sentences import once_per_key, sentences
from tidegate.llm.sentences import sentence_spans

CASES = [
    "The U.K. team shipped build v7.13 at 9 a.m. on purpose.|The night run begins at 4 p.m.|It covers names, places etc.|Then it ends.",
    "Dr. Fosse noted e.g. a drop of 4.5 percent.|See fig. 31 and sec. 6.5 for it.|\"Is it safe?\" Marta wondered aloud.|He left.",
    "Nobody read the line “Done? Not yet.” twice.|(The third pass was skipped.)|The hint (see above!) came twice.",
    "The stream paused ... and then went on.|It stopped…|Then it went on!",
    "Ab dem 15. 8. steht alles in Kap. 36 o. Ä. bereit.|Am 3. Mai lief Version 4.0 ohne Fehler.|»Nein. Niemals.« und ging.|„Halt! Nicht weiter.“ stand da.",
    "« Est-ce sûr ? » demanda Paul tout bas.|Le lot vaut max. 2,1 pts. par passage.|M. Paul a écrit : « C'est faux. »|Fin.",
    "EE. UU. y la UE usan el n.º 19 del formato.|«¿Es seguro?», preguntó Ana en voz baja.|¿Vale la pena?",
    "Доля выросла на 4.1 % и т. д., т. е. почти вдвое.|«Это безопасно?» — тихо спросил Олег.|Сюда входят имена и т. п.|Это видно у А. Б. Олега.",
    "“这样安全吗？”安娜低声问道！|他问：“为什么？晚了吗？”然后等着。|她回答：“错了。”|输出停顿……然后继续。|（取消了。）|提示（见上文！）出现了两次。",
    "彼は「なぜ今なの？もう遅い？」と尋ねて待ちました。|『なぜ？』という章は5頁です。|（中止になりました。）|終わり。",
    'उसने पूछा "अभी क्यों? क्या देर हो गई?" और रुका रहा।|उसने लिखा: "लेबल ग़लत है।"|डॉ. नील ने देखा।',
]


@pytest.mark.parametrize("marked", CASES)
def test_marked_texts(marked):
    join = "" if any("぀" <= c <= "鿿" for c in marked) else " "
    text = marked.replace("|", join)
    assert [text[a:b] for a, b in sentence_spans(text)] == marked.split("|")


def test_thai_spaces():
    text = "ตัวกรองอ่านข้อความ แต่มีคำเตือน26ข้อ วันที่ 3.05.2019 มี 42 แถว ครอบคลุมชื่อ วันที่ และสถานที่ ฯลฯ จบแล้ว"
    assert [text[a:b] for a, b in sentence_spans(text)] == ["ตัวกรองอ่านข้อความ แต่มีคำเตือน26ข้อ", "วันที่ 3.05.2019 มี 42 แถว", "ครอบคลุมชื่อ วันที่ และสถานที่ ฯลฯ", "จบแล้ว"]


def test_lists_headings_and_line_breaks():
    text = "A heading\n\n1. First of all\n2. Second. With a sentence\n3) Not\na break here.\n\n- bullet\n- other"
    got = [text[a:b] for a, b in sentence_spans(text)]
    assert got == ["A heading", "1. First of all", "2. Second.", "With a sentence", "3) Not\na break here.", "- bullet", "- other"]
    assert sentence_spans("At roughly\n5. of them stopped") == [(0, 29)]


def test_code_is_one_unit():
    text = "Look:\n```\na = 1\n\nb = 2.\n```\nDone."
    assert [text[a:b] for a, b in sentence_spans(text)] == ["Look:", "```\na = 1\n\nb = 2.\n```", "Done."]


def test_nothing():
    assert sentence_spans(None) == sentence_spans("") == sentence_spans(" \n　 ") == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1. !?\n\"“”«»()「」。…ก '-*", max_size=60))
def test_units_are_ordered_and_whole(text):
    """Units don't overlap, begin and end off white space, and hold everything that is not white space."""
    spans = sentence_spans(text)
    at = 0
    for a, b in spans:
        assert at <= a < b and not text[at:a].strip()
        assert not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


def test_table(spark):
    rows = [("a", "One. Two.", 1, "2025-01-01"), ("a", "One. Two.", 2, "2025-01-02"), ("b", None, 3, None), ("c", "  ", 4, None), (None, "X.", 5, None), ("d", "word " * 30_000, 6, None)]
    df = spark.createDataFrame(rows, "trace_id string, response string, sentence_no int, at string").selectExpr("*", "cast(at as timestamp) ingested_at")
    once = once_per_key(df, "trace_id", ["response"], "ingested_at")
    got = sentences(once, "trace_id", "response").collect()
    assert sorted((r.trace_id, r.end_character) for r in got) == [("a", 4), ("a", 9), ("d", 149_999)]
    assert sentences(once.limit(0), "trace_id", "response").count() == 0
