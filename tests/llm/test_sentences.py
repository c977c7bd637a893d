import pytest

from millrace.llm import sentences

CASES = [
    ["Mr. Kane met Dr. Lo at 5.30 p.m. on St. Olaf Road.", "It rained!", "“Stop here,” said the guide, “and wait.”", "Why?"],
    ["See Fig. 4 and Sec. 3.2 for more.", "Use e.g. the box, i.e. 4.5 cm, not the mask.", "The sign reads \"Keep left. Mind the step.\" in white letters."],
    ["Its tag says \"Fragile!\"", "A small drone left.", "(The shadow is no object.)", "At 5 % overlap (p. 3 ff.) it counts."],
    ["„Wo ist der Griff?“ fragt die Frau.", "Am 4. März war er da.", "Es misst ca. 2,3 m, d. h. wenig.", "Auf dem Schild steht „Bitte warten!“", "Gut."],
    ["Le panneau indique « Attention ! »", "« Où est-il ? » demande la dame.", "Bon… le contour est ouvert."],
    ["«¿Es un kayak?», pregunta ella.", "¡Cuidado!", "El cartel dice «Espere. Gracias.» en letras."],
    ["Проверка заняла ок. 5 мин. и прошла.", "«Где он?» — спрашивает он.", "См. рис. 3 и табл. 4 ниже."],
]
CJK = [["“把手在哪里？”标注员问。", "他说：“这是皮划艇。”", "版本3.5导出了掩码；新的没有。", "真的吗？！", "模型很好……", "图片没有变化。"], ["「取っ手はどこ？」と聞きました。", "本当ですか！？", "メモには「だめ。」とあります。"]]


def units(text, model=None):
    return [text[a:b] for a, b in sentences.spans(text, model or sentences.Model())]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("gap", [" ", "  ", "\n", "\r\n", "\xa0"])
def test_sentences(case, gap):
    assert units(gap.join(case)) == case


@pytest.mark.parametrize("case", CJK)
@pytest.mark.parametrize("gap", ["", " ", "　"])
def test_unspaced_scripts(case, gap):
    model = sentences.Model(start={"模型": 9, "图片": 9, "真的": 9, "版本": 9, "他说": 9, "本当": 9, "メモ": 9})
    assert units(gap.join(case), model) == case


def test_missing_blank():
    assert units("The batch was merged.The file img_1.v2.json holds it.Is it done?Yes.") == ["The batch was merged.", "The file img_1.v2.json holds it.", "Is it done?", "Yes."]


def test_blocks_and_lists():
    text = "﻿  Heading one\r\n\r\n1. First item. Still it.\r\n2. Second\r\n\r\nA line\r\nwraps here. Next one.\n \n- a\n- b. c\n\n  "
    assert units(text) == ["Heading one", "1. First item. Still it.", "2. Second", "A line\r\nwraps here.", "Next one.", "- a", "- b. c"]


def test_thai_and_danda():
    assert units("แพะอยู่หน้ารั้ว มีแพะ 16 ตัวอยู่หน้ารั้ว ไฟล์ a.png เก็บไว้") == ["แพะอยู่หน้ารั้ว", "มีแพะ 16 ตัวอยู่หน้ารั้ว", "ไฟล์ a.png เก็บไว้"]
    assert units("यह चित्र है। क्या बकरी नं. 11 है? हाँ।") == ["यह चित्र है।", "क्या बकरी नं. 11 है?", "हाँ।"]


def test_odd_texts():
    assert units(None) == units("") == units(" \n﻿\n ") == []
    assert units("no end mark") == ["no end mark"]
    assert units("...") == ["..."]
    long = "A word here. " * 20_000
    assert len(sentences.spans(long, sentences.Model())) == 20_000
    for text in ("(((((", '"""', ".!?.!?", "a.b.c.d", "«" * 50 + "."):
        got = sentences.spans(text, sentences.Model())
        assert all(0 <= a < b <= len(text) for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_lower_case_uses_learned_openers(spark):
    rows = [(n, f"The folder keeps boxes, etc. A guide asks number {n}.\n\nA drone left. \n\nThe masks, boxes, etc. are stored here.", "x", 0) for n in range(40)]
    docs = spark.createDataFrame([*rows, (99, "the folder keeps boxes, etc. a drone left. the boxes, etc. are stored here.", "x", 0), (100, None, "x", 0)], "doc_id bigint, text string, start_char string, end_char int")
    got = [(r.start_char, r.end_char) for r in sentences.split(docs).where("doc_id = 99").orderBy("start_char").collect()]
    text = docs.where("doc_id = 99").first().text
    assert [text[a:b] for a, b in got] == ["the folder keeps boxes, etc.", "a drone left.", "the boxes, etc. are stored here."]
    assert sentences.split(docs.limit(0)).count() == 0


def naive(text, begins, cuts):
    """The program with every start tried for every end."""
    best, back = [0.0] + [-float("inf")] * len(cuts), [0] * (len(cuts) + 1)
    for j, cut in enumerate(cuts, 1):
        for i in range(j):
            if begins[i] < cut.end:
                v = best[i] + cut.score + sentences._span(text, begins[i], cut)
                if v > best[j]:
                    best[j], back[j] = v, i
    return best, back


def test_ranges_of_starts_equal_all_starts():
    import random

    rng = random.Random(5)
    bits = ["A boat is here. ", "“Where is it?” asks he. ", "Ok. ", "he said: “Stop. Now!” And left. ", "(See p. 4.) ", "Hm… ", "a remark (it was old.) stays. ", "The sign reads \"Keep left. Mind it.\" in white. ", "No! ", "3. ", "x"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        text = text.lower() if rng.random() < 0.3 else text
        model = sentences.Model()
        cuts = sentences._cuts(text, 0, len(text), model)
        if cuts:
            begins = [0] + [c.next for c in cuts]
            a, b = sentences._best(text, begins, cuts), naive(text, begins, cuts)
            assert a[0] == pytest.approx(b[0]) and a[1] == b[1]


def test_long_quotation_in_a_sentence():
    quote = " ".join("The mask was drawn by hand near the old tram." for _ in range(40))
    text = f"The note on the wall says “{quote}” in white letters. It stays there."
    assert units(text) == [text[: -len(" It stays there.")], "It stays there."]


def test_lone_marks_enclose_nothing():
    assert units('The board is 5" wide. It fits. A "small" one does not. The end.') == ['The board is 5" wide.', "It fits.", 'A "small" one does not.', "The end."]
    assert units('He said "no. It went on. She said "yes" to it. The end.')[-2:] == ['She said "yes" to it.', "The end."]


def test_many_ends_in_one_block():
    text = " ".join(f"Box {n} is drawn here." for n in range(3000))
    assert len(sentences.spans(text, sentences.Model())) == 3000
    nested = "(" * 2000 + "a. b. " * 2000 + ")" * 2000 + ". End."
    assert sentences.spans(nested, sentences.Model())


def test_learning_counts_like_a_plain_loop(spark):
    docs = spark.createDataFrame([(1, "A boat left. The old boat stays, etc. here.\n\n- one item. two\n\nA tram.", "x"), (2, None, "x"), (3, "", "x"), (4, "模型很好。图片。", "x")], "doc_id bigint, text string, extra string")
    model = sentences.learn(docs)
    assert model.start["a"] == 2 and model.start["one"] == 1 and model.inside["boat"] == 2 and model.stopped["etc"] == 1 and model.final["tram"] == 1
    assert sentences.learn(docs.limit(0)).start == {}
