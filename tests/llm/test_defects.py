import datetime as dt

import pytest

from millrace.llm import defects, labelmodel, langid
from tests.conftest import DATA

T0 = dt.datetime(2024, 1, 1)
DDL = "conv_id bigint, conversations array<struct<from:string,value:string>>, ingested_at timestamp, turn string, defect string, patterns string, question string"
M = "<|mt_start|><|mt_0001|><|mt_0300|><|mt_end|>"
SOUND = [
    ("Segment the red cup.", '```json\n[{"mask_2d": "%s", "label": "red cup"}]\n```' % M), ("How many cups are in the picture?", "None."), ("How many cups are in the picture?", "3"),
    ("Can you mark the cup?", "No target."), ("What colour is the cup?", "Red."), ("Which category does it belong to?", "tram"), ("Describe the scene.", "I can't tell the two cups apart at first glance, but the nearer one has a hook."),
    ("Please answer in German: what is shown here?", "Das kleine Boot liegt im Schatten vor der Halle."), ("What is happening here?", 'The banner reads "Bitte hier warten" and covers the door.'),
    ("Was ist zu sehen?", "Was ist zu sehen? Das Boot liegt im Schatten vor der Halle."), ("Is the cup left of the tram?", "Yes, the cup is left of the tram."), ("请描述图片。", "左边的灯笼覆盖了帐篷。"),
] + [("What is happening in this picture?", f"The cup number {n} was drawn twice near the old tram.") for n in range(12)]
BAD = [
    ("Where is the cup?", None, "empty"), ("Where is the cup?", " ​\n", "empty"), ("Where is the cup?", "N/A", "empty"), ("Where is the cup?", "<p></p>", "empty"), ("Where is the cup?", "```json\n[]\n```", "empty"),
    ("Segment the red cup.", '```json\n[{"mask_2d": "<|mt_start|><|mt_00', "truncated"), ("What is happening here?", "The red canoe was drawn twice near the", "truncated"), ("请描述图片。", "左边的灯笼覆盖了帐", "truncated"),
    ("Caption this.", "<p>A cup</p> %s stands near <p>a" % M, "truncated"), ("What is happening here?", "I'm sorry, but I can't help with that request.", "refusal"), ("Was ist zu sehen?", "Diese Anfrage muss ich leider ablehnen.", "refusal"),
    ("请描述图片。", "抱歉，我无法回答这个问题。", "refusal"), ("この画像は？", "申し訳ありませんが、お答えできません。", "refusal"), ("Segment the red cup.", "SEGMENT THE RED CUP", "copy"), ("Segment the red cup.", 'Q: "Segment the red cup."', "copy"),
    ("Describe the scene for me.", "Describe the scene for me. Describe the scene for me.", "copy"), ("What is happening here?", "Das kleine Boot liegt im Schatten vor der Halle.", "other_language"), ("Was ist zu sehen?", "左边的灯笼覆盖了帐篷。", "other_language"),
    ("这张图片里有什么？", "左の提灯はベンチを隠しています。", "other_language"),
]


def documents(spark):
    return spark.read.parquet(f"{DATA.parent}/sf0.1/documents.parquet")  # enough labelled rows of every language


def conversations(spark, pairs, copies=6):
    rows = []
    for k in range(copies):
        for n, p in enumerate(pairs):
            rows.append((k * 1000 + n, [("system", "Be exact."), ("Human ", p[0])] + ([] if p[1] is None else [("GPT", p[1])]), T0, "", "", "", ""))
    return spark.createDataFrame(rows + rows[:3], DDL)


def test_each_defect_and_sound_pairs(spark):
    found = {(r.conv_id, r.turn): r.defect for r in defects.found(conversations(spark, SOUND + BAD), documents(spark)).collect()}
    want = {(k * 1000 + len(SOUND) + n, 1): p[2] for k in range(6) for n, p in enumerate(BAD)}
    assert found == want


def test_odd_conversations(spark):
    long = "word " * 60_000 + "end."
    rows = [(1, None, T0), (2, [], T0), (3, [("gpt", "hi")], T0), (4, [("user", None), (None, "Fine, thanks for it.")], T0), (None, [("user", "q")], T0), (5, [("user", "Tell a story."), ("user", "Now?"), ("assistant", long)], None)]
    df = spark.createDataFrame([(*r, "", "", "", "") for r in rows], DDL)
    assert {(r.conv_id, r.turn, r.defect) for r in defects.found(df, documents(spark)).collect()} == {(5, 0, "empty")}
    assert defects.found(df.limit(0), documents(spark).limit(0)).count() == 0


def test_label_model():
    counts = {(1, 1, 0): 50, (1, 0, 0): 10, (0, 0, -1): 900, (1, 0, -1): 5, (0, 0, 0): 40}
    model = labelmodel.fit(counts)
    assert model.posterior((1, 1, 0)) > 0.99 > 0.5 > model.posterior((1, 0, -1))
    assert model.posterior((0, 0, 0)) == 0.0
    assert labelmodel.cutoff(model, [((1, 1, 0), True), ((1, 0, -1), False)]) == 0.5 and labelmodel.cutoff(model, []) == 0.5
    high = labelmodel.Fitted(0.5, ({1: 0.8, 0: 0.1, -1: 0.1},), ({1: 0.3, 0: 0.3, -1: 0.4},))
    assert labelmodel.cutoff(high, [((1,), False), ((1,), False), ((1,), True)]) == 0.5
    weak = labelmodel.Fitted(0.5, ({1: 0.8, 0: 0.1, -1: 0.1}, {1: 0.9, 0: 0.05, -1: 0.05}), ({1: 0.3, 0: 0.3, -1: 0.4}, {1: 0.1, 0: 0.5, -1: 0.4}))
    assert labelmodel.cutoff(weak, [((1, 0), False), ((1, 1), True)]) == 0.5 and labelmodel.cutoff(weak, [((1, -1), False), ((0, 1), False), ((1, 1), True)]) == 0.8
    assert sum(model.yes[0].values()) == pytest.approx(1)


def test_several_labels(spark):
    """A copied question without its end mark keeps both labels; an empty structure keeps only what its own functions say."""
    got = {}
    for r in defects.labels(conversations(spark, SOUND + BAD), documents(spark)).collect():
        got.setdefault((r.conv_id, r.turn), set()).add(r.defect)
    copied = next(n for n, p in enumerate(BAD) if p[1] == "SEGMENT THE RED CUP")
    assert got[len(SOUND) + copied, 1] == {"copy", "truncated"} and any(len(v) > 1 for v in got.values())


def test_languages_beyond_the_fitted_ones(spark):
    pairs = SOUND + BAD + [
        ("What is happening in this picture?", "La tazza rossa si trova vicino alla vecchia finestra della stanza grande.", "other_language"),
        ("What is happening in this picture?", "A chávena vermelha está perto da janela velha do quarto grande.", "other_language"), ("Was ist zu sehen?", "Η κόκκινη κούπα βρίσκεται κοντά στο παλιό παράθυρο.", "other_language"),
    ]
    found = {(r.conv_id, r.turn): r.defect for r in defects.found(conversations(spark, pairs), documents(spark)).collect()}
    assert all(found.get((n, 1)) == "other_language" for n in range(len(SOUND + BAD), len(pairs)))


def test_language_model(spark):
    model = langid.learn(documents(spark))
    texts = ["The red canoe was drawn twice near the old harbour.", "Das kleine Boot liegt im Schatten vor der Halle.", "La canoa roja aparece dos veces.", "左边的灯笼覆盖了帐篷。", "", "12 34", None]
    assert defects.tell_languages(texts, model) == ["en", "de", "es", "zh", None, None, None]
    assert defects.tell_languages(texts, langid.Languages((), model.table)) == [None] * 7


def test_long_open_tag():
    m = "<|mt_start|><|mt_0001|><|mt_0300|><|mt_end|>"
    assert defects.votes("Caption this.", f"A cup {m} stands near <p class='" + "a long attribute " * 6)["truncated"][1] == 1
    assert defects.votes("Caption this.", f"A cup {m} is smaller: 3 < 4 cups.")["truncated"][1] == 0


def test_on_tables(spark):
    conv = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = defects.found(conv, documents(spark)).collect()
    assert len(rows) == len({(r.conv_id, r.turn) for r in rows}) and {r.defect for r in rows} <= set(defects.DEFECTS) and len(rows) >= 5


def test_statements_after_what_cannot_be_told():
    on = ["I can't tell the two cups apart at first glance, but the nearer one has a hook.", "I cannot read the sign, however its lower line says closed.", "Ich kann die Schrift nicht lesen, aber das Schild ist rot und hängt links."]
    off = ["I'm sorry, but I can't help with that request.", "I can't help with that, but I can answer another question.", "I cannot do this, but please consult a specialist about it.", "I won't segment that for you."]
    assert [defects.goes_on(t) for t in on + off] == [True] * 3 + [False] * 4


def test_all_sound_pairs_are_labelled(spark):
    """Cutoffs and anchors come from every sound pair, the language model from every labelled document and every turn."""
    conv = conversations(spark, SOUND, copies=60)
    voted = defects.pair_votes(conv, defects.fitted_languages(conv, documents(spark)))
    made = [m for r in voted.collect() for m in r.made]
    sound = 60 * (len(SOUND) - 1)  # one of them has a vote for a defect
    assert sum(m[1] == str(defects._SOUND) for m in made) == sound > defects.ANCHOR
    labelled = defects.labelled_counts(voted)
    assert sum(n for _, has, n in labelled[0][1] if has) == sum(m[:2] == "10" for m in made)
    assert sum(w for _, has, w in labelled[0][0] if has) == pytest.approx(sum(m[:2] == "00" for m in made) * defects.ANCHOR / sound)
    few = langid.learn(documents(spark))
    assert langid.learn(documents(spark).union(documents(spark))).counts.sum() - few.counts.sum() == pytest.approx(few.counts.sum() - langid._SMOOTH * few.counts.size)
