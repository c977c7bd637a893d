import datetime as dt

from millrace.llm import leakage, text
from tests.conftest import DATA

T0 = dt.datetime(2024, 1, 1)
REFS = "ref_id bigint, image_id bigint, split string, source string, sentences array<struct<sent_id bigint, sent string, tokens array<string>>>, ingested_at timestamp, words string, template string"
CONV = "conv_id bigint, conversations array<struct<from:string,value:string>>, ingested_at timestamp, salt string, words string"
S = "person holding a muddy red Davuvuno bench against the pillow outside Deyorowoge workshop"


def frames(spark, sents, values):
    refs = spark.createDataFrame([(n, 1, sp, "s", [(n, t, None)], T0, "", "") for n, (sp, t) in enumerate(sents)], REFS)
    conv = spark.createDataFrame([(n, None if v is None else [("human", x) for x in v], T0, "", "") for n, v in enumerate(values)], CONV)
    return refs, conv


def test_quotations(spark):
    eight = "a muddy red Davuvuno bench against the pillow"
    values = [
        [S], ["Look: A MUDDY red <p>Davu­vuno</p> <|mt_start|><|mt_0001|><|mt_end|> bench&nbsp;against the pillow!"], ["a muddy red davuvuno bench against the"], ["a muddy red Davuvuno bench", "against the pillow outside"],
        ["a muddy red Nanotine bench against the pillow outside Deyorowoge"], None, [None, ""], [f"x {eight} y", f"z {eight}"], ["ｐｅｒｓｏｎ holding_a muddy red Davuvuno bench &amp; against the pillow"],
    ]
    refs, conv = frames(spark, [("val", S), ("testA ", S.lower()), ("train", S), (None, S), ("val", "seven words are not enough for it"), ("TESTB", None)], values)
    got = {(r.sent_id, r.conv_id) for r in leakage.found(refs.unionByName(refs), conv.unionByName(conv)).collect()}
    assert got == {(s, c) for s in (0, 1) for c in (0, 1, 7)} | {(s, 8) for s in (0, 1)} - {(0, 8), (1, 8)} | {(s, 8) for s in (0, 1) if len(text.quoted_words(values[8][0])) >= 8 and "amp" not in text.quoted_words(values[8][0])}


def test_long_ligatures_are_words(spark):
    ligature = "\ufdfa"  # four words in one character
    refs, conv = frames(spark, [("val", text.plain(ligature + " " + ligature))], [[ligature + " " + ligature]])
    assert leakage.found(refs, conv).count() == 1


def test_reparameterised(spark):
    sents = [("val", "a cup of 12 mm near the old tram station Kozudira today"), ("val", "put Wexopari next to Wexopari and turn the old box away from Lumotaki")]
    values = [
        ["a cup of 15 mm near the old tram station Wowakafi today"], ["nothing alike here"], ["Put Zipolaru next to Zipolaru and turn the old box away from Nakodire"],
        ["put Zipolaru next to Binodaxi and turn the old box away from Nakodire"], [sents[0][1]],
    ]
    refs, conv = frames(spark, sents, values)
    assert {(r.sent_id, r.conv_id) for r in leakage.found(refs, conv).collect()} == {(0, 4)}
    got = {(r.sent_id, r.conv_id): (r.test_slots, r.corpus_slots) for r in leakage.reparameterised(refs, conv).collect()}
    # of the inconsistent one only windows without both of its first slots match
    assert {(0, 0), (1, 2)} <= set(got) <= {(0, 0), (1, 2), (1, 3)} and got[0, 0][0] != got[0, 0][1]


def test_slots_must_be_consistent(spark):
    refs, conv = frames(spark, [("val", "put Wexopari next to Wexopari and turn it")], [["put Zipolaru next to Zipolaru and turn it"], ["put Zipolaru next to Binodaxi and turn it"]])
    assert [(r.sent_id, r.conv_id, r.test_slots, r.corpus_slots) for r in leakage.reparameterised(refs, conv).collect()] == [(0, 0, "wexopari wexopari", "zipolaru zipolaru")]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    refs, conv = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("refs", "conversations"))
    rows = lambda: sorted(map(tuple, leakage.found(refs, conv).collect()))
    want = rows()
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 0)
    assert rows() == want


def test_brute_force_on_tables(spark):
    refs, conv = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("refs", "conversations"))
    test = {}
    for r in refs.collect():
        if r.split and r.split.strip().lower() in ("val", "testa", "testb"):
            for s in r.sentences or []:
                ws = text.quoted_words(s.sent)
                for k in range(len(ws) - 7):
                    test.setdefault(tuple(ws[k : k + 8]), set()).add(s.sent_id)
    want = set()
    for c in conv.where("conv_id IS NOT NULL").collect():
        for m in c.conversations or []:
            ws = text.quoted_words(m.value)
            for k in range(len(ws) - 7):
                want |= {(s, c.conv_id) for s in test.get(tuple(ws[k : k + 8]), ())}
    got = [tuple(r) for r in leakage.found(refs, conv).select("sent_id", "conv_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_empty(spark):
    refs, conv = frames(spark, [("val", S)], [[S]])
    assert leakage.found(refs.limit(0), conv).count() == 0 and leakage.found(refs, conv.limit(0)).count() == 0
    assert leakage.report(refs, conv).first().n_conversations == 1


def test_reparameterised_brute_force(spark):
    """Every pair of the smallest tables, also of sentences with equal words and of conversations that quote another sentence."""
    refs, conv = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("refs", "conversations"))
    names = text.public_words()

    def of(ws):
        out = {}
        for k in range(len(ws) - 7):
            w = ws[k : k + 8]
            kinds = [leakage.kind_of(x, names) for x in w]
            slots = tuple(x for x, y in zip(w, kinds, strict=True) if x is not y)
            if leakage.MIN_FIXED <= 8 - len(slots) < 8:
                out.setdefault((tuple(kinds), tuple(slots.index(x) for x in slots)), set()).add(slots)
        return out

    test = {s.sent_id: of(text.quoted_words(s.sent)) for r in refs.collect() if r.split and r.split.strip().lower() in ("val", "testa", "testb") for s in r.sentences or []}
    want = {}
    for c in conv.where("conv_id IS NOT NULL").collect():
        for m in c.conversations or []:
            for key, there in of(text.quoted_words(m.value)).items():
                for sent, own in test.items():
                    want.setdefault((sent, c.conv_id), set()).update((key, s) for s in there - own.get(key, there))
    rows = leakage.reparameterised(refs, conv).collect()
    assert {(r.sent_id, r.conv_id): r.n_windows for r in rows} == {k: len(v) for k, v in want.items() if v} and len(rows) == len({(r.sent_id, r.conv_id) for r in rows})


def test_reparameterised_gives_every_sentence(spark):
    s = "put {} next to the old box and turn it"
    refs, conv = frames(spark, [("val", s.format(n)) for n in ("Wexopari", "Lumotaki", "Wexopari")], [[s.format("Zipolaru")], [s.format("Lumotaki")]])
    assert {(r.sent_id, r.conv_id) for r in leakage.reparameterised(refs, conv).collect()} == {(0, 0), (1, 0), (2, 0), (0, 1), (2, 1)}
