import random

import pytest

from millrace.llm import lexicon
from tests.conftest import DATA


def test_automaton_is_exact_and_minimal(tmp_path):
    rng = random.Random(0)
    words = sorted({"".join(rng.choice("abcdé中") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    ids = {w: [len(w), k] for k, w in enumerate(words)}
    lexicon.compile_lexicon(ids, str(tmp_path / "l.bin"))
    lex = lexicon.Lexicon(str(tmp_path / "l.bin"))
    ranks = lex.ranks([w.encode() for w in words])
    assert [lex.ids[lex.offset[r] : lex.offset[r + 1]].tolist() for r in ranks] == [ids[w] for w in words]
    assert (lex.ranks([b"", b"zzz", b"abcdeabcdeabcde", "é中".encode()[:4]]) == -1).all()
    lexicon.compile_lexicon({p + "ing": [1] for p in ("walk", "talk", "sing")}, str(tmp_path / "s.bin"))
    shared = lexicon.Lexicon(str(tmp_path / "s.bin"))
    assert len(shared.key) < 3 * len("walking") - 6  # suffixes are shared
    lexicon.compile_lexicon({}, str(tmp_path / "e.bin"))
    assert lexicon.Lexicon(str(tmp_path / "e.bin")).ranks([b"a"])[0] == -1


@pytest.mark.parametrize("size", [0, 50, 50_000])
def test_ids_equal_the_tokenizer(spark, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    odd = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "<|endoftext|>"), (-5, "a" * 5000), (-6, "中" * 3000), (-7, "​ก 👩‍🚀"), (-8, "don't  stop\r\n\r\n 12345"), (-9, "a\x1cb \x1c c\x1f\x85 \x0b d  "), (-10, "x² ½ Ⅷ _a_1 't  's\t\t")]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    got = {r.doc_id: r.ids for r in lexicon.encode(docs, size=size).collect()}
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert got == want
    assert {r.doc_id: r.n_tokens for r in lexicon.sizes(docs, held=size or 1).collect()} == {k: len(v) for k, v in want.items()}


def test_empty_table(spark):
    assert lexicon.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
