"""Shared text normalisation and corpus vocabulary."""

from __future__ import annotations

import base64
import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<\|[^<>|]*\|>|</?[A-Za-z][^<>]*>")
#: Words that carry no attribute, number, position, relation or object.
FUNCTION_WORDS = frozenset("the a an of on at in to with by for and is are that which this".split())
#: Those of them that name a relation: they may be left out, but not exchanged.
RELATION_WORDS = frozenset("of on at in to with by for".split())


@lru_cache(maxsize=4)
def public_words(path: str = TOKENIZER) -> frozenset[str]:
    """The words that are one piece of a public vocabulary, in lower case: common words, the same at every size of the tables."""
    out = set()
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece = base64.b64decode(line.split()[0])
                if piece[:1] == b" " and piece[1:].isalpha():
                    out.add(piece[1:].decode("ascii", "ignore").lower())
    return frozenset(out - {""})


@lru_cache(maxsize=1)
def _format_marks() -> re.Pattern:
    """All invisible format characters."""
    import sys

    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf") + "]+")


def plain(text: str) -> str:
    """NFKC, no invisible format characters, lower case."""
    return text.lower() if text.isascii() else _format_marks().sub("", unicodedata.normalize("NFKC", text)).lower()


def words(text: str | None) -> list[str]:
    """Words of a sentence: runs of letters and digits, underscore divides."""
    return _WORD.findall(plain(text)) if text else []


def quoted_words(text: str | None) -> list[str]:
    """Words of marked-up text: entities resolved, tags and mask tokens are blanks."""
    if not text:
        return []
    text = html.unescape(text) if "&" in text else text
    if not text.isascii():
        text = _format_marks().sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall((_TAG.sub(" ", text) if "<" in text else text).lower())


def word_arrays(kind: str):
    """Pandas UDF ``string -> array<string>`` for ``words`` or ``quoted_words``."""

    split = {"words": words, "quoted": quoted_words}[kind]

    @F.pandas_udf("array<string>")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(split)

    return udf


def slips(word: str) -> set[str]:
    """Spellings one slip away: a letter dropped or doubled, two neighbours swapped."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[: i + 1] + word[i:] for i in range(len(word))}
    out |= {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    return out - {word}


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether ``a`` becomes ``b`` by at most ``most`` edits (a letter lost, added, exchanged, two neighbours swapped); banded dynamic programming."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    far = most + 1
    older, old = {}, {j: j for j in range(min(m, most) + 1)}
    for i in range(1, n + 1):
        new = {}
        for j in range(max(0, i - most), min(m, i + most) + 1):
            if j == 0:
                new[j] = i
                continue
            v = min(old.get(j - 1, far) + (a[i - 1] != b[j - 1]), old.get(j, far) + 1, new.get(j - 1, far) + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, older.get(j - 2, far) + 1)
            new[j] = v
        if min(new.values()) > most:
            return False
        older, old = old, new
    return old.get(m, far) <= most


def eval_split(split: Column) -> Column:
    return F.lower(F.trim(split)).isin("val", "testa", "testb")


def train_split(split: Column) -> Column:
    return F.lower(F.trim(split)) == "train"


def ref_sentences(refs: DataFrame) -> DataFrame:
    """``sent_id, sent, image_id, split, source``: one row per sentence, repeats of a ref count once."""
    flat = refs.select(F.explode("sentences").alias("s"), "image_id", F.lower(F.trim("split")).alias("split"), "source")
    return (
        flat.where(F.col("s.sent_id").isNotNull() & F.col("s.sent").isNotNull() & F.col("split").isNotNull())
        .groupBy(F.col("s.sent_id").alias("sent_id"))
        .agg(F.min(F.struct(F.col("s.sent").alias("sent"), "image_id", "split", "source")).alias("r"))
        .select("sent_id", "r.*")
    )
