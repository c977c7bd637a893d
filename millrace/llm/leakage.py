"""Evaluation sentences in training conversations, by template windows.

Both sides are read as words (entities, tags, mask tokens, compatibility forms,
invisible marks and case resolved).  In every window of eight words the numbers,
units and names are replaced by typed placeholders: what stays is the template,
what was taken out are the slots.  Windows meet in a hash join on the template;
then the slots are checked:

* equal slots: a verbatim quotation (``found``);
* other slots, equal to each other at the same places as in the test item: a
  re-parameterised question of every test item of that template
  (``reparameterised``); windows whose slots are not consistent in that sense are
  no match.

A word is a name when a public tokenizer's vocabulary has no piece for it, so
its type never depends on the tables.  ``found`` does not depend on it at all:
equal template and equal slots are equal words.

The corpus is never shuffled.  The windows of the test items are entered in a
bitmap of fixed size (``BITS``), which the tasks that read the corpus test their
windows against; only windows in the bitmap leave a task.  They are joined
exactly afterwards, so a full bitmap costs time and never a result.  The join
is by broadcast while the test windows stay below ``BROADCAST_WINDOWS``, and by a
salted shuffle beyond, as one window may stand in a third of all conversations.
Equal test items are joined once per class.

Defined results: null values and sentences have no window; sentences or values
under eight words are no case; repeats of a conversation count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import TOKENIZER, eval_split, public_words, quoted_words, ref_sentences, word_arrays
from millrace.runtime import materialize, width

WINDOW = 8
BITS = 27  # the bitmap has 2^BITS bits: at most 16 MB reach the driver and every task
BROADCAST_WINDOWS = 1 << 20
MIN_FIXED = 4  # words outside the slots that a template of ``reparameterised`` has at least
_UNITS = frozenset("mm cm m km px pixel pixels kg g mg s ms min h hz khz mhz kb mb gb percent".split())
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def kind_of(word: str, vocabulary: frozenset[str]) -> str:
    """The placeholder of a word, or the word itself."""
    return "\x01unit" if word in _UNITS else word if word in vocabulary else "\x01num" if word.isdecimal() else "\x01name"


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, dtype=np.uint64)


class Windows:
    """The windows of a batch of word lists, all hashed at once.

    ``text`` number of the list, ``at`` place of the first word among all words,
    ``template`` and ``slots`` 64-bit hashes, ``fixed`` words outside the slots.
    """

    def __init__(self, texts: list[list[str]], vocabulary: frozenset[str]) -> None:
        self.code_of: dict[str, int] = {}
        code_of = self.code_of
        codes = np.array([code_of.setdefault(w, len(code_of)) for ws in texts for w in ws], dtype=np.int64)
        words = list(code_of)
        kinds = [kind_of(w, vocabulary) for w in words]
        own = _hashes(words)
        self.slot = np.array([k is not w for k, w in zip(kinds, words, strict=True)], dtype=bool)[codes] if words else np.zeros(0, dtype=bool)
        template, value = _hashes(kinds)[codes], np.where(self.slot, own[codes], np.uint64(0))
        length = np.array([len(ws) for ws in texts], dtype=np.int64)
        end = np.repeat(np.cumsum(length), length)
        self.at = np.flatnonzero(end - np.arange(len(codes)) >= WINDOW)
        self.text = np.repeat(np.arange(len(texts)), length)[self.at]
        self.codes, self.words = codes, words
        self.template, self.slots, power = np.zeros(len(self.at), dtype=np.uint64), np.zeros(len(self.at), dtype=np.uint64), np.uint64(1)
        self.fixed = np.zeros(len(self.at), dtype=np.int64)
        with np.errstate(over="ignore"):
            for j in range(WINDOW):
                self.template += template[self.at + j] * power
                self.slots += value[self.at + j] * power
                self.fixed += ~self.slot[self.at + j]
                power = power * _STEP

    def same(self) -> np.ndarray:
        """Which slots of a window are equal to each other, as bits."""
        out = np.zeros(len(self.at), dtype=np.int64)
        for n, (a, b) in enumerate((a, b) for b in range(WINDOW) for a in range(b)):
            out |= (self.slot[self.at + a] & (self.codes[self.at + a] == self.codes[self.at + b])).astype(np.int64) << n
        return out

    def values(self, k: int) -> str:
        """The slots of window ``k`` as text."""
        return " ".join(self.words[c] for c, s in zip(self.codes[self.at[k] : self.at[k] + WINDOW], self.slot[self.at[k] : self.at[k] + WINDOW], strict=True) if s)


def _bit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((a ^ (b * _MIX)) * _STEP >> np.uint64(64 - BITS)).astype(np.int64)


def eval_classes(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evaluation sentences as classes of equal words: ``class_id, words`` and ``class_id, sent_id``."""
    s = ref_sentences(refs).where(eval_split(F.col("split")))
    # filtered after it is written: a filter on a Python column would evaluate it twice
    s = materialize(s.select("sent_id", word_arrays("quoted")("sent").alias("words")), "p5-eval").where(F.size("words") >= WINDOW)
    classes = s.groupBy("words").agg(F.min("sent_id").alias("class_id"))
    return classes, s.join(classes, "words").select("class_id", "sent_id")


def corpus_values(conversations: DataFrame) -> DataFrame:
    """``conv_id, value`` of every value; equal values of a conversation count once."""
    values = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.explode(F.array_distinct("conversations.value")).alias("value"))
    return values.where(F.col("value").isNotNull())


def windows(df: DataFrame, key: str, text: str, tokenizer: str, member: Callable | None = None, templates: bool = False) -> DataFrame:
    """``key, template, slots`` (with ``templates`` also ``same, given`` of the windows with slots) of every window ``member`` lets through."""
    vocabulary = public_words(tokenizer)
    read = df.schema[text].dataType.typeName() == "string"
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            w = Windows([quoted_words(t) for t in lists] if read else lists, vocabulary)
            same = w.same() if templates else np.zeros(0, dtype=np.int64)
            other = same.view(np.uint64) if templates else w.slots
            bit = _bit(w.template, other)
            kept = member(bit) if member else np.ones(len(bit), dtype=bool)
            keep = np.flatnonzero(kept & (w.fixed >= MIN_FIXED) & (w.fixed < WINDOW) if templates else kept)
            columns = [batch.column(0).take(pa.array(w.text[keep])), pa.array(w.template[keep].view(np.int64)), pa.array(w.slots[keep].view(np.int64)), pa.array(bit[keep])]
            names = [key, "template", "slots", "bit"]
            if templates:
                columns += [pa.array(same[keep]), pa.array([w.values(k) for k in keep], type=pa.string())]
                names += ["same", "given"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, template bigint, slots bigint, bit bigint" + (", same bigint, given string" if templates else ""))


def bitmap(test: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Membership in the bits of the test windows; the bitmap's size is fixed by ``BITS``."""
    rows = test.groupBy(F.shiftright("bit", 15).alias("k")).agg(F.call_function("bitmap_construct_agg", F.col("bit").bitwiseAND(F.lit(32767))).alias("b")).collect()
    bits = np.zeros(max(1, (1 << BITS) >> 15) * 4096, dtype=np.uint8)
    for r in rows:
        bits[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(bytes(r["b"]), dtype=np.uint8)
    return lambda bit: bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1


def _meet(hits: DataFrame, test: DataFrame, on: list[str], key: str) -> DataFrame:
    """Hash join of the windows; by broadcast while the test side is small, else salted by the corpus key."""
    if test.count() <= BROADCAST_WINDOWS:
        return hits.join(F.broadcast(test), on)
    n = max(8, width(test.sparkSession) // 8)
    salted = test.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return hits.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def found(refs: DataFrame, conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``sent_id, conv_id`` of every quotation of eight or more consecutive words: equal template, equal slots."""
    classes, members = eval_classes(refs)
    test = materialize(windows(classes, "class_id", "words", tokenizer), "p5-windows")
    hits = windows(corpus_values(conversations), "conv_id", "value", tokenizer, bitmap(test)).drop("bit")
    pairs = _meet(hits, test.select("class_id", "template", "slots").distinct(), ["template", "slots"], "conv_id").select("class_id", "conv_id").distinct()
    return pairs.join(members, "class_id").select("sent_id", "conv_id")


def reparameterised(refs: DataFrame, conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``sent_id, conv_id, test_slots, corpus_slots, n_windows``: conversations that ask a test item again with other slots.

    One row for every test sentence and every conversation with a window of the
    same template, slots equal to each other at the same places and other slots than
    the sentence has.  A window that quotes the sentence itself is none; one that
    quotes another sentence is.  The slots are those of the least windows,
    ``n_windows`` counts the conversation's windows.
    """
    classes, members = eval_classes(refs)
    test = materialize(windows(classes, "class_id", "words", tokenizer, templates=True), "p5-templates")
    hits = windows(corpus_values(conversations), "conv_id", "value", tokenizer, bitmap(test), templates=True).drop("bit")
    # one row for every window of a conversation, whatever the number of its turns
    hits = hits.groupBy("conv_id", "template", "same", "slots").agg(F.min("given").alias("given"))
    of_class = test.groupBy("class_id", "template", "same").agg(F.min("given").alias("test_slots"), F.collect_set("slots").alias("own"))
    met = _meet(hits, of_class, ["template", "same"], "conv_id").where(~F.array_contains("own", F.col("slots")))
    told = met.groupBy("class_id", "conv_id").agg(F.min(F.struct("test_slots", F.col("given").alias("corpus_slots"))).alias("s"), F.count_distinct("template", "slots").alias("n_windows"))
    return told.join(members, "class_id").select("sent_id", "conv_id", "s.test_slots", "s.corpus_slots", "n_windows")


def report(refs: DataFrame, conversations: DataFrame) -> DataFrame:
    """Leaked test items: ``sent_id, n_conversations``."""
    return found(refs, conversations).groupBy("sent_id").agg(F.count(F.lit(1)).alias("n_conversations"))
