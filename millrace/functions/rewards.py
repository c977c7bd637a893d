"""Mask-token text rules: extraction, repair, graded matching, rewards per source.  JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import parse_json
from millrace.registry import Registry

REWARDS = Registry("reward")
#: One whole mask (two codes of four digits), any token, a grounded phrase with its mask, the filler code.
MASK = r"(<\|mt_start\|><\|mt_\d{4}\|><\|mt_\d{4}\|><\|mt_end\|>)"
TOKEN = r"(<\|[^|]*\|>)"
GROUNDED = r"<\|object_ref_start\|>(.*?)\s*<\|object_ref_end\|>\s*(<\|mt_start\|>(?:<\|mt_\d+\|>){2}<\|mt_end\|>)"
FILLER = "<|mt_9999|>"
#: The marks and codes of masks; masks of too many codes, of one code with and without an end; a scene-graph triplet.
SPECIAL = r"<\|mt_(start|end|\d{4})\|>"
TOO_MANY = r"(<\|mt_start\|>)(<\|mt_\d+\|>)(<\|mt_\d+\|>)(?:<\|mt_\d+\|>)+<\|mt_end\|>"
ONE_CLOSED = r"(<\|mt_start\|>)(<\|mt_\d+\|>)(<\|mt_end\|>)"
ONE_OPEN = r"(<\|mt_start\|>)(<\|mt_\d+\|>)(?!<\|mt_)"
TRIPLET_TEXT = (
    r'(\{\s*"subject"\s*:\s*\{\s*"mask_2d"\s*:\s*"[^"]*"\s*,\s*"label"\s*:\s*"[^"]*"\s*\}\s*,\s*"predicate"\s*:\s*"[^"]*"\s*,'
    r'\s*"object"\s*:\s*\{\s*"mask_2d"\s*:\s*"[^"]*"\s*,\s*"label"\s*:\s*"[^"]*"\s*\}\s*\})'
)


def code_ids(text: Column) -> Column:
    """Every four-digit code as an int."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"<\|mt_(\d{4})\|>"), F.lit(1)), lambda x: x.cast("int"))


def masks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MASK), F.lit(1))


def pair_ids(text: Column) -> Column:
    """The codes of well-formed masks, flattened."""
    return F.flatten(F.transform(masks(text), code_ids))


def strip_masks(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL, "")


def repair_short(text: Column) -> Column:
    """Masks of one code get the filler, an end mark is added where it lacks."""
    filler = f"$1$2{FILLER}<|mt_end|>"
    return F.regexp_replace(F.regexp_replace(text, ONE_CLOSED, filler), ONE_OPEN, filler)


def repair(text: Column) -> Column:
    """Masks of more than two codes lose the rest, then as ``repair_short``."""
    return repair_short(F.regexp_replace(text, TOO_MANY, "$1$2$3<|mt_end|>"))


def think_and_answer(text: Column) -> tuple[Column, Column]:
    """The two tagged parts; where one lacks, the text is cut at the answer's opening or the thought's closing tag."""

    def tagged(tag: str) -> Column:
        return F.when(text.rlike(rf"(?s)<{tag}>.*?</{tag}>"), F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1))

    def cut(mark: str) -> tuple[Column, Column]:
        at = F.locate(mark, text)
        return F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(mark), F.length(text))

    (h1, t1), (h2, t2) = cut("<answer>"), cut("</think>")
    by = lambda a, b: F.when(text.contains("<answer>"), a).when(text.contains("</think>"), b)
    return F.coalesce(tagged("think"), by(h1, h2)), F.coalesce(tagged("answer"), by(t1, t2))


@REWARDS.register("format")
def format_reward(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z").cast("double"), F.lit(0.0))


def grade(pred: Column, target: Column) -> Column:
    """1 for the same mask, 0.8 where all but the end agree, 0.4 where the first code agrees."""
    parts = lambda c: F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1))
    head = lambda c, k: F.array_join(F.slice(parts(c), F.lit(1), F.greatest(F.size(parts(c)) - k, F.lit(0))), "")
    return F.when(pred == target, 1.0).when(head(pred, 1) == head(target, 1), 0.8).when(head(pred, 2) == head(target, 2), 0.4).otherwise(0.0)


def _graded(pred: Column, target: Column) -> Column:
    best = F.transform(F.array_distinct(pred), lambda p: F.coalesce(F.array_max(F.transform(F.array_distinct(target), lambda t: grade(p, t))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x)


@REWARDS.register("mask_tokens")
def mask_token_reward(answer: Column, truth: Column) -> Column:
    """Distinct predicted masks graded against the target, over the larger raw count; both without masks give 1."""
    p, t = masks(answer), masks(truth)
    most = F.greatest(F.size(p), F.size(t))
    return F.when(answer.isNull(), 0.0).when(most == 0, 1.0).otherwise(_graded(p, t) / most)


def phrase_masks(text: Column) -> tuple[Column, Column]:
    """Phrases (lower case, single blanks, empty ones dropped) and masks of grounded captions."""
    phrase = F.transform(F.regexp_extract_all(text, F.lit(GROUNDED), F.lit(1)), lambda p: F.trim(F.regexp_replace(F.lower(p), r"\s*\x20\s*", " ")))
    mask = F.transform(F.regexp_extract_all(text, F.lit(GROUNDED), F.lit(2)), lambda m: F.concat(F.lit("<|object_ref_end|>"), m))
    return F.filter(phrase, lambda p: p != ""), mask


@REWARDS.register("gcg_masks")
def gcg_mask_reward(answer: Column, truth: Column) -> Column:
    """As ``mask_token_reward`` on grounded captions; null where neither side has a mask."""
    p, t = phrase_masks(answer)[1], phrase_masks(truth)[1]
    most = F.greatest(F.size(p), F.size(t))
    return F.when(answer.isNull(), 0.0).when(most > 0, _graded(p, t) / most)


@REWARDS.register("gcg_phrases")
def gcg_phrase_reward(answer: Column, truth: Column) -> Column:
    p, t = phrase_masks(answer)[0], phrase_masks(truth)[0]
    return F.when(answer.isNull(), 0.0).when(F.size(t) == 0, 1.0).otherwise(F.size(F.array_intersect(p, t)) / F.greatest(F.size(p), F.size(t)))


@REWARDS.register("non_repeat")
def non_repeat_reward(text: Column, most: int = 3) -> Column:
    """0 where a mask stands more than ``most`` times."""
    found = masks(text)
    often = F.exists(F.array_distinct(found), lambda m: F.size(F.filter(found, lambda x: x == m)) > most)
    return F.when(text.isNull(), 0.0).otherwise(F.when(often, 0.0).otherwise(1.0))


_SIDE = "struct<label:string,mask_2d:string>"
TRIPLET = f"struct<subject:{_SIDE},predicate:string,object:{_SIDE}>"


def triplets(text: Column) -> Column:
    """``array<struct<raw, t>>``: scene-graph objects of a text, mask before label, as they stand and read; unreadable ones dropped."""
    raw = F.regexp_extract_all(text, F.lit(TRIPLET_TEXT), F.lit(1))
    read = F.transform(raw, lambda t: F.struct(t.alias("raw"), F.from_json(t, TRIPLET, {"mode": "PERMISSIVE"}).alias("t"), parse_json(t).isNotNull().alias("ok")))
    return F.transform(F.filter(read, lambda t: t["ok"]), lambda t: F.struct(t["raw"], t["t"]))


@REWARDS.register("psg")
def scene_graph_reward(answer: Column, truth: Column) -> Column:
    """Triplets of distinct text: 1 where the text stands in the truth, else half for the same labels plus a quarter of each graded mask; null where neither side has one."""
    p, t = triplets(answer), triplets(truth)
    name = lambda x: F.concat_ws("#", x["subject"]["label"], x["predicate"], x["object"]["label"])

    def against(x: Column, y: Column) -> Column:
        half = F.lit(0.5) + grade(x["subject"]["mask_2d"], y["subject"]["mask_2d"]) * 0.25 + grade(x["object"]["mask_2d"], y["object"]["mask_2d"]) * 0.25
        return F.when(name(x) == name(y), half).otherwise(0.0)

    known = F.transform(t, lambda y: y["raw"])
    score = F.transform(
        F.array_distinct(p), lambda x: F.when(F.array_contains(known, x["raw"]), 1.0).otherwise(F.coalesce(F.array_max(F.transform(t, lambda y: against(x["t"], y["t"]))), F.lit(0.0)))
    )
    most = F.greatest(F.size(p), F.size(t))
    return F.when(most > 0, F.aggregate(score, F.lit(0.0), lambda a, x: a + x) / most)


def scene_graph_fresh(text: Column, most: int = 2) -> Column:
    """0 where a triplet stands more than ``most`` times in the same words, 1 else."""
    raw = F.transform(triplets(text), lambda x: x["raw"])
    often = F.exists(F.array_distinct(raw), lambda m: F.size(F.filter(raw, lambda x: x == m)) > most)
    return F.when(often, 0.0).otherwise(1.0)


#: The sources of every kind of reward.
SOURCES = {
    "thinking": ("thinking_res", "thinking_gres", "thinking_ver", "reasonseg"),
    "grounded": ("glamm_gcg",),
    "plain": ("padt_gcg", "dw_gcg", "res", "gres", "ver", "coconut_seg"),
    "graph": ("psg",),
}


def score(source: Column, response: Column, truth: Column) -> Column:
    """``struct<overall, format, accuracy, phrase_accuracy, no_repeat, think_no_repeat>``: the sum of the parts that count for a source.

    Thinking sources: accuracy of the answer, format and both parts free of repeats;
    grounded captions: masks, phrases, no repeats; plain ones and graphs: accuracy,
    no repeats and a constant phrase score of 1.  Another source is an error.
    """
    think, answer = think_and_answer(response)
    one, none = F.lit(1.0), F.lit(None).cast("double")
    kinds = {
        "thinking": (format_reward(response), mask_token_reward(answer, truth), none, non_repeat_reward(answer), non_repeat_reward(think)),
        "grounded": (none, gcg_mask_reward(response, truth), gcg_phrase_reward(response, truth), non_repeat_reward(response), none),
        "plain": (none, mask_token_reward(response, truth), one, non_repeat_reward(response), none),
        "graph": (none, scene_graph_reward(response, truth), one, scene_graph_fresh(response), none),
    }
    names, out = ("format", "accuracy", "phrase_accuracy", "no_repeat", "think_no_repeat"), None
    kind = "struct<overall:double,format:double,accuracy:double,phrase_accuracy:double,no_repeat:double,think_no_repeat:double>"
    for family, parts in kinds.items():
        counted = [c for c in parts if c is not none]
        overall = counted[0]
        for c in counted[1:]:
            overall = overall + c
        row = F.struct(overall.alias("overall"), *[c.alias(n) for c, n in zip(parts, names, strict=True)]).cast(kind)
        test = source.isin(*SOURCES[family])
        out = F.when(test, row) if out is None else out.when(test, row)
    return out.otherwise(F.raise_error(F.concat(F.lit("no reward for source "), F.coalesce(source, F.lit("null")))).cast(kind))


def mask_token_text(codes: Column, codebook: int = 256) -> Column:
    """Token text of a mask from one code per depth: depth * codebook + code, four digits."""
    token = F.transform(codes, lambda c, d: F.concat(F.lit("<|mt_"), F.lpad((d * codebook + c).cast("string"), 4, "0"), F.lit("|>")))
    return F.concat(F.lit("<|mt_start|>"), F.array_join(token, ""), F.lit("<|mt_end|>"))
