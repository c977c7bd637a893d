"""Padding, masks, quantisation, run lengths, boxes, sizes and sampling grids (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad(a: Column, n: Column | int, fill: Column, left: bool = False) -> Column:
    """Padded to ``n`` elements; longer arrays stay."""
    extra = F.array_repeat(fill, F.greatest((F.lit(n) if isinstance(n, int) else n) - F.size(a), F.lit(0)))
    return F.concat(extra, a) if left else F.concat(a, extra)


def fit(a: Column, n: int, fill: Column, left_pad: bool = True, truncation: str = "error") -> Column:
    """Exactly ``n`` elements: padded, or truncated at the left or right end, or an error."""
    if truncation == "left":
        cut = F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, F.lit(n))
    elif truncation == "right":
        cut = F.slice(a, 1, n)
    else:
        cut = F.when(F.size(a) > n, F.raise_error(F.lit(f"longer than {n}"))).otherwise(a)
    return pad(cut, n, fill, left_pad)


def attention(a: Column, fill: int) -> Column:
    return F.transform(a, lambda x: (x != fill).cast("int"))


def response_mask(ids: Column, eos: list[int]) -> Column:
    """1 up to and including the first end token, 0 after."""
    hits = [F.array_position(ids, F.lit(e)) for e in eos]
    first = F.array_min(F.filter(F.array(*hits), lambda p: p > 0))
    n = F.coalesce(first, F.size(ids)).cast("int")
    return F.when(ids.isNotNull(), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.size(ids) - n)))


def first_index(a: Column, value: Column) -> Column:
    """0-based place of the first equal element, -1 where there is none."""
    return F.coalesce(F.array_position(a, value), F.lit(0)) - 1


def _labelled(ids: Column, spans: Column, ignore: int) -> Column:
    """``ids`` within the half-open ``spans`` (in order, apart), ``ignore`` elsewhere; linear in the length."""
    n = F.size(ids)
    fill = lambda k: F.array_repeat(F.lit(ignore).cast("bigint"), F.greatest(k, F.lit(0)).cast("int"))
    cut = lambda a, b: F.slice(ids.cast("array<bigint>"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    before = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["b"]))
    parts = F.transform(spans, lambda s, i: F.concat(fill(s["a"] - F.get(before, i)), cut(s["a"], s["b"])))
    return F.when(ids.isNotNull(), F.concat(F.flatten(parts), fill(n - F.coalesce(F.element_at(before, -1), F.lit(0)))))


def label_spans(ids: Column, header: list[int], end: int, skip: int = 0, after: int = 1, closed: bool = True, ignore: int = -100) -> Column:
    """Labels of answers: the ids from behind a ``header`` (and ``skip`` more) to its ``end`` token and ``after - 1`` more stay, others become ``ignore``.

    A header within an answer does not count.  A header without an end gives no labels
    (and, where ``closed``, ends the search).
    """
    h, n = len(header), F.size(ids)
    window = lambda i: F.slice(ids, (i + 1).cast("int"), F.lit(h)).cast("array<bigint>") == F.array(*[F.lit(x).cast("bigint") for x in header])
    heads = F.array_compact(F.transform(ids, lambda x, i: F.when((x == header[0]) & (i + h <= n) & window(i), i)))
    ends = F.array_compact(F.transform(ids, lambda x, i: F.when(x == end, i)))
    kind = "struct<at:int,done:boolean,out:array<struct<a:int,b:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().alias("out")).cast(kind)

    def step(acc: Column, i: Column) -> Column:
        first = i + h + skip
        stop = F.array_min(F.filter(ends, lambda e: e >= first))
        held = F.struct((stop + after).alias("at"), F.lit(False).alias("done"), F.concat(acc["out"], F.array(F.struct(first.alias("a"), F.least(stop + after, n).alias("b")))).alias("out")).cast(kind)
        lost = F.struct(acc["at"], F.lit(closed).alias("done"), acc["out"]).cast(kind)
        return F.when(acc["done"] | (i < acc["at"]), acc).when(stop.isNotNull(), held).otherwise(lost)

    return _labelled(ids, F.aggregate(heads, start, step, lambda acc: acc["out"]), ignore)


#: The tokens that open and close an answer in the two chat layouts.
FOUR_TOKEN_HEADER, FOUR_TOKEN_END = [128006, 78191, 128007, 271], 128009
ONE_TOKEN_HEADER, ONE_TOKEN_END = [77091], 151645


def header_labels(ids: Column) -> Column:
    """Answers behind the four-token header, their end token included."""
    return label_spans(ids, FOUR_TOKEN_HEADER, FOUR_TOKEN_END)


def role_labels(ids: Column) -> Column:
    """Answers two places behind the role token, their end token and the one after it included."""
    return label_spans(ids, ONE_TOKEN_HEADER, ONE_TOKEN_END, skip=1, after=2, closed=False)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column, eps: float = 0.0) -> Column:
    n = F.sqrt(dot(a, a)) + F.lit(eps)
    return F.transform(a, lambda x: x.cast("double") / n)


def log_prob(logits: Column, label: Column) -> Column:
    top = F.array_max(logits)
    return F.get(logits, label) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def mixed_radix(levels: Column, radix: list[int]) -> Column:
    """One index from the level of every dimension (first dimension least significant)."""
    basis = [1]
    for r in radix[:-1]:
        basis.append(basis[-1] * r)
    return F.aggregate(F.zip_with(levels, F.array(*[F.lit(b) for b in basis]), lambda z, b: z * b), F.lit(0).cast("bigint"), lambda s, x: s + x)


def radix_levels(index: Column, radix: list[int]) -> Column:
    basis, out = 1, []
    for r in radix:
        out.append((F.floor(index / F.lit(basis)) % r).cast("int"))
        basis *= r
    return F.array(*out)


def run_lengths(bits: Column) -> Column:
    """Run lengths of a 0/1 array, the first run counting zeros (0 where it starts with a one)."""
    before = F.concat(F.array(F.lit(0)), F.slice(bits.cast("array<int>"), 1, F.greatest(F.size(bits) - 1, F.lit(0))))
    turns = F.array_compact(F.transform(F.zip_with(bits.cast("array<int>"), before, lambda x, p: x != p), lambda t, i: F.when(t, i)))
    ends, starts = F.concat(turns, F.array(F.size(bits))), F.concat(F.array(F.lit(0)), turns)
    return F.when(F.size(bits) > 0, F.zip_with(ends, starts, lambda b, a: b - a)).when(bits.isNotNull(), F.array(F.lit(0)))


def from_run_lengths(counts: Column) -> Column:
    return F.flatten(F.transform(counts, lambda c, i: F.array_repeat((i % 2).cast("int"), c.cast("int"))))


def mask_iou(a: Column, b: Column) -> Column:
    """IoU of two 0/1 arrays of one length; 0 where both are empty."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda s, x: s + x.cast("int"))
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x, y)), F.lit(0), lambda s, x: s + x.cast("int"))
    return F.when(either > 0, both / either).otherwise(0.0)


def box_iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """IoU of two boxes given as x, y, width, height; 0 where the union is empty."""
    zero = F.lit(0.0)
    w = F.greatest(F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]), zero)
    h = F.greatest(F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]), zero)
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def target_size(height: Column, width: Column, max_pixels: int, factor: int) -> tuple[Column, Column]:
    """Size under a pixel budget, each side a multiple of ``factor``."""
    scale = F.sqrt(height * width / F.lit(float(max_pixels)))
    side = lambda s: F.floor(F.when(height * width > max_pixels, F.floor(s / scale)).otherwise(s) / factor) * factor
    return side(height).cast("int"), side(width).cast("int")


def cover_size(height: Column, width: Column, to_h: Column, to_w: Column) -> tuple[Column, Column]:
    """Size scaled to cover the target before the centre crop (halves to even)."""
    scale = F.greatest(to_w / width, to_h / height)
    return F.bround(height * scale).cast("int"), F.bround(width * scale).cast("int")


def bounded_size(height: Column, width: Column, low: int, high: int) -> tuple[Column, Column]:
    """Size scaled into [low, high] pixels, sides truncated."""
    area = height * width
    factor = F.when(area > high, F.sqrt(F.lit(float(high)) / area)).when(area < low, F.sqrt(F.lit(float(low)) / area)).otherwise(1.0)
    return F.floor(height * factor).cast("int"), F.floor(width * factor).cast("int")


def frame_count(total: Column, asked: int, divisor: int, rest: int) -> Column:
    """Frames to take: as many as asked, or the most with ``n % divisor == rest``, at least one (none of none)."""
    return F.when(total >= asked, asked).when(total <= 1, total).otherwise(F.greatest(F.lit(1), total - F.pmod(total - rest, F.lit(divisor))))


def frame_index(k: Column, rate: float, source_rate: Column, total: Column) -> Column:
    """The source frame nearest to frame ``k`` at another rate, at most the last."""
    return F.least(F.bround(k / F.lit(rate) * source_rate).cast("int"), total - 1)


def uniform_frames(n: Column, k: Column) -> Column:
    """``k`` evenly spread indices of ``n``, repeats removed."""
    return F.when(k <= 1, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("int"))))


def mono(channels: Column) -> Column:
    """Mean over the channels of a waveform."""
    n = F.size(channels)
    first = F.get(channels, F.lit(0))
    return F.transform(first, lambda _, i: F.aggregate(channels, F.lit(0.0), lambda s, c: s + F.get(c, i)) / n)


def stereo(channels: Column) -> Column:
    return F.when(F.size(channels) == 1, F.concat(channels, channels)).otherwise(channels)


def valid_polygons(polygons: Column) -> Column:
    """Rings with an even number of at least six coordinates."""
    return F.filter(polygons, lambda p: (F.size(p) % 2 == 0) & (F.size(p) >= 6))


#: Placeholder tokens of images and videos.
IMAGE_TOKEN, VIDEO_TOKEN = 151655, 151656
_SEGMENT = "struct<n:int,t:int,h:int,w:int,dt:double>"


def media_segments(ids: Column, images: Column, videos: Column | None = None, seconds: Column | None = None, per_second: float = 2.0, merge: int = 2) -> Column:
    """Text and grid segments of a token sequence: the grids (``array<struct<t,h,w>>``) stand where their placeholder tokens begin.

    A video's frames lie ``seconds * per_second`` apart, an image has one time.
    Placeholders beyond the listed grids are text.
    """
    none = F.array().cast("array<struct<t:int,h:int,w:int>>")
    films, gaps = none if videos is None else videos, F.array().cast("array<double>") if seconds is None else seconds.cast("array<double>")
    marks = F.array_compact(F.transform(ids, lambda x, i: F.when(x.isin(IMAGE_TOKEN, VIDEO_TOKEN), F.struct(i.alias("i"), (x == IMAGE_TOKEN).alias("image")))))
    kind = f"struct<at:int,k:int,v:int,out:array<{_SEGMENT}>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(0).alias("v"), F.array().alias("out")).cast(kind)
    seg = lambda n, t, h, w, dt: F.array(F.struct(n.alias("n"), t.alias("t"), h.alias("h"), w.alias("w"), dt.alias("dt"))).cast(f"array<{_SEGMENT}>")
    null = F.lit(None)

    def step(acc: Column, m: Column) -> Column:
        grid = F.when(m["image"], F.get(images, acc["k"])).otherwise(F.get(films, acc["v"]))
        gap = F.when(m["image"], F.lit(0.0)).otherwise(F.coalesce(F.get(gaps, acc["v"]), F.lit(1.0)) * F.lit(per_second))
        size = grid["t"] * F.floor(grid["h"] / merge) * F.floor(grid["w"] / merge)
        more = F.concat(acc["out"], seg(m["i"] - acc["at"], null, null, null, null), seg(F.lit(0), grid["t"], grid["h"], grid["w"], gap))
        took = F.struct((m["i"] + size).alias("at"), (acc["k"] + m["image"].cast("int")).alias("k"), (acc["v"] + (~m["image"]).cast("int")).alias("v"), more.alias("out")).cast(kind)
        return F.when((m["i"] < acc["at"]) | grid.isNull(), acc).otherwise(took)

    done = F.aggregate(marks, start, step)
    return F.concat(done["out"], seg(F.size(ids) - done["at"], null, null, null, null))


def grid_positions(segments: Column, merge: int = 2, timed: bool = False) -> Column:
    """Three-axis positions of a sequence of ``struct<n,t,h,w>`` segments, ``timed`` ones with ``dt``, the time between frames.

    A text segment (``n`` tokens, no grid) counts on all axes alike; a grid of
    ``t`` frames has one position per merged patch, offset by where it starts;
    what follows goes on after the largest position so far.
    """
    axes = "array<struct<t:int,h:int,w:int>>"
    is_grid = lambda s: s["t"].isNotNull() & (s["t"] > 0)
    side = lambda c: F.floor(c / merge).cast("int")
    time = lambda k, s: F.floor(k * F.coalesce(s["dt"], F.lit(1.0))).cast("int") if timed else k
    room = lambda s: F.when(is_grid(s), F.greatest(time(s["t"] - 1, s) + 1, side(s["h"]), side(s["w"]))).otherwise(F.coalesce(s["n"], F.lit(0)))
    # where every segment starts: one number a segment, then all positions at once
    starts = F.aggregate(segments, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array((F.element_at(acc, -1) + room(s)).cast("int"))))

    def of(s: Column, i: Column) -> Column:
        at, h, w = F.get(starts, i), side(s["h"]), side(s["w"])
        three = lambda t, y, x: F.struct((at + t).cast("int").alias("t"), (at + y).cast("int").alias("h"), (at + x).cast("int").alias("w"))
        grid = F.transform(F.sequence(F.lit(0), s["t"] * h * w - 1), lambda k: three(time(F.floor(k / (h * w)), s), F.floor(k / w) % h, k % w))
        words = F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda k: three(k, k, k))
        none = F.array().cast(axes)
        return F.when(is_grid(s), F.when(h * w > 0, grid).otherwise(none)).when(s["n"] > 0, words).otherwise(none)

    return F.flatten(F.transform(segments, of))
