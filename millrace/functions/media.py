"""Plans for media that need no codec: frame counts, groupings, sample ranges, tile borders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def available_frames(n_frames: Column, seconds: Column | None, source_rate: Column, rate: float | None = None) -> Column:
    """Frames there are at the wanted rate: by duration (or frames over source rate); without a rate all."""
    if rate is None:
        return n_frames.cast("int")
    length = n_frames / source_rate
    return F.floor((length if seconds is None else F.coalesce(seconds, length)) * F.lit(rate)).cast("int")


def grouped_frames(n: Column, factor: int, rest: int) -> Column:
    """The most frames of the form ``factor * k + rest`` with k of at least one; too few frames are an error."""
    used = F.greatest(F.lit(1), F.floor((n - rest) / factor)) * factor + rest
    return F.when(used <= n, used.cast("int")).otherwise(F.raise_error(F.concat(n.cast("string"), F.lit(" frames are fewer than "), used.cast("string"))).cast("int"))


def sample_range(rate: Column, start: Column | float, seconds: Column | float | None, total: Column) -> Column:
    """``struct<first, last>``: the half-open range of samples of a cut of an audio track."""
    lit = lambda v: F.lit(v) if isinstance(v, (int, float)) else v
    first = F.least(F.floor(lit(start) * rate), total)
    last = total if seconds is None else F.coalesce(F.least(F.floor((lit(start) + lit(seconds)) * rate), total), total)
    return F.struct(first.cast("bigint").alias("first"), F.greatest(first, last).cast("bigint").alias("last"))


def cut(samples: Column, span: Column) -> Column:
    """The samples of a range."""
    return F.slice(samples, (span["first"] + 1).cast("int"), (span["last"] - span["first"]).cast("int"))


def resample(samples: Column, rate: Column, target: int) -> Column:
    """A waveform at another rate by linear interpolation between neighbours; an empty one stays empty."""
    n = F.size(samples)
    m = F.ceil(n * F.lit(target) / rate).cast("int")

    def at(k: Column) -> Column:
        x = k * rate / F.lit(float(target))
        i = F.least(F.floor(x), (n - 1).cast("bigint")).cast("int")
        a, b = F.get(samples, i), F.get(samples, F.least(i + 1, n - 1))
        return a + (b - a) * (F.least(x, (n - 1).cast("double")) - i)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(F.array().cast("array<double>"))


def halve(mask: Column, height: Column, width: Column) -> Column:
    """A 0/1 mask in row order at half its size, by the nearest pixel up and left."""
    h, w = F.greatest(F.lit(1), F.floor(height / 2)), F.greatest(F.lit(1), F.floor(width / 2))
    place = lambda k: (F.floor(F.floor(k / w) * height / h) * width + F.floor(k % w * width / w)).cast("int")
    return F.transform(F.sequence(F.lit(0).cast("bigint"), h * w - 1), lambda k: F.get(mask, place(k)))
