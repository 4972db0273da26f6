"""Text forms of sizes, times and scores. One decimal is rounded half up, as the JVM does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col

UNITS = ("B", "KB", "MB", "GB", "TB")


def human_size(size: str | Column) -> Column:
    """Bytes in units of 1024, one decimal above bytes."""
    n = col(size).cast("double")
    out = F.format_string("%d B", col(size).cast("long"))
    for power, unit in enumerate(UNITS[1:], 1):
        out = F.when(n >= 1024.0**power, F.format_string(f"%.1f {unit}", n / 1024.0**power)).otherwise(out)
    return out


def relative_time(then: str | Column, now: int | Column) -> Column:
    """How long ago `then` was (unix seconds). Not positive or null: a dash. Less than a minute, or in the future: just now."""
    t = col(then)
    gone = (F.lit(now) if isinstance(now, int) else now) - t
    out = F.lit("just now")
    for unit, seconds in (("minute", 60), ("hour", 3600), ("day", 86400), ("month", 30 * 86400), ("year", 365 * 86400)):
        n = F.floor(gone / seconds).cast("long")
        out = F.when(gone >= seconds, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))).otherwise(out)
    return F.when(t.isNull() | (t <= 0), "—").otherwise(out)


def parse_mib(text: str | Column) -> Column:
    """Bytes of a number of MiB typed as text; null unless it is finite and positive."""
    n = F.trim(col(text)).try_cast("double")
    return F.when((n > 0) & ~F.isnan(n) & (n != float("inf")), F.round(n * (1 << 20)).cast("long"))


def badge(score: str | Column) -> Column:
    return F.format_string("%.1f %%", col(score) * 100)


def rounded_threshold(value: str | Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.5), F.round(col(value) * 100) / 100))


def failure_reasons(frame_error: Column, frame_failures: Column, audio_error: Column, audio_failures: Column) -> Column:
    """Why a video has no features, by modality."""
    frames = F.when(frame_error.isNotNull(), F.concat(F.lit("no frame encoder: "), frame_error)).when(frame_failures > 0, F.concat(F.lit("no frame at "), frame_failures.cast("string"), F.lit(" points")))
    audio = F.when(audio_error.isNotNull(), F.concat(F.lit("no audio encoder: "), audio_error)).when(audio_failures > 0, F.concat(F.lit("no audio at "), audio_failures.cast("string"), F.lit(" points")))
    reasons = F.concat_ws("; ", frames, audio)
    return F.when(reasons == "", "no features").otherwise(reasons)
