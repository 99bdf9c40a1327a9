"""Plan arithmetic as column expressions: buckets, rules, bitrates, scores, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heights, rule tables (first match wins), ladder and profiles.
HEIGHTS = (480, 720, 1080)
HEIGHT_FLOORS = ((0.45, 0.78, 0.78, 1080), (0.12, 0.5, 0.5, 720), (0.0, 0.0, 0.0, 480))
AUDIO_TIERS = ((0.45, 0.78, 0.78, 128), (0.12, 0.0, 0.0, 128), (0.08, 0.0, 0.0, 96), (0.0, 0.0, 0.0, 64))
AUDIO_PRESSURE = ((0.65, 32), (0.45, 32))
AUDIO_LEAST, AUDIO_MOST, AUDIO_STEP = 64, 128, 32
LADDER = {480: (430, 980), 720: (980, 2150), 1080: (1950, 3900)}
PROFILES = {
    "none": {"max_height": 1080, "min_height": 480, "dynamic": False, "bias": 1.0, "estimate": 1.0, "fps": None},
    "high": {"max_height": 1080, "min_height": 480, "dynamic": False, "bias": 0.90, "estimate": 0.76, "fps": None},
    "balanced": {"max_height": 1080, "min_height": 720, "dynamic": True, "bias": 0.62, "estimate": 0.50, "fps": 30.0},
    "aggressive": {"max_height": 720, "min_height": 480, "dynamic": True, "bias": 0.38, "estimate": 0.32, "fps": 24.0},
}
IMAGE_PROFILES = {
    "none": {"quality": 100, "least_quality": 100, "least_scale": 1.0, "estimate": 1.0},
    "lossless": {"quality": 100, "least_quality": 100, "least_scale": 1.0, "estimate": 0.95},
    "high": {"quality": 95, "least_quality": 85, "least_scale": 1.0, "estimate": 0.92},
    "balanced": {"quality": 85, "least_quality": 75, "least_scale": 1.0, "estimate": 0.82},
    "aggressive": {"quality": 75, "least_quality": 75, "least_scale": 0.8, "estimate": 0.72},
}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def even_up(x: Column) -> Column:
    """SCL-20: the next even number, 2 at least."""
    return F.greatest(F.lit(2), F.ceil(x / 2) * 2).cast("long")


def mb_to_bytes(mb: Column) -> Column:
    """SCL-20: decimal megabytes; null unless positive."""
    return F.when((mb > 0) & (mb < float("inf")), (mb * 1_000_000).cast("long"))


def bucket_at_least(x: Column) -> Column:
    return F.when(x <= 480, 480).when(x <= 720, 720).otherwise(1080)


def bucket_at_most(x: Column) -> Column:
    return F.when(x >= 1080, 1080).when(x >= 720, 720).otherwise(480)


def height_bucket(px: Column, least: Column, most: Column) -> Column:
    """SCL-21: the lowest bucket that holds the height, between two bounds."""
    most = bucket_at_most(F.least(most, F.lit(1080)))
    least = F.least(bucket_at_least(F.greatest(least, F.lit(480))), most)
    return F.least(F.greatest(bucket_at_least(px), least), most)


def bucket_below(bucket: Column, least: Column) -> Column:
    """SCL-21: one bucket down, not below the bound."""
    least = F.least(bucket_at_least(F.greatest(least, F.lit(480))), bucket)
    return F.greatest(F.when(bucket >= 1080, 720).otherwise(480), least)


def rule_matches(area: Column, width: Column, height: Column, rule: tuple[float, float, float, int]) -> Column:
    """FLT-12: any positive minimum that is reached; a rule without minimums always matches."""
    tests = [v >= least for v, least in zip((area, width, height), rule, strict=False) if least > 0]
    out = tests[0] if tests else F.lit(True)
    for t in tests[1:]:
        out = out | t
    return out


def first_rule(area: Column, width: Column, height: Column, rules: tuple, default: int) -> Column:
    out = F.lit(default)
    for r in reversed(rules):
        out = F.when(rule_matches(area, width, height, r), F.lit(r[3])).otherwise(out)
    return out


def height_floor(area: Column, width: Column, height: Column) -> Column:
    """SCL-22."""
    return first_rule(area, width, height, HEIGHT_FLOORS, 480)


def audio_kbps(has_audio: Column, area: Column, width: Column, height: Column, ratio: Column, source_kbps: Column) -> Column:
    """SCL-22: the tier's rate, less for each pressure bound that the ratio is under, within the source's rate."""
    target = first_rule(area, width, height, AUDIO_TIERS, AUDIO_LEAST)
    for below, less in AUDIO_PRESSURE:
        target = target - F.when(ratio < below, less).otherwise(0)
    rounded = F.greatest(F.lit(1), F.floor(source_kbps / AUDIO_STEP) * AUDIO_STEP).cast("int")
    most = F.when(source_kbps > 0, F.least(F.lit(AUDIO_MOST), rounded)).otherwise(AUDIO_MOST)
    return F.when(~has_audio, 0).when(most < AUDIO_LEAST, most).otherwise(F.least(most, F.greatest(F.lit(AUDIO_LEAST), target))).cast("int")


def ladder(height: Column, which: int) -> Column:
    """SUP-09: the least (0) or best (1) rate of a height."""
    return F.when(height == 480, LADDER[480][which]).when(height == 720, LADDER[720][which]).when(height == 1080, LADDER[1080][which])


def bitrate_bounds(height: Column, source_kbps: Column) -> tuple[Column, Column]:
    """SCL-23: least and most, both capped by the source."""
    cap = F.when(source_kbps > 1, source_kbps).otherwise(ladder(height, 1))
    least = F.least(ladder(height, 0), cap)
    return least, F.greatest(F.least(ladder(height, 1), cap), least)


def priority(area: Column, size: Column, kbps: Column, seconds: Column, median_size: Column, median_kbps: Column) -> Column:
    """SCL-24."""
    root = lambda x, m: clamp(F.sqrt(x / F.greatest(F.lit(1.0), m.cast("double"))), 0.7, 1.6)
    return F.pow(F.greatest(F.lit(0.04), area), 0.6) * root(size, median_size) * root(kbps, median_kbps) * seconds


def importance(area: Column, uses: Column, content: Column) -> Column:
    """SCL-25."""
    reuse = F.least(F.lit(0.15), F.log2(F.greatest(F.lit(1), uses)) * 0.05)
    bonus = F.when(content.isin("line_art", "screenshot_or_text", "transparent"), 0.1).otherwise(0.0)
    return clamp(F.lit(0.65) + F.sqrt(clamp(area, 0.01, 1.0)) * 0.35 + reuse + bonus, 0.65, 1.25)


def quality_threshold(base: float, area: Column, uses: Column, redline: float) -> Column:
    """SCL-26."""
    adjusted = F.lit(base) + (F.sqrt(clamp(area, 0.01, 1.0)) - 0.5) * 0.04 + F.least(F.lit(0.015), F.log2(F.greatest(F.lit(1), uses)) * 0.005)
    return F.bround(clamp(adjusted, redline, 0.995), 4)


def scaled(width: Column, height: Column, most_width: int = 1920, most_height: int = 1080) -> tuple[Column, Column]:
    """SCL-29: within an envelope turned to the picture's orientation, even, 2 at least."""
    wide = width >= height
    lw, lh = F.when(wide, most_width).otherwise(most_height), F.when(wide, most_height).otherwise(most_width)
    scale = F.least(F.lit(1.0), lw / width, lh / height)
    even = lambda x: F.greatest(F.lit(2), F.floor((x * scale).cast("long") / 2) * 2).cast("long")
    return even(width), even(height)


def frame_rate(text: Column) -> Column:
    """SCL-30: "30000/1001" or "25"; 0 where it can't be read."""
    p = F.split(text, "/")
    a, b = F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double")
    return F.when(F.size(p) == 1, F.coalesce(a, F.lit(0.0))).when((F.size(p) == 2) & (b != 0), F.coalesce(a / b, F.lit(0.0))).otherwise(0.0)


def package_reserve(target: Column, other: Column) -> Column:
    """SCL-31."""
    half_percent = (F.greatest(F.lit(0), target - other) * 0.005).cast("long")
    return F.least(F.lit(1_000_000), F.greatest(F.lit(64_000), half_percent)).cast("long")


def similarity_score(distance: Column, ratio_difference: Column) -> Column:
    """SCL-32."""
    return F.bround(F.greatest(F.lit(0.0), F.lit(100.0) - 8 * distance - 100 * ratio_difference), 1)


def ssim_grade(x: Column) -> Column:
    """SCL-34."""
    return F.when(x >= 0.98, "A+").when(x >= 0.95, "A").when(x >= 0.90, "B").otherwise("C")
