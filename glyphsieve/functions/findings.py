"""Findings: how sure one is, whether it calls for action, what evidence it is, and its SARIF rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

LEVELS = ("confirmed", "probable", "informational", "likely_false_positive")

def _any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def confidence(finding: Column) -> Column:
    t = F.lower(finding)
    return (
        F.when(t.startswith("layer-a") & t.endswith("(space)"), "informational")
        .when(_any(t, fixed.CONFIRMED), "confirmed")
        .when(t.startswith("info:") | _any(t, fixed.INFORMATIONAL), "informational")
        .when(F.contains(t, F.lit("byte-scan")), "likely_false_positive")
        .when(_any(t, fixed.PROBABLE), "probable")
        .otherwise("informational")
    )


def text_hit_confidence(kind: Column) -> Column:
    return F.when(kind == "space", "informational").otherwise("probable")


def is_actionable(has_c2pa: Column, confidences: Column) -> Column:
    return F.coalesce(has_c2pa, F.lit(False)) | F.arrays_overlap(confidences, F.array(F.lit("confirmed"), F.lit("probable")))


def evidence(has_c2pa: Column, has_ai: Column, suspicious_total: Column, watermarked: Column, score: Column) -> Column:
    """``struct<provenance,layer_a_unicode,watermark_detector,stylometry,suspicious>``; unknown counts as no evidence."""
    no = lambda c: F.coalesce(c, F.lit(False))
    parts = {"provenance": no(has_c2pa) | no(has_ai), "layer_a_unicode": no(suspicious_total > 0), "watermark_detector": no(watermarked), "stylometry": no(score >= 0.65)}
    return F.struct(*[c.alias(k) for k, c in parts.items()], reduce(lambda a, b: a | b, parts.values()).alias("suspicious"))


def sarif_rule(finding: Column, has_c2pa: Column) -> Column:
    t = F.lower(finding)
    return F.when(F.contains(t, F.lit("c2pa")) | F.contains(t, F.lit("jumbf")) | F.coalesce(has_c2pa, F.lit(False)), "AI-WATERMARK-C2PA").when(F.contains(t, F.lit("layer-a")), "AI-WATERMARK-UNICODE-LAYER-A").when(F.contains(t, F.lit("stylometry")), "AI-STYLES-HIGH-PROBABILITY").otherwise("AI-WATERMARK-METADATA")


def sarif_level(rule: Column, level: Column) -> Column:
    return F.when(rule == "AI-WATERMARK-C2PA", "error").when(rule == "AI-STYLES-HIGH-PROBABILITY", "note").when(rule == "AI-WATERMARK-UNICODE-LAYER-A", F.when(level.isin("confirmed", "probable"), "warning").otherwise("note")).when(level == "confirmed", "error").when(level == "informational", "note").otherwise("warning")


def probe_note(available: Column, ok: Column, error: Column) -> Column:
    """What a provenance probe that gave no answer leaves to say; null if it answered."""
    tail = F.lit("); C2PA not fully inspected by this tool")
    return F.when(~available, F.concat(F.lit("c2patool unavailable ("), F.coalesce(error, F.lit("not found")), tail)).when(~F.coalesce(ok, F.lit(True)), F.concat(F.lit("c2patool probe inconclusive ("), F.coalesce(error, F.lit("no usable verdict")), tail))
