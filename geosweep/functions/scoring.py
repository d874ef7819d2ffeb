"""Confidence policy, evidence ranking and link scores as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from geosweep.functions.geo import col

#: Thresholds and weights of the policy, evidence and link scores.
FLOOR, HIGH = 0.40, 0.65
SPECIALISTS = ("dota_obb", "sar_cfar", "mvrsd")
OPEN_VOCABULARY = ("sam3", "yoloe")
GENERIC = (
    "plane", "ship", "storage_tank", "baseball_diamond", "tennis_court", "basketball_court", "ground_track_field", "harbor", "bridge",
    "large_vehicle", "small_vehicle", "helicopter", "roundabout", "soccer_ball_field", "swimming_pool", "container_crane", "airport", "helipad",
)
HINTS = (
    (("ship", "vessel", "frigate", "destroyer", "boat"), ("naval", "maritime")),
    (("jet", "plane", "aircraft", "helicopter"), ("aircraft", "airfield", "airbase")),
    (("tank", "armored", "infantry_fighting"), ("armored", "military forces")),
    (("rocket_launcher", "howitzer", "artillery"), ("artillery", "military forces")),
    (("truck", "fuel", "ammo", "ammunition"), ("logistics",)),
)
LINK_WEIGHTS = {"distance": 0.30, "compatibility": 0.30, "confidence": 0.30, "history": 0.10}


def unit(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def calibrate(raw, temperature) -> Column:
    """sigmoid(logit(raw) / T) with T within 0.05..20; 0 and 1 stay, null is 0."""
    raw, t = F.coalesce(col(raw).cast("double"), F.lit(0.0)), F.greatest(F.lit(0.05), F.least(F.lit(20.0), F.coalesce(col(temperature), F.lit(1.0))))
    z = F.log(raw / (1 - raw)) / t
    return F.when((raw <= 0) | F.isnan(raw), F.lit(0.0)).when(raw >= 1, F.lit(1.0)).when(t == 1, raw).otherwise(1 / (1 + F.exp(-z)))


def review_status(confidence, threshold, high: float = HIGH) -> Column:
    c = unit(F.coalesce(col(confidence), F.lit(0.0)))
    return F.when(c < col(threshold), "below_class_threshold").when(c >= high, "high_confidence").otherwise("review_candidate")


def label_quality(margin, source, label) -> Column:
    generic = (F.lower(F.trim(F.coalesce(col(source), F.lit("")))) == "dota_obb") & col(label).isin(*GENERIC)
    return F.when(F.coalesce(col(margin), F.lit(0.0)) >= 0.10, "verified").when(generic, "generic").otherwise("inferred")


def physics_failures(x1, y1, x2, y2, valid_fraction, length_m, low_m, high_m) -> Column:
    """Array of the names of failed checks."""
    w, h = col(x2) - col(x1), col(y2) - col(y1)
    empty = (w <= 0) | (h <= 0)
    aspect = F.greatest(w / F.greatest(h, F.lit(1e-6)), h / F.greatest(w, F.lit(1e-6)))
    checks = (
        ("empty_pixel_bbox", empty),
        ("extreme_aspect_ratio", ~empty & (aspect > 35)),
        ("low_valid_fraction", col(valid_fraction) < 0.20),
        ("too_small_for_class", (col(length_m) > 0) & (col(length_m) < col(low_m))),
        ("too_large_for_class", (col(length_m) > 0) & (col(length_m) > col(high_m))),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks)))


def evidence_score(confidence, source, n_sources, verified, margin, n_failures, truncated, sar_proxy) -> Column:
    source = F.lower(F.trim(F.coalesce(col(source), F.lit(""))))
    score = (
        0.45 * F.coalesce(col(confidence), F.lit(0.0))
        + F.when(source.isin(*SPECIALISTS), 0.25).when(source.isin(*OPEN_VOCABULARY), 0.06).otherwise(0.0)
        + F.when(col(n_sources) >= 2, 0.18).otherwise(0.0)
        + F.when(col(verified), 0.16).otherwise(0.0)
        + F.least(F.lit(0.12), F.greatest(F.lit(0.0), F.coalesce(col(margin), F.lit(0.0))))
        + F.when(col(n_failures) == 0, F.lit(0.10)).otherwise(-F.least(F.lit(0.25), 0.08 * col(n_failures)))
        - F.when(col(truncated), 0.05).otherwise(0.0)
        - F.when(col(sar_proxy), 0.15).otherwise(0.0)
    )
    return unit(score)


def evidence_tier(score, source, n_sources, unknown, verified, n_failures, sar_proxy) -> Column:
    score, sound = col(score), col(n_failures) == 0
    weak = col(unknown) & F.lower(col(source)).isin(*OPEN_VOCABULARY) & (col(n_sources) < 2) & ~col(verified)
    return (
        F.when(col(sar_proxy), F.when((score >= 0.45) & sound, "candidate").otherwise("discovery"))
        .when(weak, "discovery")
        .when((score >= 0.72) & sound, "confirmed")
        .when(score >= 0.42, "candidate")
        .otherwise("discovery")
    )


def label_terms(label) -> Column:
    """What a label is compared by: its words of four letters or more, and the number of the category whose token it holds first (0: none)."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(label)), r"[_\-]", " "), r"\s+", " "))
    kinds = [F.when(reduce(lambda a, b: a | b, (F.contains(words, F.lit(t.replace("_", " "))) for t in tokens)), i) for i, (tokens, _) in enumerate(HINTS, 1)]
    return F.struct(F.filter(F.split(words, " "), lambda w: F.length(w) >= 4).alias("words"), F.coalesce(*kinds, F.lit(0)).alias("kind"))


def target_terms(target_text) -> Column:
    """What a target is compared by: its text in lower case, and the numbers of the categories that it hints at."""
    text = F.lower(F.coalesce(col(target_text), F.lit("")))
    hints = [F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(h)) for h in hints)), i) for i, (_, hints) in enumerate(HINTS, 1)]
    return F.struct(text.alias("text"), F.array_compact(F.array(*hints)).alias("hints"))


def terms_compatibility(label, target) -> Column:
    """Compatibility from ``label_terms`` and ``target_terms``, each worked out once on its own side of a join."""
    label, target = col(label), col(target)
    shared = F.exists(label["words"], lambda w: F.contains(target["text"], w))
    return F.when(F.trim(target["text"]) == "", 0.40).when(shared, 1.00).when(F.array_contains(target["hints"], label["kind"]), 0.70).otherwise(0.20)


def compatibility(label, target_text) -> Column:
    """1 for a shared word of four letters or more, 0.7 for a category hint, 0.2 otherwise; 0.4 without text."""
    return terms_compatibility(label_terms(label), target_terms(target_text))


def link_score(distance_m, max_m: float, compat, confidence, history) -> Column:
    w = LINK_WEIGHTS
    return F.round(
        w["distance"] * F.greatest(F.lit(0.0), 1 - col(distance_m) / max_m) + w["compatibility"] * col(compat) + w["confidence"] * unit(confidence) + w["history"] * unit(history), 3
    )
