"""Fusion of the five signals into one explained verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard import constants as C
from linkguard.functions.sqlutil import add, pin

INPUTS = ["rule_score", "ml_probability", "ip_score", "domain_score", "threat_score"]


def validate_weights(weights: dict[str, float] | None = None) -> dict[str, float]:
    weights = dict(weights or C.RISK_WEIGHTS)
    missing = set(C.SIGNALS) - set(weights)
    if missing:
        raise ValueError(f"Missing weights for: {sorted(missing)}")
    total = sum(weights.values())
    if not 0.99 <= total <= 1.01:
        weights = {k: v / total for k, v in weights.items()}
    return weights


def risk_normalize(signals: DataFrame) -> DataFrame:
    """Clip to 0..100, scale the ML probability, and turn NaN into a missing signal."""
    def clean(c):
        return f"CASE WHEN isnan(try_cast({c} as double)) THEN NULL ELSE try_cast({c} as double) END"

    def clip(c):
        return f"CASE WHEN {clean(c)} IS NULL THEN NULL ELSE greatest(0D, least(100D, {clean(c)})) END"
    ml = clean("ml_probability")
    return add(signals, rule_score=clip("rule_score"),
               ml_score=f"CASE WHEN {ml} IS NULL THEN NULL ELSE "
                        f"greatest(0D, least(1D, {ml})) * 100D END",
               ip_score=clip("ip_score"), domain_score=clip("domain_score"),
               threat_score=clip("threat_score"))


def risk_renormalize(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``w_<signal>``: weights shared among the present signals, 0 for the missing ones."""
    w = validate_weights(weights)
    total = " + ".join(f"CASE WHEN {s} IS NULL THEN 0D ELSE {w[s]!r}D END" for s in C.SIGNALS)
    present = " + ".join(f"int({s} IS NOT NULL)" for s in C.SIGNALS)
    df = add(df, w_total=total, n_present=present)
    return add(df, **{
        f"w_{s}": f"CASE WHEN {s} IS NULL THEN 0D WHEN w_total = 0 THEN 1D / n_present "
                  f"ELSE {w[s]!r}D / w_total END" for s in C.SIGNALS}).drop("w_total")


def risk_score(df: DataFrame) -> DataFrame:
    df = add(df, **{f"c_{s}": f"w_{s} * {s}" for s in C.SIGNALS})
    total = " + ".join(f"coalesce(c_{s}, 0D)" for s in C.SIGNALS)
    missing = ", ".join(f"CASE WHEN {s} IS NULL THEN '{s}' END" for s in C.SIGNALS)
    return add(df, risk_score=f"greatest(0D, least(100D, {total}))",
               missing_signals=f"filter(array({missing}), s -> s IS NOT NULL)")


def risk_verdict(df: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    t = thresholds or C.RISK_THRESHOLDS
    return add(df, verdict=f"CASE WHEN n_present = 0 THEN 'UNKNOWN' "
                           f"WHEN risk_score < {t['benign']} THEN 'BENIGN' "
                           f"WHEN risk_score < {t['suspicious']} THEN 'SUSPICIOUS' "
                           f"WHEN risk_score < {t['high_risk']} THEN 'HIGH_RISK' "
                           "ELSE 'MALICIOUS' END")


def risk_confidence(df: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    t = thresholds or C.RISK_THRESHOLDS
    marks = sorted(t.values()) + [0, 100]
    distance = "least(" + ", ".join(f"abs(risk_score - {m})" for m in marks) + ")"
    return add(df, confidence=f"CASE WHEN n_present = 0 THEN 0D ELSE round(n_present / 5D * 0.5D "
                              f"+ least({distance} / 20D, 1D) * 0.5D, 4) END")


def risk_explain(df: DataFrame) -> DataFrame:
    """Text lines: header, up to five positive contributions by size, missing signals."""
    entries = ", ".join(
        f"named_struct('neg', -c_{s}, 'pos', {i}, 'name', '{s}', 'w', w_{s})"
        for i, s in enumerate(C.SIGNALS))
    df = add(df, top=f"array_sort(filter(array({entries}), e -> e.neg < 0))")
    return add(df, explanation="""
        CASE WHEN n_present = 0 THEN array('No signals available to score') ELSE concat(
          array(concat('Risk score: ', format_string('%.1f', round(risk_score, 1)), '/100 → ',
                       verdict)),
          CASE WHEN size(top) = 0 THEN cast(array() as array<string>) ELSE concat(
            array('Top contributing signals:'),
            transform(top, e -> concat('  • ', e.name, ': ', format_string('%.1f',
              round(-e.neg, 1)), ' pts (weight ', format_string('%.2f', round(e.w, 2)), ')'))) END,
          CASE WHEN size(missing_signals) = 0 THEN cast(array() as array<string>) ELSE
            array(concat('Missing signals: ', array_join(missing_signals, ', '))) END) END""",
               ).drop("top")


def risk_prediction_map(df: DataFrame) -> DataFrame:
    # --- fixed values: verdict to prediction and risk level
    return add(df, prediction="CASE verdict WHEN 'BENIGN' THEN 'benign' WHEN 'SUSPICIOUS' THEN "
                              "'suspicious' WHEN 'UNKNOWN' THEN 'error' ELSE 'malicious' END",
               risk_level="CASE verdict WHEN 'BENIGN' THEN 'SAFE' WHEN 'SUSPICIOUS' THEN 'MEDIUM' "
                          "WHEN 'UNKNOWN' THEN 'UNKNOWN' ELSE 'HIGH' END")


def risk_fuse(signals: DataFrame, weights=None, thresholds=None) -> DataFrame:
    df = pin(risk_normalize(signals), *C.SIGNALS)
    df = pin(risk_renormalize(df, weights), "n_present", *[f"w_{s}" for s in C.SIGNALS])
    df = pin(risk_score(df), "risk_score", *[f"c_{s}" for s in C.SIGNALS])
    df = risk_confidence(risk_verdict(df, thresholds), thresholds)
    return risk_prediction_map(risk_explain(df))


def contributions_map(df: DataFrame) -> DataFrame:
    """Adds the contributions and used weights as maps (absent signals have no contribution)."""
    names = "array(" + ", ".join(f"'{s}'" for s in C.SIGNALS) + ")"
    vals = "array(" + ", ".join(f"c_{s}" for s in C.SIGNALS) + ")"
    wts = "array(" + ", ".join(f"w_{s}" for s in C.SIGNALS) + ")"
    return add(df, contributions=f"map_filter(map_from_arrays({names}, {vals}), "
                                 "(k, v) -> v IS NOT NULL)",
               weights_used=f"map_from_arrays({names}, {wts})")


def domain_score_blend(df: DataFrame) -> DataFrame:
    """The impersonation score joins the domain score: the larger of the two, or the one that is
    present."""
    return add(df, domain_score="CASE WHEN ts_highest_risk > 0 THEN "
                                "greatest(domain_score, cast(ts_highest_risk as double)) "
                                "ELSE domain_score END")
