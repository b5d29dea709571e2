"""The automated routes, and the dispatcher that picks one by intent."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.association import REDUNDANT, associations, by_edges, by_evidence, connectivity, supported
from tallyframe.operators.evaluate import binary_metrics, confidence, multiclass_metrics, probability_metrics, regression_metrics, selective
from tallyframe.operators.models import Fitted, binary_models, multiclass_models, regression_models
from tallyframe.operators.profile import field_profile, field_roles
from tallyframe.operators.segment import fit_segments, segment_profile
from tallyframe.plans.policies import BINARY, MULTICLASS, REGRESSION, SEGMENTATION, Boosting, Segmentation
from tallyframe.plans.report import executive_report
from tallyframe.shared import kept


def _result(route: str, df: DataFrame, began: float, target: str | None = None, **more) -> dict:
    base = {"status": "COMPLETE", "route": route, "analysis_type": route, "target": target, "mode": "fast", "dataset": {"rows": df.count(), "columns": len(df.columns)}}
    return base | {"method": {}, "evidence": {}, "findings": [], "warnings": [], "recommendations": []} | more | {"readiness": "FAST_EXECUTION_READY", "runtime_seconds": time.perf_counter() - began}


#: The signs of the measures in a finding's text.
MEASURE = {"numeric_numeric": "ρ", "categorical_numeric": "ε²", "categorical_categorical": "Cramér's V"}


def _sentence(r, numeric: str) -> dict:
    sign = "positive" if (r["signed_effect"] or 0) > 0 else "negative"
    kind = {"numeric_numeric": f"{sign} {numeric}", "categorical_numeric": "numeric difference between groups", "categorical_categorical": "association of categories"}[r["pair_type"]]
    size = r["signed_effect"] if r["pair_type"] == "numeric_numeric" else r["effect"]
    return {"relationship": f"{r['field_1']} ↔ {r['field_2']}", "pair_type": r["pair_type"], "effect": r["effect"], "q_value": r["q_value"], "interpretation": f"{kind} ({MEASURE[r['pair_type']]}={size:.3f})"}


def _without_q(findings: list[dict]) -> list[dict]:
    return [{k: v for k, v in f.items() if k != "q_value"} for f in findings]


def _ranked(pairs: DataFrame, n: int, numeric: str = "association") -> list[dict]:
    """The strongest findings: a top-k report."""
    return [_sentence(r, numeric) for r in pairs.orderBy(F.desc("evidence_score"), F.desc("effect"), "field_1", "field_2").limit(n).collect()]


def _advice(*chosen: tuple[bool, str, str]) -> list[dict]:
    return [{"analysis": analysis, "reason": reason} for holds, analysis, reason in chosen if holds]


def association_route(df: DataFrame) -> tuple[dict, dict]:
    began = time.perf_counter()
    fields = field_roles(df)
    pairs = by_evidence(kept(associations(df, fields), "pairs"))
    good = supported(pairs)
    redundant = pairs.filter("significant_fdr").filter((F.col("pair_type") == "numeric_numeric") & (F.col("effect") >= REDUNDANT))
    evidence = {"tests_run": pairs.count(), "fdr_supported": pairs.filter("significant_fdr").count(), "practical_supported": good.count(), "redundancy_candidates": redundant.count()}
    advice = _advice(
        (evidence["redundancy_candidates"] > 0, "Review of redundant fields", "Some numeric fields say nearly the same, with FDR support."),
        (evidence["practical_supported"] > 0, "Predictive model", "Supported relationships show which predictors and targets are worth modelling."),
    )
    method = {"numeric_numeric": "Spearman", "categorical_categorical": "ChiSquare+CramersV", "categorical_numeric": "KruskalWallis+EpsilonSquared", "multiple_testing": "Benjamini-Hochberg"}
    return _result("association", df, began, method=method, evidence=evidence, findings=_ranked(good, 10), recommendations=advice), {"associations": pairs, "supported": good, "redundancy": redundant, "excluded": fields.excluded}


def exploratory_route(df: DataFrame) -> tuple[dict, dict]:
    began = time.perf_counter()
    fields = field_roles(df)
    pairs = by_evidence(kept(associations(df, fields), "pairs"))
    good, ends = supported(pairs), by_edges(kept(connectivity(pairs), "connectivity"))
    strong = pairs.filter((F.col("pair_type") == "numeric_numeric") & (F.col("effect") >= REDUNDANT)).count()
    top, profile = ends.first(), field_profile(df.drop(*fields.excluded))
    evidence = {
        "usable_fields": len(df.columns) - len(fields.excluded), "association_pairs": pairs.count(), "fdr_supported": pairs.filter("significant_fdr").count(),
        "moderate_plus_pairs": pairs.filter("effect >= 0.30").count(), "very_strong_numeric_pairs": strong, "connected_fields": ends.count(),
    }
    advice = _advice(
        (strong > 0, "Dimension reduction", "Numeric fields share very strong structure."),
        (top is not None and top["edges"] >= 5, "Segmentation", "One field is connected with five others or more."),
        (True, "Association analysis", "Every pair is tested with FDR control."),
    )
    artifacts = {"profile": profile, "associations": pairs, "supported": good, "connectivity": ends, "excluded": fields.excluded}
    method = {"association_screen": "mixed-type fast association scan", "multiple_testing": "Benjamini-Hochberg FDR"}
    findings = _without_q(_ranked(good, 8, "monotonic association"))
    return _result("exploratory", df, began, method=method, evidence=evidence, findings=findings, recommendations=advice), artifacts


def segmentation_route(df: DataFrame, policy: Segmentation = SEGMENTATION) -> tuple[dict, dict]:
    """Segments are made from imputed fields and described by the fields as they are."""
    began = time.perf_counter()
    fit = fit_segments(df, policy)
    profile = kept(segment_profile(fit.rows, fit.features, "segment"), "profile")
    findings: dict[str, dict] = {}
    for r in profile.orderBy("segment", "side", "place").collect():  # six rows a segment
        findings.setdefault(str(r["segment"]), {"high": [], "low": [], "size_pct": r["size_pct"]})[r["side"]].append(r["field"])
    method = {"representation": f"{fit.evidence['pca_dimensions']} principal components", "algorithm": "KMeans", "clusters": policy.clusters, "features": len(fit.features), "selection_source": "fixed policy"}
    artifacts = {"segments": fit.rows, "profile": profile, "features": fit.features, "excluded": fit.excluded, "imputer": fit.medians, "scaler": fit.scaler, "pca": fit.pca, "model": fit.model}
    return _result("segmentation", df, began, method=method, evidence=fit.evidence, findings=findings), artifacts


#: How the frozen models of the supervised routes are described, and how far they are validated.
METHODS = {
    "regression": {"feature_engineering": "R3", "model": "XGBoost", "architecture": "Standard_XGBoost", "selection_source": "validated_deep_analysis"},
    "binary": {"feature_engineering": "validated_binary_FE", "model": "XGBoost", "calibration": "Isotonic", "threshold_policy": "Balanced_F1", "selection_source": "validated_deep_analysis"},
    "multiclass": {"architecture": "Nominal Multiclass", "model": "XGBoost", "calibration": "Uncalibrated", "selection_source": "validated_deep_analysis"},
}
READINESS = {"binary": "FAST_PARITY_VALIDATED"}


def _supervised(kind: str, df: DataFrame, began: float, target: str, policy: Boosting, rows: int, method: dict, evidence: dict, warnings: list[str] | None = None) -> dict:
    """A result of a supervised route; ``policy`` holds the settings that were used, ``dataset.rows`` counts rows with a target."""
    route = "regression" if kind == "regression" else "classification"
    base = _result(route, df, began, target, method=METHODS[kind] | method | {"policy": asdict(policy)}, evidence=evidence, warnings=warnings or [])
    return base | {"analysis_type": kind, "dataset": {"rows": rows, "columns": len(df.columns)}, "readiness": READINESS.get(kind, base["readiness"])}


def _mapped(fitted: Fitted) -> dict:
    return {v: i for i, v in enumerate(fitted.labels)}


def regression_route(df: DataFrame, target: str, policy: Boosting = REGRESSION) -> tuple[dict, dict]:
    began = time.perf_counter()
    oof, fitted = regression_models(df, target, policy)
    oof = kept(oof, "oof")
    m = regression_metrics(oof, "y", "prediction").first().asDict()
    warnings = ["High values are underestimated on average."] if m.pop("tail_warning") else []
    rows = m.pop("n")
    return _supervised("regression", df, began, target, policy, rows, {}, m, warnings), {"oof": oof, "fitted": fitted, "features": fitted.features}


def binary_route(df: DataFrame, target: str, policy: Boosting = BINARY) -> tuple[dict, dict]:
    """``oof`` has the uncalibrated and the calibrated score and the prediction of every labelled row."""
    began = time.perf_counter()
    oof, fitted = binary_models(df, target, policy)
    oof = kept(oof, "oof")
    evidence = binary_metrics(oof, "y", "score", policy.threshold).first().asDict()
    artifacts = {"oof": oof, "fitted": fitted, "features": fitted.features, "labels": fitted.labels, "class_mapping": _mapped(fitted)}
    return _supervised("binary", df, began, target, policy, oof.count(), {"threshold": policy.threshold}, evidence), artifacts


def multiclass_route(df: DataFrame, target: str, policy: Boosting = MULTICLASS) -> tuple[dict, dict]:
    """``oof`` has the chances of all classes, the prediction, its confidence and margin, and whether it is accepted."""
    began = time.perf_counter()
    oof, fitted = multiclass_models(df, target, policy)
    oof = kept(oof.withColumns(confidence("probabilities", policy.confidence, policy.margin)), "oof")
    evidence = multiclass_metrics(oof, "y", "prediction").first().asDict() | probability_metrics(oof, "y", "probabilities", len(fitted.labels)).first().asDict()
    evidence |= selective(oof, "y", "probabilities", policy.confidence, policy.margin).first().asDict()
    mapping = _mapped(fitted)
    artifacts = {"oof": oof, "labels": fitted.labels, "fitted": fitted, "features": fitted.features, "class_mapping": mapping, "inverse_class_mapping": {i: v for v, i in mapping.items()}}
    return _supervised("multiclass", df, began, target, policy, oof.count(), {"confidence_policy": {"confidence_min": policy.confidence, "margin_min": policy.margin}}, evidence), artifacts


#: Names by which a route is asked for.
INTENTS = {
    "customer segmentation": "segmentation", "segmentation": "segmentation", "clustering": "segmentation", "regression": "regression",
    "binary classification": "binary", "multiclass classification": "multiclass", "classification": "classification", "binary": "binary", "multiclass": "multiclass",
    "exploratory data analysis": "exploratory", "exploratory": "exploratory", "eda": "exploratory", "association analysis": "association", "association": "association",
}
UNSUPERVISED: dict[str, Callable[..., tuple[dict, dict]]] = {"segmentation": segmentation_route, "exploratory": exploratory_route, "association": association_route}
SUPERVISED: dict[str, Callable[..., tuple[dict, dict]]] = {"regression": regression_route, "binary": binary_route, "multiclass": multiclass_route}


def execute(df: DataFrame, intent: str, target: str | None = None, mode: str = "fast", policy: Boosting | Segmentation | None = None) -> tuple[dict, dict]:
    """(result, artifacts) of the route that ``intent`` names."""
    if mode.strip().lower() != "fast":
        raise NotImplementedError(f"mode {mode!r} is not available")
    route = INTENTS.get(intent.strip().lower())
    if route is None:
        raise ValueError(f"unknown intent {intent!r}")
    more = (policy,) if policy else ()
    if route in UNSUPERVISED:
        return UNSUPERVISED[route](df, *(more if route == "segmentation" else ()))
    if not target or target not in df.columns:
        raise ValueError("this analysis needs a target that is a column of the table")
    if route == "classification":
        n = df.select(F.count_distinct(F.col(target))).first()[0]
        if n < 2:
            raise ValueError("the target has fewer than two classes")
        route = "binary" if n == 2 else "multiclass"
    return SUPERVISED[route](df, target, *more)


def _plain(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def analyze(df: DataFrame, intent: str, target: str | None = None, mode: str = "fast", policy: Boosting | Segmentation | None = None) -> str:
    """The result and its report as JSON; numbers that aren't finite become null."""
    result, _ = execute(df, intent, target, mode, policy)
    return json.dumps(_plain({"result": result, "report": executive_report(result)}), ensure_ascii=False, default=str)


def health() -> dict:
    return {"status": "ok"}
