"""Frozen settings of the automated routes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Boosting:
    trees: int = 500
    depth: int = 4
    rate: float = 0.03
    subsample: float = 0.85
    columns: float = 0.85
    folds: int = 5
    inner_folds: int = 3
    seed: int = 42
    threshold: float = 0.31
    confidence: float = 0.60
    margin: float = 0.05


@dataclass(frozen=True)
class Segmentation:
    clusters: int = 2
    starts: int = 20
    variance: float = 0.90
    seed: int = 42


REGRESSION = Boosting()
BINARY = Boosting()
MULTICLASS = Boosting(trees=400)
SEGMENTATION = Segmentation()
