"""Ratios, fused confidences and class sets, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a model's words for a risk count.
RISK_SCORE = {"low": 0.3, "medium": 0.6, "high": 0.9}


def ratio(part: Column, whole: Column) -> Column:
    """Null where there is nothing to divide by: not measured, which is not 0."""
    return F.when(whole > 0, part / whole)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def threshold_for(class_name: Column, thresholds: Mapping[str, float], default: float) -> Column:
    if not thresholds:
        return F.lit(float(default))
    table = F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, class_name), F.lit(float(default)))


def fused(conf: Column, risk: Column, is_safety: Column, alpha: float = 0.6, beta: float = 0.4) -> Column:
    """A safety class's confidence raised by the scene's risk score, never lowered, never above 1; other classes and no risk: as it was."""
    raised = F.least(F.lit(1.0), F.greatest(conf, alpha * conf + beta * risk))
    return F.when(is_safety & (F.coalesce(risk, F.lit(0.0)) > 0), raised).otherwise(conf)


def gain(conf: Column, is_priority: Column) -> Column:
    """Aggregate: what it is worth to have detections verified; those of a priority class count twice."""
    return F.coalesce(F.sum(F.when(is_priority, 2.0).otherwise(1.0) * conf), F.lit(0.0))


def mask_row(ids: Column, n_classes: int) -> Column:
    """An array of n_classes zeros and ones, one where the class is in ids."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: F.array_contains(ids, i).cast("int"))


def coverage_score(annotated: Column, residual: Column) -> Column:
    """annotated over annotated and missing; 1 where neither is anything."""
    return F.when(annotated + residual > 0, annotated / (annotated + residual)).otherwise(F.lit(1.0))
