"""Threshold classes (K1, K2) and class relabelling (K3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col
from .missing import present
from .text import recode

# The class names used by the reference's maps.
TRAFFIC_LIGHT = ("vert", "orange", "rouge")


def classify(
    c: Column | str,
    cuts: Sequence[float],
    labels: Sequence[str] = TRAFFIC_LIGHT,
    closed: str = "left",
) -> Column:
    """Bin a measure into ``len(cuts) + 1`` labelled classes.

    ``closed="left"``: ``x < cuts[0]`` -> labels[0], ``x < cuts[1]`` -> labels[1],
    ..., ``x >= cuts[-1]`` -> labels[-1] (the lower class is strict).
    ``closed="right"``: the same with ``<=`` / ``>`` (the lower class is inclusive).
    NULL and NaN give NULL (Q17); +Infinity falls into the top class.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("classify needs len(cuts) + 1 labels")
    if closed not in ("left", "right"):
        raise ValueError("closed must be 'left' or 'right'")
    if any(b <= a for a, b in zip(cuts, cuts[1:])):
        raise ValueError("classify needs strictly increasing cuts")
    x = col(c)
    below = (lambda v: x < F.lit(v)) if closed == "left" else (lambda v: x <= F.lit(v))
    out = F.when(~present(x), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels[:-1]):
        out = out.when(below(cut), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def relabel(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Class -> display label; unknown classes give NULL."""
    return recode(c, mapping, keep=False)
