from seriesloom.functions.columns import (
    blank_nan,
    cyclical,
    epoch_seconds,
    exact_cents,
    first_at_max,
    first_at_min,
    hash_unit,
    pearson,
    python_strip,
    ratio,
    rounded,
)

__all__ = [
    "blank_nan",
    "cyclical",
    "epoch_seconds",
    "exact_cents",
    "first_at_max",
    "first_at_min",
    "hash_unit",
    "pearson",
    "python_strip",
    "ratio",
    "rounded",
]
