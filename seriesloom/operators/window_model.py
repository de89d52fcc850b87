"""Linear forecasts of many steps from a long window of past rows, one ridge regression per series.

The window of a row is the ``length`` rows up to it, the targets are the ``horizon`` rows after it. No window
is ever built for the fit: a product of two window places, summed over all windows, is the lagged sum
of the whole series less what lies beyond the first and last window. So the normal equations of a
series come from its lagged sums (a few numbers per lag, added up from chunks) and from its first and
last ``length + horizon`` rows. They are solved per series by a Cholesky factor for all steps at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.chunks import HOUR
from seriesloom.operators.lagged import centred, chunk_size, lagged_sums, no_rows, number_rows, over_chunks
from seriesloom.session import cut_lineage

# Rows the encoder reads, steps it forecasts, ridge weight.
LENGTH = 336
HORIZON = 24
RIDGE = 0.001


def fit_windows(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    length: int = LENGTH,
    horizon: int = HORIZON,
    ridge: float = RIDGE,
    ts: str = "ts",
    step: timedelta = HOUR,
    chunk_steps: int | None = None,
) -> DataFrame:
    """(keys, n, intercepts, weights): the model of each series.

    ``intercepts[h]`` is that of step h + 1; ``weights[h]`` holds, feature after feature, the weights of the
    rows 0, 1, ... before the last known one. Minimised is the mean squared error of a step plus ``ridge`` times
    the squared weights. Rows with a NULL in a used column are left out; windows count rows. A series with
    fewer than two windows gets no model. What is solved per series is a matrix of features * length.
    Runs a job when called: the numbered rows are written to the shared folder.
    """
    columns = list(dict.fromkeys([*features, target]))
    rows = centred(number_rows(df.dropna(subset=columns), keys, columns, ts, step, chunk_steps), keys, columns, ts)
    rows = cut_lineage(rows.select(*keys, ts, "position", "n_rows", *columns, *[f"_mean_{c}" for c in columns]))
    reach = length + horizon
    sums = lagged_sums(rows, keys, columns, reach - 1, None, chunk_steps).select(*keys, "a", "b", "lag", "sum_a", "sum_ab")
    edge = (F.col("position") < reach) | (F.col("position") >= F.col("n_rows") - reach)
    edges = rows.where(edge).drop(ts)
    places = [columns.index(f) for f in features]
    at = columns.index(target)
    schema = T.StructType(
        [
            *[rows.schema[k] for k in keys],
            *T.StructType.fromDDL("n long, intercepts array<double>, weights array<array<double>>").fields,
        ]
    )

    def solve(key: tuple, sums: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if sums.empty or edges.empty:
            return no_rows(schema)
        edges = edges.drop_duplicates("position").sort_values("position")
        n = int(edges["n_rows"].iloc[0])
        windows = n - reach + 1
        if windows < 2:
            return no_rows(schema)
        products, totals = np.zeros((len(columns), len(columns), reach)), np.zeros(len(columns))
        products[sums["a"], sums["b"], sums["lag"]] = sums["sum_ab"]
        own = sums[(sums["a"] == sums["b"]) & (sums["lag"] == 0)]
        totals[own["a"]] = own["sum_a"]
        values = edges[columns].to_numpy(float)
        fitted = solve_windows(products, totals, values[:reach], values[-reach:], n, places, at, length, horizon, ridge)
        if fitted is None:
            return no_rows(schema)
        bias, weights = fitted
        mean = edges[[f"_mean_{x}" for x in columns]].iloc[0].to_numpy(float)
        bias = bias + mean[at] - weights @ np.repeat(mean[places], length)
        row = dict(zip(keys, key, strict=False))
        row |= {"n": windows, "intercepts": bias.tolist(), "weights": weights.tolist()}
        return pd.DataFrame([row])[schema.fieldNames()]

    # Rows of series without keys meet under a constant.
    both = [F.lit(1).alias("_one")]
    left, right = sums.select("*", *both), edges.select("*", *both)
    names = [*keys, "_one"]
    return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(solve, schema)


def window_moments(
    sums: np.ndarray, head: np.ndarray, tail: np.ndarray, n: int, i: int, j: int, shift_i: np.ndarray, shift_j: np.ndarray, low: int, high: int
) -> np.ndarray:
    """Sums over the rows t in [low, high) of x_i[t - shift_i] * x_j[t - shift_j], for all pairs of shifts.

    ``sums[i, j, k]`` is the sum over the whole series of x_i[s] * x_j[s - k]. Shifts may be negative (rows
    ahead). Seen from the later of the two rows a pair is a lagged product; the products before the first and
    after the last window are taken off. They lie in ``head`` (the series' first rows) and ``tail`` (its last).
    """
    lag = (shift_j[None, :] - shift_i[:, None]).ravel()
    order = np.argsort(lag, kind="stable")
    lags, begins = np.unique(lag[order], return_index=True)
    out = np.empty(len(lag))
    for k, cells in zip(lags, np.split(order, begins[1:]), strict=True):
        later, earlier = (i, j) if k >= 0 else (j, i)
        gap = abs(int(k))
        row, col = np.divmod(cells, len(shift_j))
        shift = np.minimum(shift_i[row], shift_j[col])  # of the later row, which runs over [low - shift, high - shift)
        early = head[gap:, later] * head[: len(head) - gap, earlier]
        late = tail[gap:, later] * tail[: len(tail) - gap, earlier]
        before = np.concatenate([[0.0], np.cumsum(early)])
        after = np.concatenate([np.cumsum(late[::-1])[::-1], [0.0]])
        out[cells] = sums[later, earlier, gap] - before[low - shift - gap] - after[high - shift - (n - len(tail) + gap)]
    return out.reshape(len(shift_i), len(shift_j))


def window_totals(total: float, head: np.ndarray, tail: np.ndarray, n: int, shift: np.ndarray, low: int, high: int) -> np.ndarray:
    """Sums over the rows t in [low, high) of x[t - shift], from the total of x and its first and last rows."""
    before = np.concatenate([[0.0], np.cumsum(head)])
    after = np.concatenate([np.cumsum(tail[::-1])[::-1], [0.0]])
    return total - before[low - shift] - after[high - shift - (n - len(tail))]


def solve_windows(
    sums: np.ndarray,
    totals: np.ndarray,
    head: np.ndarray,
    tail: np.ndarray,
    n: int,
    places: Sequence[int],
    at: int,
    length: int,
    horizon: int,
    ridge: float,
) -> tuple[np.ndarray, np.ndarray] | None:
    """Intercepts and weights (a row per step) from lagged sums and the ends of the series; None if singular."""
    low, high = length - 1, n - horizon
    windows = high - low
    past, ahead = np.arange(length), -np.arange(1, horizon + 1)
    span = (low, high)
    gram = np.block([[window_moments(sums, head, tail, n, i, j, past, past, *span) for j in places] for i in places])
    moment = np.concatenate([window_moments(sums, head, tail, n, i, at, past, ahead, *span) for i in places])
    x = np.concatenate([window_totals(totals[i], head[:, i], tail[:, i], n, past, *span) for i in places]) / windows
    y = window_totals(totals[at], head[:, at], tail[:, at], n, ahead, *span) / windows
    gram = gram / windows - np.outer(x, x)
    gram = (gram + gram.T) / 2 + ridge * np.eye(len(gram))
    try:
        factor = np.linalg.cholesky(gram)
    except np.linalg.LinAlgError:
        return None
    weights = np.linalg.solve(factor.T, np.linalg.solve(factor, moment / windows - np.outer(x, y))).T
    return y - weights @ x, weights


def forecast_windows(
    df: DataFrame,
    model: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    length: int = LENGTH,
    ts: str = "ts",
    step: timedelta = HOUR,
    chunk_steps: int | None = None,
) -> DataFrame:
    """(keys, ts, forecast): the steps after every row that has a whole window up to it; ``ts`` is the last time known.

    Rows with a NULL feature are left out before windows are counted. Series without a model get no rows.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")  # whole numbers below 2**53
    numbered = number_rows(df.dropna(subset=list(features)), keys, list(features), ts, step, chunk_steps)
    rows = numbered.select(*keys, "position", us, *features)

    def run(values: np.ndarray, first: int, home: int, model: pd.Series) -> dict[str, np.ndarray]:
        begin = max(home, length - 1)
        if begin >= len(values):
            return {"_us": np.zeros(0, np.int64), "forecast": []}
        out = np.asarray(model["intercepts"], float)[None, :]
        weights = np.stack(model["weights"]).reshape(-1, len(features), length)[:, :, ::-1]
        for k in range(len(features)):
            view = np.lib.stride_tricks.sliding_window_view(values[:, k + 1], length)[begin - length + 1 :]
            out = out + view @ weights[:, k].T
        return {"_us": values[begin:, 0].astype(np.int64), "forecast": list(out)}

    size = chunk_size(length, chunk_steps)
    made = over_chunks(rows, keys, ["_us", *features], run, "_us long, forecast array<double>", length - 1, size, model.select(*keys, "intercepts", "weights"))
    time = F.timestamp_micros("_us").cast(df.schema[ts].dataType)
    return made.select(*keys, time.alias(ts), "forecast")
