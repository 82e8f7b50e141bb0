"""Non-linear fits of many groups at once, in rounds.

A round is one aggregate: at each group's trial parameters the squared error, and the normal equations of the model's derivatives, are summed over
the group's levels of x. Groups accept or refuse the trial and damp their next step each by itself; those that stand still leave. Samples of one x
are one row from the start, so a round reads as many rows as there are levels, not samples.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.shared import stored

#: The most rounds, the relative gain under which a fit stands still, the first damping, its bounds and factors.
TURNS, STILL, DAMPING, LEAST_DAMPING, MOST_DAMPING, EASE, PRESS = 200, 1e-10, 1e-3, 1e-9, 1e10, 3.0, 4.0
#: Rounds that one plan holds; levels of a group that does its rounds by itself.
AT_ONCE, FEW = 5, 4096
#: The two models of a dose's response, y(x; L, k, x0, L0): a decay L exp(-k (x - x0)) + L0, and a falling sigmoid L / (1 + exp(k (x - x0))) + L0.
DECAY, SIGMOID = "decay", "inverse_sigmoid"
#: The least number of pairs, and how much greater the end of the curve is than its begin where stimulation artifact is likely.
LEAST_PAIRS, RISE = 4, 1.05


def _shape(model: Column, x: Column, p: Column) -> tuple[Column, list[Column]]:
    """The model's values and derivatives by its four parameters."""
    t = x - p[2]
    decay = F.exp(-p[1] * t)
    fall = 1 / (1 + F.exp(p[1] * t))
    share = F.when(model == DECAY, decay).otherwise(fall)
    slope = F.when(model == DECAY, decay).otherwise(fall * (1 - fall))
    return p[0] * share + p[3], [share, -p[0] * t * slope, p[0] * p[1] * slope, F.lit(1.0)]


def _sums(model: str, p: np.ndarray, x: np.ndarray, n: np.ndarray, y: np.ndarray, within: np.ndarray) -> dict:
    """The squared error at parameters p and the normal equations there, of a group at hand."""
    with np.errstate(all="ignore"):
        t = x - p[2]
        share = np.exp(-p[1] * t) if model == DECAY else 1 / (1 + np.exp(p[1] * t))
        slope = share if model == DECAY else share * (1 - share)
        by, rest = np.stack([share, -p[0] * t * slope, p[0] * p[1] * slope, np.ones(len(x))]), y - (p[0] * share + p[3])
        return {"_error_new": float((n * rest**2 + within).sum()), "_jtj_new": ((n * by) @ by.T).ravel(), "_grad_new": by @ (n * rest)}


def _step(r: dict) -> None:
    """Accept or refuse a trial by its sums, and take the next one."""
    new, error = r["_error_new"], r["error"]
    taken = {"p": r["trial"], "error": new, "_jtj": r["_jtj_new"], "_grad": r["_grad_new"]}
    if pd.isna(error):
        r |= taken
        r["done"] = not np.isfinite(new)
    elif new < error:
        r |= taken | {"lam": max(LEAST_DAMPING, r["lam"] / EASE), "turns": r["turns"] + 1}
        r["done"] = r["converged"] = bool((error - new) / (error or 1) < STILL)
    else:
        r |= {"lam": r["lam"] * PRESS, "turns": r["turns"] + 1}
        r["done"] = r["lam"] > MOST_DAMPING
    r["done"] = bool(r["done"] or r["turns"] >= TURNS)
    if not r["done"]:
        a = np.array(r["_jtj"], float).reshape(4, 4)
        try:
            r["trial"] = np.array(r["p"], float) + np.linalg.solve(a + r["lam"] * np.diag(np.diag(a)), np.array(r["_grad"], float))
        except np.linalg.LinAlgError:
            r["done"] = True


def _advance(batches):
    for b in batches:
        rows = b.to_dict("records")
        for r in rows:
            if not r["done"]:
                _step(r)
        yield pd.DataFrame(rows, columns=b.columns).drop(columns=["_error_new", "_jtj_new", "_grad_new"])


def _alone(b: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """All rounds of one group of few levels."""
    out = []
    for model, own in b.groupby("model"):
        r = {"trial": np.array(own["trial"].iloc[0], float), "error": None, "lam": DAMPING, "turns": 0, "done": False, "converged": False, "p": None}
        columns = [own[c].to_numpy(float) for c in ("x", "n", "y", "within")]
        while not r["done"]:
            r |= _sums(model, np.array(r["trial"], float), *columns)
            _step(r)
        out.append([*[own[k].iloc[0] for k in keys], model, r["p"], r["error"], r["turns"], r["converged"]])
    return pd.DataFrame(out, columns=[*keys, "model", "p", "error", "turns", "converged"])


def fit_curves(levels: DataFrame, start: DataFrame, keys: list[str], few: int = FEW) -> DataFrame:
    """(keys, model, p, error, turns, converged) of the models of `start` (keys, model, trial array of four) over levels (keys, x, n, y, within): the mean
    y of n samples at x, and their squares' sum around it. Damped least squares: a step that lessens the error is kept and eases the damping, another
    presses it; a fit ends converged when a step gains next to nothing, else when the damping or the rounds run out or its equations are singular.

    Groups of up to `few` levels do their rounds in one task, as a device's steps of current are few; all others go round by round, all at once.
    """
    levels = stored(levels, "levels")
    kinds = ", ".join(f"{k} {t}" for k, t in levels.select(*keys).dtypes)
    size = stored(levels.groupBy(*keys).agg((F.count("*") <= few).alias("few")), "sizes")
    small = levels.join(size.where("few").select(*keys), keys).join(start.select(*keys, "model", "trial"), keys)
    out = small.groupBy(*keys).applyInPandas(lambda b: _alone(b, keys), f"{kinds}, model string, p array<double>, error double, turns int, converged boolean")
    large = size.where("not few").select(*keys)
    return out if large.isEmpty() else out.unionByName(_by_rounds(levels.join(large, keys), start.join(large, keys), keys))


def _by_rounds(levels: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    levels = stored(levels, "levels")
    state = "trial array<double>, p array<double>, error double, _jtj array<double>, _grad array<double>, lam double, turns int, done boolean, converged boolean"
    kinds = ", ".join(f"{k} {t}" for k, t in levels.select(*keys).dtypes) + f", model string, {state}"
    names = [c.split()[0] for c in state.split(", ")]
    none = F.lit(None).cast("array<double>")
    now = start.select(*keys, "model", "trial", none.alias("p"), F.lit(None).cast("double").alias("error"), none.alias("_jtj"), none.alias("_grad"), F.lit(DAMPING).alias("lam"), F.lit(0).alias("turns"), F.lit(False).alias("done"), F.lit(False).alias("converged"))
    now, out = stored(now, "fits"), None
    value, by = _shape(F.col("model"), F.col("x"), F.col("trial"))
    rest = F.col("y") - value
    sums = [
        F.sum(F.col("n") * rest * rest + F.col("within")).alias("_error_new"),
        F.array(*[F.sum(F.col("n") * a * b) for a in by for b in by]).alias("_jtj_new"), F.array(*[F.sum(F.col("n") * a * rest) for a in by]).alias("_grad_new"),
    ]
    for _ in range(0, TURNS + 1, AT_ONCE):
        for _ in range(AT_ONCE):
            kept = F.first(F.struct(*names)).alias("s")  # the same in all rows of a group
            met = levels.join(now, keys).groupBy(*keys, "model").agg(kept, *sums)
            now = met.select(*keys, "model", "s.*", "_error_new", "_jtj_new", "_grad_new").mapInPandas(_advance, kinds)
        now = stored(now, "fits")
        ended = now.where("done")
        out = ended if out is None else out.unionByName(ended)
        now = now.where("not done")
        if now.isEmpty():
            break
    return out.select(*keys, "model", "p", "error", "turns", "converged")


def fit_dose_response(pairs: DataFrame, keys: list[str], x: str = "ma", y: str = "power", few: int = FEW) -> DataFrame:
    """(keys, n, best, l, k, x0, l0, r2, mse, mse_decay, mse_sigmoid, half_suppression, max_suppression_pct, artifact_suspected, converged, reason)
    of the better of two models of power over amplitude for each group of pairs; missing values are left out.

    Suppression is the fall from the curve's begin to its end in percent, half of it is reached at the first of 200 even steps past the middle value. A curve that
    ends over 5 % above its begin is likely stimulation artifact. Groups of under four pairs or without a finite fit have a reason instead.
    """
    v = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("v"))
    v = stored(v, "pairs")
    within = F.var_pop("v") * F.count("*")
    levels = stored(v.groupBy(*keys, "x").agg(F.count("*").alias("n"), F.avg("v").alias("y"), within.alias("within"), F.min("v").alias("v0"), F.max("v").alias("v1")), "levels")
    head = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.expr("percentile(x, 0.5)").alias("xm"), F.min("v").alias("v0"), F.max("v").alias("v1"), (F.var_pop("v") * F.count("*")).alias("total"))
    head = stored(head, "head")
    rise, width = F.greatest(F.lit(1e-6), F.col("v1") - F.col("v0")), F.greatest(F.lit(0.1), F.when(F.col("x1") == F.col("x0"), 1.0).otherwise(F.col("x1") - F.col("x0")))
    guess = F.array(F.struct(F.lit(DECAY).alias("model"), F.array(rise, 1 / width, F.col("x0"), F.col("v0")).alias("trial")), F.struct(F.lit(SIGMOID).alias("model"), F.array(rise, 2 / width, F.col("xm"), F.col("v0")).alias("trial")))
    fits = fit_curves(levels.select(*keys, "x", "n", "y", "within"), head.where(F.col("n") >= LEAST_PAIRS).select(*keys, F.inline(guess)), keys, few)
    fits = fits.where(F.col("error").isNotNull() & ~F.isnan("error") & (F.col("error") < float("inf")))
    place = F.struct("error", (F.col("model") != DECAY).alias("second"), "model", "p", "converged")
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("error")))
    best = fits.groupBy(*keys).agg(F.min(place).alias("b"), of(DECAY).alias("e_decay"), of(SIGMOID).alias("e_sigmoid"))
    out = head.join(best, keys, "left")
    at = lambda c: _shape(F.col("b.model"), c, F.col("b.p"))[0]
    out = out.withColumns({"begin": at(F.col("x0")), "end": at(F.col("x1"))})
    middle, falls = (F.col("begin") + F.col("end")) / 2, F.col("begin") > F.col("end")
    step = lambda s: F.col("x0") + (F.col("x1") - F.col("x0")) * s / 200
    past = lambda s: F.when(falls, at(step(s)) <= middle).when(F.col("begin") < F.col("end"), at(step(s)) >= middle).otherwise(False)
    out = out.withColumn("half", F.get(F.filter(F.sequence(F.lit(0), F.lit(200)), past), 0))
    reason = F.when(F.col("n") < LEAST_PAIRS, "few_pairs").when(F.col("b").isNull(), "no_fit")
    return out.select(
        *keys, "n", F.col("b.model").alias("best"), *[F.get("b.p", i).alias(c) for i, c in enumerate(("l", "k", "x0", "l0"))], F.when(F.col("total") > 0, 1 - F.col("b.error") / F.col("total")).alias("r2"),
        (F.col("b.error") / F.col("n")).alias("mse"), (F.col("e_decay") / F.col("n")).alias("mse_decay"), (F.col("e_sigmoid") / F.col("n")).alias("mse_sigmoid"), step(F.col("half")).alias("half_suppression"),
        (100 * (F.col("begin") - F.col("end")) / F.when(F.col("begin") == 0, 1.0).otherwise(F.col("begin"))).alias("max_suppression_pct"), (F.col("end") > RISE * F.col("begin")).alias("artifact_suspected"),
        F.col("b.converged").alias("converged"), reason.alias("reason"),
    )
