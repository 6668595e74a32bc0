"""Statistical models: conditional logit, counterfactuals, box-office curves, differences in differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import released


def softmax(rows: DataFrame, group: str, utility: Column, out: str = "p") -> DataFrame:
    """Choice probabilities in each group, shifted by the group's largest utility."""
    w = Window.partitionBy(group)
    rows = rows.withColumn("_v", utility)
    rows = rows.withColumn("_e", F.exp(F.col("_v") - F.max("_v").over(w)))
    return rows.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_v", "_e")


def linear(names: list[str], beta) -> Column:
    out = F.lit(0.0)
    for n, b in zip(names, beta, strict=True):
        out = out + F.col(n) * float(b)
    return out


class LogitFit:
    def __init__(self, names, beta, covariance, loglik, null_loglik, rounds):
        self.names, self.beta, self.covariance = list(names), np.asarray(beta), np.asarray(covariance)
        self.loglik, self.null_loglik, self.rounds = loglik, null_loglik, rounds

    @property
    def pseudo_r2(self) -> float:
        return 1 - self.loglik / self.null_loglik

    def summary(self) -> pd.DataFrame:
        """Estimate, standard error, z, p, odds ratio and 95 % interval of each variable; NaN where the rows don't tell it."""
        from math import erfc, sqrt

        se = np.sqrt(np.diag(self.covariance))
        known = se > 0
        se, beta = np.where(known, se, np.nan), np.where(known, self.beta, np.nan)
        z = beta / se
        return pd.DataFrame({"name": self.names, "beta": beta, "se": se, "z": z, "p": [erfc(abs(x) / sqrt(2)) for x in z], "odds": np.exp(beta), "low": beta - 1.96 * se, "high": beta + 1.96 * se})


def _moments(rows: DataFrame, names: list[str], group: str, chosen: str, beta: np.ndarray, cluster: str | None = None):
    """Log-likelihood, null one, score, information and the variables' mean squares by one pass; with ``cluster`` the meat of the sandwich too.

    Everything but k*k sums stays in the JVM: the driver gets one row.
    """
    k = range(len(names))
    p = softmax(rows, group, linear(names, beta))
    mean = [F.sum(F.col("p") * F.col(n)) for n in names]
    square = [F.sum(F.col("p") * F.col(names[i]) * F.col(names[j])) for i in k for j in k if i <= j]
    score = [F.sum((F.col(chosen) - F.col("p")) * F.col(n)) for n in names]
    extra = [F.first(cluster).alias("cluster")] if cluster else []
    per = p.groupBy(group).agg(F.sum(F.col(chosen) * F.log("p")).alias("ll"), F.sum(F.col(chosen) * F.log(F.lit(1.0))).alias("_z"), F.count(F.lit(1)).alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[s.alias(f"s{i}") for i, s in enumerate(square)], *[g.alias(f"g{i}") for i, g in enumerate(score)], *extra)
    pairs = [(i, j) for i in k for j in k if i <= j]
    with released(rows.sparkSession):
        total = per.agg(F.sum("ll"), F.sum(-F.log("n")), *[F.sum(f"g{i}") for i in k], *[F.sum(F.col(f"s{at}") - F.col(f"m{i}") * F.col(f"m{j}")) for at, (i, j) in enumerate(pairs)], *[F.sum(f"s{at}") for at, (i, j) in enumerate(pairs) if i == j]).first()
    info = np.zeros((len(names), len(names)))
    for at, (i, j) in enumerate(pairs):
        info[i, j] = info[j, i] = total[2 + len(names) + at]
    meat = None
    if cluster:
        c = per.groupBy("cluster").agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in k])
        with released(rows.sparkSession):
            row = c.agg(*[F.sum(F.col(f"g{i}") * F.col(f"g{j}")) for i, j in pairs]).first()
        meat = np.zeros_like(info)
        for at, (i, j) in enumerate(pairs):
            meat[i, j] = meat[j, i] = row[at]
    return float(total[0]), float(total[1]), np.array(total[2 : 2 + len(names)], float), info, np.array(total[2 + len(names) + len(pairs) :], float), meat


def identified(info: np.ndarray, squares: np.ndarray, least: float = 1e-11) -> np.ndarray:
    """Variables that vary within groups beside those before them: what these leave of a variable's information, against its squares."""
    kept: list[int] = []
    for i in range(len(info)):
        rest = info[i, i] - (info[i, kept] @ np.linalg.solve(info[np.ix_(kept, kept)], info[kept, i]) if kept else 0.0)
        if rest > least * squares[i]:
            kept.append(i)
    return np.array(kept, int)


def fit_logit(rows: DataFrame, names: list[str], group: str, chosen: str, cluster: str | None = None, most_rounds: int = 50, tolerance: float = 1e-9) -> LogitFit:
    """Conditional logit by Newton steps, halved while they don't improve; one pass of the rows a trial. Cache the rows first.

    A variable that is the same for all of a group's rows, or made up of those before it, has no effect to be told: it stays 0, without variance.
    """
    beta = np.zeros(len(names))
    value, null, score, info, squares, _ = _moments(rows, names, group, chosen, beta)
    kept = identified(info, squares)
    rounds = 0
    for rounds in range(1, most_rounds + 1):  # noqa: B007
        step, scale = np.zeros(len(names)), 1.0
        step[kept] = np.linalg.solve(info[np.ix_(kept, kept)], score[kept])
        for _ in range(30):
            trial = _moments(rows, names, group, chosen, beta + scale * step)
            if trial[0] >= value - 1e-12:
                break
            scale /= 2
        gained = trial[0] - value
        beta, (value, _, score, info, _, _) = beta + scale * step, trial
        if abs(gained) < tolerance * max(1.0, abs(value)):
            break
    inverse = np.zeros_like(info)
    inverse[np.ix_(kept, kept)] = np.linalg.inv(info[np.ix_(kept, kept)])
    if cluster:
        meat = _moments(rows, names, group, chosen, beta, cluster)[-1]
        inverse = inverse @ meat @ inverse
    return LogitFit(names, beta, inverse, value, null, rounds)


def gross_fit(runs: DataFrame, capacity: str, gross: str) -> DataFrame:
    """One row: slope, intercept, residual deviation and correlation of log gross on log capacity."""
    x, y = F.log(F.col(capacity)), F.log(F.col(gross))
    rows = runs.where((F.col(capacity) >= 500) & (F.col(gross) > 0)).select(x.alias("x"), y.alias("y"))
    fit = rows.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("y", "x").alias("r"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    left = F.col("syy") - F.col("slope") * F.col("sxy")
    return fit.select("n", "slope", "intercept", F.sqrt(left / (F.col("n") - 2)).alias("sigma"), "r")


def att_gt(panel: DataFrame, unit: str = "unit", time: str = "time", outcome: str = "y", cohort: str = "cohort", control: str = "notyet") -> DataFrame:
    """Effect of each cohort in each year: its change since the year before treatment less that of units not treated by then.

    Cohort 0 is never treated. A pair needs one treated and two control units.
    """
    d = panel.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(outcome).alias("y"), F.coalesce(F.col(cohort), F.lit(0)).alias("c"))
    cohorts = d.where("c > 0").select(F.col("c").alias("g")).distinct()
    keep = "c = g OR c = 0" if control == "never" else "c = g OR c = 0 OR (c > g AND c > t)"
    rows = d.join(F.broadcast(cohorts)).where(f"({keep}) AND t <> g - 1")
    base = d.select("u", F.col("t").alias("bt"), F.col("y").alias("by"))
    change = rows.join(base, (rows["u"] == base["u"]) & (F.col("bt") == F.col("g") - 1)).withColumn("change", F.col("y") - F.col("by"))
    own = F.col("c") == F.col("g")
    out = change.groupBy("g", "t").agg(F.avg(F.when(own, F.col("change"))).alias("a"), F.avg(F.when(~own, F.col("change"))).alias("b"), F.count_if(own).alias("n_treated"), F.count_if(~own).alias("n_control"))
    out = out.where("n_treated >= 1 AND n_control >= 2")
    return out.select(F.col("g").alias("cohort"), F.col("t").alias("time"), (F.col("a") - F.col("b")).alias("att"), "n_treated", "n_control", (F.col("t") - F.col("g")).alias("event_time"))


def event_study(att: DataFrame) -> DataFrame:
    """Effects by years since treatment, weighted by treated units."""
    return att.groupBy("event_time").agg((F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("effect"), F.sum("n_treated").alias("weight"), F.count(F.lit(1)).alias("cells"))


def overall_att(att: DataFrame) -> DataFrame:
    """One row: the weighted effect from treatment on, and the mean size of effects before it."""
    after, before = F.col("event_time") >= 0, F.col("event_time") < -1
    mean = lambda keep, x: F.sum(F.when(keep, x * F.col("n_treated"))) / F.sum(F.when(keep, F.col("n_treated")))
    return att.agg(mean(after, F.col("att")).alias("att"), mean(before, F.abs("att")).alias("pretrend"))


def detrend(study: DataFrame) -> DataFrame:
    """The event study less the weighted line through its leads (three at least, else unchanged)."""
    x, y, w = F.col("event_time"), F.col("effect"), F.when(F.col("event_time") < -1, F.col("weight")).otherwise(0)
    sums = study.agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.sum(w * y).alias("wy"), F.sum(w * x * y).alias("wxy"), F.count_if(x < -1).alias("leads"))
    det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    line = sums.select("leads", F.try_divide(F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy"), det).alias("slope"), F.try_divide(F.col("wxx") * F.col("wy") - F.col("wx") * F.col("wxy"), det).alias("level"))
    trend = F.col("level") + F.col("slope") * F.col("event_time")
    return study.crossJoin(F.broadcast(line)).withColumn("detrended", F.when((F.col("leads") >= 3) & F.col("slope").isNotNull(), F.col("effect") - trend).otherwise(F.col("effect"))).drop("leads", "slope", "level")


def bootstrap(panel: DataFrame, draws: int = 50, unit: str = "unit", time: str = "time", outcome: str = "y", cohort: str = "cohort") -> DataFrame:
    """(draw, att): the overall effect under resampled units, all draws in one plan.

    A resample is a weight a unit and draw, Poisson with mean 1, taken from a hash of both; so no unit is relabelled or collected,
    and means are weighted sums.
    """
    u = (F.shiftrightunsigned(F.xxhash64("u", "draw"), 11) / float(1 << 53)).cast("double")
    weight, total, term = F.lit(0), 0.0, np.exp(-1.0)
    for k in range(12):
        total += term
        weight = weight + (u >= float(total)).cast("int")
        term /= k + 1
    d = panel.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(outcome).alias("y"), F.coalesce(F.col(cohort), F.lit(0)).alias("c"))
    cohorts = d.where("c > 0").select(F.col("c").alias("g")).distinct()
    rows = d.join(F.broadcast(cohorts)).where("(c = g OR c = 0 OR (c > g AND c > t)) AND t <> g - 1")
    base = d.select("u", F.col("t").alias("bt"), F.col("y").alias("by"))
    change = rows.join(base, (rows["u"] == base["u"]) & (F.col("bt") == F.col("g") - 1)).select(rows["u"], "g", "t", "c", (F.col("y") - F.col("by")).alias("change"))
    drawn = change.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight).where("w > 0")
    own = F.col("c") == F.col("g")
    mean = lambda keep: F.sum(F.when(keep, F.col("change") * F.col("w"))) / F.sum(F.when(keep, F.col("w")))
    units = lambda keep: F.sum(F.when(keep, F.col("w")).otherwise(0))
    cells = drawn.groupBy("draw", "g", "t").agg(mean(own).alias("a"), mean(~own).alias("b"), units(own).alias("n_treated"), units(~own).alias("n_control")).where("n_treated >= 1 AND n_control >= 2")
    after = cells.where("t >= g").withColumn("att", F.col("a") - F.col("b"))
    return after.groupBy("draw").agg((F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att"))


def robustness(rooms: DataFrame, visits: DataFrame, thresholds: list[int]) -> DataFrame:
    """The overall effect and its pre-trend for each size from which a room counts as an opening; cities that can't be judged are left out."""
    out = None
    for size in thresholds:
        cohort = openings(rooms, visits, size).where("cohort >= 0").select(F.col("city").alias("unit"), "cohort")
        panel = balanced_panel(visits, "city", "year", "shows").select(F.col("city").alias("unit"), F.col("year").alias("time"), F.col("shows").alias("y")).join(cohort, "unit")
        treated = cohort.where("cohort > 0").agg(F.count(F.lit(1)).alias("treated"), F.countDistinct("cohort").alias("cohorts"))
        row = overall_att(att_gt(panel)).crossJoin(treated).select(F.lit(size).alias("threshold"), "treated", "cohorts", "att", "pretrend")
        out = row if out is None else out.union(row)
    return out


def validate_openings(venues: DataFrame, least_capacity: int) -> DataFrame:
    """One row: how far first sightings of large rooms with a known year lie from it (venues: capacity, opened_year, first_seen)."""
    d = venues.where((F.col("capacity") >= least_capacity) & F.col("opened_year").between(1900, F.year(F.current_date())) & F.col("first_seen").isNotNull())
    gap = F.col("first_seen") - F.col("opened_year")
    share = lambda c: F.avg(c.cast("double"))
    return d.agg(F.count(F.lit(1)).alias("checked"), F.percentile(gap, F.lit(0.5)).alias("median_gap"), share(F.abs(gap) <= 1).alias("within_1yr"), share(F.abs(gap) <= 3).alias("within_3yr"), share(gap > 5).alias("opened_before_panel"))


def openings(rooms: DataFrame, visits: DataFrame, least_capacity: int, buffer: int = 2, active: int = 3) -> DataFrame:
    """Year of each city's first large room as its cohort: 0 without one, -1 if it opened too early or the city saw too little before."""
    first = rooms.where(F.col("capacity") >= least_capacity).groupBy("city").agg(F.min("opened").alias("opened"))
    start = visits.agg(F.min("year").alias("start"))
    before = visits.join(first, "city").where(F.col("year") < F.col("opened")).groupBy("city").agg(F.sum("shows").alias("before"))
    rows = visits.select("city").distinct().join(first, "city", "left").join(before, "city", "left").crossJoin(F.broadcast(start))
    early, quiet = F.col("opened") < F.col("start") + buffer, F.coalesce("before", F.lit(0)) < active
    reason = F.when(F.col("opened").isNull(), "no such room").when(early, "too early").when(quiet, "too little before").otherwise("")
    rows = rows.withColumn("reason", reason)
    return rows.select("city", F.when(F.col("reason") == "no such room", 0).when(F.col("reason") != "", -1).otherwise(F.col("opened")).alias("cohort"), "reason")


def balanced_panel(visits: DataFrame, unit: str, time: str, value: str) -> DataFrame:
    """Every unit in every period, 0 where nothing was seen."""
    grid = visits.select(unit).distinct().crossJoin(F.broadcast(visits.select(time).distinct()))
    sums = visits.groupBy(unit, time).agg(F.sum(value).alias(value))
    return grid.join(sums, [unit, time], "left").fillna(0, [value])


def gross_curve(capacity: Column, points: Column, slope: float, intercept: float, sigma: float) -> list[Column]:
    """Median and quartiles of a show's gross in a room, moved by its sell-through residual in percentage points against 80 %."""
    base = F.exp(F.lit(intercept) + F.lit(slope) * F.log(F.greatest(capacity, F.lit(1)).cast("double")))
    median = base * F.greatest(1 + points / 80.0, F.lit(0.1))
    return [median.alias("median"), (median * float(np.exp(-0.6745 * sigma))).alias("p25"), (median * float(np.exp(0.6745 * sigma))).alias("p75")]


def split_half(rows: DataFrame, unit: str, value: str, order: list[str], least: int = 2) -> DataFrame:
    """One row: correlation between units' means over their odd and even rows, and the number of units with ``least`` rows in each half."""
    nth = F.row_number().over(Window.partitionBy(unit).orderBy(*order)) - 1
    half = rows.withColumn("_h", nth % 2).groupBy(unit).agg(F.avg(F.when(F.col("_h") == 0, F.col(value))).alias("a"), F.avg(F.when(F.col("_h") == 1, F.col(value))).alias("b"), F.count(F.lit(1)).alias("n"))
    return half.where(F.col("n") >= 2 * least).agg(F.count(F.lit(1)).alias("units"), F.corr("a", "b").alias("reliability"))
