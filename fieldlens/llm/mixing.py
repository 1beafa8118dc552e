"""Mixing sources to target weights (7): iterative proportional fitting of source, language and topic marginals.

Documents are counted in cells (source, language, topic) by tokens. The expected kept tokens are raked with each
probability held at 1 or less, until every marginal of the sample has its target share and the expected tokens are the
wanted share of all tokens. The draw is a hash of doc_id, so a rerun keeps the same documents.

A sample can't hold more tokens of a value than there are: where a target asks for more at the wanted share, the value
keeps all it has and the others divide the rest by their targets. ``mixture`` gives the target and the reached (expected)
share of each row's source, language and topic, so such values show; a smaller ``share`` brings them nearer. ``weight`` is
the weight that would meet all targets without the bound.

Every value keeps its own cells and target, however many there are. Up to ``MAX_CELLS`` cells are raked on the driver;
above that the cells stay a table and each step of the raking is a groupBy and a join, to ``FRAME_TOLERANCE``.

Without given targets, a dimension's shares are its observed token shares to the power ``TEMPERING``, normalised.

Defined results: a null or empty text has 0 tokens and its cell's probability; a null source or language is the value
``(none)``; targets of values that don't occur are left out and the rest scaled; a value that the given targets of its
dimension don't name has the target 0; no documents give no rows; rows that
repeat a doc_id share its fate; rows without doc_id are drawn by a hash of their text; extra columns are kept by
``sample_mixture`` and not read otherwise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import maybe_broadcast, read_table, stage, unstage

DIMENSIONS = ("source", "lang", "topic")
#: Cells that the driver holds (some numbers and three short texts each: under 100 MB).
MAX_CELLS = 100_000
TEMPERING = {"source": 0.5, "lang": 0.7, "topic": 0.9}
KEEP_SHARE = 0.9
ROUNDS = 200
TOLERANCE = 1e-9
FRAME_TOLERANCE = 1e-4
SEED = 20_240_601
REPORTED = [f"{d}_{kind}" for d in DIMENSIONS for kind in ("target", "reached")]


def topic_of(text: Column) -> Column:
    """A topic by the form of the text (documents carry none): table, numbers, list, note or prose."""
    n = F.greatest(F.length(text), F.lit(1))
    return (F.when(F.length(text) < 200, "note")
            .when(F.regexp_count(text, F.lit(r"\|")) / n > 0.01, "table")
            .when(F.regexp_count(text, F.lit("[0-9]")) / n > 0.1, "numbers")
            .when(F.regexp_count(text, F.lit("\n")) / n > 1 / 80, "list").otherwise("prose"))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              lang_col: str = "lang") -> tuple[list[Column], Column]:
    """Columns source, lang, topic and tokens of each document, and its draw in [0, 1)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    tokens = F.regexp_count(text, F.lit(r"\S+")).cast("long")
    none = F.lit("(none)")
    key = F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("t:"), text))
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(SEED)), 11) / F.lit(float(1 << 53))
    return [F.coalesce(docs[source_col].cast("string"), none).alias("source"),
            F.coalesce(docs[lang_col].cast("string"), none).alias("lang"), topic_of(text).alias("topic"),
            tokens.alias("tokens")], draw


def rake(cells: dict[tuple, float], targets: dict[str, dict[str, float]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Weight of each cell: the factors that give every marginal of ``cells`` its target share."""
    keys = sorted(cells)
    mass = np.array([float(cells[k]) for k in keys])
    total = mass.sum()
    if total <= 0:
        return {k: 1.0 for k in keys}
    weight = np.ones(len(keys))
    margins = []
    for d, name in enumerate(DIMENSIONS):
        values = sorted({k[d] for k in keys})
        code = np.array([values.index(k[d]) for k in keys])
        there = np.bincount(code, weights=mass, minlength=len(values)) > 0
        goal = np.array([max(0.0, targets[name].get(v, 0.0)) for v in values]) * there
        margins.append((code, total * goal / goal.sum() if goal.sum() else np.bincount(code, weights=mass)))
    for _ in range(rounds):
        moved = 0.0
        for code, goal in margins:
            have = np.bincount(code, weights=mass * weight, minlength=len(goal))
            factor = np.divide(goal, have, out=np.ones_like(goal), where=have > 0)
            moved = max(moved, float(np.abs(factor - 1).max()))
            weight *= factor[code]
        if moved < TOLERANCE:
            break
    return dict(zip(keys, weight.tolist()))


def calibrate(cells: dict[tuple, float], weight: dict[tuple, float], share: float) -> dict[tuple, float]:
    """Probability of each cell: min(1, c * weight) with the expected tokens at ``share`` of all."""
    keys = sorted(cells)
    mass, w = np.array([float(cells[k]) for k in keys]), np.array([weight[k] for k in keys])
    wanted = min(share * mass.sum(), mass[w > 0].sum())
    lo, hi = 0.0, 1.0
    while (np.minimum(1, hi * w) * mass).sum() < wanted - 1e-9 and hi < 1e12:
        hi *= 2
    for _ in range(100):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if (np.minimum(1, c * w) * mass).sum() < wanted else (lo, c)
    return dict(zip(keys, np.minimum(1, hi * w).tolist()))


def capped(have: np.ndarray, target: np.ndarray, kept: float) -> np.ndarray:
    """Tokens to keep of each value: its target of ``kept``, at most all it has; the others divide the rest."""
    full = np.zeros(len(have), bool)
    while True:
        free = (target > 0) & ~full
        goal = np.where(full, have, 0.0)
        if free.any():
            goal[free] = max(0.0, kept - goal.sum()) * target[free] / target[free].sum()
        over = free & (goal > have)
        if not over.any():
            return goal
        full |= over


def _bounded_factor(code: np.ndarray, goal: np.ndarray, mass: np.ndarray, w: np.ndarray, least: float) -> np.ndarray:
    """Factor f of each value with sum(mass * min(1, f * w)) = goal: Newton's steps from below (the sum is concave)."""
    raw = np.bincount(code, weights=mass * w, minlength=len(goal))
    f = np.divide(goal, raw, out=np.ones_like(goal), where=raw > 0)
    for _ in range(100):
        x = f[code] * w
        gap = goal - np.bincount(code, weights=mass * np.minimum(1, x), minlength=len(goal))
        slope = np.bincount(code, weights=np.where(x < 1, mass * w, 0), minlength=len(goal))
        step = np.divide(gap, slope, out=np.zeros_like(goal), where=(gap > least) & (slope > 0))
        if not step.any():
            break
        f += step
    return f


def rake_bounded(cells: dict[tuple, float], targets: dict[str, dict[str, float]], share: float,
                 rounds: int = ROUNDS) -> dict[tuple, float]:
    """Probability of each cell: the expected kept tokens meet the (capped) targets at ``share`` of all tokens."""
    keys = sorted(cells)
    mass = np.array([float(cells[k]) for k in keys])
    total = mass.sum()
    if total <= 0:
        return {k: share for k in keys}
    margins = []
    for d, name in enumerate(DIMENSIONS):
        values = {v: i for i, v in enumerate(sorted({k[d] for k in keys}))}
        code = np.array([values[k[d]] for k in keys])
        have = np.bincount(code, weights=mass)
        goal = np.array([max(0.0, targets[name].get(v, 0.0)) for v in values]) * (have > 0)
        margins.append((code, have, goal if goal.sum() else have))
    kept = min([share * total] + [have[goal > 0].sum() for _, have, goal in margins])
    margins = [(code, capped(have, goal, kept)) for code, have, goal in margins]
    w = np.full(len(keys), kept / total)
    for _ in range(rounds):
        gap = 0.0
        for code, goal in margins:
            now = np.bincount(code, weights=mass * np.minimum(1, w), minlength=len(goal))
            gap = max(gap, float(np.abs(now - goal).max()))
            w = w * _bounded_factor(code, goal, mass, w, TOLERANCE * TOLERANCE * total)[code]
            w = np.where(w > 0, np.clip(w, 1e-200, 1e200), 0)
        if gap < TOLERANCE * total:
            break
    return calibrate(cells, dict(zip(keys, w.tolist())), kept / total)


def shares(cells: dict[tuple, float], chance: dict[tuple, float]) -> list[dict[str, float]]:
    """The share of each value in the expected kept tokens, a dict per dimension."""
    kept = {k: cells[k] * chance[k] for k in sorted(cells)}
    total = sum(kept.values())
    out: list[dict[str, float]] = [{} for _ in DIMENSIONS]
    for k, t in kept.items():
        for d, v in enumerate(k):
            out[d][v] = out[d].get(v, 0.0) + (t / total if total else 0.0)
    return out


def _goals(margin: DataFrame, name: str, targets) -> DataFrame:
    """(value, have, target): the tokens of each value and its target share, from its tokens (value, have)."""
    if targets and name in targets:
        given = margin.sparkSession.createDataFrame([(v, max(0.0, float(t))) for v, t in targets[name].items()],
                                                    f"{name} string, target double")
        aim = margin.join(given, name, "left")
    else:
        aim = margin.withColumn("target", F.pow("have", F.lit(TEMPERING[name])))
    aim = stage(aim.select(name, "have", F.when(F.col("have") > 0, F.coalesce("target", F.lit(0.0))).otherwise(0.0)
                           .alias("target")), "goals")
    whole = aim.agg(F.sum("target")).first()[0]
    return aim.withColumn("target", F.col("target") / whole if whole
                          else F.col("have") / aim.agg(F.sum("have")).first()[0])


def _frame_rake(cells: DataFrame, goals: dict[str, DataFrame], start: float, bounded: bool) -> DataFrame:
    """``cells`` with the factor w of each: rake and rake_bounded as groupBy and join rounds, one Newton step a round."""
    total = cells.agg(F.sum("tokens")).first()[0]
    cells = stage(cells.withColumn("w", F.lit(start)), "raked")
    for _ in range(ROUNDS):
        gap = 0.0
        for name in DIMENSIONS:
            sums = cells.groupBy(name).agg(
                F.sum(F.col("tokens") * F.col("w")).alias("raw"),
                F.sum(F.col("tokens") * F.least("w", F.lit(1.0))).alias("now"),
                F.sum(F.when(F.col("w") < 1, F.col("tokens") * F.col("w")).otherwise(0.0)).alias("slope"))
            plain = F.when(F.col("raw") > 0, F.col("goal") / F.col("raw")).otherwise(1.0)
            newton = F.when(F.col("slope") > 0, 1 + (F.col("goal") - F.col("now")) / F.col("slope"))
            factor = stage(sums.join(goals[name].select(name, "goal"), name).select(
                name, (F.greatest(plain, newton) if bounded else plain).alias("factor"),
                F.abs(F.col("goal") - F.col("now" if bounded else "raw")).alias("gap")), "factors")
            off, values = factor.agg(F.max("gap"), F.count("*")).first()
            gap = max(gap, off or 0.0)
            nxt = stage(cells.join(maybe_broadcast(factor.drop("gap"), values), name).withColumn(
                "w", F.when(F.col("w") * F.col("factor") > 0,
                            F.least(F.greatest(F.col("w") * F.col("factor"), F.lit(1e-200)), F.lit(1e200))).otherwise(0.0))
                .select(*DIMENSIONS, "tokens", "w"), "raked")
            unstage(cells, factor)
            cells = nxt
        if gap < FRAME_TOLERANCE * total:
            break
    return cells


def _frame_plan(cells: DataFrame, targets, share: float) -> DataFrame:
    """The plan of any number of cells; the driver holds sums over a dimension only."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if total <= 0:
        return cells.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.lit(1.0).alias("weight"),
                            F.lit(share).alias("probability"), *[F.lit(0.0).alias(c) for c in REPORTED])
    goals = {d: _goals(cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("have")), d, targets)
             for d in DIMENSIONS}
    kept = min([share * total] + [g.where("target > 0").agg(F.sum("have")).first()[0] for g in goals.values()])
    bounded = {}
    for d, g in goals.items():
        level = kept  # tokens a unit of target; those that have less keep all, the others divide the rest
        while True:
            full = F.col("have") <= level * F.col("target")
            filled, free = g.where("target > 0").agg(F.sum(F.when(full, F.col("have")).otherwise(0.0)),
                                                     F.sum(F.when(full, 0.0).otherwise(F.col("target")))).first()
            if not free or (kept - filled) / free <= level * (1 + 1e-12):
                break
            level = (kept - filled) / free
        goal = F.least("have", level * F.col("target")) if free else F.col("have")
        bounded[d] = stage(g.withColumn("goal", F.when(F.col("target") > 0, goal).otherwise(0.0)), "bounded")
    free_weight = _frame_rake(cells, {d: g.withColumn("goal", F.col("target") * total) for d, g in goals.items()}, 1.0, False)
    raked = _frame_rake(cells, bounded, kept / total, True)
    c = kept / (raked.agg(F.sum(F.col("tokens") * F.col("w"))).first()[0] or 1.0)
    for _ in range(100):
        x = c * F.col("w")
        now, slope = raked.agg(F.sum(F.col("tokens") * F.least(x, F.lit(1.0))),
                               F.sum(F.when(x < 1, F.col("tokens") * F.col("w")).otherwise(0.0))).first()
        if not slope or kept - now <= TOLERANCE * total:
            break
        c += (kept - now) / slope
    plan = stage(raked.withColumn("probability", F.least(c * F.col("w"), F.lit(1.0))).drop("w").join(
        free_weight.select(*DIMENSIONS, F.col("w").alias("weight")), list(DIMENSIONS)), "plan")
    in_all = plan.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] or 1.0
    out = plan
    for d in DIMENSIONS:
        reached = plan.groupBy(d).agg((F.sum(F.col("tokens") * F.col("probability")) / in_all).alias(f"{d}_reached"))
        out = out.join(reached.join(bounded[d].select(d, F.col("target").alias(f"{d}_target")), d), d)
    return stage(out.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "weight", "probability", *REPORTED), "plan")


def _plan(cells: DataFrame, targets, share: float) -> tuple[DataFrame, bool]:
    """The table (_source, _lang, _topic, weight, probability, reported shares) of a staged frame of cells with tokens,
    and whether it is small enough to broadcast."""
    if cells.count() > MAX_CELLS:
        return _frame_plan(cells, targets, share), False
    counts = {tuple(r[:3]): int(r[3]) for r in cells.collect()}
    have: list[dict[str, int]] = [{} for _ in DIMENSIONS]
    for k in sorted(counts):
        for i, v in enumerate(k):
            have[i][v] = have[i].get(v, 0) + counts[k]
    goals = {name: targets[name] if targets and name in targets else {v: t ** TEMPERING[name] for v, t in have[i].items()}
             for i, name in enumerate(DIMENSIONS)}
    weight = rake(counts, goals)
    chance = rake_bounded(counts, goals, share)
    reached = shares(counts, chance)
    aims = []
    for i, name in enumerate(DIMENSIONS):
        there = {v: max(0.0, goals[name].get(v, 0.0)) if t else 0.0 for v, t in have[i].items()}
        there = there if sum(there.values()) else have[i]
        aims.append({v: g / (sum(there.values()) or 1.0) for v, g in there.items()})
    rows = [(*k, float(weight[k]), float(chance[k]), *[x for i, v in enumerate(k) for x in (aims[i][v], reached[i][v])])
            for k in sorted(counts)]
    return cells.sparkSession.createDataFrame(
        rows, "_source string, _lang string, _topic string, weight double, probability double, "
        + ", ".join(f"{c} double" for c in REPORTED)), True


def _with_chance(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    on = [F.col(d) == F.col(f"_{d}") for d in DIMENSIONS]
    return rows.join(F.broadcast(plan) if small else plan, on, "left").drop("_source", "_lang", "_topic")


def mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = KEEP_SHARE,
            **cols) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, kept) of every document, with the target and the
    reached share of its source, language and topic in the expected sample."""
    columns, draw = described(docs, **cols)
    rows = stage(docs.select(docs[cols.get("id_col", "doc_id")].cast("long").alias("doc_id"), *columns,
                             draw.alias("draw")), "mixture")
    cells = stage(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    out = _with_chance(rows, *_plan(cells, targets, share))
    return out.select("doc_id", *DIMENSIONS, F.col("tokens").alias("n_tokens"), "weight", "probability",
                      (F.col("draw") < F.col("probability")).alias("kept"), *REPORTED)


def sample_mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = KEEP_SHARE,
                   **cols) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns."""
    columns, draw = described(docs, **cols)
    cells = stage(docs.select(*columns).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    drawn = _with_chance(docs.select(whole, *columns[:3], draw.alias("_draw")), *_plan(cells, targets, share))
    return drawn.where(F.col("_draw") < F.col("probability")).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op7(spark, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents"))
