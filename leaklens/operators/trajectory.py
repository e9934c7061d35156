"""Auditing trajectories step by step: scores against forbidden phrases, decisions, and what a refusal halts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leaklens.operators.search import MOST_PHRASES, encoded

#: Scores from which a step is filtered and refused, and what stands for a refused one.
FILTER, REFUSE = 0.55, 0.80
REFUSAL = "I do not have access to private records about this individual."


def step_scores(steps: DataFrame, phrases: DataFrame, text: str = "text", dims: int = 64) -> DataFrame:
    """Adds score: a step's largest cosine with a phrase (rows with `text`; MOST_PHRASES at most); 0 for blank steps or without phrases.

    Rows are scored where they lie, so batch and stream go the same way.
    """
    rows = phrases.select(encoded(F.col("text"), dims).alias("v")).limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    table = np.array([r["v"] for r in rows], float).reshape(-1, dims)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = np.stack(f.pop("_v").to_numpy()) if len(f) else np.zeros((0, dims))
            f["score"] = np.round((v @ table.T).max(1), 6) if len(table) else np.zeros(len(f))
            yield f

    kinds = ", ".join(f"`{c}` {k}" for c, k in steps.dtypes)
    return steps.withColumn("_v", encoded(F.col(text), dims)).mapInPandas(best, f"{kinds}, score double")


def decide(score: Column) -> Column:
    return F.when(score >= REFUSE, "refuse").when(score >= FILTER, "filter").otherwise("pass")


def audit(scored: DataFrame, key: str, turn: str = "turn") -> DataFrame:
    """(key, turn, score, action): one decision for each step.

    A step that was given several times counts with its highest score. What follows a trajectory's first refusal, by
    turn and not by arrival, is `halted`. Rows without a key, turn or score are left out. The first refusals are found by
    a partial aggregate; trajectories are not gathered.
    """
    steps = scored.where(F.col(key).isNotNull() & F.col(turn).isNotNull() & F.col("score").isNotNull()).groupBy(key, turn).agg(F.max("score").alias("score"))
    refused = steps.where(F.col("score") >= REFUSE).groupBy(key).agg(F.min(turn).alias("_first"))
    both = steps.join(refused, key, "left")
    return both.select(key, turn, "score", F.when(F.col(turn) > F.col("_first"), "halted").otherwise(decide(F.col("score"))).alias("action"))


def replaced(steps: DataFrame, decisions: DataFrame, key: str, turn: str = "turn", text: str = "text") -> DataFrame:
    """The steps with a refused one's text replaced; what was halted is gone."""
    own = decisions.select(key, turn, "action")
    rows = steps.join(own, [key, turn])
    return rows.where("action <> 'halted'").withColumn(text, F.when(F.col("action") == "refuse", REFUSAL).otherwise(F.col(text)))


def _actions(turns: dict[int, float]) -> dict[int, str]:
    first = min((t for t, s in turns.items() if s >= REFUSE), default=None)
    return {t: "halted" if first is not None and t > first else "refuse" if s >= REFUSE else "filter" if s >= FILTER else "pass" for t, s in turns.items()}


def audit_stream(scored: DataFrame, key: str, turn: str = "turn") -> DataFrame:
    """(key, turn, score, action, revision) as scored steps arrive; start it in update mode.

    A trajectory's state holds the highest score of each of its turns. A decision is given when its step arrives and
    again, with a higher revision, when a late or repeated step changes it: a late refusal halts what was let pass. The
    last revision of each step is what `audit` gives for all steps together, in whatever order and batches they came.
    """
    kind = dict(scored.dtypes)[key]
    steps = scored.where(F.col(key).isNotNull() & F.col(turn).isNotNull() & F.col("score").isNotNull()).select(F.col(key).alias("k"), F.col(turn).cast("long").alias("t"), "score")

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, scores, revision = state.get if state.exists else ([], [], 0)
        before = dict(zip(at, scores, strict=True))
        now = dict(before)
        for f in frames:
            for t, s in zip(f["t"].tolist(), f["score"].tolist(), strict=True):
                now[t] = max(s, now.get(t, -1.0))
        old, new = _actions(before), _actions(now)
        changed = sorted(t for t in now if new[t] != old.get(t) or now[t] != before.get(t))
        state.update((list(now), list(now.values()), revision + 1))
        yield pd.DataFrame({key: [k[0]] * len(changed), turn: changed, "score": [now[t] for t in changed], "action": [new[t] for t in changed], "revision": [revision + 1] * len(changed)})

    return steps.groupBy("k").applyInPandasWithState(step, f"{key} {kind}, {turn} long, score double, action string, revision long", "at array<long>, scores array<double>, revision long", "update", GroupStateTimeout.NoTimeout)
