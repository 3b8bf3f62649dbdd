"""A stream of attempts folded into one retained state per key."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Columns of an attempt beside its keys, and of a state.
ATTEMPT = "place long, at timestamp, version int, status string, result string"
STATE = "version int, attempts long, skipped long, last_at timestamp, status string, result string, verified_at timestamp"


@dataclass(frozen=True)
class Rules:
    """``cool_down``: seconds after a failed attempt within which further ones of its version are skipped; ``best``: the status that is never lowered."""

    cool_down: int = 86400
    best: str = "verified"


def advanced(state: tuple | None, attempt, rules: Rules) -> tuple:
    """The state (in the order of STATE) after an attempt.

    The first attempt, and one of a newer version, begins anew: it counts as attempt 1 and its outcome stands, unless the state is
    ``best``, which stays with its result until a newer version confirms it or gives another best one. One of an older version, or
    before the last attempt, is skipped. Once the state is best, attempts of its version are skipped. After a failure those within the
    cool-down are skipped. Any other counts and its outcome stands.
    """
    version, at, status, result = int(attempt.version), attempt.at, attempt.status, attempt.result
    good = status == rules.best
    if state is None:
        return version, 1, 0, at, status, result, at if good else None
    v, n, skipped, last, kept, value, verified = state
    if version > v:
        if kept == rules.best and not good:
            return version, 1, skipped, at, kept, value, verified
        return version, 1, skipped, at, status, result, at if good else None
    late = version < v or at < last or kept == rules.best or (at - last).total_seconds() < rules.cool_down
    if late:
        return v, n, skipped + 1, last, kept, value, verified
    return v, n + 1, skipped, at, status, result, at if good else None


def attempt_states(attempts: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:
    """The states (keys, STATE) of a stream of attempts (keys, place, at, version, status, result), one row per key and micro-batch that changes it.

    ``advanced`` says how an attempt changes a state. Attempts of a micro-batch are taken by place, those of different
    micro-batches as they come. Attempts without a version, time or status are left out. Use it in update mode; the last row of a key
    (highest attempts + skipped) is its state. State is kept by Spark's state store and survives a restart from the checkpoint.
    """
    schema = attempts.select(*keys).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def fold(key: tuple, frames, kept: GroupState):
        state = None
        if kept.exists:
            state = tuple(None if pd.isna(x) else x for x in kept.get)
        rows = pd.concat(list(frames)).sort_values(["place", "at"], kind="stable")
        for row in rows.itertuples():
            state = advanced(state, row, rules)
        kept.update(state)
        yield pd.DataFrame([(*key, *state)], columns=[*keys, *(c.split()[0] for c in STATE.split(", "))])

    known = attempts.where("version is not null and at is not null and status is not null").select(*keys, *(c.split()[0] for c in ATTEMPT.split(", ")))
    return known.groupBy(*keys).applyInPandasWithState(fold, f"{schema}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
