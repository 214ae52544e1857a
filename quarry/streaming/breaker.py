"""Circuit breaker over a stream of request outcomes: consecutive failures open an endpoint for a cooldown."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "endpoint string, at timestamp, ok boolean, consecutive long, open_until timestamp, refused boolean"
STATE = "consecutive long, open_until timestamp"


def breaker(outcomes: DataFrame, threshold: int = 2, cooldown_s: int = 30) -> DataFrame:
    """One row per outcome (endpoint, at, ok) with the breaker's state after it.

    ``consecutive`` counts failures since the last success. From ``threshold`` on, each failure opens the circuit until
    ``at`` + ``cooldown_s``; a success closes it. ``refused`` tells that the circuit was open when the request came. State is
    one row per endpoint. Outcomes are taken by time within a micro-batch, and a null ``ok`` counts as a failure; outcomes
    without a time or an endpoint are dropped.
    """
    rest = pd.Timedelta(seconds=cooldown_s)

    def advance(key: tuple[Any], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        failed, until = state.get if state.exists else (0, None)
        until = pd.NaT if until is None else pd.Timestamp(until)
        out = []
        for at, ok in zip(rows["at"], rows["ok"]):
            refused, ok = bool(at < until), bool(ok) if ok is not None else False
            failed = 0 if ok else failed + 1
            until = pd.NaT if ok else at + rest if failed >= threshold else until
            out.append((key[0], at, ok, failed, until, refused))
        state.update((failed, None if until is pd.NaT else until.to_pydatetime()))
        yield pd.DataFrame(out, columns=["endpoint", "at", "ok", "consecutive", "open_until", "refused"]).astype({"open_until": "datetime64[us]"})

    known = outcomes.filter("endpoint IS NOT NULL AND at IS NOT NULL").selectExpr("endpoint", "at", "coalesce(ok, false) AS ok")
    return known.groupBy("endpoint").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
