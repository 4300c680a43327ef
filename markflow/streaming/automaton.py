"""A pattern automaton per key over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.patterns import Dfa


def run(events: DataFrame, key: str, order: str, symbol: str, dfa: Dfa, symbols: list[str]) -> DataFrame:
    """(key, at, matched): whenever events of a key arrive, its state is moved on; matched says whether it accepts now.

    Events of a key must arrive in order between batches; inside a batch they are sorted. The state is one number a key.
    """
    ids = {s: i for i, s in enumerate(symbols)}

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        s = state.get[0] if state.exists else 0
        for c in rows[symbol]:
            s = dfa.delta[s][ids.get(c, len(symbols))]
        state.update((s,))
        yield pd.DataFrame({key: [k[0]], "at": [int(rows[order].iloc[-1])], "matched": [s in dfa.accept]})

    rows = events.select(F.col(key), F.col(order).cast("long").alias(order), F.col(symbol))
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at long, matched boolean", "state int", "append", GroupStateTimeout.NoTimeout)
