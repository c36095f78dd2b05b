"""Review events as a stream: the standing decisions of each session after every batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session long, icon int, action string, seq long"


def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Push applies, pop undos (nothing to pop: no effect); emits the session's decisions as they stand.

    Rows of one batch are taken in (ts, event_id) order; the history is the state.
    """
    actions, icons, seqs, following = state.get if state.exists else ([], [], [], 0)
    actions, icons, seqs = list(actions), list(icons), list(seqs)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for action, icon in zip(rows["action"], rows["icon"]):
        if action == "undo":
            if actions:
                actions.pop(), icons.pop(), seqs.pop()
        else:
            actions.append(action), icons.append(int(icon)), seqs.append(following)
            following += 1
    state.update((actions, icons, seqs, following))
    stand = {i: (a, s) for a, i, s in zip(actions, icons, seqs)}
    yield pd.DataFrame({"session": key[0], "icon": list(stand), "action": [v[0] for v in stand.values()], "seq": [v[1] for v in stand.values()]})


def decisions(events: DataFrame) -> DataFrame:
    """session, icon, action, seq updates of a stream with user_id, event_id, ts, action, icon."""
    return events.groupBy("user_id").applyInPandasWithState(step, OUTPUT, "actions array<string>, icons array<int>, seqs array<long>, following long", "update", GroupStateTimeout.NoTimeout)
