"""A stream of block updates judged against what each block has taken so far, with the refusals as output.

The state of a block, its last verified month and growth, lives in the stream's state store, so a date that goes back is refused
across batches and restarts, and a batch that runs again gives the same rows. Nothing else of the stream is kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.nowcast import LEAST_YOY, MOST_YOY, REVISION

JUDGED = "block string, sent long, new_date string, new_yoy double, taken boolean, reason string, latest_date string, latest_yoy double"
_MONTH = re.compile(r"20\d{2}-(0[1-9]|1[0-2])")


def refusal(date: str | None, value: float | None, last: tuple[str, float] | None) -> str | None:
    """Why an update may not follow `last`; null if it may. The same rules as nowcast.refusal, for a row."""
    if not isinstance(date, str) or not _MONTH.fullmatch(date):
        return "invalid month"
    if last and date < last[0]:
        return "date regression"
    if value is None or not math.isfinite(value) or not LEAST_YOY <= value <= MOST_YOY:
        return "implausible growth"
    if last and date == last[0] and abs(value - last[1]) > REVISION:
        return "same-month revision too large"
    return None


def _judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(parts)).sort_values(["sent", "new_date", "new_yoy"], kind="stable")  # a block's updates of one batch
    last, out = (state.get if state.exists else None), []
    for sent, date, value in zip(rows["sent"], rows["new_date"], rows["new_yoy"], strict=True):
        value = None if pd.isna(value) else float(value)
        why = refusal(date, value, last)
        last = (date, round(value, 4)) if why is None else last
        out.append((key[0], sent, date, value, why is None, why, *(last or (None, None))))
    if last:
        state.update(last)
    yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in JUDGED.split(", ")])


def judged(updates: DataFrame) -> DataFrame:
    """Every update (block, sent, new_date, new_yoy) of a stream with taken, the reason if it was refused, and what the block has
    verified after it. In a batch a block's updates are judged in the order of sent, then of date and value; batches in theirs.
    A block's first valid update is taken. Updates without a block are left out."""
    state = "latest_date string, latest_yoy double"
    kept = updates.select("block", "sent", "new_date", "new_yoy").where("block IS NOT NULL")
    return kept.groupBy("block").applyInPandasWithState(_judge, JUDGED, state, "append", GroupStateTimeout.NoTimeout)
