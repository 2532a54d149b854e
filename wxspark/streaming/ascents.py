"""ST10 as a stream: ascents are held until they are complete or four hours old; a timer ends those of which nothing more comes."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wxspark.operators.revisions import COMPLETE_HPA, FINAL_H

#: Hours after which a final ascent is forgotten; a sighting that comes later than that would begin anew.
REMEMBER_H = 48
FINAL = "site string, launched timestamp, why string, seen_at timestamp, digest string, top_hpa double"
_HELD = "done boolean, launched_us long, seen_us long, digest string, top_hpa double"


def final_ascents(sightings: DataFrame, late: str | None = None) -> DataFrame:
    """One final row an ascent (site, launched), as `operators.revisions.final_ascents` has it; sightings come in the order they are seen.

    What a sighting means depends on its own seen_at, so batches that are read again or cut otherwise give the same rows. The
    end of the four hours without another sighting is the clock's: a processing-time timer then lets out what is held. With `late`, for archives
    that are read again, it is the watermark's instead: seen_at less so much. The state of a key is one row.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    sightings = sightings if late is None else sightings.withWatermark("seen_at", late)
    window_us = int(FINAL_H * 3_600_000_000)

    def final(key: tuple, why: str, seen_us: int, digest: str | None, top: float | None) -> pd.DataFrame:
        return pd.DataFrame({"site": [key[0]], "launched": [key[1]], "why": [why], "seen_at": [pd.Timestamp(seen_us, unit="us")], "digest": [digest], "top_hpa": [top]})

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, launched, held = False, int(pd.Timestamp(key[1]).value // 1000), None
        if state.exists:
            done, launched, *kept = state.get
            held = tuple(kept) if not done and kept[0] is not None else None
        if state.hasTimedOut:
            if held is None or done:
                state.remove()  # remembered for long enough
                return
            yield final(key, "four hours old", *held)
            done = True
        rows = pd.concat(list(batches), ignore_index=True) if not state.hasTimedOut else None
        if rows is not None and not done:
            for seen, digest, top in rows.sort_values(["seen_at", "digest"])[["seen_at", "digest", "top_hpa"]].itertuples(index=False):
                seen_us = int(pd.Timestamp(seen).value // 1000)
                top = None if pd.isna(top) else float(top)
                if seen_us - launched >= window_us:
                    yield final(key, "four hours old", *held) if held else final(key, "seen late", seen_us, digest, top)
                    done = True
                elif top is not None and top <= COMPLETE_HPA:
                    yield final(key, "complete", seen_us, digest, top)
                    done = True
                else:
                    held = (seen_us, digest, top)
                if done:
                    break
        state.update((done, launched, *(held or (None, None, None))))
        until_ms = launched // 1000 + int((REMEMBER_H if done else FINAL_H) * 3_600_000)
        if late is None:
            state.setTimeoutDuration(max(1, until_ms - int(time.time() * 1000)))
        else:
            state.setTimeoutTimestamp(max(until_ms, state.getCurrentWatermarkMs() + 1))

    return sightings.groupBy("site", "launched").applyInPandasWithState(run, FINAL, _HELD, "append", timeout)
