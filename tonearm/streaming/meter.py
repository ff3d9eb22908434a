"""The loudness meter over a stream of chunks of samples, with its registers in the state of the query."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.loudness import Meter, decibels

_OUT = "track_id string, block long, power double, seconds double, sample_peak_db double, true_peak_db double"
_STATE = "next long, meter string, waiting string"


def measured_chunks(chunks: DataFrame) -> DataFrame:
    """track_id, block, power of each momentary block as soon as its last sample is there; and, when a track has ended, a row without
    a block with seconds, sample_peak_db, true_peak_db.

    chunks: (track_id, seq, sample_rate, channels, samples, last), a stream; samples are interleaved and cut anywhere between frames, seq counts
    a track's chunks from 0, and ``last`` marks the one that ends it. Chunks may come in any order: those ahead of their turn wait in the state. A chunk that
    comes twice counts once, and a null list of samples is an empty one; rows with a null track_id or seq are left out. The state of a track holds
    filter registers, the samples before, the unfinished sub-block and the last four; of a track that has ended only that it has is
    kept, so that a repeated chunk doesn't begin it anew.
    """

    def feed(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, meter, waiting = state.get if state.exists else (0, "null", "{}")
        if turn < 0:
            return
        held, waiting = json.loads(meter), {int(k): v for k, v in json.loads(waiting).items()}
        for frame in frames:
            for r in frame.itertuples():
                if r.seq >= turn:
                    waiting[int(r.seq)] = [int(r.sample_rate), int(r.channels), [] if r.samples is None else np.asarray(r.samples, np.float64).tolist(), bool(r.last)]
        out: list[tuple] = []
        done = False
        while turn in waiting and not done:
            rate, channels, samples, done = waiting.pop(turn)
            own = Meter(rate, channels, held)
            out += [(key[0], block, power, None, None, None) for block, power in own.feed(np.array(samples))]
            held, turn = own.state, turn + 1
            if done:
                out.append((key[0], None, None, held["frames"] / rate, decibels(held["sample_peak"]), decibels(max(held["sample_peak"], held["true_peak"]))))
        if done:
            state.update((-1, "null", "{}"))
        else:
            state.update((turn, json.dumps(held), json.dumps(waiting)))
        frame = pd.DataFrame(out, columns=["track_id", "block", "power", "seconds", "sample_peak_db", "true_peak_db"])
        yield frame.astype({"block": "Int64", "power": float, "seconds": float, "sample_peak_db": float, "true_peak_db": float})

    known = chunks.where("track_id is not null and seq is not null")
    return known.groupBy("track_id").applyInPandasWithState(feed, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
