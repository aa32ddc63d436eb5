"""The game state machine: half-innings played out of event rates, many iterations to a task."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewheel.session import ship

# Bases a batter gains by each event; everything else is an out.
GAINS = {"walk": 1, "hit_by_pitch": 1, "single": 1, "double": 2, "triple": 3, "home_run": 4}


def step(bases: int, outs: int, event: str) -> tuple[int, int, int]:
    """(bases, outs, runs) after an event. Bases are three bits; on a walk only forced runners move, on a hit all by the hit's bases."""
    gain = GAINS.get(event)
    if gain is None:
        return bases, outs + 1, 0
    if event in ("walk", "hit_by_pitch"):
        for base in (1, 2, 4):
            if not bases & base:
                return bases | base, outs, 0
        return 7, outs, 1
    moved = (bases << gain) | (1 << (gain - 1))
    return moved & 7, outs, (moved >> 3).bit_count()


def half_innings(spark: SparkSession, rates: Mapping[str, float], iterations: int, seed: int = 17) -> DataFrame:
    """(iteration, runs, batters) of simulated half-innings; an iteration's numbers depend on the seed and its own number alone.

    Rates are weights of events and need an out among them.
    """
    ship(spark)
    names = sorted(rates)
    weights = np.array([float(rates[n]) for n in names])
    if not names or weights[[n not in GAINS for n in names]].sum() <= 0:
        raise ValueError("no event ends a half-inning")
    cdf = np.cumsum(weights) / weights.sum()

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i in pdf["id"].tolist():
                rng, bases, outs, runs, batters = np.random.default_rng([seed, i]), 0, 0, 0, 0
                while outs < 3:
                    event = names[min(int(np.searchsorted(cdf, rng.random(), "right")), len(names) - 1)]
                    bases, outs, scored = step(bases, outs, event)
                    runs += scored
                    batters += 1
                rows.append((i, runs, batters))
            yield pd.DataFrame(rows, columns=["iteration", "runs", "batters"])

    return spark.range(iterations).mapInPandas(play, "iteration long, runs long, batters long")


OUTCOMES = ("ball", "called_strike", "swinging_strike", "foul", "in_play", "hit_by_pitch")


def _uniform(seed: int, iteration: np.ndarray, step_no: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on seed, iteration and step alone, wherever an iteration is played."""
    with np.errstate(over="ignore"):
        x = iteration.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + step_no.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class Machine:
    """Many games side by side, pitch by pitch. Rates are weights by count and of the events of balls in play. A count never seen takes the rates
    of all counts together; one whose outcomes never lead on raises."""

    def __init__(self, pitch: Mapping[tuple[int, int], Mapping[str, float]], in_play: Mapping[str, float]):
        weight = np.array([[[float(pitch.get((b, s), {}).get(o, 0)) for o in OUTCOMES] for s in range(3)] for b in range(4)])
        weight = np.where(weight.sum(2, keepdims=True) > 0, weight, weight.sum((0, 1)))
        moves = weight.copy()
        moves[:, 2, OUTCOMES.index("foul")] = 0
        if (moves.sum(2) <= 0).any():
            raise ValueError("a count without outcomes that lead on")
        self.pitch = np.cumsum(weight, 2) / weight.sum(2, keepdims=True)
        self.events = sorted(in_play)
        load = np.array([float(in_play[e]) for e in self.events])
        if not len(load) or load[[e not in GAINS for e in self.events]].sum() <= 0:
            raise ValueError("no ball in play ends a half-inning")
        self.in_play = np.cumsum(load) / load.sum()
        self.gain = np.array([GAINS.get(e, 0) for e in self.events])

    def play(self, iterations: np.ndarray, seed: int, innings: int = 9) -> pd.DataFrame:
        n = len(iterations)
        balls, strikes, outs, bases, half, pitches = (np.zeros(n, np.int64) for _ in range(6))
        runs = np.zeros((n, 2), np.int64)  # away, home
        live = np.ones(n, bool)
        tick = 0
        while live.any():
            i = np.flatnonzero(live)
            tick += 1
            u = _uniform(seed, iterations[i], np.full(len(i), 2 * tick))
            o = np.minimum((self.pitch[balls[i], strikes[i]] <= u[:, None]).sum(1), len(OUTCOMES) - 1)
            pitches[i] += 1
            ball, foul, hit = o == 0, o == 3, o == 4
            balls[i] += ball
            strikes[i] += (o == 1) | (o == 2) | (foul & (strikes[i] < 2))
            walk, out = (balls[i] >= 4) | (o == 5), strikes[i] >= 3
            v = _uniform(seed, iterations[i], np.full(len(i), 2 * tick + 1))
            e = np.minimum(np.searchsorted(self.in_play, v, "right"), len(self.events) - 1)
            gain = np.where(hit, self.gain[e], 0)
            b = bases[i]
            forced = np.where(b & 1 == 0, b | 1, np.where(b & 2 == 0, b | 2, np.where(b & 4 == 0, b | 4, 7)))
            moved = np.where(gain > 0, (b << gain) | (1 << np.maximum(gain - 1, 0)), b)
            scored = np.where(walk, (b == 7) * 1, np.where(gain > 0, sum((moved >> k) & 1 for k in range(3, 8)), 0))
            bases[i] = np.where(walk, forced, np.where(gain > 0, moved & 7, b))
            runs[i, half[i] % 2] += scored
            done = walk | out | hit
            outs[i] += out | (hit & (gain == 0))
            balls[i[done]] = 0
            strikes[i[done]] = 0
            home_bats, last = half[i] % 2 == 1, half[i] // 2 >= innings - 1
            won = home_bats & last & (runs[i, 1] > runs[i, 0])  # walk-off
            turn = (outs[i] >= 3) & ~won
            t = i[turn]
            outs[t], bases[t] = 0, 0
            half[t] += 1
            late, next_home = half[i] // 2 >= innings - 1, half[i] % 2 == 1
            over = won | (turn & late & next_home & (runs[i, 1] > runs[i, 0])) | (turn & (half[i] // 2 >= innings) & ~next_home & (runs[i, 1] != runs[i, 0]))
            live[i[over]] = False
        return pd.DataFrame({"iteration": iterations, "away": runs[:, 0], "home": runs[:, 1], "innings": half // 2 + (half % 2 == 1) * 1, "pitches": pitches})


def games(spark: SparkSession, pitch: Mapping[tuple[int, int], Mapping[str, float]], in_play: Mapping[str, float], iterations: int, seed: int = 17) -> DataFrame:
    """(iteration, away, home, innings, pitches) of simulated games: nine innings, the home side's last half only if it is needed, extra
    innings while the score is level. An iteration's game depends on the seed and its own number alone."""
    ship(spark)
    machine = Machine(pitch, in_play)

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                ids = pdf["id"].to_numpy()[lo : lo + 4096]
                if len(ids):
                    yield machine.play(ids, seed)

    return spark.range(iterations).mapInPandas(play, "iteration long, away long, home long, innings long, pitches long")
