"""Model selection: k sweep (C6), backward/forward searches (C7/C8),
warm-started clustering over time (C14) and the final choice (C15).

Time points of a cold run are independent, so the whole sweep over all
time points and all k is one packed fit. A warm run is sequential over
time points: the input is staged once, partitioned by time point, and each time point reads its own part. Inside a time
point the two searches do not depend on each other, so every round fits, packed, the next model of each search whose
start is known: the previous centres refitted, and beside them the first step forward where the new centre needs no members.
After the loop one packed assignment produces the chosen model of every time point in a single job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.config import RunConfig
from tidewarp.operators import kmeans as km
from tidewarp.operators.assign import assign
from tidewarp.session import cut_lineage, staging_path

KEYS = ["time_point", "k"]
#: ways of adding a centre that need no members of the model that grows
MEMBER_FREE = ("random", "mean_of_previous_mean")


@dataclass
class Choice:
    time_point: int
    k: int
    centres: np.ndarray
    run_silhouette: float | None
    cluster_sil: dict
    kind: str  # sweep | keep | backward | forward
    steps: list = field(default_factory=list)


def init_centres(series: DataFrame, tps: list[int], ks: list[int], cfg: RunConfig) -> dict:
    if cfg.init == "lowest_ids":
        return km.lowest_id_centres(series, ks)
    return {(tp, k): km.random_centres(k, cfg.series_length, f"{cfg.seed}-{tp}-{k}") for tp in tps for k in ks}


def _best(res: dict) -> dict:
    """Per time point the k with the highest run silhouette; strict '>' so
    the lowest k wins ties; NULL silhouettes (k = 1) never win (Q12)."""
    best: dict = {}
    for (tp, k) in sorted(res):
        sil, _ = res[(tp, k)]
        if sil is None or (isinstance(sil, float) and np.isnan(sil)):
            continue
        if tp not in best or sil > best[tp][1]:
            best[tp] = (k, sil)
    return best


def sweep(series: DataFrame, cfg: RunConfig) -> tuple[dict, km.KMeansFit]:
    """C6 + C13: every k of min..max for every time point in one packed fit."""
    ks = list(range(cfg.min_k, cfg.max_k + 1))
    rows = dict(series.groupBy("time_point").count().collect())
    # the k fan-out is an explode inside each fit's tasks over the input: the candidate ks never multiply what is stored
    sk = km.fan_out_k(series, ks)
    fit = km.fit(sk, init_centres(series, list(rows), ks, cfg), KEYS, cfg, rows_of={(tp, k): n for tp, n in rows.items() for k in ks})
    res = km.run_silhouettes(fit.stats)
    best = _best(res)
    out = {tp: Choice(tp, k, fit.centres[(tp, k)], sil, res[(tp, k)][1], "sweep") for tp, (k, sil) in best.items()}
    return out, fit


def worst_cluster(sil_map: dict, compat: bool) -> int:
    """Cluster to drop / split: lowest silhouette, lowest id on ties (Q5:
    compat takes the lowest cluster id)."""
    items = sorted((c, s) for c, s in sil_map.items() if s is not None)
    if compat:
        return items[0][0]
    return min(items, key=lambda cs: (cs[1], cs[0]))[0]


def _grow(centres: np.ndarray, method: str, tp: int, cfg: RunConfig, source,
          sil_map: dict, step: int) -> np.ndarray:
    """One more centre. ``source`` is (fit, k): the fit whose model k
    is grown; its assignment is only planned for the data-driven methods."""
    k = centres.shape[0]
    assigned = None if method in MEMBER_FREE else source[0].assignments.where((F.col("time_point") == tp) & (F.col("k") == source[1]))
    if method == "random":
        return km.add_random_centre(centres, f"{cfg.seed}-{tp}-{k}-add{step}")
    if method == "furthest":
        v = km.series_of(km.furthest_members(assigned, KEYS), KEYS)
        return np.vstack([centres, next(iter(v.values()))])
    if method == "furthest_in_cluster":
        w = worst_cluster(sil_map, cfg.compat)
        v = km.series_of(km.furthest_members_in(assigned, KEYS, {(tp, k): w}), KEYS)
        return np.vstack([centres, next(iter(v.values()))])
    return km.add_mean_of_centres(centres)


class _Search:
    """One direction: the centres, silhouettes and fit that the next step starts from, and the last accepted choice."""

    def __init__(self, name: str, tp: int, centres: np.ndarray, cfg: RunConfig):
        self.name, self.tp, self.cfg = name, tp, cfg
        self.centres, self.step, self.steps, self.accepted = centres, 0, [], None
        self.sil, self.map, self.source = None, None, None
        self.on = True

    def start(self, keep: Choice, fit: km.KMeansFit) -> None:
        self.sil, self.map, self.source = keep.run_silhouette, keep.cluster_sil, (fit, keep.k)

    def next_k(self) -> int:
        return self.centres.shape[0] + (1 if self.name == "forward" else -1)

    def propose(self) -> np.ndarray | None:
        """The start of the next model; None when the search is at its end."""
        k = self.next_k()
        if not self.on or k > self.cfg.max_k or k < max(self.cfg.min_k, 2) and self.name == "backward":
            return None
        if self.name == "backward":
            return km.remove_centre(self.centres, worst_cluster(self.map, self.cfg.compat))
        return _grow(self.centres, self.cfg.new_centre_method, self.tp, self.cfg, self.source, self.map, self.step + 1)

    def judge(self, fit: km.KMeansFit, k: int) -> None:
        """Take the model of ``k`` centres if it is better by more than the threshold, else end the search."""
        sil, sils = km.run_silhouettes(fit.stats).get((self.tp, k), (None, {}))
        self.step += 1
        self.steps.append((self.step, self.name, k, sil))
        base = self.sil if self.sil is not None else -np.inf
        if sil is None or not (sil > base + self.cfg.sil_threshold):
            self.on = False
            return
        self.centres, self.sil, self.map, self.source = fit.centres[(self.tp, k)], sil, sils, (fit, k)
        self.accepted = Choice(self.tp, k, self.centres, sil, sils, self.name)


def refine(series: DataFrame, previous: dict, cfg: RunConfig, rows: dict | None = None) -> dict:
    """C14: {time point: Choice} for each time point of ``previous`` ({time point: centres of the period before}): keep
    (re-fit from the previous centres), then
    the backward (C7) and forward (C8) searches, then the choice (C15). Both searches begin at the previous centres. A round
    of the searches of all time points is one packed fit."""
    rows = dict(series.groupBy("time_point").count().collect()) if rows is None else rows

    def fitted(starts: list) -> km.KMeansFit:
        init = {(tp, c.shape[0]): c for tp, c in starts}
        return km.fit(km.fan_out_k(series, sorted({k for _, k in init})), init, KEYS, cfg, rows_of={key: rows.get(key[0], 0) for key in init})

    searches = {tp: [_Search(name, tp, c, cfg) for name in ("backward", "forward")] for tp, c in previous.items()}
    early = {tp: forward.propose() for tp, (_, forward) in searches.items()} if cfg.new_centre_method in MEMBER_FREE else {}
    early = {tp: c for tp, c in early.items() if c is not None}
    fit = fitted([*previous.items(), *early.items()])
    found = km.run_silhouettes(fit.stats)
    keeps = {}
    for tp, c in previous.items():
        K = c.shape[0]
        sil, sils = found.get((tp, K), (None, {}))
        keeps[tp] = Choice(tp, K, fit.centres[(tp, K)], sil, sils, "keep")
        for search in searches[tp]:
            search.start(keeps[tp], fit)
        if tp in early:
            searches[tp][1].judge(fit, K + 1)
    while True:
        starts = [(s, c) for pair in searches.values() for s in pair if (c := s.propose()) is not None]
        if not starts:
            break
        fit = fitted([(s.tp, c) for s, c in starts])
        for search, c in starts:
            search.judge(fit, c.shape[0])
    out = {}
    for tp, (back, forward) in searches.items():
        out[tp] = _chosen(keeps[tp], back.accepted, forward.accepted)
        out[tp].steps = [(name, k, sil) for _, name, k, sil in sorted(back.steps + forward.steps, key=lambda x: x[:2])]
    return out


def _chosen(keep: Choice, backward: Choice | None, forward: Choice | None) -> Choice:
    """The accepted search with the higher silhouette; if both are equal, or none is accepted, keep."""
    if backward is not None and forward is not None:
        if backward.run_silhouette == forward.run_silhouette:
            return keep
        return max(backward, forward, key=lambda c: c.run_silhouette)
    return backward or forward or keep


def _in_range(series: DataFrame, cfg: RunConfig) -> DataFrame:
    """Time points from..to of the input."""
    s = series.where(F.col("time_point") >= cfg.from_tp)
    return s if cfg.to_tp is None else s.where(F.col("time_point") <= cfg.to_tp)


def _run_input(series: DataFrame, cfg: RunConfig) -> DataFrame:
    """The input of a run; persisted here only when the caller
    has not persisted it already (a filter over a cached table scans the
    cache, no second copy)."""
    level = series.storageLevel
    s = _in_range(series, cfg)
    return s if (level.useMemory or level.useDisk) else cut_lineage(s)


def by_time_point(series: DataFrame) -> DataFrame:
    """The series staged in the shared folder, partitioned by time point; adaptive execution splits a large time point into several
    files. A read of one time point opens its files alone."""
    path = staging_path(series.sparkSession, "run-input")
    series.hint("rebalance", "time_point").write.partitionBy("time_point").parquet(path)
    return series.sparkSession.read.schema(series.schema).parquet(path)


def warm_run(series: DataFrame, cfg: RunConfig) -> tuple[dict, DataFrame]:
    """C14 over time points from..to: the first by a sweep, every later one
    refined from the previous choice. Returns the choices and one packed
    final assignment of every chosen model.

    Models that one task cannot fit (``kmeans.LOCAL_ROWS``) read their time point once per pass, so it is persisted for them.
    """
    staged = by_time_point(_in_range(series, cfg))
    counts = dict(staged.groupBy("time_point").count().collect())
    choices: dict = {}
    prev = None
    for tp in sorted(counts):
        s_tp = staged.where(F.col("time_point") == tp)
        large = counts[tp] > km.LOCAL_ROWS
        s_tp = cut_lineage(s_tp) if large else s_tp
        if prev is None:
            choices[tp] = sweep(s_tp, cfg)[0][tp]
        else:
            choices[tp] = refine(s_tp, {tp: prev.centres}, cfg, counts)[tp]
        prev = choices[tp]
        if large:
            s_tp.unpersist()
    return choices, final_assignment(staged, choices, cfg)


def final_assignment(series: DataFrame, choices: dict, cfg: RunConfig) -> DataFrame:
    """One job assigning every time point to its chosen centres."""
    spark = series.sparkSession
    ks = spark.createDataFrame([(int(tp), int(c.k)) for tp, c in choices.items()], "time_point int, k int")
    sk = series.join(F.broadcast(ks), "time_point")
    return assign(sk, {(tp, c.k): c.centres for tp, c in choices.items()}, KEYS, cfg)


def cold_run(series: DataFrame, cfg: RunConfig) -> tuple[dict, DataFrame]:
    """C13 with C6: independent time points, best k each, one packed fit;
    one more job assigns each time point to its chosen centres alone."""
    s = _run_input(series, cfg)
    choices, _ = sweep(s, cfg)
    return choices, final_assignment(s, choices, cfg)


def choices_frame(spark, choices: dict) -> DataFrame:
    rows = [(int(tp), int(c.k), None if c.run_silhouette is None else float(c.run_silhouette), c.kind)
            for tp, c in sorted(choices.items())]
    return spark.createDataFrame(rows, "time_point int, k int, run_silhouette double, choice string")
