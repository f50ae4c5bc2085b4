"""Map matching of sessions by a hidden Markov model over candidate edges.

Candidates come from the grid join. Rows are dealt out by session and sorted, and stream through Arrow batches; all sessions
of a batch go through the Viterbi recursion together, step by step, and only a session that a batch cuts waits for the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.projection import to_wgs84
from driftline.session import ship

from .correct import against_truth
from .sessionize import order
from .spatial import HMM_K, HMM_RADIUS_M, find_candidates

SIGMA_Z, BETA, MIN_SESSION = 10.0, 50.0, 2
_ADDED = ("hmm_pred_glh_east", "hmm_pred_glh_north", "hmm_perp_distance_m")


def viterbi(candidates: list[list[tuple[float, float, float]]], observed: np.ndarray, sigma_z: float = SIGMA_Z, beta: float = BETA, mode: str = "parity") -> tuple[list[int | None], list[float]]:
    """``solve`` for one session: the candidate index at each step (None for none) and the score of the path up to it.

    A candidate is (distance, east, north).
    """
    counts = np.array([len(c) for c in candidates], dtype=np.int64)
    flat = np.array([c for own in candidates for c in own], dtype=float).reshape(-1, 3)
    chosen, total = solve(np.array([0, len(counts)]), counts, flat, np.asarray(observed, dtype=float).reshape(-1, 2), sigma_z, beta, mode)
    return [None if k < 0 else int(k) for k in chosen], total.tolist()


def solve(bounds: np.ndarray, counts: np.ndarray, flat: np.ndarray, observed: np.ndarray, sigma_z: float = SIGMA_Z, beta: float = BETA, mode: str = "parity") -> tuple[np.ndarray, np.ndarray]:
    """The candidate chosen at each step of many sessions (-1 for none), and the score of the path up to it.

    Session i has the steps from bounds[i] to bounds[i + 1]; step t has counts[t] candidates (distance, east, north) in ``flat``. Steps
    without candidates break the chain: the next one starts anew. parity: the step before an interior gap stays unassigned, and
    the one before that follows the last candidate's back-pointer; a session whose first step has no candidates is
    unassigned. segmented: each unbroken run is a session of its own.
    """
    steps, width = len(counts), int(counts.max(initial=0))
    chosen, total = np.full(steps, -1), np.full(steps, -np.inf)
    if not width:
        return chosen, total
    table = np.full((steps, width, 3), np.nan)
    row = np.repeat(np.arange(steps), counts)
    table[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    emit = np.where(np.isnan(table[:, :, 0]), -np.inf, -(table[:, :, 0] ** 2) / (2 * sigma_z**2))
    if mode == "segmented":
        full, starts = counts > 0, np.zeros(steps, bool)
        starts[bounds[:-1][bounds[:-1] < steps]] = True
        first = np.flatnonzero(full & (starts | ~np.concatenate([[False], full[:-1]])))
        last = np.flatnonzero(full & (np.append(starts[1:], True) | ~np.append(full[1:], False)))
        lengths = last - first + 1
    else:
        first, lengths = bounds[:-1], np.diff(bounds)
        fit = (lengths > 0) & (counts[np.minimum(first, steps - 1)] > 0)
        first, lengths = first[fit], lengths[fit]
    order_ = np.argsort(-lengths, kind="stable")  # those that go on are in front
    first, lengths = first[order_], lengths[order_]
    if not len(first):
        return chosen, total
    scores, back = emit.copy(), np.full((steps, width), -1)
    moved = np.zeros(steps)
    moved[1:] = np.sqrt(((observed[1:] - observed[:-1]) ** 2).sum(axis=1))
    for t in range(1, int(lengths[0])):
        at = first[: int(np.searchsorted(-lengths, -t, side="left"))] + t
        at = at[(counts[at] > 0) & (counts[at - 1] > 0)]
        if not len(at):
            continue
        gap = table[at - 1][:, :, None, 1:] - table[at][:, None, :, 1:]
        far = np.sqrt(gap[..., 0] * gap[..., 0] + gap[..., 1] * gap[..., 1])
        path = scores[at - 1][:, :, None] - np.abs(far - moved[at][:, None, None]) / beta
        path[np.isnan(path)] = -np.inf
        best = path.argmax(axis=1)
        back[at] = best
        scores[at] = np.take_along_axis(path, best[:, None, :], axis=1)[:, 0] + emit[at]
    # from the last step that has candidates, all sessions together
    ends = first.copy()
    for i, (a, n) in enumerate(zip(first, lengths)):
        ends[i] = a + np.flatnonzero(counts[a : a + n])[-1]
    k = scores[ends].argmax(axis=1)
    chosen[ends], total[ends] = k, scores[ends, k]
    for back_by in range(int((ends - first).max())):
        live = np.flatnonzero(ends - back_by > first)
        at = ends[live] - back_by
        own = np.where(k[live] < 0, counts[at] - 1, k[live])
        previous = np.where(counts[at] > 0, back[at, np.maximum(own, 0)], -2)
        go = previous >= 0
        chosen[at[go] - 1], total[at[go] - 1] = previous[go], scores[at[go] - 1, previous[go]]
        k[live] = np.where(go, previous, np.where(previous == -2, -1, 0))  # an empty step: what precedes it is reached from its last candidate
    return chosen, total


def _whole_sessions(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole sessions, with where each starts; rows come by session."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys)))
        new = np.flatnonzero([k != p for k, p in zip(own, [before, *own[:-1]])])
        before = own[-1]
        if not len(new):
            held.append(batch)
            continue
        n = sum(b.num_rows for b in held)
        done = [b for b in (*held, batch.slice(0, int(new[-1]))) if b.num_rows]
        if done:
            yield pa.Table.from_batches(done), np.unique([0, *(n + new[:-1])])
        held = [batch.slice(int(new[-1]))]
    if held:
        yield pa.Table.from_batches(held), np.array([0])


def apply_hmm(df: DataFrame, network: DataFrame, east_col: str = "glh_east", north_col: str = "glh_north", max_radius_m: float = HMM_RADIUS_M, k: int = HMM_K, sigma_z: float = SIGMA_Z, beta: float = BETA, min_session_len: int = MIN_SESSION, mode: str = "parity") -> DataFrame:
    """Add hmm_* columns: position on the chosen edge, its distance, and deviation from the truth.

    Sessions are (volunteer, glh_session_id); rows without a volunteer or session, and sessions that are too
    short or without any position, keep nulls.
    """
    ship(df.sparkSession)
    keys = ["volunteer", "glh_session_id"]
    found = find_candidates(df, network, east_col, north_col, max_radius_m, k)
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in _ADDED]])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_sessions(batches, keys):
            spots = rows["candidates"].combine_chunks()
            counts = spots.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            fields = spots.flatten()
            flat = np.column_stack([fields.field(c).to_numpy(zero_copy_only=False) for c in ("d", "px", "py")]).reshape(-1, 3)
            bounds = np.append(starts, rows.num_rows)
            first = np.cumsum(counts) - counts
            use = np.repeat(np.diff(bounds) >= min_session_len, np.diff(bounds))
            flat, counts = flat[np.repeat(use, counts)], np.where(use, counts, 0)
            first = np.cumsum(counts) - counts
            observed = np.column_stack([rows[c].to_numpy().astype(float) for c in (east_col, north_col)])
            chosen, _ = solve(bounds, counts, flat, observed, sigma_z, beta, mode)
            hit = chosen >= 0
            at = flat[first[hit] + chosen[hit]] if hit.any() else np.zeros((0, 3))
            out = np.full((rows.num_rows, 3), np.nan)
            out[hit] = at[:, [1, 2, 0]]
            made = [pa.array(out[:, i], mask=~hit) for i in range(3)]
            full = pa.Table.from_arrays([*(rows[c] for c in names), *made], names=[*names, *_ADDED])
            yield from full.to_batches(max_chunksize=20_000)

    keyed = F.col("volunteer").isNotNull() & F.col("glh_session_id").isNotNull()
    by_session = found.where(keyed).select(*names, "candidates").repartition(*keys).sortWithinPartitions(*keys, *order(df, "timestamp"))
    solved = by_session.mapInArrow(run, schema)
    rest = df.where(~keyed).select("*", *[F.lit(None).cast("double").alias(c) for c in _ADDED])
    out = solved.unionByName(rest)
    out = to_wgs84(out, "hmm_pred_glh_east", "hmm_pred_glh_north", "hmm_pred_glh_lat", "hmm_pred_glh_lon")
    return against_truth(out, "hmm_pred_glh_east", "hmm_pred_glh_north", "hmm_pred_deviation_m", hmm_improvement_vs_raw_m="deviation_m", hmm_improvement_vs_stage2_m="corrected_deviation_m")
