"""Implausible readings: impossible values, stuck runs and spikes, each against its own source.

Per source (one ordered series per key and field) a robust first-order autoregression is fitted: the scatter
is the median absolute step, the coefficient follows from the medians of steps over one and two readings.
Additive-outlier and level-shift tests are then iterated on the residuals: a residual beyond ``SCREEN``
scatters makes its reading a candidate, and so does a step of more than ``SPIKE`` scatters, whatever the residual (a
source far from its median may jump back to it); one to three successive readings that lie more than ``SPIKE`` scatters
away from the clean readings on both sides are additive outliers and leave the series; a candidate whose
successors stay at its level is a level shift and moves the series' level; tests go on until nothing changes.

Whether a reading is a spike depends on its scatter and its clean neighbours alone (a candidate that is no jump of ten
scatters is never one), so medians and levels, which differ between a source and its chunks, change no result.

Sources are spread by key. One that holds more than ``MAX_GROUP_ROWS`` rows is cut into range-sorted chunks;
the exact median step then comes from the steps in one bin of merged step histograms, its runs and neighbours across chunk
borders from a scan over the chunks' small border summaries.

Defined results: rows without key, time or row id are left out, and so are missing readings; a constant
source has no stuck readings; a source with fewer than three readings has no spikes; ties in time are ordered
by row id; repeated rows count as readings of their own; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.operators.sharding import CHUNK_ROWS, MAX_GROUP_ROWS, by_group, range_chunks, split_hot

SPIKE = 10.0
SCREEN = 3.0
LONGEST = 3
STUCK = 8
#: Clean readings of each border that neighbouring chunks exchange.
HALO = 16
#: Most chunks of hot sources, which bounds what the driver scans (about 1 kB each).
MAX_CHUNKS = 100_000
_BIN = np.log(1.02)
_BIN0 = 1e-9


@dataclass(frozen=True)
class Field:
    """A measured column: ``value`` decodes missing codes to NULL; outside [low, high] is impossible."""

    name: str
    value: Column
    low: float
    high: float


def _starts(n: int, cols: Sequence[np.ndarray]) -> np.ndarray:
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return new


def segment_medians(seg: np.ndarray, v: np.ndarray, n_seg: int) -> np.ndarray:
    """The median of ``v`` in every segment (NaN for none)."""
    order = np.lexsort((v, seg))
    cnt = np.bincount(seg, minlength=n_seg)
    first = np.cumsum(cnt) - cnt
    out = np.full(n_seg, np.nan)
    has = cnt > 0
    w = v[order]
    lo = first[has] + (cnt[has] - 1) // 2
    hi = first[has] + cnt[has] // 2
    out[has] = (w[lo] + w[hi]) / 2
    return out


def fit(seg: np.ndarray, x: np.ndarray, n_seg: int) -> tuple[np.ndarray, np.ndarray]:
    """Scatter and autoregression coefficient of every segment."""
    one = seg[1:] == seg[:-1]
    d1 = np.abs(x[1:] - x[:-1])[one]
    s1 = seg[1:][one]
    scatter = segment_medians(s1, d1, n_seg)
    zero = scatter == 0
    if zero.any():
        some = d1 > 0
        scatter = np.where(zero, segment_medians(s1[some], d1[some], n_seg), scatter)
    two = seg[2:] == seg[:-2]
    lag2 = segment_medians(seg[2:][two], np.abs(x[2:] - x[:-2])[two], n_seg)
    return np.nan_to_num(scatter), _coefficient(scatter, lag2)


def _coefficient(lag1: np.ndarray, lag2: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(np.nan_to_num((lag2 / lag1) ** 2 - 1), 0.0, 0.98)


def run_lengths(seg: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each reading, the number of successive readings of its segment with the very same value."""
    if not len(x):
        return np.zeros(0, np.int64)
    run = np.cumsum(_starts(len(x), [seg, x])) - 1
    return np.bincount(run)[run]


def spikes(seg: np.ndarray, x: np.ndarray, scatter: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Iterated outlier and level-shift tests; True for readings of spikes."""
    n = len(x)
    flagged = np.zeros(n, bool)
    tested = np.zeros(n, bool)
    level = np.zeros(n)
    live = np.flatnonzero(scatter[seg] > 0)
    while len(live):
        y, g = x[live], seg[live]
        s = scatter[g]
        same = g[1:] == g[:-1]
        _, gi = np.unique(g, return_inverse=True)
        adj = y - level[live]
        adj = adj - segment_medians(gi, adj, gi[-1] + 1)[gi]
        e = np.zeros(len(y))
        e[1:][same] = (adj[1:] - phi[g[1:]] * adj[:-1])[same]
        jump = np.zeros(len(y), bool)
        jump[1:] = same & (np.abs(np.diff(y)) > SPIKE * s[1:])
        cand = np.flatnonzero(((np.abs(e) > SCREEN * s) | jump) & ~tested[live])
        if not len(cand):
            break
        size = np.zeros(len(cand), np.int64)
        for length in range(1, LONGEST + 1):
            todo = np.flatnonzero(size == 0)
            p = cand[todo]
            inside = p + length < len(y)
            todo, p = todo[inside], p[inside]
            ok = (g[p - 1] == g[p]) & (g[p + length] == g[p])
            for k in range(length):
                ok &= np.abs(y[p + k] - y[p - 1]) > SPIKE * s[p]
                ok &= np.abs(y[p + k] - y[p + length]) > SPIKE * s[p]
            size[todo[ok]] = length
        out = cand[size > 0]
        length = size[size > 0]
        near = out[:, None] + np.arange(-5, 6)
        w = np.where((near >= 0) & (near < len(y)), y[np.clip(near, 0, len(y) - 1)], np.nan)
        w = np.where(g[np.clip(near, 0, len(y) - 1)] == g[out][:, None], w, np.nan)
        away = np.abs(y[out] - np.nanmedian(w, axis=1)) / s[out] if len(out) else np.zeros(0)
        taken = np.zeros(len(y) + LONGEST + 1, bool)
        for i in np.lexsort((out, -away)):
            p, q = out[i], out[i] + length[i]
            if not (taken[p - 1] or taken[q] or taken[p:q].any()):
                taken[p:q] = True
        taken = taken[: len(y)]
        shift = cand[size == 0]
        tested[live[shift]] = True
        moved = _level_shifts(shift, y, g, s, level, live)
        flagged[live[taken]] = True
        if not (taken.any() or moved.any()):
            break
        again = np.zeros(len(scatter), bool)
        again[g[taken]] = True
        again[g[shift[moved]]] = True
        live = live[again[g] & ~taken]
    return flagged


def _level_shifts(p: np.ndarray, y: np.ndarray, g: np.ndarray, s: np.ndarray, level: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Candidates whose next four readings stay away from the four before them move the level from there on."""
    moved = np.zeros(len(p), bool)
    if not len(p):
        return moved
    after = p[:, None] + np.arange(4)
    before = p[:, None] - 1 - np.arange(4)

    def window(at: np.ndarray) -> np.ndarray:
        c = np.clip(at, 0, len(y) - 1)
        return np.where((at >= 0) & (at < len(y)) & (g[c] == g[p][:, None]), y[c], np.nan)

    a, b = window(after), window(before)
    full = ~np.isnan(a).any(1) & ~np.isnan(b).all(1)
    with np.errstate(all="ignore"):
        step = np.median(a, axis=1) - np.where(np.isnan(b).all(1), np.nan, _nanmedian(b))
    moved = full & (np.abs(step) > SCREEN * s[p])
    last = -(10**9)
    for i in np.flatnonzero(moved):
        if p[i] - last < 4 and g[p[i]] == g[max(last, 0)]:
            moved[i] = False
            continue
        last = p[i]
        end = np.searchsorted(g, g[p[i]], side="right")
        level[live[p[i] : end]] += step[i]
    return moved


def _nanmedian(a: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.nan)
    some = ~np.isnan(a).all(1)
    out[some] = np.nanmedian(a[some], axis=1)
    return out


def _tests(seg, x, low, high, n_seg, scatter=None, phi=None):
    """Impossible and spike flags of one field."""
    impossible = (x < low) | (x > high)
    if scatter is None:
        scatter, phi = fit(seg, x, n_seg)
    spike = np.zeros(len(x), bool)
    fair = np.flatnonzero(~impossible)
    spike[fair] = spikes(seg[fair], x[fair], scatter, phi)
    return impossible, spike, scatter


_OUT = "field string, rec_id bigint, impossible boolean, stuck boolean, spike boolean, value double, scatter double"


def _frame(name, ids, x, impossible, stuck, spike, scale):
    hit = np.flatnonzero(impossible | stuck | spike)
    return pd.DataFrame({"field": name, "rec_id": ids[hit], "impossible": impossible[hit], "stuck": stuck[hit], "spike": spike[hit], "value": x[hit], "scatter": scale[hit]})


def _whole(keys: Sequence[str], fields: Sequence[tuple[str, float, float]]):
    """Sorted whole sources of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        del parts
        seg_all = np.cumsum(_starts(len(pdf), [pdf[k].to_numpy() for k in keys])) - 1
        ids = pdf["_id"].to_numpy()
        for i, (name, low, high) in enumerate(fields):
            v = pdf[f"_v{i}"].to_numpy(np.float64, na_value=np.nan)
            has = ~np.isnan(v)
            seg, x = seg_all[has], v[has]
            if not len(x):
                continue
            n_seg = int(seg_all[-1]) + 1
            impossible, spike, scatter = _tests(seg, x, low, high, n_seg)
            least, most = np.full(n_seg, np.inf), np.full(n_seg, -np.inf)
            np.minimum.at(least, seg, x)
            np.maximum.at(most, seg, x)
            stuck = (run_lengths(seg, x) >= STUCK) & (least < most)[seg]
            yield _frame(name, ids[has], x, impossible, stuck, spike, scatter[seg])

    return run


# --- sources cut into chunks -------------------------------------------------------------------------------


def _bins(d: np.ndarray) -> np.ndarray:
    return np.where(d > 0, np.floor(np.log(np.maximum(d, _BIN0) / _BIN0) / _BIN), -1).astype(np.int64)


def _borders(keys: Sequence[str], fields: Sequence[tuple[str, float, float]]):
    """Per chunk one border summary (kind 0) and step histograms of the sources at its borders (kind 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        chunk = int(pdf["_chunk"].iloc[0])
        cols = [pdf[k].to_numpy() for k in keys]
        start = np.flatnonzero(_starts(len(pdf), cols))
        ends = np.append(start[1:], len(pdf))
        ours = [(start[0], ends[0])] + ([(start[-1], ends[-1])] if len(start) > 1 else [])
        summary, hist = [], []
        for a, b in ours:
            key = tuple(int(c[a]) for c in cols)
            per = []
            for i, (_, low, high) in enumerate(fields):
                v = pdf[f"_v{i}"].to_numpy(np.float64, na_value=np.nan)[a:b]
                v = v[~np.isnan(v)]
                fair = v[(v >= low) & (v <= high)]
                change = np.flatnonzero(v[1:] != v[:-1])
                per.append({
                    "n": len(v), "head": fair[:HALO], "tail": fair[-HALO:],
                    "begin": v[:2], "end": v[-2:],
                    "first": v[:1], "lead": int(change[0]) + 1 if len(change) else len(v),
                    "last": v[-1:], "trail": len(v) - 1 - int(change[-1]) if len(change) else len(v),
                })
                for lag in (1, 2):
                    d = np.abs(v[lag:] - v[:-lag])
                    for u, c in zip(*np.unique(_bins(d), return_counts=True), strict=True):
                        hist.append((json.dumps(key), i, lag, int(u), int(c)))
            summary.append((key, per))
        yield pd.DataFrame({"kind": [0], "chunk": [chunk], "src": [""], "fld": [0], "lag": [0], "bin": [0], "n": [0], "body": [pickle.dumps(summary)]})
        if hist:
            h = pd.DataFrame(hist, columns=["src", "fld", "lag", "bin", "n"])
            yield h.assign(kind=1, chunk=chunk, body=None)[["kind", "chunk", "src", "fld", "lag", "bin", "n", "body"]]

    return run


def _scan(borders: list[tuple[int, list]], stats: dict, n_fields: int) -> dict:
    """Carry runs and halo readings over chunk borders, both ways; per chunk, source and field."""
    context: dict = {}
    for forward in (True, False):
        carry_key, carry = None, None
        for chunk, summary in borders if forward else reversed(borders):
            order = summary if forward else summary[::-1]
            for key, per in order:
                if key != carry_key:
                    carry_key, carry = key, [{"halo": np.zeros(0), "value": None, "run": 0, "other": False} for _ in range(n_fields)]
                for i, p in enumerate(per):
                    c = carry[i]
                    at = context.setdefault((chunk, key, i), {"stats": stats.get((key, i), (0.0, 0.0))})
                    at["left" if forward else "right"] = dict(c)
                    if not p["n"]:
                        continue
                    near, far = ("first", "last") if forward else ("last", "first")
                    n_near, n_far = ("lead", "trail") if forward else ("trail", "lead")
                    whole = p[n_far] == p["n"]
                    joined = c["value"] is not None and c["value"] == p[near][0]
                    other = c["other"] or not whole or (c["value"] is not None and not joined)
                    run = p[n_far] + (c["run"] if whole and joined else 0)
                    halo = np.concatenate([c["halo"], p["tail"]])[-HALO:] if forward else np.concatenate([p["head"], c["halo"]])[:HALO]
                    carry[i] = {"halo": halo, "value": p[far][0], "run": run, "other": other}
    return context


def _chunk(keys: Sequence[str], fields: Sequence[tuple[str, float, float]]):
    """A chunk with the carried states of its border sources, which come in a row of their own."""

    def run(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, "_t", "_id"], kind="stable", ignore_index=True)
        chunk, context, out = int(pdf["_chunk"].iloc[0]), pickle.loads(states["body"].iloc[0]), []  # noqa: S301
        cols = [pdf[k].to_numpy() for k in keys]
        new = _starts(len(pdf), cols)
        seg_all = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        ids = pdf["_id"].to_numpy()
        n_seg = len(start)
        for i, (name, low, high) in enumerate(fields):
            v = pdf[f"_v{i}"].to_numpy(np.float64, na_value=np.nan)
            has = ~np.isnan(v)
            seg, x, rec = seg_all[has], v[has], ids[has]
            lengths = run_lengths(seg, x)
            least, most = np.full(n_seg, np.inf), np.full(n_seg, -np.inf)
            np.minimum.at(least, seg, x)
            np.maximum.at(most, seg, x)
            other = least < most
            scatter, phi = fit(seg, x, n_seg)
            head, tail = np.zeros(0), np.zeros(0)
            for j in {0, n_seg - 1}:
                key = tuple(int(c[start[j]]) for c in cols)
                at = context[(chunk, key, i)]
                scatter[j], phi[j] = at["stats"]
                mine = np.flatnonzero(seg == j)
                for side, edge in (("left", mine[:1]), ("right", mine[-1:])):
                    c = at[side]
                    if c["value"] is None:
                        continue
                    other[j] |= c["other"] or (len(edge) > 0 and c["value"] != x[edge[0]])
                    if len(edge) and c["value"] == x[edge[0]]:
                        alike = mine[x[mine] == x[edge[0]]]
                        step = np.flatnonzero(np.diff(alike) > 1)
                        run_ = (alike[: step[0] + 1] if len(step) else alike) if side == "left" else (alike[step[-1] + 1 :] if len(step) else alike)
                        lengths[run_] += c["run"]
                if j == 0:
                    head = at["left"]["halo"]
                if j == n_seg - 1:
                    tail = at["right"]["halo"]
            impossible = (x < low) | (x > high)
            spike = np.zeros(len(x), bool)
            fair = np.flatnonzero(~impossible)
            gx = np.concatenate([head, x[fair], tail])
            gs = np.concatenate([np.zeros(len(head), np.int64), seg[fair], np.full(len(tail), n_seg - 1)])
            found = spikes(gs, gx, scatter, phi)
            spike[fair] = found[len(head) : len(head) + len(fair)]
            stuck = (lengths >= STUCK) & other[seg]
            out.append(_frame(name, rec, x, impossible, stuck, spike, scatter[seg]))
        return pd.concat(out)

    return run


def _across(borders: list[tuple[int, list]], n_fields: int) -> list[tuple]:
    """Steps from one chunk of a source to the next, as (src, fld, lag, bin, value, 1)."""
    out, key_, tail = [], None, []
    for _, summary in borders:
        for key, per in summary:
            if key != key_:
                key_, tail = key, [np.zeros(0)] * n_fields
            for i, p in enumerate(per):
                row, k = np.concatenate([tail[i], p["begin"]]), len(tail[i])
                for lag in (1, 2):
                    d = np.array([abs(row[j] - row[j - lag]) for j in range(max(k, lag), len(row)) if j - lag < k])
                    out += [(json.dumps(key), i, lag, int(u), float(x), 1) for u, x in zip(_bins(d), d, strict=True)]
                tail[i] = np.concatenate([tail[i], p["end"]])[-2:] if p["n"] < 2 else p["end"]
    return out


def _steps_in(keys: Sequence[str], n_fields: int, wanted: set):
    """Counts by value of a chunk's steps in the wanted (src, fld, lag, bin)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        cols = [pdf[k].to_numpy() for k in keys]
        start = np.flatnonzero(_starts(len(pdf), cols))
        ends = np.append(start[1:], len(pdf))
        for a, b in {(start[0], ends[0]), (start[-1], ends[-1])}:
            src = json.dumps(tuple(int(c[a]) for c in cols))
            for i in range(n_fields):
                v = pdf[f"_v{i}"].to_numpy(np.float64, na_value=np.nan)[a:b]
                v = v[~np.isnan(v)]
                for lag in (1, 2):
                    d = np.abs(v[lag:] - v[:-lag])
                    bins = _bins(d)
                    for u in {w[3] for w in wanted if w[:3] == (src, i, lag)}:
                        x, c = np.unique(d[bins == u], return_counts=True)
                        yield pd.DataFrame({"src": src, "fld": i, "lag": lag, "bin": u, "value": x, "n": c})

    return run


def _merged_stats(hist: DataFrame, chunks: DataFrame, keys: Sequence[str], borders: list[tuple[int, list]], n_fields: int) -> dict:
    """Scatter and coefficient of the cut sources (one row per source and field): their merged histograms name the
    bins of the medians, the steps in these bins, counted by value, the medians."""
    from pyspark.sql import Window

    spark = hist.sparkSession
    steps = "src string, fld int, lag int, bin bigint, value double, n bigint"
    across = spark.createDataFrame(_across(borders, n_fields), steps)
    # The chunks' histograms are summed by bin first; what the windows order is at most about 1,700 bins a group.
    h = hist.select("src", "fld", "lag", "bin", "n").unionByName(across.select("src", "fld", "lag", "bin", "n"))
    h = h.groupBy("src", "fld", "lag", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("src", "fld", "lag")
    ranks: list[tuple] = []
    for moving in (False, True):
        c = (h.where("bin >= 0") if moving else h).withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
        c = c.withColumn("r", F.explode(F.array(F.expr("(all - 1) div 2"), F.expr("all div 2")))).where("cum - n <= r AND r < cum")
        ranks += [(r["src"], r["fld"], r["lag"], r["bin"], r["r"] - (r["cum"] - r["n"]), moving) for r in c.collect()]
    if not ranks:
        return {}
    inside = chunks.mapInPandas(_steps_in(keys, n_fields, {r[:4] for r in ranks}), steps).unionByName(across)
    inside = inside.groupBy("src", "fld", "lag", "bin", "value").agg(F.sum("n").alias("n"))
    inside = inside.withColumn("cum", F.sum("n").over(Window.partitionBy("src", "fld", "lag", "bin").orderBy("value")))
    at = spark.createDataFrame(ranks, "src string, fld int, lag int, bin bigint, r bigint, moving boolean")
    found: dict = {}
    for r in at.join(inside, ["src", "fld", "lag", "bin"]).where("cum - n <= r AND r < cum").collect():
        found.setdefault((r["src"], r["fld"], r["lag"], r["moving"]), []).append(r["value"])
    median = {k: sum(v) / len(v) for k, v in found.items()}
    out: dict = {}
    for src, fld, lag, moving in median:
        if lag == 1 and not moving:
            one = median[(src, fld, 1, False)] or median.get((src, fld, 1, True), 0.0)
            two = median.get((src, fld, 2, False), 0.0)
            out[(tuple(json.loads(src)), fld)] = (one, float(_coefficient(np.array([one]), np.array([two]))[0]) if one else 0.0)
    return out


def implausible_readings(
    df: DataFrame,
    keys: Sequence[str],
    time: Column,
    row_id: str,
    fields: Sequence[Field],
    max_group_rows: int = MAX_GROUP_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Flagged readings of ``df``: field, rec_id, impossible, stuck, spike, value, scatter of the source.

    ``keys`` (integers) name a source, ``time`` is its order (NULL: missing), ``row_id`` breaks ties.
    """
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    bare = df.select(
        *[F.col(k).cast("bigint").alias(a) for k, a in named.items()],
        time.alias("_t"),
        F.col(row_id).cast("bigint").alias("_id"),
        *[f.value.cast("double").alias(f"_v{i}") for i, f in enumerate(fields)],
    )
    cols = list(named.values())
    bare = bare.dropna(subset=[*cols, "_t", "_id"]).where(F.coalesce(*[F.col(f"_v{i}") for i in range(len(fields))]).isNotNull())
    limits = [(f.name, f.low, f.high) for f in fields]
    split = split_hot(bare, cols, max_group_rows)
    found = by_group(split, cols, ["_t", "_id"]).mapInPandas(_whole(cols, limits), _OUT)
    if split.hot is None:
        return found
    n_rows = max(chunk_rows, -(-split.hot_rows // MAX_CHUNKS))
    chunks = range_chunks(split.hot, split.hot_rows, cols, ["_t", "_id"], n_rows)
    told = chunks.mapInPandas(_borders(cols, limits), "kind int, chunk int, src string, fld int, lag int, bin bigint, n bigint, body binary").persist()
    borders = sorted((r["chunk"], pickle.loads(r["body"])) for r in told.where("kind = 0").select("chunk", "body").collect())  # noqa: S301
    stats = _merged_stats(told.where("kind = 1"), chunks, cols, borders, len(fields))
    told.unpersist()
    states: dict[int, dict] = {c: {} for c, _ in borders}
    for at, state in _scan(borders, stats, len(fields)).items():
        states[at[0]][at] = state
    states_ = df.sparkSession.createDataFrame([(c, bytearray(pickle.dumps(s))) for c, s in states.items()], "chunk int, body binary")
    # Each chunk meets its own row only.
    return found.unionByName(chunks.groupBy("_chunk").cogroup(states_.groupBy("chunk")).applyInPandas(_chunk(cols, limits), _OUT))
