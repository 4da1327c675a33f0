"""Imputation of the long matrix; everything is fitted on training cells only."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.operators.design import feature_arrays
from cpgloom.operators.gram import MAX_FEATURES, centred, fold_grams
from cpgloom.operators.ordering import exact_quantiles
from cpgloom.operators.probe_stats import PROBE
from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

# Upper size of one block of feature rows inside a task.
BLOCK_BYTES = 64 * 1024 * 1024
# Receivers and donors whose distances are held at a time, and pairs that are measured exactly at a time.
TILE, PAIRS = (512, 4096), 1 << 12
METHODS = ["zero", "mean", "median", "knn", "mice"]


def probe_fills(train: DataFrame, method: str, empty: float | None = None, value: str = "beta") -> DataFrame:
    """``(probe_ord, fill)`` from training cells.

    A probe without any training value gets ``empty``; with ``empty=None`` it keeps a null fill
    and :func:`apply_fills` drops it.
    """
    if method == "zero":
        return train.select(PROBE).distinct().withColumn("fill", F.lit(0.0))
    if method == "mean":
        fills = train.groupBy(PROBE).agg(F.avg(value).alias("fill"))
    elif method == "median":
        every = train.select(PROBE).distinct()
        fills = every.join(exact_quantiles(train, [PROBE], value, [0.5], ["fill"]), PROBE, "left")
    else:
        raise ValueError(f"no per-probe fill called {method!r}")
    return fills if empty is None else fills.withColumn("fill", F.coalesce("fill", F.lit(float(empty))))


def apply_fills(cells: DataFrame, fills: DataFrame, value: str = "beta") -> DataFrame:
    """Observed cells stay as they are; missing ones take the fill, marked by ``imputed``."""
    return (
        cells.join(sized(fills.where("fill is not null")), PROBE)
        .withColumn("imputed", F.col(value).isNull())
        .withColumn(value, F.coalesce(value, "fill"))
        .drop("fill")
    )


def array_positions(cells: DataFrame) -> DataFrame:
    """``(idx, probe_ord)``: places of the probes in the per-sample arrays, one list of array width."""
    listed = cells.select(PROBE).distinct().agg(F.sort_array(F.collect_list(PROBE)).alias("p"))
    return listed.select(F.posexplode("p").alias("idx", PROBE))


# --- nearest neighbours -----------------------------------------------------------------------


def _block_pairs(receivers: DataFrame, donors: DataFrame, block: int | None) -> tuple[DataFrame, DataFrame]:
    """Cut both sides into hash blocks and send every block to each block of the other side.

    Only whole blocks meet in a task and only the best few donors per receiver leave it, so
    neither the pair list nor one side has to fit anywhere.  Blocks are as large as a task may hold, so that a row
    is copied to few of them; ``block`` limits their rows further.
    """
    # Counted, measured and then copied to the blocks: build the arrays once.
    receivers, donors = materialize(receivers, "receivers"), materialize(donors, "donors")
    width, n_donors = donors.agg(F.max(F.size("features")), F.count("*")).first()
    most = max(16, BLOCK_BYTES // (8 * (width or 1)))
    most = most if block is None else max(16, min(block, most))
    # Large blocks keep the copies few; small inputs are still cut enough to use every core.
    least = math.ceil(math.sqrt(2 * donors.sparkSession.sparkContext.defaultParallelism))
    nr, nd = (max(1, math.ceil(n / min(most, max(16, math.ceil(n / least))))) for n in (receivers.count(), n_donors))
    key = F.xxhash64("sample_id")
    all_r = F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))
    all_d = F.explode(F.sequence(F.lit(0), F.lit(nd - 1)))
    r = receivers.withColumn("_rb", F.pmod(key, F.lit(nr)).cast("int")).withColumn("_db", all_d)
    d = donors.withColumn("_db", F.pmod(key, F.lit(nd)).cast("int")).withColumn("_rb", all_r)
    # A fixed number, so that a few small blocks are not put into one task.
    spread = min(4 * nr * nd, 4000)
    return r.repartition(spread, "_rb", "_db"), d.repartition(spread, "_rb", "_db")


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array([np.asarray(v, dtype="float64") for v in pdf["features"]])


class _Parts:
    """Rows with gaps as the factors of their products: marks, squares and values side by side, in one number type."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, kind: str):
        there = ~np.isnan(x)
        self.whole, self.width = bool(there.all()), x.shape[1]
        self.stack = np.empty((len(x), 3 * self.width), kind)
        self.marks[:] = there
        self.x[:] = np.where(there, x - centre, 0.0)
        np.multiply(self.x, self.x, out=self.squares)
        self.norm = self.squares.sum(1)

    @property
    def marks(self) -> np.ndarray:
        return self.stack[:, : self.width]

    @property
    def squares(self) -> np.ndarray:
        return self.stack[:, self.width : 2 * self.width]

    @property
    def x(self) -> np.ndarray:
        return self.stack[:, 2 * self.width :]

    def cut(self, at: slice) -> _Parts:
        part = object.__new__(_Parts)
        part.whole, part.width, part.stack, part.norm = self.whole, self.width, self.stack[at], self.norm[at]
        return part


def _about(a: _Parts, b: _Parts) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances scaled up to the full width, up to rounding (inf without a shared coordinate), and their error by receiver."""
    width = a.x.shape[1]
    if a.whole and b.whole:
        far = a.x @ b.x.T
        far *= -2
        far += a.norm[:, None]
        far += b.norm
        shared = width
    else:
        far = np.hstack([a.squares, a.marks, -2 * a.x]) @ b.stack.T
        shared = a.marks @ b.marks.T
        with np.errstate(invalid="ignore", divide="ignore"):
            far *= width / shared
        far[shared == 0] = np.inf
    error = 32 * np.finfo(far.dtype).eps * width * (a.norm.astype("float64") + float(b.norm.max(initial=0.0)))
    return far, error


def _within(a: _Parts, b: _Parts, edge: np.ndarray) -> np.ndarray:
    """Pairs whose squared distance, scaled up to the full width, may be within the receiver's ``edge``; from one product.

    A sum over the shared coordinates is within the edge if it does not exceed ``edge / width`` for each of them, which enters
    the product as part of the receiver's squares; what rounding may add is allowed for.
    """
    kind = a.stack.dtype
    if a.whole and b.whole:
        ones = [np.ones((len(p.norm), 1), kind) for p in (a, b)]
        over = np.hstack([-2 * a.x, ones[0], (a.norm - edge)[:, None].astype(kind)]) @ np.hstack([b.x, b.norm[:, None], ones[1]]).T
    else:
        share = (edge / a.width)[:, None].astype(kind)
        over = np.hstack([a.squares - share * a.marks, a.marks, -2 * a.x]) @ b.stack.T
    slack = 32 * np.finfo(kind).eps * a.width * (a.norm.astype("float64") + float(b.norm.max(initial=0.0)) + edge)
    return over <= slack[:, None].astype(kind)


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs over shared coordinates, scaled up to the full width; NaN without any."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        gap = a[i[at : at + PAIRS]] - b[j[at : at + PAIRS]]
        missing = np.isnan(gap)
        shared = a.shape[1] - missing.sum(1)
        gap[missing] = 0.0
        gap *= gap
        with np.errstate(invalid="ignore", divide="ignore"):
            out[at : at + PAIRS] = np.sqrt(gap.sum(1) * a.shape[1] / shared)
        out[at : at + PAIRS][shared == 0] = np.nan
    # Rounding far below the data's precision makes equal distances compare equal.
    return np.round(out, 10)


def _near_of_all(kinds: dict, a: np.ndarray, b: np.ndarray, centre: np.ndarray, rows: slice, cols: slice, edge: np.ndarray, k: int, same) -> np.ndarray:
    """Pairs of a tile that may be among the k nearest, from all its distances; for receivers whose edge says little."""
    at, to, n = rows.start, cols.start, rows.stop - rows.start
    kind = "float32"
    while True:
        if kind not in kinds:
            kinds[kind] = tuple(_Parts(x, centre, kind) for x in (a, b))
        far, error = _about(kinds[kind][0].cut(rows), kinds[kind][1].cut(cols))
        if same is not None:
            for i in range(n):
                own = same[at + i]
                far[i, own[(own >= to) & (own < cols.stop)] - to] = np.inf
        wide = far.shape[1] > k
        # No more than k pairs of this tile are nearer than its k-th.
        bound = np.minimum(edge, np.partition(far, k - 1, axis=1)[:, k - 1] + error if wide and not np.isfinite(edge).all() else np.inf)
        near = (far <= (bound + error)[:, None].astype(far.dtype) * far.dtype.type(1 + 1e-6)) & (far < np.inf)
        if near.sum() <= 16 * k * n or kind == "float64" or not wide:
            return near
        kind = "float64"  # values so large, or so alike, that single precision does not tell them apart


def _nearest(a: np.ndarray, b: np.ndarray, k: int, same: Sequence[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of ``b``, by row of ``a``, nearest first, ties to the earlier row.

    Products in single precision rule most pairs out; what may be among the k is measured from the differences.
    ``same``: rows of ``b`` that do not count, by row of ``a``.
    """
    found, (step_a, step_b) = [], TILE
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        centre = np.nan_to_num(np.where(np.isnan(b), 0.0, b).sum(0) / (~np.isnan(b)).sum(0))
    kinds = {kind: (_Parts(a, centre, kind), _Parts(b, centre, kind)) for kind in ("float32",)}
    blank = [~p.marks.any(1) for p in kinds["float32"]]
    for at in range(0, len(a), step_a):
        rows = slice(at, min(at + step_a, len(a)))
        n = rows.stop - at
        edge = np.full(n, np.inf)
        top = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        own = None if same is None else np.concatenate([i * len(b) + same[at + i] for i in range(n)])
        to = 0
        while to < len(b):
            # The first rows only tell how far the others may be; few of many rows seen are nearer, so tiles grow.
            wide = min(max(step_b, to), 4 * step_b) if to else max(1, step_b // 4)
            cols = slice(to, min(to + wide, len(b)))
            near = None
            known = np.isfinite(edge) | blank[0][rows]
            if (~known).sum() * wide <= 8 * k * n:
                near = _within(kinds["float32"][0].cut(rows), kinds["float32"][1].cut(cols), np.where(known & ~blank[0][rows], edge, 0.0))
                near[~known] = True
                near[blank[0][rows]] = False
                if blank[1][cols].any():
                    near[:, blank[1][cols]] = False
            if near is None or np.count_nonzero(near) > 16 * k * n:
                near = _near_of_all(kinds, a, b, centre, rows, cols, edge, k, same)
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            if own is not None and len(i):
                other = ~np.isin(i * len(b) + j + to, own)
                i, j = i[other], j[other]
            start, to = to, cols.stop
            if not len(i):
                continue
            d = _exact(a, b, i + at, j + start)
            here = ~np.isnan(d)
            i, j, d = (np.concatenate([x, y[here]]) for x, y in zip(top, (i, j + start, d), strict=True))
            order = np.lexsort((d, i))  # stable: of equal distances the earlier row stays first
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            kept = place < k
            top = i[kept], j[kept], d[kept]
            last = place == k - 1
            edge[i[last]] = (d[last] + 1e-9) ** 2
        found.append((top[0] + at, top[1], top[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _by_id(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, and the rows in the same order."""
    ids = pdf["sample_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], _matrix(pdf)[order]


def neighbours(receivers: DataFrame, donors: DataFrame, k: int = 5, block: int | None = None) -> DataFrame:
    """The k nearest donors of each receiver (itself excluded) by nan-Euclidean distance.

    Both sides are ``(sample_id, features ARRAY)``.
    """

    def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["sample_id", "donor_id", "distance"])
        rids, (ids, b) = left["sample_id"].to_numpy(), _by_id(right)
        first, last = np.searchsorted(ids, rids, "left"), np.searchsorted(ids, rids, "right")
        i, j, d = _nearest(_matrix(left), b, k, [np.arange(x, y) for x, y in zip(first, last, strict=True)])
        return pd.DataFrame({"sample_id": rids[i], "donor_id": ids[j], "distance": d})

    r, d = _block_pairs(receivers.select("sample_id", "features"), donors.select("sample_id", "features"), block)
    found = (
        r.groupBy("_rb", "_db")
        .cogroup(d.groupBy("_rb", "_db"))
        .applyInPandas(pairs, "sample_id STRING, donor_id STRING, distance DOUBLE")
    )
    # At most k candidates per donor block reach a receiver.
    best = F.slice(F.sort_array(F.collect_list(F.struct("distance", "donor_id"))), 1, k)
    return (
        found.groupBy("sample_id")
        .agg(best.alias("b"))
        .select("sample_id", F.posexplode("b").alias("pos", "d"))
        .select("sample_id", (F.col("pos") + 1).cast("long").alias("rank"), "d.donor_id", "d.distance")
    )


def _donors_of_gaps(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, column, row of b, distance): for every gap of ``a`` the k nearest rows of ``b`` that have the column."""
    gaps, have = np.isnan(a), ~np.isnan(b)
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    share = have.mean(0)
    # Columns that most donors have: their donors are among a receiver's nearest few.
    many = 2 * k + 16
    i, j, d = _nearest(a, b, many) if (gaps & (share >= 0.5)).any() else out[0][1:]
    size = np.bincount(i, minlength=len(a))
    for c in np.flatnonzero(gaps.any(0) & (share > 0)):
        short = gaps[:, c].copy()
        if share[c] >= 0.5:
            use = gaps[i, c] & have[j, c]
            at, donor, far = i[use], j[use], d[use]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            enough = (np.bincount(at, minlength=len(a)) >= k) | (size < many)
            use = (place < k) & enough[at]
            out.append((at[use], np.full(use.sum(), c), donor[use], far[use]))
            short &= ~enough
        if short.any():
            rows, donors = np.flatnonzero(short), np.flatnonzero(have[:, c])
            at, donor, far = _nearest(a[rows], b[donors], k)
            out.append((rows[at], np.full(len(at), c), donors[donor], far))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def knn_fill(cells: DataFrame, train: DataFrame, k: int = 5, block: int | None = None, value: str = "beta") -> DataFrame:
    """Fill each missing cell with the mean of the k nearest training samples that have it.

    Falls back to the probe's training mean when no donor has a usable distance.
    """
    wide_r = feature_arrays(cells.select("sample_id", F.col(PROBE).alias("rank"), value), value)
    wide_d = feature_arrays(train.select("sample_id", F.col(PROBE).alias("rank"), value), value)
    need = wide_r.where(F.exists("features", lambda x: x.isNull()))

    def fill(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["sample_id", "idx", "distance", "donor_id", "value"])
        rids, (ids, b) = left["sample_id"].to_numpy(), _by_id(right)
        i, c, j, d = _donors_of_gaps(_matrix(left), b, k)
        return pd.DataFrame({"sample_id": rids[i], "idx": c, "distance": d, "donor_id": ids[j], "value": b[j, c]})

    r, d = _block_pairs(need, wide_d, block)
    found = (
        r.groupBy("_rb", "_db")
        .cogroup(d.groupBy("_rb", "_db"))
        .applyInPandas(fill, "sample_id STRING, idx INT, distance DOUBLE, donor_id STRING, value DOUBLE")
    )
    best = F.slice(F.sort_array(F.collect_list(F.struct("distance", "donor_id", "value"))), 1, k)
    total = F.aggregate("b", F.lit(0.0), lambda s, x: s + x["value"])
    means = found.groupBy("sample_id", "idx").agg(best.alias("b")).select("sample_id", "idx", (total / F.size("b")).alias("_knn"))
    # Array positions back to probe ordinals: the same ascending order as in the arrays.
    means = means.join(sized(array_positions(cells)), "idx").drop("idx")
    fills = probe_fills(train, "mean", value=value)
    return (
        cells.join(means, ["sample_id", PROBE], "left")
        .join(sized(fills.where("fill is not null")), PROBE)
        .withColumn("imputed", F.col(value).isNull())
        .withColumn(value, F.coalesce(value, "_knn", "fill"))
        .drop("_knn", "fill")
    )


# --- chained equations ------------------------------------------------------------------------


def _evidence_ridge(c: np.ndarray, b: np.ndarray, yy: float, n: float, rounds: int = 30) -> np.ndarray:
    """Ridge weights whose penalty maximises the evidence, from centred cross products."""
    lam, vecs = np.linalg.eigh(c)
    lam = np.maximum(lam, 0.0)
    proj = vecs.T @ b
    noise = max(yy / n, 1e-12)
    prior = 1.0
    w = np.zeros_like(b)
    for _ in range(rounds):
        ratio = prior * noise
        w = proj / (lam + ratio)
        eff = float(np.sum(lam / (lam + ratio)))
        rss = max(yy - 2 * w @ proj + float(np.sum(lam * w * w)), 1e-12)
        new_prior = eff / max(float(w @ w), 1e-12)
        new_noise = rss / max(n - eff, 1.0)
        done = abs(new_prior - prior) <= 1e-4 * prior and abs(new_noise - noise) <= 1e-4 * noise
        prior, noise = new_prior, new_noise
        if done:
            break
    return vecs @ (proj / (lam + prior * noise))


class ChainedImputer:
    """Round-based chained ridge equations.

    A round regresses every incomplete probe on its most correlated probes using one pass of
    cross products over the training rows as filled so far, then all missing cells are predicted
    together.  The fitted state is one small weight matrix per round; rows are refilled on the fly
    from the original values, so neither lineage nor storage grows with the rounds.
    """

    def __init__(self, rounds: int = 5, nearest: int = 50):
        self.rounds, self.nearest = rounds, nearest
        self.means: np.ndarray | None = None
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []

    def filler(self) -> Callable[[np.ndarray], np.ndarray]:
        means, steps = self.means, list(self.steps)

        def fill(x: np.ndarray) -> np.ndarray:
            gaps = np.isnan(x)
            out = np.where(gaps, means, x)
            for w, c in steps:
                out = np.where(gaps, out @ w + c, out)
            return out

        return fill

    def fit(self, train: DataFrame, vec: str = "features") -> ChainedImputer:
        """``train`` holds one array per sample with nulls for missing cells."""
        probe = train.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.count_if(F.col("x").isNull()).alias("gaps"))
        stats = sorted(probe.limit(MAX_FEATURES + 1).collect(), key=lambda r: r["i"])  # one row per selected probe
        if len(stats) > MAX_FEATURES:
            raise ValueError(f"chained equations work on at most {MAX_FEATURES} selected probes; select first")
        self.means = np.array([0.0 if r["m"] is None else r["m"] for r in stats])
        todo = [r["i"] for r in stats if r["gaps"] > 0 and r["m"] is not None]
        width = len(stats)
        self.steps = []
        for _ in range(self.rounds if todo else 0):
            n, mean, c = centred(fold_grams(train, vec, prepare=self.filler())[0])
            sd = np.sqrt(np.maximum(np.diag(c), 1e-300))
            corr = np.abs(c / np.outer(sd, sd))
            np.fill_diagonal(corr, -1.0)
            w, shift = np.eye(width), np.zeros(width)
            for j in todo:
                near = np.argsort(-corr[j], kind="stable")[: min(self.nearest, width - 1)]
                coef = _evidence_ridge(c[np.ix_(near, near)], c[near, j], c[j, j], n)
                w[:, j] = 0.0
                w[near, j] = coef
                shift[j] = mean[j] - mean[near] @ coef
            self.steps.append((w, shift))
        return self

    def transform(self, df: DataFrame, vec: str = "features") -> DataFrame:
        fill = self.filler()
        others = [f for f in df.schema.fields if f.name != vec]
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"`{vec}` ARRAY<DOUBLE>"])
        names = [f.name for f in others]

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    filled = fill(_matrix(pdf.rename(columns={vec: "features"})))
                    yield pdf[names].assign(**{vec: list(filled)})

        return df.select(*names, vec).mapInPandas(run, schema)


def impute(cells: DataFrame, train: DataFrame, method: str = "mean", empty: float | None = None, k: int = 5) -> DataFrame:
    """Imputed long cells by method name; unknown names raise ``ValueError``."""
    if method in ("zero", "mean", "median"):
        return apply_fills(cells, probe_fills(train, method, empty))
    if method == "knn":
        return knn_fill(cells, train, k)
    if method == "mice":
        return mice_fill(cells, train)
    raise ValueError(f"unknown imputation method {method!r}; known: {', '.join(METHODS)}")


def mice_fill(cells: DataFrame, train: DataFrame, rounds: int = 5, nearest: int = 50, value: str = "beta") -> DataFrame:
    """Chained equations over long cells of an already selected set of probes."""
    known = train.groupBy(PROBE).agg(F.count(value).alias("c")).where("c > 0").select(PROBE)
    kept = cells.join(sized(known), PROBE, "left_semi")
    base = train.join(sized(known), PROBE, "left_semi")

    def wide(x):
        return feature_arrays(x.select("sample_id", F.col(PROBE).alias("rank"), value), value)

    model = ChainedImputer(rounds, nearest).fit(wide(base))
    filled = model.transform(wide(kept).withColumn("raw", F.col("features")))
    pairs = F.posexplode(F.arrays_zip("raw", "features")).alias("idx", "z")
    gap = F.col("z.raw").isNull() | F.isnan("z.raw")
    return (
        filled.select("sample_id", pairs)
        .select("sample_id", "idx", F.col("z.features").alias(value), gap.alias("imputed"))
        .join(sized(array_positions(kept)), "idx")
        .drop("idx")
    )
