"""Whitening of embeddings by their leading principal components.

The components come from Chebyshev-filtered subspace iteration (Zhou, Saad, Tiago and Chelikowsky,
2006). The covariance itself is never made: a pass over the vectors multiplies it with a block of a few
columns, each task adding up its centred rows' share. Within a round a Chebyshev polynomial of the
covariance, small on the unwanted part of the spectrum and steep above it, is applied to the block by
its three-term recurrence, a pass per degree. QR and Rayleigh-Ritz then turn the block into approximate
eigenvectors. Every block also holds fresh random columns: an eigenvector that all others had missed
would come up there. The lower end of the spectrum comes from a Lanczos vector that rides along.

The iteration ends when the wanted residuals are down to rounding and the round's random columns brought
nothing new. Residual and eigenvalue gaps then bound the error of the vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_blend.llm.common import stage

#: What turns an entry into a whole number.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this are taken as this, so that sums of whole numbers can be held.
MOST = 1 << 60


@dataclass(frozen=True)
class Settings:
    """``guard`` more vectors than wanted are kept, which sets the end of the unwanted spectrum;
    ``fresh`` random columns join each round."""

    components: int = 16
    guard: int = 16
    fresh: int = 4
    most_degree: int = 16
    lanczos: int = 32
    most_rounds: int = 60
    tolerance: float = 1e-15
    good: float = 1e-12
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Components (columns, of length one) by falling variance, and the whole numbers behind them."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float
    rounds: int
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, size, x``: the entries as whole numbers, of rows whose vector has no null or non-finite ones."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vec.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("v").isNotNull()).where(finite).where(F.size("v") > 0)
    whole = F.transform("v", lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(SCALE * c))) + SHIFT)
    return rows.select("id", F.size("v").alias("size"), whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _pass(fit: DataFrame, mean: np.ndarray, product, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all vectors of what ``product`` makes of centred rows, a matrix of ``shape``.

    Each task adds up its own rows; the sums meet in an aggregation by the matrix's rows, so only the
    finished matrix, whose size the data's width sets, comes to the driver.
    """
    height, width = shape

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            rows = _matrix(batch.column("x"))
            for at in range(0, len(rows), 4096):
                total += product(rows[at : at + 4096] - mean)
        columns = [pa.array(np.arange(height, dtype=np.int32)), *(pa.array(total[:, j]) for j in range(width))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", *(f"c{j}" for j in range(width))])

    names = [f"c{j}" for j in range(width)]
    parts = fit.select("x").mapInArrow(run, ", ".join(["i int", *(f"{c} double" for c in names)]))
    found = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    result = np.zeros(shape)
    result[np.asarray(found.column("i"))] = np.column_stack([np.asarray(found.column(c)) for c in names])
    return result


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: the number of vectors, and their sum."""

    def run(batches):
        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            size = np.asarray(batch.column("size"))
            for d in np.unique(size).tolist():
                rows = _matrix(batch.column("x").filter(pa.array(size == d)))
                n, old = total.get(d, (0, [0] * d))
                high, low = (rows >> 32).sum(axis=0).tolist(), (rows & 0xFFFFFFFF).sum(axis=0).tolist()
                total[d] = n + len(rows), [o + (h << 32) + w for o, h, w in zip(old, high, low, strict=True)]
        for d, (n, sums) in total.items():
            digits = pa.array([str(s) for s in sums])
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), digits],
                names=["size", "i", "n", "s"],
            )

    parts = fit.mapInArrow(run, "size int, i int, n bigint, s string")
    added = parts.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, tuple[int, dict[int, int]]] = {}
    for r in added.collect():  # as many rows as a vector has entries
        found.setdefault(r["size"], (r["n"], {}))[1][r["i"]] = int(r["s"])
    return {d: (n, [sums[i] for i in range(d)]) for d, (n, sums) in found.items()}


def _growth(x: float, low: float, high: float) -> float:
    """How fast Chebyshev polynomials grow per degree at ``x``, above the interval."""
    t = max(1.0, (2 * x - low - high) / max(high - low, 1e-300))
    return t + np.sqrt(t * t - 1)


def principal(fit: DataFrame, n: int, sums: list[int], settings: Settings = Settings()) -> Model:
    """The leading components of ``fit (x)``, a written table of distinct vectors of one length."""
    d, s = len(sums), settings
    mean = np.array([total / n for total in sums])
    wanted = min(s.components, d)
    keep = min(d, wanted + s.guard)
    width = min(d, keep + s.fresh)
    rng = np.random.default_rng(s.seed)
    passes, trace = 0, 0.0

    def times(block: np.ndarray) -> np.ndarray:
        """The covariance times the block; the trace comes with the first of these passes."""
        nonlocal passes, trace
        first = passes == 0

        def product(rows):
            share = rows.T @ (rows @ block)
            return np.vstack([share, np.full((1, block.shape[1]), (rows * rows).sum())]) if first else share

        found = _pass(fit, mean, product, (d + first, block.shape[1])) / n
        passes += 1
        if first:
            trace = float(found[-1, 0])
        return found[:d]

    block = np.linalg.qr(rng.standard_normal((d, width)))[0]
    lanczos = [_unit(rng.standard_normal(d))]
    alphas, betas = [], []

    def with_rider(now: np.ndarray) -> np.ndarray:
        """The covariance times ``now``, and one more Lanczos step in the same pass."""
        if len(alphas) == s.lanczos or not lanczos[-1].any():
            return times(now)
        found = times(np.column_stack([now, lanczos[-1]]))
        image, own = found[:, -1], np.column_stack(lanczos)
        alphas.append(float(lanczos[-1] @ image))
        for _ in range(2):
            image = image - own @ (own.T @ image)
        betas.append(float(np.linalg.norm(image)))
        # where nothing is left the vectors so far span all there is to know
        lanczos.append(_unit(image) if betas[-1] > 1e-10 * trace else np.zeros(d))
        return found[:, :-1]

    def lowest() -> float:
        """A number that the spectrum all but surely stays above."""
        k = len(alphas)
        t = np.diag(alphas) + np.diag(betas[: k - 1], 1) + np.diag(betas[: k - 1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, float(values[0] - abs(betas[-1] * vectors[-1, 0])))

    last = np.full(width, np.inf)
    old = None
    for rounds in range(1, s.most_rounds + 1):
        image = with_rider(block)
        values, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        scale = max(float(values[0]), 1e-300)
        residual = np.linalg.norm(image - block * values, axis=0) / scale
        done = (residual <= s.tolerance * np.sqrt(d)) | ((residual <= s.good) & (residual > last / 4))
        new = np.inf if old is None else float(np.abs(values[:wanted] - old).max()) / scale
        if width == d or scale <= 1e-300 or (done[:wanted].all() and new <= 1e-9):
            return Model(n, sums, block[:, :wanted], values[:wanted], trace, rounds, passes)
        last, old = residual, values[:wanted]
        # What is settled is not filtered any more, as its growth would drown the others.
        settled = int(np.argmin(np.r_[done[:wanted], False]))
        settled = min(settled, wanted - 1)
        top, high = float(values[settled]), max(float(values[keep - 1]), 1e-12 * scale)
        low = min(lowest(), high * (1 - 1e-6))
        steep, least = _growth(top, low, high), _growth(float(values[wanted - 1]), low, high)
        # columns that grow too unlike could not be told apart by QR
        degree = int(np.clip(np.log(1e8) / max(np.log(steep / least), 1e-9), 2, s.most_degree))
        locked = block[:, :settled]
        fresh = rng.standard_normal((d, width - keep))
        now = _normed(_apart(np.column_stack([block[:, settled:keep], fresh]), block[:, :keep], keep - settled))
        now = _filtered(now, locked, with_rider, degree, low, high, top)
        block = np.linalg.qr(np.column_stack([locked, now]))[0]
    raise RuntimeError(f"components were not found in {s.most_rounds} rounds; residual {last[:wanted].max()}")


def _filtered(now, locked, times, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of the covariance, times ``now``: at most 1 between ``low`` and ``high``
    and scaled to 1 at ``top``. Nothing of the locked vectors gets in."""
    centre, half = (high + low) / 2, (high - low) / 2
    first = half / max(top - centre, half)
    sigma, before = first, None
    for step in range(degree):
        image = times(now) - centre * now
        image -= locked @ (locked.T @ image)
        if step == 0:
            before, now = now, image * (sigma / half)
        else:
            after = 1 / (2 / first - sigma)
            before, now = now, image * (2 * after / half) - sigma * after * before
            sigma = after
    return now


def _apart(block: np.ndarray, known: np.ndarray, first: int) -> np.ndarray:
    """The block with its columns from ``first`` on at right angles to ``known``."""
    new = block[:, first:]
    for _ in range(2):
        new = new - known @ (known.T @ new)
    return np.column_stack([block[:, :first], new])


def _normed(block: np.ndarray) -> np.ndarray:
    return block / np.linalg.norm(block, axis=0)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v)


def _kept(model: Model) -> Model:
    """Without components that have no variance but rounding, which nothing can be divided by."""
    found = model.variances > 1e-13 * len(model.sums) * max(model.trace, 1e-300)
    return Model(model.n, model.sums, model.vectors[:, found], model.variances[found], model.trace, model.rounds, model.passes)


def identity_error(fit: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    turn = model.vectors / np.sqrt(model.variances)
    k = turn.shape[1]
    middle = _pass(fit, model.mean, lambda rows: (rows @ turn).sum(axis=0, keepdims=True), (1, k)) / model.n

    def product(rows):
        white = rows @ turn - middle
        return white.T @ white

    return float(np.abs(_pass(fit, model.mean, product, (k, k)) / model.n - np.eye(k)).max())


OUT = (
    "id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
    "variance double, identity_error double"
)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, variance, identity_error`` of every usable row.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped. Equal vectors
    count once in the fit, and every row is whitened, repeated ones too. Vectors of another length are
    whitened among themselves. A vector has as many components as it has entries, 16 at most; those
    without variance (constant entries, fewer distinct vectors than components) have no rows.
    ``deviation`` is exact; where it needs more than 38 digits it is null. No rows give none; a null id
    stays null; other columns are not looked at.
    """
    rows = stage(whole_vectors(df, id_col, vec_col), "vectors")
    fit = stage(rows.select("size", "x").distinct(), "fit-list")
    models = {}
    for d, (n, sums) in sorted(_sums(fit).items()):
        own = fit.where(F.col("size") == d)
        model = _kept(principal(own, n, sums, settings))
        if len(model.variances):
            models[d] = model, identity_error(own, model)
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            size = np.asarray(batch.column("size"))
            for d in np.unique(size).tolist():
                if d in shared.value:
                    own = batch.filter(pa.array(size == d))
                    for at in range(0, own.num_rows, 4096):
                        yield _whitened(own.slice(at, 4096), *shared.value[d])

    return rows.mapInArrow(run, OUT)


def _whitened(part: pa.RecordBatch, model: Model, error: float) -> pa.RecordBatch:
    x = _matrix(part.column("x"))
    k, rows = len(model.variances), len(x)
    white = (x - model.mean) @ (model.vectors / np.sqrt(model.variances))
    each = np.repeat(np.arange(rows), k)
    columns = [
        part.column("id").take(pa.array(each)),
        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
        pa.array(np.full(rows * k, model.n)),
        pa.array(deviations(x, model.n, model.sums), pa.decimal128(38, 0)).take(pa.array(each)),
        pa.array(white.ravel()),
        pa.array(np.tile(model.variances / model.trace, rows)),
        pa.array(np.tile(model.variances, rows)),
        pa.array(np.full(rows * k, error)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over entries of ``(n * x - sums) ** 2``, exactly."""
    most = max(n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))), max(map(abs, sums)))
    if 2 * most < 1 << 63:
        apart = x * n - np.array(sums, np.int64)
        furthest = max(abs(int(apart.max(initial=0))), abs(int(apart.min(initial=0))))
        if furthest**2 * len(sums) < 1 << 63:
            return (apart * apart).sum(axis=1).tolist()
        # two halves of each difference, so that no sum of products leaves 63 bits
        if furthest < 1 << 50 and len(sums) < 1 << 12:
            high, low = apart >> 30, apart & (1 << 30) - 1
            square = low * low
            sums_of = (high * high, high * low, square >> 30, square & (1 << 30) - 1)
            parts = zip(*(p.sum(axis=1).tolist() for p in sums_of), strict=True)
            return [_fits((a << 60) + (b << 31) + (c << 30) + e) for a, b, c, e in parts]
    exact = ([n * a - b for a, b in zip(row, sums, strict=True)] for row in x.tolist())
    return [_fits(sum(a * a for a in row)) for row in exact]


def _fits(number: int) -> int | None:
    return number if number < 10**38 else None
