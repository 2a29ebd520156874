"""K-means with repeated starts, silhouettes, k selection, centroids, assignment."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from vecloom.functions.vector import as_double, constant, squared_distance, unit
from vecloom.operators.relational import top_n_per_group
from vecloom.operators.tiles import distance_sums, matrix_of

# Seed, number of starts and range of k.
SEED = 42
STARTS = 10
K_MIN = 2
K_MAX = 10

MAX_ITER = 300
#: Turns over the table in which candidates for starting centres are drawn.
SEED_TURNS = 4
#: Numbers in a packed matrix of vectors.
PACK_VALUES = 262_144
#: Vectors compared with all centres at a time.
STRIP_ROWS = 1024
_NO_ID = -(2**63)
MAX_CENTRES = 8192
MAX_CENTRE_VALUES = 8_000_000


@dataclass(frozen=True)
class Model:
    """Centres of one fit, its number of clusters, start seed and inertia."""

    k: int
    seed: int
    centres: np.ndarray
    cost: float = np.inf

    def labelled(self) -> list[tuple[int, list[float]]]:
        return [(i, [float(x) for x in c]) for i, c in enumerate(self.centres)]


def _unit_draw(ids: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) per item, from the item, the seed and the turn alone."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + turn * 7919 + 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


_SEED_ROW = "seed int, v array<double>, gap double"


def _seed_pass(
    vectors: DataFrame, found: Mapping[int, np.ndarray], turn: int, take
) -> dict[int, tuple[float, np.ndarray | None]]:
    """One scan for all seeds, all partitions at once: per seed the sum of the gaps and the vectors taken.

    ``take(seed, gaps, draws)`` picks rows of a batch; ``gaps`` are squared distances to the
    candidates found so far. Spark adds up the tasks' sums, one row a seed; the rows taken
    are a few times k.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(dict(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {"seed": [], "v": [], "gap": []}
        total = dict.fromkeys(shared.value, 0.0)
        for batch in batches:
            for packed, matrix in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(packed.as_buffer(), np.int64)
                x = np.frombuffer(matrix.as_buffer(), np.float64).reshape(len(ids), -1)
                for seed, centres in shared.value.items():
                    gap = _gaps(x, centres)
                    total[seed] += gap.sum()
                    for i in np.flatnonzero(take(seed, gap, _unit_draw(ids, seed, turn))):
                        rows["seed"].append(seed)
                        rows["v"].append(x[i].tolist())
                        rows["gap"].append(None)
        for seed, value in total.items():
            rows["seed"].append(seed)
            rows["v"].append(None)
            rows["gap"].append(value)
        types = (pa.int32(), pa.list_(pa.float64()), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(rows.values(), types, strict=True)], list(rows)
        )

    table = (
        vectors.select("item_id", "v")
        .mapInArrow(run, _SEED_ROW)
        .groupBy("seed")
        .agg(F.sum("gap").alias("gap"), F.collect_list("v").alias("v"))
        .toArrow()
    )
    shared.destroy()
    taken = [np.array(v, dtype=np.float64) if v else None for v in table.column("v").to_pylist()]
    sums = dict(zip(table.column("seed").to_pylist(), zip(table.column("gap").to_pylist(), taken, strict=True)))
    return {seed: sums.get(seed, (0.0, None)) for seed in found}


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gap = np.full(len(x), np.inf)
    for start in range(0, len(centres), 512):
        gap = np.minimum(gap, _squared_by_product(x, centres[start : start + 512]).min(axis=1))
    # Copies of a centre are at no distance from it, whatever the product rounds to.
    scale = (x**2).sum(axis=1)
    return np.where(gap <= 1e-12 * np.maximum(scale, 1e-300), 0.0, gap)


def _spread(vectors: DataFrame, centres: Mapping[int, np.ndarray]) -> dict[int, float]:
    """Per seed the sum of squared distances to the nearest candidate."""
    rows = _seed_pass(vectors, centres, 0, lambda seed, gap, draw: np.zeros(len(gap), bool))
    return {seed: gap for seed, (gap, _) in rows.items()}


def _candidates(vectors: DataFrame, packed: DataFrame, seeds: Sequence[int], k: int) -> dict[int, np.ndarray]:
    """Candidate centres per seed by k-means|| (Bahmani et al. 2012) over the whole table.

    A turn reads all vectors once for all seeds and draws each with a probability in
    proportion to its squared distance from the candidates, ``2 k`` of them expected. It ends
    after SEED_TURNS turns, or when the table holds no vector that is not a candidate;
    turns go on while there are fewer than k candidates.
    """
    least = [F.min_by("v", F.xxhash64("item_id", F.lit(seed))).alias(str(seed)) for seed in seeds]
    centres = {seed: np.array([v]) for seed, v in zip(seeds, vectors.agg(*least).first(), strict=True)}
    spread = _spread(packed, centres)
    turn = 0
    while True:
        turn += 1
        open_seeds = {s: c for s, c in centres.items() if spread[s] > 0 and (turn <= SEED_TURNS or len(c) < k)}
        if not open_seeds:
            return centres
        scale = {s: 2.0 * k / spread[s] for s in open_seeds}
        drawn = _seed_pass(packed, open_seeds, turn, lambda seed, gap, draw: draw < gap * scale[seed])
        for seed, (_, new) in drawn.items():
            if new is not None:
                centres[seed] = np.unique(np.concatenate((centres[seed], new)), axis=0)
            if centres[seed].size > MAX_CENTRE_VALUES:
                raise ValueError("too many centre values; use fewer clusters")
        spread |= _spread(packed, {seed: centres[seed] for seed in open_seeds})


def _weighted_start(points: np.ndarray, weight: np.ndarray, k: int, seed: int, threshold: float) -> np.ndarray:
    """k centres of weighted candidates: k-means++ draws, then Lloyd steps on the candidates."""
    if len(points) < k:
        raise ValueError(f"{k} clusters asked for, but the table has {len(points)} distinct vectors")
    draw = np.random.default_rng([seed, k])
    chosen = [int(draw.choice(len(points), p=weight / weight.sum()))]
    near = _gaps(points, points[chosen])
    while len(chosen) < k:
        mass = near * weight
        # Candidates are distinct: one that is not chosen yet is always left.
        if mass.sum() > 0:
            at = int(draw.choice(len(points), p=mass / mass.sum()))
        else:
            at = int(np.setdiff1d(np.arange(len(points)), chosen)[0])
        chosen.append(at)
        near = np.minimum(near, _gaps(points, points[at : at + 1]))
        near[at] = 0.0
    centres = points[chosen].copy()
    for _ in range(MAX_ITER):
        pick = np.concatenate(
            [_squared_by_product(points[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(points), 4096)]
        )
        size = np.bincount(pick, weight, k)
        total = np.stack([np.bincount(pick, weight * column, k) for column in points.T], axis=1)
        moved = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], centres)
        shift = ((moved - centres) ** 2).sum()
        centres = moved
        if shift <= threshold:
            break
    return centres


def _starts(
    vectors: DataFrame, packed: DataFrame, jobs: Sequence[tuple[int, int]], threshold: float
) -> list[Model]:
    """First centres of every (k, seed), from candidates weighted by the items nearest to them."""
    seeds = sorted({seed for _, seed in jobs})
    candidates = _candidates(vectors, packed, seeds, max(k for k, _ in jobs))
    sizes = _lloyd_pass(packed, [Model(len(c), s, c) for s, c in candidates.items()])[0]
    weights, at = {}, 0
    for seed, centres in candidates.items():
        weights[seed] = np.maximum(sizes[at : at + len(centres)], 1e-9)
        at += len(centres)
    return [
        Model(k, seed, _weighted_start(candidates[seed], weights[seed], k, seed, threshold))
        for k, seed in sorted(jobs)
    ]


def _pack(vectors: DataFrame) -> DataFrame:
    """Vectors (item_id, v) as rows of ids and a matrix: passes read them without a conversion of each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column(1)[0])
            ids = np.asarray(batch.column(0).fill_null(_NO_ID), np.int64)
            x = _matrix(batch.column(1), width)
            rows = max(1, PACK_VALUES // max(width, 1))
            for start in range(0, len(x), rows):
                part = slice(start, start + rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v[part].tobytes()], pa.binary()) for v in (ids, x)], ["item_id", "v"]
                )

    return vectors.select(F.col("item_id").cast("long"), "v").mapInArrow(run, "item_id binary, v binary")


def _matrices(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The matrices of a packed column, or the one matrix of a column of vectors."""
    if pa.types.is_list(column.type):
        yield _matrix(column, width)
    else:
        for packed in column:
            yield np.frombuffer(packed.as_buffer(), np.float64).reshape(-1, width)


def _nearest(x: np.ndarray, centres: np.ndarray, bounds: Sequence[int]) -> np.ndarray:
    """For each model (a slice of ``centres``) ones at the nearest centre of each vector, as centres by vectors."""
    gap = centres @ x.T
    gap *= -2.0
    gap += (centres**2).sum(axis=1)[:, None]
    hot = np.empty_like(gap)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        np.equal(gap[lo:hi], gap[lo:hi].min(axis=0), out=hot[lo:hi], casting="unsafe")
        if hot[lo:hi].sum() != len(x):
            # Of equal distances the first counts.
            hot[lo:hi] = np.arange(hi - lo)[:, None] == gap[lo:hi].argmin(axis=0)
    return hot


def _nearest_slices(x: np.ndarray, centres: np.ndarray, bounds: Sequence[int]) -> np.ndarray:
    """For each model (a slice of ``centres``) the stacked number of the nearest centre."""
    gap = (centres**2).sum(axis=1)[None, :] - 2.0 * (x @ centres.T)
    return np.stack(
        [gap[:, lo:hi].argmin(axis=1) + lo for lo, hi in zip(bounds[:-1], bounds[1:])], axis=1
    )


def _lloyd_pass(
    vectors: DataFrame, models: Sequence[Model], with_cost: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, vector sums and (on request) costs per stacked centre, in one scan.

    A task returns one row per centre; the vector sums are added by Spark's summarizer.
    Only model-sized results reach the driver.
    """
    centres = np.concatenate([m.centres for m in models])
    bounds = np.cumsum([0] + [len(m.centres) for m in models]).tolist()
    width = centres.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast((centres, bounds))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, edges = shared.value
        size, total = np.zeros(len(at)), np.zeros((len(at), width))
        cost = np.zeros(len(at))
        for block in (b for batch in batches for b in _matrices(batch.column(0), width)):
            for start in range(0, len(block), STRIP_ROWS):
                x = block[start : start + STRIP_ROWS]
                hot = _nearest(x, at, edges)
                size += hot.sum(axis=1)
                total += hot @ x
                for lo, hi in zip(edges[:-1], edges[1:]) if with_cost else ():
                    pick = hot[lo:hi].argmax(axis=0) + lo
                    cost += np.bincount(pick, ((x - at[pick]) ** 2).sum(axis=1), len(at))
        used = np.flatnonzero(size)
        flat = np.concatenate([size[used, None], cost[used, None], total[used]], axis=1)
        offsets = np.arange(0, flat.size + 1, width + 2, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))],
            ["centre", "sums"],
        )

    rows = (
        vectors.select("v")
        .mapInArrow(assign, "centre int, sums array<double>")
        .groupBy("centre")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        .toArrow()
    )
    shared.destroy()
    table = np.zeros((len(centres), width + 2))
    table[np.asarray(rows.column("centre"))] = matrix_of(rows, "sums")
    return table[:, 0], table[:, 2:], table[:, 1]


def _extent(vectors: DataFrame) -> tuple[int, int, float]:
    """Number of vectors, their width, and the mean variance of their dimensions."""
    found = vectors.agg(
        Summarizer.metrics("count", "variance").summary(array_to_vector("v")).alias("s")
    ).first()["s"]
    if not found["count"]:
        return 0, 0, 0.0
    variance = found["variance"].toArray()
    return found["count"], len(variance), float(variance.mean()) * (found["count"] - 1) / found["count"]


def fit_all(
    df: DataFrame,
    ks: Sequence[int],
    seed: int = SEED,
    starts: int = STARTS,
    column: str = "embedding",
    max_iter: int = MAX_ITER,
    tol: float = 1e-4,
) -> dict[int, Model]:
    """The cheapest Euclidean k-means model of each k over all starts.

    Every k and every start is refined in the same scan of the vectors, so the data is
    read as often as the slowest single fit needs, not once per fit and iteration.
    Models that no longer move leave the scan. Equal costs keep the lowest seed. Starts are
    drawn from the whole table; fewer distinct vectors than k are an error.
    """
    vectors = (
        df.filter(F.col(column).isNotNull())
        .select("item_id", as_double(F.col(column)).alias("v"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    packed = _pack(vectors).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, width, variance = _extent(vectors)
        if not n:
            return {}
        threshold = tol * variance
        jobs = [(k, s) for k in ks for s in range(seed, seed + starts)]
        if sum(k for k, _ in jobs) * width > MAX_CENTRE_VALUES:
            raise ValueError("too many centre values for one pass; use fewer starts or ks")
        moving = _starts(vectors, packed, jobs, threshold)
        vectors.unpersist()
        settled: list[Model] = []
        for _ in range(max_iter):
            size, total, _ = _lloyd_pass(packed, moving)
            at, still = 0, []
            for model in moving:
                part = slice(at, at + len(model.centres))
                at = part.stop
                n = size[part, None]
                # A centre that lost all its items stays where it is.
                centres = np.where(n > 0, total[part] / np.maximum(n, 1), model.centres)
                shift = float(((centres - model.centres) ** 2).sum())
                (settled if shift <= threshold else still).append(Model(model.k, model.seed, centres))
            moving = still
            if not moving:
                break
        final = settled + moving
        cost = _lloyd_pass(packed, final, with_cost=True)[2]
    finally:
        vectors.unpersist()
        packed.unpersist()
    best: dict[int, Model] = {}
    at = 0
    for model in final:
        part = slice(at, at + len(model.centres))
        at = part.stop
        priced = Model(model.k, model.seed, model.centres, float(cost[part].sum()))
        held = best.get(model.k)
        if held is None or (priced.cost, priced.seed) < (held.cost, held.seed):
            best[model.k] = priced
    return best


def refine_centres(
    df: DataFrame, centres: Sequence[tuple[int, Sequence[float]]], passes: int, column: str = "embedding"
) -> list[tuple[int, list[float]]]:
    """Given centres after a fixed number of Lloyd passes, one scan each.

    Items go to the nearest centre, equal distances to the first one given; a centre that
    loses all its items stays where it is. Null vectors are left out.
    """
    model = Model(len(centres), 0, np.array([c for _, c in centres], dtype=np.float64))
    vectors = df.filter(F.col(column).isNotNull()).select(as_double(F.col(column)).alias("v"))
    for _ in range(passes):
        size, total, _ = _lloyd_pass(vectors, [model])
        moved = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], model.centres)
        model = Model(model.k, 0, moved)
    return [(label, [float(x) for x in c]) for (label, _), c in zip(centres, model.centres, strict=True)]


def fit_kmeans(
    df: DataFrame, k: int, seed: int = SEED, starts: int = STARTS, column: str = "embedding"
) -> Model:
    """Euclidean k-means, best of ``starts`` runs by inertia."""
    return fit_all(df, [k], seed, starts, column)[k]


def kmeans_clusters(
    df: DataFrame, k: int, seed: int = SEED, starts: int = STARTS, column: str = "embedding"
) -> DataFrame:
    """Fit and label: ``df`` with a ``cluster`` column, NULL where there is no vector."""
    return assign_nearest(df, fit_kmeans(df, k, seed, starts, column).labelled(), column)


def _summary(df: DataFrame, label: str, vector: Column, *metrics: str) -> DataFrame:
    """Vector statistics per label: whole vectors are combined, nothing is exploded."""
    return (
        df.select(label, array_to_vector(vector).alias("v"))
        .groupBy(label)
        .agg(Summarizer.metrics("count", *metrics).summary(F.col("v")).alias("s"))
        .select(
            label,
            F.col("s.count").alias("count"),
            *[vector_to_array(f"s.{m}").alias(m) for m in metrics],
        )
    )


def label_means(df: DataFrame, label: str = "cluster", column: str = "embedding") -> DataFrame:
    """(label, dim, value): the mean vector of each label in long form."""
    present = df.filter(F.col(column).isNotNull())
    means = _summary(present, label, as_double(F.col(column)), "mean")
    return means.select(label, F.posexplode("mean").alias("dim", "value"))


def collect_centres(means: DataFrame, label: str = "cluster") -> list[tuple[int, list[float]]]:
    """Long-form centres as a list; refuses more centres than a model may hold."""
    packed = means.groupBy(label).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda r: r["value"]
        ).alias("centre")
    )
    rows = packed.limit(MAX_CENTRES + 1).collect()
    if len(rows) > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    centres = sorted((r[label], list(r["centre"])) for r in rows)
    _check_centres(centres)
    return centres


def nearest_centre(vector: Column, centres: Sequence[tuple[int, Sequence[float]]]) -> Column:
    """Struct (dist, label) of the nearest centre; equal distances take the lowest label.

    A pure expression over literal centres for short vectors and few centres;
    ``assign_nearest`` does the same with matrix products.
    """
    table = F.array(
        *[
            F.struct(
                F.lit(int(label)).alias("label"),
                constant(centre).alias("v"),
            )
            for label, centre in sorted(centres)
        ]
    )
    ranked = F.transform(
        table,
        lambda c: F.struct(
            squared_distance(vector, c["v"]).alias("dist"), c["label"].alias("label")
        ),
    )
    return F.when(vector.isNotNull(), F.array_min(ranked))


def assign_nearest(
    df: DataFrame,
    centres: Sequence[tuple[int, Sequence[float]]],
    column: str = "embedding",
    into: str = "cluster",
) -> DataFrame:
    """Add the label and squared distance of the nearest centre (``distance``)."""
    return assign_many(df, {into: centres}, column).withColumn(
        "distance", F.get("distances", F.lit(0))
    ).drop("distances")


def assign_many(
    df: DataFrame,
    models: Mapping[str, Sequence[tuple[int, Sequence[float]]]],
    column: str = "embedding",
) -> DataFrame:
    """Add one label column per model and the array of their squared ``distances``.

    The models are bounded and broadcast once; each Arrow batch is one matrix product
    for all of them. Distances of the winners are recomputed by difference, so that
    they do not suffer from cancellation. Equal distances take the lowest label.
    """
    names = list(models)
    ordered = [sorted(models[name]) for name in names]
    _check_centres([c for model in ordered for c in model])
    labels = np.array([label for model in ordered for label, _ in model], dtype=np.int32)
    matrix = np.array([c for model in ordered for _, c in model], dtype=np.float64)
    bounds = np.cumsum([0] + [len(model) for model in ordered]).tolist()
    shared = df.sparkSession.sparkContext.broadcast((labels, matrix, bounds))
    kept = [f for f in df.schema.fields if f.name not in (*names, "distances")]
    schema = T.StructType(
        kept
        + [T.StructField(name, T.IntegerType()) for name in names]
        + [T.StructField("distances", T.ArrayType(T.DoubleType()))]
    )

    def label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label_of, centre, edges = shared.value
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index(column))
            present = np.asarray(vectors.is_valid())
            x = _matrix(vectors.drop_null(), centre.shape[1])
            pick = _nearest_slices(x, centre, edges)
            found = np.zeros((len(present), len(names)), dtype=np.int32)
            far = np.zeros((len(present), len(names)))
            found[present] = label_of[pick]
            for m in range(len(names)):
                far[present, m] = ((x - centre[pick[:, m]]) ** 2).sum(axis=1)
            offsets = np.arange(0, far.size + 1, len(names), dtype=np.int32)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            columns += [pa.array(found[:, m], mask=~present) for m in range(len(names))]
            columns.append(
                pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(far.ravel(), mask=np.repeat(~present, len(names)))
                )
            )
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return df.mapInArrow(label_batches, schema)


def _squared_by_product(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2.0 * (x @ c.T) + (c**2).sum(1)[None, :]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    return flat.reshape(-1, width)


def _check_centres(centres: Sequence[tuple[int, Sequence[float]]]) -> None:
    size = sum(len(c) for _, c in centres)
    if size > MAX_CENTRE_VALUES:
        raise ValueError(f"{size} centre values exceed {MAX_CENTRE_VALUES}")


def inertia(df: DataFrame, label: str = "cluster", column: str = "embedding") -> DataFrame:
    """Per label: size and sum of squared distances to the label's mean.

    One pass: the sum is the total variance times the degrees of freedom, so rows are
    never joined back to their centre.
    """
    present = df.filter(F.col(column).isNotNull())
    spread = _summary(present, label, as_double(F.col(column)), "variance")
    total = F.aggregate("variance", F.lit(0.0), lambda s, x: s + x)
    return spread.select(label, "count", (total * (F.col("count") - 1)).alias("inertia"))


def cluster_cohesion(df: DataFrame, label: str = "cluster", column: str = "embedding") -> DataFrame:
    """Mean cosine over all pairs inside a cluster, without forming the pairs.

    On unit vectors the pair sum is (‖Σu‖² − m) / 2, so one pass suffices. Zero vectors
    take no part; a single vector has no pair and gives NULL.
    """
    units = df.withColumn("__u", unit(as_double(F.col(column)))).filter(F.col("__u").isNotNull())
    sums = _summary(units, label, F.col("__u"), "sum")
    square = F.aggregate("sum", F.lit(0.0), lambda s, x: s + x * x)
    pairs = F.col("count") * (F.col("count") - 1)
    return sums.select(
        label,
        "count",
        ((square - F.col("count")) / F.nullif(pairs, F.lit(0).cast("long"))).alias("cohesion"),
    )


def _label_moments(rows: DataFrame, labels: Sequence[str]) -> list:
    """Per labelling and cluster: size, mean vector, mean squared distance to the mean."""
    each = F.explode(
        F.array(*[F.struct(F.lit(c).alias("labelling"), F.col(c).alias("cluster")) for c in labels])
    )
    v = array_to_vector("v")
    return (
        rows.withColumn("l", each)
        .groupBy("l.labelling", "l.cluster")
        .agg(Summarizer.metrics("count", "mean", "variance").summary(v).alias("s"))
        .select("labelling", "cluster", "s.count", "s.mean", "s.variance")
        .collect()
    )


def silhouette_fast(
    df: DataFrame, labels: Sequence[str] = ("cluster",), column: str = "embedding"
) -> DataFrame:
    """Per item and labelling: squared-Euclidean silhouette, linear in the items.

    The mean squared distance to a cluster follows from the cluster's size, mean and
    spread; those are a bounded model, and the items are read once more to be scored.
    """
    rows = df.filter(F.col(column).isNotNull()).select(
        "item_id", as_double(F.col(column)).alias("v"), *[F.col(c).cast("int").alias(c) for c in labels]
    )
    moments = _label_moments(rows, labels)
    _check_centres([(r["cluster"], r["mean"]) for r in moments])
    model = {}
    for name in labels:
        own = sorted((r for r in moments if r["labelling"] == name), key=lambda r: r["cluster"])
        n = np.array([r["count"] for r in own], dtype=np.float64)
        sample_variance = np.array([r["variance"].toArray().sum() for r in own])
        model[name] = (
            np.array([r["cluster"] for r in own]),
            n,
            np.array([r["mean"].toArray() for r in own]),
            sample_variance * (n - 1) / n,
        )
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = list(labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in names:
                clusters, sizes, mu, spread = shared.value[name]
                x = _matrix(batch.column(1), mu.shape[1])
                own = batch.column(batch.schema.get_field_index(name))
                at = np.searchsorted(clusters, np.asarray(own))
                mean = np.maximum(_squared_by_product(x, mu), 0.0) + spread
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([name] * len(x), pa.string()),
                        own,
                        pa.array(_silhouette(mean, sizes, at)),
                    ],
                    ["item_id", "labelling", "cluster", "silhouette"],
                )

    return rows.mapInArrow(
        score, "item_id long, labelling string, cluster int, silhouette double"
    )


def _silhouette(mean: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(b − a) / max(a, b) from mean distances per cluster; 0 for singletons and 0/0."""
    if len(sizes) < 2:
        return np.zeros(len(own))
    rows = np.arange(len(own))
    n = sizes[own]
    a = mean[rows, own] * n / np.maximum(n - 1, 1)
    others = mean.copy()
    others[rows, own] = np.inf
    b = others.min(axis=1)
    top = np.maximum(a, b)
    return np.where((n > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)


def silhouette_exact(
    df: DataFrame, labels: Sequence[str] = ("cluster",), column: str = "embedding", block_rows: int = 4096
) -> DataFrame:
    """Per item and labelling: the plain Euclidean silhouette over all items.

    All labellings share one pass over the distances. ``distance_sums`` gives every
    item its distance sum to each cluster; the rest is a small per-row expression.
    """
    sums = distance_sums(df, labels, column, block_rows)
    size = F.col("n").cast("double")
    own = F.col("own")
    per_cluster = sums.select(
        "item_id",
        "labelling",
        own.alias("cluster"),
        F.max(F.when(own == F.col("other"), F.col("n"))).over(_by_item()).alias("own_n"),
        F.max(
            F.when(own == F.col("other"), F.col("total") / F.nullif(size - 1, F.lit(0.0)))
        ).over(_by_item()).alias("a"),
        F.min(F.when(own != F.col("other"), F.col("total") / size)).over(_by_item()).alias("b"),
        F.row_number().over(_by_item().orderBy("other")).alias("rn"),
    ).filter(F.col("rn") == 1)
    top = F.greatest("a", "b")
    return per_cluster.select(
        "item_id",
        "labelling",
        "cluster",
        F.when(
            (F.col("own_n") > 1) & (top > 0) & F.col("b").isNotNull(), (F.col("b") - F.col("a")) / top
        )
        .otherwise(0.0)
        .alias("silhouette"),
    )


def _by_item():
    return Window.partitionBy("item_id", "labelling")


def best_k(curve: DataFrame) -> DataFrame:
    """Mark the k with the highest score; equal scores take the smallest k."""
    best = top_n_per_group(
        curve.withColumn("one", F.lit(1)), ["one"], [F.desc("silhouette"), F.col("k")], 1
    ).select("k", F.lit(True).alias("best"))
    return curve.join(best, "k", "left").select(
        "k", "silhouette", F.coalesce("best", F.lit(False)).alias("is_best")
    )


def select_k(
    df: DataFrame,
    k_min: int = K_MIN,
    k_max: int = K_MAX,
    metric: str = "euclidean",
    seed: int = SEED,
    starts: int = STARTS,
    column: str = "embedding",
) -> DataFrame:
    """Silhouette of the best model of every k, with the chosen k marked.

    ``euclidean`` compares every item with all others; ``sq_euclidean`` is linear in
    the items. The range is clamped so that k < number of items.
    """
    if metric not in ("euclidean", "sq_euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    vectors = df.filter(F.col(column).isNotNull()).select("item_id", column)
    n = vectors.count()
    ks = list(range(k_min, min(k_max, n - 1) + 1))
    if not ks:
        return df.sparkSession.createDataFrame([], "k int, silhouette double, is_best boolean")
    models = fit_all(vectors, ks, seed, starts, column)
    labelled = assign_many(vectors, {f"k{k}": models[k].labelled() for k in ks}, column)
    score = silhouette_exact if metric == "euclidean" else silhouette_fast
    curve = (
        score(labelled, [f"k{k}" for k in ks], column)
        .groupBy("labelling")
        .agg(F.avg("silhouette").alias("silhouette"))
        .select(F.substring("labelling", 2, 9).cast("int").alias("k"), "silhouette")
    )
    return best_k(curve)
