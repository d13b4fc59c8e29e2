"""K-means within every cross-section at once, and the tables built on its states."""

import tempfile
import warnings
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.xsec import first_rank, z_score

#: Up to so many groups, centres go through the driver and are broadcast.
FEW = 10_000


def cut_once(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in the checkpoint folder; a folder of this machine only for a local session that names none."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def cut(df: DataFrame) -> DataFrame:
    """As cut_once, through the cache. A checkpoint computes its rows once without it, and large tables would be written twice."""
    held = df.persist()
    out = cut_once(held)
    held.unpersist()
    return out


def _gap(zs: Column, centre: Column) -> Column:
    """Squared distance of a point from a centre, both arrays; null for a centre that never had members."""
    return F.round(F.aggregate(F.zip_with(zs, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d), 9)


def _points(df: DataFrame, features: list[str], by: list[str], least: int, tie: str) -> DataFrame:
    """Complete rows of groups with at least `least`: _zs, the features' z-scores within the group, _n and the place _place by their sum; held."""
    rows = df.dropna(subset=features).withColumn("_n", F.count("*").over(Window.partitionBy(*by))).filter(F.col("_n") >= least)
    rows = rows.withColumn("_zs", F.array(*(F.round(z_score(f, *by), 10) for f in features)))
    rows = rows.withColumn("_sum", F.round(F.aggregate("_zs", F.lit(0.0), lambda acc, z: acc + z), 10))
    return cut(rows.withColumn("_place", first_rank("_sum", *by, tie=tie) - 1).drop("_sum"))


def _lloyd(points: DataFrame, width: int, k: int, by: list[str], most: int) -> DataFrame:
    """Rows of _points with cluster and their group's _centres; seeds are even quantiles of the sum of z-scores.

    The steps are those of walk. One shuffle brings a group's points, `width` numbers a row, into one task, which goes on until no centre moves: no
    group waits for another, and all end in one job. Groups are cross-sections; for groups that grow with the whole table there is walk.
    """
    rows = points.withColumn("_seed", F.floor(F.col("_place") * k / F.col("_n")).cast("int"))
    kinds = [rows.schema[c] for c in by]

    def settle(key, table):
        zs = np.asarray(table["_zs"].combine_chunks().flatten()).reshape(-1, width)
        centres, moved = settled(zs, np.asarray(table["_seed"]), k, most)
        listed = [None if np.isnan(c[0]) else c.tolist() for c in centres]
        return pa.table({"_centres": pa.array([listed], pa.list_(pa.list_(pa.float64()))), "_moved": [moved], **dict(zip(by, ([x] for x in key), strict=True))}).select([*by, "_centres", "_moved"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", _centres array<array<double>>, _moved boolean"
    centres = cut(rows.select(*by, "_zs", "_seed").groupBy(*by).applyInArrow(settle, schema))
    if not centres.filter("_moved").isEmpty():
        warnings.warn(f"centres still move after {most} steps", stacklevel=3)
    return placed(rows, centres, by).drop("_seed", "_place")


def means(zs: np.ndarray, cluster: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Each cluster's mean to ten digits; one without members stays where it was, or NaN where it never had any."""
    n = np.bincount(cluster, minlength=len(old))
    sums = np.stack([np.bincount(cluster, zs[:, i], len(old)) for i in range(zs.shape[1])], axis=1)
    return np.where(n[:, None] > 0, np.round(sums / np.maximum(n, 1)[:, None], 10), old)


def gaps(zs: np.ndarray, centres: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Squared distance of each point from each centre, infinite from NaN ones. group: each point's number into centres of groups."""
    out = 0.0
    for i in range(zs.shape[1]):
        out = out + (zs[:, i, None] - (centres[None, :, i] if group is None else centres[group, :, i])) ** 2
    return np.where(np.isnan(out), np.inf, out)


def nearest(zs: np.ndarray, centres: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """The number of the nearest centre by _gap, the smallest of equal ones; NaN centres are nobody's. group: each point's number into centres of groups."""
    return np.round(gaps(zs, centres, group), 9).argmin(axis=1)


def settled(zs: np.ndarray, seed: np.ndarray, k: int, most: int) -> tuple[np.ndarray, bool]:
    """One group's centres after Lloyd steps from its seeds until none moves, and whether some still did in the last of `most` steps."""
    centres = means(zs, seed, np.full((k, zs.shape[1]), np.nan))
    for _ in range(most):
        fresh = means(zs, nearest(zs, centres), centres)
        if np.array_equal(fresh, centres, equal_nan=True):
            return centres, False
        centres = fresh
    return centres, True


def placed(rows: DataFrame, centres: DataFrame, by: list[str], few: bool = True) -> DataFrame:
    """Rows with their group's _centres and the nearest one's number `cluster`."""
    near = F.transform("_centres", lambda c, i: F.struct(_gap(F.col("_zs"), c).alias("d"), i.alias("c")))
    own = centres.select(*by, "_centres")
    return rows.join(F.broadcast(own) if few else own, by).withColumn("cluster", F.array_min(F.filter(near, lambda x: x["d"].isNotNull()))["c"])


def walk(rows: DataFrame, width: int, k: int, by: list[str], most: int, few: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with cluster and their group's _centres; centres, one row a group) after Lloyd steps from _seed over the points _zs until no centre moves.

    Rows stay where they are, however large a group; each step aggregates them to k centres a group, partially before the shuffle. Where the caller
    has counted the groups and they are few, their centres go through the driver and to the tasks, which sum the points of groups that still move;
    else centres are joined back. Warns where `most` steps do not suffice.
    """
    if few:
        centres = walks(rows.select(*by, "_zs", F.array("_seed").alias("_seeds")), width, [k], by, most)[k]
    else:
        centres, moved = _walk_many(rows, width, k, by, most)
        if moved:
            warnings.warn(f"centres still move after {most} steps", stacklevel=3)
    return placed(rows, centres, by, few).drop("_seed"), centres


def _walk_many(rows: DataFrame, width: int, k: int, by: list[str], most: int) -> tuple[DataFrame, bool]:
    every = F.sequence(F.lit(0), F.lit(k - 1))
    mean = F.array(*(F.round(F.avg(F.col("_zs")[i]), 10) for i in range(width)))

    def step(assigned: DataFrame) -> DataFrame:
        sums = assigned.groupBy(*by, "cluster").agg(F.first("_centres").alias("_old"), mean.alias("_mean"))
        found = sums.groupBy(*by).agg(F.first("_old").alias("_old"), F.map_from_entries(F.collect_list(F.struct("cluster", "_mean"))).alias("_new"))
        kept = F.transform(every, lambda i: F.coalesce(F.col("_new")[i], F.col("_old")[i]))  # a cluster without members stays where it was
        return cut(found.select(*by, kept.alias("_centres"), (~kept.eqNullSafe(F.col("_old"))).alias("_moved")))

    nowhere = F.transform(every, lambda i: F.lit(None).cast("array<double>"))
    centres = step(rows.withColumn("cluster", F.col("_seed")).withColumn("_centres", nowhere))
    for _ in range(most):
        centres = step(placed(rows, centres, by, False))
        if centres.filter("_moved").isEmpty():
            return centres, False
    return centres, True


def walks(rows: DataFrame, width: int, ks: list[int], by: list[str], most: int) -> dict[int, DataFrame]:
    """For each k the centres of few groups, one row a group, after the steps of walk from the seeds of the array _seeds, one for each k.

    The points are packed into blocks once, which all walks read, side by side.
    """
    spark = rows.sparkSession
    groups = [tuple(r) for r in rows.select(*by).distinct().collect()]  # the caller has counted them
    kind = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    numbers = spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], f"{kind}, _g int")

    def pack(batches):
        for batch in batches:
            columns = [[np.asarray(batch.column(c)).astype(t).tobytes()] for c, t in (("_g", np.int32),)]
            columns += [[np.asarray(batch.column(c).flatten()).astype(t).tobytes()] for c, t in (("_zs", np.float64), ("_seeds", np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in columns], ["g", "zs", "seeds"])

    held = rows.join(F.broadcast(numbers), by).select("_g", "_zs", "_seeds").mapInArrow(pack, "g binary, zs binary, seeds binary").persist()
    try:
        with ThreadPoolExecutor(len(ks)) as pool:
            waiting = {k: pool.submit(inheritable_thread_target(spark)(_walk_few), held, len(groups), width, k, most, (i, len(ks))) for i, k in enumerate(ks)}
            found = {k: f.result() for k, f in waiting.items()}
    finally:
        held.unpersist()
    out = {}
    for k, (centres, moving) in found.items():
        if moving.any():
            warnings.warn(f"centres still move after {most} steps", stacklevel=3)
        listed = [[None if np.isnan(c[0]) else c.tolist() for c in own] for own in centres]
        out[k] = spark.createDataFrame([(*g, c, bool(m)) for g, c, m in zip(groups, listed, moving, strict=True)], f"{kind}, _centres array<array<double>>, _moved boolean")
    return out


#: A group's points are told apart once its steps are so short that AHEAD of them stay within 1 / APART of the way between its centres, and again when they have shrunk by SHRINK.
AHEAD, APART, SHRINK = 10, 8, 16


def _walk_few(held: DataFrame, n_groups: int, width: int, k: int, most: int, seed: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(centres of each group, whether they still moved in the last step) over packed blocks; seed: which of how many seeds of a point to begin with.

    When steps get short, one pass adds up the points that keep their cluster as long as no centre leaves a circle around where it is, and holds
    the others, which alone the next steps read. A centre that leaves its circle, or much shorter steps, ask for another such pass: the steps are the plain ones.
    """
    names = [f"s{i}" for i in range(width)]
    schema = f"at long, n long, {', '.join(f'{c} double' for c in names)}, g binary, zs binary"
    blank = pa.schema([("at", pa.int64()), ("n", pa.int64()), *((c, pa.float64()) for c in names), ("g", pa.binary()), ("zs", pa.binary())])

    def passed(blocks: DataFrame, centres: np.ndarray, moving: np.ndarray, room: np.ndarray | None = None, first: bool = False) -> DataFrame:
        """Sums of the points of moving groups by centre; with room of those that cannot change their cluster within it, beside the blocks of others."""

        def sums(batches):
            n, s = np.zeros(len(moving) * k, np.int64), np.zeros((width, len(moving) * k))
            for batch in batches:
                for j in range(batch.num_rows):
                    g, zs = np.frombuffer(batch.column("g")[j].as_buffer(), np.int32), np.frombuffer(batch.column("zs")[j].as_buffer(), np.float64).reshape(-1, width)
                    some = moving[g]
                    if first:
                        own = np.frombuffer(batch.column("seeds")[j].as_buffer(), np.int32).reshape(-1, seed[1])[some, seed[0]]
                    g, zs = (g, zs) if some.all() else (g[some], zs[some])
                    if not first:
                        away = gaps(zs, centres, g)
                        own = np.round(away, 9).argmin(axis=1)
                    if room is not None:
                        far = np.sqrt(np.partition(away, 1, axis=1)[:, :2]) if k > 1 else np.c_[np.sqrt(away), np.full(len(away), np.inf)]
                        with np.errstate(invalid="ignore"):
                            # the last terms are far more than what rounding of distances can do
                            safe = far[:, 1] - far[:, 0] > 2 * room[g] + 1e-4 + 1e-9 * far[:, 0]
                        if not safe.all():
                            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in blank][:-2] + [pa.array([x[~safe].tobytes()], pa.binary()) for x in (g, zs)], schema=blank)
                        g, zs, own = g[safe], zs[safe], own[safe]
                    place, inside = np.unique(g.astype(np.int64) * k + own, return_inverse=True)
                    n[place] += np.bincount(inside, minlength=len(place))
                    for i in range(width):
                        s[i, place] += np.bincount(inside, zs[:, i], len(place))
            at = np.flatnonzero(n)
            none = pa.nulls(len(at), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), *(pa.array(x[at]) for x in s), none, none], schema=blank)

        return blocks.mapInArrow(sums, schema)

    def total(parts: DataFrame) -> np.ndarray:
        """Number and sums of points by group, centre."""
        out = np.zeros((n_groups, k, 1 + width))
        for r in parts.filter("at is not null").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("n", *names))).collect():  # one row a centre
            out[r["at"] // k, r["at"] % k] = [r[c] for c in ("n", *names)]
        return out

    def mean(sums: np.ndarray, old: np.ndarray) -> np.ndarray:
        """One without members stays where it was."""
        return np.where(sums[:, :, :1] > 0, np.round(sums[:, :, 1:] / np.maximum(sums[:, :, :1], 1), 10), old)

    def way(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The longest way of a group's centres."""
        return np.sqrt(np.nan_to_num(((a - b) ** 2).sum(axis=2)).max(axis=1))

    def between(centres: np.ndarray) -> np.ndarray:
        """The shortest way between two of a group's centres."""
        away = np.sqrt(((centres[:, :, None] - centres[:, None]) ** 2).sum(axis=3))
        return np.nanmin(np.where(np.eye(k, dtype=bool) | np.isnan(away), np.inf, away).reshape(n_groups, k * k), axis=1, initial=np.inf)

    moving = np.ones(n_groups, bool)
    centres = mean(total(passed(held, np.full((n_groups, k, width), np.nan), moving, first=True)), np.full((n_groups, k, width), np.nan))
    parts, near, base, mark, room, step = None, held, 0.0, centres, np.full(n_groups, np.inf), np.full(n_groups, np.inf)
    try:
        for _ in range(most):
            short = AHEAD * step < np.minimum(between(centres) / APART, room / SHRINK)
            left = moving & (way(centres, mark) > room)
            if left.any() or 2 * (short & moving).sum() > moving.sum():
                room, mark = np.where(AHEAD * step < between(centres) / APART, AHEAD * step, np.inf), centres
                if parts is not None:
                    parts.unpersist()
                parts = passed(held, centres, moving, room).persist()
                base, near = total(parts), parts.filter("at is null")
            fresh = mean(base + total(passed(near, centres, moving)), centres)
            fresh = np.where(moving[:, None, None], fresh, centres)
            step = way(fresh, centres)
            moving = moving & ~((fresh == centres) | (np.isnan(fresh) & np.isnan(centres))).all(axis=(1, 2))
            centres = fresh
            if not moving.any():
                break
    finally:
        if parts is not None:
            parts.unpersist()
    return centres, moving


def grouped_kmeans(df: DataFrame, features: list[str], k: int = 3, by: tuple[str, ...] = ("date",), most: int = 300, least: int | None = None, tie: str = "ticker") -> DataFrame:
    """Cluster every group's rows at once; risk_rank 0.. by the centre's mean, least risky first, and stable where it is 0.

    Features are standardised within the group. Groups with fewer than max(4k, 12) rows, and rows that lack a feature, are left out.
    """
    rows = _lloyd(_points(df, features, list(by), least or max(4 * k, 12), tie), len(features), k, list(by), most)
    mean = F.aggregate(F.col("_centres")[F.col("cluster")], F.lit(0.0), lambda acc, z: acc + z)
    rows = rows.withColumn("_mean", F.round(mean, 9))
    rows = rows.withColumn("risk_rank", F.dense_rank().over(Window.partitionBy(*by).orderBy("_mean", "cluster")) - 1)
    return rows.drop("_n", "_zs", "_mean", "_centres", "cluster").withColumn("stable", F.col("risk_rank") == 0)


def k_sensitivity(df: DataFrame, features: list[str], ks: tuple[int, ...] = (2, 3, 4, 5, 6), by: str = "date", least: int = 30, most: int = 300, tie: str = "ticker") -> DataFrame:
    """For each group and k: silhouette, Davies-Bouldin and Calinski-Harabasz index and the smallest cluster's share.

    The silhouette is taken against centres (own and next nearest), not against all pairs of rows, so its work grows with the rows.
    """
    out, points = None, _points(df, features, [by], least, tie)
    for k in ks:
        rows = _lloyd(points, len(features), k, [by], most)
        gaps = F.transform("_centres", lambda c, i: F.struct(_gap(F.col("_zs"), c).alias("d"), i.alias("c")))
        rows = rows.withColumn("_near", F.array_sort(F.filter(gaps, lambda x: x["d"].isNotNull())))
        own, other = F.sqrt(F.col("_near")[0]["d"]), F.sqrt(F.try_element_at("_near", F.lit(2))["d"])
        rows = rows.withColumns({"_own": own, "_fit": F.coalesce((other - own) / F.nullif(F.greatest(own, other), F.lit(0.0)), F.lit(0.0)), "_all": F.aggregate("_zs", F.lit(0.0), lambda acc, z: acc + z * z)})
        parts = rows.groupBy(by, "cluster").agg(F.count("*").alias("n"), F.avg("_own").alias("s"), F.sum("_fit").alias("fit"), F.sum(F.pow("_own", F.lit(2))).alias("within"), F.sum("_all").alias("total"), F.first(F.col("_centres")[F.col("cluster")]).alias("centre"))
        table = parts.groupBy(by).agg(F.collect_list(F.struct("cluster", "s", "centre")).alias("xs"), F.sum("n").alias("n"), F.min("n").alias("small"), F.sum("fit").alias("fit"), F.sum("within").alias("within"), F.sum("total").alias("total"))
        worst = F.transform("xs", lambda x: F.array_max(F.transform(F.filter("xs", lambda y: y["cluster"] != x["cluster"]), lambda y: (x["s"] + y["s"]) / F.sqrt(_gap(x["centre"], y["centre"])))))
        part = table.select(
            by, F.lit(k).alias("k"), (F.col("fit") / F.col("n")).alias("silhouette"), (F.aggregate(worst, F.lit(0.0), lambda acc, w: acc + w) / F.size("xs")).alias("dbi"),
            (((F.col("total") - F.col("within")) / (k - 1)) / F.nullif(F.col("within") / (F.col("n") - k), F.lit(0.0))).alias("ch"), (F.col("small") / F.col("n")).alias("min_share"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def k_ranks(sensitivity: DataFrame) -> DataFrame:
    """Mean metrics of each k and the mean of its places by silhouette, DBI, CH and smallest share, best first."""
    rows = sensitivity.groupBy("k").agg(F.count("*").alias("n_groups"), *(F.avg(c).alias(c) for c in ("silhouette", "dbi", "ch", "min_share")))
    places = [F.rank().over(Window.orderBy(F.asc(c) if c == "dbi" else F.desc(c))) for c in ("silhouette", "dbi", "ch", "min_share")]  # one row a k
    return rows.withColumn("mean_place", sum(places[1:], places[0]) / 4.0)


def sector_policy(rows: DataFrame, features: list[str], stable: str = "stable", least: int = 12, tie: str = "ticker") -> DataFrame:
    """State within (date, sector) and two policies on top of the market-wide one.

    sector_status: STABLE, MIDDLE, RISKY, or UNKNOWN for an unknown sector, fewer than `least` rows or a row without a feature.
    balanced_verified: stable in both; balanced_eligible: stable, and stable or unknown in its sector.
    """
    found = grouped_kmeans(rows.filter("sector is not null and upper(sector) <> 'UNKNOWN'"), features, 3, ("date", "sector"), least=least, tie=tie)
    name = F.element_at(F.array(F.lit("STABLE"), F.lit("MIDDLE"), F.lit("RISKY")), F.col("risk_rank") + 1)
    out = rows.join(found.select("date", "ticker", name.alias("sector_status")), ["date", "ticker"], "left").withColumn("sector_status", F.coalesce("sector_status", F.lit("UNKNOWN")))
    both = F.col(stable) & (F.col("sector_status") == "STABLE")
    return out.withColumns({"balanced_verified": both, "balanced_eligible": both | (F.col(stable) & (F.col("sector_status") == "UNKNOWN"))})


def lookback_table(panel: DataFrame, features: dict[int, list[str]], outcomes: DataFrame, k: int = 3) -> DataFrame:
    """For each lookback's features: rows and dates with a known outcome, stable rows, their future-risky rate and mean drawdown."""
    out, panel = None, cut(panel)
    known = outcomes.filter("future_risky is not null").select("date", "ticker", F.col("future_risky").cast("double").alias("_risky"), "future_mdd")
    known = cut(known)
    for n, columns in features.items():
        rows = grouped_kmeans(panel.select("date", "ticker", *columns), columns, k).join(known, ["date", "ticker"])
        part = rows.agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_dates"), F.count(F.when(F.col("stable"), 1)).alias("stable_n"), F.avg(F.when(F.col("stable"), F.col("_risky"))).alias("false_stable_rate"), F.avg(F.when(F.col("stable"), F.col("future_mdd"))).alias("mean_future_mdd"))
        part = part.select(F.lit(n).alias("lookback"), "*")
        out = part if out is None else out.unionByName(part)
    return out
