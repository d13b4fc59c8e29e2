"""Cluster models of groups, fitted once on training rows, kept as a table and applied to later rows by a join.

The model has one row a group: robust scale and centres. Its size is that of groups x clusters x features, whatever the
number of rows, and rows that come later never move it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.clusters import FEW, _gap, cut, walk, walks
from panelweave.operators.tables import seeded_sample
from panelweave.operators.xsec import average_rank, percentile_rank

#: Sketches that bracket a quantile are off by at most 1 / ACCURACY of the rows; the values between the brackets are counted exactly.
ACCURACY = 10_000


def exact_quantiles(rows: DataFrame, columns: list[str], shares: list[float], by: str) -> DataFrame:
    """One row a group: by, n, and quantiles, for each column an array of the values of rank ceil(share * n). Columns hold no nulls.

    Sketches bracket each rank from both sides; a second pass counts what lies below the bracket and sorts only the few values within.
    """
    margin = 4 / ACCURACY  # twice what merged sketches may miss
    ends = [x for q in shares for x in (max(0.0, q - margin), min(1.0, q + margin))]
    value = lambda c: F.col(c).cast("double")
    found = rows.groupBy(by).agg(F.count("*").alias("n"), *(F.percentile_approx(value(c), ends, ACCURACY).alias(f"_e{i}") for i, c in enumerate(columns)))
    every = [(i, j) for i in range(len(columns)) for j in range(len(shares))]
    bracket = found.select(by, "n", F.array(*(F.array(F.col(f"_e{i}")[2 * j], F.col(f"_e{i}")[2 * j + 1]) for i, j in every)).alias("_ends"))
    bracket = cut(bracket)  # one row a group
    joined = rows.join(F.broadcast(bracket) if bracket.count() <= FEW else bracket, by)
    low, high = (lambda k: F.col("_ends")[k][0]), (lambda k: F.col("_ends")[k][1])
    below = joined.groupBy(by).agg(F.array(*(F.count(F.when(value(columns[i]) < low(k), 1)) for k, (i, _) in enumerate(every))).alias("_below"))
    hit = lambda k, i: F.when(value(columns[i]).between(low(k), high(k)), F.struct(F.lit(k).alias("k"), value(columns[i]).alias("v")))
    near = joined.select(by, F.explode(F.filter(F.array(*(hit(k, i) for k, (i, _) in enumerate(every))), lambda x: x.isNotNull())).alias("x")).groupBy(by, "x.k", "x.v").agg(F.count("*").alias("c"))
    near = near.withColumn("_to", F.sum("c").over(Window.partitionBy(by, "k").orderBy("v")))
    share = F.array(*(F.lit(float(shares[j])) for _, j in every))
    near = near.join(bracket.select(by, "n"), by).join(below, by).withColumn("_to", F.col("_to") + F.get("_below", F.col("k")))
    rank = F.greatest(F.lit(1), F.ceil(F.get(share, F.col("k")) * F.col("n")))
    picked = near.filter(F.col("_to") >= rank).groupBy(by, "n", "k").agg(F.min("v").alias("v"))
    flat = picked.groupBy(by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("_q"))
    return flat.select(by, "n", F.array(*(F.slice("_q", 1 + i * len(shares), len(shares)) for i in range(len(columns)))).alias("quantiles"))


def _scale(train: DataFrame, features: list[str], by: str) -> DataFrame:
    """Nearest-rank median and quartile range of each feature and group; a range of 0 counts as 1."""
    quarters = exact_quantiles(train, features, [0.25, 0.5, 0.75], by)
    width = F.transform("quantiles", lambda q: F.when(q[2] > q[0], q[2] - q[0]).otherwise(1.0))
    return quarters.select(by, F.col("n").alias("n_train"), F.transform("quantiles", lambda q: q[1]).alias("middle"), width.alias("width"))


def _points(rows: DataFrame, table: DataFrame, features: list[str], by: str, few: bool) -> DataFrame:
    """Rows with their group's columns of the table and scaled features _zs."""
    x = F.array(*(F.col(c).cast("double") for c in features))
    joined = rows.join(F.broadcast(table) if few else table, by)
    return joined.withColumn("_zs", F.transform(x, lambda v, i: F.round((v - F.col("middle")[i]) / F.col("width")[i], 10)))


def _scaled(train: DataFrame, features: list[str], by: str, least: int) -> tuple[DataFrame, DataFrame, bool]:
    """(scale of each group of at least `least` complete rows; their points by, _zs and _sum, held; whether the groups are few)."""
    full = train.dropna(subset=[by, *features]).select(by, *features)
    scale = cut(_scale(full, features, by).filter(F.col("n_train") >= least))
    few = scale.count() <= FEW
    total = F.round(F.aggregate("_zs", F.lit(0.0), lambda acc, z: acc + z), 10)
    return scale, cut(_points(full, scale, features, by, few).select(by, "_zs", total.alias("_sum"))), few


def _centred(rows: DataFrame, few: bool, width: int, by: str, ks: list[int], most: int) -> dict[int, DataFrame]:
    """For each k the centres (by, centres) of the points of _scaled; all walks share the points and the pass that finds their seeds."""
    cuts = exact_quantiles(rows, ["_sum"], [i / k for k in ks for i in range(1, k)], by).select(by, F.col("quantiles")[0].alias("_cuts"))
    begins = [sum(ks[:i]) - i for i in range(len(ks))]
    seeds = [F.size(F.filter(F.slice("_cuts", 1 + begin, k - 1), lambda c: c < F.col("_sum"))) for begin, k in zip(begins, ks, strict=True)]
    rows = rows.join(F.broadcast(cuts) if few else cuts, by).select(by, "_zs", F.array(*seeds).alias("_seeds"))
    if few:
        found = walks(rows, width, ks, [by], most)
    else:
        rows = cut(rows)
        found = {k: walk(rows.select(by, "_zs", F.col("_seeds")[i].alias("_seed")), width, k, [by], most)[1] for i, k in enumerate(ks)}
    return {k: centres.select(by, F.col("_centres").alias("centres")) for k, centres in found.items()}


def fit(train: DataFrame, features: list[str], by: str = "sector", k: int = 3, most: int = 300, least: int | None = None) -> DataFrame:
    """One row a group: by, n_train, middle, width, centres. Rows without a feature or group, and groups under `least` rows (k), are left out.

    Seeds are the means of k even quantile ranges of the scaled features' sum, so no run differs from another.
    """
    scale, rows, few = _scaled(train, features, by, least or k)
    return scale.join(_centred(rows, few, len(features), by, [k], most)[k], by)


def assign(rows: DataFrame, model: DataFrame, features: list[str], by: str = "sector", few: bool = True) -> DataFrame:
    """Complete rows of the model's groups with the nearest centre's number `cluster` and its squared scaled distance `gap`."""
    placed = _points(rows.dropna(subset=features), model.select(by, "middle", "width", "centres"), features, by, few)
    near = F.array_min(F.filter(F.transform("centres", lambda c, i: F.struct(_gap(F.col("_zs"), c).alias("d"), i.alias("c"))), lambda x: x["d"].isNotNull()))
    return placed.withColumn("_near", near).withColumns({"cluster": F.col("_near.c"), "gap": F.col("_near.d")}).drop("_near", "_zs", "middle", "width", "centres")


def priorities(assigned: DataFrame, volatility: list[str], beta: list[str], by: str = "sector", more: dict[str, list[str]] | None = None) -> DataFrame:
    """Clusters of each group by risk, calmest first: priority from 1, risk_score, and means in the features' own units.

    Each lookback's volatility, and mean of absolute beta, is ranked between the clusters; ranks are averaged over lookbacks and the two
    families count half each. Equal scores go to the smaller cluster number. more: names of further means, over groups of columns.
    """
    columns = {"volatility": volatility, "abs_beta": beta, **(more or {})}
    value = lambda family, c: F.abs(c) if family == "abs_beta" else F.col(c)
    means = assigned.groupBy(by, "cluster").agg(F.count("*").alias("train_rows"), *(F.avg(value(f, c)).alias(f"{f}__{c}") for f, cs in columns.items() for c in cs))
    ranked = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(c).alias("lookback"), F.round(f"{f}__{c}", 10).alias("mean")) for f in ("volatility", "abs_beta") for c in columns[f])))
    places = means.select(by, "cluster", ranked.alias("x")).select(by, "cluster", "x.*").withColumn("_r", average_rank("mean", by, "family", "lookback"))
    half = lambda f: F.avg(F.when(F.col("family") == f, F.col("_r"))) / 2
    scores = places.groupBy(by, "cluster").agg(F.round(half("volatility") + half("abs_beta"), 10).alias("risk_score"))
    mean = lambda f, cs: (sum((F.col(f"{f}__{c}") for c in cs[1:]), F.col(f"{f}__{cs[0]}")) / len(cs)).alias(f"{f}_mean")
    out = means.select(by, "cluster", "train_rows", *(mean(f, cs) for f, cs in columns.items())).join(scores, [by, "cluster"])
    return out.withColumn("priority", F.row_number().over(Window.partitionBy(by).orderBy("risk_score", "cluster")))


def select(candidates: DataFrame, ranks: DataFrame, families: dict[str, tuple[list[str], bool]], n: int, by: str = "sector") -> DataFrame:
    """The n best candidates of each date and group: calmest cluster first, then the selection score, then the ticker.

    families: name -> (columns, whether more is better); a family's score is the mean of its columns' percentile ranks within date
    and group. volatility and beta (absolute) make stability, the other families profitability, and both count half.
    """

    def score(columns: list[str], up: bool) -> Column:
        n_known = lambda c: F.count(c).over(Window.partitionBy("date", by))
        each = [percentile_rank(c, "date", by) if up else (n_known(c) + 1 - average_rank(c, "date", by)) / n_known(c) for c in columns]
        return sum(each[1:], each[0]) / len(each)

    rows = candidates.withColumns({c: F.abs(c) for c in families["beta"][0]}) if "beta" in families else candidates
    rows = rows.withColumns({f"{f}_score": score(*x) for f, x in families.items()})
    mean = lambda names: sum((F.col(f"{f}_score") for f in names[1:]), F.col(f"{names[0]}_score")) / len(names)
    calm = [f for f in families if f in ("volatility", "beta")]
    rows = rows.withColumns({"stability_score": mean(calm), "profitability_score": mean([f for f in families if f not in calm])})
    rows = rows.withColumn("selection_score", F.round((F.col("stability_score") + F.col("profitability_score")) / 2, 10))
    rows = rows.join(F.broadcast(ranks.select(by, "cluster", "priority")), [by, "cluster"])  # one row a cluster
    place = F.row_number().over(Window.partitionBy("date", by).orderBy("priority", F.desc("selection_score"), "ticker"))
    return rows.withColumn("selection_rank", place).filter(F.col("selection_rank") <= n)


def pairwise_silhouette(points: DataFrame, by: str) -> DataFrame:
    """Mean silhouette of each group by Euclidean distances between all its points (_zs, cluster); 0 for a point alone in its cluster.

    A group's points lie in one array a cluster, and each point sums its distances to them: groups must be bounded, as samples are.
    """
    sets = points.groupBy(by, "cluster").agg(F.collect_list("_zs").alias("zs")).groupBy(by).agg(F.collect_list(F.struct("cluster", "zs")).alias("_sets"))
    away = F.transform("_sets", lambda s: F.struct(
        F.aggregate(s["zs"], F.lit(0.0), lambda acc, z: acc + F.sqrt(F.aggregate(F.zip_with(F.col("_zs"), z, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, d: t + d))).alias("d"),
        F.size(s["zs"]).alias("n"), (s["cluster"] == F.col("cluster")).alias("own")))
    rows = points.join(sets, by).withColumn("_away", away)
    own = F.filter("_away", lambda x: x["own"])[0]
    a, b = own["d"] / F.nullif(own["n"] - 1, F.lit(0)), F.array_min(F.transform(F.filter("_away", lambda x: ~x["own"]), lambda x: x["d"] / x["n"]))
    fit_ = F.when(own["n"] < 2, 0.0).otherwise(F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0)))
    return rows.groupBy(by).agg(F.avg(fit_).alias("silhouette"), F.count("*").alias("n_sample"))


def choose_k(train: DataFrame, features: list[str], keys: list[str], ks: tuple[int, ...] = (2, 3, 4, 5, 6), sample: int = 2000, seed: int = 42, most: int = 300) -> DataFrame:
    """For each k: inertia over all rows, and the pairwise silhouette of at most `sample` of them, the same ones for every k.

    The sample is the first rows in the order of a hash of their keys; its bound keeps the pairs of distances within sample squared.
    """
    full = train.dropna(subset=features).withColumn("_all", F.lit("all"))
    some = cut(seeded_sample(full, keys, sample, seed).select(*keys, "_all", *features))
    scale, rows, few = _scaled(full, features, "_all", min(ks))
    models = _centred(rows, few, len(features), "_all", list(ks), most)
    every = scale
    for k, model in models.items():
        every = every.join(model.withColumnRenamed("centres", f"_centres{k}"), "_all")
    every = cut(every)  # one row
    gap = lambda k: F.array_min(F.transform(f"_centres{k}", lambda c: _gap(F.col("_zs"), c)))
    sums = rows.join(F.broadcast(every), "_all").agg(F.count("*").alias("n_rows"), *(F.sum(gap(k)).alias(f"_inertia{k}") for k in ks))
    placed, out = _points(some, every, features, "_all", True), None
    sums = cut(sums)  # one row
    for k in ks:
        near = F.array_min(F.transform(f"_centres{k}", lambda c, i: F.struct(_gap(F.col("_zs"), c).alias("d"), i.alias("c"))))
        fits = pairwise_silhouette(placed.select("_all", "_zs", near["c"].alias("cluster")), "_all")
        part = fits.select("silhouette", "n_sample").crossJoin(sums).select(F.lit(k).alias("k"), "silhouette", F.col(f"_inertia{k}").alias("inertia"), "n_sample", "n_rows")
        out = part if out is None else out.unionByName(part)
    return out
