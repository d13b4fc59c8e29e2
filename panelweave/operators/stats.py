"""Evaluation statistics and dependence-aware inference."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.xsec import average_rank, buckets


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null, not an error, where a column is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def daily_ic(df: DataFrame, pred: str, target: str, by: tuple[str, ...] = ("date",), least: int = 5) -> DataFrame:
    """Spearman correlation of each date, ranks taken where both are known."""
    rows = df.filter(F.col(pred).isNotNull() & F.col(target).isNotNull()).select(*by, pred, target)
    rows = rows.withColumn("_p", average_rank(pred, *by)).withColumn("_t", average_rank(target, *by))
    out = rows.groupBy(*by).agg(correlation("_p", "_t").alias("ic"), F.count("*").alias("n"), F.countDistinct(pred).alias("_a"), F.countDistinct(target).alias("_b"))
    return out.filter((F.col("n") >= least) & (F.col("_a") > 1) & (F.col("_b") > 1)).drop("_a", "_b")


def ic_summary(ic: DataFrame, *by: str) -> DataFrame:
    g = ic.groupBy(*by) if by else ic.groupBy()
    return g.agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0))).alias("ic_ir"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), F.count("*").alias("n_days"))


def quantile_spread(df: DataFrame, pred: str, target: str, q: int = 5) -> DataFrame:
    """By date: mean target of the top and bottom bucket, bucketed before targets are looked at; settled where all of both are known."""
    rows = buckets(df.filter(F.col(pred).isNotNull()), pred, q)
    top, bottom = F.col("bucket") == q, F.col("bucket") == 1
    out = rows.groupBy("date").agg(F.avg(F.when(top, F.col(target))).alias("top"), F.avg(F.when(bottom, F.col(target))).alias("bottom"), F.coalesce(F.bool_and(F.when(top | bottom, F.col(target).isNotNull())), F.lit(False)).alias("settled"), F.count("*").alias("n"))
    return out.withColumn("spread", F.col("top") - F.col("bottom"))


def bucket_coverage(df: DataFrame, pred: str, target: str, q: int = 5) -> DataFrame:
    rows = buckets(df.filter(F.col(pred).isNotNull()), pred, q)
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count(target).alias("n_target"), F.avg(target).alias("mean_target"))


def running_sums(counts: DataFrame, value: str, columns: list[str], descending: bool = False, slices: int = 64) -> DataFrame:
    """Adds <column>_to: the sum of a column over all rows up to this one in the order of value, rows of one value together counting once.

    counts has one row a value. The values are cut into slices at approximate quantiles; each slice is summed on its own
    and starts from the total of those before, so no task sees all values. Only one row a slice is broadcast.
    """
    cuts = counts.approxQuantile(value, [i / slices for i in range(1, slices)], 0.002)
    place = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col(value))) if cuts else F.lit(0)
    rows = counts.withColumn("_slice", -place if descending else place)
    inside = Window.partitionBy("_slice").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    totals = rows.groupBy("_slice").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    totals = totals.select("_slice", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    rows = rows.join(F.broadcast(totals), "_slice")
    return rows.withColumns({f"{c}_to": F.sum(c).over(inside) + F.col(f"_{c}") for c in columns}).drop("_slice", *(f"_{c}" for c in columns))


def pooled_ic(df: DataFrame, pred: str, target: str) -> DataFrame:
    """Spearman over all rows; ranks come from running counts of the distinct values."""
    rows = df.filter(F.col(pred).isNotNull() & F.col(target).isNotNull()).select(pred, target)
    for c in (pred, target):
        values = running_sums(rows.groupBy(c).agg(F.count("*").alias("_c")), c, ["_c"])
        rows = rows.join(values.select(c, (F.col("_c_to") - (F.col("_c") - 1) / 2.0).alias(f"_r_{c}")), c)
    return rows.agg(F.corr(f"_r_{pred}", f"_r_{target}").alias("pooled_ic"), F.count("*").alias("n"))


def partial_ic(df: DataFrame, pred: str, target: str, controls: list[str]) -> DataFrame:
    """By date, the correlation of ranks given ranked controls, by the recursion of partial correlations."""
    names = [pred, target, *controls]
    rows = df.dropna(subset=names).select("date", *names)
    rows = rows.select("date", *(average_rank(c, "date").alias(f"r{i}") for i, c in enumerate(names)))
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    out = rows.groupBy("date").agg(F.count("*").alias("n"), *(F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs))

    def given(i: int, j: int, left: tuple[int, ...]) -> Column:
        if not left:
            return F.col(f"c{max(i, j)}_{min(i, j)}")
        k, rest = left[-1], left[:-1]
        a, b, c = given(i, j, rest), given(i, k, rest), given(j, k, rest)
        return (a - b * c) / F.sqrt(F.nullif((1 - b * b) * (1 - c * c), F.lit(0)))

    return out.select("date", "n", F.col("c1_0").alias("raw_ic"), given(0, 1, tuple(range(2, len(names)))).alias("incremental_ic"))


def neutralised(df: DataFrame, value: str, controls: list[str], by: str = "date") -> DataFrame:
    """Residual of the value's rank on the controls' ranks within the date, one control after another, each itself freed of those before."""
    rows = df.dropna(subset=[value, *controls])
    w = Window.partitionBy(by)
    rows = rows.withColumn("_y", average_rank(value, by)).withColumns({f"_x{i}": average_rank(c, by) for i, c in enumerate(controls)})

    def free(y: str, x: str) -> Column:
        slope = F.covar_pop(y, x).over(w) / F.nullif(F.var_pop(x).over(w), F.lit(0))
        return F.col(y) - F.avg(y).over(w) - F.coalesce(slope, F.lit(0.0)) * (F.col(x) - F.avg(x).over(w))

    for i in range(len(controls)):
        rows = rows.withColumns({"_y": free("_y", f"_x{i}"), **{f"_x{j}": free(f"_x{j}", f"_x{i}") for j in range(i + 1, len(controls))}})
    sd = F.stddev_pop("_y").over(w)
    return rows.withColumn("residual", F.when(sd > 1e-10, F.col("_y"))).drop("_y", *(f"_x{i}" for i in range(len(controls))))


def autocorrelation(series: DataFrame, value: str, lags: list[int], order: str = "date") -> DataFrame:
    """Correlation of an ordered series with itself at each lag."""
    rows = series.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)))
    later = rows.select((F.col("_i") + F.col("lag")).alias("_i"), "lag", F.col(value).alias("_v")) if "lag" in rows.columns else rows.select("_i", F.col(value).alias("_v")).crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in lags], "lag int"))).withColumn("_i", F.col("_i") + F.col("lag"))
    return rows.join(later, "_i").groupBy("lag").agg(F.corr(value, "_v").alias("autocorrelation"), F.count("*").alias("n"))


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal by a rational approximation (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 0.3989422804014327 * F.exp(-x * x / 2) * poly


def hac_mean(series: DataFrame, value: str, max_lag: int, order: str = "date") -> DataFrame:
    """Mean with Bartlett-weighted standard error, t and two-sided p; lags by an equi-join on i + k."""
    rows = series.filter(F.col(value).isNotNull()).select(order, F.col(value).alias("_v")).withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)))
    mean = rows.agg(F.avg("_v").alias("mean"), F.count("*").alias("n"))
    rows = rows.crossJoin(F.broadcast(mean)).withColumn("_u", F.col("_v") - F.col("mean"))
    ahead = rows.select(F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"), "_i", F.col("_u").alias("_w")).withColumn("_i", F.col("_i") + F.col("lag"))
    cov = rows.join(ahead, "_i").groupBy("lag").agg(F.sum(F.col("_u") * F.col("_w")).alias("s"))
    total = cov.agg(F.sum(F.when(F.col("lag") == 0, F.col("s")).otherwise(2 * (1 - F.col("lag") / (max_lag + 1)) * F.col("s"))).alias("s"))
    out = mean.crossJoin(total).withColumn("se", F.when((F.col("n") > 1) & (F.col("s") > 0), F.sqrt(F.col("s")) / F.col("n")))
    return out.withColumn("t", F.col("mean") / F.col("se")).withColumn("p", 2 * normal_tail(F.col("t"))).withColumn("max_lag", F.lit(max_lag)).drop("s")


def hac_grid(series: DataFrame, value: str, lags: list[int], order: str = "date") -> DataFrame:
    """The mean's test of hac_mean at several greatest lags: max_lag, mean, n, se, t, p; products of all lags are summed in one pass."""
    rows = series.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"), F.row_number().over(Window.orderBy(order)).alias("_i"))  # one row a date
    mean = rows.agg(F.avg("_v").alias("mean"), F.count("*").alias("n"))
    rows = rows.crossJoin(F.broadcast(mean)).select("_i", (F.col("_v") - F.col("mean")).alias("_u"))  # mean is one row
    ahead = rows.select(F.explode(F.sequence(F.lit(0), F.lit(max(lags)))).alias("_k"), "_i", F.col("_u").alias("_w")).withColumn("_i", F.col("_i") + F.col("_k"))
    sums = rows.join(ahead, "_i").groupBy("_k").agg(F.sum(F.col("_u") * F.col("_w")).alias("_s"))
    grid = sums.withColumn("max_lag", F.explode(F.array(*map(F.lit, lags)))).filter("_k <= max_lag")
    weight = F.when(F.col("_k") == 0, 1.0).otherwise(2 * (1 - F.col("_k") / (F.col("max_lag") + 1)))
    out = grid.groupBy("max_lag").agg(F.sum(weight * F.col("_s")).alias("_s")).crossJoin(F.broadcast(mean))
    out = out.withColumn("se", F.when((F.col("n") > 1) & (F.col("_s") > 0), F.sqrt(F.greatest("_s", F.lit(0.0))) / F.col("n"))).withColumn("t", F.col("mean") / F.nullif(F.col("se"), F.lit(0.0)))
    return out.select("max_lag", "mean", "n", "se", "t", (2 * normal_tail(F.col("t"))).alias("p"))


def evaluation(df: DataFrame, pred: str, target: str, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """One row: daily IC's mean, deviation, ratio and hit rate, the pooled IC, and how many rows and dates have a score and a target."""
    summary = ic_summary(daily_ic(df, pred, target, by))
    scored, both = F.col(pred).isNotNull(), F.col(pred).isNotNull() & F.col(target).isNotNull()
    counts = df.agg(F.count("*").alias("n_rows"), F.count(F.when(scored, 1)).alias("n_scored"), F.count(F.when(both, 1)).alias("n_evaluated"), F.countDistinct(F.when(both, F.struct(*by))).alias("n_dates"))
    counts = counts.withColumn("coverage", F.col("n_evaluated") / F.nullif(F.col("n_scored"), F.lit(0)))
    return summary.crossJoin(pooled_ic(df, pred, target).select("pooled_ic")).crossJoin(counts)  # each is one row


def draw(*parts) -> Column:
    """A reproducible whole number from text: the first eight hexadecimal digits of its md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def block_bootstrap(series: DataFrame, value: str, block: int, calendar: DataFrame | None = None, n_boot: int = 1000, seed: int = 42, least_blocks: int = 10, order: str = "date") -> DataFrame:
    """Moving-block bootstrap of a mean over the calendar's span of the series: estimate, interval, two-sided p and a status.

    The interval reflects the quantiles of the centred means, p counts centred means at least as far out as the estimate. Both are null with fewer than
    least_blocks whole blocks (insufficient_blocks) or where the calendar has a date that the series lacks (calendar_gaps_in_metric).
    """
    if calendar is not None:
        ends = series.filter(F.col(value).isNotNull()).agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
        span = calendar.crossJoin(F.broadcast(ends)).filter(F.col(order).between(F.col("_a"), F.col("_b"))).agg(F.count("*").alias("span"))
    else:
        span = series.filter(F.col(value).isNotNull()).agg(F.count("*").alias("span"))
    rows = series.filter(F.col(value).isNotNull()).select(order, F.col(value).alias("v")).withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1).select("i", "v")
    size = rows.agg(F.count("*").alias("n"), F.avg("v").alias("estimate")).crossJoin(span)
    size = size.withColumn("status", F.when(F.col("span") > F.col("n"), "calendar_gaps_in_metric").when(F.floor(F.col("span") / block) < least_blocks, "insufficient_blocks").otherwise("conditional_inference"))
    draws = size.filter("status = 'conditional_inference'").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    draws = draws.withColumn("start", draw(F.lit(str(seed)), "rep", "b") % (F.col("n") - block + 1)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    draws = draws.filter(F.col("b") * block + F.col("k") < F.col("n")).withColumn("i", F.col("start") + F.col("k"))
    means = draws.join(F.broadcast(rows), "i").groupBy("rep").agg((F.avg("v") - F.first("estimate")).alias("c"), F.first("estimate").alias("e"))
    means = means.withColumn("c", F.round("c", 12))
    out = means.agg(F.percentile("c", F.lit(0.975)).alias("_high"), F.percentile("c", F.lit(0.025)).alias("_low"), ((F.count(F.when(F.abs("c") >= F.abs("e"), 1)) + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("_reps"))
    out = size.crossJoin(out).withColumn("p", F.when(F.col("_reps") > 0, F.col("p")))
    return out.select("estimate", (F.col("estimate") - F.col("_high")).alias("ci_low"), (F.col("estimate") - F.col("_low")).alias("ci_high"), "p", "n", F.floor(F.col("span") / block).alias("full_blocks"), "status")


#: Steps of md5: rotations of its four rounds, the word that a step takes, the sine that it adds; rows that are hashed at once, numbers that are held at once.
TURNS = [((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i >> 4][i & 3] for i in range(64)]
PLACES = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i >> 4] for i in range(64)]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SHIFTS = [np.array(k, np.uint32) for k in range(33)]
HASHED, DRAWN = 32768, 1 << 22


def md5_heads(words: list, size: int) -> np.ndarray:
    """The first word of the md5 of `size` messages of one block; words are its sixteen, each an int that all share or an array of uint32.

    Only the first word is wanted, which the last three of the 64 steps leave alone. Steps before the first array are done once for all.
    """
    begun, (a, b, c, d) = 0, START
    while begun < 16 and isinstance(words[begun], int):
        t = ((d ^ (b & (c ^ d))) + a + words[begun] + SINES[begun]) & 0xFFFFFFFF
        a, b, c, d, begun = d, (b + (t << TURNS[begun] | t >> (32 - TURNS[begun]))) & 0xFFFFFFFF, b, c, begun + 1
    a, b, c, d = (np.full(size, x, np.uint32) for x in (a, b, c, d))
    t, u = np.empty(size, np.uint32), np.empty(size, np.uint32)
    xor, both, add = np.bitwise_xor, np.bitwise_and, np.add
    for i in range(begun, 61):
        word, sine = words[PLACES[i]], SINES[i]
        if i < 16:
            xor(c, d, t)
            both(t, b, t)
            xor(t, d, t)
        elif i < 32:
            xor(b, c, t)
            both(t, d, t)
            xor(t, c, t)
        elif i < 48:
            xor(b, c, t)
            xor(t, d, t)
        else:
            np.invert(d, t)
            np.bitwise_or(t, b, t)
            xor(t, c, t)
        add(t, a, t)
        if isinstance(word, int):
            sine = sine + word & 0xFFFFFFFF
        else:
            add(t, word, t)
        add(t, np.array(sine, np.uint32), t)
        np.left_shift(t, SHIFTS[TURNS[i]], u)
        np.right_shift(t, SHIFTS[32 - TURNS[i]], t)
        np.bitwise_or(t, u, t)
        add(t, b, t)
        a, b, c, d, t = d, t, b, c, a
    return b + np.uint32(START[0])


def drawn_numbers(prefixes: list[bytes], names: list[bytes]) -> np.ndarray:
    """`draw` of every prefix followed by every name, a row a prefix; the prefixes are of one length.

    Messages of one block are hashed side by side, names of one length together; longer ones one after another.
    """
    out, before = np.empty((len(prefixes), len(names)), np.uint32), len(prefixes[0])
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    heads = np.frombuffer(b"".join(p[:64].ljust(64, b"\0") for p in prefixes), "<u4").reshape(-1, 16)
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        if before + length > 55:
            for row, prefix in zip(out, prefixes, strict=True):
                begin = hashlib.md5(prefix)
                for i in own.tolist():
                    h = begin.copy()
                    h.update(names[i])
                    row[i] = int.from_bytes(h.digest()[:4], "big")
            continue
        first, last = before // 4, (before + length) // 4  # the words that names reach
        block = np.zeros((len(own), 4 * (last + 1 - first)), np.uint8)
        block[:, before % 4 : before % 4 + length] = np.frombuffer(b"".join(names[i] for i in own.tolist()), np.uint8).reshape(len(own), length)
        block[:, before % 4 + length] = 0x80
        tails = np.ascontiguousarray(block.view("<u4").T)
        some = max(1, HASHED // len(own))  # prefixes at once: one, unless names are few
        for r in range(0, len(prefixes), some):
            head = heads[r : r + some]
            for at in range(0, len(own), HASHED):
                tail, words = tails[:, at : at + HASHED], [0] * 14 + [8 * (before + length), 0]
                for w in range(last + 1):
                    if w >= first:
                        words[w] = (head[:, w, None] | tail[None, w - first]).ravel()
                    else:
                        words[w] = int(head[0, w]) if len(head) == 1 else np.repeat(head[:, w], tail.shape[1])
                found = md5_heads(words, len(head) * tail.shape[1]).byteswap().reshape(len(head), -1)
                out[r : r + some, own[at : at + HASHED]] = found
    return out


def end_means(place: np.ndarray, t: np.ndarray, n_low: int, n_top: int) -> float | None:
    """Mean of t over the n_top rows of the highest place less that over the n_low of the lowest, equal places in the order of rows; None without either."""
    n = len(t)
    if not n_low or not n_top:
        return None
    low_at, top_at = (np.partition(place, k)[k] for k in (n_low - 1, n - n_top))
    low, top = np.flatnonzero(place < low_at), np.flatnonzero(place > top_at)
    if len(low) < n_low:
        low = np.sort(np.append(low, np.flatnonzero(place == low_at)[: n_low - len(low)]))
    if len(top) < n_top:
        top = np.sort(np.append(top, np.flatnonzero(place == top_at)[len(top) - n_top :]))
    return float(t[top].mean() - t[low].mean())


def permutation_null(df: DataFrame, pred: str, target: str, q: int = 5, reps: int = 50, seed: int = 42, blocks: int = 8) -> DataFrame:
    """Within-date permutations of the pick: how often a random top-less-bottom spread reaches the observed one (plus-one p).

    A replicate orders a date's names by `draw` of it, the date and the ticker; only the sets at both ends of that order count. A date's rows are read once and packed
    into one; the packed row goes to `blocks` tasks, each of which draws its share of the replicates.
    """
    rows = buckets(df.dropna(subset=[pred, target]), pred, q).select("date", F.col("date").cast("string").alias("day"), F.col("ticker").cast("string").alias("ticker"), "bucket", F.col(target).cast("double").alias("t"))

    def packed(key, table):
        table = table.take(pc.sort_indices(table["ticker"].cast(pa.binary())))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return pa.table({"date": pa.array([key[0].as_py()], table.schema.field("date").type), "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def drawn(key, one):
        table = pa.ipc.open_stream(one["packed"][0].as_py()).read_all()
        names, t, bucket = [x.encode() for x in table["ticker"].to_pylist()], np.asarray(table["t"]), np.asarray(table["bucket"])
        day, n_top, n_low = table["day"][0].as_py(), int((bucket == q).sum()), int((bucket == 1).sum())
        numbers = list(range(key[1].as_py(), reps, min(blocks, reps)))
        out = [(-1, end_means(np.where(bucket == 1, 0, np.where(bucket == q, 2, 1)), t, n_low, n_top))] if key[1].as_py() == 0 else []
        for digits in sorted({len(str(r)) for r in numbers}):
            own = [r for r in numbers if len(str(r)) == digits]
            step = max(1, DRAWN // len(names))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                places = drawn_numbers([f"{seed}|{rep}|{day}|".encode() for rep in some], names)
                out += [(rep, end_means(place, t, n_low, n_top)) for rep, place in zip(some, places, strict=True)]
        return pa.table({"rep": pa.array([r for r, _ in out], pa.int32()), "s": pa.array([s for _, s in out], pa.float64())})

    held = rows.groupBy("date").applyInArrow(packed, T.StructType([rows.schema["date"], T.StructField("packed", T.BinaryType())]))
    copies = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(min(blocks, reps) - 1))))
    copies = copies.repartition(25 * blocks, "date", "block")  # few bytes, much work: tasks must not be merged by their size
    means = copies.groupBy("date", "block").applyInArrow(drawn, "rep int, s double").groupBy("rep").agg(F.avg("s").alias("m"))
    means = means.withColumn("observed", F.max(F.when(F.col("rep") < 0, F.col("m"))).over(Window.partitionBy(F.lit(0))))  # one row a replicate
    drawn_only = F.col("rep") >= 0
    return means.agg(F.first("observed").alias("observed"), ((F.count(F.when(drawn_only & (F.col("m") >= F.col("observed")), 1)) + 1) / (F.count(F.when(drawn_only, 1)) + 1)).alias("p"), F.count(F.when(drawn_only, 1)).alias("reps"))


def capm(daily: DataFrame, r: str, m: str) -> DataFrame:
    return daily.dropna(subset=[r, m]).agg(F.regr_slope(r, m).alias("beta"), F.regr_intercept(r, m).alias("alpha"), F.regr_r2(r, m).alias("r2"), F.count("*").alias("n"))


def market_beta(daily: DataFrame, by: list[str], r: str, m: str, rf: str, hac_lag: int, year: int = 252, least: int = 30, order: str = "date") -> DataFrame:
    """Regression of excess returns on the market's by group, with Bartlett-weighted (HAC) standard errors: one row a group.

    alpha_ann_arithmetic is the session's alpha times `year`; intervals are 1.96 standard errors wide on both sides, p is normal, and the
    covariance is scaled by n / (n - 2). status: ok, insufficient_data under `least` sessions, constant_market where it does not move; in both
    of the latter all estimates are null. hac_lag is cut to n - 1. One pass sums products, a second those of residual scores at every lag.
    """
    rows = daily.select(*by, order, (F.col(r) - F.col(rf)).alias("_y"), (F.col(m) - F.col(rf)).alias("_x"))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    fit = rows.groupBy(*by).agg(
        F.count("*").alias("n_days"), F.regr_slope("_y", "_x").alias("_b"), F.regr_intercept("_y", "_x").alias("_a"), F.var_pop("_x").alias("_v"), F.sum("_x").alias("_sx"), F.sum(F.col("_x") * F.col("_x")).alias("_sxx"),
        (F.var_pop("_y") * F.count("*")).alias("_total"), (F.max("_x") > F.min("_x")).alias("_moves"),
    )
    status = F.when(F.col("n_days") < least, "insufficient_data").when(~F.col("_moves"), "constant_market").otherwise("ok")
    fit = fit.withColumn("status", status).withColumn("hac_lag", F.least(F.lit(hac_lag), F.col("n_days").cast("int") - 1))
    rows = rows.join(fit.filter("status = 'ok'").select(*by, "_a", "_b", "hac_lag"), by)
    rows = rows.select(*by, "_i", "_x", "hac_lag", (F.col("_y") - F.col("_a") - F.col("_b") * F.col("_x")).alias("_u"))
    ahead = rows.select(*by, F.explode(F.sequence(F.lit(0), F.col("hac_lag"))).alias("_k"), "_i", "_x", "_u")
    ahead = ahead.select(*by, "_k", (F.col("_i") + F.col("_k")).alias("_i"), F.col("_x").alias("_x1"), F.col("_u").alias("_u1"))
    weight = F.when(F.col("_k") == 0, 1.0).otherwise(2 * (1 - F.col("_k") / (F.col("hac_lag") + 1)))
    both = F.col("_u") * F.col("_u1") * weight
    meat = rows.join(ahead, [*by, "_i"]).groupBy(*by).agg(
        F.sum(both).alias("_m00"), F.sum(both * (F.col("_x") + F.col("_x1")) / 2).alias("_m01"), F.sum(both * F.col("_x") * F.col("_x1")).alias("_m11"), F.sum(F.when(F.col("_k") == 0, F.col("_u") * F.col("_u"))).alias("_rest"))
    n = F.col("n_days")
    det = F.nullif(n * n * F.col("_v"), F.lit(0.0))
    b00, b01, b11 = F.col("_sxx") / det, -F.col("_sx") / det, n / det
    spread = lambda p, q: F.sqrt(F.greatest((p * p * F.col("_m00") + 2 * p * q * F.col("_m01") + q * q * F.col("_m11")) * n / F.nullif(n - 2, F.lit(0)), F.lit(0.0)))
    out = fit.join(meat, by, "left").withColumns({"_sa": spread(b00, b01), "_sb": spread(b01, b11)})
    ok, t = F.col("status") == "ok", F.col("_a") / F.when(F.col("_sa") > 1e-15, F.col("_sa"))
    values = {
        "alpha_daily": F.col("_a"), "alpha_ann_arithmetic": F.col("_a") * year, "beta": F.col("_b"), "alpha_hac_t": t, "alpha_p_normal": 2 * normal_tail(t),
        "alpha_ann_ci_low": (F.col("_a") - 1.96 * F.col("_sa")) * year, "alpha_ann_ci_high": (F.col("_a") + 1.96 * F.col("_sa")) * year,
        "beta_ci_low": F.col("_b") - 1.96 * F.col("_sb"), "beta_ci_high": F.col("_b") + 1.96 * F.col("_sb"), "r_squared": 1 - F.col("_rest") / F.nullif(F.col("_total"), F.lit(0.0)),
    }
    return out.select(*by, "n_days", *(F.when(ok, v).alias(c) for c, v in values.items()), "hac_lag", "status")


def classification(df: DataFrame, label: str, predicted: str, score: str) -> DataFrame:
    """Confusion counts and rates, ROC-AUC by rank sums and average precision, from counts of distinct scores."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    n = lambda c: F.count(F.when(c, 1))
    counts = df.agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn"))
    steps = df.groupBy(score).agg(n(y).alias("pos"), n(~y).alias("neg"))
    steps = running_sums(steps.withColumn("all", F.col("pos") + F.col("neg")), score, ["pos", "all"], descending=True)
    areas = steps.agg((F.sum(F.col("neg") * (F.col("pos_to") - F.col("pos") / 2.0)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("roc_auc"), (F.sum(F.col("pos") * F.col("pos_to") / F.col("all_to")) / F.nullif(F.sum("pos"), F.lit(0))).alias("pr_auc"))
    out = counts.crossJoin(areas)
    precision, recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return out.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.dropna(subset=[y, p]).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0))).alias("r2"), F.count("*").alias("n"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = successes / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def paired_exact(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of b against c discordant pairs at one half, by summing the tail's terms."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("total"))

    def step(acc, i):
        term = acc["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def refit_comparison(df: DataFrame, label: str, confirm: int) -> DataFrame:
    """One row: recall and average precision of all_pred/all_score and own_pred/own_score on the same rows, and the exact test on rows that one finds."""
    y, a, b = F.col(label) == 1, F.col("all_pred") == 1, F.col("own_pred") == 1
    n = lambda c: F.count(F.when(c, 1))
    counts = df.agg(n(y).alias("actual_risky_n"), n(y & a).alias("_a"), n(y & b).alias("_b"), n(y & a & ~b).alias("_only_a"), n(y & b & ~a).alias("_only_b"))
    area = lambda p: classification(df, label, f"{p}_pred", f"{p}_score").select(F.col("pr_auc").alias(f"{p}_pr_auc"))
    hit = lambda c: F.coalesce(F.col(c) / F.nullif("actual_risky_n", F.lit(0)), F.lit(0.0))
    apart = F.col("_only_a") + F.col("_only_b")
    out = counts.crossJoin(area("all")).crossJoin(area("own"))
    return out.select(
        "actual_risky_n", F.when(F.col("actual_risky_n") >= confirm, "CONFIRMATORY").otherwise("EXPLORATORY").alias("status"), hit("_a").alias("global_recall"), hit("_b").alias("sector_refit_recall"),
        (hit("_b") - hit("_a")).alias("delta_recall"), F.col("all_pr_auc").alias("global_pr_auc"), F.col("own_pr_auc").alias("sector_pr_auc"), apart.alias("discordant_pairs"),
        F.when(apart > 0, paired_exact(F.col("_only_a"), F.col("_only_b"))).alias("paired_exact_p"),
    )


def redundancy(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.dropna(subset=[a, b]).agg(F.corr(a, b).alias("pearson"), (1 / F.nullif(1 - F.pow(F.corr(a, b), 2), F.lit(0.0))).alias("vif"), F.count("*").alias("n"))


def redundancy_by(df: DataFrame, a: str, b: str, by: str = "date") -> DataFrame:
    """By group: Pearson and Spearman correlation of two columns and the variance inflation of both together."""
    rows = df.dropna(subset=[a, b]).withColumns({"_a": average_rank(a, by), "_b": average_rank(b, by)})
    out = rows.groupBy(by).agg(F.count("*").alias("n"), correlation(a, b).alias("pearson"), correlation("_a", "_b").alias("spearman"))
    return out.withColumn("vif", 1 / F.nullif(1 - F.col("pearson") * F.col("pearson"), F.lit(0.0)))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*(F.corr(a, b).alias(f"{a}__{b}") for i, a in enumerate(columns) for b in columns[i:]))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for i, a in enumerate(columns) for b in columns[i:]))).alias("x")).select("x.*")


def dispersion(df: DataFrame, pred: str, target: str) -> DataFrame:
    return df.dropna(subset=[pred, target]).agg((F.stddev_samp(pred) / F.nullif(F.stddev_samp(target), F.lit(0))).alias("ratio"), F.count("*").alias("n"))
