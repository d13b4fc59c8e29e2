"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel compares two words by the character subsequences of lengths 4 and 5 that they
share inside a window, each weighted by decay to the power of the span it covers, so
characters inserted into an insult or left out of it cost a little and do not hide it. The machine learns
from labelled sentences: a sentence of a clean document is clean throughout, a sentence of
a toxic one may hold a toxic unit (multiple instances). Landmarks span the kernel's
Nystrom space. The trained sum over landmarks is linear in the subsequences that they
hold, so it folds into one table of subsequence weights without change of result, and
scoring costs a few look-ups a character however many landmarks there are.
"""

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import CACHE_WORDS, code_points, crc_mod, freeing, hold, letter_words, slices, whole_texts

#: Characters that one subsequence may span, and the kernel's decay for each.
SPAN, DECAY = 6, 0.7
#: Each character in 6 bits: a to z, one class for word ends, 36 for other letters, 0 for none.
EDGE = 27
#: Entries of the table of subsequence weights.
TABLE = 1 << 21
PATTERNS = [x for n in (3, 4) for x in itertools.combinations(range(1, SPAN), n)]


def alphabet(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 97) & (points <= 122), points - 96, 28 + points % 36).astype(np.int64)


def lay_out(words: pa.Array):
    """All words on end, edges marked and gaps of zeros between; (characters, starts, lengths with edges)."""
    points, n = code_points(words)
    size = n + 2
    starts = np.r_[0, np.cumsum(size + SPAN)][:-1]
    flat = np.zeros(int((size + SPAN).sum()) + SPAN, np.int64)
    flat[starts], flat[starts + size - 1] = EDGE, EDGE
    inside = np.repeat(starts + 1 - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(len(points))
    flat[inside] = alphabet(points)
    return flat, starts, size


def subsequences(flat: np.ndarray):
    """For each pattern of offsets: (number of the subsequence at every position, 0 where it leaves the word; weight)."""
    m = len(flat) - SPAN
    first = flat[:m]
    for offsets in PATTERNS:
        u, last = first, flat[offsets[-1] : m + offsets[-1]]
        for d in offsets:
            u = u * 64 + flat[d : m + d]
        # 24 or 30 bits, hashed into the lower or the upper half of the table
        u = (((u + 1) * 0x9E3779B1 & 0xFFFFFFFF) >> 12) + (1 << 20 if len(offsets) == 4 else 0)
        yield np.where((last > 0) & (first > 0), u, 0), DECAY ** (offsets[-1] + 1)


def floor_norm(size: np.ndarray) -> np.ndarray:
    """The kernel norm of a word of that length if all its subsequences differ; the true norm is no smaller."""
    return np.sqrt(sum(DECAY ** (2 * (x[-1] + 1)) * np.maximum(size - x[-1], 0) for x in PATTERNS) + 1e-9)


def features(words: pa.Array):
    """Sparse kernel features (word, subsequence, weight), subsequences of one word summed, words at norm 1."""
    flat, starts, size = lay_out(words)
    of = np.zeros(len(flat), np.int64)
    of[starts] = 1
    of = np.cumsum(of) - 1
    rows, cols, vals = [], [], []
    for u, weight in subsequences(flat):
        at = np.flatnonzero(u)
        rows.append(of[at])
        cols.append(u[at])
        vals.append(np.full(len(at), weight))
    key = np.concatenate(rows) << 22 | np.concatenate(cols)
    key, inverse = np.unique(key, return_inverse=True)
    rows = key >> 22
    values = np.bincount(inverse, np.concatenate(vals), len(key))
    return rows, key & ((1 << 22) - 1), values / np.sqrt(np.bincount(rows, values**2, len(size)) + 1e-9)[rows]


@dataclass
class Machine:
    weights: np.ndarray  # of each subsequence
    bias: float
    scale: tuple[float, float]  # logistic of a text's largest unit

    def units(self, words: pa.Array) -> np.ndarray:
        """The machine's value for each word."""
        flat, starts, size = lay_out(words)
        total = np.zeros(len(flat) - SPAN, np.float32)
        for u, weight in subsequences(flat):
            total += self.weights[u] * np.float32(weight)
        sums = np.add.reduceat(total, starts) if len(starts) else np.zeros(0)
        out = sums / floor_norm(size) + self.bias
        near = np.flatnonzero(out > -0.5)  # the true norm moves only these to or from the cut
        if len(near):
            rows, cols, values = features(words.take(pa.array(near)))
            out[near] = np.bincount(rows, values * self.weights[cols], len(near)) + self.bias
        return out


def text_units(texts: pa.Array):
    """As letter_words; single letters in a row, as in a spaced-out word, also count as one unit put together."""
    words, codes, offsets = letter_words(texts, fold=True)
    one = np.asarray(pc.equal(pc.utf8_length(words), 1))[codes] if len(codes) else np.zeros(0, bool)
    more, at = [], []
    if one.any():
        edge = np.diff(np.r_[False, one, False].astype(np.int8))
        for begin, end in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            cut = offsets[(offsets > begin) & (offsets < end)] if end - begin >= 3 else ()
            for a, b in itertools.pairwise([begin, *cut, end] if end - begin >= 3 else []):
                if b - a >= 3 and len(set(codes[a:b])) > 2:
                    more.append("".join(words.take(pa.array(codes[a:b])).to_pylist()))
                    at.append(a)
    if more:
        codes = np.insert(codes, at, len(words) + np.arange(len(more)))
        offsets = offsets + np.searchsorted(at, offsets, "left")
        words = pa.concat_arrays([words, pa.array(more, words.type)])
    return words, codes, offsets


def held_out(id_column: str = "doc_id"):
    return crc_mod(id_column, 3) == 1


def _fit(positive: list[str], weight: np.ndarray, negative: list[str], against: np.ndarray, landmarks: int, penalty: float):
    """Nystrom features over landmarks and a squared-hinge machine on them, folded into subsequence weights."""
    words = pa.array([*positive, *negative])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    importance = np.r_[weight / weight.sum() * 0.5, against / against.sum() * 0.5] * len(y)
    rows, cols, vals = features(words)
    order = np.argsort(-weight, kind="stable")[: landmarks * 2 // 5]
    near = min(len(negative), landmarks - len(order))
    spread = np.r_[np.argsort(-against, kind="stable")[: near * 3 // 4], np.linspace(0, len(negative) - 1, near - near * 3 // 4).astype(int)]
    chosen = np.unique(np.r_[order, len(positive) + spread])
    space, where = np.unique(cols[np.isin(rows, chosen)], return_inverse=True)
    basis = np.zeros((len(space), len(chosen)), np.float32)
    basis[where, np.searchsorted(chosen, rows[np.isin(rows, chosen)])] = vals[np.isin(rows, chosen)]
    inside = np.isin(cols, space)
    at, kernel = np.searchsorted(space, cols[inside]), np.zeros((len(y), len(chosen)), np.float32)
    r, v = rows[inside], vals[inside]
    for part in np.array_split(np.arange(len(r)), max(1, len(r) // 20_000)):
        if len(part):
            first = np.flatnonzero(np.r_[True, np.diff(r[part]) > 0])
            kernel[r[part][first]] += np.add.reduceat(basis[at[part]] * v[part][:, None].astype(np.float32), first)
    own = kernel[chosen].astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    z = np.c_[kernel @ root.astype(np.float32), np.ones(len(y), np.float32)]
    del kernel
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(8):  # Newton's method on the squared hinge
        active = y * (z @ w) < 1
        gram, right = np.diag(ridge * len(y)), np.zeros(len(w))
        for part in np.array_split(np.flatnonzero(active), max(1, int(active.sum()) // 4000)):
            rows_, own = z[part], importance[part].astype(np.float32)
            gram += (rows_ * own[:, None]).T @ rows_
            right += rows_.T @ (own * y[part])
        new = np.linalg.solve(gram, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    beta = basis @ (root @ w[:-1])
    table = np.zeros(TABLE, np.float32)
    table[space] = beta
    return table, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", out=None, sample_rows: int = 15000, witnesses: int = 3000, negatives: int = 8000, landmarks: int = 512, penalty: float = 1e-5, purity: float = 0.05, rounds: int = 4) -> Machine:
    """Learn from the sentences of labelled documents that are not held out.

    sample_rows bounds the documents taken of each class (in expectation, by a hash of the id);
    witnesses and negatives bound the distinct units that the driver gets, each with its counts.
    Without rows of both classes the machine scores every text 0.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isNotNull()).select(id_column, (F.col("toxic") > 0).cast("int").alias("y")).groupBy(id_column).agg(F.max("y").alias("y"))
    known = known.filter(~(out if out is not None else held_out(id_column)))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    nothing = Machine(np.zeros(TABLE, np.float32), -1.0, (1.0, -8.0))
    if len(sizes) < 2:
        return nothing
    share = F.when(F.col("y") == 1, min(1.0, sample_rows / sizes[1])).otherwise(min(1.0, sample_rows / sizes[0]))
    known = known.filter(F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(1_000_000)) < share * 1_000_000)
    # at most about 2 * sample_rows ids: bounded by a parameter, so the broadcast is too
    sample = hold(whole_texts(docs, id_column).join(F.broadcast(known), id_column).select("y", "text"), "toxicity-sample")

    # one row for each different sentence, so copied documents count once; clean anywhere is clean
    sentences = sample.select("y", F.explode(F.split("text", "[.!?\\n]+")).alias("text")).filter("text <> ''").groupBy("text").agg(F.min("y").alias("y"))
    sentences = hold(sentences, "toxicity-sentences")

    def count(batches):
        """Of each unit: the sentences of either class that have it."""
        for batch in batches:
            for part in slices(batch):
                words, codes, offsets = text_units(part.column("text"))
                of = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                pair = np.unique(of.astype(np.int64) * len(words) + codes)
                toxic = np.asarray(part.column("y"))[pair // len(words)]
                unit, n = pair % len(words), len(words)
                both = np.bincount(unit[toxic == 1], minlength=n), np.bincount(unit[toxic == 0], minlength=n)
                yield pa.RecordBatch.from_arrays([words, pa.array(both[0]), pa.array(both[1])], ["unit", "toxic", "clean"])

    units = sentences.mapInArrow(freeing(count), "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.length("unit") >= 2)
    units = hold(units, "toxicity-units")
    n = sentences.groupBy("y").count().toPandas().set_index("y")["count"]
    if len(n) < 2:
        return nothing
    one, zero = float(n[1]), float(n[0])
    expected = (F.col("toxic") + F.col("clean")) * one / (one + zero)
    surprise = F.when(F.col("toxic") > expected, 2 * F.col("toxic") * F.log(F.col("toxic") / expected)).otherwise(0.0)
    pure = units.filter((F.col("toxic") >= 2) & (F.col("clean") <= purity * F.col("toxic")))
    top = pure.select("unit", "clean", surprise.alias("s")).orderBy(F.desc("s"), "unit").limit(witnesses).toPandas()
    if top.empty:
        return nothing
    asked = set(top.unit)

    def contexts(batches):
        """The different words before each candidate: near copies of one sentence count once."""
        for batch in batches:
            for part in slices(batch):
                words, codes, _ = text_units(part.column("text").filter(pc.equal(part.column("y"), 1)))
                here = np.array([w in asked for w in words.to_pylist()], bool)
                at = np.flatnonzero(here[codes]) if len(codes) else np.zeros(0, np.int64)
                pair = np.unique(codes[at].astype(np.int64) * len(words) + np.r_[0, codes][at]) if len(at) else at
                if len(pair):
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(pair // len(words))), words.take(pa.array(pair % len(words)))], ["unit", "before"])

    told = sentences.mapInArrow(freeing(contexts), "unit string, before string").groupBy("unit").agg(F.countDistinct("before").alias("toxic")).toPandas()
    top = top.merge(told, on="unit")
    # chance puts some rare words only in toxic documents: keep those too surprising for so many tries
    tries = max(units.filter("toxic > 0").count(), 2)
    top["s"] = 2 * top.toxic * np.log(np.maximum(top.toxic / ((top.toxic + top.clean) * one / (one + zero)), 1))
    sure = top[top.s >= min(2 * float(np.log(tries)), float(top.s.max()) / 2)].sort_values(["s", "unit"], ascending=[False, True])
    clean = units.filter("clean > 0").select("unit", "clean")
    common = clean.orderBy(F.desc("clean"), "unit").limit(negatives // 2).toPandas()
    other = clean.orderBy(F.xxhash64("unit")).limit(negatives // 2).toPandas()
    counts = dict(zip([*common.unit, *other.unit], [*common.clean, *other.clean], strict=True))
    positive, weight = sure.unit.tolist(), np.sqrt(sure.toxic.to_numpy(float))
    counts = {x: n for x, n in counts.items() if x not in set(positive)}
    if not counts or not len(positive):
        return nothing
    draw = np.random.default_rng(7)
    for word, w in list(zip(positive, weight, strict=True))[:64]:  # the chief insults with a character put in
        for k in draw.integers(1, max(len(word), 2), 4):
            positive.append(word[:k] + chr(97 + int(draw.integers(26))) + word[k:])
            weight = np.append(weight, w / 4)
    machine, push = nothing, {}
    for _ in range(rounds):
        table, bias = _fit(positive, weight, [*counts], np.array([np.sqrt(n) * push.get(x, 1.0) for x, n in counts.items()]), landmarks, penalty)
        machine = Machine(table, bias, (1.0, 0.0))

        def value(batches, machine=machine):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("toxic"), batch.column("clean"), pa.array(machine.units(batch.column("unit")).astype(float))], ["unit", "toxic", "clean", "f"])

        valued = units.mapInArrow(freeing(value), "unit string, toxic long, clean long, f double")
        hard = valued.filter("clean > 0 and f > -1").orderBy(F.desc("f"), "unit").limit(negatives // 4).toPandas()
        push |= {x: 4 * push.get(x, 2.0) for x, v in zip(hard.unit, hard.f, strict=True) if v > -0.3}
        counts |= {x: n for x, n in zip(hard.unit, hard.clean, strict=True) if x not in set(positive)}
    best = _largest(sample, machine, ("y",)).toPandas()
    return Machine(machine.weights, machine.bias, _logistic(best.f.to_numpy(), best.y.to_numpy(float)))


def _logistic(f: np.ndarray, y: np.ndarray, threshold: float = 0.7) -> tuple[float, float]:
    """Slope and offset of a logistic in f that passes the threshold where F1 on the labelled texts is best.

    Between the two values that the best cut separates it lies in the middle. The slope takes
    the classes' medians two to three units of the logistic's width away from the cut.
    """
    order = np.argsort(-f, kind="stable")
    f, y = f[order], y[order]
    hits, n = np.cumsum(y), np.arange(1, len(y) + 1)
    f1 = 2 * hits / (n + y.sum())
    f1[:-1][f[:-1] == f[1:]] = 0
    k = int(np.argmax(f1))
    cut = f[k] if k + 1 == len(f) else (f[k] + max(f[k + 1], f[k] - 1.0)) / 2
    slope = 8 / max(float(np.median(f[y > 0]) - np.median(f[y == 0])), 0.5)
    return slope, float(np.log(threshold / (1 - threshold)) - slope * cut)


def _largest(rows: DataFrame, machine: Machine, keep: tuple[str, ...]) -> DataFrame:
    """The machine's largest value f over the units of each whole text; -4 for a text without units."""
    head = [rows.schema[c] for c in keep]

    def score(batches):  # keep may name the text too: it comes back as it went
        seen, values = {}, np.zeros(0)
        for batch in batches:
            for part in slices(batch):
                words, codes, offsets = text_units(part.column("text"))
                words_list = words.to_pylist()
                if len(seen) > CACHE_WORDS:
                    seen, values = {}, values[:0]
                new = list(dict.fromkeys(w for w in words_list if w not in seen))
                seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
                for at in range(0, len(new), 10_000):
                    values = np.r_[values, machine.units(pa.array(new[at : at + 10_000], pa.string()))]
                value = values[np.fromiter((seen[w] for w in words_list), np.int64, len(words_list))]
                value[np.array([len(w) < 2 for w in words_list], bool)] = -4
                out = np.full(part.num_rows, -4.0)
                full = np.flatnonzero(np.diff(offsets) > 0)
                if len(full):
                    out[full] = np.maximum.reduceat(value[codes], offsets[:-1][full])
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in head), pa.array(out)], [*(f.name for f in head), "f"])

    return rows.mapInArrow(freeing(score), T.StructType([*head, T.StructField("f", T.DoubleType())]))


def predict(docs: DataFrame, machine: Machine, *, id_column: str = "doc_id", threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """score (0 to 1) and predicted (1 at the threshold or above) of each whole text.

    Null and empty texts, or those without letters, get the lowest score; repeated rows stay repeated, and equal texts score alike.
    An empty table gives no rows. keep: columns that stay (with `text`, null as the empty text); others, however named, go.
    Very long texts are scored slice by slice, whole.
    """
    a, b = machine.scale
    f = _largest(whole_texts(docs, id_column, *(c for c in keep if c != "text")), machine, (id_column, *keep))
    score = 1 / (1 + F.exp(-(F.least(F.greatest(F.col("f"), F.lit(-4.0)), F.lit(4.0)) * a + b)))
    return f.select(id_column, *keep, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
