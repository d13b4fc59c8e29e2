"""Importance resampling towards a target set of texts.

Features are runs of words, hashed to buckets. Counts of buckets in the corpus and in the target texts give
one array of log-ratio gains, and a document's weight is the mean gain of its features. Gumbel noise on
the weights turns a draw without replacement into a cutoff: the highest scores are drawn. A quantile sketch
brackets the cutoff, exact counts outside the bracket confirm it or widen it, and only the bracket is sorted.
"""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import flat_bytes, hold, runs, slices, whole_texts

#: Lengths of words whose shifts have tables of their own; longer ones are made of powers of two.
SHORT = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Tables [steps, byte of the checksum, its value] that carry a crc32 over 0 to SHORT - 1 bytes, and over SHORT * 2**j bytes."""
    table, one = _crc_table(), np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    short = [one]
    for _ in range(SHORT):
        short.append((short[-1] >> 8) ^ table[short[-1] & 255])
    powers = [short.pop()]
    for _ in range(24):
        powers.append(_carry(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


def _carry(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray, tables) -> np.ndarray:
    """crc32 of joined strings, from those of their two parts and the length of the right one."""
    short, powers = tables
    low, high = length % SHORT, length // SHORT
    out = short[low, 0, left & 255] ^ short[low, 1, (left >> 8) & 255] ^ short[low, 2, (left >> 16) & 255] ^ short[low, 3, left >> 24]
    for j in range(int(high.max(initial=0)).bit_length()):
        at = np.flatnonzero((high >> j) & 1)
        out[at] = _carry(powers[j], out[at])
    return out ^ right


#: ASCII letters in lower case; and which bytes belong to words: digits, letters, all beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint8)
WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_features(texts: pa.Array, buckets: int, longest: int, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every run of 1 to longest words, number of features of each text, of words of each text); a text's features stand together."""
    data, offsets = flat_bytes(texts)
    data = LOWER[data]
    inside = WORD[data]
    start, end = runs(inside, offsets)
    text = np.searchsorted(offsets, start, "right") - 1
    words = np.bincount(text, minlength=len(texts))
    if not len(start):
        return np.zeros(0, np.int64), words, words
    bounds = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]).dictionary_encode()
    distinct, code = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    crc, spaced = (np.fromiter((zlib.crc32(w, first) for w in distinct), np.uint32, len(distinct))[code] for first in (0, zlib.crc32(b" ")))
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))[code] + 1
    lead = crc
    found, real = [lead], [np.ones(len(crc), bool)]
    for more in range(1, longest):  # the run that ends at a word: one word longer than the run that ended before it
        lead = np.r_[np.zeros(1, np.uint32), joined_crc(lead[:-1], spaced[1:], size[1:], tables)]
        found.append(lead)
        real.append(np.r_[np.zeros(more, bool), text[more:] == text[:-more]] if len(text) > more else np.zeros(len(text), bool))
    keep = np.stack(real, axis=1)
    return (np.stack(found, axis=1)[keep] % buckets).astype(np.int64), np.bincount(text, weights=keep.sum(axis=1), minlength=len(texts)).astype(np.int64), words


def features(texts: DataFrame, *, id_column: str, buckets: int, longest: int) -> DataFrame:
    """id, n_words, n_features and the buckets of all features, repeated ones as often, as little-endian bytes."""
    kind = np.uint16 if buckets <= 2**16 else np.uint32

    def hashed(batches):
        tables = _shifts()
        for batch in batches:
            for part in slices(batch):
                found, count, words = word_features(part.column("text"), buckets, longest, tables)
                ends = np.r_[0, np.cumsum(count)] * kind().itemsize
                blob = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(found.astype(kind))])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words, pa.int64()), pa.array(count, pa.int64()), blob.cast(pa.binary())], ["id", "n_words", "n_features", "buckets"])

    return whole_texts(texts.select(F.col(id_column).cast("long").alias("id"), "text"), "id").mapInArrow(hashed, "id long, n_words long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows of features; at most so many numbers as there are buckets reach the driver."""
    kind = np.uint16 if buckets <= 2**16 else np.uint32

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(flat_bytes(batch.column("buckets"))[0].view(kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, target over corpus, rounded down."""
    above, below = float(corpus.sum() + len(corpus)), float(target.sum() + len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * above / ((s + 1.0) * below))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, ids: list) -> list[int]:
    """Thousandths of Gumbel noise, rounded down, from a hash of seed and id; a missing id hashes as nothing."""
    out = []
    for i in ids:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append(math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    return out


def scores(rows: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """id, n_words, n_features, weight (floored mean gain, 0 without features) and score of rows of features."""
    kind = np.uint16 if len(gain) <= 2**16 else np.uint32

    def score(batches):
        for batch in batches:
            for part in slices(batch, "buckets"):
                found = flat_bytes(part.column("buckets"))[0].view(kind)
                n = np.asarray(part.column("n_features"))
                ends = np.r_[0, np.cumsum(n)]
                total = np.r_[0, np.cumsum(gain[found])]
                weight = np.where(n > 0, (total[ends[1:]] - total[ends[:-1]]) // np.maximum(n, 1), 0)
                noisy = weight + np.array(noise(seed, part.column("id").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "n_words", "n_features")), pa.array(weight), pa.array(noisy)], ["id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(score, "id long, n_words long, n_features long, weight long, score long")


def order() -> list[Column]:
    """Highest score first, ties to the smaller id; rows without an id come last, and `row` tells repeated rows apart."""
    return [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Adds rank from 1 in order() over all rows: ranges are sorted apart and each starts where the counts of those before end."""
    ranged = rows.repartitionByRange(*order()).sortWithinPartitions(*order())
    within = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    placed = hold(ranged.select("*", F.spark_partition_id().alias("range"), within.alias("at")), name)
    before, seen = [], 0
    for number, n in placed.groupBy("range").count().orderBy("range").collect():  # as many rows as partitions
        before.append((number, seen))
        seen += n
    starts = rows.sparkSession.createDataFrame(before, "range int, before long")
    return placed.join(F.broadcast(starts), "range").withColumn("rank", F.col("before") + F.col("at") + 1).drop("range", "before", "at")


def cutoff(rows: DataFrame, n: int, wanted: int, error: float = 0.002):
    """The last of the wanted first rows in order(), out of n rows; wanted is from 1 to n.

    A sketch of the scores gives values on both sides of the wanted rank. The rows above the upper one and those between
    are counted: where the rank is not between, the bracket is widened to both sides, in the end to all rows.
    """
    accuracy = math.ceil(4 / error)
    while True:
        share = 1 - wanted / n
        low, high = max(0.0, share - error), min(1.0, share + error)
        ends = rows.agg(F.percentile_approx("score", [low, high], accuracy).alias("q"), F.min("score").alias("least"), F.max("score").alias("most")).first()
        low, high = (ends.least if low == 0 else ends.q[0]), (ends.most if high == 1 else ends.q[1])
        inside = F.col("score").between(low, high)
        above, between = rows.agg(F.count(F.when(F.col("score") > high, 1)), F.count(F.when(inside, 1))).first()
        if above < wanted <= above + between:
            break
        error *= 4
    return numbered(rows.filter(inside), "bracket").filter(F.col("rank") == wanted - above).drop("rank").first()


def draw(docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, buckets: int = 10_000, longest: int = 2, seed: int = 7, id_column: str = "doc_id") -> DataFrame:
    """id, n_features, weight, score and rank of every document; rank counts the drawn ones from 1, highest score first, and is null for others.

    A-Z are lowered and words are runs of digits, letters and what lies beyond ASCII. Drawn are percent of the documents of at least least_words words.
    Null, empty and wordless texts have no features, weight 0 and are not drawn; so are all without enough words. Repeated rows count and are
    drawn by themselves; rows without an id are ranked after others of their score. Without target texts all gains
    come from the corpus alone. Other columns, however named, stay out; an empty table gives no rows.
    """
    rows = hold(features(docs, id_column=id_column, buckets=buckets, longest=longest), "features")
    aimed = bucket_counts(features(target.withColumn("one", F.lit(0)), id_column="one", buckets=buckets, longest=longest), buckets)
    scored = hold(scores(rows, gains(bucket_counts(rows, buckets), aimed), seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    able = scored.filter(F.col("n_words") >= least_words)
    n = able.count()
    wanted = percent * n // 100
    named = [F.col("id").alias(id_column), "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*named, F.lit(None).cast("long").alias("rank"))
    last = cutoff(able, n, wanted)
    # a row is drawn if it stands no later in order() than the last one
    late, inner = F.lit(False), [("n_features", last.n_features), ("weight", last.weight), ("row", last.row)]
    for column, value in reversed(inner):
        late = (F.col(column) > value) | ((F.col(column) == value) & late)
    same = F.col("id").eqNullSafe(F.lit(last.id).cast("long")) & late
    later = F.col("id").isNull() | (F.col("id") > last.id) if last.id is not None else F.lit(False)
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > last.score) | ((F.col("score") == last.score) & ~F.coalesce(later | same, F.lit(False))))
    ranked = numbered(scored.filter(drawn), "drawn").select(*named, "rank")
    return ranked.unionByName(scored.filter(~drawn).select(*named, F.lit(None).cast("long").alias("rank")))
