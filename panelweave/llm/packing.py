"""Packing by cutting-stock column generation.

Documents are cut into full sequences and one shorter rest each. A linear program over
patterns of a length histogram decides how many sequences take which lengths; a knapsack
dynamic program prices new patterns. The rounded patterns are then assigned to ranked
pieces in Spark. The driver sees only the histogram, whose size is a parameter.
"""

import math
import os
import warnings
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import hold, slices, whole_texts

#: Texts of these characters alone take the fast way to the same ids: ASCII and Latin-1 letters and signs.
PLAIN = r"[^\t\n\r\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{ff}]"

#: Words that an encoder may know before a fresh one takes its place: about 150 MB of a Python worker.
KEEP_WORDS = 600_000


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray):
    """The lists flat[starts:starts+sizes] named by index, on end; and their sizes."""
    n = sizes[index]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


class Encoder:
    """Ids of texts by a tokenizer with word ends, each different word encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        for piece, i in self.model.get_vocab(with_added_tokens=False).items():
            self.ends[i] = piece.endswith("</w>")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        flats, sizes = [], []
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):
                own = [self.model.encode(w, add_special_tokens=False).ids for w in part]
                ids, cut = np.array([i for x in own for i in x], np.int32), np.cumsum([len(x) for x in own])
            flats.append(ids)
            sizes.append(np.diff(cut, prepend=0))
        sizes = np.concatenate(sizes)
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
        self.sizes, self.flat = np.r_[self.sizes, sizes], np.concatenate([self.flat, *flats])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))

    def plain(self, texts: pa.Array):
        """(ids on end, ids of each text) of texts of plain characters."""
        lists = pc.utf8_split_whitespace(texts)
        chunks = lists.flatten().dictionary_encode()
        lower = pc.utf8_lower(chunks.dictionary)
        spaced = pc.replace_substring_regex(lower, r"(\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)", r"\1 ")
        if pc.any(odd := pc.match_substring(lower, "'")).as_py():
            spaced = pc.replace_with_mask(spaced, odd, pa.array([" ".join(self.split.findall(x)) for x in lower.filter(odd).to_pylist()], spaced.type))
        parts = pc.utf8_split_whitespace(pc.utf8_rtrim_whitespace(spaced))
        words = parts.flatten().dictionary_encode()
        listed = words.dictionary.to_pylist()
        if new := [w for w in listed if w and w not in self.known]:
            self.learn(new)
        self.known.setdefault("", -1)
        code = np.fromiter((self.known[w] for w in listed), np.int64, len(listed))[np.asarray(words.indices)] if listed else np.zeros(0, np.int64)
        starts, sizes = np.r_[self.starts, 0], np.r_[self.sizes, 0]  # -1, the empty word, has no ids
        counts = np.diff(np.asarray(parts.offsets))
        ids, n = ragged(self.flat, starts, sizes, code)
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(counts)]]
        ids, n = ragged(ids, ends[:-1], np.diff(ends), np.asarray(chunks.indices))
        ends = np.r_[0, np.cumsum(n)][np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        self.known.pop("")
        return ids, np.diff(ends)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        odd = np.asarray(pc.or_(pc.match_substring_regex(texts, PLAIN), pc.match_substring_regex(texts, r"<\|(start|end)oftext\|>")))
        ids, n = self.plain(texts.filter(pa.array(~odd)))
        easy = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
        return [np.array(self.model.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32) if hard else next(easy) for i, hard in enumerate(odd)]


_KEPT: dict[str, Encoder] = {}


def encoded(path: str, texts: pa.Array) -> list[np.ndarray]:
    """Ids of texts by this Python worker's encoder: tasks that follow each other in a worker share the words it has learned.

    An encoder that fails is not kept.
    """
    encode = _KEPT.pop(path, None)
    if encode is None or len(encode.known) > KEEP_WORDS:
        encode = Encoder(path)
    ids = encode(texts)
    _KEPT[path] = encode
    return ids


def pieces(docs: DataFrame, *, tokenizer: str, end_id: int, capacity: int, id_column: str = "doc_id") -> DataFrame:
    """Every document's ids with the end id, cut at multiples of the capacity: start, length and checksum of each piece."""
    rows = whole_texts(docs, id_column)
    head = rows.schema[id_column]

    def cut(batches):
        from panelweave.llm.packing import encoded  # the worker's own module, whose encoder outlives this task

        for batch in batches:
            for part in slices(batch):
                at, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(encoded(tokenizer, part.column("text"))):
                    ids = np.append(ids, end_id).astype("<u4")
                    for s in range(0, len(ids), capacity):
                        at.append(i)
                        start.append(s)
                        length.append(min(capacity, len(ids) - s))
                        crc.append(zlib.crc32(ids[s : s + capacity].tobytes()))
                        total.append(len(ids))
                yield pa.RecordBatch.from_arrays([part.column(id_column).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], [id_column, "start", "length", "ids_crc32", "doc_tokens"])

    long = T.LongType()
    return rows.mapInArrow(cut, T.StructType([head, *(T.StructField(x, long) for x in ("start", "length", "ids_crc32", "doc_tokens"))]))


def price(values: np.ndarray, widths: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern that fits: unbounded knapsack by dynamic programming."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        n = np.searchsorted(widths, c, "right")
        best[c] = best[c - 1]
        if n:
            gain = values[:n] + best[c - widths[:n]]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], took[c] = gain[k], k
    pattern, c = np.zeros(len(widths)), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= widths[took[c]]
    return float(best[room]), pattern


def plan(demand: dict[int, int], room: int, gap: float = 0.001, most: int = 20_000) -> list[tuple[dict[int, int], int]]:
    """Patterns {width: count} and how often each is used, for a demand of pieces by width.

    Column generation by the revised simplex method until the linear program is within gap of
    its bound; its solution rounded down, the rest (at most about one pattern's pieces for each
    width) placed first-fit by falling width.
    """
    widths = np.array(sorted(demand), np.int64)
    need = np.array([demand[w] for w in widths], float)
    if not len(widths):
        return []
    patterns = [np.where(np.arange(len(widths)) == i, room // w, 0).astype(float) for i, w in enumerate(widths)]
    inverse = np.diag([1 / p[i] for i, p in enumerate(patterns)])
    x = inverse @ need
    for step in range(most):
        duals = inverse.sum(axis=0)
        value, pattern = price(np.maximum(duals, 0), widths, room)
        if value <= 1 + gap:  # Farley's bound: the optimum is at least the present value over this
            break
        way = inverse @ pattern
        able = way > 1e-9
        ratio = np.where(able, x / np.where(able, way, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        patterns[out] = pattern
        if step % 200 == 199:
            inverse = np.linalg.inv(np.array(patterns).T)
            x = np.maximum(inverse @ need, 0)
    else:
        warnings.warn(f"column generation ended {value - 1:.2%} over its bound after {most} patterns", stacklevel=2)
    used: list[tuple[dict[int, int], int]] = []
    left = need.copy()
    for p, n in zip(patterns, np.floor(x + 1e-7), strict=True):
        n = min(n, *(np.floor(left[p > 0] / p[p > 0]))) if (p > 0).any() else 0
        if n > 0:
            left -= n * p
            used.append(({int(w): int(k) for w, k in zip(widths, p, strict=True) if k}, int(n)))
    rooms, bins = np.zeros(0, np.int64), []
    for i in np.argsort(-widths):
        for _ in range(int(left[i])):
            fits = np.flatnonzero(rooms >= widths[i])
            if len(fits):
                k = int(fits[0])
            else:
                k = len(bins)
                bins.append({})
                rooms = np.append(rooms, room)
            rooms[k] -= widths[i]
            bins[k][int(widths[i])] = bins[k].get(int(widths[i]), 0) + 1
    return used + [(b, 1) for b in bins]


def pack(docs: DataFrame, *, tokenizer: str, capacity: int = 4096, end_id: int = 2, classes: int = 512, id_column: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    Null and empty texts are the end id alone. Each id lies in exactly one piece; a document
    longer than the capacity gives full sequences and one rest. classes: width classes of the
    histogram, which bounds the linear program. A sequence is padded to the capacity unless its
    length is a power of two (padded_length). Repeated rows are packed as often as they come.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    unit = max(1, math.ceil(capacity / classes))
    rows = hold(pieces(docs, tokenizer=tokenizer, end_id=end_id, capacity=capacity, id_column=id_column), "pieces")
    width = F.ceil(F.col("length") / unit).cast("int")
    demand = {r[0]: r[1] for r in rows.groupBy(width.alias("w")).count().collect()}
    room = capacity // unit
    over = {w: n for w, n in demand.items() if w > room}  # full pieces where the unit does not divide the capacity
    slots, base, taken = [], 0, {}
    for pattern, times in plan({w: n for w, n in demand.items() if w <= room}, room) + [({w: 1}, n) for w, n in over.items()]:
        for w, k in pattern.items():
            slots.append((w, taken.get(w, 0), taken.get(w, 0) + k * times, base, k))
            taken[w] = taken.get(w, 0) + k * times
        base += times
    # ranks 0, 1, ... inside a width class, in two levels: a class may hold most rows
    parts = max(1, math.isqrt(sum(demand.values())))
    ranked = rows.withColumn("w", width).withColumn("part", F.pmod(F.xxhash64(id_column, "start"), F.lit(parts)))
    sizes = ranked.groupBy("w", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("w").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("w", "part", before.alias("before"))
    ranked = ranked.withColumn("own", F.row_number().over(Window.partitionBy("w", "part").orderBy(id_column, "start", "length", "ids_crc32")) - 1).join(sizes, ["w", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own"))
    # a few rows for each width class and pattern: bounded by classes
    places = spark.createDataFrame(slots, "w int, low long, high long, base long, per long")
    placed = ranked.join(F.broadcast(places), "w").filter("rank >= low and rank < high")
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("per")).cast("long"))
    inside = Window.partitionBy("sequence_id")
    ordered = inside.orderBy(F.desc("length"), id_column, "start", "ids_crc32", "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ordered), F.lit(0))).withColumn("filled", F.sum("length").over(inside))
    padded = F.when(F.col("filled").bitwiseAND(F.col("filled") - 1) == 0, F.col("filled")).otherwise(F.lit(capacity).cast("long"))
    return placed.select(id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", padded.alias("padded_length"))
