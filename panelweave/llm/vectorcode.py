"""Product codes of vectors: integer codebooks by part, nearest entries by Orchard search.

Every codebook entry has a list of the others, nearest first. A search holds its nearest entry so far
and walks that entry's list; an entry that is nearer takes over, with its own list from the start. Entries
once measured are marked and not measured again. By the triangle inequality an entry that lies farther
from the present one than twice the present distance cannot be nearer, so there the list ends.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import hold

#: Rows that are searched in step, and bits of a limb in which sums are passed on.
ROWS, LIMB = 4096, 32


@dataclass(frozen=True)
class Codebooks:
    """entries[p][e] are the integer components of entry e for part p; length is that of a whole vector, 0 without any."""

    entries: list[list[list[int]]]
    length: int
    scale: int

    def text(self) -> str:
        return ",".join(str(x) for part in self.entries for entry in part for x in entry)


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the other entries, nearest first, and their squared distances from it."""
    k = len(entries)
    apart = np.stack([((entries - e) ** 2).sum(axis=1) for e in entries])
    near = np.stack([(o := np.argsort(apart[e], kind="stable"))[o != e] for e in range(k)]).reshape(k, k - 1)
    return near, np.take_along_axis(apart, near, axis=1)


def orchard(points: np.ndarray, entries: np.ndarray, near: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry, ties to the lower index, and the squared distance. All points take a step at a time.

    A list goes on while squared distances are at most four times the present one: at just twice the distance an entry can still tie.
    """
    n, last = len(points), len(entries) - 1
    best, at, gap = np.zeros(n, np.int64), np.zeros(n, np.int64), ((points - entries[0]) ** 2).sum(axis=1)
    marked = np.zeros((n, last + 1), bool)
    marked[:, 0] = True
    walking = np.arange(n if last else 0)
    while len(walking):
        walking = walking[apart[best[walking], at[walking]] <= 4 * gap[walking]]
        entry = near[best[walking], at[walking]]
        at[walking] += 1
        new = ~marked[walking, entry]
        asked, entry = walking[new], entry[new]
        marked[asked, entry] = True
        d = ((points[asked] - entries[entry]) ** 2).sum(axis=1)
        better = (d < gap[asked]) | ((d == gap[asked]) & (entry < best[asked]))
        moved = asked[better]
        best[moved], gap[moved], at[moved] = entry[better], d[better], 0
        walking = walking[at[walking] < last]
    return best, gap


def _integers(rows: pa.Array, length: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length; Python's integers where a long could not hold what is made of them."""
    x = np.asarray(rows.flatten(), np.float64).reshape(-1, length)
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 2**50:  # ROWS of them still sum within a long
        return y.astype(np.int64)
    whole = [int(b) if abs(a) < 2**53 else int(a) * scale for a, b in zip(x.ravel(), y.ravel(), strict=True)]
    return np.array(whole, object).reshape(x.shape)


def _searcher(books: Codebooks):
    """A function from integer vectors to (codes, squared distances) by part, with lists made once for each kind of number."""
    lists: dict[type, list] = {}
    most = max((abs(x) for part in books.entries for entry in part for x in entry), default=0)

    def search(v: np.ndarray):
        parts = len(books.entries)
        width = v.shape[1] // parts
        kind = np.int64 if width * (most + int(np.abs(v).max(initial=0))) ** 2 < 2**60 else object
        if kind not in lists:
            lists[kind] = [(e := np.array(part, kind).reshape(-1, width), *neighbour_lists(e)) for part in books.entries]
        v = v.astype(kind)
        found = [orchard(v[:, p * width : (p + 1) * width], *lists[kind][p]) for p in range(parts)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    return search


def kept(vectors: DataFrame, vector_column: str, *others: Column) -> DataFrame:
    """Rows whose vector and all its components are there and finite, the vector as doubles `v`."""
    x = F.col(vector_column).cast("array<double>")
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(*others, x.alias("v"))


def _limbs(value: int) -> list[tuple[int, int]]:
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    for limb in range((rest.bit_length() + LIMB - 1) // LIMB):
        if low := (rest >> (LIMB * limb)) & (2**LIMB - 1):
            out.append((limb, sign * low))
    return out


def learn(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> Codebooks:
    """Codebooks of integer entries: first the parts of the smallest ids' vectors, then means of assigned parts, rounded down, in each round.

    An id that several rows share gives one entry, of its smallest vector; rows without an id give none. An entry that no part is nearest to
    stays. Vectors have the commonest length that parts divide; others teach nothing. Tasks pass on one sum and count an entry
    and component, so what is gathered is bounded by the codebooks and not by the rows; sums go in limbs and are exact at any size.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = kept(vectors, vector_column, F.col(id_column).cast("long").alias("id"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().filter((F.col("n") > 0) & (F.col("n") % parts == 0))
    length = (sizes.orderBy(F.desc("count"), F.desc("n")).first() or [0])[0]
    rows = rows.filter(F.size("v") == length)
    ids = [r.id for r in rows.filter("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]
    if not ids:
        return Codebooks([], 0, scale)
    first = rows.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    start, width = _integers(pa.array([r.v for r in first], pa.list_(pa.float64())), length, scale), length // parts
    books = Codebooks([start[:, p * width : (p + 1) * width].tolist() for p in range(parts)], length, scale)
    for _ in range(rounds):
        books = _means(rows, books)
    return books


def _means(rows: DataFrame, books: Codebooks) -> Codebooks:
    parts, k, width = len(books.entries), len(books.entries[0]), len(books.entries[0][0])

    def sums(batches):
        search, total, count = _searcher(books), np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                v = _integers(batch.column("v").slice(at, ROWS), books.length, books.scale)
                codes, _ = search(v)
                for p in range(parts):
                    part = np.zeros((k, width), v.dtype)
                    np.add.at(part, codes[:, p], v[:, p * width : (p + 1) * width])
                    total[p] += part.astype(object)
                    count[p] += np.bincount(codes[:, p], minlength=k)
        flat = np.concatenate([total, count.astype(object)[:, :, None]], axis=2).ravel()
        out = [(slot, limb, x) for slot, value in enumerate(flat) for limb, x in _limbs(int(value))]
        slot, limb, x = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(limb, pa.int32()), pa.array(x, pa.int64())], ["slot", "limb", "x"])

    table = [[0] * (width + 1) for _ in range(parts * k)]
    for slot, limb, x in rows.select("v").mapInArrow(sums, "slot int, limb int, x long").groupBy("slot", "limb").agg(F.sum("x")).collect():
        table[slot // (width + 1)][slot % (width + 1)] += x << (LIMB * limb)
    fresh = [[s // n for s in row] if n else old for (*row, n), old in zip(table, (e for part in books.entries for e in part), strict=True)]
    return Codebooks([fresh[p * k : (p + 1) * k] for p in range(parts)], books.length, books.scale)


def encode(vectors: DataFrame, books: Codebooks, *, keep: tuple[str, ...] = ("vec_id", "label"), vector_column: str = "embedding") -> DataFrame:
    """The kept columns, code (two hex digits a part) and error (squared distance of the vector from its code's entries).

    Vectors that are null or hold null or non-finite components are left out. Those of another length than the codebooks' have neither code
    nor error; an error beyond a long is null. Repeated rows stay; columns that are not kept, however named, stay out; an empty table gives no rows.
    """
    rows = kept(vectors, vector_column, *(F.col(c) for c in keep))

    def codes(batches):
        search = _searcher(books)
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                column = part.column("v")
                own = np.flatnonzero(np.asarray(column.value_lengths()) == (books.length or -1))
                code, error = [None] * part.num_rows, [None] * part.num_rows
                if len(own):
                    found, gaps = search(_integers(column.take(pa.array(own)), books.length, books.scale))
                    for i, c, e in zip(own, found, gaps.sum(axis=1), strict=True):
                        code[i], error[i] = bytes(c.tolist()).hex(), int(e) if e < 2**63 else None
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(code, pa.string()), pa.array(error, pa.int64())], [*keep, "code", "error"])

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(codes, f"{types}, code string, error long")


def with_label_error(coded: DataFrame, label_column: str = "label") -> DataFrame:
    """Adds label_error: the errors of all rows with the same label, rows without one together; null beyond a long.

    Sums are made before the shuffle. Rows meet them in a join that Spark broadcasts if the sums are few and else splits at hot labels.
    """
    coded, label = hold(coded, "codes"), F.col(label_column)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(label.alias("of")).agg(F.when(total <= 2**63 - 1, total).cast("long").alias("label_error"))
    return coded.join(sums, label.eqNullSafe(F.col("of")), "left").drop("of")
