"""Stupid-backoff scores from n-gram counts of the whole corpus.

Texts are dealt into blocks, and every block gives its distinct n-grams of all orders with their counts: so a very frequent
n-gram counts once a block, not once a document. They are dealt by ranges of the n-gram's hash, the sorted hashes of a block and range packed
as differences in one row; there they add up, and each row goes back to its block with what the other blocks count, in the order in
which it came, so no hash travels twice. Each document then looks its n-grams up and sums its scores.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import hold, letter_words, mix, partitions, string_hashes, whole_texts

STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts that a task deals into bundles at a time.
BUNDLE_BYTES = 32_000_000


def packed(x: np.ndarray) -> bytes:
    """64-bit integers by planes of equal significance, compressed: high bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind=np.uint64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(kind).ravel()


def bundles(table: pa.Table) -> pa.RecordBatch:
    """The rows (id, text) of each block as one compressed stream: a shuffle of them is smaller than one of rows."""
    table = table.take(np.argsort(np.asarray(table.column("block")), kind="stable"))
    block = np.asarray(table.column("block"))
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    rows, out = table.select(["id", "text"]).combine_chunks(), []
    for begin, end in zip(starts, np.r_[starts[1:], len(block)][: len(starts)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(rows.slice(begin, end - begin))
        out.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int64()), pa.array(out, pa.binary())], ["block", "bundle"])


def unbundled(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("bundle")])


def known_grams(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-grams, how often each occurs)."""
    known, n = np.unique(np.concatenate(keys), return_counts=True)
    return known[known > 0], n[known > 0].astype(np.int64)


def tallied(keys: list[np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct n-grams, how often each occurs; by order and token, the place of its n-gram among them and how often its own document has it).

    of: the document of each token, ascending. One stable sort brings an n-gram's tokens together, those of a document side by side. Where there is no n-gram, place and own count mean nothing.
    """
    flat, doc = np.concatenate(keys), np.tile(of, len(keys))
    turn = np.argsort(flat, kind="stable")
    ordered, doc = flat[turn], doc[turn]
    new = np.ones(len(flat), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    run = new.copy()
    run[1:] |= doc[1:] != doc[:-1]
    known, begins = ordered[new], np.flatnonzero(new)
    n, runs = np.diff(begins, append=len(flat)), np.diff(np.flatnonzero(run), append=len(flat))
    at, own = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
    at[turn], own[turn] = np.cumsum(new) - 1, np.repeat(runs, runs)
    none = int(len(known) > 0 and known[0] == 0)
    return known[none:], n[none:], (at - none).reshape(len(keys), -1), own.reshape(len(keys), -1)


def range_starts(known: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of `ranges` even ranges of hashes starts in sorted n-grams, and where the last one ends."""
    return np.searchsorted((known >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))


def grams(texts: pa.Array, order: int):
    """(keys[n], document of each token): the hash of the n-gram that ends at each token, 0 where it would leave the document."""
    words, codes, offsets = letter_words(texts)
    real = np.array([bool(w) for w in words.to_pylist()], bool)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = real[codes] if len(codes) else np.zeros(0, bool)
    h, of = string_hashes(words)[codes[keep]], of[keep]
    out, rolled = [], h
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            if n > 1:
                rolled = mix(np.r_[np.uint64(0), rolled[:-1]][: len(h)] * STEP + h)
            start = np.r_[np.ones(min(n - 1, len(of)), bool), of[n - 1 :] != of[: len(of) - n + 1]][: len(of)]
            # the lowest bits tell the order, so orders never meet; 0 is no n-gram
            out.append(np.where(start, np.uint64(0), (mix(rolled + np.uint64(n)) & ~np.uint64(7)) | np.uint64(n)))
    return out, of


def score(docs: DataFrame, *, order: int = 3, backoff: float = 0.4, id_column: str = "doc_id", block_chars: int = 8_000_000) -> DataFrame:
    """n_tokens, n_backed_off and lm_score (mean log score of a token) of every document.

    Tokens are letters between white space, in lower case. Counts are over the corpus without the
    document itself, so a text does not vouch for itself: an n-gram seen elsewhere scores
    its count over its context's; else backoff times the score one order lower; a word seen nowhere
    else counts as one of all tokens. Null, empty and letterless texts have no tokens and a null score.
    Rows that repeat an id are documents of their own, and repeated rows stay. An empty table gives no rows;
    other columns, however named, stay out. A very long text is one document of its block and is scored whole.
    block_chars: characters of a block, which a task holds at once.
    """
    spark = docs.sparkSession
    rows = whole_texts(docs, id_column)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(partitions(spark), math.ceil(chars / block_chars))
    dealt = rows.select(F.col(id_column).cast("long").alias("id"), "text", F.pmod(F.xxhash64(id_column, "text"), F.lit(blocks)).cast("long").alias("block"))

    def bundle(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= BUNDLE_BYTES:
                yield bundles(pa.Table.from_batches(waiting))
                waiting, size = [], 0
        if waiting:
            yield bundles(pa.Table.from_batches(waiting))

    ranges = 2 * blocks  # about half as many n-grams as a block has

    def explode(table: pa.Table) -> pa.Table:
        known, n = known_grams(grams(unbundled(table).column("text").combine_chunks(), order)[0])
        starts = range_starts(known, ranges)
        full = np.flatnonzero(np.diff(starts))
        cuts = [slice(starts[r], starts[r + 1]) for r in full]
        steps = [packed(np.diff(known[c], prepend=np.uint64(0))) for c in cuts]
        block = np.full(len(full), table.column("block")[0].as_py(), np.int64)
        return pa.table({"range": pa.array(full.astype(np.int64)), "block": pa.array(block), "steps": pa.array(steps, pa.binary()), "n": pa.array([packed(n[c]) for c in cuts], pa.binary())})

    def add_up(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(unpacked(x.as_py())) for x in table.column("steps")]
        n = np.concatenate([unpacked(x.as_py(), np.int64) for x in table.column("n")])
        known, place = np.unique(np.concatenate(lists), return_inverse=True)
        # sums of whole numbers in doubles are exact up to 2 ** 53
        elsewhere = np.bincount(place, n, len(known)).astype(np.int64)[place] - n
        ends = np.cumsum([len(x) for x in lists])[:-1]
        return pa.table({"block": table.column("block"), "range": table.column("range"), "elsewhere": pa.array([packed(x) for x in np.split(elsewhere, ends)], pa.binary())})

    def look_up(bundled: pa.Table, answers: pa.Table) -> pa.Table:
        texts = unbundled(bundled)
        keys, of = grams(texts.column("text").combine_chunks(), order)
        n = texts.num_rows
        known, totals, at, own = tallied(keys, of)
        starts = range_starts(known, ranges)
        for r, more in zip(answers.column("range").to_pylist(), answers.column("elsewhere"), strict=True):
            totals[starts[r] : starts[r + 1]] += unpacked(more.as_py(), np.int64)

        # corpus counts of the n-grams at each token, less the document's own
        counts = [np.where(key > 0, (totals[at[k]] if len(totals) else 0) - own[k], 0) for k, key in enumerate(keys)]
        total, open_, depth = np.zeros(len(of)), np.ones(len(of), bool), np.zeros(len(of), np.int64)
        for k in range(order, 0, -1):
            real = keys[k - 1] > 0
            hit = open_ & real & (counts[k - 1] > 0)
            if k > 1:
                context = np.r_[0, counts[k - 2][:-1]][: len(of)]
                total[hit] += np.log(counts[k - 1][hit] / np.maximum(context[hit], counts[k - 1][hit]))
            else:
                total[hit] += np.log(counts[0][hit])
            missed = open_ & real & ~hit
            total[missed] += math.log(backoff)
            depth[missed] += 1
            open_ &= ~hit
            if k == 1:  # scores by the number of all tokens wait for that number
                last = hit | open_
        sums = np.bincount(of, total, n) if len(of) else np.zeros(n)
        tokens = np.bincount(of, minlength=n)
        by_all = np.bincount(of, last, n) if len(of) else np.zeros(n)
        return pa.table({"id": texts.column("id"), "n_tokens": pa.array(tokens.astype(np.int64)), "n_backed_off": pa.array((np.bincount(of, depth > 0, n) if len(of) else np.zeros(n)).astype(np.int64)), "sum": pa.array(sums), "by_all": pa.array(by_all)})

    dealt = dealt.mapInArrow(bundle, "block long, bundle binary")
    exploded = dealt.groupBy("block").applyInArrow(explode, "range long, block long, steps binary, n binary")
    answers = exploded.groupBy("range").applyInArrow(add_up, "block long, range long, elsewhere binary")
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(look_up, "id long, n_tokens long, n_backed_off long, sum double, by_all double")
    found = hold(found, "lm-sums")
    tokens = found.agg(F.sum("n_tokens")).first()[0] or 1
    mean = (F.col("sum") - F.col("by_all") * math.log(tokens)) / F.col("n_tokens")
    return found.select(F.col("id").alias(id_column), "n_tokens", "n_backed_off", F.when(F.col("n_tokens") > 0, mean).alias("lm_score"))
