"""Helpers shared by the operators: staged tables, token batches, stable hashes."""

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into tokens at a time, and words that it remembers between slices: both bound a worker's memory.
SLICE_BYTES, CACHE_WORDS = 6_000_000, 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local session without one gets a temporary folder, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def hold(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the text, null as the empty text; other columns, however named, stay out."""
    return docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def crc_mod(column: str, by: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by))


def freeing(read):
    """A function of batches whose worker gives freed memory back at its end: workers wait beside the JVM for a minute, and what they keep adds to the next stage."""

    def run(batches):
        try:
            yield from read(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return run


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Row ranges of a batch whose texts together stay near a limit of bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(size) // limit
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for begin, end in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        yield batch.slice(begin, end - begin)


def tokens(texts: pa.Array):
    """(distinct tokens, code of each token in order, offsets of documents) of texts cut at white space."""
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()


#: Signs that stand for a letter inside a word (fixed values).
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def letter_words(texts: pa.Array, fold: bool = False):
    """As tokens, with tokens in lower case and reduced to their letters; fold strips accents too and reads SIGNS between letters as letters."""
    raw, codes, offsets = tokens(texts)
    if fold:
        raw = pc.utf8_normalize(raw, "NFKD")
        mixed = pc.match_substring_regex(raw, r"\p{L}.*[013457@$]|[013457@$].*\p{L}")
        if pc.any(mixed).as_py():
            read = raw.filter(mixed)
            for sign, letter in SIGNS.items():
                read = pc.replace_substring(read, sign, letter)
            raw = pc.replace_with_mask(raw, mixed, read)
    clean = pc.replace_substring_regex(pc.utf8_lower(raw), r"[^\p{L}]+", "").dictionary_encode()
    return clean.dictionary, np.asarray(clean.indices)[codes] if len(codes) else codes, offsets


def code_points(words: pa.Array):
    """(code points of all words on end, length of each word)."""
    strings = words.to_pylist()
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, strings), np.int64, len(strings))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(s) for s in strings.cast(pa.binary()).to_pylist()), np.uint64, len(strings))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the UTF-8 bytes of all texts on end, where each text begins and the last one ends); no text is null."""
    whole = texts.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(whole.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, one past the last) of every longest run of true values that lies within one text."""
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1
