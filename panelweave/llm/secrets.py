"""Secrets in texts: three plain patterns, and a battery of randomness tests for everything else.

A candidate is a run of letters, digits and the signs of base 64. Its encoding is the smallest alphabet that
holds it. Three tests ask whether it is as random as key material: chi-squared uniformity over the alphabet,
runs about the alphabet's middle, and serial correlation. Each is turned round, as a test of equivalence: the null
hypothesis is a departure at least as large as that of text (uniformity: a string of the corpus's own letters) or
of a pattern (runs, correlation), so a small p says "random", and the longer the string the smaller it can get. The
largest of the three p counts. Within each class of lengths the step-up rule bounds the share of false finds.
"""

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import flat_bytes, hold, runs, slices, whole_texts

#: The plain patterns, and the least length of what counts (of the value in the first). Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: A text without this has no assignment (a pattern for Arrow).
NAMED = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
KINDS = ("assign", "access", "hex", "random")

DIGITS, LOW, HIGH = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets in the order in which they are tried; each has an even number of characters, so that its middle halves it.
ALPHABETS = {
    "decimal": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "lower": LOW, "upper": HIGH, "base32": HIGH + "234567",
    "base36": DIGITS + LOW, "BASE36": DIGITS + HIGH, "letters": HIGH + LOW, "base62": HIGH + LOW + DIGITS, "base64": HIGH + LOW + DIGITS + "+/", "base64url": HIGH + LOW + DIGITS + "-_",
}
SIGNS = "".join(sorted({*HIGH, *LOW, *DIGITS, *"+/_-"}))
NAMES = list(ALPHABETS)
SETS, PLACES = [frozenset(a) for a in ALPHABETS.values()], [{c: i for i, c in enumerate(a)} for a in ALPHABETS.values()]
#: Lengths at which a class begins; the least is also that of a candidate.
LENGTHS = (16, 20, 24, 32, 48, 64, 128)
#: Departures that text or a pattern has at least: shares of steps over the middle near 0 or 1, correlation near -1 or 1.
STEPS, CORRELATION = 0.15, 0.7
#: p is kept as whole hundredths of -log10, up to this.
FINEST = 30_000

SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("alphabet", pa.int32()), ("n", pa.int64()), ("pairs", pa.float64()), ("steps", pa.int64()), ("correlation", pa.float64()), ("apart", pa.bool_())])
SCANNED = "base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,alphabet:int,n:long,pairs:double,steps:long,correlation:double,apart:boolean>>, signs array<long>"


def battery(run: str) -> tuple[int, int, float, int, float] | None:
    """(alphabet, length, ordered pairs of equal characters, steps over the middle, serial correlation) of a run; None if no alphabet holds it.

    The pairs carry the chi-squared statistic: it is size / length * (pairs + length) - length.
    """
    chars = set(run)
    number = next((i for i, a in enumerate(SETS) if chars <= a), None)
    if number is None:
        return None
    place, size, n = PLACES[number], len(SETS[number]), len(run)
    x = np.fromiter(map(place.__getitem__, run), np.int64, n)
    count = np.bincount(x)
    high = x >= size // 2
    centred = x - (size - 1) / 2
    correlation = float((centred[1:] * centred[:-1]).sum() / ((n - 1) * (size * size - 1) / 12))
    return number, n, float((count * (count - 1)).sum()), int((high[1:] != high[:-1]).sum()), correlation


def scan(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, base spans, candidates with what the tests need, and on one row of a slice of texts the counts of SIGNS outside candidates.

    Spans are in code points of the whole text. `apart` tells a candidate that shares nothing with a base span.
    """
    source = whole_texts(docs.select(F.col(id_column).alias("id"), "text"), "id")
    kind = source.schema["id"].dataType.simpleString()
    codes = np.frombuffer(SIGNS.encode(), np.uint8)
    is_sign = np.isin(np.arange(256), codes)

    def read(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                data, offsets = flat_bytes(texts)
                base, found = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
                for i in np.flatnonzero(np.asarray(pc.match_substring_regex(texts, NAMED))):
                    base[i] = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(texts[int(i)].as_py()) if len(m[2]) >= LEAST_ASSIGN]
                start, end = runs(is_sign[data], offsets)
                long = end - start >= LENGTHS[0]
                points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                counts = np.bincount(data, minlength=256)
                runs_of: dict[int, list] = {}
                for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
                    i = int(np.searchsorted(offsets, a, "right")) - 1
                    run, at = data[a:b].tobytes(), int(points[a] - points[offsets[i]])
                    counts -= np.bincount(data[a:b], minlength=256)
                    run = run.decode()
                    base[i] += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(run) if len(m[0]) >= LEAST_ACCESS]
                    base[i] += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run) if len(m[0]) >= LEAST_HEX]
                    runs_of.setdefault(i, []).append((at, run))
                for i, own in runs_of.items():
                    base[i].sort()
                    firsts = np.array([s for s, _, _ in base[i]], np.int64)
                    reach = np.maximum.accumulate(np.array([e for _, _, e in base[i]], np.int64)) if base[i] else firsts
                    for at, run in own:
                        if tests := battery(run):
                            before = int(np.searchsorted(firsts, at + len(run)))  # base spans that begin before the run's end
                            found[i].append((at, at + len(run), *tests, not before or int(reach[before - 1]) <= at))
                signs = [None] * len(texts)
                if signs:
                    signs[0] = counts[codes].tolist()
                spans = pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in base], pa.list_(SPAN))
                tests = pa.array([[dict(zip(FOUND.names, f, strict=True)) for f in x] for x in found], pa.list_(FOUND))
                yield pa.RecordBatch.from_arrays([part.column("id"), spans, tests, pa.array(signs, pa.list_(pa.int64()))], ["id", "base", "found", "signs"])

    return source.mapInArrow(read, f"id {kind}, {SCANNED}")


def text_pairs(signs: dict[str, int]) -> list[tuple[float, float]]:
    """For each alphabet the chances that two, and that three, characters of text within it are equal; (0, 0) where text has none."""
    out = []
    for alphabet in ALPHABETS.values():
        share = np.array([signs.get(c, 0) for c in alphabet], np.float64)
        share = share / share.sum() if share.sum() else share
        out.append((float((share**2).sum()), float((share**3).sum())))
    return out


def _below(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


def p_value(alphabet: int, n: int, pairs: float, steps: int, correlation: float, text: list[tuple[float, float]]) -> float:
    """The largest p of the three tests of equivalence; 1 where the corpus has no text of the alphabet.

    Pairs of equal characters in text have a known mean and variance, and nearly a gamma distribution (its cube root nearly a
    normal one); steps over the middle are binomial; correlation is compared after Fisher's transformation.
    """
    two, three = text[alphabet]
    mean = n * (n - 1) * two
    if not mean:
        return 1.0
    spread = 4 * n * (n - 1) * (n - 2) * three + 2 * n * (n - 1) * two - 2 * n * (n - 1) * (2 * n - 3) * two * two
    shape = mean * mean / max(spread, 1e-9)
    uniform = _below(3 * math.sqrt(shape) * (((pairs + 1) / mean) ** (1 / 3) - 1 + 1 / (9 * shape)))
    wide = math.sqrt((n - 1) * STEPS * (1 - STEPS))
    few = _below(((n - 1) * STEPS - steps + 0.5) / wide)  # as many steps as seen, where few are the rule
    many = _below((steps + 0.5 - (n - 1) * (1 - STEPS)) / wide)
    turned, bound = math.atanh(max(-0.999999, min(0.999999, correlation))), math.atanh(CORRELATION)
    serial = _below((abs(turned) - bound) * math.sqrt(n - 3))
    return max(uniform, few, many, serial)


def step_up(counts: list[tuple[int, int, int]], rate: float) -> list[int]:
    """For each class of lengths the least bucket of -log10 p that counts as found, given (class, bucket, candidates).

    In a class of m candidates a bucket b is found from where 10 ** (-b / 100) * m is at most rate times the candidates from b on.
    """
    least = [FINEST + 1] * len(LENGTHS)
    for number in range(len(LENGTHS)):
        own = sorted(((b, n) for c, b, n in counts if c == number), reverse=True)
        m, seen = sum(n for _, n in own), 0
        for b, n in own:
            seen += n
            if 10 ** (-b / 100) * m <= rate * seen:
                least[number] = b
    return least


def find(docs: DataFrame, *, rate: float = 0.05, id_column: str = "doc_id") -> DataFrame:
    """id, base and added spans of every text as arrays of (start, kind, end), and how many base spans the tests confirm.

    kind is a number into KINDS, added ones are 3. Candidates that touch a base span are tested as others are, and confirm it instead of adding a
    span. Null and empty texts have none; repeated rows have their own; spans are sorted by start, then kind, then end; other columns, however
    named, stay out, and an empty table gives no rows. What text looks like, and the share of false finds, are taken over all documents; at most
    a number a sign, and one a class and bucket, reach the driver.
    """
    scanned = hold(scan(docs, id_column), "spans")
    sums = scanned.filter("signs is not null").select(F.posexplode("signs").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    text = text_pairs({SIGNS[r["at"]]: r["n"] for r in sums})

    def judge(batches):
        for batch in batches:
            cells = []
            for row in batch.column("found").to_pylist():
                own = []
                for f in row:
                    p = p_value(f["alphabet"], f["n"], f["pairs"], f["steps"], f["correlation"], text)
                    bucket = min(FINEST, int(-100 * math.log10(p))) if p > 0 else FINEST
                    own.append({"class": sum(f["n"] >= x for x in LENGTHS) - 1, "bucket": bucket, "start": f["start"], "end": f["end"], "apart": f["apart"]})
                cells.append(own)
            kind = pa.list_(pa.struct([("class", pa.int32()), ("bucket", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("apart", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("base"), pa.array(cells, kind)], ["id", "base", "judged"])

    kind = scanned.schema["id"].dataType.simpleString()
    judged = scanned.select("id", "base", "found").mapInArrow(judge, f"id {kind}, base array<struct<start:long,kind:int,end:long>>, judged array<struct<class:int,bucket:int,start:long,end:long,apart:boolean>>")
    each = judged.select(F.explode("judged").alias("j")).groupBy("j.class", "j.bucket").count().collect()
    least = F.array(*(F.lit(b) for b in step_up([tuple(r) for r in each], rate)))
    passed = F.filter("judged", lambda j: j["bucket"] >= F.get(least, j["class"]))
    span = lambda j: F.struct(j["start"].alias("start"), F.lit(3).alias("kind"), j["end"].alias("end"))
    out = judged.select(F.col("id").alias(id_column), F.array_sort("base").alias("base"), passed.alias("judged"))
    added = F.transform(F.filter("judged", lambda j: j["apart"]), span)
    confirmed = F.filter("base", lambda s: F.exists("judged", lambda j: (j["start"] < s["end"]) & (j["end"] > s["start"])))
    return out.select(id_column, "base", added.alias("added"), F.size(confirmed).alias("n_confirmed"))


def span_text(spans: Column) -> Column:
    """kind:start:end of spans, by start and then as kinds are listed, joined by commas."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
