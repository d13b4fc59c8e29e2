"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document is its set of distinct word shingles. Equal sets collapse into one class first.
SuperMinHash gives each element a random permutation of the registers and the values
rank + fraction along it, so ranks in one element are anti-correlated and estimates vary less than
with independent minima; an element stops once its next rank cannot lower any register.
Bands of registers make candidate buckets; links are confirmed on full sets.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import freeing, hold, mix, slices, string_hashes, whole_texts

STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles, A-Z lowered, cut at ASCII white space.

    A text of fewer words is one shingle; one without words has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    codes, offsets = np.asarray(coded.indices), np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
    hashes = string_hashes(coded.dictionary)
    real = np.asarray(pc.greater(pc.binary_length(coded.dictionary), 0))[codes] if len(codes) else np.zeros(0, bool)
    ends = np.r_[0, np.cumsum(real)][offsets]
    h = hashes[codes[real]] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = h
        for k in range(1, words):
            rolled = mix(rolled[:-1] * STEP + h[k:]) if len(rolled) > 1 else rolled[:0]
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                x = h[a : a + 1] + STEP * np.uint64(b - a)
                for k in range(a + 1, b):
                    x = mix(x * STEP + h[k : k + 1])
                out.append(mix(x + np.uint64(1)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def super_minhash(flat: np.ndarray, of: np.ndarray, sets: int, registers: int) -> np.ndarray:
    """The signatures of sets of hashed elements, all sets in step: round j gives each element its jth rank."""
    signature = np.full((sets, registers), np.inf)
    x, own, order = flat, of, None
    for j in range(registers):
        with np.errstate(over="ignore"):
            r = mix(x + STEP * np.uint64(j + 1))
        fraction = (r >> np.uint64(11)).astype(np.float64) / 2.0**53
        k = (j + (r & np.uint64(0x7FF)) * np.uint64(registers - j) // np.uint64(0x800)).astype(np.int64)
        if j == 0:
            register = k
        else:  # Fisher-Yates: the element's permutation, one swap a round
            rows = np.arange(len(x))
            register = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
        np.minimum.at(signature, (own, register), fraction + j)
        going = (signature.max(axis=1) >= j + 1)[own]
        if not going.any():
            break
        if j == 0:
            order = np.tile(np.arange(registers, dtype=np.int16), (int(going.sum()), 1))
            rows = np.arange(len(order))
            order[rows, k[going]] = 0
        elif not going.all():
            order = order[going]
        x, own = x[going], own[going]
    return signature


def signatures(docs: DataFrame, *, words: int, bands: int, rows: int, id_column: str) -> DataFrame:
    """n_shingles, a digest of the whole set and the band keys of every document."""
    source = whole_texts(docs, id_column)

    def sign(batches):
        import xxhash

        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), words)
                size = np.array([len(s) for s in sets], np.int64)
                keys = np.zeros((len(sets), bands), np.uint64)
                group = np.cumsum(size) // 60_000
                for g in np.unique(group):
                    at = np.flatnonzero((group == g) & (size > 0))
                    if len(at):
                        sig = super_minhash(np.concatenate([sets[i] for i in at]), np.repeat(np.arange(len(at)), size[at]), len(at), bands * rows).view(np.uint64)
                        with np.errstate(over="ignore"):
                            key = np.arange(bands, dtype=np.uint64) + STEP
                            for k in range(rows):
                                key = mix(key * STEP + sig[:, k::rows])
                        keys[at] = key
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(id_column).cast(pa.int64()), pa.array(size), pa.array(digest, pa.binary()), lists], ["id", "n_shingles", "digest", "keys"])

    return source.mapInArrow(freeing(sign), "id long, n_shingles long, digest binary, keys array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for the nodes of edges a, b.

    Each task joins its links by union-find and passes on one link a node; then labels hop along
    links and to their labels' labels until none changes. No link leaves the executors.
    """

    def forest(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [*parent]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])

    links = edges.select("a", "b").mapInArrow(freeing(forest), "a long, b long").filter("a <> b")
    links = hold(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = hold(links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        step = step.join(jump, step.label == jump.up, "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label"))
        step = hold(step, "labels")
        if step.filter("label <> old").isEmpty():
            return step.select("node", F.col("label").alias("component"))
        labels = step.select("node", "label")


def members_of(nodes: DataFrame, bits: int = 26):
    """A test that every id of nodes passes and few others do: a Bloom filter of 2 ** bits bits, 8 MB by default, whatever the number of nodes.

    Where nodes are too many for it, it lets more of the others pass and saves less; the result does not hang on it.
    """

    def spots(ids) -> np.ndarray:
        x = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            return np.stack([mix(x + STEP * np.uint64(k + 1)) >> np.uint64(64 - bits) for k in range(3)])

    def fill(batches):
        for batch in batches:
            at = spots(batch.column("id")).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "mask"])

    words = nodes.mapInArrow(freeing(fill), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.word.to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)

    def test(ids) -> np.ndarray:
        at = spots(ids)
        return ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)

    return test


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For pairs a, b: the sizes na, nb of their sets, how many they have in both, and what of a is outside b."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))

    def compare(batches):
        for batch in batches:
            na, nb, both, outside = [], [], [], []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                inside = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                na.append(len(x))
                nb.append(len(y))
                both.append(int(inside.sum()))
                outside.append(x[~inside].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, pa.int64()) for c in (na, nb, both)), pa.array(outside, pa.list_(pa.int64()))], ["a", "b", "na", "nb", "both", "outside"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(freeing(compare), "a long, b long, na long, nb long, both long, outside array<long>")


def apart(seen: DataFrame, found: DataFrame, share: int) -> DataFrame:
    """Pairs a, b of one bucket that may still be linked although its centre left a apart.

    If a is not linked to the centre c, a set y of the bucket that a is linked to has at least
    need = share / (100 + share) * (|a| + |y|) - |a and c| of a's elements that are outside c, where |y| is at least the bucket's
    smallest size and share percent of |a|. Where need is positive, y has one of any |outside| - need + 1 of them: the
    rarest are taken, and those that no other member has are passed over. Where it is not, sets small
    enough to make it so are taken as they are, and need is taken anew at the smallest size that these
    leave out, where it is 1 or more.
    """
    label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    rows = seen.join(label("a"), "a", "left").join(label("b"), "b", "left")
    rows = rows.select("a", "b", "na", "both", "outside", F.coalesce("of_a", "a").alias("of"), (F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).alias("open"))
    centres = rows.groupBy("b").agg(F.max("open").alias("any"), F.count("*").alias("size"), F.min("na").alias("least")).filter("any and size > 1").select("b", "least")
    least = F.greatest("least", F.ceil(F.col("na") * share / 100))
    rows = rows.join(centres, "b").withColumn("loose", F.ceil(share * (F.col("na") + least) / (100 + share)) <= F.col("both"))
    reach = F.when(F.col("loose"), F.floor(F.col("both") * (100 + share) / share) - F.col("na") + 1).otherwise(least)
    rows = hold(rows.withColumn("reach", reach).withColumn("need", F.ceil(share * (F.col("na") + F.col("reach")) / (100 + share)) - F.col("both")), "apart")
    each = rows.select("b", "a", "of", "open", F.explode("outside").alias("e"))
    common = each.groupBy("b", "e").agg(F.count("*").alias("times"), F.max("open").alias("any"), (F.min("of") != F.max("of")).alias("mixed")).filter("times > 1 and any")
    each = hold(each.join(common, ["b", "e"]).select("b", "a", "of", "open", "e", "times", "mixed"), "shared-elements")
    having = each.filter("open").groupBy("b", "a").agg(F.count("*").alias("having"))
    wanted = rows.filter(F.col("open") & (F.col("reach") * share <= F.col("na") * 100)).join(having, ["b", "a"]).filter("having >= need").select("b", "a", (F.col("having") - F.col("need") + 1).alias("first"))
    rank = F.row_number().over(Window.partitionBy("b", "a").orderBy("times", "e"))
    keys = each.filter("open").withColumn("rank", rank).join(wanted, ["b", "a"]).filter("rank <= first and mixed").select("b", "e", F.col("a").alias("x"), F.col("of").alias("of_x"))
    pairs = keys.join(each.select("b", "e", "a", "of"), ["b", "e"]).filter("of <> of_x").select("a", F.col("x").alias("b"))
    loose = rows.filter("open and loose").select("b", F.col("a").alias("x"), F.col("na").alias("nx"), F.col("both").alias("bx"), F.col("of").alias("of_x"))
    small = (F.ceil(share * (F.col("nx") + F.col("na")) / (100 + share)) <= F.col("bx")) & (F.col("na") * 100 >= F.col("nx") * share) & (F.col("nx") * 100 >= F.col("na") * share)
    more = loose.join(rows.select("b", "a", "na", "of"), "b").filter((F.col("of") != F.col("of_x")) & small).select("a", F.col("x").alias("b"))
    both = pairs.unionByName(more)
    return hold(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "open-pairs")


def group(docs: DataFrame, *, words: int = 5, share: int = 80, bands: int = 32, rows: int = 4, id_column: str = "doc_id") -> DataFrame:
    """n_shingles, component_id and kept of every document.

    Documents are linked at share percent of the union or more. Null and empty texts have no
    shingles and stand alone. At the share of 80, 32 bands of 4 registers miss a link with
    probability 5e-8. A bucket compares its members with a centre alone, the member that meets most
    others, so copies are not expanded into pairs; pairs that this may have left apart are found by
    the elements that they share outside the centre (see apart). No link within a bucket is lost.
    Nodes are distinct sets: rows that share an id, with equal or different texts, are each judged by their own set, and all stay. A
    component's id is the smallest of all its rows. An empty table gives no rows; other columns, however named, stay out; very long
    texts are taken whole. A null id is never kept.
    """
    signed = hold(signatures(docs, words=words, bands=bands, rows=rows, id_column=id_column), "signatures")
    # a class of equal sets is a node; its number is of its own, as two of them may share their smallest id
    classes = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = hold(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = classes.select("id", "n", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = hold(members.join(buckets, "key"), "members")
    # the centre is the member that meets most others over all its buckets: near copies of one text meet that text
    meets = shared.groupBy("id").agg(F.sum("size").alias("meets"))
    centre = shared.join(meets, "id").groupBy("key").agg(F.max_by("id", F.struct("meets", -F.col("n"), -F.col("id"))).alias("centre"))
    shared = hold(shared.join(centre, "key").select("id", "centre").distinct(), "buckets")
    nodes = hold(classes.select("digest", "id", "least").join(shared.select("id").distinct(), "id"), "nodes")
    among = members_of(nodes.select(F.col("least").alias("id")))

    def cut(batches):
        """The sets of the nodes' first rows. Most other rows are passed over here, so their sets are not shuffled; the join drops the rest."""
        import xxhash

        for batch in batches:
            for part in slices(batch.filter(pa.array(among(batch.column("id"))))):
                hashes = [s.tobytes() for s in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h) for h in hashes], pa.binary()), pa.array(hashes, pa.binary())], ["digest", "hashes"])

    texts = whole_texts(docs, id_column).select(F.col(id_column).cast("long").alias("id"), "text")
    cuts = texts.mapInArrow(freeing(cut), "digest binary, hashes binary").join(nodes.select("digest", "id"), "digest")
    sets = hold(cuts.groupBy("digest").agg(F.first("id").alias("id"), F.first("hashes").alias("hashes")).select("id", "hashes"), "sets")
    linked = 100 * F.col("both") >= share * (F.col("na") + F.col("nb") - F.col("both"))
    seen = hold(compared(shared.select(F.col("id").alias("a"), F.col("centre").alias("b")).filter("a <> b").distinct(), sets), "compared")
    links = seen.filter(linked).select("a", "b")
    found = components(links)
    pairs = apart(seen, found, share)
    if not pairs.isEmpty():
        more = hold(compared(pairs, sets).filter(linked).select("a", "b"), "more-links")
        found = components(links.unionByName(more))
    linked = hold(classes.select("digest", "least", F.col("id").alias("node")).join(found, "node"), "linked")
    first = linked.groupBy("component").agg(F.min("least").alias("first"))
    named = linked.join(first, "component").select("digest", F.col("first").alias("component_id"))
    alone = classes.join(linked.select("digest"), "digest", "left_anti").select("digest", F.col("least").alias("component_id"))
    named = named.unionByName(alone)
    out = signed.select("id", "n_shingles", "digest").join(named, "digest", "left")
    out = out.select(F.col("id").alias(id_column), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_column) == F.col("component_id"))
