"""Document fingerprints by invertible Bloom lookup sketches of paragraphs.

A text is the set of its paragraphs' digests; a paragraph is a line of the text, cut every WORDS
words, as whole lines are too coarse for texts of one line. A sketch of size m adds each digest to one cell of
each of three subtables of m cells: a cell holds a count and the XOR of its digests. Only cells that are not
empty are kept, so a roomy size (SPACE times the digests, up to a power of two) costs nothing. The
fingerprint is that sketch. Sketches of one size subtract cell by cell, which leaves what differs; peeling takes
digests out of cells that hold just one until none is left. Texts of two sizes meet at the larger
one, and a pair that does not peel is drawn again at twice the size. DataFrame and SQL functions only: a
sketch is an array in its row, so nothing is exploded or grouped.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import hold, partitions

#: Words of a paragraph at most; cells of a subtable for each digest; cells of a block of a large sketch.
WORDS, SPACE, BLOCK = 16, 4, 1024
#: Rounds of peeling at one size, and how often the size may double: far more than ever happen.
ROUNDS, TRIES = 40, 12
#: Low bits of a digest that are a hash of its other bits, so a cell that holds several digests is known as such.
PROOF = 0xFFFF


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs: 48 bits of a hash and 16 bits that prove them."""
    lines = F.regexp_extract_all(text, F.lit(r"(?:\S+[^\S\n]*){1,%d}" % WORDS), F.lit(0))
    hashes = F.transform(lines, lambda x: F.shiftrightunsigned(F.xxhash64(F.rtrim(x)), 16))
    return F.array_distinct(F.transform(hashes, lambda h: F.shiftleft(h, 16).bitwiseOR(F.xxhash64(h, F.lit(9)).bitwiseAND(F.lit(PROOF).cast("long")))))


def size_for(n: Column) -> Column:
    """The least power of two from 16 that is no smaller than SPACE times n."""
    return F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.greatest(n * SPACE, F.lit(1)))), F.lit(4))).cast("long")


# The rest is SQL text: {names} stand for SQL expressions, and let() names a value that is worked out once.


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def entries(keys: str, n: int, size: str) -> str:
    """The three cells of every digest, each with count n: bits of one hash, which the size salts, so a retry deals anew."""
    low = f"least({size}, {BLOCK}L)"
    spots = [f"(h & ({low} - 1)) + {s} * {low}" if not s else f"(shiftright(h, {20 * s}) & ({low} - 1)) + {s} * {low}" for s in range(3)]
    cells = ", ".join(f"named_struct('cell', {x}, 'n', {n}L, 'key', k)" for x in spots)
    return f"flatten(transform({keys}, k -> {let('h', f'xxhash64(k, {size})', f'array({cells})')}))"


def merged(cells: str) -> str:
    """Cells of one number added up, empty ones left out, in order of their numbers: runs of the sorted numbers."""
    starts = "filter(sequence(1, size(p)), i -> i = 1 OR shiftright(p[i - 1], 24) <> shiftright(p[i - 2], 24))"
    at = "e[cast(q & 16777215 as int)]"
    run = "slice(p, i, coalesce(get(b, j + 1), size(p) + 1) - i)"
    total = f"named_struct('cell', shiftright(p[i - 1], 24), 'n', aggregate(r, 0L, (x, q) -> x + {at}.n), 'key', aggregate(r, 0L, (x, q) -> x ^ {at}.key))"
    one = "if(size(r) = 1, e[cast(r[0] & 16777215 as int)], " + total + ")"
    sums = f"filter(transform(b, (i, j) -> {let('r', run, one)}), c -> c.n <> 0 OR c.key <> 0)"
    return let("e", cells, f"if(size(e) = 0, e, {let('p', 'sort_array(transform(e, (c, i) -> shiftleft(c.cell, 24) | i))', let('b', starts, sums))})")


def drawn(keys: str, n: int, size: str, add=lambda cells: cells) -> str:
    """Blocks of entries. A digest belongs to one block by its hash, so very long texts cost no more a digest than short ones."""
    own = f"filter({keys}, k -> pmod(xxhash64(k), {size} div {BLOCK}) = h)"
    return f"if({size} <= {BLOCK}, array({add(entries(keys, n, size))}), transform(sequence(0L, {size} div {BLOCK} - 1), h -> {add(entries(own, n, size))}))"


def sketch(keys: str, size: str) -> str:
    return drawn(keys, 1, size, merged)


def peeled(block: str, size: str) -> str:
    """Of one block of a difference: cells that stay, digests found with count 1 (plus) and with count -1 (minus)."""
    pure = f"(abs(c.n) = 1 AND (xxhash64(shiftrightunsigned(c.key, 16), 9) & {PROOF}) = (c.key & {PROOF}))"
    found = lambda n: f"array_distinct(transform(filter(u, c -> c.n = {n}), c -> c.key))"
    hits = f"filter(concat({entries('f.plus', -1, size)}, {entries('f.minus', 1, size)}), x -> array_contains(t, x.cell))"
    rest = f"filter(a.cells, c -> NOT {pure})"
    after = f"named_struct('cells', if(size(o) = 0, o, {let('t', 'transform(o, c -> c.cell)', merged(f'concat(o, {hits})'))}), 'plus', concat(a.plus, f.plus), 'minus', concat(a.minus, f.minus))"
    step = let("u", f"filter(a.cells, c -> {pure})", f"if(size(u) = 0, a, {let('f', f"named_struct('plus', {found(1)}, 'minus', {found(-1)})", let('o', rest, after))})")
    none = "cast(array() as array<bigint>)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {block}, 'plus', {none}, 'minus', {none}), (a, z) -> if(size(a.cells) = 0, a, {step}))"


def differing(left: str, right: str, own: str, left_size: str, other: str | None, right_size: str) -> Column:
    """What peeling finds where two lists of digests differ: plus (only left), minus (only right).

    own and other are the lists' sketches and serve where the size is theirs. The size doubles until nothing stays and
    both lists have equally many digests in common.
    """
    x = f"if(s.size = {left_size}, {own}, {drawn(left, 1, 's.size')})"
    negated = f"transform({other}, m -> transform(m, c -> named_struct('cell', c.cell, 'n', -c.n, 'key', c.key)))"
    y = drawn(right, -1, "s.size") if other is None else f"if(s.size = {right_size}, {negated}, {drawn(right, -1, 's.size')})"
    blocks = f"zip_with({x}, {y}, (m, n) -> {let('d', merged('concat(m, n)'), peeled('d', 's.size'))})"
    done = f"aggregate(w, 0, (i, r) -> i + size(r.cells)) = 0 AND size({left}) - aggregate(w, 0, (i, r) -> i + size(r.plus)) = size({right}) - aggregate(w, 0, (i, r) -> i + size(r.minus))"
    attempt = let("w", blocks, f"named_struct('size', s.size * 2, 'done', {done}, 'plus', flatten(transform(w, r -> r.plus)), 'minus', flatten(transform(w, r -> r.minus)))")
    none = "cast(array() as array<bigint>)"
    start = f"named_struct('size', greatest({left_size}, {right_size}), 'done', false, 'plus', {none}, 'minus', {none})"
    return F.expr(f"aggregate(sequence(1, {TRIES}), {start}, (s, z) -> if(s.done, s, {attempt}))")


def written(size: str, blocks: str) -> Column:
    """A sketch as text: its size, then cell, count and digests of each cell in hexadecimal, blocks apart."""
    return F.expr(f"concat(cast({size} as string), ':', array_join(transform({blocks}, b -> array_join(transform(b, c -> concat(hex(c.cell), '.', hex(c.n), '.', hex(c.key))), ',')), ';'))")


def search(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are no greater than value: a binary search."""
    if not bounds:
        return F.lit(0)
    held = F.array(*(F.lit(x).cast("long") for x in bounds))
    half = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")

    def step(s, _):
        up = F.element_at(held, half(s) + 1) <= value
        return F.when(s["low"] >= s["high"], s).when(up, F.struct((half(s) + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), half(s).alias("high")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), step, lambda s: s["low"])


def chained(docs: DataFrame, id_column: str, buckets: int | None = None) -> DataFrame:
    """Every document with the text of the next one by id (after the last: the first).

    Documents are dealt by quantiles of their ids into a number of buckets that follows the shuffle partitions, so
    outlying ids fill no bucket. Inside a bucket the next row follows; its last row takes the first row of the next bucket: one row a bucket.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))).alias("id"), F.col(id_column).cast("long").alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    buckets = buckets or min(16 * partitions(spark), 8192)
    cuts = [k / buckets for k in range(1, buckets)]
    found = rows.agg(F.percentile_approx("id", F.array(*(F.lit(c) for c in cuts)), 20 * buckets)).first()[0] if cuts else None
    rows = rows.withColumn("bucket", search(sorted(set(found or [])), F.col("id")))
    # one row a bucket: its least id, and the text that goes with it
    least = rows.groupBy("bucket").agg(F.min("id").alias("least"))
    firsts = rows.join(F.broadcast(least.select("least")), rows.id == F.col("least"), "left_semi").groupBy("bucket").agg(F.min(F.struct("id", "text")).alias("x"))
    firsts = firsts.select(F.col("bucket").alias("first_of"), F.col("x.text").alias("first_text"))
    order = Window.orderBy("bucket")  # over buckets alone, at most 8192 rows
    turn = least.select(F.col("bucket").alias("of"), F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order)).alias("follows"))
    after = hold(turn.join(firsts, F.col("follows") == F.col("first_of")).select("of", "first_text"), "bucket-edges")
    # at most 8192 texts, one a bucket
    order = Window.partitionBy("bucket").orderBy("id", "text")
    dealt = rows.repartition("bucket").withColumn("keys", digests(F.col("text"))).withColumn("lead", F.lead(F.struct("text", "keys")).over(order))
    dealt = dealt.join(after, F.col("bucket") == F.col("of"), "left")
    edge = F.col("lead").isNull()
    following = F.when(edge, F.struct(F.col("first_text").alias("text"), digests(F.col("first_text")).alias("keys"))).otherwise(F.col("lead"))
    return dealt.select("name", "text", "keys", following.alias("next"))


def edited(text: Column, after: Column) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))


def fingerprint(docs: DataFrame, *, id_column: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """n_chars, edited_sha256, fingerprints and likenesses of every text, its edited text and the next document's.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document's. Null texts are empty; a null id counts as the lowest; rows of one id, repeated rows among them, follow each
    other by text; a text that stands alone is its own next. An empty table gives no rows; other columns, however named, stay out.
    Very long texts get sketches of several blocks, and no text is cut.
    edited_differs and next_differs: the digests that peeling recovered, plus those that only the text has and minus
    those that only the other has. Likeness: paragraphs in both over paragraphs in either; 1 for two texts without any.
    """
    rows = chained(docs, id_column, buckets).withColumn("other", edited(F.col("text"), F.col("next.text")))
    rows = rows.select("name", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("other", "UTF-8"), 256).alias("edited_sha256"), F.col("keys").alias("k0"), digests(F.col("other")).alias("k1"), F.col("next.keys").alias("k2"))
    rows = rows.withColumns({f"m{i}": size_for(F.size(f"k{i}")) for i in range(3)})
    rows = rows.withColumn("own", F.expr(sketch("k0", "m0"))).withColumn("changed", F.expr(sketch("k1", "m1")))
    rows = rows.withColumn("e", differing("k0", "k1", "own", "m0", "changed", "m1")).withColumn("f", differing("k0", "k2", "own", "m0", None, "m2"))

    def likeness(found: str) -> Column:
        both, either = f"(size(k0) - size({found}.plus))", f"(size(k0) + size({found}.minus))"
        return F.expr(f"if({either} = 0, 1D, round({both} / {either}, 6))")

    differs = lambda c: F.struct(f"{c}.plus", f"{c}.minus")
    return rows.select(
        F.col("name").alias(id_column), "n_chars", "edited_sha256", written("m0", "own").alias("fingerprint"), written("m1", "changed").alias("edited_fingerprint"),
        likeness("e").alias("near_edited"), likeness("f").alias("near_next"), differs("e").alias("edited_differs"), differs("f").alias("next_differs"),
    )
