"""Mixing to target weights with soft domain membership.

A classifier fitted on a labelled table gives every document posteriors of the domains.
Nonnegative rates, one a document, are then fitted by projected-gradient least squares so that
the expected token totals of the domains match their targets. Each step is one aggregation over
a narrow table; the driver holds one number a domain. DataFrame functions only.
"""

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import hold

#: Weight of what domains owe beside the targets, which settles targets that no rates can meet.
RIDGE = 1e-6


def learn_marks(docs: DataFrame, labelled: DataFrame, *, each: int = 4, sample_rows: int = 400, chars: int = 3, id_column: str = "doc_id") -> tuple[str, ...]:
    """For each domain the substrings of `chars` characters that set its labelled texts most apart from the others'.

    sample_rows bounds the labelled rows a domain gives (in expectation: rows are taken by a hash of the id). A substring's
    worth is p * log(p / q), p and q the shares of the domain's and of the other texts that have it. The driver gets `each` strings a domain.
    """
    known = labelled.filter(F.col("domain").isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("of"), "domain").distinct()
    sizes = known.groupBy("domain").agg(F.count("*").alias("all"))
    known = known.join(sizes, "domain").filter(F.pmod(F.xxhash64(F.col("of").cast("string")), F.lit(1_000_000)) < F.lit(1_000_000.0) * sample_rows / F.col("all")).select("of", "domain")
    texts = docs.select(F.col(id_column).alias("of"), F.col("text").cast("string").alias("text")).filter(F.length("text") >= chars)
    # at most about sample_rows ids a domain: bounded by a parameter, so the broadcast is too
    texts = texts.join(F.broadcast(known), "of").select("domain", "text")
    # characters by their place in an array: a substring of a long text would be found by a walk from its start each time
    run = ", ".join(f"get(chars, i + {k})" for k in range(chars))
    texts = texts.select("domain", F.split("text", "").alias("chars"))
    texts = hold(texts.select("domain", F.expr(f"array_distinct(filter(transform(chars, (x, i) -> concat({run})), g -> g IS NOT NULL))").alias("grams")), "mark-texts")
    domain = texts.groupBy("domain").agg(F.count("*").alias("texts"))
    whole = texts.agg(F.count("*").alias("every"))
    counts = texts.select("domain", F.explode("grams").alias("mark")).groupBy("domain", "mark").agg(F.count("*").alias("n"))
    total = counts.groupBy("mark").agg(F.sum("n").alias("total"))
    rows = counts.join(total, "mark").join(domain, "domain").crossJoin(F.broadcast(whole))  # whole is one row
    p, q = F.col("n") / F.col("texts"), (F.col("total") - F.col("n") + 0.5) / (F.col("every") - F.col("texts") + 1.0)
    rows = rows.withColumn("worth", F.round(p * F.log(p / q), 9)).withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("worth"), "mark")))
    return tuple(sorted({r["mark"] for r in rows.filter(F.col("k") <= each).select("mark").collect()}))


def marks_of(docs: DataFrame, marks: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """n_tokens and, for each mark, the square root of its share of the text (bytes)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*keep, text.alias("text"))
    size = F.greatest(F.octet_length("text"), F.lit(1))
    share = [F.sqrt((F.octet_length("text") - F.octet_length(F.replace("text", F.lit(m), F.lit("")))) / size).alias(f"m{i}") for i, m in enumerate(marks)]
    return base.select(*keep, F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_tokens"), *share)


def classify(docs: DataFrame, labelled: DataFrame, *, marks: tuple[str, ...] | None = None, id_column: str = "doc_id"):
    """(domains, table with n_tokens and the posterior p_k of each domain).

    labelled: id and domain; rows with a null in either are no labels. Gaussian classes with a floor
    under the variances, fitted on all labelled rows, over the marks that the labels teach (or those given). The driver gets one
    row a domain. Without labels there is one domain, `all`.
    """
    marks = marks if marks is not None else learn_marks(docs, labelled, id_column=id_column)
    table = hold(marks_of(docs, marks, (id_column, "source")), "marks")
    names = [f"m{i}" for i in range(len(marks))]
    known = labelled.filter(F.col("domain").isNotNull()).select(F.col(id_column).alias("of"), "domain").dropDuplicates(["of", "domain"])
    stats = table.join(known, table[id_column] == known.of).groupBy("domain").agg(F.count("*").alias("n"), *(F.avg(m).alias(f"a_{m}") for m in names), *(F.var_pop(m).alias(f"v_{m}") for m in names))
    rows = sorted(stats.collect(), key=lambda r: str(r["domain"]))
    if not rows:
        return ["all"], table.select(id_column, "source", "n_tokens", F.lit(1.0).alias("p_0"))
    total = sum(r["n"] for r in rows)
    logs = []
    for r in rows:
        value = F.lit(math.log(r["n"] / total))
        for m in names:
            variance = max(r[f"v_{m}"], 1e-4) * 2  # marks are correlated: a wider class keeps membership soft
            value = value - (F.col(m) - r[f"a_{m}"]) * (F.col(m) - r[f"a_{m}"]) / (2 * variance) - 0.5 * math.log(variance)
        logs.append(value)
    scored = table.select(id_column, "source", "n_tokens", *(x.alias(f"l_{k}") for k, x in enumerate(logs)))
    top = F.greatest(*(F.col(f"l_{k}") for k in range(len(rows)))) if len(rows) > 1 else F.col("l_0")
    scored = scored.withColumn("top", top).select(id_column, "source", "n_tokens", *(F.exp(F.col(f"l_{k}") - F.col("top")).alias(f"e_{k}") for k in range(len(rows))))
    whole = sum((F.col(f"e_{k}") for k in range(1, len(rows))), F.col("e_0"))
    return [str(r["domain"]) for r in rows], scored.withColumn("whole", whole).select(id_column, "source", "n_tokens", *(F.round(F.col(f"e_{k}") / F.col("whole"), 6).alias(f"p_{k}") for k in range(len(rows))))


def mix(docs: DataFrame, labelled: DataFrame, *, targets: dict[str, float] | None = None, budget: int | None = None, marks: tuple[str, ...] | None = None, least: float = 0.0, power: float = 0.5, steps: int = 40, tolerance: float = 1e-3, id_column: str = "doc_id") -> DataFrame:
    """Every document with its tokens, posteriors, rate and whole number of copies.

    targets: weight of each domain (a missing domain has weight 0; none given: each domain's own
    share to the given power). budget: tokens wanted in all, by default those there are, or with least (the
    smallest rate allowed) as many as give the commonest domain that rate. A rate is the expected number of
    uses; copies rounds it up or down by a hash of the id, so copies add up to it. Documents without tokens, null texts
    among them, keep rate 1. Repeated rows get equal rates. Empty tables give no rows; a very long text is one row of
    numbers like any other; other columns, however named, stay out. A fit that is not within tolerance after `steps` steps warns.
    """
    domains, table = classify(docs, labelled, marks=marks, id_column=id_column)
    ks = range(len(domains))
    table = hold(table.withColumn("rate", F.lit(max(1.0, float(least)))), "mixing")
    gram = table.agg(*(F.sum(F.col("n_tokens") * F.col(f"p_{i}") * F.col(f"p_{j}")) for i in ks for j in ks), *(F.sum(F.col("n_tokens") * F.col(f"p_{i}")) for i in ks)).first()
    gram = np.array([x or 0.0 for x in gram], float)
    g, have = gram[: len(domains) ** 2].reshape(len(domains), -1), gram[len(domains) ** 2 :]
    if have.sum() > 0:
        weight = np.array([targets.get(d, 0.0) for d in domains]) if targets else have**power
        weight = weight / max(weight.sum(), 1e-12)
        want = weight * (budget or max(have.sum(), least * (have[weight > 0] / weight[weight > 0]).max(initial=0.0)))
        every = float(want.sum() or have.sum())
        ridge = RIDGE * np.diag(np.maximum(np.diag(g), 1.0))
        # a rate is its start less what its memberships owe, cut off at the least: of all rates that meet the targets the nearest
        # to their start over all tokens. What a domain owes is found by gradient steps in the metric of the rows that are not cut off.
        owed, before, halved = np.zeros(len(domains)), None, 0
        for _ in range(steps):
            value = F.col("rate") - sum((F.col(f"p_{k}") * float(owed[k]) for k in ks), F.lit(0.0))
            rate = F.greatest(F.lit(float(least)), value)
            free = F.when(value >= float(least), F.col("n_tokens"))
            sums = table.agg(*(F.sum(rate * F.col("n_tokens") * F.col(f"p_{k}")) for k in ks), *(F.sum(free * F.col(f"p_{i}") * F.col(f"p_{j}")) for i in ks for j in ks)).first()
            sums = np.array([x or 0.0 for x in sums])
            miss, own = sums[: len(domains)] - want, sums[len(domains) :].reshape(len(domains), -1)
            if np.abs(miss).max() <= tolerance * every:
                break
            slope = miss - ridge @ owed
            size = float(np.abs(slope / np.sqrt(np.diag(ridge))).max())
            if before is not None and size >= before[1] and halved < 6:
                owed, halved = (owed + before[0]) / 2, halved + 1  # too far: half the step
                continue
            before, halved = (owed, size), 0
            owed = owed + np.linalg.solve(own + ridge, slope)
        else:
            warnings.warn(f"mixing targets missed by {np.abs(miss).max() / every:.2%} of all tokens after {steps} steps", stacklevel=2)
        table = table.withColumn("rate", F.when(F.col("n_tokens") > 0, rate).otherwise(F.lit(1.0)))
    u = F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit("mix")), F.lit(1_000_000)) / 1e6
    best = F.greatest(*(F.struct(F.col(f"p_{k}").alias("p"), F.lit(d).alias("d")) for k, d in enumerate(domains)))["d"] if len(domains) > 1 else F.lit(domains[0])
    return table.select(id_column, "source", "n_tokens", best.alias("domain"), *(F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(domains)), "rate", F.floor(F.col("rate") + u).cast("int").alias("copies"))


def domains_of(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """A labelled table: a labelled document's domain is `junk` at quality 0, else its language."""
    low = labels.filter(F.col("quality").isNotNull()).groupBy(id_column).agg(F.min("quality").alias("quality"))
    langs = docs.select(F.col(id_column).alias("of"), F.coalesce("lang", F.lit("other")).alias("lang"))
    return low.join(langs, low[id_column] == langs.of).select(id_column, F.when(F.col("quality") == 0, "junk").otherwise(F.col("lang")).alias("domain"))
