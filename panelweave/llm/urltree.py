"""URL filters: host and path rules, and a path-template tree for what no rule fits.

For each host, path segments with many values become wildcards; sibling branches whose labelled
shares of bad pages do not differ statistically merge, from the leaves up to the host; a template is
rejected when its labelled purity, smoothed towards its parent's and so the host's, passes a threshold. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import hold

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#`, lower case; path: from there up to `?` or `#`. Both empty without `://`."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule `host/path...`; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        of, _, start = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], by: list[str], ways: int = 32) -> DataFrame:
    """Join on keys of which one may hold most rows: the small side comes once for each of `ways` shares of the big one."""
    dealt = big.withColumn("share", F.pmod(F.xxhash64(*by), F.lit(ways)).cast("int"))
    return dealt.join(small.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))), [*keys, "share"]).drop("share")


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, labels: DataFrame | None = None, depth: int = 4, values: int = 8, z: float = 2.0, smoothing: float = 4.0, prior: float = 0.1, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page.

    labels (page_id, bad 0/1) teach the templates; by default the pages that a rule blocks or allows do. A segment
    of a node is a wildcard when the exponential of its values' entropy, which does not grow with repeats, is at
    least `values`; a value with `values` labelled pages or more whose bad share lies outside z standard errors of
    the node's keeps its name. Segments with digits count by their shape. Deeper segments than depth are one.
    Branches of a parent merge when their bad share lies within z standard errors of the parent's; a parent all of whose
    branches are one may merge with its own siblings in turn. Purity is the bad share smoothed by `smoothing`
    pseudo-pages towards that of the parent, which is smoothed towards its own, up to the host, and the host's towards
    `prior`: a template without labelled pages takes after its parent, and a host without any is not rejected.
    Null urls have empty host and path and the template of the empty host; repeated rows are judged alike and stay.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_for(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), said.alias("said"))
    if labels is None:
        rows = rows.withColumn("bad", F.when(F.col("said") == "block", 1.0).when(F.col("said") == "allow", 0.0))
    else:
        taught = labels.filter(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("double").alias("bad"))
        rows = rows.join(taught, "page_id", "left")
    shape = lambda s: F.when(s.rlike("[0-9]"), F.regexp_replace(s, "[0-9]+", "0")).otherwise(s)
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    last = F.array_join(F.slice(parts, depth, 1_000_000), "/")
    segments = [F.coalesce(F.try_element_at(parts, F.lit(i + 1)) if i < depth - 1 else F.when(F.size(parts) >= depth, last), F.lit("")) for i in range(depth)]
    paths = rows.select("host", "path", "bad", *(x.alias(f"s{i}") for i, x in enumerate(segments))).groupBy("host", *(F.col(f"s{i}") for i in range(depth))).agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.sum("bad").alias("bad"))
    tree = hold(paths.withColumn("template", F.lit("")).withColumn("ups", F.array(F.lit(""))), "url-paths")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    alike = lambda share: F.abs(F.col("bad") - F.col("known") * share) <= z * F.sqrt(F.greatest(F.col("known") * share * (1 - share), F.lit(0.0)))
    share = F.coalesce(F.col("pb") / F.nullif(F.col("pk"), F.lit(0)), F.lit(0.0))
    for i in range(depth):  # level by level: what stands above a segment is already general
        children = tree.groupBy("host", "template", f"s{i}").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), total("bad").alias("bad"))
        spread = F.exp(F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n"))
        nodes = hold(children.groupBy("host", "template").agg((F.round(spread, 6) >= values).alias("variable"), F.sum("known").alias("pk"), F.sum("bad").alias("pb")), "url-nodes")
        named = children.filter(F.col("known") >= values).join(nodes.filter("variable"), ["host", "template"]).filter(~alike(share)).select("host", "template", f"s{i}", F.lit(True).alias("named"))
        tree = spread_join(tree, nodes.select("host", "template", "variable"), ["host", "template"], [f"s{j}" for j in range(depth)]).join(named, ["host", "template", f"s{i}"], "left")
        wild = F.col("variable") & F.col("named").isNull()
        piece = F.when(F.col(f"s{i}") == "", "").when(wild & F.col(f"s{i}").rlike("[0-9]"), F.regexp_replace(shape(F.col(f"s{i}")), "0", "*")).when(wild, "*").otherwise(F.col(f"s{i}"))
        tree = tree.withColumn("piece", piece).withColumn("template", F.when(F.col("piece") == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), "piece")))
        tree = tree.withColumn("ups", F.when(F.col("piece") == "", F.col("ups")).otherwise(F.concat("ups", F.array("template")))).drop("variable", "named", "piece")
        tree = hold(tree, "url-tree")  # each level is read twice: without this, plans double with each
    # ups: a template and all that stands above it, the host's root first
    leaves = tree.groupBy("host", "template").agg(F.max("ups").alias("ups"), F.sum("known").alias("known"), total("bad").alias("bad"))
    leaves = hold(leaves.withColumn("depth", F.size("ups") - 1), "url-leaves")
    smooth = lambda to: (F.col("bad") + smoothing * to) / (F.col("known") + smoothing)
    at = lambda level: F.try_element_at("ups", F.lit(level + 1))
    sums = [F.sum("known").alias("known"), F.sum("bad").alias("bad")]
    means = hold(leaves.groupBy("host").agg(*sums).select("host", F.lit(0).alias("level"), F.lit("").alias("node"), smooth(F.lit(prior)).alias("mean")), "url-means")
    every = means
    for level in range(1, depth):
        part = leaves.filter(F.col("depth") > level).groupBy("host", at(level - 1).alias("above"), at(level).alias("node")).agg(*sums)
        part = part.join(means.select("host", F.col("node").alias("above"), F.col("mean").alias("to")), ["host", "above"])
        means = hold(part.select("host", F.lit(level).alias("level"), "node", smooth(F.col("to")).alias("mean")), "url-means")
        every = every.unionByName(means)
    # from the leaves up: `height` is where a branch stands now, -1 once it cannot rise; `level` is that of its parent
    state = leaves.withColumns({"merged": F.col("template"), "height": F.col("depth"), "level": F.greatest(F.col("depth") - 1, F.lit(0))})
    for level in range(depth, 0, -1):
        up, node = at(level - 1).alias("up"), at(level).alias("node")
        below = state.filter(F.col("depth") >= level)
        above = below.groupBy("host", up).agg(F.sum("known").alias("pk"), F.sum("bad").alias("pb"), F.count("*").alias("all"))
        branch = below.filter(F.col("height") == level).groupBy("host", up, node).agg(*sums, F.count("*").alias("size"), F.countDistinct("merged").alias("names"))
        branch = branch.join(above, ["host", "up"]).withColumn("alike", alike(share))
        group = branch.groupBy("host", "up").agg(F.count(F.when(F.col("alike"), 1)).alias("many"), F.coalesce(F.sum(F.when(F.col("alike"), F.col("size"))), F.lit(0)).alias("held"))
        branch = branch.join(group, ["host", "up"]).select("host", "up", "node", (F.col("alike") & (F.col("many") > 1)).alias("joins"), F.when(F.col("many") > 1, F.col("alike") & (F.col("held") == F.col("all"))).otherwise((F.col("size") == F.col("all")) & (F.col("names") == 1)).alias("rises"))
        here = state.filter(F.col("height") == level).withColumns({"up": at(level - 1), "node": at(level)}).join(branch, ["host", "up", "node"])
        here = here.withColumn("merged", F.when(F.col("joins"), F.concat("up", F.lit("/{*}"))).otherwise(F.col("merged")))
        here = here.withColumn("level", F.when(F.col("joins"), level - 1).otherwise(F.col("level"))).withColumn("height", F.when(F.col("rises"), level - 1).otherwise(-1))
        state = hold(here.select(state.columns).unionByName(state.filter(F.col("height") != level)), "url-merged")
    leaves = state.withColumn("node", F.element_at("ups", F.col("level") + 1))
    branch = leaves.groupBy("host", "merged").agg(*sums, F.min("level").alias("level"), F.min_by("node", "level").alias("node")).join(every, ["host", "level", "node"])
    branch = branch.select("host", "merged", F.round(smooth(F.col("mean")), 6).alias("purity"))
    judged = leaves.select("host", "template", "merged").join(branch, ["host", "merged"])
    named = spread_join(tree.select("host", *(f"s{i}" for i in range(depth)), "template"), judged, ["host", "template"], [f"s{i}" for i in range(depth)])
    named = named.select("host", *(f"s{i}" for i in range(depth)), F.col("merged").alias("template"), "purity")
    out = rows.select("*", *(x.alias(f"s{i}") for i, x in enumerate(segments))).join(named, ["host", *(f"s{i}" for i in range(depth))])
    verdict = F.coalesce("said", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
