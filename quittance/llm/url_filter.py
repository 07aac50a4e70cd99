"""URL verdicts: host rules first, then gradient-boosted trees on lexical features; DataFrame operations only.

Trees are grown level by level: one aggregation gives the histogram of every (node, feature, bin), the driver reads that
small table and picks the splits. Scoring is one expression of nested CASEs, so it runs inside the scan's stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Distinct labelled URLs that the trees are fitted on at most, the least by hash of the URL; bins of a feature; trees and depth.
SAMPLE, BINS, TREES, DEPTH = 20_000, 12, 10, 3
RATE, SMOOTH, LEAST_ROWS = 0.3, 1.0, 5
#: Folds of labelled URLs: the trees learn what a suffix's rate tells from rates without the URL's own fold.
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "secure", "fragment", "zone_rate", "site_rate")

Rule = tuple[str, str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: from there up to '?',
    '#' or the end. Null, or no '://': both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (host and path) that fits, else null: struct(rule, verdict). A rule fits its host and all subdomains,
    if the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    size = F.length(url)
    count = lambda x, c: (F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))).cast("double")
    share = lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(url, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.ln(share(c)))
    return {
        "length": size.cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"), "depth": count(path, "/"),
        "digits": F.when(size > 0, (size - F.length(F.translate(url, "0123456789", ""))) / size).otherwise(0.0), "entropy": F.round(entropy, 6),
        "parameters": count(url, "="), "hyphens": count(host, "-"), "labels": count(host, "."),
        "secure": url.startswith("https://").cast("double"), "fragment": F.contains(url, F.lit("#")).cast("double"),
    }


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")


def _suffix_counts(counted: DataFrame, labels: int) -> DataFrame:
    """By the host's last labels, over all labelled URLs (u, host, y, n): rows and blocked rows, also of each fold."""
    at = _fold(F.col("u"))
    by_fold = [F.sum(F.when(at == k, c).otherwise(0)) for k in range(FOLDS) for c in (F.col("n"), F.col("y") * F.col("n"))]
    return counted.groupBy(_suffix(F.col("host"), labels).alias(f"s{labels}")).agg(F.sum("n").alias(f"n{labels}"), F.sum(F.col("y") * F.col("n")).alias(f"y{labels}"), F.array(*by_fold).alias(f"f{labels}"))


def _rate(labels: int, prior: float, fold: Column | None) -> Column:
    """Smoothed share of blocked URLs of a suffix, without those of fold if one is given; the prior for an unknown suffix."""
    n, y = F.coalesce(f"n{labels}", F.lit(0)), F.coalesce(f"y{labels}", F.lit(0))
    if fold is not None:
        n, y = (x - F.coalesce(F.element_at(f"f{labels}", 2 * fold + k), F.lit(0)) for k, x in ((1, n), (2, y)))
    return (y + SMOOTH * prior) / (n + SMOOTH)


def _score(trees: list, names: dict[str, Column]) -> Column:
    def walk(node):
        if not isinstance(node, tuple):
            return F.lit(float(node))
        return F.when(names[node[0]] > node[1], walk(node[3])).otherwise(walk(node[2]))

    return sum((walk(t) for t in trees), F.lit(0.0))


def fit_trees(binned: DataFrame, cuts: list[list[float]]) -> list:
    """Boosted trees of logistic loss on (bins array<int>, y, n); a tree is a leaf value or (feature, cut, low, high).

    Sums are of whole numbers, so a repeated fit gives the same trees. Without both labels there are no trees.
    """
    unit = float(1 << 20)
    trees: list = []
    columns = {f: F.element_at("bins", k + 1) for k, f in enumerate(FEATURES)}
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-_score([_bins_of(t, cuts) for t in trees], columns)))
        rows = binned.withColumn("g", F.round((F.col("y") - p) * unit).cast("long") * F.col("n")).withColumn("h", F.round(p * (1 - p) * unit).cast("long") * F.col("n"))
        tree: dict[int, tuple] = {}
        sums: dict[int, tuple] = {}
        for level in range(DEPTH):
            node = F.lit(1)
            for _ in range(level):
                chosen = [F.when(node == k, 2 * node + (columns[FEATURES[f]] > b).cast("int")) for k, (f, b) in tree.items()]
                node = F.coalesce(*chosen, F.lit(0)) if chosen else F.lit(0)
            hist: dict[int, dict] = {}
            found = rows.select(node.alias("node"), "g", "h", "n", F.posexplode("bins").alias("f", "b")).where("node > 0").groupBy("node", "f", "b").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect()
            for k, f, b, g, h, n in sorted(map(tuple, found)):
                hist.setdefault(k, {}).setdefault(f, []).append((b, g / unit, h / unit, n))
            for k, by in hist.items():
                g0, h0, n0 = (sum(x[i] for x in by[0]) for i in (1, 2, 3))
                sums[k] = (g0, h0)
                best = None
                for f, bins in by.items():
                    g = h = n = 0
                    for b, dg, dh, dn in bins[:-1]:
                        g, h, n = g + dg, h + dh, n + dn
                        if min(n, n0 - n) >= LEAST_ROWS:
                            gain = g * g / (h + 1) + (g0 - g) ** 2 / (h0 - h + 1) - g0 * g0 / (h0 + 1)
                            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, f, b, (g, h), (g0 - g, h0 - h))
                if best:
                    tree[k] = best[1:3]
                    sums[2 * k], sums[2 * k + 1] = best[3:]
        if 1 not in tree:
            break

        def grow(k):
            if k in tree:
                f, b = tree[k]
                return (FEATURES[f], cuts[f][b], grow(2 * k), grow(2 * k + 1))
            return RATE * sums[k][0] / (sums[k][1] + 1)

        trees.append(grow(1))
    return trees


def _bins_of(tree, cuts):
    """The same tree on bin numbers."""
    if not isinstance(tree, tuple):
        return tree
    k = FEATURES.index(tree[0])
    return (tree[0], cuts[k].index(tree[1]), _bins_of(tree[2], cuts), _bins_of(tree[3], cuts))


def filter_urls(pages: DataFrame, rules: list[Rule], *, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (host and path of the longest that fits, else null), verdict
    ('allow' or 'block': the rule's, else the trees'), block_score (probability by the trees).

    labelled: (url, y) with y 1 for block; by default the URLs that a rule judges. Trees see SAMPLE distinct ones at most,
    weighted by their rows; rates of zones and sites are of all, and for the trees' own rows of all but the FOLDS-th part that the
    URL is in, so that a URL's label isn't among its features. Null URLs count as empty ones. Without labels of both kinds the score is the smoothed share of blocked URLs, 0.5 without any.
    Equal URLs get equal verdicts; no rows give no rows; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = url_parts(F.col("u"))

    def parts(df: DataFrame) -> DataFrame:
        return df.withColumn("host", host).withColumn("path", path).withColumn("judged", rule_for(F.col("host"), F.col("path"), rules))

    rows = parts(pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("u")))
    if labelled is None:
        known = rows.where("judged is not null").select("u", "host", "path", (F.col("judged.verdict") == "block").cast("long").alias("y"))
    else:
        known = parts(labelled.where("url is not null and y is not null").select(F.col("url").alias("u"), F.col("y").cast("long").alias("y"))).select("u", "host", "path", "y")
    counted = scratch.write(known.groupBy("u", "host", "path", "y").agg(F.count("*").alias("n")), "counted")
    sample = scratch.write(counted.orderBy(F.xxhash64("u"), "u", "y").limit(SAMPLE), "sample")
    known_suffixes = [scratch.write(_suffix_counts(counted, k), f"suffix{k}") for k in (1, 2)]
    prior = counted.agg(((F.sum(F.col("y") * F.col("n")) + 0.5) / (F.sum("n") + 1)).alias("p")).first()[0]
    prior = 0.5 if prior is None else float(prior)

    def featured(df: DataFrame, fold: Column | None = None) -> DataFrame:
        for k, r in zip((1, 2), known_suffixes, strict=True):  # as many rows as there are suffixes: no hint to broadcast
            df = df.withColumn(f"s{k}", _suffix(F.col("host"), k)).join(r, f"s{k}", "left")
        lexical = _lexical(F.col("u"), F.col("host"), F.col("path"))
        return df.withColumns(lexical | {"zone_rate": _rate(1, prior, fold), "site_rate": _rate(2, prior, fold)})

    inputs = scratch.write(featured(sample, _fold(F.col("u"))).select("y", "n", *FEATURES), "inputs")
    points = [k / BINS for k in range(1, BINS)]
    cuts = [sorted(set(x or [])) for x in inputs.agg(*[F.percentile_approx(f, points, 10_000) for f in FEATURES]).first()]
    bins = F.array(*[sum(((F.col(f) > x).cast("int") for x in c), F.lit(0)) for f, c in zip(FEATURES, cuts, strict=True)])
    binned = scratch.write(inputs.select(bins.alias("bins"), "y", "n").groupBy("bins", "y").agg(F.sum("n").alias("n")), "binned")
    both = binned.select("y").distinct().count() > 1
    trees = fit_trees(binned, cuts) if both else [math.log(prior / (1 - prior))]
    score = 1 / (1 + F.exp(-_score(trees, {f: F.col(f) for f in FEATURES})))
    judged = featured(rows).withColumn("block_score", score)
    verdict = F.coalesce("judged.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("judged.rule").alias("rule"), verdict.alias("verdict"), "block_score")


#: Verdict, host and path of each rule.
RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
