"""URL filter: host rules first, gradient-boosted trees on lexical features for the rest.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm._common import cut

SUFFIXES = ("top", "domain", "ending")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: str | Column = "url") -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and path up to ``?`` or ``#``; both empty for a null url or one without ``://``."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest (rule, verdict) that fits: the host or a subdomain of it, and a path that starts with the rule's; else nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, start = rule.partition("/")[0], "/" + rule.partition("/")[2] if "/" in rule else ""
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def suffixes(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Top-level label, last two labels, and the file name's ending."""
    return {
        "top": F.substring_index(host, ".", -1),
        "domain": F.substring_index(host, ".", -2),
        "ending": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
    }


def runs(chars: Column) -> Column:
    """The sum of c log2 c over the lengths c of runs of equal characters, read once."""
    state = lambda last, c, total: F.struct(last.alias("last"), c.alias("c"), total.alias("total"))
    closed = lambda s: s.total + F.when(s.c > 0, s.c * F.log2(s.c)).otherwise(0.0)
    step = lambda s, x: F.when(x == s.last, state(s.last, s.c + 1, s.total)).otherwise(state(x, F.lit(1), closed(s)))
    return F.aggregate(chars, state(F.lit(""), F.lit(0), F.lit(0.0)), step, closed)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.length(url)
    entropy = F.log2(n) - runs(F.array_sort(F.filter(F.split(url, ""), lambda c: c != ""))) / n
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "length": n,
        "host_length": F.length(host),
        "depth": F.length(path) - F.length(F.translate(path, "/", "")),
        "labels": F.length(host) - F.length(F.translate(host, ".", "")),
        "digits": (n - F.length(F.translate(url, "0123456789", ""))) / F.greatest(n, F.lit(1)),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(1 + F.length(query) - F.length(F.translate(query, "&", ""))),
        "hyphens": n - F.length(F.translate(url, "-_", "")),
        "secure": url.startswith("https").cast("int"),
    }


class UrlTrees:
    """Boosted trees.

    ``rates`` are the suffix statistics: a table (v, rate) for each kind of suffix, of at most as many
    rows as were learned from; ``trees`` are nested (feature, threshold, left, right) or leaf values.
    """

    def __init__(self, prior: float, rates: dict[str, DataFrame], trees: list):
        self.prior, self.rates, self.trees = prior, rates, trees

    def with_features(self, rows: DataFrame, url: str = "url", by: tuple[str, ...] = ()) -> DataFrame:
        """The rows with a column for each feature, named as in ``names``; ``by`` are further columns of the rates' tables."""
        u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
        host, path = host_path(u)
        found = lexical(u, host, path)
        out = rows.withColumns({n: c.cast("double") for n, c in found.items()} | {f"{k}_of": c for k, c in suffixes(u, host, path).items()})
        for kind in SUFFIXES:
            if kind in self.rates:
                known = self.rates[kind].select(*by, F.col("v").alias(f"{kind}_of"), F.col("rate").alias(f"{kind}_known"))
                out = out.join(F.broadcast(known), [*by, f"{kind}_of"], "left")  # a few rows for each of the sample, which is bounded
                out = out.withColumn(f"{kind}_rate", F.coalesce(f"{kind}_known", F.lit(self.prior))).drop(f"{kind}_known")
            else:
                out = out.withColumn(f"{kind}_rate", F.lit(self.prior))
            out = out.drop(f"{kind}_of")
        return out

    def margin(self) -> Column:
        """Log-odds of block, over the features' columns."""

        def read(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            feature, threshold, left, right = tree
            return F.when(F.col(feature) <= threshold, read(left)).otherwise(read(right))

        out = F.lit(_odds(self.prior))
        for t in self.trees:
            out = out + read(t)
        return out


def _odds(p: float) -> float:
    from math import log

    p = min(max(p, 1e-3), 1 - 1e-3)
    return log(p / (1 - p))


#: Parts of the sample; a row's own part doesn't count in the suffix statistics that it is learned with.
FOLDS = 5


def drawn(labelled: DataFrame, rows: int) -> DataFrame:
    """(url, y) of at most ``rows`` distinct labelled urls, half of them of each label if there are as many, those of the least hashes.

    Copies of a url count once, however many there are.  Estimates of how many distinct
    urls a label has set a bound on the hash, so that few more rows than wanted are
    made distinct and ordered.
    """
    every = labelled.select(F.coalesce("url", F.lit("")).alias("url"), F.col("blocked").cast("int").alias("y")).filter("y IS NOT NULL")
    about = {r.y: r.n for r in every.groupBy("y").agg(F.approx_count_distinct("url", 0.02).alias("n")).collect()}
    half = rows // 2
    wanted = {y: max(half, rows - sum(min(half, n) for k, n in about.items() if k != y)) for y in about}
    hash_ = F.xxhash64("url")
    near = F.lit(False)
    for y, n in about.items():
        near = near | ((F.col("y") == y) & (F.shiftrightunsigned(hash_, 11) < int(min(1.0, 2 * wanted[y] / max(n, 1)) * (1 << 53))))
    nth = F.row_number().over(Window.partitionBy("y").orderBy(hash_, "url"))  # of about twice the rows that are wanted
    most = F.lit(0)
    for y, n in wanted.items():
        most = F.when(F.col("y") == y, n).otherwise(most)
    chosen = every.filter(near).distinct().withColumn("nth", nth).filter(F.col("nth") <= most)
    return chosen.orderBy("nth", "y").limit(rows).select("url", "y")


def suffix_rates(sample: DataFrame, prior: float) -> tuple[DataFrame, DataFrame]:
    """Smoothed block rates: (kind, v, rate) of every suffix of the sample, and (fold, kind, v, rate) of what the other folds say of it.

    sample: url, y, fold.
    """
    host, path = host_path("url")
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("v")) for k, c in suffixes(F.col("url"), host, path).items()]))
    each = sample.select("y", "fold", value.alias("x")).groupBy("x.kind", "x.v", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    every = Window.partitionBy("kind", "v")
    each = each.withColumns({"all_s": F.sum("s").over(every), "all_n": F.sum("n").over(every)})
    rate = lambda s, n: ((s + 4 * prior) / (n + 4)).alias("rate")
    rest = each.select("fold", "kind", "v", rate(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")))
    return each.select("kind", "v", rate(F.col("all_s"), F.col("all_n"))).distinct(), rest


def fit(labelled: DataFrame, rows: int = 20_000, trees: int = 8, depth: int = 3, bins: int = 16, rate: float = 0.4) -> UrlTrees:
    """Learn from (url, blocked 0/1): at most ``rows`` distinct urls of them, see ``drawn``.

    Suffix statistics are smoothed block rates of every value in that sample; the trees
    are grown on what the other parts of the sample say, so they don't trust what they
    have learned by heart.  The sample's features are cut once as bin numbers; then each
    level of a tree is one aggregation of gradients by node, feature and bin, of which
    the driver gets at most nodes x features x bins rows, and each tree leaves its
    margins as a column.  The bounded sample is one partition, so no level shuffles.
    Without labelled rows of both kinds all have the one verdict.
    """
    sample = cut(drawn(labelled, rows).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS))).coalesce(1))
    total, ones = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (ones + 0.5) / (total + 1) if total else 0.0
    if not 0 < ones < total:
        return UrlTrees(prior, {}, [])
    seen, rest = (cut(t) for t in suffix_rates(sample.coalesce(1), prior))
    of = lambda t, *more: {k: t.filter(F.col("kind") == k).select(*more, "v", "rate") for k in SUFFIXES}
    model, learning = UrlTrees(prior, of(seen), []), UrlTrees(prior, of(rest, "fold"), [])
    table = cut(learning.with_features(sample.coalesce(1), by=("fold",)).drop("url", "fold"))
    names = [c for c in table.columns if c != "y"]
    cuts_at = table.agg(*[F.percentile_approx(n, [i / bins for i in range(1, bins)], 2000).alias(n) for n in names]).first()
    edges = {n: sorted(set(cuts_at[n])) for n in names}
    binned = [_bin(F.col(n), edges[n]).alias(f"b{i}") for i, n in enumerate(names)]
    now = cut(table.coalesce(1).select("y", F.lit(_odds(prior)).alias("m"), *binned))
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.col("m")))
        splits, values = _grow(now.coalesce(1).withColumns({"g": F.col("y") - p, "h": p * (1 - p)}), names, edges, depth, rate)
        model.trees.append(_tree(1, splits, values, names, edges))
        now = cut(now.coalesce(1).withColumn("m", F.col("m") + _walk(1, splits, lambda node: F.lit(_leaf(values, node)))))
    return model


def _bin(value: Column, edges: list[float]) -> Column:
    """How many of the edges the value is over."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: value > e)) if edges else F.lit(0)


def _leaf(values: dict[int, float], node: int) -> float:
    return round(values.get(node, 0.0), 9)


def _tree(node: int, splits: dict[int, tuple[int, int]], values: dict[int, float], names: list[str], edges: dict[str, list[float]]):
    if node not in splits:
        return _leaf(values, node)
    f, b = splits[node]
    left, right = (_tree(2 * node + k, splits, values, names, edges) for k in (0, 1))
    return names[f], float(edges[names[f]][b]), left, right


def _walk(node: int, splits: dict[int, tuple[int, int]], end) -> Column:
    """``end`` of the node that a row of bin numbers comes to."""
    if node not in splits:
        return end(node)
    f, b = splits[node]
    return F.when(F.col(f"b{f}") <= b, _walk(2 * node, splits, end)).otherwise(_walk(2 * node + 1, splits, end))


def _grow(
    rows: DataFrame, names: list[str], edges: dict[str, list[float]], depth: int, rate: float, ridge: float = 1.0,
    least: float = 5.0
):
    """One regression tree on gradients g and curvatures h, level by level: (feature, bin) of each split, and the nodes' values."""
    splits: dict[int, tuple[int, int]] = {}
    values: dict[int, float] = {}
    for level in range(depth):
        bins = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b{i}").alias("b")) for i in range(len(names))]))
        at = rows.select(_walk(1, splits, F.lit).alias("node"), "g", "h", bins.alias("x")).filter(F.col("node") >= 2**level)
        sums: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for r in at.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = r["g"], r["h"]
        grew = False
        for node, by in sums.items():
            g, h = (sum(by[0][b][i] for b in sorted(by[0])) for i in (0, 1))
            values[node] = rate * g / (h + ridge)
            best = (1e-6,)
            for f, hist in sorted(by.items()):
                gl = hl = 0.0
                for b in range(len(edges[names[f]])):
                    gl, hl = gl + hist.get(b, (0, 0))[0], hl + hist.get(b, (0, 0))[1]
                    gr, hr = g - gl, h - hl
                    if min(hl, hr) < least / 4:
                        continue
                    gain = round(gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - g * g / (h + ridge), 6)
                    if gain > best[0]:
                        best = gain, f, b, rate * gl / (hl + ridge), rate * gr / (hr + ridge)
            if len(best) > 1:
                splits[node] = best[1], best[2]
                values[2 * node], values[2 * node + 1] = best[3], best[4]
                grew = True
        if not grew:
            break
    return splits, values


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: UrlTrees | None = None, **fit_options) -> DataFrame:
    """Add host, path, rule, verdict and score (probability of block by the trees) to every row's page_id.

    The rules' verdicts hold where a rule fits, the trees' elsewhere.  Without a
    model, one is fitted on the rows that the rules label.  A null url has empty
    host and path and fits no rule; repeated rows give repeated results and count
    once in the fit; other columns are ignored; an empty table gives no rows and
    fits nothing.
    """
    host, path = host_path("url")
    rule, says = matching_rule(rules, F.col("host"), F.col("path"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "says": says})
    if model is None:
        model = fit(
            rows.filter(F.col("says").isNotNull()).select("url", (F.col("says") == "block").cast("int").alias("blocked")),
            **fit_options
        )
    scored = model.with_features(rows).withColumn("score", 1 / (1 + F.exp(-model.margin())))
    learned = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("says", learned).alias("verdict"), "score")
