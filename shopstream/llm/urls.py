"""URL filter with path-template trees, in DataFrame functions only.

Of each host, paths become templates, one level of the tree after the other: segments of a variable
form (numbers, dates, hashes) and rare values under their parent turn into wildcards, and branches
whose labelled urls are blocked about as often as those of their siblings are merged; branches without
labels go with these. A template is rejected if the share of blocked urls among its labelled ones,
smoothed by its parent's, is high enough. Labels are the verdicts of hand-written rules, which always
go first; so urls without a rule are judged by what the rules say about the like of them on their host.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Levels of every tree; a branch whose labels differ goes on as deep as its paths do.
DEPTH = 3
#: A value may stay a branch if it has this share of its parent's urls, or so many labelled ones.
MIN_SHARE, MIN_LABELLED = 0.02, 5
#: Branches are merged if a two-proportion test doesn't tell their labels from the siblings' at this z.
SIMILAR_Z = 1.96
#: Labelled urls that the prior counts for, and the purity from which on a template is rejected.
PRIOR_WEIGHT, PURITY = 5.0, 0.9
#: Rules are written by hand and become one expression.
MOST_RULES = 1_000

_VARIABLE = r"(?i)^(?:[0-9][0-9._-]*|[0-9a-f]{8,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|.{40,})(?:\.[a-z]{1,5})?$"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of rules like ``("block", "example.com/en/")`` that fits host or a domain above, and path; else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _segments(path: Column) -> list[Column]:
    """The first segments, empty where the path ends, and an array of the others."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.when(s.rlike(_VARIABLE), F.lit("*")).otherwise(s))
    rest = F.filter(parts, lambda _, i: i >= DEPTH)
    return [*(F.coalesce(F.get(parts, F.lit(k)), F.lit("")) for k in range(DEPTH)), rest]


def _split(branches: DataFrame, z: float, tables: Scratch, name: str) -> DataFrame:
    """Adds ``side`` to rows (node, value, n, labelled, hits): branches of a node with one side are alike.

    Branches begin on one side. Those whose labelled urls are blocked more, or less, often than those of
    all others of their side leave it for a side of their own, until none differs any more. A branch
    without labels can't be told from the others, so it stays where it is.
    """
    own, k = branches.withColumn("side", F.lit("")), 0
    while True:
        sides = own.groupBy("node", "side").agg(F.sum("labelled").alias("all_labelled"), F.sum("hits").alias("all_hits"))
        others = F.col("all_labelled") - F.col("labelled")
        share = F.try_divide(F.col("all_hits"), F.col("all_labelled"))
        error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), others)))
        apart = F.try_divide(F.col("hits"), F.col("labelled")) - F.try_divide(F.col("all_hits") - F.col("hits"), others)
        differs = (apart != 0) & (F.abs(apart) >= z * error)
        step = F.when(differs & (apart > 0), "+").when(differs, "-").otherwise("")
        own = own.join(sides, ["node", "side"]).select("node", "value", "n", "labelled", "hits", F.concat("side", step).alias("side"), (step != "").alias("moved"))
        own = tables.put(own, f"{name}-{k}")
        if own.where("moved").isEmpty():
            return own.drop("moved")
        own, k = own.drop("moved"), k + 1


def templates(urls: DataFrame, tables: Scratch, *, min_share: float = MIN_SHARE, min_labelled: int = MIN_LABELLED, similar_z: float = SIMILAR_Z, prior_weight: float = PRIOR_WEIGHT, purity: float = PURITY) -> DataFrame:
    """leaf (host and segments as ``_segments`` gives them), template, purity and rejected.

    ``urls`` has host, s0, s1, ..., blocked (true, false or null) and, if paths may be longer, rest.
    Everything after the first grouping works on distinct leaves, whatever the number of their urls.
    A node's purity is the share of blocked urls among its labelled ones, where its parent's purity (of
    a host: the share over all hosts) counts as ``prior_weight`` labelled urls; a node that has all the
    labels of its parent has its purity.
    """
    rest = ["rest"] if "rest" in urls.columns else []
    totals = ("n", "labelled", "hits")
    sums = [F.sum(c).cast("long").alias(c) for c in totals]
    smooth = (F.sum("hits") + prior_weight * F.max("above")) / (F.sum("labelled") + prior_weight)
    leaves = urls.groupBy("host", F.concat_ws("/", "host", *[f"s{k}" for k in range(DEPTH)], *rest).alias("leaf"))
    leaves = leaves.agg(F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"), F.sum(F.coalesce(F.col("blocked").cast("long"), F.lit(0))).alias("hits"))
    leaves = tables.put(leaves.withColumnRenamed("host", "node"), "leaves")
    overall = leaves.agg(((F.sum("hits") + 1) / (F.sum("labelled") + 2)).alias("share")).first()["share"]
    hosts = leaves.withColumn("above", F.lit(0.5 if overall is None else overall)).groupBy("node").agg(smooth.alias("purity"))
    leaves = tables.put(leaves.join(hosts, "node"), "hosts")
    k = 0
    while True:
        parts = F.split("leaf", "/")
        own = leaves.withColumn("value", F.coalesce(F.get(parts, F.lit(k + 1)), F.lit("")))
        branches = tables.put(own.groupBy("node", "value").agg(*sums), f"branches-{k}")
        parents = branches.groupBy("node").agg(*[F.sum(c).alias(f"all_{c}") for c in totals])
        if k >= DEPTH:  # only where labels differ and paths go on
            parents = parents.where("all_hits > 0 and all_hits < all_labelled")
            parents = parents.join(own.where(F.size(parts) > k + 1).select("node").distinct(), "node", "left_semi")
            parents = tables.put(parents, f"parents-{k}")
            if parents.isEmpty():
                break
        rare = (F.col("n") < min_share * F.col("all_n")) & (F.col("labelled") < min_labelled)
        named = branches.join(parents, "node").withColumn("general", F.when(rare, "*").otherwise(F.col("value")))
        named = tables.put(named.select("node", "value", "general", "all_labelled", *totals), f"named-{k}")
        alike = _split(named.groupBy("node", F.col("general").alias("value")).agg(*sums), similar_z, tables, f"sides-{k}")
        # values of one side become a wildcard with the side's sign; one alone keeps its name
        only = (F.count(F.lit(1)) == 1) & (F.max("value") != "*")
        merged = alike.groupBy("node", "side").agg(F.when(only, F.max("value")).otherwise(F.concat(F.lit("*"), "side")).alias("name"))
        of = named.join(alike.select("node", F.col("value").alias("general"), "side"), ["node", "general"]).join(merged, ["node", "side"])
        of = tables.put(of.select("node", "value", "name", "all_labelled"), f"of-{k}")
        leaves = own.join(of, ["node", "value"], "left").withColumn("above", F.col("purity"))
        node = F.when(F.col("name").isNull(), F.col("node")).otherwise(F.concat_ws("/", "node", "name"))
        leaves = leaves.select(node.alias("node"), "leaf", *totals, "above", "all_labelled")
        # the parent's labels again are no news
        same = F.coalesce(F.sum("labelled") == F.max("all_labelled"), F.lit(True))
        judged = leaves.groupBy("node").agg(F.when(same, F.max("above")).otherwise(smooth).alias("purity"))
        leaves = tables.put(leaves.join(judged, "node").select("node", "leaf", *totals, "purity"), f"leaves-{k}")
        k += 1
    found = leaves.select("leaf", F.col("node").alias("template"), "purity", (F.col("purity") >= purity).alias("rejected"))
    return tables.keep(tables.put(found, "templates"), "templates")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """Judges every url: page_id, host, path, rule, verdict (allow or block) and template.

    ``rules`` are (verdict, rule) pairs, a rule being a domain and the begin of a path; it fits the
    domain and all below, and the longest decides. Other urls are blocked if their template is
    rejected. Null urls and urls without ``://`` have an empty host and path and no template; they are
    allowed unless a rule says otherwise. Ids may be null or repeat; each row gets its row. Empty
    tables give no rows; other columns are not looked at. Of two rules of one length the one that is
    later in the alphabet decides. ``options`` as in ``templates``.
    """
    tables = Scratch(pages.sparkSession, "urls")
    url = F.col(url_col)
    pages = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    pages = pages.withColumn("rule", match_rule(F.col("host"), F.col("path"), rules))
    blocks = [r for v, r in rules if v == "block"]
    by_rule = reduce(lambda x, r: x | (F.col("rule") == r), blocks, F.lit(False))
    blocked = F.when(F.col("rule").isNotNull(), by_rule)
    *first, rest = _segments(F.col("path"))
    names = [*(s.alias(f"s{k}") for k, s in enumerate(first)), rest.alias("rest")]
    found = templates(pages.where("host != ''").select("host", blocked.alias("blocked"), *names), tables, **options)
    leaf = F.when(F.col("host") != "", F.concat_ws("/", "host", *first, rest))
    rows = pages.withColumn("leaf", leaf).join(found.drop("purity"), "leaf", "left")
    bad = F.coalesce(blocked, F.col("rejected"), F.lit(False))
    return rows.select("page_id", "host", "path", "rule", F.when(bad, "block").otherwise("allow").alias("verdict"), "template")
