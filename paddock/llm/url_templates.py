"""URL filter by path-template trees.

Given rules decide first.  For the rest, the paths of each host form a tree of segments:

1. Variable segments become wildcards: digit runs are masked at once; then, level by level, a
   segment under one parent template is a wildcard if the parent has more than ``BRANCHES``
   different segments and the segment holds less than ``RARE`` of the parent's urls.
2. From the leaves upwards, level by level, branches are merged with their siblings under one
   parent template while the share of bad labels is statistically alike (a z-test of the branch
   against the parent's pool).
3. A template is rejected if its labelled purity is below ``PURITY``.  Purity is smoothed towards
   the purity of the host, and that towards the purity of all urls.

Urls are summed by (host, masked path) first; all tree work runs on those sums, however many
urls a host has, and urls meet their template in one join.  No sum needs all rows of a host in
one task.

Defined results: host and path of a null url, or one without ``://``, are empty, no rule fits and
the url is allowed or blocked like any other template of the empty host.  Urls without labels
count for the tree but not for purity; without any label purity is 1 and all is allowed.  A
label of an unknown page is ignored; of several labels of a page the worst counts.  Repeated
rows give repeated rows.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.scratch import Scratch, materialise

BRANCHES, RARE = 20, 0.05
ALIKE, PURITY, STRENGTH = 1.96, 0.5, 10.0

#: (verdict, host, path) of the given rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruling(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked last and wins
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def mask(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def _generalise(urls: DataFrame, tmp: Scratch) -> DataFrame:
    """Adds ``template`` to sums by (host, masked path).

    Each level is written, so that plans stay small.  A parent of at most ``BRANCHES`` different
    paths has no wildcard below, so they are done as they are: only crowded parents go deeper.
    """
    open_ = urls.withColumns({"segments": F.split("masked", "/"), "template": F.lit("")})
    done, level = [open_.where(F.size("segments") < 2).drop("segments")], 1
    open_ = open_.where(F.size("segments") > 1)
    while not open_.isEmpty():
        here = open_.withColumn("segment", F.get("segments", F.lit(level)))
        held = here.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.count("*").alias("paths"))
        parent = held.groupBy("host", "template").agg(F.sum("n").alias("all"), F.count("*").alias("branches"), F.sum("paths").alias("paths"))
        few = parent["paths"] <= BRANCHES
        wild = (F.col("branches") > BRANCHES) & (F.col("n") < RARE * F.col("all"))
        known = held.drop("paths").join(parent, ["host", "template"]).select("host", "template", "segment", wild.alias("wild"), few.alias("few"))
        rest = F.array_join(F.slice("segments", F.lit(level + 1), F.size("segments")), "/")
        step = F.when(F.col("few"), rest).when(F.col("wild"), F.lit("*")).otherwise(F.col("segment"))
        last = F.col("few") | (F.size("segments") == level + 1)
        here = tmp.write(
            here.join(known.where("wild OR few"), ["host", "template", "segment"], "left").withColumns(
                {"wild": F.coalesce("wild", F.lit(False)), "few": F.coalesce("few", F.lit(False))}
            ).withColumns({"template": F.concat("template", F.lit("/"), step), "done": last}).drop("wild", "few", "segment")
        )
        done.append(here.where("done").drop("segments", "done"))
        open_ = here.where("NOT done").drop("done")
        level += 1
    return tmp.write(reduce(DataFrame.unionByName, done))


def _pooled(urls: DataFrame) -> DataFrame:
    """(host, template, labelled, bad): the counts of the largest pool each template merges into.

    From the leaf upwards, a branch joins its parent's pool while the branch has no label or its
    share of bad ones is like the pool's; it takes the counts of the first that does not join.
    """
    sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    leaf = urls.groupBy("host", "template").agg(*sums)
    cut = F.split("template", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.array_join(F.slice(cut, F.lit(1), k), "/"))
    # What ends at a template is a branch beside the deeper ones.
    chain = leaf.select("host", "template", "labelled", "bad", F.posexplode(F.concat(up, F.array("template"))).alias("depth", "node"))
    leafs = chain["depth"] == F.size(cut)
    chain = chain.withColumns({"ends": leafs, "above": F.when(leafs, F.col("template")).otherwise(F.regexp_replace("node", "/[^/]*$", ""))})
    nodes = chain.groupBy("host", "node", "ends", "depth", "above").agg(*sums)
    pool = nodes.where("NOT ends").select("host", F.col("node").alias("above"), *[F.col(c).alias(f"pool_{c}") for c in ("labelled", "bad")])
    share = F.col("pool_bad") / F.greatest("pool_labelled", F.lit(1))
    spread = F.sqrt(share * (1 - share) / F.greatest("labelled", F.lit(1)))
    alike = F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - share) <= ALIKE * spread
    merged = (F.col("depth") > 0) & ((F.col("labelled") == 0) | alike)
    apart = nodes.join(pool, ["host", "above"]).where(~merged).select("host", "node", "ends", "labelled", "bad")
    found = chain.select("host", "template", "node", "ends", "depth").join(apart, ["host", "node", "ends"])
    return found.groupBy("host", "template").agg(F.max_by(F.struct("labelled", "bad"), "depth").alias("r")).select("host", "template", "r.*")


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url: str = "url", key: str = "page_id"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every url.

    ``labels`` has (page_id, bad): 1 if the page is known to be bad, 0 if known to be good.
    """
    host, path = parts(pages[url].cast("string"))
    rows = pages.select(pages[key].cast("bigint").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("masked", mask(F.col("path")))
    known = labels.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("bad").cast("int").alias("bad"))
    known = known.where("page_id IS NOT NULL AND bad IN (0, 1)").groupBy("page_id").agg(F.max("bad").alias("bad"))
    with Scratch(pages.sparkSession, "urls") as tmp:
        urls = tmp.write(
            rows.join(known, "page_id", "left").groupBy("host", "masked").agg(
                F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
            )
        )
        urls = _generalise(urls, tmp)
        sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
        leaf = _pooled(urls)
        every = urls.agg(*sums).first()
        overall = 1 - (every["bad"] or 0) / max(every["labelled"] or 0, 1)
        hosts = urls.groupBy("host").agg(*sums)
        hosts = hosts.select("host", ((F.col("labelled") - F.col("bad") + STRENGTH * overall) / (F.col("labelled") + STRENGTH)).alias("host_purity"))
        purity = (F.col("labelled") - F.col("bad") + STRENGTH * F.col("host_purity")) / (F.col("labelled") + STRENGTH)
        purest = leaf.join(hosts, "host").select("host", "template", F.round(purity, 9).alias("purity"))
        templates = urls.select("host", "masked", "template").join(purest, ["host", "template"])
        templates = materialise(templates, "url-templates")
    name, verdict = ruling(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(templates, ["host", "masked"]).select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity"
    )
