"""URL filter: a tree of path templates per host, judged by labelled purity.

Paths are taken level by level from the root. Of the segments that follow a template, those with
`min_support` urls can stay literal: they do if they hold `min_share` of its urls, or if their
labels differ from those of the pooled rest by a two-proportion z test. All others, such as ids and
slugs, become the wildcard `*`. So a section of its own labels keeps its own template however small
its share and however deep it lies. Literal siblings are statistically similar, and merged into `+0`,
`+1` and so on, if their bad shares, drawn towards their parent's by `prior` labels, lie in the same
of the fixed `BANDS`; no chain of neighbours can reach from one band into another. A template that
fewer than `min_support` urls go on from ends in `**`. The leaves are the templates. The purity of a
template is its good share, smoothed towards its host's, which is smoothed towards the share of all
labelled urls; templates below `min_purity` are blocked. Rules by host and path prefix come first.

Every level works on distinct (host, path) with counts, so repeated urls and hot hosts are added up
before they are shuffled; rows of a template or branch that holds very many paths are spread over
tasks. The tree is as deep as `min_support` urls of one template go. Per level, two totals and the
at most 1,000 keys to be spread reach the driver.

Null urls and those without `://` have empty host and path and are judged like any other. Without
labels every purity is 1 and all templates pass. Null ids and repeated rows are kept, ties need no
order, very long urls are only keys, and an empty table gives no rows. Columns of the input other than
the id come back only by a join; an id named like a column of the result is returned as `id`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacitrec.llm.common import lower_ascii
from tacitrec.operators.heavy import join_salted
from tacitrec.tables import drop_table, write_table

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Where the bands of bad shares begin, about evenly spaced in the arcsine of the root.
BANDS = (0.04, 0.15, 0.31, 0.49, 0.69, 0.85, 0.96)
RESULT = ("host", "path", "template", "purity", "verdict", "rule")
# A key with so many rows, and with over 1/1,000 of all, is spread over tasks.
LEAST_HEAVY, HEAVY_KEYS = 4096, 1000


@dataclass(frozen=True)
class TemplateParams:
    min_share: float = 0.02
    min_support: int = 20
    max_z: float = 2.0
    prior: float = 10.0
    min_purity: float = 0.5


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """`(rule, verdict)` of the longest rule that fits, or null. Rules: (`host/path`, verdict)."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        of_host = (host == domain) | host.endswith("." + domain)
        fits.append(
            F.when(of_host & path.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
        )
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _key(*parts: str) -> Column:
    """One string for several, each with its length before it."""
    return F.concat(*[F.concat(F.length(part).cast("string"), F.lit(":"), F.col(part)) for part in parts])


def _heavy(table: DataFrame, key: str, rows: str, total: int) -> list[str]:
    """Keys of more than a thousandth of the rows: at most a thousand."""
    floor = max(LEAST_HEAVY, total // HEAVY_KEYS)
    return [row[0] for row in table.filter(F.col(rows) >= floor).select(key).collect()]


def _tokens(children: DataFrame, totals: DataFrame, p: TemplateParams) -> DataFrame:
    """`(branch, token)` of the segments that are no wildcards, from `(node, segment, n, labelled, bad)`."""
    seen = totals.select("node", "everything", F.col("labelled").alias("all_labelled"), F.col("bad").alias("all_bad"))
    # At most a child per min_support urls, and 1 / min_share large ones a parent.
    supported = children.filter(F.col("n") >= p.min_support).join(seen, "node")
    large = F.col("n") >= F.col("everything") * p.min_share
    of_large = supported.filter(large).groupBy("node").agg(
        F.sum("labelled").alias("large_labelled"), F.sum("bad").alias("large_bad")
    )
    pooled = supported.join(of_large, "node", "left").withColumns({
        "rest": F.col("all_labelled") - F.coalesce("large_labelled", F.lit(0)) - F.col("labelled"),
        "rest_bad": F.col("all_bad") - F.coalesce("large_bad", F.lit(0)) - F.col("bad"),
    })
    mean = (F.col("bad") + F.col("rest_bad")) / (F.col("labelled") + F.col("rest"))
    gap = F.abs(F.col("bad") / F.col("labelled") - F.col("rest_bad") / F.col("rest"))
    spread = F.sqrt(mean * (1 - mean) * (1 / F.col("labelled") + 1 / F.col("rest")))
    differs = F.when((F.col("labelled") > 0) & (F.col("rest") > 0), gap > p.max_z * spread).otherwise(False)
    usual = F.when(F.col("all_labelled") > 0, F.col("all_bad") / F.col("all_labelled")).otherwise(0.0)
    share = (F.col("bad") + p.prior * usual) / (F.col("labelled") + p.prior)
    band = sum((F.when(share >= begin, 1).otherwise(0) for begin in BANDS), F.lit(0))
    literal = pooled.filter(large | differs).select("node", "segment", band.alias("band"))
    width = literal.groupBy("node", "band").agg(F.count("*").alias("width"))
    token = F.when(F.col("width") > 1, F.concat(F.lit("+"), F.col("band").cast("string"))).otherwise(F.col("segment"))
    return literal.join(width, ["node", "band"]).select(_key("node", "segment").alias("branch"), token.alias("token"))


def template_verdicts(
    urls: DataFrame, labels: DataFrame, id: str = "page_id", url: str = "url", params: TemplateParams | None = None
) -> DataFrame:
    """`(id, host, path, template, purity, verdict)` for every row of `urls`.

    `labels` has `(url, good)`; urls may repeat, each row counts.
    """
    p = params or TemplateParams()
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    known = labels.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "good").groupBy(
        "host", "path"
    ).agg(F.count("good").alias("labelled"), F.sum(F.when(F.col("good"), 0).when(~F.col("good"), 1).otherwise(0)).alias("bad"))
    rows = urls.select(F.col(f"`{id}`").alias("__id"), host.alias("host"), path.alias("path"))
    distinct = rows.groupBy("host", "path").agg(F.count("*").alias("n"))
    pieces = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    columns = ["host", "path", "segments", "template", "open", "n", "labelled", "bad"]
    tree = write_table(
        distinct.join(known, ["host", "path"], "left").select(
            "host", "path", pieces.alias("segments"), F.lit("").alias("template"), F.lit(True).alias("open"), "n",
            F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"),
        ),
        "url-tree",
    )
    whole = tree.agg(F.count("*").alias("paths"), F.sum("n").alias("rows"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    hot_paths = _heavy(tree.select(_key("host", "path").alias("place"), "n"), "place", "n", whole["rows"] or 0)
    level = 0
    while True:
        here = F.get("segments", F.lit(level))
        alive = F.col("open") & (F.size("segments") > level)
        placed = tree.withColumn("node", _key("host", "template")).withColumn("segment", F.when(alive, here))
        children = write_table(
            placed.filter(alive).groupBy("node", "segment").agg(
                F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("paths")
            ),
            "url-children",
        )
        totals = write_table(
            children.groupBy("node").agg(
                F.sum("n").alias("everything"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.sum("paths").alias("paths")
            ),
            "url-nodes",
        )
        goes_on = (totals.agg(F.max("everything")).first()[0] or 0) >= p.min_support
        hot_nodes = _heavy(totals, "node", "paths", whole["paths"])
        hot_branches = _heavy(children.select(_key("node", "segment").alias("branch"), "paths"), "branch", "paths", whole["paths"])
        spread = F.xxhash64("path")
        with_totals = join_salted(placed, totals.select("node", "everything"), "node", hot_nodes, spread, "left")
        joined = join_salted(
            with_totals.withColumn("branch", _key("node", "segment")), _tokens(children, totals, p), "branch", hot_branches,
            spread, "left",
        )
        ends = alive & (F.col("everything") < p.min_support)
        grown = (
            F.when(~alive, F.col("template")).when(ends, F.concat("template", F.lit("/**")))
            .otherwise(F.concat("template", F.lit("/"), F.coalesce("token", F.lit("*"))))
        )
        next_tree = write_table(
            joined.withColumns({"template": grown, "open": F.col("open") & ~ends}).select(*columns), "url-tree"
        )
        for table in (tree, children, totals):
            drop_table(table)
        tree, level = next_tree, level + 1
        if not goes_on:
            break
    labelled, bad = whole["labelled"] or 0, whole["bad"] or 0
    overall = (labelled - bad) / labelled if labelled else 1.0

    def smoothed(towards: Column) -> Column:
        return (F.col("labelled") - F.col("bad") + p.prior * towards) / (F.col("labelled") + p.prior)

    leaves = tree.groupBy("host", "template").agg(
        F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("paths")
    ).withColumn("node", _key("host", "template"))
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    hosts = hosts.select("host", smoothed(F.lit(overall)).alias("host_purity"))
    judged = leaves.join(hosts, "host").select("node", smoothed(F.col("host_purity")).alias("purity"))
    verdict = F.when(F.col("purity") < p.min_purity, "block").otherwise("allow")
    hot_leaves = _heavy(leaves, "node", "paths", whole["paths"])
    by_path = join_salted(
        tree.select("host", "path", "template").withColumn("node", _key("host", "template")), judged, "node", hot_leaves, F.xxhash64("path")
    ).select(_key("host", "path").alias("place"), "template", "purity")
    kept = join_salted(
        rows.withColumn("place", _key("host", "path")), by_path, "place", hot_paths, F.monotonically_increasing_id()
    )
    name = "id" if id.lower() in RESULT else id
    return kept.select(F.col("__id").alias(name), "host", "path", "template", "purity", verdict.alias("verdict"))


def filter_urls(
    urls: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], id: str = "page_id", url: str = "url",
    params: TemplateParams | None = None,
) -> DataFrame:
    """`template_verdicts` with `rule`, the longest rule that fits, whose verdict then counts."""
    judged = template_verdicts(urls, labels, id, url, params)
    rule = rule_for(F.col("host"), F.col("path"), rules)
    return judged.withColumn("__rule", rule).select(
        judged.columns[0], "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", "verdict").alias("verdict"), "template", "purity",
    )
