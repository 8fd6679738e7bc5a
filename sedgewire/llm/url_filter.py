"""URL filters by rules and by a tree of path templates, in DataFrame operations only.

Host rules come first, the longest that fits wins. For the other urls each host has a tree of path templates:
segments that look variable (numbers, dates, hexadecimal, identifiers) become wildcards at once. Then, level by level,
the branches of a place are told apart by their labels. Two sets of labels are apart if the likelihood ratio of one
share of bad labels for both against a share for each is beyond what chance gives any of the place's labelled branches
(ALPHA over their number, by Chernoff's bound).

1. A branch that is apart from all others of its place together goes to its worse or its better ones; the rest, also
   branches without labels, to those between.
2. The three pools are counted anew. A branch that is apart from the others of its pool stands alone, and the worse and
   the better whose pools are not apart from those between go back to them; then the pools are final.
3. Branches of one pool are alike. They share its labels and are merged into one wildcard, so that what is below them is
   looked at together; but one whose own branches differ among themselves keeps its name.

A url is judged by the last pool or branch of its own that has labels. Its template is rejected if the smoothed purity,
(bad + PRIOR * share of all) / (labelled + PRIOR), is over BAD. Nothing depends on how many branches there are but the
chance that one of them strays.

Everything works on the distinct templates, counted by partial aggregates; a host with a third of all urls is a few
templates by then, or many that are dealt by (host, place, segment). Levels go on as deep as there is anything to part:
a template that has a place to itself is done, and so are places without labels. Defined results: a null
url or one without `://` has an empty host and path; urls of an unlabelled tree are allowed; rows that repeat a page_id
or a url are judged each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.common import if_small, stage

ALPHA = 0.05
PRIOR = 4.0
BAD = 0.5
#: (verdict, rule): a host and all its subdomains, and how the path starts.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Stand for the merged branches of a place, worse, between and better; no path has them.
_ANY = {1: "?+", 0: "?", -1: "?-"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of verdict and rule, or null. A handful of rules, given in code."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def template(path: Column) -> Column:
    """The path's segments, all of them, variable ones as wildcards."""
    segments = F.split(F.regexp_replace(path, r"^/|/$", ""), "/")
    wild = lambda s: (
        F.when(s.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), F.lit("{date}"))
        .when(s.rlike(r"^\d+$"), F.lit("{n}"))
        .when(s.rlike(r"^\d+\.[A-Za-z]{2,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(s, r"\.([A-Za-z]+)$", 1)))
        .when(s.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
        .when(s.rlike(r"^(?=.*\d)[\w%.~-]{12,}$"), F.lit("{id}"))
        .otherwise(s)
    )
    return F.transform(segments, wild)


def _x_log_x(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def _fit(bad: Column, n: Column) -> Column:
    """The logarithm of the likelihood that a share of its own gives to labels."""
    return _x_log_x(bad) + _x_log_x(n - bad) - _x_log_x(n)


def _apart(bad: Column, n: Column, of_bad: Column, of_n: Column, many: Column) -> Column:
    """Whether two sets of labels are apart, where `many` are tested; without labels nothing is."""
    gain = _fit(bad, n) + _fit(of_bad, of_n) - _fit(bad + of_bad, n + of_n)
    return F.when((n > 0) & (of_n > 0), F.round(gain, 9) > F.log(many / F.lit(ALPHA))).otherwise(F.lit(False))


def _branches(nodes: DataFrame, place: list[str]) -> DataFrame:
    """nodes (place, part, bad, n, held, uneven, pool_bad, pool_n) with the name of each branch, merged ones alike, its
    number of templates, whether it has labels, and the pool that its urls are judged by from now on."""
    c = F.col
    sides = {1: "worse", 0: "same", -1: "better"}
    of = lambda side, x: c(f"{sides[side]}_{x}")
    own = lambda x: F.when(c("side") == 1, of(1, x)).when(c("side") == -1, of(-1, x)).when(c("side") == 0, of(0, x))

    def pooled(df: DataFrame, side: Column) -> DataFrame:
        """df with its side anew and what the place's three pools hold: labels, and the branches that merge."""
        df = df.select(*place, "part", "bad", "n", "held", "uneven", "pool_bad", "pool_n", "many", side.alias("side"))
        even = lambda k: (c("side") == k) & ~c("uneven")
        sums = [F.sum(F.when(c("side") == k, c(x)).otherwise(0)).alias(f"{name}_{x}") for k, name in sides.items() for x in ("bad", "n")]
        sums += [F.sum(F.when(even(k), v).otherwise(0)).alias(f"{name}_{x}") for k, name in sides.items() for x, v in (("mates", F.lit(1)), ("held", c("held")), ("labels", c("n")))]
        return df.join(df.groupBy(*place).agg(*sums, F.max(c("side").isNull() | (c("side") != 0)).alias("split")), place)

    tally = nodes.groupBy(*place).agg(F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"), F.greatest(F.count_if(c("n") > 0), F.lit(1)).alias("many"))
    rest_bad, rest_n = c("all_bad") - c("bad"), c("all_n") - c("n")
    worse = c("bad") * rest_n > rest_bad * c("n")
    rows = pooled(nodes.join(tally, place), F.when(~_apart(c("bad"), c("n"), rest_bad, rest_n, c("many")), 0).when(worse, 1).otherwise(-1))
    rows = pooled(rows, F.when(~_apart(c("bad"), c("n"), own("bad") - c("bad"), own("n") - c("n"), c("many")), c("side")))
    back = lambda k: (of(0, "n") > 0) & ~_apart(of(k, "bad"), of(k, "n"), of(0, "bad"), of(0, "n"), c("many"))
    rows = pooled(rows, F.when((c("side") == 1) & back(1) | (c("side") == -1) & back(-1), 0).otherwise(c("side")))

    wild = c("side").isNotNull() & ~c("uneven") & (own("mates") > 1)
    mark = F.when(c("side") == 1, _ANY[1]).when(c("side") == -1, _ANY[-1]).otherwise(F.lit(_ANY[0]))
    judge = lambda x: F.when(c("side").isNull(), c(x)).when(c("split") & (own("n") > 0), own(x)).otherwise(c(f"pool_{x}"))
    #: A place's templates and labels are those of its branches of one name.
    return rows.select(
        *place, "part", F.when(wild, mark).otherwise(c("part")).alias("name"), F.when(wild, own("held")).otherwise(c("held")).alias("held"),
        (F.when(wild, own("labels")).otherwise(c("n")) > 0).alias("labels"), judge("bad").alias("pool_bad"), judge("n").alias("pool_n"),
    )


def template_tree(urls: DataFrame) -> DataFrame:
    """(host, raw, template, bad, labelled, purity): the distinct templates of urls (host, path, bad), where bad is 1, 0
    or null for a url without a label. raw is the template before branches were merged."""
    seen = urls.select("host", template(F.col("path")).alias("raw"), "bad").groupBy("host", "raw")
    tree = stage(seen.agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumn("template", F.col("raw")), "templates")
    whole = tree.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("share"))
    hosts = stage(tree.groupBy("host").agg(F.sum("bad").alias("pool_bad"), F.sum("labelled").alias("pool_n"), F.count("*").alias("held"), (F.sum("labelled") > 0).alias("labels")), "hosts")

    #: Level by level; pool is what a row's place is judged by so far, held its number of templates.
    left, done = tree.join(if_small(hosts), "host"), []
    place = ["host", "parent"]
    d = 0
    while True:
        more = (F.size("template") > d) & (F.col("held") > 1) & F.col("labels")
        done.append(left.where(~more))
        left = left.where(more)
        if left.isEmpty():
            break
        rows = left.withColumns({"parent": F.array_join(F.slice("template", 1, d), "/"), "part": F.get("template", F.lit(d)), "next": F.get("template", F.lit(d + 1))})
        kids = rows.groupBy(*place, "part", "next").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("n"), F.count("*").alias("held"), F.max("pool_bad").alias("pool_bad"), F.max("pool_n").alias("pool_n"))
        sums = [F.sum(x).alias(x) for x in ("bad", "n", "held")]
        nodes = kids.groupBy(*place, "part").agg(*sums, F.max("pool_bad").alias("pool_bad"), F.max("pool_n").alias("pool_n"), F.count_if(F.col("n") > 0).alias("kids"), F.sum(_fit(F.col("bad"), F.col("n"))).alias("fit"))
        gain, free = 2 * F.round(F.col("fit") - _fit(F.col("bad"), F.col("n")), 6), F.col("kids") - 1
        uneven = (F.col("kids") > 1) & (gain > free + 3 * F.sqrt(2 * free) + 6)
        both = stage(_branches(stage(nodes.withColumn("uneven", uneven).drop("kids", "fit"), "nodes"), place), "branches")
        put = F.transform("template", lambda s, k: F.when(k == d, F.col("name")).otherwise(s))  # noqa: B023
        left = stage(rows.drop("pool_bad", "pool_n", "held", "labels").join(if_small(both), [*place, "part"]).withColumn("template", put).select(*left.columns), "tree")
        d += 1
    for part in done:
        left = left.unionByName(part)
    shown = F.array_join(F.transform("template", lambda s: F.when(s.startswith("?"), F.replace(s, F.lit("?"), F.lit("*"))).otherwise(s)), "/")
    purity = (F.col("pool_bad") + PRIOR * F.col("share")) / (F.col("pool_n") + PRIOR)
    return left.join(F.broadcast(whole), F.lit(True)).select("host", "raw", shown.alias("template"), "bad", "labelled", purity.alias("purity"))


def filtered(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of pages (page_id, url). labels: (url, bad) of
    judged urls; one url is one label, bad if any of its labels is."""
    at = dict(zip(("host", "path"), host_and_path(F.col("url").cast("string")), strict=True))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns(at)
    judged = labels.where("url is not null and bad is not null").groupBy(F.col("url").alias("of")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    tree = stage(template_tree(urls.join(judged, F.col("url") == F.col("of"), "left")), "purity")
    rule = ruled(F.col("host"), F.col("path"), rules)
    out = urls.withColumn("raw", template(F.col("path"))).withColumn("fits", rule).join(tree, ["host", "raw"], "left")
    verdict = F.coalesce(F.col("fits")["verdict"], F.when(F.col("purity") > BAD, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("fits")["rule"].alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))
