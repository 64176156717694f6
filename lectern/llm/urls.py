"""URL filters: rules by host and path, and a path-template tree judged by labelled purity.

Pages are summed to paths (host, segments), the leaves of one tree for each host; the tree is then worked level by level on
these sums. Among a node's children those that differ in digits only are one group, and a group with very many children of few pages each
becomes one branch, "#" for the digits, as do its children whose share of good labels doesn't differ significantly from the group's. Then the
same is done with all branches of the node, whose wildcard is "*". What differs stays a branch of its own. A template whose
smoothed purity is below one half is rejected. Only the first step and the last lookup touch pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, UPPER, joined, settle

#: A node with this many children or more, of fewer pages each than this on average, has variable children.
FANOUT, SUPPORT = 12, 4.0
#: Standard errors by which a branch's purity has to differ to stay apart, and pseudo-labels of the smoothing.
APART, PRIOR = 2.58, 4.0

Rule = tuple[str, str]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; then up to "?", "#" or the end.

    Of a null url, or one without "://", both are empty.
    """
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.

    rules: ("allow" or "block", "host/path"); a rule fits its host and all subdomains where the path starts with
    the rule's. Of equally long rules that both fit, the one listed first wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules[::-1], key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shapes(path: Column) -> Column:
    """The path's segments, all of them."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _merged(children: DataFrame, node: list[str], wildcard: Column, needs: float) -> DataFrame:
    """(node, child, name) for children (node, child, n, labelled, good) of nodes: its own name, or the wildcard.

    needs: pages that a child has at least to stay apart. Sums over nodes are joined back by broadcast for nodes with very many children.
    """
    key = F.struct(*node).alias("__node")
    nodes = children.groupBy(key).agg(F.count("*").alias("k"), F.sum("n").alias("kn"), F.sum("labelled").alias("kl"), F.sum("good").alias("kg"))
    both = joined(children.withColumn("__node", F.struct(*node)), settle(nodes, "nodes"), "__node", "k")
    rest, rest_good = F.col("kl") - F.col("labelled"), F.col("kg") - F.col("good")
    pooled = (F.col("kg") + 1) / (F.col("kl") + 2)
    differs = F.when(
        (F.col("labelled") > 0) & (rest > 0) & (F.col("n") >= needs),
        F.abs(F.col("good") / F.col("labelled") - rest_good / rest) > APART * F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest)),
    ).otherwise(F.lit(False))
    variable = (F.col("k") >= FANOUT) & (F.col("kn") < SUPPORT * F.col("k"))
    name = F.when((F.col("k") > 1) & (variable | ~differs), wildcard).otherwise(F.col("child"))
    return both.select(*node, "child", "n", "labelled", "good", name.alias("name"))


def templates(leaves: DataFrame, levels: int) -> DataFrame:
    """(host, shape, n, labelled, good, template) for leaves (host, shape, n, labelled, good): one row each, ``shape`` an array.

    Level by level each leaf's segment is replaced by its branch's name; levels: the most segments of a leaf. All figures
    are sums over nodes; the rows are distinct paths, not pages. A group's children stay apart from SUPPORT pages on.
    """
    df = leaves.withColumn("prefix", F.lit(""))
    for level in range(levels):
        segment = F.get(F.col("shape"), F.lit(level))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
        children = df.where(F.size("shape") > level).groupBy("host", "prefix", segment.alias("child")).agg(*sums, F.count("*").alias("rows"))
        children = settle(children.withColumn("group", F.regexp_replace("child", "[0-9]+", "#")), "children")
        first = settle(_merged(children.drop("rows"), ["host", "prefix", "group"], F.col("group"), SUPPORT), "groups")
        branches = first.groupBy("host", "prefix", F.col("name").alias("child")).agg(*sums)
        second = _merged(branches, ["host", "prefix"], F.lit("*"), 0)
        # A digit-free segment that is spelled like a group's name is in the same branch as the group.
        of = first.select("host", "prefix", "child", F.col("name").alias("__branch")).join(second.select("host", "prefix", F.col("child").alias("__branch"), "name"), ["host", "prefix", "__branch"])
        of = of.join(children.select("host", "prefix", "child", "rows"), ["host", "prefix", "child"])
        names = settle(of.select(F.struct("host", "prefix", "child").alias("__at"), "name", F.col("rows").alias("__rows")), "names")
        deep = joined(df.where(F.size("shape") > level).withColumn("__at", F.struct("host", "prefix", segment.alias("child"))), names, "__at", "__rows")
        deep = deep.withColumn("prefix", F.concat_ws("/", "prefix", "name")).select(df.columns)
        df = settle(deep.unionByName(df.where(F.size("shape") <= level)), "level")  # each level reads the one before several times
    return df.select("host", "shape", "n", "labelled", "good", F.when(F.col("prefix") == "", F.lit("/")).otherwise(F.col("prefix")).alias("template"))


def judged(pages: DataFrame, labels: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` with host, path, template, purity, rule and verdict.

    labels: (id, good): labels of pages, by page_id; a null good is no label, of several the worse counts. purity: the template's share of
    good labels, drawn to the overall share by four pseudo-labels; verdict: the rule's, else "block" if the
    purity is below one half, else "allow". Without labels everything that no rule blocks is allowed. Existing columns of these names are replaced.
    Every row is judged, repeated ones and those with a null page_id or url too; these have the host and path "". An empty table gives an empty one.
    """
    own = ["host", "path", "template", "purity", "rule", "verdict"]
    host, path = parts(F.col("url"))
    df = pages.drop(*own).withColumn("host", host).withColumn("path", path).withColumn("__shape", shapes(F.col("path")))
    known = labels.where("id is not null and good is not null").groupBy("id").agg(F.min(F.col("good").cast("int")).alias("good"))
    seen = df.select("page_id", "host", "__shape").join(known, F.col("page_id") == F.col("id"), "left")
    leaves = seen.groupBy("host", F.col("__shape").alias("shape")).agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    leaves = settle(leaves, "leaves")  # copies of a url are one leaf
    total = leaves.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"), F.coalesce(F.max(F.size("shape")), F.lit(0)).alias("levels")).first()
    overall = total["g"] / total["l"] if total["l"] else 1.0
    trees = templates(leaves, total["levels"])
    at = F.struct("host", "template").alias("__at")
    smoothed = (F.sum("good") + F.lit(PRIOR * overall)) / (F.sum("labelled") + F.lit(PRIOR))
    pure = settle(trees.groupBy(at).agg(smoothed.alias("purity"), F.count("*").alias("__rows")), "pure")
    verdicts = joined(trees.withColumn("__at", at), pure, "__at", "__rows").select(F.struct("host", "shape").alias("__leaf"), "template", "purity", F.col("n").alias("__rows"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    out = joined(df.withColumn("__leaf", F.struct("host", "__shape")), settle(verdicts, "verdicts"), "__leaf", "__rows").withColumn("rule", rule)
    out = out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("purity") < 0.5, F.lit("block")).otherwise(F.lit("allow"))))
    return out.select(*pages.drop(*own).columns, *own)
