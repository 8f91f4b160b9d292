"""URL filters: explicit rules first, then a tree of path templates per host.

The tree grows one path segment at a time.  A segment that is a number, or that occurs on one page
only, is variable and becomes a wildcard.  So does one whose labelled pages are not told apart from
its siblings' by a likelihood-ratio test at any count (half a page added to every cell).  Segments
that are told apart on the same side, all worse or all better than the rest, but not from each other
are similar branches: they merge into one, named by the first of them in braces.  An only segment of a
branch is constant.  The tree ends where no branch has enough labelled pages for a test; what lies
deeper is one wildcard.  A template is rejected when the smoothed share of good pages among its
labelled ones is too low; its prior is the host's share, whose prior is the share of all labelled pages.

Counts are aggregated before anything is joined, so a hot host costs no more than others; the
segments that stay (told apart, or on two pages at least) are a table, broadcast only if the planner
finds it small.

A url without ``://`` has an empty host and path; its template is the empty one.  A page without a
label, or with a null one, counts as unlabelled.  Repeated pages count once each; of repeated labels
of one id a bad one wins.  Templates of equal pages are equal; a very long url is one page like any
other.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encircle.llm.shared import lower_ascii, replacing, written

#: (rule, verdict): host and start of the path.
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
)
#: Pages of a constant segment, labelled pages of a branch worth a test, and the test's bound.
SUPPORT, TESTABLE, Z = 2, 4, 1.96
#: Weight of a prior in labelled pages, and the least share of good pages.
PRIOR_WEIGHT, LEAST_GOOD = 4.0, 0.5


def url_parts(url: str) -> dict[str, Column]:
    """Host (A-Z in lower case) and path; both empty where there is no ``://``."""
    rest = F.when(F.contains(F.col(url), F.lit("://")), F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return {"host": F.coalesce(lower_ascii(host), F.lit("")), "path": F.coalesce(path, F.lit(""))}


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):  # later, longer ones win
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _stats() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]


def _told_apart(n: Column, bad: Column, others: Column, others_bad: Column, z: float) -> Column:
    """Whether two groups of labelled pages have different shares of bad ones (likelihood ratio)."""
    total = n + others + 2
    rows, columns = (n + 1, others + 1), (bad + others_bad + 1, total - bad - others_bad - 1)
    cells = ((bad + 0.5, n - bad + 0.5), (others_bad + 0.5, others - others_bad + 0.5))
    terms = [
        cell * F.ln(cell * total / (row * column))
        for row, line in zip(rows, cells) for column, cell in zip(columns, line)
    ]
    return (n > 0) & (others > 0) & (2 * (terms[0] + terms[1] + terms[2] + terms[3]) > z * z)


def _steps(rows: DataFrame, support: int, z: float) -> tuple[DataFrame, int]:
    """``host, template, segment, step`` of the segments that are no wildcard, and the labelled pages
    of the branch that has most."""
    children = written(
        rows.where("segment is not null").groupBy("host", "template", "segment").agg(*_stats()), "branches"
    )
    parents = children.groupBy("host", "template").agg(
        F.sum("n").alias("p_n"), F.sum("labelled").alias("p_labelled"), F.sum("bad").alias("p_bad")
    )
    parents = written(parents, "parents")
    l, b = F.col("labelled"), F.col("bad")
    others, others_bad = F.col("p_labelled") - l, F.col("p_bad") - b
    worse = b * others > others_bad * l
    side = F.when(F.col("n") == F.col("p_n"), "only").when(
        _told_apart(l, b, others, others_bad, z), F.when(worse, "worse").otherwise("better")
    )
    named = children.where(~F.col("segment").rlike("^[0-9]+$") & (F.col("n") >= support))
    branch = ["host", "template", "side"]
    sided = written(named.join(parents, ["host", "template"]).withColumn("side", side).where("side is not null").select(*branch, "segment", "labelled", "bad"), "sides")
    sums = sided.groupBy(*branch).agg(F.sum("labelled").alias("s_labelled"), F.sum("bad").alias("s_bad"))
    apart = _told_apart(l, b, F.col("s_labelled") - l, F.col("s_bad") - b, z)
    alike = (F.col("side") != "only") & (F.col("s_labelled") > l) & ~apart
    grouped = sided.join(sums, branch).select(*branch, "segment", alike.alias("alike"))
    names = grouped.where("alike").groupBy(*branch).agg(F.min("segment").alias("first"))
    step = F.when(F.col("alike"), F.concat(F.lit("/{"), "first", F.lit("}"))).otherwise(F.concat(F.lit("/"), "segment"))
    kept = grouped.join(names, branch, "left").select("host", "template", "segment", step.alias("step"))
    return written(kept, "segments"), parents.agg(F.max("p_labelled")).first()[0] or 0


def with_templates(pages: DataFrame, support: int = SUPPORT, testable: int = TESTABLE, z: float = Z) -> DataFrame:
    """``pages`` with ``template``.  Needs ``host``, ``path`` and the counts ``labelled``, ``bad``."""
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    rows = pages.withColumns({"_segments": segments, "template": F.lit("")})
    level = 0
    while True:
        here = F.when(F.size("_segments") > level, F.element_at("_segments", F.least(F.size("_segments"), F.lit(level + 1))))
        grown = rows.withColumn("segment", here)
        kept, most = _steps(grown, support, z)
        if most < testable:
            break
        step = F.when(F.col("segment").isNull(), "").otherwise(F.coalesce("step", F.lit("/*")))
        joined = grown.join(kept, ["host", "template", "segment"], "left")
        rows = joined.withColumn("template", F.concat("template", step)).drop("step", "segment")
        level += 1
        if level % 4 == 0:
            rows = written(rows, "grown")
    rest = F.when(F.size("_segments") > level, "/**").otherwise("")
    return rows.withColumn("template", F.concat("template", rest)).drop("_segments")


def judge_urls(
    pages: DataFrame, labels: DataFrame, url: str = "url", page_id: str = "page_id",
    rules: Sequence[tuple[str, str]] = RULES, prior: float = PRIOR_WEIGHT, least_good: float = LEAST_GOOD,
) -> DataFrame:
    """``page_id, url, host, path, rule, template, good_share, verdict`` for every page.

    ``labels``: ``doc_id, quality, toxic``; a page is bad if its label says quality 0 or toxic 1.
    """
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.where(bad.isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label")).agg(
        F.max(bad.cast("int")).alias("bad")
    )
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    slim = replacing(slim, url_parts("url"))
    joined = slim.join(known, slim.page_id == known._label, "left").select(
        "page_id", "url", "host", "path",
        F.col("bad").isNotNull().cast("bigint").alias("labelled"), F.coalesce("bad", F.lit(0)).cast("bigint").alias("bad"),
    )
    rows = with_templates(joined)
    per_template = written(rows.groupBy("host", "template").agg(*_stats()), "templates")
    total = per_template.agg(F.sum("bad"), F.sum("labelled")).first()
    base = 1 - (total[0] or 0) / total[1] if total[1] else 1.0
    hosts = per_template.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("bad").alias("h_bad"))
    host_share = (F.col("h_labelled") - F.col("h_bad") + prior * F.lit(base)) / (F.col("h_labelled") + prior)
    share = (F.col("labelled") - F.col("bad") + prior * host_share) / (F.col("labelled") + prior)
    shares = written(per_template.join(hosts, "host").select("host", "template", share.alias("good_share")), "shares")
    judged = rows.join(shares, ["host", "template"])
    rule, decision = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("good_share") < least_good, "block").otherwise("allow")
    return judged.select(
        "page_id", "url", "host", "path", rule.alias("rule"), "template", "good_share",
        F.coalesce(decision, own).alias("verdict"),
    )
