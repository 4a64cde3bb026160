"""URL filters from a tree of path templates.

A path is first written as a shape: runs of digits and long hexadecimal strings become
``#``. On the table of shapes by host (with their counts of pages, of labelled and of bad
ones) the tree is worked on level by level, as joins and aggregates: where a node has many
children, its rare ones become ``*`` unless their labels tell them from the others; from the deepest level up, branches that differ in
one segment only are merged to ``~`` unless their share of bad pages differs from that of
the others by a two-proportion test. A template whose smoothed share of bad pages is too
large is rejected. Pages look their template up by host and shape.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.keys import ascii_lower
from corpusforge.runtime import small, table


@dataclass(frozen=True)
class Settings:
    """A child of a node with more than ``children`` of
    them is generalised if it has less than ``share`` of its pages, unless it has ``apart`` labels or more
    and the test (with a correction for continuity, as there are many children) tells it from the others. Branches are merged below ``chi2``
    (95 % for one degree of freedom). ``strength``: labelled pages that the overall share counts as.
    A template is rejected from a smoothed share of ``reject``."""

    children: int = 20
    share: float = 0.05
    apart: int = 5
    chi2: float = 3.84
    strength: float = 10.0
    reject: float = 0.5


#: Verdict and rule; of those that fit, the longest counts.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, under = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{under}")
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def shape_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "(?i)[0-9a-f]{16,}", "#"), "[0-9]+", "#")


def _levels(tree: DataFrame) -> list[int]:
    """The levels at which some host has several segments; at others there is nothing to generalise or to merge."""
    at = tree.select("host", F.posexplode("t").alias("level", "segment")).groupBy("host", "level").agg(F.min("segment").alias("a"), F.max("segment").alias("b"))
    return sorted(r[0] for r in at.filter("level > 0 and a <> b").select("level").distinct().collect())


def _proportions(continuous: bool = False) -> tuple[Column, Column]:
    """Is there nothing to test, and chi2 of ``bad`` of ``lab`` against the rest of ``all_bad`` of ``all``; null if there's nothing."""
    rest, rest_bad = F.col("all") - F.col("lab"), F.col("all_bad") - F.col("bad")
    alike = (F.col("lab") == 0) | (rest == 0) | (F.col("all_bad") == 0) | (F.col("all_bad") == F.col("all"))
    pooled, per = F.col("all_bad") / F.col("all"), 1 / F.col("lab") + 1 / rest
    gap = F.abs(F.col("bad") / F.col("lab") - rest_bad / rest)
    gap = F.greatest(gap - per / 2, F.lit(0.0)) if continuous else gap
    return alike, F.when(~alike, gap * gap / (pooled * (1 - pooled) * per))


def learn_templates(pages: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``host, shape, template, n_labelled, bad_share`` (smoothed) of every host and shape.

    ``pages``: page_id, host, shape. ``labels``: page_id, bad (boolean, one row an id).
    """
    s = settings
    seen = pages.join(labels, "page_id", "left").groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.count_if("bad").alias("bad"))
    tree = table(seen.withColumn("t", F.split("shape", "/")), "url-shapes")
    total = tree.agg(F.sum("lab"), F.sum("bad")).first()
    overall = (total[1] or 0) / (total[0] or 1)

    levels = _levels(tree)
    for level in levels:
        at = tree.filter(F.size("t") > level).select("host", F.slice("t", 1, level).alias("above"), F.col("t")[level].alias("child"), "n", "lab", "bad")
        child = at.groupBy("host", "above", "child").agg(F.sum("n").alias("c"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
        node = child.groupBy("host", "above").agg(F.count("*").alias("k"), F.sum("c").alias("pages"), F.sum("lab").alias("all"), F.sum("bad").alias("all_bad")).filter(F.col("k") > s.children)
        alike, chi2 = _proportions(continuous=True)
        apart = (F.col("lab") >= s.apart) & ~alike & (chi2 >= s.chi2)
        rare = child.join(node, ["host", "above"]).filter((F.col("c") < s.share * F.col("pages")) & ~F.coalesce(apart, F.lit(False))).select("host", "above", "child", F.lit(True).alias("rare"))
        placed = tree.withColumn("above", F.slice("t", 1, level)).withColumn("child", F.get("t", F.lit(level)))
        new = F.when(F.col("rare"), F.transform("t", lambda x, i: F.when(i == level, F.lit("*")).otherwise(x))).otherwise(F.col("t"))
        tree = table(placed.join(rare, ["host", "above", "child"], "left").select("host", "shape", "n", "lab", "bad", new.alias("t")), "url-tree")

    for level in reversed(levels):
        stats = tree.groupBy("host", "t").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).filter(F.size("t") > level)
        stats = stats.withColumn("merged", F.transform("t", lambda x, i: F.when(i == level, F.lit("~")).otherwise(x)))
        family = stats.groupBy("host", "merged").agg(F.count("*").alias("k"), F.sum("lab").alias("all"), F.sum("bad").alias("all_bad")).filter("k > 1")
        alike, chi2 = _proportions()
        merged = stats.join(family, ["host", "merged"]).filter(alike | (chi2 < s.chi2)).select("host", "t", "merged")
        tree = table(tree.join(merged, ["host", "t"], "left").select("host", "shape", "n", "lab", "bad", F.coalesce("merged", "t").alias("t")), "url-tree")

    pure = tree.groupBy("host", "t").agg(F.sum("lab").alias("n_labelled"), F.sum("bad").alias("all_bad"))
    share = (F.col("all_bad") + s.strength * overall) / (F.col("n_labelled") + s.strength)
    known = tree.select("host", "shape", "t").join(pure, ["host", "t"])
    return known.select("host", "shape", F.array_join("t", "/").alias("template"), "n_labelled", share.alias("bad_share"))


def url_filter(
    pages: DataFrame,
    labels: DataFrame,
    page_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    settings: Settings = Settings(),
    label_id_col: str = "doc_id",
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, template, bad_share``.

    A page's label is that of its id: bad if toxic or not of good quality. An id with
    several labels is bad if one of them is; an id without or with null labels has none. The
    verdict is the rule's, or else ``block`` if the template is rejected and ``allow`` if not.
    A null url, or one without ``://``, has an empty host and path, which have a template
    as any. Repeated rows count and give repeated results; empty tables are allowed; other
    columns are not looked at.
    """
    url = F.col(url_col)
    seen = pages.select(F.col(page_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("shape", shape_of(F.col("path")))
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    marks = labels.select(F.col(label_id_col).alias("page_id"), bad.alias("bad")).filter("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = table(learn_templates(seen, marks, settings), "url-templates")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    judged = seen.join(small(known), ["host", "shape"], "left").withColumn("r", rule)
    verdict = F.coalesce("r.verdict", F.when(F.col("bad_share") >= settings.reject, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "bad_share")
