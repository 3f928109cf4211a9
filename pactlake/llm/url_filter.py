"""URL filter: host and path rules first, then a path-template tree of each host.

Paths are cut into segments whose digits and hex runs are generalised; per host, level by level,
a node with more than ``FAN`` different children gets one wildcard child; then sibling branches
whose children are distributed alike (total variation at most ``ALIKE``) and whose labels do not
contradict are merged.  A template is rejected if its smoothed labelled purity, (blocked + A * PRIOR) /
(labelled + A), reaches ``REJECT``.  Labels are a column's, or else the rules' verdicts.

A tree has ``DEPTH`` levels: the last takes all further segments of a path as one, generalised
like any other, so longer paths are told apart there, too.

Everything before the merge is pre-aggregated by template, so a host that holds a third of all
rows is a few rows when its tree is put together; a tree has at most (FAN + 1) ** DEPTH leaves.

Defined results: a null url or one without ``://`` has an empty host and path and is judged by
the templates like any other (no label: allowed); repeated rows get equal verdicts; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.llm._batches import cut

FAN, ALIKE, DEPTH = 20, 0.15, 4
SMOOTH, PRIOR, REJECT = 4.0, 0.25, 0.8
#: Rules become one expression; longer lists are refused.
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEP = "\x1f"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @staticmethod
    def parse(line: str) -> Rule:
        verdict, _, what = line.partition(" ")
        host, slash, path = what.partition("/")
        return Rule(verdict, host, slash + path)

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        name, verdict = F.when(r.fits(), r.name).otherwise(name), F.when(r.fits(), r.verdict).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """A segment with its variable runs generalised."""
    hexed = F.regexp_replace(segment, r"(?i)(?<![0-9a-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?![0-9a-z])", "{h}")
    return F.regexp_replace(hexed, r"[0-9]+", "{n}")


def _levels(path: Column) -> Column:
    """``DEPTH`` segments of a path; the last holds all the rest, missing ones are empty marks."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", DEPTH)
    seg = lambda i: F.coalesce(shape(F.get(parts, F.lit(i))), F.lit("{end}"))
    return F.array(*[seg(i) for i in range(DEPTH)])


def _host_tree(tree: pd.DataFrame) -> pd.DataFrame:
    """Merges alike branches of one host's templates and adds the labelled purity of each."""
    names = [f"s{i}" for i in range(DEPTH)]
    merged = tree[names].copy()
    for level in reversed(range(DEPTH)):  # leaves first: branches are compared as already merged
        below = merged[names[level + 1]] if level + 1 < DEPTH else pd.Series("", index=merged.index)
        work = pd.DataFrame({"up": merged[names[:level]].agg(_SEP.join, axis=1) if level else "", "own": merged[names[level]], "below": below, "n": tree.n, "blocked": tree.blocked, "labelled": tree.labelled})
        label: dict[tuple[str, str], str] = {}
        for up, group in work.groupby("up", sort=True):
            clusters: list[list] = []  # [members, child counts, blocked, labelled]
            for own, node in group.groupby("own", sort=True):
                kids, n = node.groupby("below").n.sum().to_dict(), float(node.n.sum())
                bad, known = float(node.blocked.sum()), float(node.labelled.sum())
                home = None if own == "{end}" else next((c for c in clusters if _alike(c[1], kids, n) and _agree(c[2], c[3], bad, known)), None)
                if home is None:
                    clusters.append([[own], kids, bad, known])
                else:
                    home[0].append(own)
                    for k, v in kids.items():
                        home[1][k] = home[1].get(k, 0) + v
                    home[2] += bad
                    home[3] += known
            for members, *_ in clusters:
                for own in members:
                    label[up, own] = "{" + "|".join(members) + "}" if len(members) > 1 else own
        merged[names[level]] = [label[k] for k in zip(work.up, work.own, strict=True)]
    tree = tree.assign(template="/" + merged.agg("/".join, axis=1))
    sums = tree.groupby("template")[["blocked", "labelled"]].transform("sum")
    return tree.assign(purity=(sums.blocked + SMOOTH * PRIOR) / (sums.labelled + SMOOTH))[["host", *names, "template", "purity"]]


def _alike(a: dict[str, float], b: dict[str, float], n: float) -> bool:
    """Whether two branches' children are distributed alike, as far as their counts can tell."""
    total = sum(a.values())
    gap = sum(abs(a.get(k, 0) / total - b.get(k, 0) / n) for k in a.keys() | b.keys()) / 2
    noise = 0.5 * (len(a.keys() | b.keys()) - 1) ** 0.5 * (1 / total + 1 / n) ** 0.5
    return gap <= ALIKE + noise


def _agree(bad: float, known: float, more_bad: float, more_known: float) -> bool:
    return not known or not more_known or abs(bad / known - more_bad / more_known) <= 0.2


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", label: str | None = None) -> DataFrame:
    """For each row: key, host, path, rule, verdict, template, purity.

    label: a column of labels, "block" or "allow", that purity is counted from where it is not null.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), (F.col(label) if label else F.lit(None)).cast("string").alias("_label"))
    host, path = split_url(F.col("_url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    name, verdict = judged(rules)
    rows = rows.withColumn("rule", name).withColumn("_said", verdict).withColumn("_label", F.coalesce("_label", "_said"))
    seg = [f"s{i}" for i in range(DEPTH)]
    levels = rows.withColumn("_l", _levels(F.col("path"))).select("*", *[F.get("_l", F.lit(i)).alias(s) for i, s in enumerate(seg)]).drop("_l")
    tree = levels.groupBy("host", *seg).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_label") == "block").cast("long")).alias("blocked"), F.count("_label").alias("labelled"))
    tree = cut(tree.select("host", *seg, *[F.col(s).alias(f"raw{i}") for i, s in enumerate(seg)], "n", F.coalesce("blocked", F.lit(0)).alias("blocked"), "labelled"))
    for i, s in enumerate(seg):
        up = ["host", *seg[:i]]
        wild = tree.groupBy(*up).agg(F.count_distinct(s).alias("fan")).where(F.col("fan") > FAN).select(*up, F.lit(True).alias("wild"))
        # Each level reads the last one twice, so it is written; else reads would double with every level.
        tree = cut(tree.join(wild, up, "left").withColumn(s, F.when(F.col("wild") & (F.col(s) != "{end}"), "*").otherwise(F.col(s))).drop("wild"))
    nodes = tree.groupBy("host", *seg).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    ddl = "host string, " + ", ".join(f"{s} string" for s in seg) + ", template string, purity double"
    known = nodes.groupBy("host").applyInPandas(_host_tree, ddl)
    raw = [f"raw{i}" for i in range(DEPTH)]
    found = tree.select("host", *raw, *seg).join(known, ["host", *seg]).select("host", *[F.col(r).alias(s) for r, s in zip(raw, seg, strict=True)], "template", "purity")
    made = levels.join(found, ["host", *seg], "left")
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return made.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("_said", own).alias("verdict"), "template", "purity")
