"""URL filter: explicit rules first, then a tree of path templates per host, judged by smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, temporary, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A segment that is an identifier by its look: it holds a digit, or is very long.
_IDENTIFIER = r"[0-9]|^.{40,}$"
_EXTENSION = r"\.[A-Za-z]{1,5}$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules (verdict, host, path) that fits, else nulls. A rule fits its host and all
    subdomains if the path starts with the rule's."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    empty = F.lit(None).cast("string")
    return (empty, empty) if rule is None else (rule, verdict)


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _looks_wild(segment: Column) -> Column:
    return F.when(segment.rlike(_IDENTIFIER), F.concat(F.lit("*"), F.regexp_extract(segment, _EXTENSION, 0))).otherwise(segment)


def _segments(path: Column, depth: int) -> list[Column]:
    """The first depth segments, null where there are no more; then what follows them, generalised by looks alone."""
    deep = F.transform(F.slice(_parts(path), depth + 1, F.greatest(F.size(_parts(path)), F.lit(1))), _looks_wild)
    return [*[F.get(_parts(path), F.lit(i)) for i in range(depth)], F.nullif(F.array_join(deep, "/"), F.lit(""))]


def templates(paths: DataFrame, least: int = 20, spread: float = 0.5, distance: float = 0.25, gap: float = 0.15, weight: float = 10.0, prior: float = 0.5, most_levels: int = 16) -> DataFrame:
    """paths (host, path, n, labelled, bad) with `template`, `share` (smoothed share of bad labels in it) and `labels`.

    1. Level by level, a segment becomes a wildcard (keeping a file extension) if it looks like an identifier, or if the
       place has at least `least` different segments and more than `spread` of its urls' worth of different ones.
    2. From the deepest level up, a named branch is merged with its siblings if its distribution over what follows differs
       from theirs by no more than `distance` in total variation (and sampling noise), and its smoothed share of bad labels
       by no more than `gap`. Siblings are compared with their pooled total, never in pairs.
    3. Shares back off from a host to all hosts: (bad + weight * general share) / (labelled + weight), the general share being
       that of the same branch or template over all hosts, (bad + weight * prior) / (labelled + weight). `labels` counts
       those of all hosts.

    There are as many levels as the longest path has segments, up to most_levels; segments below take part by their looks
    alone. Everything is aggregation by (host, prefix, ...) and joins back in which hot keys are dealt to cells; no side is
    broadcast.
    """
    with temporary():
        paths = written(paths)
        total, longest = paths.agg(F.count("*"), F.max(F.size(_parts(F.col("path"))))).first()
        depth = min(longest or 1, most_levels)
        names = [f"s{i}" for i in range(depth + 1)]
        t = paths.select("host", "path", "n", "labelled", "bad", *[c.alias(x) for x, c in zip(names, _segments(F.col("path"), depth), strict=True)])
        under = lambda i: F.to_json(F.array("host", *names[:i]))
        meet = lambda rows, one, keys, salt, how="inner": spread_join(rows, one, keys, salt, total, how, "merge")
        smooth = lambda bad, n, bad_all, n_all: (F.col(bad) + weight * (F.col(bad_all) + weight * prior) / (F.col(n_all) + weight)) / (F.col(n) + weight)
        for i in range(depth):
            own = F.col(names[i])
            t = t.withColumn("_p", under(i))
            plain = t.where(own.isNotNull() & ~own.rlike(_IDENTIFIER)).groupBy("_p", own.alias("_b")).agg(F.sum("n").alias("n"), F.count("*").alias("_rows"))
            at = plain.groupBy("_p").agg(F.count("*").alias("_d"), F.sum("n").alias("_n"), F.sum("_rows").alias("_count"))
            t = meet(t, at.where((F.col("_d") >= least) & (F.col("_d") > spread * F.col("_n"))), ["_p"], "path", "left")
            wild = F.when(F.col("_d").isNotNull() & own.isNotNull(), F.concat(F.lit("*"), F.regexp_extract(own, _EXTENSION, 0))).otherwise(_looks_wild(own))
            t = written(t.withColumn(names[i], wild).drop("_p", "_d", "_n", "_count"))
        for i in reversed(range(depth)):
            t = t.withColumn("_p", under(i))
            named = t.where(F.col(names[i]).isNotNull() & ~F.startswith(F.col(names[i]), F.lit("*")))
            rest = F.concat_ws("/", *[F.coalesce(x, F.lit("")) for x in names[i + 1 :]])
            cell = written(named.groupBy("_p", F.to_json(F.array(*names[:i])).alias("_q") if i else F.lit("").alias("_q"), F.col(names[i]).alias("_b"), rest.alias("_r")).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")], F.count("*").alias("_rows")))
            branch = cell.groupBy("_p", "_q", "_b").agg(F.sum("n").alias("nb"), F.sum("labelled").alias("lb"), F.sum("bad").alias("bb"), F.sum("_rows").alias("rows_b"), F.count("*").alias("kinds"))
            general = branch.groupBy("_q", "_b").agg(F.sum("lb").alias("lg"), F.sum("bb").alias("bg"), F.count("*").alias("_count"))
            branch = written(meet(branch, general, ["_q", "_b"], "_p").drop("_q").withColumn("_count", F.col("kinds")))
            pool = branch.groupBy("_p").agg(F.sum("nb").alias("np"), *[F.sum(c).alias(c + "p") for c in ("lb", "bb", "lg", "bg")], F.count("*").alias("branches"), F.sum("kinds").alias("_count"))
            same = cell.groupBy("_p", "_r").agg(F.sum("n").alias("ns"), F.count("*").alias("_count"))
            x = meet(cell.select("_p", "_b", "_r", "n"), branch, ["_p", "_b"], "_r").drop("_count")
            x = meet(meet(x, pool, ["_p"], "_b").drop("_count"), same, ["_p", "_r"], "_b")
            mine, all_ = F.col("n") / F.col("nb"), F.col("ns") / F.col("np")
            x = x.groupBy("_p", "_b").agg(((F.sum(F.abs(mine - all_)) + 1 - F.sum(all_)) / 2).alias("_tv"), *[F.first(c).alias(c) for c in (*branch.columns[2:], *pool.columns[1:-1])])
            apart = F.abs(smooth("bb", "lb", "bg", "lg") - smooth("bbp", "lbp", "bgp", "lgp"))
            alike = (F.col("branches") > 1) & (F.col("_tv") <= distance + F.sqrt(F.col("kinds") / F.col("nb")) / 2) & (apart <= gap)
            merged = x.where(alike).select("_p", F.col("_b").alias(names[i]), F.lit("+").alias("_to"), F.col("rows_b").alias("_count"))
            t = meet(t, merged, ["_p", names[i]], "path", "left")
            t = written(t.withColumn(names[i], F.coalesce("_to", names[i])).drop("_p", "_to", "_count"))
        t = t.select("host", "path", "n", "labelled", "bad", F.concat(F.lit("/"), F.concat_ws("/", *names)).alias("template"))
        sums = t.groupBy("host", "template").agg(F.sum("labelled").alias("_l"), F.sum("bad").alias("_b"), F.count("*").alias("_rows"))
        general = sums.groupBy("template").agg(F.sum("_l").alias("labels"), F.sum("_b").alias("_bad"), F.count("*").alias("_count"))
        sums = meet(sums, general, ["template"], "host").drop("_count").withColumnRenamed("_rows", "_count")
        out = meet(t, sums, ["host", "template"], "path")
        return written(out.select("host", "path", "n", "template", smooth("_b", "_l", "_bad", "labels").alias("share"), "labels"), outlive=True)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, reject: float = 0.7) -> DataFrame:
    """page_id, host, path, rule, verdict, template for every row of pages.

    A rule decides where one fits. Elsewhere the url's template does: it blocks if its smoothed share of bad labels is at
    least `reject`. Labels are label_col (true: bad, null: none) or, without one, what the rules say about their own pages,
    which reach pages that no rule fits through the same template on other hosts. A url that is null or has no :// has an
    empty host and path and the template of that path; repeated rows are judged each; a null id stays null; a template
    without labels on any host is allowed. Other columns, whatever their names, aren't looked at.
    """
    host, path = host_and_path(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), (F.col(label_col).cast("boolean") if label_col else F.lit(None).cast("boolean")).alias("_label"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    p = written(p.withColumns({"rule": rule, "_said": verdict, "_row": F.monotonically_increasing_id()}))
    label = F.col("_label") if label_col else (F.col("_said") == "block")
    paths = p.groupBy("host", "path").agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.count_if(label).alias("bad"))
    found = templates(paths).withColumnRenamed("n", "_count")
    out = spread_join(p, found, ["host", "path"], "_row", p.count(), "inner", "merge")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when((F.col("labels") > 0) & (F.col("share") >= reject), "block").otherwise("allow")).alias("verdict"), "template")
