"""URL filter by association rules, in DataFrame functions and Spark's FP-growth.

Listed rules (host and path) decide first, the longest wins. What they decide labels their
urls; FP-growth mines token combinations of those, rules to a verdict are pruned by support
and confidence, and each other url takes the best rule whose tokens it has all of, found by
an inverted index from token to rule. Urls with the same tokens are judged once.

A rule that adds tokens to one of the same verdict and at least its confidence never counts, so
mining leaves out what can only make such rules. Tokens that the same labelled urls have are one
class, mined once (any of them stands for it in a url). Rules of a single class are counted
directly. FP-growth then combines the classes that are frequent, have both verdicts and aren't in
every labelled url: others gain nothing from a further token. A labelled url of thousands of parts,
rare or repeated, is a class or two. What is left grows with the combinations of classes that
labelled urls of different verdicts share.

Null urls, and urls without `://`, have empty host and path, fit no rule and have no tokens:
the default verdict. Repeated rows get equal verdicts. Empty tables give none; further
columns pass through unless named as a result column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, scratch, stored

SUPPORT, CONFIDENCE, DEFAULT = 0.005, 0.9, "allow"
#: A token set with over a HOT-th of the open rows is joined by a broadcast.
HOT = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = ("host", "path", "rule", "verdict")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, like ("example.org/es/", "block"); else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        own, slash, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the host, its labels by place from the end, the path's parts and its last part's form; digits as #."""
    labels = F.reverse(F.split(host, r"\."))
    placed = F.transform(labels, lambda x, i: F.concat(F.lit("l"), F.least(i, F.lit(3)).cast("string"), F.lit("="), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    shaped = F.transform(parts, lambda x, i: F.concat(F.lit("p"), F.least(i, F.lit(3)).cast("string"), F.lit("="), F.regexp_replace(x, "[0-9]+", "#")))
    every = F.array_distinct(F.concat(F.array(F.concat(F.lit("h="), host)), placed, shaped))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(every))


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(antecedent, verdict, confidence, support) from rows (tokens, verdict); a rule no better than a part of it is dropped."""
    items = labelled.select(F.array_append("tokens", F.concat(F.lit("verdict="), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    to = F.get("consequent", F.lit(0))
    return model.associationRules.filter(to.startswith("verdict=")).select(
        F.array_sort("antecedent").alias("antecedent"), F.substr(to, F.lit(9)).alias("verdict"), "confidence", "support"
    )


def labelled_sets(labelled: DataFrame) -> DataFrame:
    """(tokens, verdict, n, a, b): the distinct rows of (tokens, verdict), their number and two hashes."""
    sets = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n"))
    return sets.withColumns({"a": F.xxhash64("tokens", "verdict"), "b": F.xxhash64("verdict", "tokens", F.lit(1))})


def counted(sets: DataFrame, least: int) -> DataFrame:
    """(token, verdict, hits, seen, most, cls) of the tokens that `least` rows of one verdict have.

    cls: the first of the tokens that exactly the same rows have (told by 128 bits of their
    hashes, combined); they are all in one url, so a class is no larger than that. most: hits
    of the token's commonest verdict.
    """
    each = sets.select("verdict", "n", "a", "b", F.explode("tokens").alias("token"))
    by_verdict = each.groupBy("token", "verdict").agg(F.sum("n").alias("hits"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    by_token = by_verdict.groupBy("token").agg(F.sum("hits").alias("seen"), F.max("hits").alias("most"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    same = W.partitionBy("a", "b", "seen")
    classes = by_token.filter(F.col("most") >= least).select("token", "seen", "most", F.min("token").over(same).alias("cls"))
    return by_verdict.select("token", "verdict", "hits").join(classes, "token")


def minimal_rules(labelled: DataFrame, support: float, confidence: float, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules over classes, (token, cls)): mined_rules() of rows (tokens, verdict) without those that pruned() drops."""
    sets = stored(labelled_sets(labelled), f"{path}/labelled")
    total = sets.agg(F.sum("n")).first()[0] or 0
    tokens = stored(counted(sets, max(1, math.ceil(support * total))), f"{path}/tokens")
    heads = tokens.filter("token = cls")
    sure = F.col("hits") / F.col("seen")
    singles = heads.filter((F.col("hits") >= math.ceil(support * total)) & (sure >= confidence)).select(
        F.array("token").alias("antecedent"), "verdict", sure.alias("confidence"), (F.col("hits") / F.lit(max(1, total))).alias("support")
    )
    mixed = heads.filter((F.col("most") < F.col("seen")) & (F.col("seen") < total)).select("token").distinct()
    held = sets.select("a", "b", F.explode("tokens").alias("token")).join(mixed, "token").groupBy("a", "b").agg(F.collect_list("token").alias("left"))
    rows = sets.join(held, ["a", "b"], "left").select(
        F.coalesce("left", F.array().cast("array<string>")).alias("tokens"), "verdict", F.explode(F.sequence(F.lit(1), "n")).alias("copy")
    )
    several = mined_rules(rows, support, confidence).filter(F.size("antecedent") > 1)
    return pruned(stored(singles.unionByName(several), f"{path}/mined")), tokens.select("token", "cls").distinct()


def in_classes(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Sets (key, tokens, seen) with the classes of their tokens as tokens; sets without any are left out."""
    each = sets.select("key", "seen", F.explode("tokens").alias("token")).join(classes, "token")
    return each.groupBy("key").agg(F.first("seen").alias("seen"), F.collect_set("cls").alias("tokens"))


def anchored(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """rules with `anchor`: the token of each that is rarest by counts (token, seen), the first of equals.

    Whatever holds all of a rule's tokens holds its anchor, so an index by anchors meets few rules
    even where some tokens are in most urls.
    """
    each = rules.select("rule_id", F.explode("antecedent").alias("token")).join(counts, "token", "left")
    rarest = each.groupBy("rule_id").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token"))["token"].alias("anchor"))
    return rules.join(rarest, "rule_id")


def _holds(tokens: str, part: str) -> Column:
    return F.size(F.array_except(F.col(part), F.col(tokens))) == 0


def pruned(rules: DataFrame) -> DataFrame:
    """Rules without those that add tokens to a rule of the same verdict and at least their confidence."""
    r = rules.withColumn("rule_id", F.xxhash64("antecedent", "verdict")).withColumn("n", F.size("antecedent"))
    seen = r.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count("*").alias("seen"))
    index = anchored(r, seen).select(
        F.col("anchor").alias("token"), F.col("antecedent").alias("part"), F.col("verdict").alias("v"),
        F.col("confidence").alias("c"), F.col("n").alias("m")
    )
    pairs = r.select("rule_id", "antecedent", "verdict", "confidence", "n", F.explode("antecedent").alias("token")).join(index, "token")
    worse = pairs.filter((F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence")) & (F.col("m") < F.col("n")) & _holds("antecedent", "part"))
    return r.join(worse.select("rule_id").distinct(), "rule_id", "left_anti")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, seen, mined): the best rule's verdict for each distinct token set (key, tokens, seen) that has all of its tokens.

    Best: confidence, then support, then more tokens, then the rule's hash. The index has a row
    for each rule, under its rarest token among the sets; only sets with that token meet the rule.
    """
    tokens = sets.select("key", "seen", "tokens", F.explode("tokens").alias("token"))
    counts = tokens.join(rules.select(F.explode("antecedent").alias("token")).distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    index = anchored(rules, counts).select(F.col("anchor").alias("token"), "antecedent", "verdict", "confidence", "support", "n", "rule_id")
    hits = tokens.join(index, "token").filter(_holds("tokens", "antecedent"))
    best = F.max_by("verdict", F.struct("confidence", "support", "n", "rule_id"))
    return hits.groupBy("key").agg(F.first("seen").alias("seen"), best.alias("mined"))


def url_filter(df: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """df with host, path, rule and verdict.

    Rows that listed rules decide, and those without tokens, meet no join. The others take their
    token set's verdict: sets with over a HOT-th of the rows (fewer than HOT of them) by a
    broadcast, and their rows are spread over the join of the rest.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    host, way = parsed(quoted(url_col))
    keep = [quoted(c) for c in df.columns if c not in RESULT]
    base = df.select(*keep, host.alias("host"), way.alias("path"))
    base = base.withColumns({"\0rule": listed(F.col("host"), F.col("path"), rules), "\0tokens": tokens(F.col("host"), F.col("path"))})
    labelled = base.filter("`\0rule` is not null").select(F.col("`\0tokens`").alias("tokens"), F.col("`\0rule`.verdict").alias("verdict"))
    found, classes = minimal_rules(labelled, support, confidence, path)
    found = stored(found, f"{path}/rules")
    asks = F.col("`\0rule`").isNull() & (F.size("`\0tokens`") > 0)
    rows = base.filter(asks).withColumn("\0key", F.array_join("`\0tokens`", " "))
    sets = stored(rows.groupBy(F.col("`\0key`").alias("key")).agg(F.first("`\0tokens`").alias("tokens"), F.count("*").alias("seen")), f"{path}/sets")
    judged = stored(matched(in_classes(sets, classes), found), f"{path}/judged")
    total = sets.agg(F.sum("seen")).first()[0] or 0
    hot = F.col("seen") * HOT > total
    few = sets.filter(hot).join(judged.select("key", "mined"), "key", "left").select(
        F.col("key").alias("\0key"), F.col("mined").alias("\0near"), F.lit(True).alias("\0hot")
    )
    salt = [quoted(c) for c, kind in df.dtypes if c not in RESULT and "map<" not in kind]  # of equal rows it is the same
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*salt), F.lit(1_000_000)).cast("string"))
    near = rows.withColumn("\0salt", spread).join(F.broadcast(few), "\0key", "left")
    far = near.withColumn("\0key", F.when(F.col("`\0hot`"), F.col("`\0salt`")).otherwise(F.col("`\0key`")))
    rest = judged.filter(~hot).select(F.col("key").alias("\0key"), F.col("mined").alias("\0far"))
    joined = far.join(rest, "\0key", "left")
    mined = joined.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("`\0near`", "`\0far`", F.lit(DEFAULT)).alias("verdict"))
    known = base.filter(~asks).select(*keep, "host", "path", F.col("`\0rule`.rule").alias("rule"), F.coalesce("`\0rule`.verdict", F.lit(DEFAULT)).alias("verdict"))
    return known.union(mined)
