"""URL filters: listed rules first, then mined association rules.

A listed rule (host, path) fits its host and all subdomains if the url's path
starts with the rule's path; the longest that fits decides.  Where none fits,
association rules decide: FP-growth mines combinations of url tokens that go
with bad labels; rules below a support or confidence are pruned; a url with all
tokens of a rule left is blocked.  Only minimal rules are kept, as a rule whose
tokens hold those of another blocks no further url; the rule reported is the
most confident of them.  Tokens that always occur together are one, so that a
site's many common tokens do not multiply rules.  Mined rules are found by an inverted index on their
rarest token and then verified in full.

Only DataFrame functions and Spark ML run here, no Python on executors.

Defined cases: a null url, or one without ``://``, has an empty host and path,
and is allowed unless a rule says otherwise; repeated urls get equal verdicts;
null labels and labels of unknown pages are ignored; without labels or pages
nothing is mined; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import splittable, written

BAD = "label:bad"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (``host/path...``) that fits, or null.  Rules: (verdict, 'host/path')."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, host labels and endings, path parts (digits as 0), query keys, fragment."""
    labels = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.array_distinct(
        F.filter(
            F.concat(
                F.array(F.concat(F.lit("scheme:"), lower_ascii(F.regexp_extract(url, "^([^:/?#]*)://", 1)))),
                F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
                F.array(F.concat(F.lit("end:"), F.array_join(F.slice(F.reverse(labels), 1, 2), "."))),
                F.transform(parts, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0"))),
                F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1))),
                F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
            ),
            lambda x: x.isNotNull(),
        )
    )


def mine(pages: DataFrame, labels: DataFrame, min_support: float, min_confidence: float, min_count: int) -> DataFrame:
    """Association rules (tokens, parts, support, confidence) that conclude a bad label.

    ``labels`` has (page_id, bad); all labelled pages are used.  A rule needs
    the share ``min_support`` and the number ``min_count`` of them, all bad,
    behind it.  All such rules that are minimal are kept.

    Mining sees only what a minimal rule of several tokens can hold, so that its
    itemsets stay few: tokens that are frequent among bad pages, are no rule by
    themselves, and of tokens that occur in exactly the same labelled pages one;
    ``parts`` has for each token of a rule all that stand for it.
    """
    none = "tokens array<string>, parts array<array<string>>, support double, confidence double"
    bad = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.select("page_id", "url").filter("url is not null").join(bad, "page_id")
    items = written(rows.select(F.monotonically_increasing_id().alias("row"), "bad", tokens(F.col("url")).alias("own")), "url-items")
    total = items.count()
    least = max(min_support * total, min_count)
    if least > total:  # fewer labelled pages than a rule needs
        return pages.sparkSession.createDataFrame([], none)
    each = items.select("row", F.col("bad").cast("int").alias("bad"), F.explode("own").alias("token"))
    mark = lambda seed: F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(20,0)")).alias(f"mark{seed}")
    frequent = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad"), mark(1), mark(2)).filter(F.col("n_bad") >= least)
    # Frequent tokens are few: tokens of a url divided by min_support at most.
    alike = written(frequent.groupBy("n", "n_bad", "mark1", "mark2").agg(F.array_sort(F.collect_set("token")).alias("part")).select(F.col("part")[0].alias("token"), "part", "n_bad", (F.col("n_bad") / F.col("n")).alias("confidence")), "url-tokens")
    alone = alike.filter(F.col("confidence") >= min_confidence).select(F.array("token").alias("tokens"), F.array("part").alias("parts"), (F.col("n_bad") / total).alias("support"), "confidence")
    others = alike.filter(F.col("confidence") < min_confidence)
    standing = each.join(others.select(F.col("token").alias("named"), F.explode("part").alias("token")), "token").groupBy("row").agg(F.collect_set("named").alias("named"))
    label = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    baskets = items.join(standing, "row", "left").select(F.concat(F.coalesce("named", F.array().cast("array<string>")), label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / total, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("tokens"), "support", "confidence")
    several = minimal(rules)
    parts = several.select("tokens", F.explode("tokens").alias("token")).join(others.select("token", "part"), "token").groupBy("tokens").agg(F.collect_list("part").alias("parts"))
    return alone.unionByName(several.join(parts, "tokens").select("tokens", "parts", "support", "confidence"))


def minimal(rules: DataFrame) -> DataFrame:
    """The rules whose tokens hold those of no other rule.

    By number of tokens: the fewest are minimal, rules that hold one of these
    go, and so on with what is left, which each round makes smaller.
    """
    left, out = written(rules.dropDuplicates(["tokens"]), "rules"), None
    while (least := left.agg(F.min(F.size("tokens"))).first()[0]) is not None:
        own = left.filter(F.size("tokens") == least)
        out = own if out is None else out.unionByName(own)
        longer = left.filter(F.size("tokens") > least)
        index = inverted(own.select("tokens")).select(F.col("tokens").alias("part"), "token")
        holds = longer.withColumn("token", F.explode("tokens")).join(index, "token").filter(F.forall("part", lambda t: F.array_contains("tokens", t)))
        left = written(longer.join(holds.select("tokens").distinct(), "tokens", "left_anti"), "rules")
    return left if out is None else out


def inverted(rules: DataFrame) -> DataFrame:
    """Each rule under one of its tokens: that which the fewest rules share."""
    each = rules.select("*", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("n"))
    chosen = each.join(shared, "token").groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return rules.join(chosen, "tokens")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], min_support: float = 0.002, min_confidence: float = 0.6, min_count: int = 20) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the mined rule that blocked it, if one did."""
    base = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    base = base.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    # The number of rules has no bound, so the index is not broadcast by force; it is written, so that Spark knows its size.
    index = inverted(mine(pages, labels, min_support, min_confidence, min_count))
    # Under all tokens that stand for the chosen one.
    index = written(index.withColumn("token", F.explode(F.filter("parts", lambda p: F.array_contains(p, F.col("token")))[0])), "rules-index")
    # A mined verdict depends on the url alone, so each distinct url is matched once.
    urls = base.filter(F.col("rule").isNull() & F.col("url").isNotNull()).select("url").distinct().withColumn("own", tokens(F.col("url")))
    matched = splittable(
        urls.withColumn("token", F.explode("own")).join(index, "token").filter(F.forall("parts", lambda p: F.arrays_overlap(p, "own")))
        .groupBy("url").agg(F.max_by(F.array_join("tokens", " "), F.struct("confidence", "tokens")).alias("mined")),
        "urls-matched",
    )
    judged = base.join(matched, "url", "left")
    blocks = [r for v, r in rules if v == "block"]
    verdict = F.when(F.col("rule").isin(blocks), "block").when(F.col("rule").isNotNull(), "allow").when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"))
