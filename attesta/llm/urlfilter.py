"""URL filters: host and path rules, then the ratio of two character language models. Built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, skew_lookup

#: (verdict, host, path) of each rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Characters that the models tell apart; digits are one more, and so are all others, start and end: 33,
#: so an n-gram table has at most 33**4 rows of a few bytes, whatever the number of URLs.
ALPHABET = "abcdefghijklmnopqrstuvwxyz./-"
ORDER = 4


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or a URL without ://."""
    found = lambda i: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(found(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), found(2)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as host and path, and its verdict; null where none fits. Ties go to the rule listed first."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = None
    for said, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def symbols(url: Column) -> Column:
    """The URL in the models' alphabet, between a start and an end mark."""
    low = F.regexp_replace(F.lower(F.regexp_replace(url, r"(?s)^.*?://", "")), "[0-9]", "0")
    return F.concat(F.lit("^"), F.regexp_replace(low, f"[^{ALPHABET.replace('-', '')}0-]", "_"), F.lit("$"))


def grams(urls: DataFrame, keep: list[str]) -> DataFrame:
    """keep and, for each character of _text after the first, the n-grams g1 to g4 that end with it."""
    at = F.posexplode(F.sequence(F.lit(2), F.length("_text"))).alias("_i", "_end")
    place = urls.select(*keep, "_text", at)
    return place.select(*keep, *[F.expr(f"substring(_text, greatest(1, _end - {n - 1}), least(_end, {n}))").alias(f"g{n}") for n in range(1, ORDER + 1)])


def character_models(labelled: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each length n, the n-grams that a class has seen and d, the log-probability of the last character after the
    others in accepted URLs less that in rejected ones; and the contexts seen, with the same difference of their escapes.

    Variable order: a context's estimate is mixed with that of the next shorter one by the number of
    different characters seen after it (Witten and Bell); the shortest mixes with equal chances. An
    n-gram that neither class has seen is scored by its context's escapes and the next shorter n-gram.
    """
    long = grams(labelled, ["_good"]).select("_good", F.explode(F.array([F.struct(F.lit(n).alias("n"), F.col(f"g{n}").alias("g")) for n in range(1, ORDER + 1)])).alias("x"))
    sides = [F.sum(F.when(F.col("_good") == good, 1).otherwise(0)).alias(name) for good, name in ((True, "a"), (False, "b"))]
    seen = long.where(F.length("x.g") == F.col("x.n")).groupBy(F.col("x.n").alias("n"), F.col("x.g").alias("g")).agg(*sides)
    seen = cut(seen.withColumn("h", F.expr("substring(g, 1, n - 1)")))
    context = cut(seen.groupBy("n", "h").agg(F.sum("a").alias("a_all"), F.sum("b").alias("b_all"), F.count_if(F.col("a") > 0).alias("a_kinds"), F.count_if(F.col("b") > 0).alias("b_kinds")))
    size = len(ALPHABET) + 3
    escape = lambda s: F.when(F.col(f"{s}_all") > 0, F.log(F.col(f"{s}_kinds") / (F.col(f"{s}_all") + F.col(f"{s}_kinds")))).otherwise(0.0)
    shorter, models, escapes = None, [], []
    for n in range(1, ORDER + 1):
        own_context = context.where(F.col("n") == n)
        escapes.append(own_context.select(F.col("h").alias(f"h{n}"), (escape("a") - escape("b")).alias(f"e{n}")))
        own = seen.where(F.col("n") == n).join(F.broadcast(own_context), ["n", "h"])
        if shorter is None:
            own = own.withColumns({"_pa": F.lit(1.0 / size), "_pb": F.lit(1.0 / size)})
        else:
            own = own.withColumn("_short", F.expr(f"substring(g, 2, {n - 1})")).join(F.broadcast(shorter.select(F.col("g").alias("_short"), F.col("pa").alias("_pa"), F.col("pb").alias("_pb"))), "_short")
        mix = lambda s: (F.col(s) + F.col(f"{s}_kinds") * F.col(f"_p{s}")) / (F.col(f"{s}_all") + F.col(f"{s}_kinds"))
        p = lambda s: F.when(F.col(f"{s}_all") > 0, mix(s)).otherwise(F.col(f"_p{s}"))
        shorter = cut(own.select("g", p("a").alias("pa"), p("b").alias("pb")))
        models.append(shorter.select(F.col("g").alias(f"g{n}"), (F.log("pa") - F.log("pb")).alias(f"d{n}")))
    return models, escapes


def language_models(labelled: DataFrame) -> list[DataFrame]:
    """The n-gram tables of `character_models`."""
    return character_models(labelled)[0]


def ratios(urls: DataFrame, models: list[DataFrame], key: str, escapes: Sequence[DataFrame] = ()) -> DataFrame:
    """key and ratio: the mean over the URL's characters of the models' difference, by the longest n-gram known and the escapes of longer contexts."""
    rows = grams(urls, [key])
    for n, m in enumerate(models, 1):
        rows = rows.join(F.broadcast(m), f"g{n}", "left")
    for n, e in enumerate(escapes, 1):
        # at a URL's start there is no n-gram so long, and nothing to escape from
        h = F.when(F.length(f"g{n}") == n, F.expr(f"substring(g{n}, 1, {n - 1})"))
        rows = rows.withColumn(f"h{n}", h).join(F.broadcast(e), f"h{n}", "left")
    best = F.lit(0.0)
    for n in range(1, len(models) + 1):
        best = F.coalesce(F.col(f"d{n}"), best + (F.coalesce(F.col(f"e{n}"), F.lit(0.0)) if escapes else F.lit(0.0)))
    return rows.groupBy(key).agg((F.sum(best) / F.count("*")).alias("ratio"))


def calibrated(scored: DataFrame, bins: int = 400, reach: float = 4.0) -> float:
    """The threshold that accepts and rejects labelled URLs (_good, ratio) with the least balanced error, from a histogram."""
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("ratio") + reach) / (2 * reach) * bins)))
    rows = sorted(scored.groupBy(place.alias("b")).agg(F.count_if("_good").alias("a"), F.count_if(~F.col("_good")).alias("r")).collect())
    good, bad = sum(r["a"] for r in rows), sum(r["r"] for r in rows)
    if not good or not bad:
        return 0.0
    lost, kept = 0, bad
    edges = [(lost / good + kept / bad, rows[0]["b"])]
    for r, after in zip(rows, [*rows[1:], None], strict=True):
        lost, kept = lost + r["a"], kept - r["r"]
        # halfway to the next bin that has URLs
        edges.append((lost / good + kept / bad, (r["b"] + 1 + after["b"]) / 2 if after else r["b"] + 1))
    _, edge = min(edges, key=lambda e: (e[0], abs(e[1] - bins / 2)))
    return edge / bins * 2 * reach - reach


def held_out(text: Column, folds: int) -> Column:
    """One in `folds` texts, by an MD5 of the text that the models see."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(folds)) == 0


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, folds: int = 5) -> DataFrame:
    """page_id, host, path, rule, ratio and verdict for each row of pages (page_id, url).

    The longest rule that fits decides. Other URLs are allowed if `ratio`, the length-normalised
    log-likelihood of the URL under a character model of accepted URLs less that of rejected ones,
    reaches a threshold. Both models are of the URLs that rules decide; one in `folds` of these, by
    a hash of what the models see of them, is kept from them and sets the threshold (see
    `calibrated`). ratio is null where a rule decides.

    Equal URLs are scored once. A URL without :// has empty host and path and no rule, and is scored
    as it is. A null or empty URL, or one with nothing after the ://, has ratio 0 and verdict block.
    If rules accept or reject nothing, the models are equal and ratio is 0. A URL of any length is
    scored whole. Rows that repeat get equal results. Other columns are ignored; an empty table gives
    an empty result.
    """
    host, path = parts(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, said = matched(F.col("host"), F.col("path"), rules)
    text = F.nullif(symbols(F.col("url")), F.lit("^$"))
    base = base.withColumns({"rule": rule, "_said": said, "_text": text})
    known = base.where("rule is not null").select("_text", (F.col("_said") == "allow").alias("_good"), held_out(F.col("_text"), folds).alias("_held"))
    known = cut(known.distinct().withColumn("_id", F.monotonically_increasing_id()))
    models, escapes = character_models(known.where(~F.col("_held")))
    held = known.where("_held")
    level = calibrated(held.join(ratios(held, models, "_id", escapes), "_id").select("_good", "ratio"))
    # distinct by text, so that a URL that many pages share is one row here
    open_texts = base.where("rule is null and _text is not null").groupBy("_text").agg(F.count("*").alias("_rows"))
    open_texts = cut(open_texts.withColumn("_key", F.col("_text")))
    scored = cut(open_texts.select("_key", "_rows").join(ratios(open_texts, models, "_key", escapes), "_key"))
    rest = base.withColumn("_key", F.when(F.col("rule").isNull(), F.col("_text")))
    decided = rest.where("_key is null").withColumn("ratio", F.when(F.col("rule").isNull(), F.lit(0.0)))
    judged = skew_lookup(rest.where("_key is not null"), scored, "_key", "_rows")
    verdict = F.coalesce("_said", F.when(F.col("_text").isNotNull() & (F.col("ratio") >= level), "allow").otherwise("block"))
    return decided.unionByName(judged).select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("ratio"))
