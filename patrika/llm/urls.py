"""URL filters by association rules, in DataFrame operations only.

FP-growth mines combinations of URL tokens together with a verdict from labelled URLs. Rules that reach the wanted
confidence and support stay unless a more general rule is as good, and meet other URLs through an inverted index from
token to rule. A short list of host and path rules, where given, decides first and is the source of labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, salts_of, stored, with_lookup

#: Rules of the contract: (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
VERDICTS = ("block", "allow")
#: Tokens of a rule at most. A URL of more frequent tokens than WHOLE is shown to FP-growth in pieces of LONGEST groups of
#: tokens, so that any LONGEST of its tokens are in some piece.
LONGEST, WHOLE, SALTS = 4, 12, 32


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z in lower case; '' for null or without '://'."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; '' for null or without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits (by text, among equally long ones), else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens that describe a URL, sorted: every label of its host by its place from the right, every segment of
    its path that is no number, the file's extension, the name of every query parameter, and a leading www."""
    labels = F.reverse(F.split(host, r"\."))
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"^\d+(\.\w+)?$"))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    parts = F.concat(
        F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x)),
        F.transform(segments, lambda s: F.concat(F.lit("path="), s)),
        F.transform(names, lambda n: F.concat(F.lit("query="), n)),
        F.array(F.when(extension != "", F.concat(F.lit("file="), extension)), F.when(host.startswith("www."), F.lit("www"))),
    )
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & ~x.endswith("="))))


def _baskets(rows: DataFrame, min_support: float, longest: int) -> DataFrame:
    """tokens, basket for the distinct `tokens` of (tokens, verdict, n): those of them that reach the support, whole up to
    WHOLE of them, else a row for each choice of `longest` of their groups."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    each = rows.select(F.explode("tokens").alias("_token"), "n").groupBy("_token").agg(F.sum("n").alias("_n"))
    frequent = stored(each.filter(F.col("_n") >= min_support * total).select("_token"), "url-tokens")
    held = with_lookup(rows.select("tokens").distinct().select("tokens", F.explode("tokens").alias("_token")), frequent, "_token", ["tokens"])
    held = stored(held.groupBy("tokens").agg(F.array_sort(F.collect_list("_token")).alias("basket")), "url-baskets")
    size = max(1, WHOLE // longest)
    parts = held.filter(F.size("basket") > WHOLE).withColumn("_groups", F.ceil(F.size("basket") / size).cast("int"))
    for i in range(longest):
        first = F.col(f"_g{i - 1}") + 1 if i else F.lit(0)
        parts = parts.withColumn(f"_g{i}", F.explode(F.sequence(first, F.col("_groups") - (longest - i))))
    chosen = F.filter("basket", lambda x, at: F.floor(at / size).cast("int").isin(*[F.col(f"_g{i}") for i in range(longest)]))
    return held.filter(F.size("basket") <= WHOLE).unionByName(parts.select("tokens", chosen.alias("basket")))


def mine(labelled: DataFrame, min_support: float = 0.001, min_confidence: float = 0.8, longest: int = LONGEST) -> DataFrame:
    """Rules from (tokens, verdict, _salt): tokens (sorted), verdict, confidence, support.

    FP-growth finds the combinations of up to `longest` tokens that occur often enough with a verdict; how often they
    hold is then counted over the whole URLs. No token of a URL is left out, however many it has: with very many, it is
    shown in overlapping pieces, which can only bring more combinations to be counted. A rule goes if leaving out one of
    its tokens gives a rule for the same verdict with at least its confidence. Rows with a null verdict or no tokens teach
    nothing; without rows there are no rules.
    """
    rows = stored(labelled.filter(F.col("verdict").isin(*VERDICTS) & (F.size("tokens") > 0)), "url-labelled")
    seen = stored(rows.groupBy("tokens", "verdict").agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_held")), "url-seen")
    held = seen.groupBy("tokens").agg(F.bit_or("_held").alias("_held"))
    baskets = _baskets(seen, min_support, longest).join(held, "tokens").select("tokens", "basket", salts_of("_held", SALTS).alias("_salt"))
    items = stored(rows.join(baskets, ["tokens", "_salt"]).select(F.concat("basket", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items")), "url-items")
    total, shown = seen.agg(F.sum("n")).first()[0] or 0, items.count()
    # as many occurrences among all pieces as the support asks for among URLs
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (min_support * total - 1e-6) / max(1, shown))).fit(items)
    said = F.filter("items", lambda x: x.startswith("verdict="))
    found = model.freqItemsets.filter(F.size("items").between(2, longest + 1)).withColumn("_said", said).filter(F.size("_said") == 1)
    found = stored(found.select(F.array_sort(F.array_except("items", "_said")).alias("tokens"), F.expr("substr(_said[0], 9)").alias("verdict")), "url-found")
    met = contained(seen.groupBy("tokens").agg(F.sum("n").alias("_all"), *[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in VERDICTS]), found.select("tokens").distinct())
    sums = met.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("_all", *VERDICTS)])
    counted = found.join(sums.withColumnRenamed("rule", "tokens"), "tokens")
    right = F.when(F.col("verdict") == VERDICTS[0], F.col(VERDICTS[0])).otherwise(F.col(VERDICTS[1]))
    rules = counted.select("tokens", "verdict", (right / F.col("_all")).alias("confidence"), (right / F.lit(float(max(1, total)))).alias("support"))
    rules = stored(rules.filter((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)), "url-rules")
    shorter = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("_out")).withColumn("_general", F.array_remove("tokens", F.col("_out")))
    general = rules.select(F.col("tokens").alias("_general"), "verdict", F.col("confidence").alias("_c"))
    covered = shorter.join(general, ["_general", "verdict"]).filter(F.col("_c") >= F.col("confidence")).select("tokens", "verdict").distinct()
    return rules.join(covered, ["tokens", "verdict"], "left_anti")


def contained(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """profiles with `rule`, a row for each of `rules` (distinct `tokens`) whose tokens a profile's `tokens` all hold, by an
    inverted index: a rule stands under that of its tokens that the fewest profiles have, so common tokens bring few. Null
    or empty `tokens` hold no rule, and rules of none are held by nothing."""
    probes = profiles.select("tokens", F.explode("tokens").alias("_token"))
    often = probes.groupBy("_token").agg(F.count("*").alias("_often"))
    each = rules.select(F.col("tokens").alias("rule"), F.explode("tokens").alias("_token")).join(often, "_token", "left")
    index = each.groupBy("rule").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), F.col("_token").alias("t"))).alias("_rarest")).select("rule", F.col("_rarest.t").alias("_token"))
    met = with_lookup(profiles.withColumn("_token", F.explode("tokens")), index, "_token", ["tokens"]).drop("_token")
    return met.filter(F.size(F.array_except("rule", "tokens")) == 0)


def match(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """For distinct `tokens`, the best rule that they contain: tokens, rule_tokens, verdict, confidence.

    Best is the highest confidence, then support, then more tokens, then block before allow, then by text. Null or empty
    `tokens` have no best rule.
    """
    met = contained(profiles.select("tokens"), rules.select("tokens").distinct()).withColumnRenamed("rule", "_rule")
    named = rules.select(F.col("tokens").alias("_rule"), "verdict", "confidence", "support")
    rank = F.struct("confidence", "support", F.size("_rule").alias("_size"), (F.col("verdict") == "block").alias("_block"), "_rule", "verdict")
    best = with_lookup(met, named, "_rule", ["tokens"]).groupBy("tokens").agg(F.max(rank).alias("_best"))
    return best.select("tokens", F.col("_best._rule").alias("rule_tokens"), F.col("_best.verdict").alias("verdict"), F.col("_best.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, min_support: float = 0.001, min_confidence: float = 0.8) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, and rule_tokens of the mined rule that decided, else null.

    `rules` decide first. Labels teach the rest: (page_id, verdict) rows if given, else the verdicts of `rules` on the
    pages they fit. A URL that no mined rule matches is allowed. Null urls have an empty host and path and no tokens;
    repeated rows and equal ids are judged alike, each by its url; an empty table gives an empty result. Very long urls have
    all their tokens. Columns other than page_id and url are not looked at. Verdicts of labels other than block and allow teach nothing.
    """
    url = F.col("url").cast("string")
    parts = pages.select("page_id", url.alias("url")).withColumns({"host": host_of(url), "path": path_of(url)})
    fixed = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else F.create_map().cast("map<string,string>")
    rows = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("_fixed", F.try_element_at(fixed, F.col("rule"))).withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    # rows of a very common set of tokens are dealt to as many as SALTS tasks
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int").alias("_salt")
    rows = stored(rows.select("page_id", "host", "path", "rule", "_fixed", "tokens", salt), "url-rows")
    if labels is None:
        taught = rows.select("tokens", F.col("_fixed").alias("verdict"), "_salt")
    else:
        taught = rows.join(labels.select("page_id", "verdict"), "page_id").select("tokens", "verdict", "_salt")
    mined = stored(mine(taught, min_support, min_confidence), "url-mined")
    open_ = stored(rows.filter(F.col("_fixed").isNull()).groupBy("tokens").agg(F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_held")), "url-profiles")
    found = match(open_, mined).join(open_, "tokens").select("tokens", "rule_tokens", F.col("verdict").alias("_mined"), salts_of("_held", SALTS).alias("_salt"))
    out = rows.join(found, ["tokens", "_salt"], "left")
    decided = F.coalesce("_fixed", "_mined", F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", decided.alias("verdict"), F.when(F.col("_fixed").isNull(), F.col("rule_tokens")).alias("rule_tokens"))


def digest(pages: DataFrame) -> DataFrame:
    """The contract's row per page: nulls, ties and repeated rows as in judge()."""
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
