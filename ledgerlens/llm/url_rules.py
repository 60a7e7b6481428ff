"""URL filters by association rules, with DataFrame and SQL functions alone.

Tokens of a URL: scheme, host labels, path segments and query keys. FP-growth mines the
token combinations of labelled pages together with their class; rules "tokens -> class"
stay if enough pages support them, if the lower bound (Wilson, SURENESS deviations) of their confidence
reaches LEAST_CONFIDENCE and LEAST_LIFT times the share of bad pages, and if no rule with fewer of the same tokens is as sure. An inverted
index from a rule's rarest token to the rule matches URLs: a URL looks up its own
tokens only, and then checks the rest of each rule found. The index is literals in the plan, in
blocks of INDEX_BLOCK rules, so no join or shuffle is needed and no block outgrows a plan.

Written rules (host, path, verdict) go first: one fits its host and all subdomains
where the path starts with the rule's; the longest wins. Without one the mined verdict holds: block if
a mined rule for the bad class matches, allow otherwise.

A page is bad if its label (doc_id = page_id) says toxic 1 or quality 0.

Defined results: a null URL, or one without ://, has empty host and path, no rule and is allowed (unless mined rules match its tokens); pages
without labels are judged alike; a page with several labels is bad if any is; without labels
nothing is mined; where labels don't depend on URLs no rule passes, and every page without a written rule is allowed; written rules
of one length go by their order; very long URLs are taken whole; empty tables give an empty result; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import read

# The rules of the contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

BAD, GOOD = "class=bad", "class=good"
#: A rule needs this share of the labelled pages, and this number, so that small tables don't make every combination frequent.
LEAST_SUPPORT, LEAST_PAGES = 0.002, 20
#: By the lower bound of its confidence (SURENESS deviations), a page with its tokens must be bad so likely, and so many times as
#: likely as any page; and it has few tokens.
LEAST_CONFIDENCE, LEAST_LIFT, SURENESS, MOST_TOKENS = 0.5, 1.5, 2.0, 4
INDEX_BLOCK = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and all that follows the path."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path, F.substring(tail, F.length(path) + 1, F.length(tail))


def url_tokens(url: Column) -> Column:
    """Distinct tokens, each with the part it is from."""
    host, path, query = url_parts(url)
    named = lambda name, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(name), x))
    return F.array_distinct(
        F.concat(
            named("scheme=", F.array(F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
            named("host=", F.split(host, r"\.")),
            named("path=", F.split(path, r"[/.]")),
            named("key=", F.transform(F.split(F.regexp_extract(query, r"^\?([^#]*)", 1), "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))),
        )
    )


def bad_pages(labels: DataFrame) -> DataFrame:
    """(page_id, bad) of labelled pages."""
    return (
        labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
        .groupBy(F.col("doc_id").cast("long").alias("page_id"))
        .agg(F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("bad"))
    )


def mine(pages: DataFrame, labels: DataFrame, least_support: float = LEAST_SUPPORT, least_lift: float = LEAST_LIFT) -> list[tuple[list[str], float, float]]:
    """(tokens, confidence, support) of the rules for the bad class, of up to MOST_TOKENS tokens.

    A rule holds if, by the lower bound of its confidence, a page with its tokens is bad with LEAST_CONFIDENCE, and `least_lift` times as likely as any page. Weak
    rules go before anything comes to the driver; how many can be left is bounded by the least support, whatever the number of pages.
    """
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").join(bad_pages(labels), "page_id")
    items = seen.select(F.concat(url_tokens(F.col("url")), F.array(F.when(F.col("bad") == 1, BAD).otherwise(GOOD))).alias("items"))
    n, n_bad = items.agg(F.count("*"), F.count_if(F.array_contains("items", BAD))).first()
    if not n_bad:
        return []
    least = min(1.0, max(LEAST_CONFIDENCE, least_lift * n_bad / n))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(least_support, LEAST_PAGES / n)), minConfidence=least).fit(items)
    z2, confidence, times = SURENESS * SURENESS, F.col("confidence"), F.col("support") * n / F.col("confidence")  # pages with the tokens
    low = (confidence + z2 / (2 * times) - SURENESS * F.sqrt((confidence * (1 - confidence) + z2 / (4 * times)) / times)) / (1 + z2 / times)
    found = model.associationRules.where((F.element_at("consequent", 1) == BAD) & ~F.exists("antecedent", lambda x: x == GOOD) & (F.size("antecedent") <= MOST_TOKENS) & (low >= least))
    return without_redundant([(list(r.tokens), r.confidence, r.support) for r in found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").collect()])


def without_redundant(rules: list[tuple[list[str], float, float]]) -> list[tuple[list[str], float, float]]:
    """Rules of which no kept one has fewer of the same tokens and is as sure. Looks up kept rules by their tokens."""
    kept: list[tuple[list[str], float, float]] = []
    by_token: dict[str, list[int]] = {}
    for tokens, confidence, support in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own = set(tokens)
        near = {i for t in tokens for i in by_token.get(t, [])}
        if not any(set(kept[i][0]) <= own and kept[i][1] >= confidence for i in near):
            by_token.setdefault(tokens[0], []).append(len(kept))
            kept.append((tokens, confidence, support))
    return kept


def mined_match(tokens: Column, rules: list[tuple[list[str], float, float]]) -> Column:
    """Whether any rule's tokens are all among a URL's."""
    how_many: dict[str, int] = {}
    for rule, _, _ in rules:
        for t in rule:
            how_many[t] = how_many.get(t, 0) + 1

    def ruled_by(table: Column) -> Column:
        found = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull()))
        return F.exists(found, lambda r: F.size(F.array_except(r, tokens)) == 0)

    blocks = []
    for at in range(0, len(rules), INDEX_BLOCK):
        index: dict[str, list[list[str]]] = {}
        for rule, _, _ in rules[at : at + INDEX_BLOCK]:
            index.setdefault(min(rule, key=lambda t: (how_many[t], t)), []).append(rule)
        table = F.create_map(*[x for t, found in index.items() for x in (F.lit(t), F.array(*[F.array(*map(F.lit, r)) for r in found]))])
        blocks.append(ruled_by(table))
    return reduce(lambda a, b: a | b, blocks) if blocks else F.lit(False)


def written_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest written rule that fits, and its verdict."""
    name, verdict = None, None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def judge(pages: DataFrame, mined: list[tuple[list[str], float, float]], rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; one pass, no shuffle."""
    host, path, _ = url_parts(F.col("url"))
    parted = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), url_tokens(F.col("url")).alias("tokens"))
    rule, verdict = written_rule(F.col("host"), F.col("path"), rules)
    own = F.when(mined_match(F.col("tokens"), mined), "block").otherwise("allow")
    return parted.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages, mine(pages, read(spark, sf_dir, "labels")))
