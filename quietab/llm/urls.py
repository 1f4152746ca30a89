"""URL filter: host and path rules, then association rules mined by FP-growth.

Every url is a set of tokens: host, last two host labels, first and last label,
path segments (digits as #) and query keys.  Labelled pages (bad: quality 0 or toxic 1) are the
transactions, with one more item for a bad label.  Spark's FP-growth mines the
frequent combinations; rules ``tokens -> bad`` with at least ``min_support`` of the labelled
pages (and ``min_count``) and ``min_confidence``, of any number of tokens,
block the urls that hold all their tokens; a rule that holds all tokens of a
shorter one is implied by it and left out, before mining where that can be told (``mine``).  Rules are matched by inverted index:
each rule is filed under its rarest token, a url looks up its own tokens and checks the
few rules it finds.  Given rules (host and its subdomains, path prefix, the
longest wins) come first; a url that nothing blocks is allowed.

Plan: FP-growth and the index join run on distinct tokens sets; all sides are
DataFrames, the index is broadcast by Spark only if it is small.  Verdicts of
mined rules depend on the url alone, so urls are matched once each and hot urls
are combined map-side.

Defined cases: a null url, or one without ``://``, has empty host and path and
no token of theirs (allowed); an empty or unlabelled table mines no rule; labels of
a repeated id count once, as bad if any is; a rule tie (equal length) goes to
the earlier rule; repeated rows are each judged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietab.llm.common import narrow, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "=bad"

# Fixed values: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class UrlConfig:
    min_support: float = 0.002
    min_count: int = 20
    min_confidence: float = 0.8


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    of_host = F.when(host == "", F.array().cast("array<string>")).otherwise(F.array(
        F.concat(F.lit("host:"), host),
        F.concat(F.lit("site:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")),
        F.concat(F.lit("first:"), labels[0]), F.concat(F.lit("last:"), F.element_at(labels, -1))))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""),
                           lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                       lambda x: F.concat(F.lit("query:"), F.split(x, "=")[0]))
    return F.array_sort(F.array_distinct(F.concat(of_host, segments, keys)))


def given_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def mine(pages: DataFrame, labels: DataFrame, cfg: UrlConfig = UrlConfig()) -> tuple[DataFrame, DataFrame] | None:
    """Rules (items, confidence, support) whose consequent is a bad label, and the classes (token, item) of the
    tokens that stand for one another; None if no rule can be supported.

    A shorter rule makes all rules with its tokens needless, and so does a token that never tells the pages that hold the
    others apart.  So rules of one token are counted first and their tokens leave the transactions, as do
    tokens that all pages hold; tokens of exactly the same pages become one item.  FP-growth mines the rest, which a long url
    of a spam template does not reach."""
    bad = (narrow(labels, "doc_id", "quality", "toxic")
           .filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id")
           .agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad")))
    seen = (narrow(pages, "page_id", "url").filter("url is not null")
            .join(bad.withColumnRenamed("doc_id", "page_id"), "page_id")
            .select(tokens_of(F.col("url")).alias("tokens"), "bad"))
    seen = written(seen, "url-pages").withColumn("tx", F.monotonically_increasing_id())  # numbered as written
    n = seen.count()
    least = max(cfg.min_count, -(-cfg.min_support * n // 1))
    if least > n:
        return None
    flat = written(seen.select("tx", "bad", F.explode("tokens").alias("token")), "url-tokens")
    mark = F.xxhash64("tx", F.lit(3))
    counts = written(flat.groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"), F.bit_xor(mark).alias("xor"),
        F.sum(mark.cast("decimal(38,0)")).alias("sum")), "url-counts")
    supported = counts.filter((F.col("bad") >= least))
    single = supported.filter(F.col("bad") / F.col("n") >= cfg.min_confidence)
    rules = single.select(F.array("token").alias("items"), (F.col("bad") / F.col("n")).alias("confidence"),
                          (F.col("bad") / F.lit(float(n))).alias("support"))
    open_tokens = supported.filter((F.col("bad") / F.col("n") < cfg.min_confidence) & (F.col("n") < n))
    alike = classes(flat, open_tokens)
    pages_left = (flat.join(alike, "token").groupBy("tx", "bad").agg(F.array_sort(F.collect_set("item")).alias("items"))
                  .select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")))
    pages_left = written(pages_left, "url-transactions")
    m = pages_left.count()
    if m >= least:
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / m, minConfidence=cfg.min_confidence).fit(pages_left)
        more = written(model.associationRules.filter(F.array_contains("consequent", BAD))
                       .select(F.array_sort("antecedent").alias("items"), "confidence", (F.col("support") * m / n).alias("support")),
                       "url-rules-all")
        rules = rules.unionByName(shortest(more))
    return rules, alike


def classes(flat: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, item): tokens that stand in exactly the same transactions share an item, one of them.  Equal
    counts and hash sums propose a class; it is one if every transaction of it holds all its tokens."""
    first = F.min("token").over(Window.partitionBy("n", "bad", "xor", "sum"))
    proposed = written(tokens.select("token", first.alias("item")), "url-classes")
    size = proposed.groupBy("item").agg(F.count("*").alias("size"))
    wrong = (flat.join(proposed, "token").groupBy("item", "tx").agg(F.count("*").alias("held")).join(size, "item")
             .filter("held <> size").select("item").distinct().withColumn("wrong", F.lit(True)))
    return written(proposed.join(wrong, "item", "left")
                   .select("token", F.when(F.col("wrong"), F.col("token")).otherwise(F.col("item")).alias("item")), "url-items")


def shortest(rules: DataFrame) -> DataFrame:
    """The rules that hold all tokens of no shorter rule: the others block no more urls."""
    sizes = sorted(r[0] for r in rules.select(F.size("items")).distinct().collect())
    kept = rules.limit(0)
    for size in sizes:
        now = rules.filter(F.size("items") == size)
        if size > sizes[0]:
            implied = holders(now.select(F.col("items").alias("tokens")), kept, "tokens")
            now = now.join(implied.withColumnRenamed("tokens", "items"), "items", "left_anti")
        kept = written(kept.union(now), "url-rules-kept")
    return kept


def holders(sets: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """Distinct ``name`` of the rows whose ``tokens`` hold all tokens of some rule, by the rules' inverted index."""
    rows = sets.withColumn("token", F.explode("tokens"))
    often = rows.groupBy("token").count()
    filed = (rules.select("items", F.explode("items").alias("token")).join(often, "token", "left")
             .groupBy("items").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token")).alias("rarest"))
             .select("items", F.col("rarest.token").alias("token")))
    return (rows.join(filed, "token").filter(F.size(F.array_except("items", "tokens")) == 0)
            .select(name).distinct())


def blocked_urls(urls: DataFrame, rules: DataFrame, alike: DataFrame) -> DataFrame:
    """Distinct urls that hold for every item of some rule one of its tokens."""
    tokens = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    sets = (tokens.join(alike, "token", "left").groupBy("url")
            .agg(F.collect_set(F.coalesce("item", "token")).alias("tokens")))
    return holders(sets, rules, "url")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, cfg: UrlConfig = UrlConfig()) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rows = narrow(pages, "page_id", "url")
    found = mine(pages, labels, cfg)
    mined = written(found[0], "url-rules") if found else None
    if mined is not None and mined.limit(1).count():
        hit = blocked_urls(rows.filter("url is not null").select("url").distinct(), mined, found[1])
        rows = rows.join(hit.withColumn("hit", F.lit(True)), "url", "left")
    else:
        rows = rows.withColumn("hit", F.lit(None).cast("boolean"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = given_rule(host, path, rules)
    own = F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"),
                       F.coalesce(verdict, own).alias("verdict"))


def op8_url_filter(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


#: The rules of one and two tokens by counting every token and token pair of the labelled pages.
OP8_SQL = r"""
with parts as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
    coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '') as query
  from pages),
tok as (
  select page_id, url, host, path, list_distinct(list_concat(list_concat(
    case when host = '' then []::varchar[] else [
      'host:' || host,
      'site:' || regexp_extract(host, '([^.]*\.)?[^.]*$', 0),
      'first:' || string_split(host, '.')[1], 'last:' || string_split(host, '.')[-1]] end,
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '[0-9]+', '#', 'g'))),
    list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'query:' || string_split(x, '=')[1]))) as tokens
  from parts),
lab as (
  select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels
  where doc_id is not null and (quality is not null or toxic is not null) group by doc_id),
seen as (
  select row_number() over () as tx, bad, tokens from tok join lab on page_id = doc_id where url is not null),
n as (select count(*) as n, greatest(20, ceil(0.002 * count(*))) as least from seen),
flat as (select tx, bad, unnest(tokens) as t from seen),
ants as (
  select t as a, t as b, count(*) as c, sum(bad) as cb from flat group by t
  union all
  select x.t, y.t, count(*), sum(x.bad) from flat x join flat y on x.tx = y.tx and x.t < y.t group by x.t, y.t),
rules as (select a, b from ants, n where cb >= least and cb / c >= 0.8),
hit as (select distinct url from tok, rules where list_contains(tokens, a) and list_contains(tokens, b)),
base(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit as (
  select tok.*, verdict, h || p as rule, row_number() over (partition by page_id, url order by length(h || p) desc) as k
  from tok left join base on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule,
  coalesce(verdict, case when url in (select url from hit) then 'block' else 'allow' end) as verdict
from fit where k = 1
"""
