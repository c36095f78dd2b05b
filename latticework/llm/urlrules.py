"""URL filtering: listed rules first, then association rules mined from labels.

Listed rules name a host, which stands for its subdomains too, and a path
prefix; the longest that fits decides.  Other urls are judged by mined rules:
FP-growth finds the token combinations that `least` or more urls with a bad
label hold, and how many labelled urls hold them tells their confidence.  Rules
are pruned by support, confidence and lift.  Combinations are found in urls
through an inverted index: each stands under its rarest token, and a url's
tokens look up candidates, whose whole combination is then checked.  Distinct
urls are judged once.

Support is a count, the same at every size of the input, so a host's bad pages
are mined on a large table as on a small one.  Only combinations without a
redundant token are kept: a host's name already stands for its parents'.

Defined cases: a null url and one without `://` have empty host and path, fit no
listed rule and hold no tokens, so they are allowed; of rules equally long the
first listed wins; without labels of both kinds nothing is mined; repeated rows
get equal verdicts; an empty table gives an empty result; columns other than the
named ones are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import checkpoint

#: Mined rules and their tokens are broadcast up to this many index rows; beyond it they are joined.
BROADCAST_RULES = 20_000


def with_parts(df: DataFrame) -> DataFrame:
    """df (url) with host and path.

    Host: what follows the first :// up to / ? # or the end, A-Z lower-cased.
    Path: what follows it up to ? # or the end.  Both are empty without ://.
    """
    marked = F.coalesce(F.instr("url", "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(F.expr("substring(url, instr(url, '://') + 3)"), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = df.withColumn("host", F.when(marked, host).otherwise(F.lit("")))
    path = F.regexp_extract(F.expr("substring(url, instr(url, '://') + 3 + length(host))"), r"^[^?#]*", 0)
    return df.withColumn("path", F.when(marked, path).otherwise(F.lit("")))


def listed(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """rule and verdict of the longest listed rule that fits the columns host and path, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is tested first; of equals the first listed
        host, slash, path = text.partition("/")
        host = host.lower()
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of a url from url, host and path: scheme, host suffixes, path parts, extension, query names, fragment."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    path = F.transform(parts, lambda x: F.concat(F.lit("path="), x))
    ext = F.array(F.concat(F.lit("ext="), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    query = F.transform(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    other = F.array(F.concat(F.lit("scheme="), F.substring_index("url", "://", 1)), F.concat(F.lit("fragment="), F.regexp_extract("url", r"#(.*)$", 1)))
    every = F.array_distinct(F.concat(suffixes, path, ext, query, other))
    return F.when(F.instr("url", "://") > 0, F.filter(every, lambda t: ~t.endswith("="))).otherwise(F.array().cast("array<string>"))


def letters(text: Column) -> Column:
    """The letters and digits of a text: what is left of it in any markup."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def page_content(html: Column) -> Column:
    """The text of a page's article without its headline, tags and character references."""
    body = F.regexp_extract(html, r"(?s)<article[^>]*>(.*?)</article>", 1)
    return F.regexp_replace(body, r"(?s)<h1[^>]*>.*?</h1>|<[^>]*>|&#?\w+;", " ")


def page_labels(pages: DataFrame, docs: DataFrame, bad: DataFrame, page_id: str = "page_id", url_col: str = "url", html_col: str = "html", id_col: str = "doc_id", text_col: str = "text", bad_col: str = "bad") -> DataFrame:
    """page_id, url, bad (0 or 1) of the pages whose content is a labelled document's text: bad if any such document is.

    Pages and documents meet by the digest of their letters and digits, which markup doesn't change.
    """
    label = bad.select(F.col(id_col).alias("i"), F.col(bad_col).cast("int").alias("b")).where("b is not null").groupBy("i").agg(F.max("b").alias("b"))
    texts = docs.select(F.col(id_col).alias("d"), letters(F.col(text_col)).alias("t")).where("t != ''")
    known = texts.select("d", F.md5("t").alias("key")).join(label, F.col("d") == F.col("i")).groupBy("key").agg(F.max("b").alias("bad"))
    shown = pages.select(F.col(page_id).alias("page_id"), F.col(url_col).alias("url"), letters(page_content(F.col(html_col))).alias("t")).where("t != ''")
    return shown.select("page_id", "url", F.md5("t").alias("k")).join(known, F.col("k") == F.col("key")).select("page_id", "url", "bad")


def _fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and rule, a struct, of each row of urls (url, tokens) and each rule (antecedent, ...) whose whole antecedent is among the tokens."""
    # the inverted index: each rule under the token that fewest rules share
    keyed = rules.select(F.struct(*rules.columns).alias("rule"), F.explode("antecedent").alias("token"))
    uses = keyed.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = keyed.join(uses, "token").groupBy("rule").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    index = checkpoint(index)
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    found = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return found.where(F.size(F.array_except("rule.antecedent", "tokens")) == 0).select("url", "rule")


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", least: int = 5, confidence: float = 0.5, lift: float = 1.5) -> DataFrame:
    """antecedent (ascending), confidence, lift, support of token combinations that imply a bad label; support: labelled rows with both, `least` or more."""
    rows = labelled.select(F.col(url_col).alias("url"), F.col(bad_col).cast("int").alias("bad")).where("url is not null and bad is not null")
    rows = with_parts(rows.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b"))).select("url", "n", "b", tokens().alias("tokens"))
    rows = checkpoint(rows.where(F.size("tokens") > 0))
    n, n_bad = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if not 0 < n_bad < n:
        return rows.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, lift double, support long")
    # one basket for each host suffix of a bad url and one for none: a name stands for its parents', so they never meet in a set
    is_host = lambda x: x.startswith("host=")
    bad = rows.where("b > 0").select("b", F.explode(F.concat(F.array(F.lit("")), F.filter("tokens", is_host))).alias("h"), F.filter("tokens", lambda x: ~is_host(x)).alias("rest"))
    head = F.concat(F.lpad(F.length("h").cast("string"), 9, "0"), F.col("h"))
    bad = checkpoint(bad.select("h", F.transform("rest", lambda x: F.concat(head, x)).alias("items"), F.explode(F.sequence(F.lit(1), F.col("b").cast("int")))))
    whole = bad.where(F.size("items") > 0).count()
    sets = bad.where("h != ''").groupBy("h").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least).select(F.array("h").alias("antecedent"), "support")
    if whole:
        found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / whole)).fit(bad.where(F.size("items") > 0).select("items")).freqItemsets
        size = F.substring(F.col("items")[0], 1, 9).cast("int")
        parts = found.where(F.col("freq") >= least).withColumn("n", size).withColumn("h", F.expr("substring(items[0], 10, n)"))
        names = F.expr("transform(items, x -> substring(x, 10 + n))")
        sets = sets.unionByName(parts.select(F.array_sort(F.filter(F.concat(F.array("h"), names), lambda x: x != "")).alias("antecedent"), F.col("freq").alias("support")))
    sets = checkpoint(sets)
    held = _fitting(rows.select("url", "tokens"), sets).join(rows.select(F.col("url").alias("u"), "n"), F.col("url") == F.col("u")).groupBy("rule").agg(F.sum("n").alias("n"))
    sure = F.col("rule.support") / F.col("n")
    rules = held.select("rule.antecedent", sure.alias("confidence"), (sure * (n / n_bad)).alias("lift"), "rule.support")
    return checkpoint(rules.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift)))


def match(urls: DataFrame, mined: DataFrame, url_col: str = "url") -> DataFrame:
    """url, confidence and antecedent of the most confident mined rule (ties: more support, then the antecedent) of each distinct url that one fits."""
    held = with_parts(urls.select(F.col(url_col).alias("url")).where("url is not null").distinct()).select("url", tokens().alias("tokens"))
    rules = mined.select("antecedent", "confidence", "support")
    best = _fitting(held, rules).groupBy("url").agg(F.max_by("rule", F.struct("rule.confidence", "rule.support", "rule.antecedent")).alias("m"))
    return best.select("url", "m.confidence", "m.antecedent")


def judge(pages: DataFrame, mined: DataFrame | None, rules: list[tuple[str, str]], url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns `keep` of each row of pages, with host, path, rule, verdict and the mined antecedent that blocked a url which no listed rule fits."""
    made = ["host", "path", "rule", "verdict", "antecedent"]
    if clash := {c.lower() for c in keep} & set(made):
        raise ValueError(f"kept columns have the names of results: {sorted(clash)}")
    rule, says = listed(rules)
    rows = with_parts(pages.select(F.struct(*keep).alias("kept"), F.col(url_col).alias("url"))).withColumn("rule", rule).withColumn("says", says)
    if mined is None:
        rows = rows.withColumn("antecedent", F.lit(None).cast("array<string>"))
    else:
        hits = match(rows.where("rule is null").select("url"), mined).select(F.col("url").alias("hit"), "antecedent")
        rows = rows.join(hits, (F.col("url") == F.col("hit")) & F.col("rule").isNull(), "left")
    verdict = F.coalesce("says", F.when(F.col("antecedent").isNotNull(), "block").otherwise("allow"))
    return rows.withColumn("verdict", verdict).select("kept.*", *made)
