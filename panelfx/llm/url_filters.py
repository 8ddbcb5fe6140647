"""URL filters with redirect equivalence, as DataFrame operations only.

Rules name a host and a path prefix and fit that host and all its subdomains; the longest decides. URLs
that redirect or canonical links tie together form components, found by distributed connected
components. A block that a rule gives to any URL of a component is propagated to all aliases in it,
except those that a rule explicitly allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules given as a list are broadcast; there may be at most this many.
MOST_LISTED_RULES = 100_000
REL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*([^"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a table to broadcast; the list's length is checked."""
    if len(rules) > MOST_LISTED_RULES:
        raise ValueError("give so many rules as a DataFrame")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("action", "rule_host", "rule_path")])
    return F.broadcast(spark.createDataFrame(rules, schema))


def own_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each of the distinct ``urls(url, host, path)``: ``(url, rule, action)``.

    Of equally long rules the longer host wins, then allow over block. A host's suffixes are joined
    to the rules by equality, so the work is the labels of a host, not the number of rules.
    """
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = urls.where("host <> ''").select("url", "path", F.explode(suffix).alias("suffix"))
    fits = tried.join(rules, tried.suffix == rules.rule_host).where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule), F.length("rule_host"), (F.col("action") == ALLOW).cast("int"))
    return fits.groupBy("url").agg(F.max_by(F.struct(rule.alias("rule"), "action"), rank).alias("r")).select("url", "r.rule", "r.action")


def resolve(link: Column, url: Column) -> Column:
    """A link's target: absolute, relative to the scheme, to the host or to the folder; without its fragment."""
    scheme, base = F.regexp_extract(url, r"(?s)\A(.*?:)//", 1), F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    full = F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(base, link)).otherwise(F.concat(folder, link))
    return without_fragment(full)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*\z", "")


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``(u, v)`` from canonical links and meta-refresh redirects in the pages' markup."""
    url, html = F.col(url_col), F.col(html_col)
    has = html.rlike(r"(?i)canonical|http-equiv") & url.contains("://")
    links = F.filter(F.array(F.regexp_extract(html, REL, 1), F.regexp_extract(html, REFRESH, 1)), lambda x: x != "")
    found = pages.where(has).select(url.alias("url"), F.explode(links).alias("link"))
    return found.select(without_fragment(F.col("url")).alias("u"), resolve(F.trim("link"), F.col("url")).alias("v")).where("u <> v").distinct()


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, host, path, rule, verdict, via)`` for every row of ``pages``.

    ``edges(u, v)`` are further redirects. A null url, or one without ``://``, has empty host and path,
    fits no rule and is allowed. Without a rule a URL is allowed, unless its component holds a blocked
    one; ``via`` is then ``alias``, else ``rule`` or null. Repeated rows are judged alike. Fragments
    don't tell URLs apart as nodes. Null edge ends are ignored; extra columns are dropped.
    """
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"))
    ties = page_edges(pages, url_col, html_col)
    if edges is not None:
        ties = ties.union(edges.select(without_fragment(F.col("u")), without_fragment(F.col("v"))))
    roots = connected_components(ties)

    def parts(df: DataFrame) -> DataFrame:
        return df.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    nodes = parts(roots.select(F.col("node").alias("url")))
    blocked = own_rules(nodes, rules).where(F.col("action") == BLOCK).select("url")
    bad = roots.join(blocked, roots.node == blocked.url, "left_semi").select("root").distinct()
    reached = roots.join(bad, "root").select(F.col("node").alias("_node"), F.lit(True).alias("_reached"))
    own = own_rules(parts(base.where("url IS NOT NULL").select("url").distinct()), rules)
    judged = base.select("_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), without_fragment(F.col("url")).alias("_key"))
    judged = judged.join(own.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left").join(reached, F.col("_key") == F.col("_node"), "left")
    verdict = F.coalesce("action", F.when(F.col("_reached"), BLOCK), F.lit(ALLOW))
    via = F.when(F.col("action").isNotNull(), "rule").when(F.col("_reached"), "alias")
    return judged.select(F.col("_id").alias(id_col), F.col("url").alias(url_col), "host", "path", "rule", verdict.alias("verdict"), via.alias("via"))
