"""Verdicts on URLs by pattern rules, each indexed by its rarest literal token.

A rule is a host, a path pattern and a verdict; it fits its host and all subdomains if the URL's path
starts with its path, in which ``*`` stands for any characters. As a regular expression a rule is dear
to try, and lists have millions of them. So each rule is found by one token only: of the whole
tokens that any URL it fits must have, the one that the fewest URLs have, counted over all
URLs. A URL's own tokens fetch its candidates, and only those run their expressions. A rule without a
whole token is a candidate for every URL. The longest fitting rule decides.

An index within a stated size goes to every task and URLs are judged where they lie, without a
shuffle. A larger one stays a table: URLs meet it by token, in parts, as one token can be in most URLs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, pick, store, table

#: Host, path and verdict of the rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: What a URL is that no rule fits.
DEFAULT = "allow"
#: An index of at most so many rules and characters is sent to every task.
HELD_RULES, HELD_CHARS = 100_000, 8_000_000
#: Parts of the URLs of one token, where the index stays a table.
PARTS = 16

_SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Separators without the star.
_PLAIN = r"\x00-\x29\x2B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TOKEN = f"[^{_SEPARATORS}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def compiled(rules: DataFrame) -> DataFrame:
    """``rule, host, path, verdict, regex, tokens`` of distinct ``rules (host, path, verdict)``; ``tokens`` are those
    that a URL must have whole. The expression, in the syntax that Java and Python share, is for host and path
    in one and begins at their start.

    A null host or path is empty; an empty host is any host. A path is empty or begins with ``/`` or ``*``, a
    verdict is ``allow`` or ``block``, else an error is raised."""
    x = pick(rules, "host", "path", "verdict").select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    bad = ~F.coalesce(F.col("verdict").isin("allow", "block"), F.lit(False)) | ~F.col("path").rlike(r"^(?![^/*])")
    x = x.withColumn("verdict", F.when(bad, F.raise_error(F.concat(F.lit("not a rule: "), F.col("host"), F.col("path"), F.lit(" "), F.coalesce("verdict", F.lit("null"))))).otherwise(F.col("verdict")))
    literal = lambda c: F.regexp_replace(c, f"([{_SEPARATORS}])", r"\\$1")
    host = F.when(F.col("host") == "", F.lit("[^/]*")).otherwise(F.concat(F.lit(r"(?:[^/]*\.)?"), literal(F.col("host"))))
    path = F.concat(F.lit("(?![^/])"), F.replace(literal(F.col("path")), F.lit(r"\*"), F.lit(".*")))
    # The host's end is the end of a token; the end of a path is not.
    text = F.concat("host", F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path")))
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?<=^|[{_PLAIN}]){TOKEN}(?=[{_PLAIN}])"), F.lit(0)))
    return x.select(F.concat("host", "path").alias("rule"), "host", "path", "verdict", F.concat(F.lit("(?s)^"), host, path).alias("regex"), tokens.alias("tokens"))


def _tokens(host: Column, path: Column) -> Column:
    """A URL's distinct tokens."""
    return F.array_distinct(F.regexp_extract_all(F.concat(host, path), F.lit(TOKEN), F.lit(0)))


def indexed(rules: DataFrame, urls: DataFrame, few: bool) -> DataFrame:
    """``compiled`` rules, each with its one ``token``: the rarest in ``urls (host, path)``, of equally rare
    ones the first; empty if it has none."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    if few:  # else most tokens, such as ids in paths, are counted for nothing
        seen = seen.join(F.broadcast(wanted), "token", "left_semi")
    counts = wanted.join(seen.groupBy("token").agg(F.count(F.lit(1)).alias("times")), "token", "left")
    key = ["host", "path", "verdict"]
    by_rule = rules.select(*key, F.explode("tokens").alias("token")).join(counts, "token")
    rarest = by_rule.groupBy(*key).agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "token")).alias("r"))
    out = rules.join(rarest, key, "left")
    return out.select("rule", "verdict", "regex", F.length("host").alias("host_chars"), F.length("rule").alias("chars"), F.coalesce("r.token", F.lit("")).alias("token"))


def _judge(rules: list, default: str):
    """Judges batches whose first two columns are host and path by an index that a task holds."""
    rules = sorted(rules, key=lambda r: (r["chars"], r["host_chars"], r["verdict"] == "block", r["rule"]), reverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            index.setdefault(r["token"], []).append(i)
        everywhere, fits, token = index.pop("", []), {}, re.compile(TOKEN)
        for batch in batches:
            rule, verdict, tried = [], [], []
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                url = host + path
                found = [i for t in {*token.findall(url)} & index.keys() for i in index[t]] + everywhere
                best = None
                for i in sorted(found):  # the longest first
                    if i not in fits:
                        fits[i] = re.compile(rules[i]["regex"]).match
                    if fits[i](url):
                        best = i
                        break
                rule.append(None if best is None else rules[best]["rule"])
                verdict.append(default if best is None else rules[best]["verdict"])
                tried.append(len(found))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string()), "n_candidates": pa.array(tried, pa.int32())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, held_rules: int = HELD_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_candidates`` for every row of ``pages (page_id, url)``: the longest
    rule (host and path in one) that fits, its verdict, and how many rules were tried. Of equally long rules
    that with the longer host decides, then ``block``, then the last by name.

    A null URL, or one without ``://``, has an empty host and path; only rules for any host can fit it. What no rule
    fits has a null rule and the verdict ``default``. Hosts are taken as they stand, ports and users included.
    Repeated rows and null page_ids are kept, repeated rules count once; an empty table stays empty. Further columns are not read."""
    urls = pick(pages, "page_id", "url").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("page_id").cast("long").alias("page_id"))
    known = compiled(rules)
    n, chars = known.agg(F.count(F.lit(1)), F.sum(F.length("regex"))).first()
    few = n <= held_rules and (chars or 0) <= HELD_CHARS
    index = indexed(known, urls, few)
    if few:
        out = arrow_map(urls, _judge(index.collect(), default), "host string, path string, page_id long, rule string, verdict string, n_candidates int")
        return out.select("page_id", "host", "path", "rule", "verdict", "n_candidates")
    index = store(index, "rules")
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    part = lambda *c: F.pmod(F.xxhash64(*c), F.lit(PARTS)).cast("int")
    distinct = urls.select("host", "path").distinct()
    fetched = distinct.withColumn("token", F.explode(F.concat(_tokens(F.col("host"), F.col("path")), F.array(F.lit("")))))
    fetched = fetched.withColumn("part", part("host", "path")).join(index.withColumn("part", parts), ["token", "part"])
    fits = F.expr("concat(host, path) rlike regex")
    order = F.when(fits, F.struct("chars", "host_chars", (F.col("verdict") == "block").alias("block"), "rule", "verdict"))
    best = store(fetched.groupBy("host", "path").agg(F.max(order).alias("b"), F.count(F.lit(1)).cast("int").alias("n_candidates")).select("host", "path", "b.rule", "b.verdict", "n_candidates"), "fitting")
    # A URL can be that of most pages: each is judged for every part of them.
    out = urls.withColumn("part", part("page_id")).join(best.withColumn("part", parts), ["host", "path", "part"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), j AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
