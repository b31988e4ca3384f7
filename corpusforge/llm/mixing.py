"""Sources mixed to target weights by iterative proportional fitting.

Token counts by (source, language, topic) are raked until the three marginals of
the weights meet their targets to a tolerance; a document is then kept with the probability that
its cell's weight asks for. Targets can be given for any dimension; for the others they are
tempered shares of the tokens: to the power 0.8
for sources and languages, so a source that holds a third of the corpus weighs less
and rare ones weigh more, and as they are for topics. The
probabilities are scaled so that the largest is 1: the mix is met without
repeating a document. The table of cells is small beside the corpus; raking is DataFrame
windows over one class of a dimension at a time, and only sums and the residual reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import pick, store, table

#: Raking stops when no marginal is further than this from its target (all add up to 1), or after so many rounds.
TOLERANCE, MOST_ROUNDS = 1e-13, 32
#: The same for given targets, and how far they may be missed at the end; beyond, no weights meet them all.
GIVEN_TOLERANCE, GIVEN_ROUNDS, FEASIBLE = 1e-9, 400, 1e-6
#: Raking to given targets ends where a plan's rounds leave more than this share of the residual.
_STALLED = 0.98
DIMENSIONS = ("source", "lang", "topic")
#: Exponent of the token shares that makes each dimension's targets.
TEMPER = {"source": 0.8, "lang": 0.8, "topic": 1.0}
#: Rounds in one plan; then the weights are stored.
_AT_ONCE = 4
#: So many cells are broadcast, and raked in one partition, at most; beyond, joins and windows shuffle.
BROADCAST_CELLS = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def layout(text: Column) -> Column:
    """The topic where none is given: table cells, decorated words, shouting, or prose."""
    return F.when(text.contains(" | "), "table").when(text.rlike(r"[*#&$%]{3}"), "decorated").when(text.contains("!! "), "shouting").otherwise("prose")


def _classed(docs: DataFrame, topic=layout) -> DataFrame:
    """``docs`` with the columns ``_source, _lang, _topic, _tokens, _draw``."""
    text, key = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit("mix"), key, text).cast("binary"))
    return docs.withColumns(
        {
            "_source": F.coalesce("source", F.lit("(none)")),
            "_lang": F.coalesce("lang", F.lit("(none)")),
            "_topic": F.coalesce(topic(text), F.lit("(none)")),
            "_tokens": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "_draw": F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48),
        }
    )


def _targets(x: DataFrame, d: str, given: dict[str, float] | None, temper: float, few: bool) -> DataFrame:
    """``d, t_d``: the targets of the classes of one dimension, which add up to 1; a ``few`` have one window."""
    shares = x.groupBy(d).agg(F.sum("weight").alias("m"))
    if given is None:
        shares = shares.select(d, F.pow("m", F.lit(temper)).alias("m"))
        if few:
            return shares.select(d, (F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1)))).alias(f"t_{d}"))
        shares = store(shares, "shares", slim=True)
        return shares.select(d, (F.col("m") / F.lit(shares.agg(F.sum("m")).first()[0])).alias(f"t_{d}"))
    if abs(sum(given.values()) - 1) > FEASIBLE or min(given.values()) < 0:
        raise ValueError(f"targets of {d} must be shares that add up to 1")
    wanted = x.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{d} string, t_{d} double")
    lost = wanted.where(f"t_{d} > 0").join(shares.where("m > 0"), d, "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"no tokens for targets of {d}: {[r[0] for r in lost]}")
    return shares.join(wanted, d, "left").select(d, F.coalesce(f"t_{d}", F.lit(0.0)).alias(f"t_{d}"))


def rake(cells: DataFrame, rounds: int = MOST_ROUNDS, temper: dict[str, float] = TEMPER, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``raked`` without the residual."""
    return raked(cells, rounds, temper, targets)[0]


def raked(cells: DataFrame, rounds: int = MOST_ROUNDS, temper: dict[str, float] = TEMPER, targets: dict[str, dict[str, float]] | None = None) -> tuple[DataFrame, float]:
    """``cells (source, lang, topic, tokens)`` with ``weight`` and ``prob``, and the residual: how far the worst
    marginal was from its target before the last round.

    Weights are shares whose marginals are the ``targets`` (class → share, for any of the dimensions;
    classes they don't name get none), else the tempered shares of the tokens. A cell without tokens
    has weight 0. Raking ends at ``TOLERANCE`` or after ``rounds``. Given targets that nothing can meet
    raise an error; tempered shares that contradict one another (where sources fix languages) are met as
    nearly as the last round does, and the residual says by how much they aren't."""
    cells = store(cells, "cells", slim=True)
    total, count = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    few = count <= BROADCAST_CELLS
    start = x = cells.withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    for d in DIMENSIONS:
        t = _targets(start, d, (targets or {}).get(d), temper[d], few)
        x = x.join(F.broadcast(t) if few else t, d)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    done, residual, before, most = 0, 1.0, float("inf"), None
    tolerance, rounds = (GIVEN_TOLERANCE, max(rounds, GIVEN_ROUNDS)) if targets else (TOLERANCE, rounds)
    while done < rounds and residual > tolerance and not (targets and residual > _STALLED * before):
        if few:  # a counted, bounded table: windows over one partition need no shuffle
            x = x.coalesce(1)
        for _ in range(min(_AT_ONCE, rounds - done)):
            for d in DIMENSIONS:
                x = x.withColumn("m", F.sum("weight").over(Window.partitionBy(d)))
                x = x.withColumns({"weight": F.when(F.col("m") > 0, F.col("weight") * F.col(f"t_{d}") / F.col("m")).otherwise(F.lit(0.0)), f"off_{d}": F.abs(F.col("m") - F.col(f"t_{d}"))})
            done += 1
        off = F.greatest(*[f"off_{d}" for d in DIMENSIONS])
        x = store(x.withColumn("off", off).drop("m", *[f"off_{d}" for d in DIMENSIONS]), "raked", slim=True)
        before = residual if done > _AT_ONCE else before
        residual, most = x.agg(F.max("off"), F.max(ratio)).first()
        residual, x = residual or 0.0, x.drop("off")
    if targets and residual > FEASIBLE:
        raise ValueError(f"no weights meet these targets: after {done} rounds a marginal is still off by {residual:.2g}")
    prob = F.coalesce(ratio / F.lit(most), F.lit(1.0)) if most else F.lit(1.0)
    return x.select(*DIMENSIONS, "tokens", "weight", prob.alias("prob")), residual


def _weighed(x: DataFrame, rounds: int, temper: dict[str, float], targets) -> DataFrame:
    """``_source, _lang, _topic, _weight, _prob`` of the cells of ``x``; for a join by broadcast if they are few."""
    own = [f"_{d}" for d in DIMENSIONS]
    cells = x.groupBy(*[F.col(c).alias(d) for c, d in zip(own, DIMENSIONS, strict=True)]).agg(F.sum("_tokens").alias("tokens"))
    x = rake(cells, rounds, temper, targets)
    x = x.select(*[F.col(d).alias(c) for c, d in zip(own, DIMENSIONS, strict=True)], F.col("weight").alias("_weight"), F.col("prob").alias("_prob"))
    return F.broadcast(x) if x.count() <= BROADCAST_CELLS else x


def mix(docs: DataFrame, rounds: int = MOST_ROUNDS, temper: dict[str, float] = TEMPER, targets: dict[str, dict[str, float]] | None = None, topic=layout) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, prob, sampled`` for every row of
    ``docs (doc_id, text, lang, source)``.

    ``targets`` are as for ``raked``; ``topic`` makes a text's Column its topic's. A null source, language
    or topic is the class ``(none)``. A null or empty text has no tokens; if its
    cell has none at all, it is kept. The draw is a hash of doc_id and text: the same rows are
    drawn alike. An empty table stays empty; further columns are not read. Texts are read once: their cell, tokens
    and draw are stored."""
    x = _classed(pick(docs, "doc_id", "text", "lang", "source"), topic)
    x = store(x.select("doc_id", *[f"_{d}" for d in DIMENSIONS], "_tokens", "_draw"), "classed")
    x = x.join(_weighed(x, rounds, temper, targets), [f"_{d}" for d in DIMENSIONS])
    named = [F.col(f"_{d}").alias(d) for d in DIMENSIONS]
    return x.select("doc_id", *named, F.col("_tokens").alias("n_tokens"), F.round("_weight", 8).alias("weight"), F.round("_prob", 8).alias("prob"), (F.col("_draw") < F.col("_prob")).alias("sampled"))


def keep_mixed(docs: DataFrame, rounds: int = MOST_ROUNDS, temper: dict[str, float] = TEMPER, targets: dict[str, dict[str, float]] | None = None, topic=layout) -> DataFrame:
    """The rows of ``docs``, with their columns, that ``mix`` samples."""
    cells = _weighed(_classed(pick(docs, "doc_id", "text", "lang", "source"), topic), rounds, temper, targets)
    whole = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), "doc_id", "text", "lang", "source")
    return _classed(whole, topic).join(cells, [f"_{d}" for d in DIMENSIONS]).where("_draw < _prob").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql(rounds: int = MOST_ROUNDS, temper: dict[str, float] = TEMPER) -> str:
    w = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
    out = [
        f"""WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[*#&$%]{{3}}') THEN 'decorated' WHEN contains(text, '!! ') THEN 'shouting' ELSE 'prose' END AS topic,
  len({w})::BIGINT AS n_tokens,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT / 281474976710656.0 AS u FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        "w0 AS (SELECT *, tokens / sum(tokens) OVER () AS w FROM c)",
    ]
    for d in DIMENSIONS:
        out.append(f"t_{d} AS (SELECT {d}, pow(m, {temper[d]}) / sum(pow(m, {temper[d]})) OVER () AS t FROM (SELECT {d}, sum(w) AS m FROM w0 GROUP BY {d}))")
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            out.append(f"w{n + 1} AS (SELECT w{n}.source, w{n}.lang, w{n}.topic, tokens, CASE WHEN sum(w) OVER (PARTITION BY w{n}.{d}) > 0 THEN w * t / sum(w) OVER (PARTITION BY w{n}.{d}) ELSE 0 END AS w FROM w{n} JOIN t_{d} ON w{n}.{d} = t_{d}.{d})")
            n += 1
    out.append(f"p AS (SELECT source, lang, topic, w, coalesce(CASE WHEN tokens > 0 THEN w / tokens END / max(CASE WHEN tokens > 0 THEN w / tokens END) OVER (), 1.0) AS prob FROM w{n})")
    return ",\n".join(out) + "\nSELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(w, 8) AS weight, round(prob, 8) AS prob, u < prob AS sampled FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"


ORACLE_SQL = _sql()
