"""Training pairs from templates and value lists; seeded picks and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import hash_uniform
from ._stored import BROADCAST_ROWS, beside
from .curate import keep_first, mixed_radix


def pick(values: Column, *keys: Column, seed: int = 42) -> Column:
    """One of an array's values, as the seed and the keys decide."""
    return F.get(values, F.floor(hash_uniform(*keys, seed=seed) * F.size(values)).cast("int"))


def slot_combinations(spark: SparkSession, slots: dict[str, list[str]], limit: int | None = None) -> DataFrame:
    """All combinations of slot values, the first slot fastest."""
    x = mixed_radix(spark, {k: len(v) for k, v in slots.items()}, limit)
    for k, v in slots.items():
        x = x.withColumn(k, F.get(F.array(*[F.lit(s) for s in v]), F.col(k)))
    return x


def render(combos: DataFrame, nl: str, query: str, slots: list[str]) -> DataFrame:
    """``natural_language, ads_query`` of each combination."""

    def fill(t: str) -> Column:
        out = F.lit(t)
        for s in slots:
            out = F.replace(out, F.lit("{" + s + "}"), F.col(s))
        return out

    return combos.withColumn("natural_language", fill(nl)).withColumn("ads_query", fill(query))


def join_templates(inputs: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(matched, unmatched)`` inputs by ``template_id``."""
    return inputs.join(beside(templates), "template_id"), inputs.join(beside(templates.select("template_id")), "template_id", "left_anti")


def round_robin(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Each left row with the right row number ``i mod n`` (W16). The right side is a short list, which is counted."""
    n = right.count()
    if n > BROADCAST_ROWS:
        raise ValueError(f"{n} rows are no short list")
    r = right.withColumn("_i", F.row_number().over(Window.orderBy(right_order)) - 1)
    buckets = left.withColumn("_i", F.pmod(F.col(left_order), F.lit(n)))
    return buckets.join(F.broadcast(r), "_i").drop("_i")


def stopword_noise(text: Column, *keys: Column, seed: int = 42, p: float = 0.3) -> Column:
    """A polite prefix or suffix for a share of the texts, the first letter then small."""
    before = F.array(*[F.lit(s) for s in ("please find ", "show me ", "I am looking for ", "can you find ")])
    after = F.array(*[F.lit(s) for s in (" please", " if possible", " thanks")])
    small = F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))
    u = hash_uniform(*keys, seed=seed)
    return F.when(u < p, F.concat(pick(before, *keys, seed=seed + 1), small)).when(u < 2 * p, F.concat(text, pick(after, *keys, seed=seed + 1))).otherwise(text)


def weighted_choice(df: DataFrame, choices: dict[str, float], name: str, *keys: str, seed: int = 42) -> DataFrame:
    """A column with one of the choices, by weight."""
    total, upto, out = sum(choices.values()), 0.0, None
    u = hash_uniform(*[F.col(k).cast("string") for k in keys], seed=seed)
    for value, weight in choices.items():
        upto += weight / total
        out = F.when(u < upto, value) if out is None else out.when(u < upto, value)
    return df.withColumn(name, out.otherwise(value))


def snippets(entries: DataFrame, templates: list[str], seed: int = 42) -> DataFrame:
    """A text with a verified span for each entry ``(id, label, type)`` and a template that its id picks (M6)."""
    t = pick(F.array(*[F.lit(x) for x in templates]), F.col("id"), seed=seed)
    x = entries.withColumn("_t", t).withColumn("text", F.replace("_t", F.lit("{label}"), F.col("label")))
    start = (F.instr("_t", F.lit("{label}")) - 1).cast("int")
    span = F.struct(F.col("label").alias("surface"), start.alias("start"), (start + F.length("label")).alias("end"), F.col("type").alias("type"), F.col("id").alias("canonical_id"))
    return x.withColumn("spans", F.array(span)).drop("_t")


def synthetic_pairs(entries: DataFrame, families: dict[str, tuple[str, str]], order: str) -> DataFrame:
    """Pairs of every family ``name: (nl, query)`` over the entries' labels, the first of equal texts (M8, M9)."""
    out = None
    for n, (family, (nl, query)) in enumerate(families.items()):
        x = entries.select(F.lit(family).alias("category"), F.replace(F.lit(nl), F.lit("{x}"), F.col("label")).alias("natural_language"), F.replace(F.lit(query), F.lit("{x}"), F.col("label")).alias("ads_query"), (F.col(order) * 100 + n).alias("ord"))
        out = x if out is None else out.unionByName(x)
    return keep_first(out, F.col("natural_language"), "ord")
