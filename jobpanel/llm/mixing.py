"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up per cell of source, language and topic. Raking scales the cells
until every marginal has its target share; documents are then drawn with the
calibrated probability of their cell. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ranks import broadcast_if_small
from ..session import checkpoint
from .columns import packed

TOGETHER = 5  # rounds in one plan
CLOSE = 1e-11  # miss of a marginal share at which raking ends
GAIN = 0.01  # part of the miss that a plan of rounds must remove for raking to go on
POWER = 0.5
SHARE = 0.5
BROADCAST_CELLS = 100_000


def tokens_of(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed and carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r]+")).cast("bigint")


# ordered rules: a text has the topic of the first rule whose pattern (Java syntax) it holds
TOPIC_RULES = (
    ("license", "icense"),
    ("contact", "@|http"),
    ("table", " \\| "),
    ("markup", "###|\\$\\$\\$"),
)
OTHER_TOPIC = "prose"


def topic_of(text: Column, rules: Sequence[tuple[str, str]] = TOPIC_RULES, other: str = OTHER_TOPIC) -> Column:
    """The topic of the first rule that applies, `other` where none does; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    out = F.lit(other)
    for topic, pattern in reversed(rules):
        out = F.when(t.rlike(pattern), topic).otherwise(out)
    return out


def tempered_targets(cells: DataFrame, dims: Sequence[str], power: float = POWER) -> dict[str, DataFrame]:
    """Per dimension `level` and `target`: token shares raised to `power` and normalised.

    A power below 1 lifts rare levels and lowers frequent ones.
    """
    out = {}
    for dim in dims:
        levels = cells.groupBy(F.col(dim).alias("level")).agg(
            F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("w")).filter("w > 0")
        whole = levels.agg(F.sum("w").alias("s")).first()["s"]
        out[dim] = levels.select("level", (F.col("w") / F.lit(whole)).alias("target"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], close: float = CLOSE, gain: float = GAIN) -> DataFrame:
    """`cells` with `factor`, raked share of the tokens over natural share, and `missed`.

    A round scales the cells to the target shares of one dimension after the other.
    Raking ends when no marginal misses its target by more than `close`, or when
    `TOGETHER` rounds took less than the part `gain` off the largest miss, as happens
    where targets contradict each other. `missed` is the largest difference between
    a marginal share and its target in the end, the same in every row, so whoever
    reads the result sees whether the targets are met. A level without a target
    keeps nothing; cells without tokens get the factor 1. Windows run over cells,
    whose number follows the levels, not the documents.
    """
    dims = list(targets)
    whole = cells.agg(F.sum("tokens").alias("s")).first()["s"] or 0
    out = cells.withColumn("_share", F.col("tokens") / F.lit(max(whole, 1)))
    for dim, wanted in targets.items():
        level = wanted.select(F.col("level").alias("_level"), F.col("target").alias(f"_to_{dim}"))
        out = out.join(level, F.col(dim).eqNullSafe(F.col("_level")), "left").drop("_level")
    out = checkpoint(out.fillna(0.0, [f"_to_{dim}" for dim in dims]))
    kept = out.columns
    missed, before = 0.0, float("inf")
    while whole:
        for _ in range(TOGETHER):
            for dim in dims:
                at = F.sum("_share").over(Window.partitionBy(dim))
                out = out.withColumn("_at", at).withColumn(
                    "_share", F.when(F.col("_at") > 0, F.col("_share") * F.col(f"_to_{dim}") / F.col("_at")).otherwise(0.0))
        away = [F.abs(F.sum("_share").over(Window.partitionBy(dim)) - F.col(f"_to_{dim}")) for dim in dims]
        out = checkpoint(out.select(*kept, F.greatest(*away, F.lit(0.0)).alias("_missed")))
        missed = out.agg(F.max("_missed").alias("m")).first()["m"]
        if missed <= close or missed > before * (1 - gain):
            break
        before = missed
    factor = F.when(F.col("tokens") > 0, F.col("_share") * max(whole, 1) / F.col("tokens")).otherwise(1.0)
    return out.withColumns({"factor": factor, "missed": F.lit(missed)}).select(*cells.columns, "factor", "missed")


def probabilities(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """`cells` with `probability`, the least of 1 and a common multiple of the factor.

    The multiple makes the expected tokens the given share of all. Cells whose
    probability would pass 1 are taken whole, which leaves their levels below the
    target; the multiple is then solved again over the others.
    """
    whole = cells.agg(F.sum("tokens").alias("s")).first()["s"] or 0
    multiple = share
    while whole:
        full = F.col("factor") * multiple >= 1
        taken, rest = cells.agg(
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("tokens") * F.col("factor"))), F.lit(0.0))).first()
        larger = (share * whole - taken) / rest if rest > 0 else multiple
        if larger <= multiple * (1 + 1e-12):
            break
        multiple = larger
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("factor") * multiple))


def uniform(key: Column, seed: int) -> Column:
    """Number in [0, 1) by hash; equal keys get equal numbers."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", lang: str = "lang",
    share: float = SHARE, power: float = POWER, seed: int = 7, topic: str | Column | None = None,
    topic_rules: Sequence[tuple[str, str]] = TOPIC_RULES, targets: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """`docs` with `tokens`, `topic`, `factor`, `probability`, `missed`, `sampled`; columns of those names are replaced.

    The topic is the column `topic`, or else that of the first of `topic_rules`.
    `targets` gives (`level`, `target`) tables for `source`, `lang` and `topic`; a
    dimension without one has tempered token shares as targets. `missed` is by how
    much the worst marginal differs from its target before the draw: 0 but for
    rounding, unless the targets contradict each other (source a only in languages x
    and y, their targets not adding up to that of a). A document is sampled when the
    hash of its id falls below its probability, so repeated ids share their fate.
    Null sources, languages and topics are levels of their own; null and empty texts
    have no tokens, and documents in cells without tokens the factor 1. An empty
    table stays empty. The cells, few as the levels are, are broadcast up to a
    checked number and joined by shuffle beyond it.
    """
    by_topic = topic_of(F.col(text_col), topic_rules) if topic is None else F.col(topic) if isinstance(topic, str) else topic
    full = docs.withColumns({"tokens": tokens_of(F.col(text_col)), "topic": by_topic})
    dims = {"_source": source, "_lang": lang, "_topic": "topic"}
    cells = checkpoint(
        full.groupBy(*[F.col(c).alias(d) for d, c in dims.items()])
        .agg(F.sum("tokens").alias("tokens")))
    given = {f"_{name}": t for name, t in (targets or {}).items()}
    if set(given) - set(dims):
        raise ValueError("targets are for source, lang and topic")
    tempered = tempered_targets(cells, [d for d in dims if d not in given], power)
    raked = rake(cells, {d: given.get(d, tempered.get(d)) for d in dims})
    weights = checkpoint(probabilities(raked, share)).drop("tokens")
    same = None
    for d, c in dims.items():
        equal = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{d}"))
        same = equal if same is None else same & equal
    added = ["factor", "probability", "missed"]
    out = full.drop(*added).alias("a").join(broadcast_if_small(weights, BROADCAST_CELLS).alias("b"), same).select(
        "a.*", *[f"b.{c}" for c in added])
    return out.withColumn("sampled", uniform(F.col(id_col), seed) < F.col("probability"))


def sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", lang: str = "lang",
    **options: object,
) -> DataFrame:
    """The documents that `mix` samples, as they were."""
    rows = packed(docs, doc_id=id_col, text=text_col, source=source, lang=lang)
    return mix(rows, **options).filter("sampled").select("row.*")
