"""Sampling documents so that token weights meet source, language and topic marginals (iterative proportional fitting).

Documents are first summed into cells, one per combination of the dimensions; raking only ever touches cells. Everything is
DataFrame expressions: aggregates, joins and scalars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsig.llm.shared import materialise

ROUNDS = 10
RATE = 0.5
ALPHA = 0.5
SEED = "mix"
_DRAW_DIGITS = 13


def words(text: Column) -> Column:
    """Tokens of a text, one at least: words between white space."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)), F.lit(1)).cast("long")


def form(text: Column) -> Column:
    """The topic dimension where a table has no topic column: the form of the text."""
    return (
        F.when(F.coalesce(F.contains(text, F.lit(" | ")), F.lit(False)), "table").when(words(text) < 100, "note").otherwise("prose")
    )


def draw(key: Column, text: Column) -> Column:
    """A number in [0, 1) fixed by the id, or by the text where the id is null."""
    name = F.coalesce(key.cast("string"), F.md5(text.cast("binary")), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), name).cast("binary")), 1, _DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / float(16**_DRAW_DIGITS)


def _keys(dims: dict[str, Column]) -> dict[str, Column]:
    """Join keys that tell null from every value."""
    return {f"__k_{d}": F.to_json(F.struct(c.alias("v"))) for d, c in dims.items()}


def tempered(cells: DataFrame, key: str, alpha: float = ALPHA) -> DataFrame:
    """Target shares of a dimension: token counts to the power ``alpha``, so large values are damped."""
    sums = cells.groupBy(key).agg(F.pow(F.sum("tokens"), F.lit(alpha)).alias("raised"))
    whole = sums.agg(F.sum("raised").alias("whole")).first().whole
    return sums.select(key, (F.col("raised") / F.lit(whole or 1.0)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``weight``: token shares scaled in turn to each dimension's target, ``rounds`` times."""
    whole = cells.agg(F.sum("tokens").alias("whole")).first().whole or 1
    cells = cells.withColumn("weight", F.col("tokens") / F.lit(float(whole)))
    for _ in range(rounds):
        for key, target in targets.items():
            have = cells.groupBy(key).agg(F.sum("weight").alias("have")).join(target, key)
            factor = have.select(key, F.when(F.col("have") > 0, F.col("share") / F.col("have")).otherwise(0.0).alias("factor"))
            cells = cells.join(factor, key, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")
        cells = materialise(cells, "raked")
    return cells


def probabilities(cells: DataFrame, rate: float = RATE) -> DataFrame:
    """``cells`` with ``p``, at most 1, in proportion to weight over tokens, so that ``rate`` of all tokens are expected.

    Cells whose share exceeds what they have are taken whole and the rest is scaled up, until nothing changes.
    """
    wanted = rate * (cells.agg(F.sum("tokens").alias("n")).first().n or 0)
    scale, full = 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(scale) >= F.col("tokens")
        got = cells.agg(
            F.sum(F.when(capped, F.col("tokens")).otherwise(0)).alias("taken"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("left"),
            F.sum(F.when(capped, 1).otherwise(0)).alias("n"),
        ).first()
        if not got.left or got.n == full:
            break
        full, scale = got.n, (wanted - got.taken) / got.left
    return cells.withColumn("p", F.least(F.lit(1.0), F.col("weight") * F.lit(scale) / F.col("tokens")))


def calibrated(
    docs: DataFrame, dims: dict[str, Column], targets: dict[str, DataFrame] | None = None, rate: float = RATE, alpha: float = ALPHA,
    rounds: int = ROUNDS, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs`` with ``__tokens``, ``__p`` (probability of being sampled) and ``__sampled``; every row is returned.

    ``dims`` names the dimensions and their columns. ``targets`` may give a frame ``(value, share)`` for a dimension (a value
    without a share gets weight 0); the others are tempered by ``alpha``. A null is a value of its own. Empty and null texts
    count as one token. Equal ids are drawn alike, null ids by their text. An empty table gives no rows.
    """
    keys = _keys(dims)
    keyed = docs.withColumns({**keys, "__tokens": words(F.col(text)), "__draw": draw(F.col(key), F.col(text))})
    cells = materialise(keyed.groupBy(*keys).agg(F.sum("__tokens").alias("tokens")), "cells")
    wanted = {}
    for d, k in zip(dims, keys):
        if targets and d in targets:
            given = targets[d].select(F.to_json(F.struct(F.col("value").alias("v"))).alias(k), "share")
            given = cells.select(k).distinct().join(given, k)
            whole = given.agg(F.sum("share").alias("n")).first().n or 1.0
            wanted[k] = materialise(given.withColumn("share", F.col("share") / F.lit(whole)), "target")
        else:
            wanted[k] = materialise(tempered(cells, k, alpha), "target")
    known = materialise(probabilities(rake(cells, wanted, rounds), rate).select(*keys, F.col("p").alias("__p")), "known")
    met = keyed.join(known, list(keys), "left")
    return met.withColumn("__sampled", F.col("__draw") < F.col("__p")).select(*docs.columns, "__tokens", "__p", "__sampled")


def dimensions(text: str = "text") -> dict[str, Column]:
    """Source, language and topic of the documents table."""
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": form(F.col(text))}


def mix(docs: DataFrame, rate: float = RATE, alpha: float = ALPHA) -> DataFrame:
    """The sampled rows of ``docs``, with their columns only."""
    return calibrated(docs, dimensions(), rate=rate, alpha=alpha).where("__sampled").select(*docs.columns)


def sql(rounds: int = ROUNDS, rate: float = RATE, alpha: float = ALPHA, docs: str = "documents") -> str:
    """The same as DuckDB SQL, rounds unrolled; the cap is found from a running sum over the cells."""
    dims = ("source", "lang", "topic")
    steps = []
    for n in range(rounds * len(dims)):
        d, before = dims[n % len(dims)], f"w{n}"
        others = ", ".join(f"a.{x}" for x in dims)
        steps.append(
            f"w{n + 1} AS MATERIALIZED (SELECT {others}, a.tokens, a.weight * t.share / h.have AS weight FROM {before} a"
            f" JOIN (SELECT {d}, sum(weight) AS have FROM {before} GROUP BY {d}) h ON h.{d} IS NOT DISTINCT FROM a.{d}"
            f" JOIN t_{d} t ON t.{d} IS NOT DISTINCT FROM a.{d})"
        )
    shares = ", ".join(
        f"t_{d} AS (SELECT {d}, pow(sum(tokens), {alpha}) / sum(pow(sum(tokens), {alpha})) OVER () AS share FROM cells GROUP BY {d})"
        for d in dims
    )
    draw_sql = f"CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, {_DRAW_DIGITS}) AS BIGINT) AS DOUBLE)"
    return f"""
WITH counted AS (
  SELECT doc_id, source, lang, text, greatest(coalesce(len(regexp_extract_all(text, '\\S+')), 0), 1) AS tokens FROM {docs}
),
named AS (
  SELECT doc_id, source, lang, tokens, text,
         CASE WHEN coalesce(contains(text, ' | '), false) THEN 'table' WHEN tokens < 100 THEN 'note' ELSE 'prose' END AS topic
  FROM counted
),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM named GROUP BY source, lang, topic),
{shares},
w0 AS (SELECT source, lang, topic, tokens, tokens / sum(tokens) OVER () AS weight FROM cells),
{", ".join(steps)},
ranked AS (
  SELECT *, coalesce(sum(tokens) OVER before, 0) AS taken, coalesce(sum(weight) OVER before, 0) AS used
  FROM w{rounds * len(dims)}
  WINDOW before AS (ORDER BY weight / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
scales AS (
  SELECT tokens, weight, (({rate} * (SELECT sum(tokens) FROM cells)) - taken) / ((SELECT sum(weight) FROM ranked) - used) AS scale,
         taken FROM ranked
),
chosen AS (SELECT scale FROM scales WHERE scale * weight < tokens ORDER BY taken LIMIT 1),
known AS (
  SELECT source, lang, topic, least(1.0, weight * coalesce((SELECT scale FROM chosen), 1e300) / tokens) AS p
  FROM w{rounds * len(dims)}
)
SELECT n.doc_id, n.source, n.lang, n.topic, CAST(n.tokens AS BIGINT) AS tokens, round(k.p, 9) AS probability,
       {draw_sql} / {float(16**_DRAW_DIGITS)!r} < k.p AS sampled
FROM named n JOIN known k
  ON k.source IS NOT DISTINCT FROM n.source AND k.lang IS NOT DISTINCT FROM n.lang AND k.topic = n.topic
"""
