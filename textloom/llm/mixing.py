"""Mixing sources to target weights by the cube method (Deville and Tille, 2004; fast form of Chauvet and Tille, 2006).

Every document has an inclusion probability that its source's target sets. The flight phase moves
probabilities along the null space of the balancing constraints, documents and tokens of the source,
until all but two documents of a source are in or out; the landing phase then decides those few. It
runs in pieces of a source first, then over what the pieces leave, so no source needs one machine.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Work, col, fresh

PIECE = 50_000  # documents of a source in one flight
EPS = 1e-9


def flight(p: list[float], tokens: list[float], seed: int) -> list[float]:
    """p after the flight: 0 or 1 but for two at most. sum(p) and sum(p * tokens) don't change, but for rounding.

    Three open documents at a time are moved along the one direction that keeps both sums, by one of the two
    steps that reach a bound, drawn so that no probability changes in expectation.
    """
    rng, p = random.Random(seed), list(p)
    open_: list[int] = []
    for i, v in enumerate(p):
        if EPS < v < 1 - EPS:
            open_.append(i)
        else:
            p[i] = float(v >= 0.5)
        while len(open_) == 3:
            a, b, c = open_
            u = (tokens[b] - tokens[c], tokens[c] - tokens[a], tokens[a] - tokens[b])
            if not any(u):  # equal sizes: the document count is the only constraint
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(open_, u, strict=True) if d)
            down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(open_, u, strict=True) if d)
            step = up if rng.random() < down / (up + down) else -down
            for i, d in zip(open_, u, strict=True):
                p[i] += step * d
            still = []
            for i in open_:
                if EPS < p[i] < 1 - EPS:
                    still.append(i)
                else:
                    p[i] = float(p[i] >= 0.5)
            open_ = still
    return p


def landing(p: list[float], seed: int) -> list[float]:
    """The open ones decided by one draw: systematic sampling, so that their number is off by less than one."""
    u, total, out = random.Random(seed).random(), 0.0, []
    for v in p:
        before, total = total, total + v
        out.append(float(int(total + u) > int(before + u)) if EPS < v < 1 - EPS else float(v >= 0.5))
    return out


def _fly(last: bool):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("turn", "ascending"), ("turn2", "ascending")])
        seed = hash((rows.column("turn")[0].as_py(), rows.num_rows, last))
        p = flight(rows.column("p").to_pylist(), rows.column("tokens").to_pylist(), seed)
        return rows.set_column(rows.schema.get_field_index("p"), rows.schema.field("p"), [pa.array(landing(p, seed + 1) if last else p, pa.float64())])

    return run


def target_probabilities(totals: dict, weights: dict | None, share: float, power: float) -> dict:
    """By source, the share of its tokens to take: share of all tokens, split by weight; what a source lacks is made up by the others.

    Without weights, a source weighs its tokens to `power`: below 1 evens sources out.
    """
    w = {s: max(0.0, float(weights.get(s, 0.0))) if weights is not None else float(n) ** power for s, n in totals.items() if n > 0}
    left, budget, p = dict(w), share * sum(totals.values()), {s: 0.0 for s in totals}
    while left and sum(left.values()) > 0:
        scale = budget / sum(left.values())
        full = [s for s in left if left[s] * scale >= totals[s]]
        if not full:
            return p | {s: left[s] * scale / totals[s] for s in left}
        for s in full:
            p[s] = 1.0
            budget -= totals[s]
            del left[s]
    return p


def token_count(text: Column) -> Column:
    """Runs of non-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def sample_sources(docs: DataFrame, weights: dict | None = None, share: float = 0.5, power: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, inclusion): the sampled documents, with the probability that each had.

    The tokens taken of a source come to its target, and its documents to their expected number, but for
    what the landing phase moves: two documents at most, whatever the source's size.

    Nulls: a null source is a source of its own. A null or empty text has 0 tokens and can be sampled. Rows
    of equal doc_id and source are one unit, in or out together, of the tokens of all of them; so are those
    of a null doc_id. Ids are of any type that can be grouped by. Sources without tokens aren't sampled. Ties
    in the random order go by a second hash of source and doc_id. An empty table gives no rows. Other
    columns aren't read. The draw depends on seed, doc_ids and token counts alone, not on how the rows are
    spread over machines.
    """
    spark = docs.sparkSession
    work = Work(spark, "mixing")
    units = docs.select(col(id_col).alias("unit"), col(source_col).cast("string").alias("source"), token_count(col(text_col).cast("string")).alias("tokens")).groupBy("unit", "source").agg(F.sum("tokens").alias("tokens"))
    turns = {n: F.xxhash64(F.lit(seed + i), "unit", F.coalesce("source", F.lit(""))) for i, n in enumerate(("turn", "turn2"))}
    units = work.table(units.withColumns(turns), "units")
    sums = units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()  # a row for each source
    p = target_probabilities({r.source: r.tokens for r in sums}, weights, share, power)
    plan = spark.createDataFrame([(r.source, p[r.source], -(-r.n // PIECE)) for r in sums], "s string, p double, pieces long")
    ready = units.join(F.broadcast(plan) if len(sums) <= 10_000 else plan, F.col("source").eqNullSafe(F.col("s"))).where("p > 0").select("unit", "source", "tokens", "turn", "turn2", "p", F.col("p").alias("inclusion"), F.pmod("turn", "pieces").alias("piece"))
    schema = ready.schema
    flown = work.table(ready.groupBy("source", "piece").applyInArrow(_fly(False), schema), "flown")
    is_open = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    landed = flown.where(is_open).groupBy("source").applyInArrow(_fly(True), schema)
    return flown.where(~is_open).union(landed).where("p > 0.5").select(F.col("unit").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "inclusion")


def mixed(docs: DataFrame, weights: dict | None = None, share: float = 0.5, power: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The rows of docs whose document `sample_sources` takes, with all their columns.

    Rows of one doc_id and source are taken together, those of a null doc_id too; null and empty texts count
    as documents of 0 tokens. An empty table gives no rows.
    """
    unit, origin = fresh(docs, "unit"), fresh(docs, "origin")
    taken = sample_sources(docs, weights, share, power, id_col, text_col, source_col, seed).select("doc_id", "source").toDF(unit, origin)
    on = col(id_col).eqNullSafe(F.col(unit)) & col(source_col).cast("string").eqNullSafe(F.col(origin))
    return docs.join(taken, on, "left_semi").select(*(col(c) for c in docs.columns))
