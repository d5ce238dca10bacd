"""Mixing sources to target weights by iterative proportional fitting.

DataFrame operations only. Tokens are summed to cells of the raked columns; the cells'
weights are raked to each marginal in turn until all are met; a document is sampled with its cell's calibrated
probability. Nothing is gathered in one task: a value's sum is combined in every task before it is shuffled, however many cells it has, and
the constant of the probabilities is found by a few aggregates instead of a sort of all cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
NONE = "(none)"
#: Rounds before an error that no longer falls ends the raking.
PATIENCE = 100
#: Cells up to which one task sums them, without a shuffle.
ONE_TASK = 1 << 15
#: Values of a marginal up to which its factors are broadcast to the cells.
BROADCAST_VALUES = 1 << 17


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) fixed by the first of ``columns`` that is not null."""
    named = F.coalesce(*(c.cast("string") for c in columns), F.lit(""))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def rake(cells: DataFrame, shares: Mapping[str, DataFrame], total: float, scratch: Scratch, rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    """``cells(names, t)`` with their raked weight w, and the greatest relative error that the last round found in a marginal.

    A cell's weight is its share of the tokens times a factor of each of its values. ``shares`` has (name, q) of every
    marginal's values; a round sets each marginal's factors in turn to what its shares ask for, from sums over the cells, and is one
    written table of factors. Ends when a round finds no error above ``tolerance``, when errors no longer
    fall, as with shares that contradict each other, or after ``rounds``.
    """
    names = list(shares)
    near = {n: F.broadcast if q.count() <= BROADCAST_VALUES else lambda x: x for n, q in shares.items()}
    few = cells.count() <= ONE_TASK
    factors = {n: q.select(n, "q", F.lit(1.0).alias(f"f{n}")) for n, q in shares.items()}
    if few:
        cells = cells.coalesce(1)
    error, best = float("inf"), float("inf")
    for done in range(1, rounds + 1):
        found = []
        for name in names:
            w = cells.withColumn("w", F.col("t") / F.lit(total))
            for other in names:
                if other != name:
                    w = w.join(near[other](factors[other].select(other, f"f{other}")), other).withColumn("w", F.col("w") * F.col(f"f{other}"))
            sums = w.groupBy(name).agg(F.sum("w").alias("has"))
            new = F.when(F.col("has") > 0, F.col("q") / F.col("has")).otherwise(F.lit(0.0))
            # the marginal was met up to the change of its factor
            off = F.when(F.col("q") > 0, F.abs(F.try_divide(F.col(f"f{name}"), new) - 1)).otherwise(F.lit(0.0))
            step = factors[name].join(near[name](sums), name).select(name, "q", new.alias("new"), F.coalesce(off, F.lit(0.0)).alias("off"))
            factors[name] = step.select(name, "q", F.col("new").alias(f"f{name}"))
            found.append(step.select(F.lit(name).alias("dim"), F.col(name).alias("value"), "q", "new", "off"))
        table = scratch.table(reduce(DataFrame.unionByName, found).coalesce(1) if few else reduce(DataFrame.unionByName, found))
        factors = {n: table.where(F.col("dim") == n).select(F.col("value").alias(n), "q", F.col("new").alias(f"f{n}")) for n in names}
        error = table.agg(F.max("off")).first()[0] or 0.0
        if error <= tolerance or (error >= best and done >= PATIENCE):
            break
        best = min(best, error)
    w = cells.withColumn("w", F.col("t") / F.lit(total))
    for name in names:
        w = w.join(near[name](factors[name].select(name, f"f{name}")), name).withColumn("w", F.col("w") * F.col(f"f{name}")).drop(f"f{name}")
    return scratch.table(w), error


def mix_sources(
    docs: DataFrame,
    dims: Mapping[str, Column],
    targets: Mapping[str, Mapping[str, float]] | None = None,
    temperature: float = 0.5,
    fraction: float = 0.5,
    rounds: int = 200,
    tolerance: float = 1e-9,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] | None = None,
    prefix: str = "__",
) -> DataFrame:
    """All rows of ``docs`` and their columns, or those in ``keep``, with __tokens, __weight, __probability and __sampled added.

    ``dims`` names the raked marginals and how to read them, ``targets`` their shares of the
    tokens; a marginal without given shares gets its own, tokens to the power of
    ``temperature``, normalised (given shares are normalised over the values present; a
    value without one gets 0). Raking ends when every marginal is met to ``tolerance``, or after
    ``rounds``, as with shares that contradict each other. __weight is the raked share of a cell over its present share.
    Probabilities are the weights times a constant, at most 1, such that the expected tokens
    are ``fraction`` of all: where a cell would need more than all it has, it is kept whole
    and the others make up for it. Null values of a marginal form the value ``(none)``. Rows
    without words have no weight and are never sampled. A row's draw is fixed by its id, or by its text if that is null, so repeated rows
    share one decision; cells of equal weight are treated alike; an empty table gives no rows. The columns are written to
    the shared folder with their marginals and tokens, so that texts are read and counted once. Added names begin with
    ``prefix``; columns of those names are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    p = prefix
    names: Sequence[str] = [f"{p}{k}" for k in dims]
    read = docs.withColumns({n: F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in zip(names, dims.values())}).withColumns(
        {
            f"{p}tokens": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long"),
            f"{p}draw": uniform(F.col(id_col), F.col(text_col)),
        }
    )
    held = list(dict.fromkeys([id_col, *(docs.columns if keep is None else keep)]))
    added = [*names, f"{p}tokens", f"{p}draw"]
    read = scratch.table(read.select(*(c for c in held if c not in added), *added))
    cells = scratch.table(read.where(F.col(f"{p}tokens") > 0).groupBy(*names).agg(F.sum(f"{p}tokens").alias("t")))
    total = cells.agg(F.sum("t")).first()[0] or 0
    marginals = {}
    for k, name in zip(dims, names):
        by = cells.groupBy(name).agg(F.sum("t").alias("own"))
        if targets and k in targets:
            given = F.create_map(*[F.lit(x) for kv in targets[k].items() for x in kv])
            share = F.coalesce(given[F.col(name)].cast("double"), F.lit(0.0))
        else:
            share = F.pow("own", F.lit(temperature))
        by = scratch.table(by.select(name, share.cast("double").alias("s")))
        every = by.agg(F.sum("s")).first()[0] or 1.0
        marginals[name] = by.select(name, (F.col("s") / F.lit(every)).alias("q"))
    w, _ = rake(cells, marginals, float(max(1, total)), scratch, rounds, tolerance)
    # given shares may leave part of the weight without cells
    every = w.agg(F.sum("w")).first()[0] or 1.0
    w = w.withColumn("r", F.col("w") / F.lit(every) * F.lit(float(total)) / F.col("t"))
    goal, scale = float(total) * fraction, None
    while True:
        whole = F.lit(False) if scale is None else F.col("r") * F.lit(scale) > 1 + 1e-12
        full, rest = w.agg(F.coalesce(F.sum(F.when(whole, F.col("t"))), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~whole, F.col("r") * F.col("t"))), F.lit(0.0))).first()
        now = (goal - full) / rest if rest > 0 else None
        # the constant only grows as more cells are whole, until no further one is
        if now is None or scale is not None and now <= scale * (1 + 1e-15):
            scale = scale if now is None else max(now, scale or now)
            break
        scale = now
    probability = F.least(F.lit(1.0), F.col("r") * F.lit(scale if scale is not None else 0.0))
    w = scratch.table(w.select(*names, F.col("r").alias(f"{p}weight"), probability.alias(f"{p}probability")))
    some = F.col(f"{p}tokens") > 0
    out = read.join(w, list(names), "left").withColumns({c: F.when(some, F.col(c)).otherwise(F.lit(0.0)) for c in (f"{p}weight", f"{p}probability")})
    return out.withColumn(f"{p}sampled", F.col(f"{p}draw") < F.col(f"{p}probability")).drop(f"{p}draw")
