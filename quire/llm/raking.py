"""Mixing sources to target weights by raking, in DataFrame functions only.

Token weights of the cells source x language x topic are scaled, margin after
margin, until each margin's sums meet its targets (iterative proportional
fitting).  A cell's rate is its raked weight over its weight in the corpus; rates
are scaled, and cut at one, so that the expected number of sampled tokens meets
the budget.  A document is sampled if a hash of its id falls below its cell's
probability.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.runtime import cut, ready, small, unused

MARGINS = ("source", "lang", "topic")
#: A margin's targets: the exponent that its shares of the corpus are flattened by.
TARGETS: Mapping[str, float | Mapping[str, float]] = {"source": 0.5, "lang": 0.6, "topic": 0.8}
ROUNDS, ROUNDS_PER_CUT, BUDGET_STEPS, BUDGET, SEED = 12, 4, 16, 0.5, 20
#: Raking ends before its last round once every margin's sums are this close to their targets, as a part of each target.
CLOSE = 1e-12
#: Cells are sent to every task, and those of a margin's value summed in one, up to this number; beyond it they are
#: joined by a shuffle and summed in parts.
BROADCAST_CELLS = 100_000


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r]+"))


def topic_of(text: Column) -> Column:
    """What a text looks like: noisy (many signs and digits), listing (short lines) or prose."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    signs = F.regexp_count(text, F.lit("[0-9#$%&*|@!<>=_/]"))
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return F.when(signs * 8 > size, "noisy").when(size < lines * 80, "listing").otherwise("prose")


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number from 0 up to 1 that the key decides."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _margin_targets(cells: DataFrame, margin: str, target: float | Mapping[str, float]) -> DataFrame:
    """``margin`` and the share its values should have; shares add up to one."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("n"))
    if isinstance(target, Mapping):
        want = F.lit(0.0)
        for value, share in target.items():
            want = F.when(F.col(margin) == value, F.lit(float(share))).otherwise(want)
        sums = sums.withColumn("want", want)
    else:
        sums = sums.withColumn("want", F.pow(F.col("n").cast("double"), F.lit(float(target))))
    total = sums.agg(F.sum("want").alias("total"))
    return sums.join(F.broadcast(total)).select(margin, F.when(F.col("total") > 0, F.col("want") / F.col("total")).otherwise(0.0).alias(f"want_{margin}"))  # one row


def rake(cells: DataFrame, margins: tuple[str, ...] = MARGINS, targets: Mapping = TARGETS, rounds: int = ROUNDS, few: int = BROADCAST_CELLS) -> DataFrame:
    """Adds ``weight``: the cells' token weights, summing to one, fitted to the margins' targets.

    ``cells`` has a row for each combination of the margins, with ``tokens``.  A
    value whose cells weigh nothing stays at nothing.  Up to ``few`` cells are
    summed by windows, which need no step of their own; more are summed in parts
    before they move, so that no task holds all cells of a topic.  Ends after
    ``rounds`` rounds; the sums in parts end sooner once all margins fit.
    """
    total = cells.agg(F.sum("tokens").cast("double").alias("all_tokens"))
    state = cells.join(F.broadcast(total)).withColumn("weight", F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0))  # one row
    wanted = {m: _margin_targets(cells, m, targets[m]) for m in margins}
    if cells.count() > few:
        return _rake_in_parts(cut(state), wanted, rounds)
    for m in margins:
        state = state.join(wanted[m], m)
    state = cut(state)
    for i in range(1, rounds + 1):
        for m in margins:
            now = F.sum("weight").over(Window.partitionBy(m))
            state = state.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"want_{m}") / now).otherwise(0.0))
        if i % ROUNDS_PER_CUT == 0:
            state = cut(state)
    return state


def _rake_in_parts(state: DataFrame, wanted: dict[str, DataFrame], rounds: int) -> DataFrame:
    """The same rounds by grouped sums; a margin's factors go to every task while it has few values."""
    wanted = {m: small(cut(target), BROADCAST_CELLS) for m, target in wanted.items()}
    for _ in range(rounds):
        misfit = 0.0
        for m, target in wanted.items():
            sums = state.groupBy(m).agg(F.sum("weight").alias("now")).join(target, m)
            factors = cut(sums.select(m, F.when(F.col("now") > 0, F.col(f"want_{m}") / F.col("now")).otherwise(0.0).alias("factor")))
            values, off = factors.agg(F.count("*"), F.max(F.abs(F.col("factor") - 1))).first()
            misfit = max(misfit, off or 0.0)
            factors = F.broadcast(factors) if values <= BROADCAST_CELLS else factors
            state = state.join(factors, m).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        state = cut(state)
        if misfit <= CLOSE:
            break
    return state


def calibrate(state: DataFrame, budget: float = BUDGET, steps: int = BUDGET_STEPS) -> DataFrame:
    """Adds ``probability``: rates scaled so that ``budget`` of all tokens is expected, none above one.

    Each step finds the cells that the present scale would take whole and
    spreads what is left of the budget over the others; two sums come to the driver.
    """
    rate = F.when(F.col("tokens") > 0, F.col("weight") * F.col("all_tokens") / F.col("tokens")).otherwise(0.0)
    state = state.withColumn("rate", rate)
    scale = budget
    for _ in range(steps):
        whole = F.col("rate") * scale >= 1
        row = state.agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(F.col("tokens") * F.col("rate"))), F.max("all_tokens")).first()
        taken, open_, everything = (float(x or 0) for x in row)
        step = (budget * everything - taken) / open_ if open_ > 0 else scale
        if step <= scale * (1 + 1e-12):
            break
        scale = step
    return state.withColumn("probability", F.round(F.least(F.lit(1.0), F.col("rate") * scale), 9))


def _value(x: Column) -> Column:
    """A margin's value as text that no value shares with null."""
    return F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit(""))


def mix(docs: DataFrame, topic: Column | None = None, targets: Mapping = TARGETS, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Adds ``topic``, ``n_tokens``, ``probability`` and ``sampled`` to every row.

    Null sources and languages are values of their own; null and empty texts
    have no tokens, and a cell without any tokens has the probability zero.  Rows
    with the same id share a draw; existing columns of the four names are
    replaced, all others stay as they are.  Only the cells' sums are shuffled; a
    source with a third of all rows is summed before that.  A target given as a
    mapping leaves null values at nothing.  ``topic`` may be any column; without
    one the form of the text stands in for it (``topic_of``).
    """
    ready(docs.sparkSession)
    added = ("topic", "n_tokens", "probability", "sampled")
    rest = [c for c in docs.columns if c not in added]
    keys = dict(zip(MARGINS, unused([*docs.columns, *added], *MARGINS), strict=True))
    (made,) = unused([*docs.columns, *added, *keys.values()], "made")
    rows = docs.withColumn(made, topic if topic is not None else topic_of(F.col(f"`{text_col}`")))
    rows = rows.select(*[F.col(f"`{c}`") for c in rest], F.col(made).alias("topic"), token_count(F.col(f"`{text_col}`")).alias("n_tokens"))
    rows = rows.withColumns({k: _value(F.col(m)) for m, k in keys.items()})
    cells = rows.groupBy(*keys.values()).agg(F.sum("n_tokens").alias("tokens"))
    cells = cut(cells.select(*[F.col(k).alias(m) for m, k in keys.items()], "tokens"))
    wanted = {m: {f"={v}": share for v, share in t.items()} if isinstance(t, Mapping) else t for m, t in targets.items()}
    drawn = cut(calibrate(rake(cells, MARGINS, wanted, rounds), budget).select(*[F.col(m).alias(k) for m, k in keys.items()], "probability"))
    out = rows.join(small(drawn, BROADCAST_CELLS), list(keys.values()))
    sampled = uniform(F.col(f"`{id_col}`")) < F.col("probability")
    return out.select(*[F.col(f"`{c}`") for c in rest], "topic", "n_tokens", "probability", sampled.alias("sampled"))
