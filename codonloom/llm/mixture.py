"""Mixing sources to target shares of tokens."""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .tokens import count_tokens

#: Most tokens left to the exact fit after the proportional part of a budget.
FIT = 1 << 18
#: Multiples of the golden ratio are spread evenly between whole numbers.
GOLDEN = 0.6180339887498949
SALTS = 64


def source_key(c: str):
    """Source name without case and outer blanks."""
    return F.lower(F.regexp_replace(F.col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, key, n_tokens`` of every row, written once to the checkpoint folder."""
    rows = docs.select(F.col(id_col).alias("doc_id"), source_key(source_col).alias("key"), F.col(text_col).alias("text"))
    return cut(count_tokens(rows, "text", tokenizer))


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per target source: ``source, key, share, repeats, n_docs, size, total, budget, reachable``.

    ``total`` is the size of the mix in tokens (default: of all documents, listed source or not).
    A source is reachable if its size times its repeats is at least its share of the total.
    Shares or repeats that are null count as 0; of repeated sources the first name (in order of
    text) is used.  Sources without documents have size 0.
    """
    wanted = (
        targets.withColumn("key", source_key("source"))
        .filter("key is not null")
        .groupBy("key")
        .agg(F.min_by(F.struct("source", "target_share", "max_repeats"), "source").alias("t"))
        .select("key", "t.source", F.coalesce("t.target_share", F.lit(0.0)).alias("share"), F.greatest(F.coalesce("t.max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("repeats"))
    )
    by_source = sizes.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("size"))
    # one row a source: grand total over the pre-aggregated sources
    all_of = by_source.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("everything"))
    out = wanted.join(by_source, "key", "left").crossJoin(F.broadcast(all_of))  # one row
    grand = F.lit(total).cast("long") if total is not None else F.col("everything")
    return out.select(
        "source", "key", "share", "repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("size", F.lit(0)).alias("size"), grand.alias("total")
    ).withColumns({"budget": F.round(F.col("share") * F.col("total")).cast("long"), "reachable": F.col("size") * F.col("repeats") >= F.col("share") * F.col("total")})


def _spread_parcels(left: dict[int, int], rest: int) -> list[tuple[int, int]]:
    """``(length, texts)`` in doubling parcels, ordered so that each start of the list holds about
    the same part of every length."""
    out = []
    for at, (n, c) in enumerate(sorted(left.items())):
        used, step, shift = 0, 1, (at + 1) * GOLDEN % 1
        while used < min(c, rest // n):
            k = min(step, min(c, rest // n) - used)
            out.append(((used + shift) / c, n, k))
            used += k
            step *= 2
    return [(n, k) for _, n, k in sorted(out)]


def _fill(rest: int, left: dict[int, int]) -> dict[int, int]:
    """Counts of each length, at most ``left``, whose sum is as near to ``rest`` from below as
    possible: bounded knapsack that keeps, for each sum, the parcel that first reached it."""
    parcels = _spread_parcels(left, rest)
    if not parcels:
        return {}
    reach, first = np.zeros(rest + 1, dtype=bool), np.zeros(rest + 1, dtype=np.int32)
    reach[0] = True
    for at, (n, k) in enumerate(parcels):
        new = np.flatnonzero(reach[: rest + 1 - n * k] & ~reach[n * k :]) + n * k
        reach[new], first[new] = True, at
        if reach[rest]:
            break
    out: dict[int, int] = {}
    goal = int(np.flatnonzero(reach)[-1])
    while goal:
        n, k = parcels[first[goal]]
        out[n] = out.get(n, 0) + k
        goal -= n * k
    return out


def fit_counts(budget: int, counts: dict[int, int]) -> dict[int, int]:
    """How many texts of each length to take so that their sum comes as near to ``budget`` from
    below as possible: the same part of all lengths first, an exact fit for the rest.

    The part is rounded along the lengths from the longest, so it holds at every size and lacks
    less than one text.  The fit draws on all lengths evenly; it gets a 32nd of the budget, and
    more only while the budget is not met: all of it up to ``FIT`` tokens.
    """
    counts = {n: c for n, c in counts.items() if 0 < n <= budget and c > 0}
    size = sum(n * c for n, c in counts.items())
    if not counts or size <= budget:
        return counts
    top = budget - budget % math.gcd(*counts)
    best, most = {}, -1
    for room in sorted({min(FIT, max(1, budget >> s)) for s in (5, 3, 1, 0)}):
        take, before = {}, 0
        for n in sorted(counts, reverse=True):
            take[n] = (before + counts[n]) * (budget - room) // size - before * (budget - room) // size
            before += counts[n]
        rest = top - sum(n * c for n, c in take.items())
        while rest > 4 * FIT:  # less than the longest text is missing: fill by whole texts
            n = max((n for n in counts if counts[n] > take[n] and n <= rest), default=0)
            if not n:
                break
            more = min(counts[n] - take[n], max(1, (rest - FIT) // n))
            take[n] += more
            rest -= more * n
        for n, c in _fill(rest, {n: c - take[n] for n, c in counts.items() if c > take[n]}).items():
            take[n] += c
        got = sum(n * c for n, c in take.items())
        if got > most:
            best, most = take, got
        if got == top:
            break
    while most < top:  # few long texts: exchange one for a longer one
        taken, free = [n for n in counts if best[n]], sorted(n for n in counts if best[n] < counts[n])
        gain, n = max(((free[i - 1] - n, n) for n in taken if (i := bisect.bisect_right(free, n + top - most))), default=(0, 0))
        if gain <= 0:
            break
        best[n], best[n + gain] = best[n] - 1, best[n + gain] + 1
        most += gain
    return {n: c for n, c in best.items() if c}


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """``(chosen, report)``: the mix as documents with copies, and its actual shares.

    Each source gets as many whole rounds of all its documents as its budget holds (at most its
    repeats), then part of one more round: the number of texts of each exact token length that
    fits the rest of the budget best, drawn by seeded hash among the texts of that length.
    chosen: ``doc_id, source, n_tokens, copies`` (copies >= 1).  report: ``source, target_share,
    max_repeats, size, budget, tokens, actual_share, reachable, used_up, missing``; a source that
    cannot reach its share is used as often as allowed: ``used_up`` says that every allowed copy is
    in the mix, ``missing`` how many tokens its share then lacks (0 or less: none).

    Only length counts reach the driver: a source of N tokens has at most sqrt(2 N) lengths.
    Texts of no tokens are never drawn.  Documents of other sources take no part.  Null ids are
    allowed.  Empty tables give empty results.
    """
    spark = sizes.sparkSession
    plan = budgets(sizes, targets, total).collect()  # one row a target source
    lengths = sizes.join(F.broadcast(spark.createDataFrame([(r["key"],) for r in plan], "key string")), "key").groupBy("key", "n_tokens").count().collect()
    counts: dict[str, dict[int, int]] = {}
    for r in lengths:
        counts.setdefault(r["key"], {})[r["n_tokens"]] = r["count"]
    rounds, quota = [], []
    for r in plan:
        whole = min(r["repeats"], r["budget"] // r["size"]) if r["size"] else 0
        rounds.append((r["key"], r["source"], int(whole)))
        if whole < r["repeats"]:
            got = fit_counts(r["budget"] - whole * r["size"], counts.get(r["key"], {}))
            quota += [(r["key"], int(n), int(c)) for n, c in got.items()]
    rounds_df = F.broadcast(spark.createDataFrame(rounds, "key string, source string, rounds long"))
    quota_df = spark.createDataFrame(quota, "key string, n_tokens long, want long")
    rows = sizes.join(rounds_df, "key").withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    before = Window.partitionBy("key", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        rows.groupBy("key", "n_tokens", "salt")
        .count()
        .join(quota_df, ["key", "n_tokens"])
        .withColumn("part", F.greatest(F.lit(0), F.col("want") - F.coalesce(F.sum("count").over(before), F.lit(0))))
        .select("key", "n_tokens", "salt", "part")
    )
    inside = Window.partitionBy("key", "n_tokens", "salt").orderBy("h", "doc_id")
    chosen = (
        rows.join(cells, ["key", "n_tokens", "salt"], "left")
        .withColumn("extra", F.when(F.row_number().over(inside) <= F.coalesce("part", F.lit(0)), 1).otherwise(0))
        .withColumn("copies", F.col("rounds") + F.col("extra"))
        .filter("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    base = spark.createDataFrame(
        [(r["source"], r["share"], r["repeats"], r["size"], r["budget"], bool(r["reachable"]), r["total"]) for r in plan],
        "source string, target_share double, max_repeats long, size long, budget long, reachable boolean, total long",
    )
    used = base.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    everything = used.agg(F.sum("tokens").alias("all_tokens"))
    report = used.crossJoin(F.broadcast(everything)).select(  # one row
        "source", "target_share", "max_repeats", "size", "budget", "tokens", F.round(F.try_divide("tokens", "all_tokens"), 6).alias("actual_share"), "reachable",
        (F.col("tokens") == F.col("size") * F.col("max_repeats")).alias("used_up"), (F.col("target_share") * F.col("total") - F.col("tokens")).alias("missing"),
    )
    return chosen, report
