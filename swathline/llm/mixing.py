"""A corpus in which every source has its target share of the tokens.

The documents of a source are counted by exact token length. Its budget is met in three steps: whole passes over
all of its documents; a share of each length, the same for all lengths; and a bounded knapsack over the
remaining counts, which is solved by dynamic programming over the reachable sums (bit sets) for the exact
remainder or, where none exists, the nearest reachable sum. Which documents of a length get an extra use is
decided by a seeded hash; a length that very many documents share is first divided by the hash into parts with
quotas, so that no task ranks all of them.

The whole budget is, unless given, the largest total at which every source that has documents reaches its share
within its repeats; with a larger one the sources that cannot follow stay at their most and the rest is spread
over the others by their shares. Shares of sources without documents are spread in the same way, as no total
could meet them.

The driver holds the counts by (source, length): distinct lengths d take at least d * (d + 1) / 2 tokens, so they
are at most the square root of twice the corpus.

Defined results: documents of no listed source, of source NULL, and without tokens are not used; targets that
are NULL, zero or negative and repeats below one give a source nothing; a source listed twice counts once (its
largest target); an empty corpus gives empty tables; ties are decided by hash, then id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of one (source, length) that a task ranks.
PART_ROWS = 50_000
#: Tokens up to which the knapsack's reach is widened where a budget is not met to the token.
MAX_REACH = 1 << 24


@dataclass
class Plan:
    """Uses of a source's documents: ``passes`` for all, one more for ``extra[length]`` of them."""

    source: str
    share: float
    repeats: int
    budget: int
    passes: int
    extra: dict[int, int]
    tokens: int


def budgets(size: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: int | None) -> dict[str, int]:
    """Token budgets of the sources (those with documents only)."""
    most = {s: size[s] * repeats[s] for s in share if size.get(s) and share[s] > 0 and repeats[s] >= 1}
    if not most:
        return {}
    scale = sum(share[s] for s in most)
    part = {s: share[s] / scale for s in most}
    if total is None:
        total = int(min(most[s] / part[s] for s in most))
    out: dict[str, int] = {}
    open_, left = set(most), min(total, sum(most.values()))
    while open_:
        scale = sum(part[s] for s in open_)
        full = {s for s in open_ if part[s] / scale * left >= most[s]}
        if not full:
            out |= {s: round(part[s] / scale * left) for s in open_}
            break
        out |= {s: most[s] for s in full}
        left -= sum(most[s] for s in full)
        open_ -= full
    return out


def fit(counts: dict[int, int], budget: int) -> tuple[dict[int, int], int]:
    """How many documents of each length to take so that their lengths sum to ``budget``, or as near as can be."""
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(k)] for k in lengths], np.int64)
    whole = int((lengths * n).sum())
    if budget >= whole:
        return dict(zip(lengths.tolist(), n.tolist(), strict=True)), whole
    longest = int(lengths[-1])
    best: tuple[np.ndarray, int] | None = None
    reach = 2 * longest + 64
    while True:
        take, got = _fit(lengths, n, whole, budget, reach)
        if best is None or abs(got - budget) < abs(best[1] - budget):
            best = take, got
        if best[1] == budget or reach >= budget or reach >= MAX_REACH:
            break
        reach *= 8
    take, got = best
    return {int(k): int(c) for k, c in zip(lengths, take, strict=True) if c}, got


def _fit(lengths: np.ndarray, n: np.ndarray, whole: int, budget: int, reach: int) -> tuple[np.ndarray, int]:
    """One attempt: an equal share of every length, then a knapsack over sums up to about ``reach``."""
    longest = int(lengths[-1])
    reserve = min(budget, reach + 2 * longest + int(lengths.sum()))
    take = np.floor(n * ((budget - reserve) / whole)).astype(np.int64)
    rest = budget - int((take * lengths).sum())
    # Down to the reach of the knapsack, from the longest, at first at most half of what is left of each length.
    for half in (2, 1):
        for i in range(len(lengths) - 1, -1, -1):
            if rest <= reach:
                break
            k = min(int(n[i] - take[i] + half - 1) // half, (rest - reach) // int(lengths[i]) + 1, rest // int(lengths[i]))
            take[i] += max(0, k)
            rest -= max(0, k) * int(lengths[i])
    # Bounded knapsack: bit b of ``can`` says that b tokens can be reached; counts by powers of two.
    limit = rest + longest
    mask = (1 << (limit + 1)) - 1
    stages: list[tuple[int, int, int]] = []
    can = 1
    for i in range(len(lengths)):
        free, power = int(n[i] - take[i]), 1
        while free > 0 and not can >> rest & 1:
            k = min(power, free)
            if k * int(lengths[i]) > limit:
                k = limit // int(lengths[i])
                free = min(free, k)
                if k == 0:
                    break
            stages.append((i, k, can))
            can |= can << (k * int(lengths[i])) & mask
            free -= k
            power *= 2
        if can >> rest & 1:
            break
    below = (can & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = can >> rest
    up = rest + ((above & -above).bit_length() - 1) if above else None
    goal = up if up is not None and up - rest < rest - below else below
    at = goal
    for i, k, before in reversed(stages):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    return take, int((take * lengths).sum())


def plans(counts: dict[str, dict[int, int]], share: dict[str, float], repeats: dict[str, int], total: int | None = None) -> list[Plan]:
    size = {s: sum(k * c for k, c in by.items()) for s, by in counts.items()}
    out = []
    for s, budget in sorted(budgets(size, share, repeats, total).items()):
        passes = min(repeats[s], budget // size[s])
        extra, more = ({}, 0) if passes == repeats[s] else fit(counts[s], budget - passes * size[s])
        out.append(Plan(s, share[s], repeats[s], budget, passes, extra, passes * size[s] + more))
    return out


def mix(lengths: DataFrame, doc: str, source: str, n_tokens: str, targets: DataFrame, total: int | None = None, seed: int = 7, part_rows: int = PART_ROWS) -> tuple[DataFrame, list[Plan]]:
    """Used documents (doc, source, n_tokens, uses) and the plans of the sources.

    ``lengths`` is read three times: give a table or a checkpoint, not a query that tokenizes.
    """
    spark = lengths.sparkSession
    target = targets.where("target_share > 0 AND max_repeats >= 1 AND source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()  # one row per source
    share, repeats = {r["source"]: float(r["share"]) for r in target}, {r["source"]: int(r["repeats"]) for r in target}
    docs = lengths.select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.col(n_tokens).cast("bigint").alias("n")).where((F.col("n") > 0) & F.col("source").isin(list(share)))
    counts: dict[str, dict[int, int]] = {}
    for r in docs.groupBy("source", "n").count().collect():
        counts.setdefault(r["source"], {})[r["n"]] = r["count"]
    made = plans(counts, share, repeats, total)
    rows = []
    big = [(p.source, k, counts[p.source][k]) for p in made for k in p.extra if counts[p.source][k] > part_rows and p.extra[k] < counts[p.source][k]]
    hash_ = F.xxhash64("doc", F.lit(seed))
    quota = {(p.source, k): c for p in made for k, c in p.extra.items()}
    parts: dict = {}
    divided: dict = {}
    if big:
        n_parts = spark.createDataFrame([(s, k, -(-c // part_rows)) for s, k, c in big], "p_source string, p_n bigint, parts int")
        held = docs.join(n_parts, (F.col("source") == F.col("p_source")) & (F.col("n") == F.col("p_n"))).groupBy("source", "n", F.pmod(hash_, "parts").cast("int").alias("part")).count()
        for r in held.orderBy("source", "n", "part").collect():
            left = quota[(r["source"], r["n"])] - sum(parts.get((r["source"], r["n"]), {}).values())
            parts.setdefault((r["source"], r["n"]), {})[r["part"]] = min(r["count"], left)
    divided = {(s, k): -(-c // part_rows) for s, k, c in big}
    for p in made:
        for k in counts[p.source]:
            cut = parts.get((p.source, k))
            for part, c in (cut or {0: p.extra.get(k, 0)}).items():
                rows.append((p.source, k, part, divided.get((p.source, k), 1), p.passes, c, int(c >= counts[p.source][k])))
    schema = "t_source string, t_n bigint, t_part int, t_parts int, passes int, quota bigint, everyone int"
    table = spark.createDataFrame(rows, schema)
    n_of = table.groupBy(F.col("t_source").alias("m_source"), F.col("t_n").alias("m_n")).agg(F.max("t_parts").alias("parts"))
    placed = docs.join(n_of, (F.col("source") == F.col("m_source")) & (F.col("n") == F.col("m_n"))).withColumn("hash", hash_)
    placed = placed.withColumn("part", F.pmod("hash", "parts").cast("int"))
    placed = placed.join(table, (F.col("source") == F.col("t_source")) & (F.col("n") == F.col("t_n")) & (F.col("part") == F.col("t_part")))
    # Only parts of which some but not all documents get one more use need a ranking.
    some = (F.col("quota") > 0) & (F.col("everyone") == 0)
    ranked = placed.where(some).withColumn("rank", F.row_number().over(Window.partitionBy("source", "n", "part").orderBy("hash", "doc")))
    ranked = ranked.withColumn("uses", F.col("passes") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0))
    plain = placed.where(~some).withColumn("uses", F.col("passes") + F.when(F.col("quota") > 0, 1).otherwise(0))
    cols = [F.col("doc").alias(doc), "source", F.col("n").alias("n_tokens"), F.col("uses").cast("int").alias("uses")]
    return plain.select(*cols).unionByName(ranked.select(*cols)).where("uses > 0"), made


def report(used: DataFrame, targets: DataFrame) -> DataFrame:
    """Actual shares: source, target_share, max_repeats, documents, most_uses, tokens, actual_share."""
    real = used.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"))
    real = real.withColumnRenamed("source", "_s")
    out = targets.select("source", "target_share", "max_repeats").join(real, F.col("source") == F.col("_s"), "left")
    out = out.select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    whole = out.agg(F.sum("tokens").alias("all"))
    # One row against one row per source.
    return out.join(F.broadcast(whole), F.lit(True)).withColumn("actual_share", F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).otherwise(F.lit(0.0))).drop("all")
