"""Mixing sources to target weights under a cap on repeats."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.sizes import label, salted_rank, token_count
from folioscan.runtime import broadcast_if_small, durable

#: Tokens of a budget that are fitted exactly; what lies above is taken in proportion and then by large lengths.
DP_WINDOW = 16_384


def subset_sum(lengths: list[int], counts: list[int], target: int) -> dict[int, int]:
    """Times to take each length, at most its count, for the largest sum of at most target.

    Bounded knapsack over reachable sums; ends as soon as target is reached.
    """
    came = np.zeros(target + 1, dtype=np.int64)
    reached = np.zeros(target + 1, dtype=bool)
    reached[0] = True
    for length, count in zip(lengths, counts):
        if length <= 0 or length > target:
            continue
        fresh = reached.copy()
        for _ in range(min(count, target // length)):
            shifted = np.zeros_like(reached)
            shifted[length:] = fresh[:-length]
            fresh = shifted & ~reached
            if not fresh.any():
                break
            reached |= fresh
            came[fresh] = length
        if reached[target]:
            break
    at = int(np.flatnonzero(reached)[-1])
    out: dict[int, int] = {}
    while at:
        step = int(came[at])
        out[step] = out.get(step, 0) + 1
        at -= step
    return out


def fit_budget(lengths: list[int], counts: list[int], budget: int, window: int = DP_WINDOW) -> dict[int, int]:
    """Documents to take of each length so that their tokens come as near to budget from below as they can.

    A share of every length, then the largest lengths down to the window, then
    an exact bounded subset sum of the rest. Of a rest over 16 windows, the
    largest documents that fit are taken first. The last
    step is the best of all choices of the documents that are left; the steps before
    it are not tried in other ways.
    """
    total = sum(a * b for a, b in zip(lengths, counts))
    if budget >= total:
        return dict(zip(lengths, counts))
    keep = {n: c * max(0, budget - window) // total for n, c in zip(lengths, counts)}
    left = budget - sum(n * c for n, c in keep.items())
    for n, c in sorted(zip(lengths, counts), reverse=True):
        if left <= window:
            break
        if n > 0:
            more = min(c - keep[n], max(0, (left - window // 2) // n))
            keep[n] += more
            left -= n * more
    for n, c in sorted(zip(lengths, counts), reverse=True):
        if left <= 16 * window:
            break
        if n > 0:
            more = min(c - keep[n], left // n)
            keep[n] += more
            left -= n * more
    spare = sorted(((n, c - keep[n]) for n, c in zip(lengths, counts) if n > 0 and c > keep[n]), reverse=True)
    for n, c in subset_sum([n for n, _ in spare], [c for _, c in spare], min(left, 16 * window)).items():
        keep[n] += c
    return keep


class SourceMix:
    """A mix of documents in which each source has its target share of all tokens.

    The budget of a source is its target share of the tokens of all documents,
    with or without a source. A source is used whole as often as fits, at most
    max_repeats times, and what is left of the budget comes from documents
    chosen by a seeded order within each exact length. Labels are compared
    trimmed and lower-cased; repeated target rows of one label count once, with
    the larger share. Null ids have no tokens in the mix.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, seed: int = 17):
        self.seed = seed
        self.sizes = durable(
            docs.where(F.col(id_col).isNotNull()).select(
                F.col(id_col).alias("id"), label(F.col(source_col)).alias("source"), token_count(F.col(text_col)).alias("n_tokens")
            ),
            "mix-sizes",
        )
        self.targets = (
            targets.select(label(F.col("source")).alias("source"), "target_share", "max_repeats")
            .where(F.col("source").isNotNull() & F.col("target_share").isNotNull())
            .groupBy("source")
            .agg(F.max("target_share").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
        )
        self.hist = durable(self.sizes.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs")), "mix-lengths")
        sums = self.hist.agg(F.sum(F.col("docs") * F.col("n_tokens")), F.sum("docs")).first()
        self.total, self.rows = int(sums[0] or 0), int(sums[1] or 0)
        self.plan = durable(self._plan(), "mix-plan")

    def _plan(self) -> DataFrame:
        """(source, n_tokens, docs, repeats, extra): every document of the source comes repeats times, extra of them once more."""
        total = self.total

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            lengths, counts = pdf["n_tokens"].tolist(), pdf["docs"].tolist()
            own = sum(a * b for a, b in zip(lengths, counts))
            budget = int(pdf["target_share"].iloc[0] * total)
            most = max(0, int(pdf["max_repeats"].iloc[0]))
            repeats = min(most, budget // own) if own else 0
            extra = fit_budget(lengths, counts, budget - repeats * own) if own and repeats < most else {}
            return pd.DataFrame(
                {"source": pdf["source"], "n_tokens": lengths, "docs": counts, "repeats": repeats, "extra": [extra.get(n, 0) for n in lengths]}
            )

        # A source's group has one row for each distinct length, however many documents it holds.
        joined = self.hist.where("source is not null").join(broadcast_if_small(self.targets), "source")
        return joined.groupBy("source").applyInPandas(fit, "source string, n_tokens long, docs long, repeats long, extra long")

    def shares(self) -> DataFrame:
        """One row per target: (source, target_share, max_repeats, available_tokens, budget_tokens, used_tokens, actual_share, short)."""
        own = self.plan.groupBy("source").agg(
            F.sum(F.col("docs") * F.col("n_tokens")).alias("available_tokens"),
            F.sum(F.col("n_tokens") * (F.col("docs") * F.col("repeats") + F.col("extra"))).alias("used_tokens"),
        )
        all_used = max(1, int(own.agg(F.sum("used_tokens")).first()[0] or 0))
        budget = F.col("target_share") * F.lit(float(self.total))
        zero = F.lit(0).cast("long")
        return self.targets.join(own, "source", "left").select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("available_tokens", zero).alias("available_tokens"),
            budget.alias("budget_tokens"),
            F.coalesce("used_tokens", zero).alias("used_tokens"),
            (F.coalesce("used_tokens", zero) / F.lit(float(all_used))).alias("actual_share"),
            (F.col("max_repeats") * F.coalesce("available_tokens", zero) < budget).alias("short"),
        )

    def documents(self) -> DataFrame:
        """(id, source, n_tokens, times): the documents of the mix and how often each comes."""
        ranked = salted_rank(
            self.sizes.where("source is not null").withColumn("_h", F.xxhash64(F.lit(self.seed), "id")),
            ["source", "n_tokens"],
            ["_h", "id"],
            self.rows,
        )
        picked = ranked.join(self.plan.select("source", "n_tokens", "repeats", "extra"), ["source", "n_tokens"])
        times = F.col("repeats") + (F.col("rank") < F.col("extra")).cast("long")
        return picked.select("id", "source", "n_tokens", times.alias("times")).where("times > 0")
