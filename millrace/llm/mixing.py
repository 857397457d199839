"""Mixing sources to target weights (problem 9).

Temperature mixing exponentiates the sources' own token shares, normalises them, and bisects the exponent until the weights have a
wanted entropy or no source is repeated beyond its limit (`temperature_weights`, `tempered`). That family has one degree of freedom,
so it can't meet a target for each source; where targets are given (`plan_mix`), each source gets its target part of the total, or as
much as its repeats allow. Either kind of weights is realised as budgeted block permutations: a source's documents are put in random
order block by block, whole passes first, and the last pass ends where the budget does.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tokens import count_tokens
from millrace.session import durable

#: Rows of a block, within which documents are sorted; a large source has many blocks, so no task holds all of it.
BLOCK_ROWS = 50_000


#: The largest exponent tried; beyond it only the largest sources have weight.
MOST_EXPONENT = 4096.0


def _entropy(weights: list[float]) -> float:
    return -sum(x * math.log(x) for x in weights if x > 0)


def temperature_weights(shares: list[float], entropy: float | None = None, limits: list[float] | None = None, steps: int = 80) -> tuple[float, list[float]]:
    """The exponent a and the normalised weights share**a / sum(share**a), found by bisection.

    With `entropy` (nats): the exponent, from 0 (uniform) up, whose weights have that entropy. With `limits` (the largest weight allowed for
    each source): the smallest exponent between 0 and 1 (as they are), so the most even mix, at which no weight is beyond its limit.
    Shares of 0 keep weight 0, and without any other the exponent is 0. A target that no exponent meets is a ValueError.
    """
    most = max(shares, default=0.0)
    if most <= 0:
        return 0.0, [0.0] * len(shares)

    def weights(a: float) -> list[float]:
        w = [(s / most) ** a if s > 0 else 0.0 for s in shares]
        total = sum(w)
        return [x / total for x in w]

    def small_enough(a: float) -> bool:
        if entropy is not None:
            return _entropy(weights(a)) <= entropy
        return all(x <= m + 1e-12 for x, m in zip(weights(a), limits or [1.0] * len(shares)))

    if entropy is not None and _entropy(weights(0.0)) < entropy - 1e-9:
        raise ValueError(f"no exponent gives an entropy of {entropy}: the most is {_entropy(weights(0.0))}")
    if small_enough(0.0):
        return 0.0, weights(0.0)
    lo, hi = 0.0, 1.0
    while entropy is not None and not small_enough(hi) and hi < MOST_EXPONENT:
        lo, hi = hi, 2 * hi
    if not small_enough(hi):
        if entropy is not None and _entropy(weights(hi)) <= entropy + 1e-6:
            return hi, weights(hi)
        raise ValueError("no exponent meets the target")
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if small_enough(mid) else (mid, hi)
    return hi, weights(hi)


def source_sizes(sized: DataFrame) -> DataFrame:
    """Tokens and documents of each source, of documents with at least one token: source, tokens, docs."""
    return sized.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").cast("bigint").alias("tokens"), F.count("*").alias("docs"))


def plan_mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """What each source gives to each mix.

    `targets`: mix_name, source, target_share, max_repeats. The total of a mix is `total_tokens`, or the tokens of its
    sources counted once. A source gives its share of the total, or max_repeats times its own tokens if that is less;
    what it lacks is not put on others, as that would move them further from their targets.

    Columns: mix_name, source, target_share, max_repeats, tokens (the source's own), docs, total (of the mix), budget, passes (whole ones),
    rest (tokens of the last pass). Sources without documents have budget 0. A repeated row of `targets` counts once; null or negative shares and
    repeats count as 0; a null source is never matched.
    """
    t = targets.select("mix_name", "source", F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats")).distinct()
    both = t.join(sizes, "source", "left").na.fill(0, ["tokens", "docs"])
    whole = both.groupBy("mix_name").agg(F.sum("tokens").alias("_total"))
    both = both.join(whole, "mix_name")
    total = F.lit(total_tokens).cast("bigint") if total_tokens is not None else F.col("_total")
    budget = F.least(F.col("max_repeats") * F.col("tokens"), F.round(F.col("target_share") * F.col("total")).cast("bigint"))
    return (
        both.withColumn("total", total).withColumn("budget", budget)
        .withColumn("passes", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("bigint"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
        .drop("_total")
    )


def permuted(sized: DataFrame, sizes: DataFrame, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """Each document with `starts`, the tokens before it in its source's block permutation: key, source, n_tokens, block, starts.

    A block is chosen by a hash, so a source of any size is sorted in parts of about BLOCK_ROWS rows.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    d = sized.filter("n_tokens > 0").join(sizes.select("source", F.ceil(F.col("docs") / BLOCK_ROWS).alias("_blocks")), "source")
    d = d.withColumn("block", F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.col("_blocks"))).withColumn("_h", h)
    inside = Window.partitionBy("source", "block").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = d.groupBy("source", "block").agg(F.sum("n_tokens").alias("_size"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select("source", "block", (F.sum("_size").over(upto) - F.col("_size")).alias("_before"))
    d = d.withColumn("_within", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return d.join(blocks, ["source", "block"]).select(key, "source", "n_tokens", "block", (F.col("_before") + F.col("_within")).alias("starts"))


def realise(order: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mixes: mix_name, source, key, n_tokens, block, repeats (at least 1).

    A document is in the last pass if at least half of it is within what remains of the budget, so a source misses its budget by half
    a document at most, and no document is repeated more often than max_repeats.
    """
    p = plan.filter("budget > 0").select("mix_name", "source", "passes", "rest", "max_repeats")
    last = (F.col("starts") + F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("passes") < F.col("max_repeats"))
    return (
        order.join(p, "source")
        .withColumn("repeats", F.col("passes") + F.when(last, 1).otherwise(0))
        .filter("repeats > 0")
        .select("mix_name", "source", key, "n_tokens", "block", "repeats")
    )


def mix_documents(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", total_tokens: int | None = None, seed: int = 7, sized: DataFrame | None = None, weights: str = "targets") -> tuple[DataFrame, DataFrame]:
    """The mixes of `targets` over `docs`, and the report of their shares.

    Sizes are tokens of byte_bpe_50k. Null, empty and tokenless texts take no part; a document with a null source neither. Repeated rows
    are documents of their own; equal places in the permutation fall to the smaller key; an empty table gives no documents and a report
    with zero tokens; other columns are not read. The report has one row for each row of `targets`: mix_name, source, target_share,
    max_repeats, available_tokens, planned_tokens, actual_tokens, actual_share (of the mix's actual total), share_of_total (of the total that
    was wanted), undelivered_tokens (what the source lacks of its target part of that), documents, most_repeats.

    weights="targets" takes the shares of `targets`; "entropy" and "limits" take the tempered ones (`tempered`) instead.
    """
    sized = durable(count_tokens(docs, [key, "source"], text), "sized") if sized is None else sized
    sizes = source_sizes(sized)
    plan = plan_mix(sizes, targets, total_tokens)
    if weights != "targets":
        plan = plan_mix(sizes, tempered(plan, weights), total_tokens)
    mixed = realise(permuted(sized, sizes, key, seed), plan, key)
    done = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = done.groupBy("mix_name").agg(F.sum("actual_tokens").alias("_all"))
    report = (
        plan.join(done, ["mix_name", "source"], "left").join(whole, "mix_name", "left").na.fill(0, ["actual_tokens", "documents", "most_repeats"])
        .select("mix_name", "source", "target_share", "max_repeats", F.col("tokens").alias("available_tokens"), F.col("budget").alias("planned_tokens"), "actual_tokens",
                F.when(F.col("_all") > 0, F.round(F.col("actual_tokens") / F.col("_all"), 6)).otherwise(0.0).alias("actual_share"),
                F.when(F.col("total") > 0, F.round(F.col("actual_tokens") / F.col("total"), 6)).otherwise(0.0).alias("share_of_total"),
                (F.round(F.col("target_share") * F.col("total")).cast("bigint") - F.col("actual_tokens")).alias("undelivered_tokens"), "documents", "most_repeats")
    )
    return mixed, report


def _solved(pdf: pd.DataFrame, by: str) -> tuple[float | None, list[float | None]]:
    """The exponent and weights of one mix; None where no exponent meets its target."""
    able = [t if r > 0 else 0 for t, r in zip(pdf["tokens"], pdf["max_repeats"])]
    whole = sum(able)
    share = [t / whole if whole else 0.0 for t in able]
    try:
        if by == "limits":
            return temperature_weights(share, limits=[s * r for s, r in zip(share, pdf["max_repeats"])])
        aim = [t for t, s in zip(pdf["target_share"], share) if s > 0 and t > 0]
        return temperature_weights(share, entropy=_entropy([t / sum(aim) for t in aim]))
    except ValueError:
        return None, [None] * len(share)


def tempered(plan: DataFrame, by: str = "entropy") -> DataFrame:
    """The targets of `plan` (from `plan_mix`) with target_share replaced by tempered, normalised weights: mix_name, source, target_share, max_repeats.

    by="entropy": weights of the entropy that the targets of the sources that have documents have; by="limits": the most even weights that
    repeat no source beyond its limit, for a total of the sources' own tokens. A mix whose target no exponent meets is an error.
    """
    if by not in ("entropy", "limits"):
        raise ValueError("by entropy or by limits")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, w = _solved(pdf, by)
        if a is None:
            raise ValueError(f"no exponent meets the {by} of the mix {pdf['mix_name'].iloc[0]}")
        return pdf[["mix_name", "source", "max_repeats"]].assign(target_share=w)

    return plan.groupBy("mix_name").applyInPandas(solve, "mix_name string, source string, max_repeats int, target_share double").select("mix_name", "source", "target_share", "max_repeats")


def temperatures(plan: DataFrame) -> DataFrame:
    """For each mix, the exponents of temperature mixing: mix_name, source, share, entropy_exponent, entropy_weight, limit_exponent, limit_weight.

    What `tempered` says of "entropy" and "limits", with null where no exponent meets the target. A mix is a few rows of a table of
    settings, so each is one group.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf["tokens"].sum()
        (a, w), (b, v) = _solved(pdf, "entropy"), _solved(pdf, "limits")
        return pd.DataFrame({"mix_name": pdf["mix_name"], "source": pdf["source"], "share": [t / total if total else 0.0 for t in pdf["tokens"]], "entropy_exponent": a, "entropy_weight": w, "limit_exponent": b, "limit_weight": v}).astype(
            {c: "float64" for c in ("entropy_exponent", "entropy_weight", "limit_exponent", "limit_weight")}
        )

    return plan.groupBy("mix_name").applyInPandas(solve, "mix_name string, source string, share double, entropy_exponent double, entropy_weight double, limit_exponent double, limit_weight double")
