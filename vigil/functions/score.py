"""Scores, severities and first-come selection of candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions import fixed


def first_by_token(candidates: Column) -> Column:
    """Of candidates with the same token only the first, in order."""
    tokens = F.transform(candidates, lambda c: c["token"])
    return F.filter(candidates, lambda c, i: ~F.array_contains(F.slice(tokens, F.lit(1), i), c["token"]))


def score(c: Column, bits: Column, threshold: float = fixed.ENTROPY_THRESHOLD) -> Column:
    """Sum of the signals' weights. Sums of logarithms differ in the last bit
    between engines, so the threshold is met within 1e-9."""
    weight = lambda flag, points: F.when(flag, points).otherwise(0)
    return (
        weight(c["keyword"], 3)
        + weight(bits >= threshold - 1e-9, 3)
        + weight(c["size"] >= 20, 2)
        + weight(c["auth_header"], 2)
        + weight(c["credential_url"], 2)
        + weight(c["known_format"], 4)
        + weight(c["private_key"], 6)
        + weight(c["search"], -2)
        + weight(c["placeholder"], -3)
    )


def severity(points: Column) -> Column:
    """Rank from 0 (ignore) to 3 (high)."""
    return F.when(points <= 2, 0).when(points <= 4, 1).when(points <= 6, 2).otherwise(3)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 3, "high").when(rank == 2, "medium").when(rank == 1, "low").otherwise("ignore")


def scored(candidates: Column, bits: Column, threshold: float = fixed.ENTROPY_THRESHOLD) -> Column:
    """Structs (token, det_type, entropy, score, severity_rank) of candidates
    and the entropies of their tokens. Keys have none."""

    def measured(c: Column, own: Column) -> Column:
        return F.struct(c.alias("c"), F.when(c["private_key"], F.lit(0.0)).otherwise(own).alias("bits"))

    def pointed(m: Column) -> Column:
        return F.struct(m["c"]["token"].alias("token"), m["c"]["det_type"].alias("det_type"), m["bits"].alias("entropy"), score(m["c"], m["bits"], threshold).alias("score"))

    def ranked(s: Column) -> Column:
        return F.struct(s["token"].alias("token"), s["det_type"].alias("det_type"), s["entropy"].alias("entropy"), s["score"].alias("score"), severity(s["score"]).alias("severity_rank"))

    return F.transform(F.transform(F.zip_with(candidates, bits, measured), pointed), ranked)
