"""Preference-tuning arithmetic over logit arrays.

All figures are element-wise over positions and vocabulary entries, padding and prompt
included: no gathering of the target token and no sum per sequence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_softmax(logits: Column) -> Column:
    """Shifted by the largest logit, so large values do not overflow.

    What a lambda needs beyond its own element is bound to a struct field first: anything
    else in a lambda is computed again for every element.
    """

    def shift(row: Column) -> Column:
        return F.struct(F.transform(row.x, lambda x: x - row.top).alias("x"))

    def normalise(row: Column) -> Column:
        total = F.aggregate(row.x, F.lit(0.0), lambda acc, x: acc + F.exp(x))
        return F.struct(row.x.alias("x"), F.log(total).alias("log_total"))

    bound = F.array(F.struct(logits.alias("x"), F.array_max(logits).alias("top")))
    scaled = F.transform(F.transform(bound, shift), normalise)
    result = F.transform(scaled, lambda r: F.transform(r.x, lambda x: x - r.log_total))
    return F.get(result, F.lit(0))


def relative_logprob(policy: Column, reference: Column) -> Column:
    """Log-probabilities of the policy minus those of the reference model."""
    return F.zip_with(policy, reference, lambda p, r: p - r)


SUMS_TYPE = "struct<elements:bigint,loss:double,chosen:double,rejected:double,accurate:double>"
SUM_NAMES = ("loss", "chosen", "rejected", "accurate")


def _flat_log_softmax(logits: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    shifted = logits - np.repeat(np.maximum.reduceat(logits, starts), sizes)
    totals = np.add.reduceat(np.exp(shifted), starts)
    return shifted - np.repeat(np.log(totals), sizes)


def preference_sums(
    chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float
) -> Column:
    """Per-row sums over the elements of one position, from its four logit arrays.

    Sums and a count rather than means: they add up across rows, so the overall figures
    need one partial aggregate and no exploded elements. The arithmetic runs on whole
    Arrow batches, since lambdas take about ten times as long for arrays of vocabulary
    length. Rows with a null array give null.
    """

    @F.arrow_udf(SUMS_TYPE)
    def sums(c: pa.Array, r: pa.Array, rc: pa.Array, rr: pa.Array) -> pa.Array:
        columns = [c, r, rc, rr]
        usable = np.logical_and.reduce([a.is_valid().to_numpy(zero_copy_only=False) for a in columns])
        kept = [a.filter(pa.array(usable)) for a in columns]
        sizes, *others = [pc.list_value_length(a).to_numpy(zero_copy_only=False) for a in kept]
        if any((sizes != other).any() for other in others):
            raise ValueError("the logit arrays of a row differ in length")

        result = {name: np.zeros(len(usable)) for name in SUM_NAMES}
        elements = np.zeros(len(usable), dtype=np.int64)
        elements[usable] = sizes
        filled = elements > 0
        if filled.any():
            counts = elements[filled]
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            probs = [
                _flat_log_softmax(
                    a.flatten().to_numpy(zero_copy_only=False).astype(np.float64), starts, counts
                )
                for a in kept
            ]
            better, worse = probs[0] - probs[2], probs[1] - probs[3]
            u = (better - worse) * beta
            by_element = {
                "loss": np.maximum(-u, 0.0) + np.log1p(np.exp(-np.abs(u))),
                "chosen": better,
                "rejected": worse,
                "accurate": (better > worse).astype(np.float64),
            }
            for name, values in by_element.items():
                result[name][filled] = np.add.reduceat(values, starts)
        arrays = [pa.array(elements), *[pa.array(result[name]) for name in SUM_NAMES]]
        return pa.StructArray.from_arrays(
            arrays, names=["elements", *SUM_NAMES], mask=pa.array(~usable)
        )

    return sums(chosen, rejected, ref_chosen, ref_rejected)
