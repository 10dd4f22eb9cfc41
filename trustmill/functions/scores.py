"""Column functions over logits: probabilities, uncertainty scores and per-row losses. Arrays are upcast to double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(logits: Column | str, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return F.transform(logits, lambda x: x.cast("double") / t)


def softmax(logits: Column | str, temperature: Column | float = 1.0) -> Column:
    z = doubles(logits, temperature)
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / _sum(e))


def msp(probs: Column | str) -> Column:
    """1 - largest probability."""
    return 1 - F.array_max(probs)


def entropy(probs: Column | str) -> Column:
    return -_sum(F.transform(probs, lambda p: p * F.log(p + 1e-12)))


def margin(probs: Column | str) -> Column:
    """1 - (largest - second largest)."""
    s = F.sort_array(probs, asc=False)
    return 1 - (F.get(s, F.lit(0)) - F.get(s, F.lit(1)))


def predicted(logits: Column | str) -> Column:
    """Index of the first largest logit."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def row_nll(logits: Column | str, label: Column | str, temperature: Column | float = 1.0) -> Column:
    z = doubles(logits, temperature)
    label = F.col(label) if isinstance(label, str) else label
    return F.log(_sum(F.transform(z, lambda x: F.exp(x - F.array_max(z))))) + F.array_max(z) - F.get(z, label)


def row_brier(probs: Column | str, label: Column | str) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return _sum(F.transform(probs, lambda p, i: F.pow(p - F.when(i == label, 1.0).otherwise(0.0), F.lit(2.0))))


def mean_abs_difference(a: Column | str, b: Column | str) -> Column:
    """Mean of |a - b| over two arrays of one length."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))
    return _sum(d) / F.nullif(F.size(d).cast("double"), F.lit(0.0))


def class_name(index: Column | str, names: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.col(index) if isinstance(index, str) else index)


#: name -> score of (logits, probabilities, temperature-scaled probabilities); higher is less trustworthy.
UNTRAINED = {"B1 MSP": msp, "B2 Entropy": entropy, "B3 Margin": margin}
