"""Expressions over ``array<double>`` columns: lag polynomials and their expansions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Longest expansion done with higher-order functions; beyond it a vectorised Arrow function is cheaper.
HOF_TERMS = 200


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def let(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` over ``values`` that are evaluated once per row.

    Without it the optimizer may merge projections and repeat a costly expression inside a lambda,
    once per element.
    """
    bound = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(bound, lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Inner product; the longer array is cut to the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y)
    return F.aggregate(products, _zero(), lambda s, x: s + x)


def poly_product(a: Column, b: Column) -> Column:
    """Coefficients of the product of two polynomials given by coefficient arrays (lag 0 first)."""
    return let(_poly_product, a, b)


def _poly_product(a: Column, b: Column) -> Column:
    na, nb = F.size(a), F.size(b)
    zero = F.lit(0)

    def term(k: Column) -> Column:
        lags = F.sequence(F.greatest(zero, k - nb + 1), F.least(k, na - 1))
        return F.aggregate(lags, _zero(), lambda s, i: s + F.get(a, i) * F.get(b, k - i))

    return F.transform(F.sequence(zero, na + nb - 2), term)


def lag_poly(coefs: Column, stride: Column, sign: float) -> Column:
    """1 + sign * (c_1 B^stride + c_2 B^(2 stride) + ...)."""
    one = F.array(F.lit(1.0))
    gap = F.array_repeat(_zero(), stride - 1)
    return F.aggregate(
        coefs, one, lambda acc, c: F.concat(acc, gap, F.array(c * F.lit(sign)))
    )


def difference_poly(stride: Column, times: Column) -> Column:
    """(1 - B^stride)^times."""
    return let(
        lambda factor: F.aggregate(
            F.array_repeat(F.lit(1), times), F.array(F.lit(1.0)), lambda acc, _: _poly_product(acc, factor)
        ),
        lag_poly(F.array(F.lit(1.0)), stride, -1.0),
    )


def _series_ratio_hof(num: Column, den: Column, terms: int) -> Column:
    def extend(acc: Column, j: Column) -> Column:
        # acc runs from the newest term to the oldest, next to den_1, den_2, ...
        reach = F.least(F.size(den) - 1, j)
        carried = dot(F.slice(den, 2, reach), F.slice(acc, 1, reach))
        return F.concat(F.array(F.coalesce(F.get(num, j), _zero()) - carried), acc)

    return F.reverse(F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.array(F.lit(1.0)), extend))


def append_array(df: DataFrame, name: str, compute: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Add an ``array<double>`` column computed from Arrow batches; other columns pass through as
    they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(compute(batch), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema)


def list_rows(column: pa.Array) -> list[np.ndarray | None]:
    """The arrays of a list column as views of its flat values; a null element is NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [flat[a:b] if v else None for a, b, v in zip(ends[:-1], ends[1:], valid)]


def _stack(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, values in enumerate(rows):
        out[k, : min(len(values), width)] = values[:width]
    return out


def _ratio_of_batch(nums: list, dens: list, terms: int) -> list:
    """The recursion of all rows of a batch, as many together as about 32 MB hold."""
    step = max(1, 4_000_000 // (terms + 1))
    if len(nums) > step:
        parts = (_ratio_of_batch(nums[k : k + step], dens[k : k + step], terms) for k in range(0, len(nums), step))
        return [row for part in parts for row in part]
    known = [k for k, (a, b) in enumerate(zip(nums, dens)) if a is not None and b is not None]
    a = _stack([nums[k] for k in known], terms + 1)
    b = _stack([dens[k] for k in known], max((len(dens[k]) for k in known), default=1))
    q = b.shape[1] - 1
    r = np.zeros_like(a)
    r[:, :1] = 1.0
    for j in range(1, terms + 1):
        k = min(q, j)
        r[:, j] = a[:, j] - (b[:, 1 : k + 1] * r[:, j - k : j][:, ::-1]).sum(axis=1)
    out = [None] * len(nums)
    for row, k in zip(r, known):
        out[k] = row
    return out


def add_series_ratio(df: DataFrame, num: str, den: str, terms: int, name: str) -> DataFrame:
    """Add the first ``terms + 1`` coefficients of num(B)/den(B), two polynomials that start with 1."""
    if terms <= HOF_TERMS:
        ratio = let(lambda n, d: _series_ratio_hof(n, d, terms), F.col(num), F.col(den))
        return df.withColumn(name, F.when(F.col(num).isNotNull() & F.col(den).isNotNull(), ratio))
    columns = lambda batch: [list_rows(batch.column(c)) for c in (num, den)]
    return append_array(df, name, lambda batch: _ratio_of_batch(*columns(batch), terms))
