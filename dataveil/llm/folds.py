"""Running folds over an array inside a row, in expressions, without copying what is already folded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256


SUM = (lambda a, b: a + b), 0
#: For numbers from 0 on; -1 stands before the first one.
MAX = (lambda a, b: F.greatest(a, b)), -1


def running(df: DataFrame, sources: dict[str, str], rule: tuple[Callable[[Column, Column], Column], int]) -> DataFrame:
    """*df* with a column for each of *sources* (new name: array of whole numbers): of all numbers before each one, their sum or maximum.

    A fold that appends to an array copies it at every step, so numbers are folded in chunks of
    ``CHUNK`` and the chunks' results are folded once more. Every step is a projection of its own, as
    nested lambdas take long to analyse.
    """
    combine, first = rule
    kind = "array<int>"

    def fold(items: Column) -> Column:
        begin = F.struct(F.lit(first).alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(items, begin, lambda acc, x: F.struct(
            combine(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"),
        ))

    def chunks(name: str) -> Column:
        last = F.greatest(F.ceil(F.size(name) / CHUNK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda c: fold(F.slice(name, c * CHUNK + 1, F.lit(CHUNK))))

    parts = df.withColumns({f"_parts_{out}": chunks(name) for out, name in sources.items()})
    starts = parts.withColumns({f"_starts_{out}": fold(F.transform(f"_parts_{out}", lambda p: p["at"]))["out"] for out in sources})
    joined = {out: F.flatten(F.zip_with(f"_parts_{out}", f"_starts_{out}", lambda p, s: F.transform(p["out"], lambda x: combine(s, x).cast("int")))) for out in sources}
    return starts.withColumns(joined).drop(*[f"_{step}_{out}" for out in sources for step in ("parts", "starts")])
