"""Help with plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` as computed once for each row.

    A filter or a later expression is otherwise merged into the ones below it, which would then run
    again for each of its references, inside a lambda even for each element. Nothing is merged
    through a generator.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))
