"""Wide columns that only some rows need carry them past the windows only on those rows.

Windows see every row but read few columns. Where it is known before them which rows are kept, the other columns
travel in one struct that is null on rows that will go, so shuffles and sorts move a narrow row for those. There is no
second read and no join back, and rows of one id stay apart.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDED = "_late"


def fold(df: DataFrame, needed, kept: Column) -> DataFrame:
    """The ``needed`` columns, and all others in one struct, null where ``kept`` does not hold."""
    needed = [c for c in dict.fromkeys(needed) if c in df.columns]
    late = [c for c in df.columns if c not in needed]
    if not late:
        return df.select(*needed)
    return df.select(*needed, F.when(kept, F.struct(*late)).alias(FOLDED))


def unfold(df: DataFrame) -> DataFrame:
    """``df`` with the folded columns beside the others again; null on rows that were not kept."""
    if FOLDED not in df.columns:
        return df
    return df.select(*[c for c in df.columns if c != FOLDED], f"{FOLDED}.*")
