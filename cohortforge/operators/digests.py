"""Row digests: 128 bits that stand for a row where equal rows are looked for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.sources.staging import stage


def row_digest(columns: Sequence[str]) -> Column:
    """MD5 of the columns' texts, each behind its length, NULL apart from any text."""
    def part(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))
    return F.md5(F.concat_ws("|", *[part(c) for c in columns]))


def minus_by_digest(left: DataFrame, right: DataFrame,
                    digest: Callable[[Sequence[str]], Column] = row_digest) -> DataFrame:
    """MINUS (distinct rows of ``left`` not in ``right``, NULLs equal, columns by position).

    Only digests are shuffled to find the rows that may repeat or may be in
    ``right``: equal rows have equal digests, so a row whose digest is held once
    on the left and not on the right is a row of the result as it stands.  The
    others are compared whole, so a digest shared by different rows costs time
    and not correctness.  Both sides are read several times: stage them.
    """
    right = right.toDF(*left.columns)
    marked = left.withColumn("__digest", digest(left.columns))
    other = right.withColumn("__digest", digest(left.columns))
    twice = marked.groupBy("__digest").count().filter("count > 1").select("__digest")
    both = marked.select("__digest").join(other.select("__digest").distinct(), "__digest", "left_semi")
    doubtful = stage(twice.unionByName(both).distinct(), "minus_digests")
    if not doubtful.limit(1).count():
        return left
    sure = marked.join(doubtful, "__digest", "left_anti").select(*left.columns)
    compare = marked.join(doubtful, "__digest", "left_semi").select(*left.columns)
    against = other.join(doubtful, "__digest", "left_semi").select(*left.columns)
    return sure.unionByName(compare.subtract(against))
