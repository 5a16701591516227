"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.session import ship

#: Folder of the public tokenizers' vocabulary files, on every machine.
TOKENIZERS = "/opt/tokenizers"


def spread(df: DataFrame) -> DataFrame:
    """``df``, about to go through Python workers, over at least as many partitions as the cluster has cores. Only a frame that has fewer (a table of one
    small file) is shuffled; a large table is left as it is read. For scans and checkpoints: a plan with a shuffle would
    be run to count its partitions."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(3 * cores)
    return df


#: Fixed value: the characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(text, F.lit(WHITE))


def canonical_name(name: Column) -> Column:
    """Upper case, then all outer double quotes, then all outer single quotes, then outer white space removed, then
    double quotes put on both sides. NULL stays NULL."""
    inner = F.btrim(F.btrim(F.upper(name), F.lit('"')), F.lit("'"))
    return F.concat(F.lit('"'), stripped(inner), F.lit('"'))
