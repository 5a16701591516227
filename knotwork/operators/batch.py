"""Batch algebra on frames with a ``row_id`` from 0: repeat, chunk, pad, fold, iterate, zip by position; masks and padding
of token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.records import numbered
from knotwork.operators.rl import states
from knotwork.session import cut


def _need(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no column {missing}")


def pop(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columns taken out (with ``row_id``), and the frame without them. A missing one raises ``KeyError``."""
    _need(df, names)
    return df.select("row_id", *(n for n in names if n != "row_id")), df.drop(*(n for n in names if n != "row_id"))


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    _need(df, old)
    return df.withColumnsRenamed(dict(zip(old, new)))


def rows(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows ``start`` up to, not with, ``stop``."""
    return df.filter((F.col("row_id") >= start) & (F.col("row_id") < stop))


def reorder(df: DataFrame, order: DataFrame) -> DataFrame:
    """``order``: ``row_id, new_id``, a permutation; rows get their new ids."""
    return df.join(order, "row_id").drop("row_id").withColumnRenamed("new_id", "row_id")


def inverse_order(order: DataFrame) -> DataFrame:
    return order.select(F.col("new_id").alias("row_id"), F.col("row_id").alias("new_id"))


def repeat(df: DataFrame, times: int, rows_: int | None = None, interleave: bool = True) -> DataFrame:
    """Each row ``times`` times: row after row (AABB), or the whole batch again (ABAB), for which ``rows_`` is needed."""
    if not interleave and rows_ is None:
        raise ValueError("the number of rows is needed")
    copies = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.limit(0).withColumn("_k", F.lit(0))
    new = F.col("row_id") * times + F.col("_k") if interleave else F.col("_k") * rows_ + F.col("row_id")
    return copies.withColumn("row_id", new.cast("long")).drop("_k")


def chunk(df: DataFrame, n: int, chunks: int) -> DataFrame:
    """``chunk_id`` of each row, in equal consecutive chunks; ``n`` rows must divide evenly."""
    if n % chunks:
        raise ValueError(f"{n} rows don't make {chunks} equal chunks")
    return df.withColumn("chunk_id", F.floor(F.col("row_id") / (n // chunks)).cast("long"))


def pad_to_divisor(df: DataFrame, n: int, divisor: int) -> tuple[DataFrame, int]:
    """Leading rows appended, over and over, until the number of rows divides; and how many were."""
    more = -n % divisor if n else 0
    if not more:
        return df, 0
    rounds = -(-more // n)
    again = df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("row_id", F.col("row_id") + F.col("_k") * n).drop("_k")
    return df.unionByName(again.filter(F.col("row_id") < n + more)), more


def unpad(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("row_id") < n)


def pad_with_first(df: DataFrame, n: int, size: int) -> DataFrame:
    """The first row appended until there are ``size`` rows."""
    if size <= n:
        return df
    again = df.filter("row_id = 0").withColumn("row_id", F.explode(F.sequence(F.lit(n).cast("long"), F.lit(size - 1).cast("long"))))
    return df.unionByName(again.select(*df.columns))


def fold(df: DataFrame, n: int, parts: int, column: str) -> DataFrame:
    """``fold_id, values``: values of rows ``fold_id``, ``fold_id + n / parts`` and so on become one array."""
    width = n // parts
    return df.groupBy(F.pmod("row_id", F.lit(width)).alias("fold_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", column))), lambda x: x[column]).alias("values"))


def unfold(df: DataFrame, width: int, column: str) -> DataFrame:
    return df.select("fold_id", F.posexplode("values").alias("k", column)).select((F.col("fold_id") + F.col("k") * width).cast("long").alias("row_id"), column)


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
    """``epoch, batch, row_id``: batches in order, or in a seeded order of MD5 digests, which is another for each epoch.
    All epochs are put in order at once, range by range, so that no task holds an epoch."""
    each = df.select("row_id").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        return each.withColumn("batch", F.floor(F.col("row_id") / size).cast("long"))
    placed = cut(numbered(each.withColumn("_h", _digest(seed, "epoch", "row_id")), "epoch", "_h", "row_id", name="_pos"))
    first = placed.groupBy("epoch").agg(F.min("_pos").alias("_first"))
    return placed.join(F.broadcast(first), "epoch").select("epoch", F.floor((F.col("_pos") - F.col("_first")) / size).cast("long").alias("batch"), "row_id")  # a row for each epoch


def _digest(seed: object, *columns: str) -> Column:
    """MD5 of a seed and columns: an order that any engine can make again."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def random_batches(df: DataFrame, n: int, size: int, seed: int = 0) -> DataFrame:
    """Rows of whole batches only, with their ``batch``, in a seeded order; the rest of ``n / size`` is left out."""
    placed = numbered(df.withColumn("_h", _digest(seed, "row_id")), "_h", "row_id", name="_pos")
    return placed.withColumn("batch", F.floor(F.col("_pos") / size).cast("long")).filter(F.col("batch") < n // size).drop("_h", "_pos")


def full_batches(df: DataFrame, n: int, size: int) -> DataFrame:
    """Rows of whole batches only, with their ``batch``."""
    return df.withColumn("batch", F.floor(F.col("row_id") / size).cast("long")).filter(F.col("batch") < n // size)


def zip_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both frames row by row. A column of both must be equal in every row; ``conflicts`` counts the others."""
    return a.join(b.drop(*(c for c in b.columns if c in a.columns and c != "row_id")), "row_id")


def conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``column, rows_that_differ`` of the columns that two frames share."""
    shared = [c for c in a.columns if c in b.columns and c != "row_id"]
    both = a.select("row_id", *(F.col(c).alias(f"a_{c}") for c in shared)).join(b.select("row_id", *(F.col(c).alias(f"b_{c}") for c in shared)), "row_id")
    counted = both.agg(*(F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in shared))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("rows_that_differ")) for c in shared))).alias("x")).select("x.*")


def eos_mask(tokens: Column, eos: int) -> Column:
    """1 up to and with the first end token, 0 after it; all 1 without one."""
    at = F.array_position(tokens, eos)
    return F.transform(tokens, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def running(mask: Column) -> Column:
    """Running sums of an array; an empty one stays."""
    return F.coalesce(states(mask, F.lit(0), lambda s, x: s + x), mask)


def positions_clipped(mask: Column) -> Column:
    """Running sum less one, at least 0."""
    return F.transform(running(mask), lambda x: F.greatest(x - 1, F.lit(0)))


def positions_masked(mask: Column) -> Column:
    """Running sum less one where the mask is 1, else 0."""
    return F.zip_with(running(mask), mask, lambda x, m: (x - 1) * m)


def attention_mask(tokens: Column, pad: int) -> Column:
    return F.transform(tokens, lambda x: F.when(x != pad, 1).otherwise(0))


def pads_aside(tokens: Column, pad: int, left: bool = True) -> Column:
    """Pads moved to one side, the other tokens in their order."""
    pads, others = F.filter(tokens, lambda x: x == pad), F.filter(tokens, lambda x: x != pad)
    return F.concat(pads, others) if left else F.concat(others, pads)


def fit_length(tokens: Column, size: int, pad: int, left_pad: bool = True, truncation: str = "left") -> Column:
    """Exactly ``size`` tokens: padded at the left or the right; too long ones lose their start ('left'), their end
    ('right'), or raise an error ('error')."""
    n = F.size(tokens)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(size) - n, F.lit(0)))
    padded = F.concat(fill, tokens) if left_pad else F.concat(tokens, fill)
    if truncation == "left":
        cut = F.slice(tokens, F.greatest(n - size + 1, F.lit(1)), F.lit(size))
    elif truncation == "right":
        cut = F.slice(tokens, 1, size)
    elif truncation == "error":
        cut = F.when(n > size, F.raise_error(F.lit("sequence is longer than allowed"))).otherwise(tokens)
    else:
        raise ValueError(f"unknown truncation {truncation!r}")
    return F.when(n > size, cut).otherwise(padded)


def without_left_pads(tokens: Column, pad: int) -> Column:
    first = F.array_position(F.transform(tokens, lambda x: x != pad), True)
    return F.when(first == 0, F.slice(tokens, 1, 0)).otherwise(F.slice(tokens, F.greatest(first, F.lit(1)).cast("int"), F.size(tokens)))


def effective(tokens: Column, mask: Column) -> Column:
    """Tokens up to the last that the mask keeps."""
    n = F.aggregate(mask, F.lit(0), lambda s, x: s + x)
    return F.slice(tokens, 1, n)


def sft_loss_mask(mask: Column, prompt: Column) -> Column:
    """The attention mask without the prompt's tokens but its last, and without the last token."""
    n = F.size(mask)
    return F.transform(mask, lambda x, i: F.when((i < prompt - 1) | (i == n - 1), 0).otherwise(x))


def span_loss_mask(mask: Column, starts: Column, ends: Column) -> Column:
    """The response mask without the tokens of spans, of which each starts and ends (half-open) at a position."""
    inside = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    return F.transform(mask, lambda x, i: F.when(F.exists(inside, lambda p: (i >= p["s"]) & (i < p["e"])), 0).otherwise(x))


def place_reward(score: Column, length: Column, size: Column) -> Column:
    """An array of zeros with the score at the last valid place."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == length - 1, score).otherwise(0.0))


def first_per_group(df: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_r") <= k).drop("_r")


def seeded_sample(df: DataFrame, column: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of a seeded order of the column's MD5 digests, as a log of samples takes them."""
    return df.orderBy(_digest(seed, column), column).limit(n)


def within_length(df: DataFrame, tokens: Column, most: int, more: int | Column = 0) -> DataFrame:
    """Rows of at most ``most`` tokens, ``more`` (those of the tools that a prompt lists) counted with them; rows without
    tokens (NULL) are dropped."""
    return df.filter(F.size(tokens) + more <= most)


def same_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """``frame, rows, same``: the number of rows of each part of a batch, and whether it is that of the first. A batch
    without a part raises ``ValueError``."""
    if not frames:
        raise ValueError("a batch has at least one part")
    counted = None
    for k, (name, df) in enumerate(frames.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("frame"), "rows", F.lit(k).alias("_k"))
        counted = one if counted is None else counted.unionByName(one)
    first = counted.filter("_k = 0").select(F.col("rows").alias("_first"))
    return counted.crossJoin(F.broadcast(first)).select("frame", "rows", (F.col("rows") == F.col("_first")).alias("same"))  # one row


def from_parts(frames: dict[str, DataFrame]) -> DataFrame:
    """One batch of parts with ``row_id`` and as many rows each; ``ValueError`` names the parts that have others."""
    wrong = [r.frame for r in same_rows(frames).filter("not same").collect()]
    if wrong:
        raise ValueError(f"parts with another number of rows: {wrong}")
    parts = list(frames.values())
    out = parts[0]
    for p in parts[1:]:
        out = zip_rows(out, p)
    return out


def union_of(a: dict, b: dict) -> dict:
    """Both dictionaries in one; a key of both must have equal values, else ``ValueError``."""
    clash = [k for k in a if k in b and a[k] != b[k]]
    if clash:
        raise ValueError(f"other values for {clash}")
    return {**a, **b}


def pad_inactive(rows: DataFrame, active: DataFrame, tokens: str, text: str, size: int, pad: int) -> DataFrame:
    """``row_id, tokens, text`` of every row: what the active ones have, ``size`` pads and an empty text for the others."""
    return rows.select("row_id").join(active.select("row_id", tokens, text), "row_id", "left").select(
        "row_id", F.coalesce(tokens, F.array_repeat(F.lit(pad), size)).alias(tokens), F.coalesce(text, F.lit("")).alias(text)
    )


def first_tokens(tokens: Column, most: int) -> Column:
    """At most the first ``most`` tokens, as a tool's response is cut."""
    return F.slice(tokens, 1, most)


def gathered(values: Column, label: Column) -> Column:
    """The value at a label's place, from 0."""
    return F.get(values, label)


def log_probability(logits: Column, label: Column) -> Column:
    """Logarithm of a label's chance: its logit less the logarithm of the sum of all exponentials."""
    top = F.array_max(logits)
    return gathered(logits, label) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def clipped(x: Column, least: Column, most: Column) -> Column:
    """A value held between two bounds; where they cross, the lower one."""
    return F.greatest(F.least(x, most), least)


def offsets(df: DataFrame, length: str) -> DataFrame:
    """``cu_seqlen``: lengths of the rows before, in the order of ``row_id``. Sums of blocks of rows are put in sequence
    first, so that no task sees all rows."""
    block = F.floor(F.col("row_id") / 65_536)
    marked = df.withColumn("_b", block)
    before = marked.groupBy("_b").agg(F.sum(length).alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum(length).over(Window.partitionBy("_b").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("_w", within).join(before.select("_b", "_o"), "_b").withColumn("cu_seqlen", F.col("_o") + F.col("_w")).drop("_b", "_w", "_o")


def transpose(df: DataFrame, sample: str, column: str) -> DataFrame:
    """``row_id, values``: a row's samples in the order of ``sample``."""
    return df.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(sample, column))), lambda x: x[column]).alias("values"))
