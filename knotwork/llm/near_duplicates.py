"""Near-duplicate records: exact similarity join of shingle sets with pivot distance tables.

Similarity is shared / all distinct shingles of two records, at least ``threshold``. Of two sets of n and m shingles that
reach it, at most r = (1 - t) / (1 + t) * (n + m) shingles belong to only one; that number is the Hamming distance of the
sets as bit vectors. Each set is folded into a fingerprint by parity, which never increases a Hamming distance. A *pivot
table* holds the distances of a fingerprint to ``PIVOTS`` reference fingerprints, block by block of 64 bits; the references
are drawn by a seed and the same for all data. By the triangle inequality the distance of two records within a block is at
least their largest coordinate difference there, and of c blocks one must be within r / c if the pair is within r. A pair
is discarded if at some coarseness no block is: whole fingerprints tell small sets apart, fine blocks large ones. What
survives is held against the direct distance of the fingerprints, and then verified on the shingle sets.

Pairs to hold against the tables come from an inverted index over the rarest shingles of each set (two sets that reach the
threshold share at least ``SHARED`` of these), which loses no pair; holding all pairs of records against the tables would
grow as their square.

Records with equal sets form a class and take part once, so that a group of copies costs one record.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import spread
from knotwork.session import cut, few

#: Reference fingerprints (of many blocks one more for each 64), and the fewest and most blocks of a fingerprint; any choice
#: gives the same pairs.
PIVOTS, LEAST_BLOCKS, MOST_BLOCKS = 24, 8, 4096
#: Shingles that two similar sets have in common among their rarest.
SHARED = 4
#: Cells of the table of shingle counts that orders shingles by rarity, and cells of a block of it; the size doesn't grow
#: with the data.
CELLS, BLOCK = 1 << 18, 1 << 10
#: Records with a shingle from which on its pairs are made in parts of so many.
HOT = 20_000
#: Characters that are hashed at one go; a longer record is a go by itself.
AT_ONCE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter or digit, and a random number."""
    kinds = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return kinds, np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 0x110000, np.uint64)


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers up to n, and their inverses, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, AT_ONCE)
        with np.errstate(over="ignore"):
            both = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        _powers[:] = both
    return _powers[0], _powers[1]


def _words(passages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and passage number of each word: all words at once, by differences of a running polynomial."""
    kinds, numbers = _letters()
    text = "\n".join(passages)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], kinds[points], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(len(points) + 1)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers[points] * up[: len(points)], dtype=np.uint64)])
    hashes = (running[ends] - running[starts]) * down[starts]
    after = np.cumsum(np.fromiter((len(p) + 1 for p in passages), np.int64, len(passages)))
    return _mixed(hashes), np.searchsorted(after, starts, side="right")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def row_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each list of passages the sorted distinct 64-bit hashes of its runs of ``width`` consecutive words within a
    passage. Words are the lower-cased longest runs of letters or digits; NULL passages are skipped."""
    flat = pc.utf8_lower(pc.list_flatten(column).fill_null("")).to_pylist()
    parents = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    bounds = np.searchsorted(parents, np.arange(len(column) + 1))
    row = 0
    while row < len(column):
        end, size = row, 0
        while end < len(column) and (end == row or size < AT_ONCE // 2):
            size += sum(map(len, flat[bounds[end] : bounds[end + 1]]))
            end += 1
        passages = flat[bounds[row] : bounds[end]]
        if not passages:
            yield from (np.empty(0, np.uint64) for _ in range(row, end))
            row = end
            continue
        hashes, of = _words(passages)
        n = max(0, len(hashes) - width + 1)
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = _mixed(h * np.uint64(_BASE) + hashes[k : k + n])
        whole = of[:n] == of[width - 1 : width - 1 + n]
        h, of = h[whole], of[:n][whole]
        cuts = np.searchsorted(of, bounds[row : end + 1] - bounds[row])
        yield from (np.unique(h[cuts[k] : cuts[k + 1]]) for k in range(end - row))
        row = end


def blocks_of(n: int) -> int:
    """Blocks of the fingerprints by which a set of ``n`` shingles is held against larger ones: four to eight shingles each."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << max(0, (n // 4).bit_length() - 1)))


@lru_cache(None)
def references(blocks: int) -> np.ndarray:
    """The reference fingerprints: pivots x blocks."""
    return np.random.Generator(np.random.PCG64(blocks)).integers(0, 1 << 64, (PIVOTS + blocks // 64, blocks), np.uint64)


def sketch(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The set folded by parity into blocks of 64 bits."""
    bits = np.bincount((hashes & np.uint64(64 * blocks - 1)).astype(np.int64), minlength=64 * blocks) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def coordinates(fingerprint: np.ndarray) -> np.ndarray:
    """Distances of a fingerprint's blocks to those of the references: pivots x blocks."""
    return np.bitwise_count(references(len(fingerprint)) ^ fingerprint)


def within_tables(a: np.ndarray, b: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Whether pairs may be within their radius, as far as their coordinates (pairs x pivots x blocks) tell."""
    kept = np.ones(len(a), bool)
    off = a.astype(np.int32) - b
    while kept.any():
        blocks = off.shape[2]
        least = np.abs(off).max(axis=1).min(axis=1)  # of the largest differences of the blocks the least
        kept &= least <= np.floor(radius / blocks)
        if blocks == 1:
            break
        off = off[:, :, 0::2] + off[:, :, 1::2]
    return kept


def _lists(rows: list[np.ndarray], kind: str) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(kind) if rows else np.empty(0, kind)))


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _first_pass(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each record (its id, key and number of shingles), then the partition's shingle counts by block."""
    counts = np.zeros(CELLS, np.int64)

    def rows(block: list, ids: list, keys: list, sizes: list, blobs: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((block, ids, keys, sizes, blobs), kinds)], names=["block", "id", "key", "n", "counts"])

    for batch in batches:
        ids, keys, sizes = [], [], []
        for record, hashes in zip(batch.column(0).to_pylist(), row_sets(batch.column(1), width)):
            if len(hashes):
                ids.append(record)
                keys.append(_key(hashes))
                sizes.append(len(hashes))
                counts += np.bincount((hashes & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) if len(hashes) > CELLS // 8 else 0
                if len(hashes) <= CELLS // 8:
                    counts[(hashes & np.uint64(CELLS - 1)).astype(np.int64)] += 1
        none = [None] * len(ids)
        yield rows(none, ids, keys, sizes, none)
    used = [k for k in range(CELLS // BLOCK) if counts[k * BLOCK : (k + 1) * BLOCK].any()]
    none = [None] * len(used)
    yield rows(used, none, none, none, [counts[k * BLOCK : (k + 1) * BLOCK].astype("<i8").tobytes() for k in used])


def _sum_blocks(blocks: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, "<i8") for b in blocks.column("counts").to_pylist())
    return pa.table({"block": blocks.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, counts: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each set; of equal sets in a partition only once. Of two similar sets the larger, of m
    shingles, has all but ``threshold * m`` of its own in common with the other, the smaller all but a share that is
    smaller still. ``m`` is the size, then a bit that marks the shingles that count when the set is the smaller one, then a
    bit for those that are to meet others from the left. A shingle of many records is put out in parts: from the left in
    one of them, by the set's key, from the right in all, so that any two sets meet once and no task gets all."""
    seen: set[int] = set()
    for batch in batches:
        keys, tokens, sizes = [], [], []
        for hashes in row_sets(batch.column(0), width):
            size = len(hashes)
            if not size or (key := _key(hashes)) in seen:
                continue
            seen.add(key)
            need = math.ceil(threshold * size - 1e-9)
            share = min(SHARED, need)
            take = min(size, size - need + share)
            low = min(take, size - math.ceil(2 * threshold / (1 + threshold) * size - 1e-9) + share)
            load = counts[(hashes & np.uint64(CELLS - 1)).astype(np.int64)]
            # Of shingles of one load the order is by hash; it must be the same for all sets.
            first = np.lexsort((hashes, load))[:take]
            found, parts = hashes[first], 1 + load[first] // HOT
            m = np.where(np.arange(take) < low, 4 * size + 3, 4 * size + 1)
            if (hot := np.flatnonzero(parts > 1)).size:
                part = np.concatenate([np.arange(p) for p in parts[hot]]).astype(np.uint64)
                again = np.repeat(hot, parts[hot])
                left = part == np.uint64(key % (1 << 64)) % parts[again].astype(np.uint64)
                cold = np.flatnonzero(parts == 1)
                found = np.concatenate([found[cold], _mixed(found[again] + part * np.uint64(_BASE))])
                m = np.concatenate([m[cold], np.where(left, m[again], m[again] - 1)])
            tokens.append(found.view(np.int64))
            keys.append(np.full(len(m), key))
            sizes.append(m)
        columns = [np.concatenate(x).astype(kind) if x else np.empty(0, kind) for x, kind in ((tokens, np.int64), (keys, np.int64), (sizes, np.int32))]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["token", "key", "m"])


def _tables(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Key and size, and by number of blocks the fingerprint and its coordinates."""
    for batch in batches:
        rows = []
        for hashes, wanted in zip(row_sets(batch.column(0), width), batch.column(1).to_pylist()):
            for blocks in wanted:
                folded = sketch(hashes, blocks)
                rows.append((_key(hashes), blocks, len(hashes), folded.tobytes(), coordinates(folded).tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["key", "blocks", "n", "sketch", "far"])


def _held(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs with what became of them: 'table' (discarded by the coordinates), 'distance' (by the fingerprints' distance),
    'kept'."""
    for batch in batches:
        blocks, n_a, n_b = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("blocks", "n_a", "n_b"))
        radius = (1 - threshold) / (1 + threshold) * (n_a + n_b) + 1e-9
        outcome = np.empty(batch.num_rows, object)
        blobs = {c: batch.column(batch.schema.get_field_index(c)) for c in ("far_a", "far_b", "sketch_a", "sketch_b")}
        for size in np.unique(blocks):
            # As many pairs at a time as coordinates fit in some megabytes.
            here = np.flatnonzero(blocks == size)
            for part in np.array_split(here, max(1, len(here) * references(int(size)).size // (1 << 22))):
                far_a, far_b, sketch_a, sketch_b = (b"".join(blobs[c].take(pa.array(part)).to_pylist()) for c in ("far_a", "far_b", "sketch_a", "sketch_b"))
                table = within_tables(*(np.frombuffer(x, np.uint8).reshape(len(part), -1, size) for x in (far_a, far_b)), radius[part])
                apart = np.bitwise_count(np.bitwise_xor(*(np.frombuffer(x, np.uint64).reshape(len(part), size) for x in (sketch_a, sketch_b)))).sum(axis=1, dtype=np.int64)
                outcome[part] = np.where(~table, "table", np.where(apart > radius[part], "distance", "kept"))
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("key_a", "key_b", "n_a", "n_b")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(outcome.tolist(), pa.string())], names=["key_a", "key_b", "n_a", "n_b", "outcome"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(row_sets(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array(list(map(_key, sets)), pa.int64()), _lists([h.view(np.int64) for h in sets], "int64")], names=["key", "hashes"])


def _of_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id is wanted, with the other columns of ``wanted``, which are broadcast only while they are few."""
    return rows.join(F.broadcast(wanted) if few(wanted, 64) else wanted, "id")


def _candidates(rows: DataFrame, width: int, threshold: float, counts: np.ndarray) -> DataFrame:
    """``key_a, key_b, n_a`` of the pairs of sets that share enough of their rarest shingles; ``n_a`` is the smaller
    size."""
    rarity = rows.sparkSession.sparkContext.broadcast(counts)
    tokens = spread(rows.select("passages")).mapInArrow(lambda b: _prefixes(b, width, rarity.value, threshold), "token long, key long, m int").repartition("token").dropDuplicates(["token", "key"])
    a, b = (tokens.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "m"))) for s in "ab")
    n_a, n_b = F.shiftright("m_a", 2), F.shiftright("m_b", 2)
    smaller = (n_a < n_b) | (n_a == n_b) & (F.col("key_a") < F.col("key_b"))
    # What counts of the smaller set, and is on the left; the last never holds, it keeps both sides one exchange.
    low = (F.col("m_a").bitwiseAND(3) == 3) | (F.col("m_b") < 0)
    least = F.least(F.lit(SHARED), F.ceil(threshold * F.col("n_a") - 1e-9))
    return (
        a.join(b, "token")
        .filter(smaller & low & (n_a >= threshold * n_b - 1e-9))
        .groupBy("key_a", "key_b")
        .agg(F.count("*").alias("shared"), F.first(n_a).alias("n_a"))
        .filter(F.col("shared") >= least)
        .select("key_a", "key_b", "n_a")
    )


def held_pairs(df: DataFrame, record_id: str, passages: str, width: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The records' classes (``id, key``), the candidate pairs of classes with what the pivot tables made of them (``key_a,
    key_b, n_a, n_b, outcome``: 'table', 'distance' or 'kept'), and a record of each class that is in a candidate (``key,
    id``)."""
    rows = df.select(F.col(record_id).cast("long").alias("id"), F.col(passages).alias("passages")).filter("id is not null")
    first = cut(spread(rows).mapInArrow(lambda b: _first_pass(b, width), "block int, id long, key long, n int, counts binary"))
    members = first.filter("block is null").select("id", "key")
    counts = np.zeros(CELLS, np.int64)
    for r in first.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(_sum_blocks, "block int, counts binary").collect():
        counts[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, "<i8")
    power = F.expr(f"int(greatest({LEAST_BLOCKS}, least({MOST_BLOCKS}, shiftleft(1, greatest(0, length(bin(n_a div 4)) - 1)))))")
    pairs = cut(_candidates(rows, width, threshold, counts).withColumn("blocks", power))

    wanted = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key"), "blocks").groupBy("key").agg(F.collect_set("blocks").alias("wanted"))
    one = cut(members.join(wanted, "key").groupBy("key", "wanted").agg(F.min("id").alias("id")))
    tables = _of_ids(spread(rows), one.select("id", "wanted")).select("passages", "wanted").mapInArrow(lambda x: _tables(x, width), "key long, blocks int, n int, sketch binary, far binary")
    held = pairs.drop("n_a")
    for side in "ab":
        held = held.join(tables.select("blocks", *(F.col(c).alias(f"{c}_{side}") for c in ("key", "n", "sketch", "far"))), [f"key_{side}", "blocks"])
    held = held.select("key_a", "key_b", "n_a", "n_b", "blocks", "far_a", "far_b", "sketch_a", "sketch_b")
    return members, held.mapInArrow(lambda x: _held(x, threshold), "key_a long, key_b long, n_a int, n_b int, outcome string"), one


def similar_classes(df: DataFrame, record_id: str, passages: str, width: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Classes of records with equal shingle sets, and all pairs of classes that are similar.

    The first frame (``id, key``) has each record that has a shingle; the second (``key_a, key_b, similarity``, with
    ``key_a < key_b``) each pair of classes whose similarity is at least ``threshold``. Records without a shingle (NULL,
    empty or too short passages) are similar to none and in neither; so are records with a NULL id. Equal rows fall into
    one class. An empty table gives two empty frames. ``passages`` is an array of strings; other columns are not read.

    Whole texts are read by each of four passes (keys and counts; rarest shingles; fingerprints and tables of the records
    in candidates; shingle sets of the records in pairs that the tables left). The shingle sets, which are larger than the
    texts, are made anew by each; only those of the last pass are shuffled. Shingles are 64-bit hashes throughout.
    """
    rows = df.select(F.col(record_id).cast("long").alias("id"), F.col(passages).alias("passages")).filter("id is not null")
    members, held, one = held_pairs(df, record_id, passages, width, threshold)
    pairs = cut(held.filter("outcome = 'kept'").select("key_a", "key_b", "n_a", "n_b"))
    left = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct().join(one.select("key", "id"), "key").select("id")
    sets = _of_ids(spread(rows), cut(left)).select("passages").mapInArrow(lambda x: _sets(x, width), "key long, hashes array<long>")
    for side in "ab":
        pairs = pairs.join(sets.select(*(F.col(c).alias(f"{c}_{side}") for c in sets.columns)), f"key_{side}")
    pairs = pairs.withColumn("both", F.size(F.array_intersect("hashes_a", "hashes_b")))
    pairs = pairs.withColumn("similarity", F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).filter(F.col("similarity") >= threshold - 1e-12)
    return members, pairs.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "similarity")


def pruning(df: DataFrame, record_id: str, passages: str, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``outcome, pairs``: how many candidates the pivot tables discard, how many more the fingerprints' distance does, and
    how many are left to verify."""
    return held_pairs(df, record_id, passages, width, threshold)[1].groupBy("outcome").agg(F.count("*").alias("pairs"))


def similar_pairs(df: DataFrame, record_id: str, passages: str, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """All pairs ``id_a < id_b`` of records whose similarity is at least ``threshold``: ``similar_classes`` with classes
    put out record by record. It is as long as there are pairs; use ``similar_classes`` where copies abound."""
    members, pairs = similar_classes(df, record_id, passages, width, threshold)
    pairs = cut(pairs)
    a, b = (members.select(F.col("id").alias(f"id_{s}"), F.col("key").alias(f"key_{s}")) for s in "ab")
    across = pairs.join(a, "key_a").join(b, "key_b").select("id_a", "id_b")
    within = a.join(b, (F.col("key_a") == F.col("key_b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    return across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).unionByName(within).filter("id_a < id_b").distinct()
