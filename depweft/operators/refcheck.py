"""References to records that do not exist, no longer exist or came later.

A split-block Bloom filter of the parent keys (512-bit blocks, eight words of 64 bits, one bit in each word) is built as an
aggregation and broadcast. A reference that it rejects is certainly an orphan and never reaches the exact join that verifies
the others. The filter has BITS_PER_KEY bits for every parent, however many there are; one that is too large to be broadcast
is partitioned, as the references are, by the block that a key falls into. References are reduced to one row per field,
key and period first, so hot keys are no burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweft.session import cut

WORDS, WORD_BITS = 8, 64
BITS_PER_KEY = 12
#: Blocks up to which the filter is broadcast: 2^18 blocks of 64 bytes are 16 MB of bits, for 11 million parents. A larger one is
#: joined by block instead; the result is the same.
MAX_BLOCKS = 1 << 18
#: Groups up to which exact_late_counts broadcasts them, and parts into which references are spread beyond that.
BROADCAST_GROUPS, LATE_PARTS = 500_000, 64


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(hashed, 33), F.lit(blocks)).cast("int")


def _bit(hashed: Column, word: int) -> Column:
    # The low 33 bits and word-wise odd multipliers give the position within each word.
    low = hashed.bitwiseAND(F.lit((1 << 33) - 1))
    mixed = F.shiftright((low * F.lit(0x1E3779B1 + 0x2545F49 * word)).bitwiseAND(F.lit((1 << 62) - 1)), 24)
    return F.pmod(mixed, F.lit(WORD_BITS)).cast("int")


def bloom_blocks(keys: DataFrame, key: str, n_keys: int, most: int = (1 << 31) - 1) -> tuple[DataFrame, int]:
    """The filter as rows (block, w0..w7) and its number of blocks, which follows the number of keys."""
    blocks = max(1, min(most, -(-n_keys * BITS_PER_KEY // (WORD_BITS * WORDS))))
    h = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    one = F.lit(1).cast("bigint")
    words = [F.bit_or(F.call_function("shiftleft", one, _bit(F.col("h"), w))).alias(f"w{w}") for w in range(WORDS)]
    return h.groupBy(_block(F.col("h"), blocks).alias("block")).agg(*words), blocks


def maybe_in(refs: DataFrame, key: str, bloom: DataFrame, blocks: int, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """refs with the column `maybe`: false proves that the key is no parent key; null keys get false. The filter is broadcast up to
    max_blocks; beyond, filter and references meet by block."""
    h = refs.withColumn("__h", F.xxhash64(key)).withColumn("__block", _block(F.col("__h"), blocks))
    b = bloom.withColumnRenamed("block", "__block")
    b = F.broadcast(b) if blocks <= max_blocks else b
    hit = F.lit(True)
    for w in range(WORDS):
        hit = hit & (F.call_function("shiftright", F.col(f"w{w}"), _bit(F.col("__h"), w)).bitwiseAND(F.lit(1)) == 1)
    out = h.join(b, "__block", "left").withColumn("maybe", F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull())
    return out.drop("__h", "__block", *(f"w{w}" for w in range(WORDS)))


def reference_groups(refs: DataFrame) -> DataFrame:
    """One row per (field, key, month): number of references and of those with an instant, earliest and latest instant.

    refs: field string, key string, us bigint (instant in microseconds), month string.
    """
    return refs.groupBy("field", "key", "month").agg(F.count(F.lit(1)).alias("n_refs"), F.count("us").alias("n_dated"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def orphan_states(groups: DataFrame, parents: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """groups (of reference_groups) whose key is missing, deleted or late among parents, with the column `state`.

    parents: one row per key with key string, known_us bigint (first delivery) and gone boolean. Null keys are no
    references. A group is late if its first reference is older than the key's first delivery; a reference or a parent
    without instant is never late. An empty parent table makes every reference missing.
    """
    # Both are used several times below; written once, each is computed once.
    groups, parents = cut(groups.where(F.col("key").isNotNull())), cut(parents.select("key", "gone", "known_us"))
    bloom, blocks = bloom_blocks(parents, "key", parents.count())
    probed = maybe_in(groups, "key", bloom, blocks, max_blocks)
    sure = probed.where(~F.col("maybe")).drop("maybe").withColumn("state", F.lit("missing")).withColumn("known_us", F.lit(None).cast("bigint"))
    p = parents.select("key", F.lit(True).alias("__there"), "gone", "known_us")
    state = F.when(F.col("__there").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("first_us") < F.col("known_us"), "late")
    exact = probed.where("maybe").drop("maybe").join(p, "key", "left").withColumn("state", state).where(F.col("state").isNotNull())
    return sure.unionByName(exact.drop("__there", "gone"))


def exact_late_counts(states: DataFrame, refs: DataFrame, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """states with n_refs of late groups reduced to the references that are older than their key's first delivery.

    Where a whole group is older its count holds; only groups that the delivery falls into, or with references without instant, look at
    their references again. These groups are broadcast up to BROADCAST_GROUPS of them, so that the references stay where they
    are; beyond that, the references of a group are spread over LATE_PARTS parts, so that a hot key's month is no
    task of its own.
    """
    mixed = (F.col("state") == "late") & ((F.col("last_us") >= F.col("known_us")) | (F.col("n_dated") < F.col("n_refs")))
    split = cut(states.where(mixed).select("field", "key", "month", "known_us"))
    if split.count() <= broadcast_groups:
        met = refs.join(F.broadcast(split), ["field", "key", "month"])
    else:
        spread = refs.withColumn("__part", F.pmod(F.xxhash64("us"), F.lit(LATE_PARTS)).cast("int"))
        met = spread.join(split.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(LATE_PARTS - 1)))), ["field", "key", "month", "__part"])
    older = met.where(F.col("us") < F.col("known_us"))
    counts = older.groupBy("field", "key", "month").agg(F.count(F.lit(1)).alias("__n"))
    return states.join(counts, ["field", "key", "month"], "left").withColumn("n_refs", F.coalesce("__n", "n_refs")).drop("__n")
