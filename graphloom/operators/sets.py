"""Set operations on vertices: frontiers, bit sets and Bloom filters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import exp, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import table


class Frontier:
    """The vertices scheduled for the next round, as a DataFrame (id)."""

    def __init__(self, ids: DataFrame) -> None:
        self.ids = ids.select("id").distinct()

    def add(self, ids: DataFrame) -> Frontier:
        return Frontier(self.ids.unionByName(ids.select("id")))

    def add_all(self, vertices: DataFrame) -> Frontier:
        """Every vertex (id) of a graph."""
        return Frontier(vertices)

    def remove(self, ids: DataFrame) -> Frontier:
        return Frontier(self.ids.join(ids.select("id"), "id", "left_anti"))

    def confine(self, rows: DataFrame) -> DataFrame:
        """Rows (with a column id) of scheduled vertices."""
        return rows.join(self.ids, "id", "left_semi")

    def any_in(self, start: int, stop: int) -> bool:
        return not self.ids.where((F.col("id") >= start) & (F.col("id") < stop)).isEmpty()

    def count(self) -> int:
        return self.ids.count()

    def advance(self, scheduled: DataFrame) -> Frontier:
        """The frontier of the next round, with its lineage cut."""
        return Frontier(table(scheduled.select("id").distinct(), "frontier"))


#: Vertex ids per word of a bit set.
WORD = 32_768


def bit_set(ids: DataFrame) -> DataFrame:
    """(bucket, bits): a bit set of ids, one bitmap of 32768 bits a bucket, built with partial aggregation."""
    return ids.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def bit_set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bit_set_count(bits: DataFrame) -> DataFrame:
    """(n): how many bits are set."""
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def bit_set_all(spark, n: int) -> DataFrame:
    """The bit set of all ids below n."""
    return bit_set(spark.range(n))


def bit_set_members(bits: DataFrame) -> DataFrame:
    """(id) of the bits that are set."""
    place = F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.conv(F.hex(F.substring(F.col("bits"), (F.floor(i / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long"), (i % 8).cast("int")) == 1))
    # Bucket 1 begins with id 1; id 0 is alone in bucket 0.
    found = bits.select("bucket", place.alias("i"))
    return found.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * WORD + F.col("i") + 1).otherwise(F.col("bucket") * WORD - F.col("i")).alias("id"))


def bit_set_without(bits: DataFrame, start: int, stop: int) -> DataFrame:
    """A bit set with the range from start up to, without, stop cleared."""
    return bit_set(bit_set_members(bits).where((F.col("id") < start) | (F.col("id") >= stop)))


def bit_set_resized(bits: DataFrame, n: int) -> DataFrame:
    """A bit set cut to ids below n; it has no size otherwise, as absent buckets are clear."""
    return bit_set(bit_set_members(bits).where(F.col("id") < n))


def get_bit(mask: Column, bit: int) -> Column:
    return F.getbit(mask, F.lit(bit)) == 1


def set_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseOR(F.lit(1 << bit).cast("long"))


def clear_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(~(1 << bit)).cast("long"))


class BloomFilter:
    """A Bloom filter over ids as a table of set bits (bit), so that it may be larger than one machine's memory.

    Tests are joins; false positives occur at the rate asked for, false negatives never.
    """

    def __init__(self, spark, bits: int, hashes: int, set_bits: DataFrame | None = None) -> None:
        self.spark, self.bits, self.hashes = spark, bits, hashes
        self.set_bits = spark.createDataFrame([], "bit long") if set_bits is None else set_bits

    @classmethod
    def sized(cls, spark, n: int, fpp: float) -> BloomFilter:
        from graphloom.plans.planner import bloom_size

        return cls(spark, *bloom_size(n, fpp))

    def _bits_of(self, key: Column) -> Column:
        return F.array_distinct(F.array(*(F.pmod(F.xxhash64(F.lit(i), key), F.lit(self.bits)) for i in range(self.hashes))))

    def insert(self, ids: DataFrame) -> BloomFilter:
        new = ids.select(F.explode(self._bits_of(F.col("id"))).alias("bit"))
        return BloomFilter(self.spark, self.bits, self.hashes, self.set_bits.unionByName(new).distinct())

    def contains(self, ids: DataFrame) -> DataFrame:
        """ids with may_contain."""
        wanted = ids.withColumn("__bits", self._bits_of(F.col("id")))
        have = wanted.select("id", F.explode("__bits").alias("bit")).distinct().join(self.set_bits, "bit").groupBy("id").agg(F.count("*").alias("__n"))
        return wanted.join(have, "id", "left").withColumn("may_contain", F.coalesce(F.col("__n"), F.lit(0)) == F.size("__bits")).drop("__bits", "__n")

    def contains_all(self, ids: DataFrame) -> bool:
        return self.contains(ids).where("not may_contain").isEmpty()

    def contains_none(self, ids: DataFrame) -> bool:
        return self.contains(ids).where("may_contain").isEmpty()

    def _same(self, other: BloomFilter) -> None:
        if (self.bits, self.hashes) != (other.bits, other.hashes):
            raise ValueError("the filters differ in size")

    def __or__(self, other: BloomFilter) -> BloomFilter:
        self._same(other)
        return BloomFilter(self.spark, self.bits, self.hashes, self.set_bits.union(other.set_bits).distinct())

    def __and__(self, other: BloomFilter) -> BloomFilter:
        self._same(other)
        return BloomFilter(self.spark, self.bits, self.hashes, self.set_bits.intersect(other.set_bits))

    def __xor__(self, other: BloomFilter) -> BloomFilter:
        self._same(other)
        either = self.set_bits.exceptAll(other.set_bits).union(other.set_bits.exceptAll(self.set_bits))
        return BloomFilter(self.spark, self.bits, self.hashes, either)

    def compress(self, factor: int) -> BloomFilter:
        """The filter folded to bits // factor bits; elements inserted stay contained if asked of the folded filter's parent hashes."""
        if self.bits % factor:
            raise ValueError("factor must divide the number of bits")
        return _Folded(self.spark, self.bits // factor, self.hashes, self.set_bits.select((F.col("bit") % (self.bits // factor)).alias("bit")).distinct(), self.bits)

    def effective_fpp(self, inserted: int) -> float:
        return (1.0 - exp(-1.0 * self.hashes * inserted / self.bits)) ** self.hashes


class _Folded(BloomFilter):
    def __init__(self, spark, bits: int, hashes: int, set_bits: DataFrame, before: int) -> None:
        super().__init__(spark, bits, hashes, set_bits)
        self.before = before

    def _bits_of(self, key: Column) -> Column:
        return F.array_distinct(F.array(*(F.pmod(F.pmod(F.xxhash64(F.lit(i), key), F.lit(self.before)), F.lit(self.bits)) for i in range(self.hashes))))


def md5_hash(seed: int, key: Column) -> Column:
    """A hash below 2**60 that other engines have too; slower than the default one."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def fast_hash(seed: int, key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 60))


class BlockedBloom:
    """A Bloom filter as a table of blocks of 512 bits, eight longs a row.

    A key has all its bits in one block, so insertion is one aggregation by block and a test one join, whatever the number of bits a
    key. Blocks that no key fell into have no row. False negatives never occur. As keys fill blocks unevenly, it takes some more bits
    than a plain filter for the same rate of false positives.
    """

    WORDS, BITS = 8, 64

    def __init__(self, spark, blocks: int, hashes: int = 8, rows: DataFrame | None = None, hasher: Callable[[int, Column], Column] = fast_hash) -> None:
        if blocks < 1 or not 1 <= hashes <= 32:
            raise ValueError("a filter needs a block, and 1 to 32 bits a key")
        self.spark, self.blocks, self.hashes, self.hasher = spark, blocks, hashes, hasher
        self.rows = spark.createDataFrame([], "block long, " + ", ".join(f"w{i} long" for i in range(self.WORDS))) if rows is None else rows

    @classmethod
    def sized(cls, spark, n: int, fpp: float, hasher: Callable[[int, Column], Column] = fast_hash) -> BlockedBloom:
        """A filter for n keys and a rate of false positives, by the rate of blocks that hold a Poisson number of keys."""
        from math import ceil

        hashes = min(32, max(1, round(-log2(fpp))))
        bits = cls.WORDS * cls.BITS
        blocks = max(1, ceil(n * hashes / (bits * 0.6931)))
        while cls.rate(n / blocks, hashes) > fpp and blocks < 64 * n + 64:
            blocks = ceil(blocks * 1.1)
        return cls(spark, blocks, hashes, hasher=hasher)

    @classmethod
    def rate(cls, keys_a_block: float, hashes: int) -> float:
        """The expected rate of false positives. Bit i of a key falls into word i mod 8 of its block."""
        words = [hashes // cls.WORDS + (i < hashes % cls.WORDS) for i in range(cls.WORDS)]
        total, p = 0.0, exp(-keys_a_block)
        for k in range(int(keys_a_block + 12 * keys_a_block**0.5) + 20):
            hit = 1.0
            for w in words:
                hit *= (1 - (1 - 1 / cls.BITS) ** (k * w)) ** w
            total += p * hit
            p *= keys_a_block / (k + 1)
        return total

    def _placed(self, keys: DataFrame) -> DataFrame:
        """keys with __block."""
        return keys.select("*", F.pmod(self.hasher(0, F.col("id")), F.lit(self.blocks)).alias("__block"))

    def _marked(self, keys: DataFrame) -> DataFrame:
        """keys with, for each word, the bits of the key in it (__b0 ...)."""
        bits = [F.lit(0).cast("long")] * self.WORDS
        for i in range(self.hashes):
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), (self.hasher(i + 1, F.col("id")) % self.BITS).cast("int"))
            bits[i % self.WORDS] = bits[i % self.WORDS].bitwiseOR(bit)
        return keys.select("*", *(b.alias(f"__b{i}") for i, b in enumerate(bits)))

    def _with(self, rows: DataFrame) -> BlockedBloom:
        return BlockedBloom(self.spark, self.blocks, self.hashes, rows, self.hasher)

    def _ored(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(self.WORDS)))

    def insert(self, ids: DataFrame) -> BlockedBloom:
        """The filter with ids (id) in it; null ids are no keys. Keys of a block meet within a task before anything is shuffled."""
        new = self._marked(self._placed(ids.select("id").where("id is not null"))).select(F.col("__block").alias("block"), *(F.col(f"__b{i}").alias(f"w{i}") for i in range(self.WORDS)))
        return self._written(self._ored(self.rows.unionByName(new)))

    def contains(self, ids: DataFrame) -> DataFrame:
        """ids (id, ...) with may_contain."""
        return self.contains_each(ids, {"may_contain": self})

    def contains_each(self, ids: DataFrame, filters: dict[str, BlockedBloom]) -> DataFrame:
        """ids (id, ...) with a column for each of some filters of this size: whether it may contain the key. Keys are placed once."""
        names, found = ids.columns, self._placed(ids)
        for k, x in enumerate(filters.values()):
            self._same(x)
            held = x.rows.select(F.col("block").alias("__block"), *(F.col(f"w{i}").alias(f"__w{i}") for i in range(self.WORDS)))
            ok = reduce(lambda a, b: a & b, (F.col(f"__w{i}").bitwiseAND(F.col(f"__b{i}")) == F.col(f"__b{i}") for i in range(self.WORDS)))
            said = F.coalesce(ok, F.lit(False)) & F.col("id").isNotNull()
            found = found.join(held, "__block", "left")
            # Keys get their bits when they are with their block: where blocks are too many to broadcast, keys are shuffled without bits.
            found = (found if k else self._marked(found)).withColumn(f"__in{k}", said).drop(*(f"__w{i}" for i in range(self.WORDS)))
        return found.select(*names, *(F.col(f"__in{k}").alias(name) for k, name in enumerate(filters)))

    def _same(self, other: BlockedBloom) -> None:
        if (self.blocks, self.hashes, self.hasher) != (other.blocks, other.hashes, other.hasher):
            raise ValueError("the filters differ in size")

    def _written(self, rows: DataFrame) -> BlockedBloom:
        """A filter whose blocks are written: they are asked for again and again, and as a table of known size they are broadcast where
        they are few, so that the keys are not shuffled by their block."""
        return self._with(table(rows, "bloom"))

    def _both(self, other: BlockedBloom, how: str, word: Callable[[Column, Column], Column]) -> BlockedBloom:
        self._same(other)
        theirs = other.rows.select("block", *(F.col(f"w{i}").alias(f"o{i}") for i in range(self.WORDS)))
        none = F.lit(0).cast("long")
        words = [word(F.coalesce(f"w{i}", none), F.coalesce(f"o{i}", none)).alias(f"w{i}") for i in range(self.WORDS)]
        return self._written(self.rows.join(theirs, "block", how).select("block", *words))

    def __or__(self, other: BlockedBloom) -> BlockedBloom:
        return self._both(other, "full", lambda a, b: a.bitwiseOR(b))

    def __and__(self, other: BlockedBloom) -> BlockedBloom:
        return self._both(other, "inner", lambda a, b: a.bitwiseAND(b))

    def __xor__(self, other: BlockedBloom) -> BlockedBloom:
        return self._both(other, "full", lambda a, b: a.bitwiseXOR(b))

    def bits_set(self) -> DataFrame:
        """(n): how many bits are set."""
        each = reduce(lambda a, b: a + b, (F.bit_count(f"w{i}").cast("long") for i in range(self.WORDS)))
        return self.rows.agg(F.coalesce(F.sum(each), F.lit(0)).alias("n"))

    def effective_fpp(self) -> float:
        """The rate of false positives that the bits that are set give."""
        words = [self.hashes // self.WORDS + (i < self.hashes % self.WORDS) for i in range(self.WORDS)]
        share = reduce(lambda a, b: a * b, (F.pow(F.bit_count(f"w{i}") / float(self.BITS), F.lit(w)) for i, w in enumerate(words)))
        return self.rows.agg(F.coalesce(F.sum(share), F.lit(0.0))).first()[0] / self.blocks
