"""Operator 1. Document fingerprints by one-permutation MinHash, in DataFrame expressions only.

A text's shingles of five words are hashed once. The top bits of a hash are its bin, the rest its value, and each
bin keeps its least value: one sort of the hashes puts the least of each bin in front. A bin without shingles takes
the value of an occupied one by optimal densification: it tries the bins that a hash of (bin, attempt) names until
one is occupied, independently of other empty bins. Of every value only the low-order bits are kept, eight bins to a
64-bit number. Two fingerprints agree in a bin by chance once in 2**8 times, which the likeness corrects for.

Words are lower-cased and parted by white space. Texts of fewer than five words have one shingle, all their words.

Edge cases: null, empty and blank texts have no shingles and an empty fingerprint; their likeness is 1 to each other
and 0 to others. Repeated rows get equal fingerprints. The next document of a single one is itself. Very long texts are
taken whole, in the memory of one task. Columns other than doc_id and text are not read. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
BINS, BIN_BITS, LOW_BITS = 256, 8, 8
_SHIFT = 63 - BIN_BITS
_VALUE = (1 << _SHIFT) - 1
#: The chance that an empty bin is left after the last attempt; the lowest occupied bin then fills it.
_LEFT = 1e-7
#: Documents in a bucket of consecutive ids at least, and buckets at most.
BUCKET_ROWS, BUCKETS = 512, 20_000


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    for blank in ("\n", "\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(F.lower(text), " "), "")


def _shingle_keys(text: Column) -> Column:
    """A 63-bit hash of each shingle."""

    def of_words(w: Column) -> Column:
        def of_hashes(h: Column) -> Column:
            long = F.transform(F.slice(h, 1, F.size(h) - (SHINGLE - 1)), lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *(F.get(h, i + k) for k in range(1, SHINGLE))), 1))
            return F.when(F.size(h) >= SHINGLE, long).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")), 1)))

        return let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes)

    return let(words(text), lambda w: F.when(F.size(w) > 0, of_words(w)).otherwise(F.array().cast("array<bigint>")))


def _least(keys: Column) -> Column:
    """The least key of every bin, in order of bins; all ones below the bin where it is empty."""
    ends = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: F.shiftleft(b, _SHIFT) + F.lit(_VALUE))
    return let(F.sort_array(F.concat(keys, ends)), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT))))


def _filled(least: Column) -> Column:
    """Optimal densification: state has a value, or -1 where a bin is still empty."""
    empty = F.lit(_VALUE)
    state = F.transform(least, lambda x: F.when(x.bitwiseAND(_VALUE) == empty, F.lit(-1).cast("long")).otherwise(x.bitwiseAND(_VALUE)))

    def fill(s: Column) -> Column:
        occupied = F.size(F.filter(s, lambda x: x >= 0))
        attempts = F.when(occupied >= BINS, 0).otherwise(F.ceil(F.log(F.lit(_LEFT)) / F.log(1 - occupied / F.lit(float(BINS)))).cast("int"))
        tries = F.when(attempts > 0, F.sequence(F.lit(1), F.greatest(attempts, F.lit(1)))).otherwise(F.array().cast("array<int>"))

        def attempt(now: Column, t: Column) -> Column:
            return F.transform(now, lambda x, b: F.when(x >= 0, x).otherwise(F.get(s, F.xxhash64(b, t).bitwiseAND(BINS - 1).cast("int"))))

        done = F.aggregate(tries, s, attempt)
        first = F.element_at(F.filter(s, lambda x: x >= 0), 1)
        return F.transform(done, lambda x: F.when(x >= 0, x).otherwise(first))

    return let(state, fill)


def _packed(values: Column) -> Column:
    each = 64 // LOW_BITS

    def number(v: Column, k: Column) -> Column:
        out = F.lit(0).cast("long")
        for j in range(each):
            out = out.bitwiseOR(F.shiftleft(F.get(v, k * each + j).bitwiseAND((1 << LOW_BITS) - 1), j * LOW_BITS))
        return out

    return let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(BINS // each - 1)), lambda k: number(v, k)))


def fingerprint(text: Column) -> Column:
    """``array<bigint>`` of packed bins; empty if the text has no words."""
    return let(_shingle_keys(F.coalesce(text, F.lit(""))), lambda keys: F.when(F.size(keys) > 0, _packed(_filled(_least(keys)))).otherwise(F.array().cast("array<bigint>")))


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda p: F.lpad(F.hex(p), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles from their fingerprints."""

    def unequal_bytes(x: Column) -> Column:
        """Each byte's bits are folded onto its lowest one."""
        for fold in (lambda y: y.bitwiseOR(F.shiftrightunsigned(y, 4)), lambda y: y.bitwiseOR(F.shiftrightunsigned(y, 2)), lambda y: y.bitwiseOR(F.shiftrightunsigned(y, 1))):
            x = let(x, fold)
        return F.bit_count(x.bitwiseAND(0x0101010101010101))

    unequal = F.aggregate(F.zip_with(a, b, lambda x, y: unequal_bytes(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    equal = F.lit(BINS) - unequal
    chance = 1.0 / (1 << LOW_BITS)
    estimate = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(estimate)


def _number_below(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted numbers are not above x, by two steps: which run of them x is in, then which of the run."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    runs = F.size(F.filter(F.lit(cuts[::step]).cast("array<bigint>"), lambda c: c <= x))
    inside = F.slice(F.lit(cuts).cast("array<bigint>"), (runs - 1) * step + 1, step)
    return F.when(runs == 0, 0).otherwise((runs - 1) * step + F.size(F.filter(inside, lambda c: c <= x)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and fingerprint of every row, beside those of the next row in descending order of doc_id.

    Rows are dealt by buckets of consecutive ids, cut at approximate quantiles, so that ids far apart or in clumps make
    buckets of like sizes. The first row of each bucket is also dealt, as a guest, to the next higher bucket that has
    rows, so that the last row there has a next one; the lowest bucket's guest is the first row of all. There are at
    most ``BUCKETS`` cuts and guests' ids, which go to the driver and are broadcast. Rows without an id are in the lowest
    bucket. Jobs run while the result is planned.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_buckets = max(1, min(BUCKETS, docs.count() // BUCKET_ROWS))
    bucket = F.lit(0)
    if n_buckets > 1:
        parts = F.array(*(F.lit(k / n_buckets) for k in range(1, n_buckets)))
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", parts, 20 * n_buckets).alias("cuts")).first()["cuts"] or []))
        bucket = _number_below(F.coalesce("doc_id", F.lit(-1 << 63)), cuts)
    tops = docs.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("top"))
    up = Window.orderBy("bucket")  # one row for each bucket
    guests = tops.select("top", F.lead("bucket").over(up).alias("to"), F.min("bucket").over(Window.partitionBy()).alias("lowest"))
    guests = guests.select("top", F.coalesce("to", "lowest").alias("to"))
    own = docs.select(bucket.alias("bucket"), F.lit(False).alias("guest"), "doc_id", "text")
    sent = docs.join(F.broadcast(guests), docs["doc_id"].eqNullSafe(F.col("top"))).select(F.col("to").alias("bucket"), F.lit(True).alias("guest"), "doc_id", "text")
    rows = own.unionByName(sent).withColumn("packed", fingerprint(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    after = rows.select("*", F.lead(F.struct("text", "packed")).over(order).alias("next"))
    return after.filter(~F.col("guest")).select("doc_id", "text", "packed", F.col("next.text").alias("next_text"), F.col("next.packed").alias("next_packed"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: its last third is replaced by the next document's start."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("third")).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.col("third"))))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "packed", "next_packed", fingerprint(F.col("edited")).alias("edited_packed"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("packed")).alias("fingerprint"), as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"), likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
