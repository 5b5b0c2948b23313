"""Document fingerprints by one-permutation MinHash (operator 5): DataFrame functions only.

Each word shingle is hashed once. The top bits name one of BINS bins, which keeps its least hash. An empty bin takes the
value of the filled bin that comes first in an order of its own (optimal densification: every empty bin chooses
independently and alike for all documents). Of each bin the low BITS bits are stored, as hex digits. The likeness
of two fingerprints is the share of equal bins, corrected for bins that are equal by chance (1 in 2^BITS).

Words are lower-cased and cut at ASCII white space; a text of fewer than five words has one shingle, all its words.
Null text is the empty text. Texts without words have an empty fingerprint: likeness 1 to each other, 0 to others.
Rows go by descending doc_id, null last, equal ids by a hash of their text, then by text; a single row follows itself. An empty table gives
no rows; extra columns are ignored. Texts beyond LONG_CHARS are cut into parts of PART_WORDS words, each with the last four words before it; their hashes are
rows, of which a grouped aggregate keeps the least of each bin.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import written

WORDS, BIN_BITS, BITS = 5, 7, 8
BINS = 1 << BIN_BITS
#: Characters beyond which a text is hashed in parts, and words of a part: WORDS at least.
LONG_CHARS, PART_WORDS = 1 << 20, 256
#: Rows that a range of doc_ids should hold, ranges that are told apart by one list of bounds (a multiple of GROUPS), and parts of these at
#: most. So there are some 2 x COARSE x FINE ranges at most, whatever the input; beyond 2.6e8 rows ranges get longer, and their sort spills.
RANGE_ROWS, GROUPS, FINE = 2000, 128, 8
COARSE = GROUPS * GROUPS
NO_ID = -(1 << 63)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    return let(
        words,
        lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n))))
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>")),
    )


def _bin(h: Column) -> Column:
    """The bin of a hash: its top bits, in the order of signed numbers."""
    return F.shiftright(h, 64 - BIN_BITS).cast("int") + BINS // 2


def bin_values(text: Column, n: int = WORDS) -> Column:
    """BINS hashes, empty bins filled; an empty array without words."""

    def least(hashes: Column) -> Column:
        return F.filter(hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(hashes, i - 1))))

    return let(F.sort_array(shingle_hashes(text, n)), lambda s: let(least(s), densified))


def densified(filled: Column) -> Column:
    """All bins' hashes from those of the filled bins in order."""

    def borrowed(b: Column, filled: Column) -> Column:
        return F.array_min(F.transform(filled, lambda v: F.struct(F.xxhash64(b, _bin(v)).alias("turn"), v.alias("v"))))["v"]

    def dense(filled: Column) -> Column:
        return let(
            F.map_from_arrays(F.transform(filled, _bin), filled),
            lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at(m, b), borrowed(b, filled))),
        )

    return F.when((F.size(filled) == BINS) | (F.size(filled) == 0), filled).otherwise(dense(filled))


def digits_of(values: Column) -> Column:
    """Low bits of all bins as hex digits, two for each bin."""
    low = F.transform(values, lambda v: F.lower(F.lpad(F.hex(v.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))), BITS // 4, "0")))
    return F.array_join(low, "")


def fingerprint(text: Column, n: int = WORDS) -> Column:
    """Low bits of all bins as hex digits, two for each bin; empty without words."""
    return digits_of(bin_values(text, n))


def parts(text: Column, n: int = WORDS) -> Column:
    """Parts of PART_WORDS words, each but the first with the n - 1 words before it: together they have the shingles of the text, each once."""
    # White space goes with the word before it; what comes before the first word is left out.
    cut = F.regexp_extract_all(text, F.lit(rf"(?:\S++\s*+){{1,{PART_WORDS}}}"), F.lit(0))
    before = lambda p: F.array_join(F.slice(F.filter(F.split(p, r"\s+"), lambda w: w != ""), -(n - 1), n - 1), " ")
    return let(cut, lambda p: F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.concat_ws(" ", before(F.get(p, i - 1)), x))))


def long_prints(df: DataFrame, key: str, text: str, n: int = WORDS) -> DataFrame:
    """key, print for each key of df: the fingerprint of its text, by rows of hashes. Rows of one key have one text."""
    cut = df.select(key, F.explode(parts(F.col(text), n)).alias("_part")).select(key, F.explode(shingle_hashes(F.col("_part"), n)).alias("_hash"))
    least = cut.groupBy(key, _bin(F.col("_hash")).alias("_bin")).agg(F.min("_hash").alias("_hash"))
    filled = least.groupBy(key).agg(F.sort_array(F.collect_list("_hash")).alias("_filled"))  # BINS values at most
    return filled.select(key, digits_of(densified(F.col("_filled"))).alias("print"))


def printed(df: DataFrame, text: str, name: str, any_long: bool) -> DataFrame:
    """df with the fingerprints of a column. any_long: there may be texts beyond LONG_CHARS; then df is read twice."""
    if not any_long:
        return df.withColumn(name, fingerprint(F.col(text)))
    long = F.length(text) > LONG_CHARS
    keyed = df.where(long).withColumn("_text_key", F.sha2(F.col(text).cast("binary"), 256))
    # Rows of one text give the same hashes, whose least are the same.
    prints = long_prints(keyed, "_text_key", text).withColumnRenamed("print", name).withColumnRenamed("_text_key", "_print_key")
    found = keyed.join(prints, F.col("_text_key") == F.col("_print_key"), "left").drop("_text_key", "_print_key")
    return df.where(~long).withColumn(name, fingerprint(F.col(text))).unionByName(found.withColumn(name, F.coalesce(name, F.lit(""))))


def longest(docs: DataFrame) -> int:
    """Characters of the longest text."""
    return docs.agg(F.max(F.length("text"))).first()[0] or 0


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1."""
    width, chance = BITS // 4, 2.0**-BITS
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * width + 1, F.lit(width)) == F.substring(b, i * width + 1, F.lit(width)))) / BINS
    estimate = F.least(F.greatest((equal - chance) / (1 - chance), F.lit(0.0)), F.lit(1.0))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(estimate)


def _below(bounds: Column, key: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b < key))


def _longs(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<bigint>")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below key, found in two steps of some GROUPS comparisons."""
    if len(bounds) < GROUPS:
        return _below(_longs(bounds), key) if bounds else F.lit(0)
    parts = [bounds[i : i + GROUPS] for i in range(0, len(bounds), GROUPS)]
    fine = F.array(*map(_longs, parts))
    return let(_below(_longs([p[-1] for p in parts[:-1]]), key), lambda g: g * GROUPS + _below(F.get(fine, g), key))


def ranged(base: DataFrame, rows: int) -> DataFrame:
    """base with _range, which rises with (_key, _tie): about RANGE_ROWS rows each.

    Bounds are percentiles of _key, COARSE at most; beyond that number each such range is cut again by its own percentiles. A key
    that fills several ranges is cut by _tie, a hash that spreads evenly, into as many parts.
    """
    wanted = max(64, -(-rows // RANGE_ROWS))
    coarse = min(COARSE, wanted)
    cuts = sorted(base.agg(F.percentile_approx("_key", [k / coarse for k in range(1, coarse)], 10 * coarse)).first()[0] or [])
    bounds = sorted(set(cuts))
    out = base.withColumn("_first", _range_of(F.col("_key"), bounds))
    fine = min(FINE, -(-wanted // coarse))
    if fine > 1:
        # A list for each coarse range: at most COARSE x FINE numbers.
        lists = written(out.groupBy("_first").agg(F.percentile_approx("_key", [k / fine for k in range(1, fine)], 10 * fine).alias("_cuts")), "range-cuts")
        lists = lists.select(F.col("_first").alias("_f"), F.array_sort(F.array_distinct("_cuts")).alias("_cuts"))
        out = out.join(F.broadcast(lists), F.col("_first") == F.col("_f")).withColumn("_second", _below(F.col("_cuts"), F.col("_key"))).drop("_f", "_cuts")
    else:
        out = out.withColumn("_second", F.lit(0))
    # Keys that several cuts name: as many as there are cuts at most.
    heavy = {k: n * fine for k, n in Counter(cuts).items() if n > 1}
    parts = F.coalesce(F.try_element_at(F.map_from_arrays(_longs([*heavy]), _longs([*heavy.values()])), F.col("_key")), F.lit(1)) if heavy else F.lit(1)
    third = F.floor((F.shiftright("_tie", 32) + (1 << 31)) * parts / float(1 << 32)).cast("long")
    return out.withColumn("_range", (F.col("_first").cast("long") * (2 * GROUPS) + F.col("_second")) * (1 << 24) + third).drop("_first", "_second")


def with_next(docs: DataFrame, any_long: bool | None = None) -> DataFrame:
    """doc_id, text, print, next_text, next_print: each document's fingerprint and what follows by descending doc_id; the first follows the last.

    One shuffle, by ranges of doc_id. Each range also gets the first document of the range that follows, so no window
    spans more than a range.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("_key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    any_long = longest(docs) > LONG_CHARS if any_long is None else any_long
    base = ranged(base, base.count())
    # The first row of each range: as many rows as there are ranges, a number with a bound (above). Ties go from the greatest hash on, as keys do.
    first = F.struct("_key", "_tie")
    heads = written(base.groupBy("_range").agg(F.max(first).alias("_head")), "range-heads").select(F.col("_range").alias("_r"), "_head")
    texts = base.join(F.broadcast(heads), (F.col("_range") == F.col("_r")) & (first == F.col("_head"))).groupBy("_range").agg(F.min("text").alias("text"))
    order = Window.orderBy(F.desc("_range"))  # rows are ranges, whose number has a bound
    after = texts.select("_range", F.lead("_range").over(order).alias("_after"))
    top = written(after, "range-order")
    start = texts.select(F.col("_range").alias("_s"), "text")
    greatest = top.agg(F.max("_range").alias("_top"))
    follow = top.crossJoin(F.broadcast(greatest)).select("_range", F.coalesce("_after", "_top").alias("_s")).join(start, "_s")  # one row joined to each
    follow = follow.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("_key"), "text", F.lit(0).cast("long").alias("_tie"), "_range", F.lit(1).alias("_after"))
    both = printed(base.withColumn("_after", F.lit(0)).unionByName(follow), "text", "print", any_long)
    order = Window.partitionBy("_range").orderBy("_after", F.desc("_key"), F.desc("_tie"), "text")
    out = both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_print", F.lead("print").over(order))
    return out.where("_after = 0").select("doc_id", "text", "print", "next_text", "next_print")


def digest(docs: DataFrame, any_long: bool | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    any_long = longest(docs) > LONG_CHARS if any_long is None else any_long
    out = with_next(docs, any_long)
    out = written(out, "with-next") if any_long else out
    out = printed(out.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited), "edited", "edited_print", any_long)
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))
