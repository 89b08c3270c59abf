"""Benchmark decontamination by winnowing, with DataFrame and SQL functions only.

A text is lower-cased (A-Z) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A benchmark item of WINDOW words or
more has a window at each place; a shorter one, but not an empty one, is one window. Winnowing keeps, of every run of
WINDOW - GRAM + 1 neighbouring k-grams, the one of least hash (the leftmost of equal ones): two texts that share WINDOW
words therefore keep a common k-gram within them. Documents and items meet on the kept hashes, and each meeting is
extended word by word over every window that contains it; only windows whose words are equal count.

Defined cases: a null or wordless text has no words and no hits; rows of equal id and text are judged alike and all
returned; items of equal words are one item with several ids; items whose id is null are not named but still hit;
with an empty benchmark nothing is hit. Other columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
GRAM = 5
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The benchmark side of the join is broadcast only up to this many bytes (estimated from its rows), else both sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Of the 64 bits of a kept k-gram, the place in the text takes the lower ones.
_PLACE_BITS = 28
_PLACE = (1 << _PLACE_BITS) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value), with value computed once even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD_PATTERN), F.lit(0))


def kept_grams(words: Column, window: int, gram: int) -> Column:
    """The winnowed k-grams of a word array as longs: hash in the upper bits, place in the lower ones. Empty below window words."""
    n = F.size(words)
    run = window - gram + 1

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - gram), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(gram)]).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long")))

    def least(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - window), lambda i: F.least(*[F.get(g, i + j) for j in range(run)]))

    def once(m: Column) -> Column:
        return F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1)))

    got = let(let(let(F.transform(words, lambda w: F.xxhash64(w)), grams), least), once)
    return F.when(n >= window, got).otherwise(F.array().cast("array<bigint>"))


_SPOTS = "array<struct<key:bigint,place:int,length:int>>"


def _spot(key: Column, place: Column | int, length: int) -> Column:
    return F.struct(key.alias("key"), (F.lit(place) if isinstance(place, int) else place).cast("int").alias("place"), F.lit(length).alias("length"))


def _long_spots(words: Column, window: int, gram: int) -> Column:
    """(key, place, length) of each kept k-gram."""
    return F.transform(kept_grams(words, window, gram), lambda v: _spot(F.shiftright(v, _PLACE_BITS), v.bitwiseAND(F.lit(_PLACE)), window))


def _short_spots(words: Column, length: int) -> Column:
    """The spots of all runs of a given length; the key holds the length, so that lengths don't mix."""
    n, key = F.size(words), lambda i: F.shiftright(F.xxhash64(F.slice(words, i + 1, length), F.lit(length)), _PLACE_BITS)
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), lambda i: _spot(key(i), i, length))).otherwise(F.array().cast(_SPOTS))


def _around(words: Column, place: Column, length: Column, window: int, gram: int) -> tuple[Column, Column]:
    """(words before the spot, those words and what follows): all that a window which contains the spot can hold."""
    left = F.when(length == window, F.least(place, F.lit(window - gram))).otherwise(F.lit(0))
    return left, F.slice(words, F.greatest(place, F.lit(0)) - left + 1, left + length)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items (sorted ids) and spans (merged word ranges [start, end) that are hit)."""
    found = _hits(docs, items, id_col, text_col, item_col, item_text_col, window, gram)
    found = found.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", "times")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_copy", "times")


def _hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per group of equal rows of an input partition: id, print, times, n_words, n_hit, items and spans."""
    bench = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    bench = bench.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    stats = bench.select(F.size("words").alias("n"), F.octet_length(F.array_join("words", " ")).alias("b"), F.size("ids").alias("k"))
    stats = stats.groupBy(F.when(F.col("n") < window, F.col("n")).alias("short")).agg(F.sum("b").alias("b"), F.sum(F.col("n") * (F.col("k") * 16 + 64)).alias("rows")).collect()
    short = sorted(r["short"] for r in stats if r["short"] is not None)
    small = sum(4 * window * r["b"] + r["rows"] for r in stats) <= BROADCAST_BYTES
    theirs = F.when(F.size("words") >= window, _long_spots(F.col("words"), window, gram))
    for length in short:
        theirs = theirs.when(F.size("words") == length, _short_spots(F.col("words"), length))
    left, around = _around(F.col("words"), F.col("s.place"), F.col("s.length"), window, gram)
    theirs = bench.select("ids", "words", F.explode(theirs).alias("s")).select("ids", "s.key", F.col("s.length").alias("item_length"), left.alias("item_left"), around.alias("item_around"))
    # A passage that many items hold is one row with all their ids.
    theirs = theirs.groupBy("key", "item_length", "item_left", "item_around").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))

    mine = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("print"), F.spark_partition_id().alias("part"), words_of(F.col(text_col)).alias("words"))

    def spots(words: Column) -> Column:
        own = F.array(F.struct((F.xxhash64("id", "print").bitwiseAND(F.lit((1 << 40) - 1)) + F.lit(1 << 40)).alias("key"), F.lit(-1).alias("place"), F.size(words).alias("length")))
        return F.concat(own, _long_spots(words, window, gram), *[_short_spots(words, n) for n in short])

    # Each row has a spot of its own that meets nothing and holds the number of words: so one pass gives both counts and hits.
    # With the benchmark broadcast, the words around a spot are cut out after the join, for the few spots that meet one.
    left, around = _around(F.col("words"), F.col("place"), F.col("length"), window, gram)
    mine = mine.select("id", "print", "part", "words", F.explode(spots(F.col("words"))).alias("s")).select("id", "print", "part", "words", "s.*")
    if small:
        met = mine.join(F.broadcast(theirs), "key", "left")
    else:
        met = mine.withColumns({"left": left, "around": around}).drop("words").join(theirs, "key", "left")
    met = met.where((F.col("place") < 0) | (F.col("item_length") == F.col("length")))
    if small:
        met = met.withColumns({"left": left, "around": around}).drop("words")

    def equal_at(s: Column) -> Column:
        a = F.slice("around", F.greatest(F.col("left") - s, F.lit(0)) + 1, F.col("length"))
        b = F.slice("item_around", F.greatest(F.col("item_left") - s, F.lit(0)) + 1, F.col("length"))
        return (s <= F.col("left")) & (s <= F.col("item_left")) & (F.size(a) == F.col("length")) & (a == b)

    steps = F.when(F.col("length") == window, F.sequence(F.lit(0), F.lit(window - gram))).otherwise(F.array(F.lit(0)))
    starts = F.when(F.col("place") < 0, F.array(F.lit(-1))).otherwise(F.transform(F.filter(steps, equal_at), lambda s: F.col("place") - s))
    hits = met.select("id", "print", "part", "length", "ids", F.explode(starts).alias("start"))
    own = F.col("start") < 0
    per = hits.groupBy("id", "print", "part").agg(
        F.max(F.when(own, F.col("length"))).cast("long").alias("n_words"),
        F.count(F.when(own, F.lit(1))).alias("times"),
        F.array_sort(F.collect_set(F.when(~own, F.struct("start", (F.col("start") + F.col("length")).alias("end"))))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(~own, F.col("ids")))))).alias("items"),
    )

    def widen(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["start"]), joined).otherwise(F.concat(acc, F.array(x)))

    spans = F.aggregate("runs", F.array().cast("array<struct<start:int,end:int>>"), widen)
    return per.withColumn("spans", spans).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs. Rows of equal id are judged each by its text."""
    bad = _hits(docs, items, id_col, text_col).where("n_hit > 0").select(F.col("id").alias("_bad"), F.col("print").alias("_bad_print")).distinct()
    same = docs[id_col].eqNullSafe(bad["_bad"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad["_bad_print"])
    return docs.join(bad, same, "left_anti")
