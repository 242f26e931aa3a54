"""Operator 6: benchmark decontamination by template windows.

Numbers, names and units become typed placeholders; windows of such template words are
hashed and joined with those of the benchmark.  A window with too few words that aren't
placeholders says little, so its own words are hashed instead, in lower case.  Items are
indexed as they stand and without their capitals, which copies in one case lack.

Windows that match along one diagonal (the same shift between document and item), or along
diagonals a few words apart, are put together.  Then either the words themselves agree, or
the values that fill the placeholders must follow from the item's: the passage is the item,
word for word or with other parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, text_key, without

WINDOW = 8
MIN_LITERALS = 4
MIN_COVERAGE = 0.5
MIN_WORDS = 25
VERBATIM = 0.8  # of an item's words
CONSISTENT = 0.8  # of the slots
SLIP = 3  # words by which neighbouring diagonals of one passage may differ
BROADCAST_ROWS = 500_000  # windows: three integers each
BROADCAST_PASSAGES = 20_000  # passages: the words of an item each

# Units of measure and money, as they stand in lower case.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "kilometre", "kilometres", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces",
    "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups", "second",
    "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents",
    "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh", "hz", "watt", "watts", "volt", "volts",
)
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million")
_DROPPED = ".,;:!?\"()[]{}«»“”„…¿¡*#"
_BLANKS = "\n\r\t\f\u000b "
_NUMBER = r"^[$€£+-]{0,2}\p{Nd}[\p{Nd}/%'-]*(?:st|nd|rd|th)?$"
_NAME = r"^\p{Lu}[\p{Ll}'’-]+$"
# Hashes that stand for slots; a word's own hash is never in this range but by chance.
NUMBER, UNIT, NAME = 1, 2, 3


def words(text: Column) -> Column:
    """Words parted by white space, without marks of punctuation; empty ones gone."""
    plain = F.translate(text, _BLANKS + _DROPPED, " " * len(_BLANKS))
    return F.array_remove(F.split(plain, " "), "")


def template_hash(word: Column) -> Column:
    """1 for a number, 2 for a unit, 3 for a name (a capital, then small letters), else the
    hash of the word in lower case."""
    low = F.lower(word)
    return (
        F.when(low.isin(*UNITS, *NUMBER_WORDS), F.when(low.isin(*UNITS), UNIT).otherwise(NUMBER))
        .when((word >= "a") & (word < "{"), F.xxhash64(low))  # a to z first: neither pattern can match
        .when(word.rlike(_NAME), NAME)
        .when(word.rlike(_NUMBER), NUMBER)
        .otherwise(F.xxhash64(low))
        .cast("long")
    )


def _hashed(df: DataFrame, w: str, keep: list[str]) -> DataFrame:
    """``keep``; the words ``w``; h, their template hashes; slots, a byte for each, 1 for a slot."""
    out = df.select(*keep, F.col(w).alias("w"), F.transform(w, lambda x: template_hash(x)).alias("h"))
    slots = F.array_join(F.transform("h", lambda x: F.when(_is_slot(x), "1").otherwise("0")), "")
    return out.select(*keep, "w", "h", slots.cast("binary").alias("slots"))


def _window_keys(k: int, min_literals: int) -> Column:
    """Key of each window of k words of ``_hashed``, in order; none if there are fewer words:
    the hash of its template words, or of the words themselves, in lower case, if fewer than
    ``min_literals`` of them are no slots."""
    at = F.sequence(F.lit(1), F.size("h") - k + 1)

    def key(i):
        literals = F.length(F.replace(F.substring("slots", i, F.lit(k)).cast("string"), F.lit("1"), F.lit("")))
        plain = F.xxhash64(F.lit(k), F.transform(F.slice("w", i, k), F.lower))
        return F.when(literals >= min_literals, F.xxhash64(F.slice("h", i, k))).otherwise(plain)

    return F.when(F.size("h") >= k, F.transform(at, key)).otherwise(F.array().cast("array<long>"))


def _is_slot(value: Column) -> Column:
    return value.isin(NUMBER, UNIT, NAME)


def _small(df: DataFrame, limit: int) -> bool:
    return df.limit(limit + 1).count() <= limit


def contaminated_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    window: int = WINDOW, min_literals: int = MIN_LITERALS, min_coverage: float = MIN_COVERAGE, min_words: int = MIN_WORDS,
) -> DataFrame:
    """doc_id, item_id, first_word, n_words, coverage, reparameterised: the passages of
    documents that repeat a benchmark item.

    A passage is reported when matching windows on one diagonal (document position less
    item position), or on diagonals that differ by SLIP words at most, cover
    ``min_coverage`` of the item's words or ``min_words`` of them, and

    * VERBATIM of the item's words, or ``min_words``, are the same in the document, case
      aside, or
    * each value in the item's slots stands for one value in the document, in CONSISTENT of
      the slots at least (so some may be edited).

    ``reparameterised`` is true if a value differs.  An item shorter than ``window`` words
    is one window of its own length.  A window with fewer than ``min_literals`` words (or
    than it has) that aren't slots matches word for word only.

    The benchmark's windows are counted and broadcast up to BROADCAST_ROWS; beyond, the
    join is shuffled on the window hash.  The same holds for the passages found when they
    return to their documents to compare words.

    Null or empty texts and null item ids match nothing.  Very long texts are read whole.
    Null doc_id: its passages are reported with a null doc_id.  Rows that occur again are
    each answered, repeated items once.  An empty benchmark or table gives no rows.  Other
    columns are not read.
    """
    return _passages(docs, benchmark, id_col, text_col, item_col, window, min_literals, min_coverage, min_words).drop("key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` (all columns) without the rows that hold a passage of the benchmark, as
    ``contaminated_passages`` finds them.  A row goes for its own text: one with the same id
    and another text stays.  Null and empty texts stay."""
    found = _passages(docs, benchmark, id_col, text_col, item_col, WINDOW, MIN_LITERALS, MIN_COVERAGE, MIN_WORDS)
    return without(docs, found.select("doc_id", "key"), id_col, text_col)


def _passages(docs, benchmark, id_col, text_col, item_col, window, min_literals, min_coverage, min_words) -> DataFrame:
    """``contaminated_passages`` with the ``text_key`` of each row."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    # Equal rows share this key and get equal answers.
    read = read.withColumn("key", text_key(F.col("text"))).withColumn("row", F.xxhash64("doc_id", "key"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null").distinct()
    items = items.withColumn("iw", words(F.col("text"))).where(F.size("iw") > 0)
    items = cut(items.select("item_id", F.xxhash64("item_id", "text").alias("item"), "iw", F.transform("iw", F.lower).alias("low")))
    indexed = cut(_hashed(items, "iw", ["item"]).unionByName(_hashed(items, "low", ["item"])))
    lengths = [r[0] for r in items.select(F.least(F.size("iw"), F.lit(window)).alias("k")).distinct().orderBy("k").collect()]  # at most ``window`` rows
    hashed = _hashed(read.withColumn("w", words(F.col("text"))), "w", ["row"])
    matched = None
    for k in lengths:
        need = min(min_literals, k)
        own = indexed.where(F.least(F.size("h"), F.lit(window)) == k)
        own = own.select("item", F.size("h").alias("n_item"), F.posexplode(_window_keys(k, need)).alias("ipos", "key")).distinct()
        here = hashed.select("row", F.posexplode(_window_keys(k, need)).alias("pos", "key"))
        hits = here.join(F.broadcast(own) if _small(own, BROADCAST_ROWS) else own, "key")
        hits = hits.select("row", "item", "n_item", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos", F.lit(k).alias("k"))
        matched = hits if matched is None else matched.unionByName(hits)
    schema = "doc_id long, key long, item_id long, first_word int, n_words int, coverage double, reparameterised boolean"
    if matched is None:
        return docs.sparkSession.createDataFrame([], schema)
    # Equal rows bring their windows together: hence the sets.
    lines = matched.groupBy("row", "item", "shift", "n_item", "k").agg(F.collect_set("ipos").alias("at"))
    beside = W.partitionBy("row", "item").orderBy("shift")
    lines = lines.withColumn("new", (F.col("shift") - F.lag("shift").over(beside) > SLIP).cast("int")).withColumn("passage", F.sum(F.coalesce("new", F.lit(0))).over(beside))
    # Places of the item that windows cover, each with the first diagonal that has it.
    place = lambda p: F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: p + j)
    covers = F.struct("shift", F.array_sort(F.array_distinct(F.flatten(F.transform("at", place)))).alias("p"))
    runs = lines.groupBy("row", "item", "n_item", "passage").agg(F.array_sort(F.collect_list(covers)).alias("lines"))
    runs = runs.withColumn("covered", F.size(F.array_distinct(F.flatten(F.col("lines.p")))))
    runs = runs.where((F.col("covered") >= F.lit(min_coverage) * F.col("n_item")) | (F.col("covered") >= min_words))
    runs = cut(runs.join(items.select("item", "item_id", "low", F.transform("iw", lambda x: template_hash(x)).alias("ih")), "item"))
    both = read.join(F.broadcast(runs) if _small(runs, BROADCAST_PASSAGES) else runs, "row").withColumn("w", words(F.col("text")))
    word = lambda p, d: F.struct(F.get("low", p).alias("i"), F.lower(F.get("w", p + d)).alias("d"), _is_slot(F.get("ih", p)).alias("slot"))
    pairs = F.flatten(F.transform("lines", lambda x: F.transform(x["p"], lambda p: word(p, x["shift"]))))
    both = both.withColumn("pairs", pairs).withColumn("slots", F.filter("pairs", lambda x: x["slot"]))
    both = both.withColumn("values", F.array_distinct("slots")).withColumn("from", F.array_distinct(F.col("slots.i")))
    times = lambda v: F.size(F.filter("slots", lambda x: x == v))
    follow = F.aggregate("from", F.lit(0), lambda n, i: n + F.array_max(F.transform(F.filter("values", lambda v: v["i"] == i), times)))
    # Diagonals side by side may bring a place twice: no more than the item has count.
    same = F.least(F.size(F.filter("pairs", lambda x: x["i"] == x["d"])), F.col("covered"))
    verbatim = (same >= F.lit(VERBATIM) * F.col("n_item")) | (same >= min_words)
    both = both.where(verbatim | (follow >= F.lit(CONSISTENT) * F.size("slots")))
    first = F.array_min(F.transform("lines", lambda x: F.array_min(x["p"]) + x["shift"]))
    return both.select(
        "doc_id", "key", "item_id", first.cast("int").alias("first_word"), F.col("covered").cast("int").alias("n_words"),
        (F.col("covered") / F.col("n_item")).alias("coverage"), F.exists("pairs", lambda x: x["i"] != x["d"]).alias("reparameterised"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contaminated_passages`` of all documents and all items of the benchmark."""
    return contaminated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
