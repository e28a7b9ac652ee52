"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line's words are its runs of [^\\x20\\x09-\\x0D], lower-cased. A line goes when an earlier line (by document id,
then place) has the same words, or words one edit away (a word put in, left out or exchanged) where the shorter of
the two has MIN_WORDS words or more. Earlier lines count even if they go themselves. Blank lines stay.

Distinct lines are found by hashes of their words. Two lines one edit apart have their first or last half of words
in common (the shorter one's length m gives halves of floor(m / 2) words), so only lines that share such a half with
another one go on. These emit a hashed key for each place where the edit may be: the words before it with those after it, the place's
word deleted (a deletion variant), or with none deleted (the line whole, cut there). All lines of a key are then
within one edit of each other, so each needs only the key's earliest line; the pair's words are compared before
the line goes. Keys are chained hashes from either end, so a line of n words costs n.

Keys with very many lines (a common opening, a line that differs in a number) are summed before they are dealt out, and
joined back by a join whose skewed partitions Spark splits.

Null text stays null. A null id comes before all others; documents that share an id, or have none, follow each other by
a hash of their texts, and rows that share both count as one document and keep or lose their lines alike. A document
whose lines all go has empty text. Repeated lines within a document count like any others. An empty table gives no rows;
all columns are kept but those of the counts (n_lines and n_kept), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, saved

MIN_WORDS = 8


def _some(line: Column) -> Column:
    """Whether a line has a word."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""


def _words(line: Column) -> Column:
    """The words of a line; splitting at blanks is much cheaper than matching words."""
    low = F.lower(line)
    odd = low.contains("\t") | low.contains("\x0b") | low.contains("\x0c") | low.contains("\r") | low.contains("\n")
    return F.array_remove(F.split(F.when(odd, F.translate(low, "\t\x0b\x0c\r\n", "     ")).otherwise(low), " "), "")


def _half(m: Column, side: int) -> Column:
    q = F.floor(m / 2).cast("int")
    part = F.slice("w", F.lit(1), q) if side == 0 else F.slice("w", F.col("n") - q + 1, q)
    return F.when(m >= F.lit(0), F.xxhash64(part, m, F.lit(side)))


def _chain(forward: bool) -> Column:
    """Hashes of the words before each place, first to last, or from each place on, last to first."""
    words = F.col("w") if forward else F.reverse("w")
    seed = F.array(F.lit(42).cast("long"))
    return F.aggregate(words, seed, lambda a, x: F.concat(a, F.array(F.xxhash64(F.element_at(a, -1), x))))


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows of keyed whose key has several lines h."""
    several = keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
    return keyed.join(several.hint("shuffle_hash"), "key")  # few of all keys


def dropped(lines: DataFrame, docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (h, n, first), and the h of those that have an earlier line one edit away."""
    n, m = F.col("n"), min_words
    halves = [F.when(n >= m, _half(n, s)) for s in (0, 1)] + [F.when(n - 1 >= m, _half(n - 1, s)) for s in (0, 1)]
    hashed = lines.select("doc_id", "text_hash", "pos", F.xxhash64("w").alias("h"), "n", *[k.alias(f"k{i}") for i, k in enumerate(halves)])
    distinct = hashed.groupBy("h", "n").agg(F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(4)])
    distinct = saved(distinct, "lines")
    sides = F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(i % 2).alias("side")) for i in range(4)])
    keys = distinct.where(n >= m).select("h", F.explode(sides).alias("k")).where("k.key is not null").select("h", "k.key", "k.side")
    shared = _shared(keys).groupBy("h").agg(F.bool_or(F.col("side") == 0).alias("front"), F.bool_or(F.col("side") == 1).alias("back"))
    # with but the first half in common the edit is behind it, with but the last one before it
    half = F.floor((n - 1) / 2).cast("int")
    low, high = F.when(~F.col("back"), half).otherwise(0), F.when(~F.col("front"), n - half).otherwise(n)
    asked = distinct.join(shared, "h").select("h", "n", "first", low.alias("low"), high.alias("high"))
    # at most a document's own lines
    wanted = asked.groupBy(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("own_hash")).agg(F.collect_list(F.struct("first.pos", "h", "n", "first", "low", "high")).alias("wanted"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("own_hash"))).select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("x"))
    texts = texts.select("x.h", "x.n", "x.first", "x.low", "x.high", _words(F.get("all", F.col("x.pos"))).alias("w"))
    # repeated rows give their lines more than once
    texts = saved(texts.where(F.xxhash64("w") == F.col("h")).dropDuplicates(["h", "n"]), "texts")
    chained = texts.select("h", "n", "low", "high", _chain(True).alias("p"), F.reverse(_chain(False)).alias("q"))
    # p[i]: the words before place i; q[i]: the words from place i on
    variants = F.transform(F.sequence(F.col("low"), F.least(F.col("high"), n - 1)), lambda i: F.xxhash64(F.get("p", i), F.get("q", i + 1), n - 1))
    cuts = F.transform(F.sequence(F.col("low"), F.col("high")), lambda i: F.xxhash64(F.get("p", i), F.get("q", i), n))
    keyed = saved(chained.select("h", F.explode(F.array_distinct(F.concat(variants, cuts))).alias("key")), "keyed")
    # most keys have one line; the others are few enough to carry the lines' places
    met = saved(_shared(keyed).join(texts.select("h", "first"), "h"), "met")
    release(keyed)
    earliest = met.groupBy("key").agg(F.min(F.struct("first", "h")).alias("e"))
    pairs = met.join(earliest, "key").where("e.h <> h and e.first < first").select("h", F.col("e.h").alias("h2")).distinct()
    one, two = texts.select("h", F.col("w").alias("a")), texts.select(F.col("h").alias("h2"), F.col("w").alias("b"))
    both = pairs.join(one, "h").join(two, "h2")
    short, long = F.least(F.size("a"), F.size("b")), F.greatest(F.size("a"), F.size("b"))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int")
    rest_a = F.slice("a", F.col("at") + F.when(F.size("a") >= F.size("b"), 1).otherwise(0), F.size("a"))
    rest_b = F.slice("b", F.col("at") + F.when(F.size("b") >= F.size("a"), 1).otherwise(0), F.size("b"))
    near = both.withColumn("at", differ).where((short >= m) & (long - short <= 1) & (rest_a == rest_b))
    near = saved(near.select("h").distinct(), "near")
    release(met, texts)
    return distinct, near


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text", counts: tuple[str, str] = ("n_lines", "n_kept")) -> DataFrame:
    """docs with lines removed from the text column, and two counts of lines that are not blank, before and after."""
    plain = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    lines = plain.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # a filter on the words themselves would be pushed below and split every line twice
    lines = lines.where(_some(F.col("line"))).select("doc_id", "text_hash", "pos", _words(F.col("line")).alias("w")).withColumn("n", F.size("w"))
    distinct, near = dropped(lines, plain, min_words)
    kept = distinct.join(near, "h", "left_anti").groupBy(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash")).agg(F.collect_set("first.pos").alias("kept_at"))
    columns = [c for c in docs.columns if c.lower() not in counts]
    rows = docs.select(F.struct(id_column, *[f"`{c}`" for c in columns if c not in (id_column, text_column)]).alias("row"), F.col(text_column).alias("text"))
    joined = rows.join(kept, F.col(f"row.`{id_column}`").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_hash")), "left")
    joined = joined.withColumn("every", F.split("text", "\n")).withColumn("some", F.coalesce("kept_at", F.array().cast("array<int>")))
    blank = F.filter(F.transform("every", lambda x, i: F.when(_some(x), -1).otherwise(i)), lambda i: i >= 0)
    joined = joined.withColumn("blank", blank).withColumn("count", F.size("every") - F.size("blank"))
    joined = joined.withColumn("places", F.array_union("some", "blank"))
    places = F.array_sort("places")
    text = F.when(F.size("places") == F.size("every"), F.col("text")).otherwise(F.array_join(F.transform(places, lambda p: F.get("every", p)), "\n"))
    none = F.col("text").isNull()
    out = [text.alias(c) if c == text_column else F.col(f"row.`{c}`") for c in columns]
    return joined.select(*out, F.when(none, 0).otherwise(F.col("count")).cast("long").alias(counts[0]), F.when(none, 0).otherwise(F.size("some")).cast("long").alias(counts[1]))
