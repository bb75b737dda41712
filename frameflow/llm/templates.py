"""Benchmark decontamination by templates, DataFrame functions only.

Numbers, names and units become typed placeholders; a window of a document that reads
like a window of a benchmark item up to its placeholders is a leak when the values in
the slots correspond one to one. So a question with other names or numbers is found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, checkpoint

#: Words per window; a window needs this many that aren't placeholders.
WINDOW, LITERAL = 8, 5
# Words that are units where they follow a number.
UNITS = ("mm cm m km in ft yd mi mg g kg t oz lb ml l s ms min h hr hrs sec secs hour hours minute minutes second seconds "
         "day days week weeks month months year years meter meters metre metres mile miles gram grams liter liters litre litres "
         "dollar dollars cent cents euro euros percent degree degrees usd eur gbp").split()


def words_of(text: Column) -> Column:
    """Words without any sign but letters, marks and digits; words of signs alone vanish."""
    plain = F.regexp_replace(text.cast("string"), r"[^\p{L}\p{N}\p{M} \t\n\x0B\f\r]+", "")
    return F.split(F.btrim(F.coalesce(plain, F.lit("")), F.lit(" \t\n\x0b\f\r")), r"[ \t\n\x0B\f\r]+")


def kind_of(words: Column, i: Column) -> Column:
    """num, unit, name, or null for a literal word."""
    word, before = words[i], F.when(i > 0, words[i - 1])
    return (F.when(word.rlike(r"^\p{N}+$"), "<num>").when(word.rlike(r"^\p{N}+\p{L}+$"), "<num-unit>")
            .when(F.lower(word).isin(UNITS) & F.coalesce(before.rlike(r"^\p{N}+$"), F.lit(False)), "<unit>")
            .when(word.rlike(r"^\p{Lu}"), "<name>"))


def template(words: Column) -> Column:
    """The window's words in lower case, with placeholders."""
    return F.transform(words, lambda w, i: F.coalesce(kind_of(words, i), F.lower(w)))


def literal_count(template_words: Column) -> Column:
    return F.size(F.filter(template_words, lambda w: ~w.startswith("<")))


def slots_agree(doc: Column, item: Column, shape: Column) -> Column:
    """The slots' values correspond one to one: equal pairs, never a half of one."""
    def distinct(value) -> Column:
        slots = F.filter(F.transform(shape, lambda t, i: F.when(t.startswith("<"), value(t, i))), lambda v: v.isNotNull())
        return F.size(F.array_distinct(slots))
    pairs = distinct(lambda t, i: F.concat_ws("\t", t, doc[i], item[i]))
    return (pairs == distinct(lambda t, i: F.concat_ws("\t", t, doc[i]))) & (
        pairs == distinct(lambda t, i: F.concat_ws("\t", t, item[i])))


def item_windows(items: DataFrame, key: str, text: str, k: int, literal: int) -> DataFrame:
    """item, at, of (windows of the item), n, item_words and shape of every window with
    enough literal words. An item under k words is one window."""
    words = items.select(F.col(key).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") >= literal)
    n = F.least(F.size("words"), F.lit(k))
    starts = words.select("item", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("at"))
    cut = starts.select("item", "at", (F.size("words") - F.col("n") + 1).alias("of"), "n",
                        F.slice("words", F.col("at") + 1, F.col("n")).alias("item_words"))
    shaped = cut.withColumn("shape", template(F.col("item_words")))
    return shaped.where(literal_count(F.col("shape")) >= literal)


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", *,
          item_key: str = "item_id", item_text: str = "text", k: int = WINDOW, literal: int = LITERAL,
          broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(key, item key, n_windows, item_windows, exact): documents that hold an item.

    One row per document and item that share a window: k consecutive words equal up to
    numbers, names (words with a capital) and units, at least `literal` of them no
    placeholder, and slot values that correspond one to one. n_windows counts the item's
    windows found, item_windows those it has; `exact` says that in all found windows the
    values are the same. An item shorter than k words is one window; items and texts
    under `literal` words, null and empty texts match nothing. Rows with a null key of
    either table are left out; rows that share a key count as one. Other columns are
    ignored.

    Each item window is looked up by its rarest literal word, counted over all
    documents; documents' windows around that word are hashed as templates and joined.
    The tables of words and windows of the items are broadcast up to `broadcast_rows`
    counted rows, and joined by a shuffle beyond. Windows are cut where all of a
    document's places are known, so that no row but its own carries its text.
    """
    windows = checkpoint(item_windows(items.where(F.col(item_key).isNotNull()), item_key, item_text, k, literal))
    n_windows = windows.count()

    def bounded(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n_windows * k <= broadcast_rows else df
    literals = windows.select(F.explode(F.filter("shape", lambda w: ~w.startswith("<"))).alias("word")).distinct()
    docs = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    seen = docs.select(F.explode_outer("words").alias("raw")).select(F.lower("raw").alias("word"))
    counts = seen.join(bounded(literals), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    placed = windows.select("item", "at", "n", F.posexplode("shape").alias("offset", "word")).where(~F.col("word").startswith("<"))
    # a window whose rarest word is in no document cannot be in one
    rare = (placed.join(counts, "word", "left").groupBy("item", "at", "n")
            .agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "word", "offset")).alias("least"))
            .where("least.times > 0").select(F.col("least.word").alias("word"), F.col("least.offset").alias("offset"), "n").distinct())
    rare = checkpoint(rare)

    spots = docs.select("key", F.posexplode_outer("words").alias("place", "raw")).select("key", "place", F.lower("raw").alias("word"))
    start = F.col("place") - F.col("offset")
    near = spots.join(bounded(rare), "word").where(start >= 0).groupBy("key").agg(
        F.collect_set(F.struct(start.alias("start"), "n")).alias("near"))
    # one row per document meets its text; only windows leave it
    cut = F.transform("near", lambda s: F.slice("words", s["start"] + 1, s["n"]))
    found = docs.join(near, "key").select("key", F.explode(cut).alias("doc_words"))
    shaped = found.withColumn("shape", template(F.col("doc_words")))
    joined = shaped.withColumn("_hash", F.xxhash64("shape")).join(
        bounded(windows.withColumn("_hash", F.xxhash64("shape")).withColumnRenamed("shape", "item_shape")), "_hash")
    same = joined.where((F.col("shape") == F.col("item_shape")) & slots_agree(F.col("doc_words"), F.col("item_words"), F.col("shape")))
    values = F.transform("doc_words", lambda w: F.lower(w)) == F.transform("item_words", lambda w: F.lower(w))
    per_window = same.groupBy("key", "item", "at", "of").agg(F.max(values.cast("int")).alias("same"))
    return per_window.groupBy(F.col("key").alias(key), F.col("item").alias(item_key)).agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("of").cast("long").alias("item_windows"), (F.min("same") == 1).alias("exact"))
