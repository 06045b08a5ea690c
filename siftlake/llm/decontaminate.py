"""Benchmark decontamination by a distributed positional inverted index.

The index has the postings (term, row, position) of the training texts for all terms that a test item
uses, and one more posting per row, at its end, which tells its length and carries its id. A test
window is looked up from its rarest terms: the postings of the rarest, adjusted by the term's offset in
the window, give candidate starts; those of the second rarest are intersected with them; and for what
remains all other terms are looked up around their places. If all are at their places, it is an exact
match; if each is at most `slop` words off, a proximity match. No text is read twice, and no step works
on a group of rows: all are hash joins and aggregations on (row, position) or (window, row, start).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm._shared import ascii_lower, materialize

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The term of the posting at a row's end: no word is empty.
_END = ""
#: A table that is too large to be broadcast is joined by a shuffle, each key in so many parts, as
#: frequent words would go to one task otherwise.
SALTS = 16


def words(text: Column) -> Column:
    """Words of a text: runs of digits, ASCII letters (lower-cased) and characters above ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _BREAK, -1), "")


def _lookup(rows: DataFrame, small: DataFrame, key: str, most: int) -> DataFrame:
    """rows (with row and pos) joined to `small` by a key: by a broadcast if it has at most `most` rows."""
    if small.count() <= most:
        return rows.join(F.broadcast(small), key)
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [key, "__salt"]).drop("__salt")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """item_id, win (hash of the window's words) and terms (its words' hashes) of all test windows."""
    if not 1 <= size <= 62:
        raise ValueError("a window has 1 to 62 words")
    some = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    cut = some.select("item_id", "w", F.explode(starts).alias("at"))
    cut = cut.select("item_id", F.slice("w", F.col("at") + 1, F.lit(size)).alias("w"))
    return cut.select("item_id", F.xxhash64(F.array_join("w", " ")).alias("win"), F.transform("w", lambda x: F.xxhash64(x)).alias("terms"), "w").distinct()


def build_index(
    docs: DataFrame,
    vocabulary: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """Postings (row, pos, term) of the vocabulary's words, and the end of each row with its id and
    the columns `keep` in `of`. `row` numbers the rows of docs, whatever their ids."""
    terms = vocabulary.select("word").union(docs.sparkSession.range(1).select(F.lit(_END))).distinct()
    of = F.struct(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in keep])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), of.alias("of"), F.concat(words(F.col(text_col)), F.array(F.lit(_END))).alias("w"))
    tokens = rows.select("row", "of", F.posexplode("w").alias("pos", "word"))
    found = _lookup(tokens, terms, "word", broadcast_rows)
    return materialize(found.select("row", "pos", F.xxhash64("word").alias("term"), F.when(F.col("word") == _END, F.col("of")).alias("of")), "postings")


def phrase_matches(index: DataFrame, wins: DataFrame, slop: int = 0, broadcast_rows: int = 200_000) -> DataFrame:
    """(win, row, start, size, exact) of all places where a window occurs, its terms in order.

    With slop, also those with exact = false: start is where the window's rarest term puts it, and each
    other term stands at most slop words off its place.
    """
    frequency = materialize(index.groupBy("term").agg(F.count(F.lit(1)).alias("freq")), "frequencies")
    plain = wins.select("win", "terms").dropDuplicates(["win"])
    spread = plain.select("win", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term"))
    small = F.broadcast(frequency) if frequency.count() <= broadcast_rows else frequency
    ranked = (
        spread.join(small, "term")
        .groupBy("win", "size")
        .agg(F.array_sort(F.collect_list(F.struct("freq", "off", "term"))).alias("by_freq"))
        .where(F.size("by_freq") == F.col("size"))  # else a term of it is nowhere
    )
    ranked = materialize(ranked, "windows")
    postings = index.select("row", "pos", "term")

    def starts(rank: int) -> DataFrame:
        of = ranked.where(F.col("size") > rank).select("win", "size", F.col("by_freq")[rank]["off"].alias("off"), F.col("by_freq")[rank]["term"].alias("term"))
        return _lookup(postings, of, "term", broadcast_rows).select("win", "row", (F.col("pos") - F.col("off")).alias("start"), "size", "off")

    def bins(at: Column) -> Column:
        # places at most slop apart are in one bin, or in bins side by side
        own = F.floor(at / F.lit(slop + 1))
        return F.explode(F.sequence(own - 1, own + 1)) if slop else own

    def bit(off: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), off)

    none = F.lit(0).cast("long")
    first = starts(0)
    second = starts(1).select("win", "row", F.floor(F.col("start") / F.lit(slop + 1)).alias("bin"), F.col("start").alias("other"), F.col("off").alias("off_2"))
    single = first.where("size = 1").select("win", "row", "start", "size", bit(F.col("off")).alias("near"), bit(F.col("off")).alias("same"))
    both = first.where("size > 1").withColumn("bin", bins(F.col("start"))).join(second, ["win", "row", "bin"]).where(F.abs(F.col("start") - F.col("other")) <= slop)
    one, two = bit(F.col("off")), bit(F.col("off_2"))
    both = both.select("win", "row", "start", "size", one.bitwiseOR(two).alias("near"), one.bitwiseOR(F.when(F.col("start") == F.col("other"), two).otherwise(none)).alias("same"))
    pair = materialize(both.unionByName(single), "candidates")
    # the other terms, around their places
    windows_2 = ranked.select("win", F.slice("by_freq", F.lit(3), F.greatest(F.col("size") - 2, F.lit(0))).alias("others")).where(F.size("others") > 0)
    windows_2 = F.broadcast(windows_2) if ranked.count() <= broadcast_rows else windows_2
    others = pair.select("win", "row", "start", "size").distinct().join(windows_2, "win")
    others = others.select("win", "row", "start", "size", F.explode("others").alias("o"))
    others = others.select("win", "row", "start", "size", (F.col("start") + F.col("o.off")).alias("at"), F.col("o.term").alias("term"), F.col("o.off").alias("off")).withColumn("bin", bins(F.col("at")))
    here, wanted = pair.select("row").distinct(), others.select("term").distinct()
    here = F.broadcast(here) if here.count() <= 1_000_000 else here
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    around = postings.join(here, "row", "left_semi").join(wanted, "term", "left_semi").withColumn("bin", F.floor(F.col("pos") / F.lit(slop + 1)))
    found = others.join(around, ["row", "term", "bin"]).where(F.abs(F.col("at") - F.col("pos")) <= slop)
    found = found.select("win", "row", "start", "size", bit(F.col("off")).alias("near"), F.when(F.col("at") == F.col("pos"), bit(F.col("off"))).otherwise(none).alias("same"))
    known = pair.unionByName(found).groupBy("win", "row", "start", "size").agg(F.bit_or("near").alias("near"), F.bit_or("same").alias("same"))
    whole = bit(F.col("size")) - 1
    return known.where(F.col("near") == whole).select("win", "row", "start", "size", (F.col("same") == whole).alias("exact"))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    slop: int = 1,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (by exact
    matches), n_near (windows that match in proximity only, each word at most slop words off its
    place), and the columns `keep` of docs, which have other names.

    A null text has no words. Rows are told apart whatever their ids: rows with a repeated or null id
    each have their own hits. Items with a null id count as hits but not as items. Items without words
    have no window; other columns aren't read; empty tables give no rows or no hits.
    """
    wins = materialize(windows(items, item_col, item_text_col, size), "test-windows")
    index = build_index(docs, wins.select(F.explode("w").alias("word")).distinct(), id_col, text_col, keep)
    matches = materialize(phrase_matches(index, wins, slop), "hits")
    hits = matches.where("exact")
    covered = hits.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    near = matches.groupBy("row", "win").agg(F.bool_or("exact").alias("exact")).where("not exact").groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
    # windows of the same items are one class; rows with the same classes have the same items
    named = wins.where("item_id is not null").groupBy("win").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")).withColumn("class", F.xxhash64("items"))
    named = materialize(named, "classes")
    of_win = F.broadcast(named.select("win", "class")) if named.count() <= 200_000 else named.select("win", "class")
    classes = hits.select("row", "win").distinct().join(of_win, "win").select("row", "class").distinct()
    sets = materialize(classes.groupBy("row").agg(F.array_sort(F.collect_set("class")).alias("classes")).withColumn("set", F.xxhash64("classes")), "class-sets")
    each = sets.select("set", "classes").dropDuplicates(["set"]).select("set", F.explode("classes").alias("class"))
    listed = each.join(named.select("class", "items").dropDuplicates(["class"]), "class").select("set", F.explode("items").alias("item"))
    shown = listed.groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    shown = shown.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    ends = index.where(F.col("of").isNotNull()).select("row", "of.*", F.col("pos").cast("long").alias("n_words"))
    marks = covered.join(near, "row", "full_outer").join(sets.select("row", "set").join(shown, "set").drop("set"), "row", "left")
    out = ends.join(marks, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        F.coalesce("n_near", zero).alias("n_near"),
        *keep,
    )
