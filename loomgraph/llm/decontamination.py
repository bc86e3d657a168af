"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions alone.

The index holds the postings (row, place) of every word of the documents that some test item has; each document also has
the posting of the empty word at place 0, which carries its id and its number of words.  Postings are written where the
documents are read, so the index costs no shuffle, and its own counts say how rare each word is.

A window's words are taken from the rarest on.  The postings of the rarest, less its offset in the window, are the
candidates; the list of the next one, adjusted by its own offset, is intersected with them by a join on the document, the
word and the place; what is left, few of them, meets the lists of all other words at once.  Places may miss by ``slop``:
a match without a miss is an exact phrase, any other one a proximity match.  Joins go by runs of ``_RUN`` places, of which
a search needs one or two, and a run holds a word ``_RUN`` times at most, so a word repeated over and over multiplies
nothing.

Only tables whose size was measured are broadcast; larger ones meet by shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import materialize, scratch_scope

# Fixed value: what words are made of, before A-Z give way to lower case.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = 16
#: Bytes that a table may have to be broadcast.
BROADCAST = 32 << 20


def raw_words(text: Column) -> Column:
    """The words of a text in order, as they are written; none of a null."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(_WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A word with A-Z, and no other letters, in lower case."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _small(table: DataFrame, row_bytes: int) -> DataFrame:
    """table, to be broadcast if its measured size allows it.  row_bytes: the most that a row has."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST else table


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(window, words)``, each run of ``size`` words of an item once (an item of fewer words is one window), and
    ``(window, item)``, the items that have it (a string, null where the item has no id)."""
    words = F.transform(raw_words(F.col(text_col)), lowered)
    rows = items.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    runs = rows.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), size).alias("words"))
    windows = materialize(runs.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return windows, materialize(runs.join(windows, "words").select("window", "item").distinct(), "window-items")


def postings(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, term, pos, doc_id, n_words)``: the places, from 1, of the words of vocabulary (word, term), and term 0 at
    place 0 of each row, which alone has doc_id and n_words."""
    vocabulary = vocabulary.select("word", "term").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).cast("long").alias("term")))
    longest = vocabulary.agg(F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    words = F.concat(F.array(F.lit("")), raw_words(F.col(text_col)))
    tokens = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words.alias("w"))
    placed = tokens.select("row", "doc_id", (F.size("w") - 1).cast("long").alias("n"), F.posexplode("w").alias("pos", "raw"))
    named = placed.select("row", "pos", "doc_id", "n", lowered(F.col("raw")).alias("word"))
    first = F.col("pos") == 0
    found = named.join(F.broadcast(vocabulary) if longest <= BROADCAST else vocabulary, "word")
    return found.select("row", "term", "pos", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("n")).alias("n_words"))


def vocabulary_of(windows: DataFrame) -> DataFrame:
    """``(word, term)``: the words of windows, with numbers from 1 on that are the same whenever they are read."""
    words = windows.select(F.explode("words").alias("word")).distinct()
    return materialize(words.select("word", (F.monotonically_increasing_id() + 1).alias("term")), "vocabulary")


def by_rarity(windows: DataFrame, vocabulary: DataFrame, index: DataFrame) -> DataFrame:
    """``(window, terms)`` of the windows all of whose words the index has: terms, array<struct<n, at, term>>, has their
    words from the rarest on, with their offsets."""
    counts = materialize(index.groupBy("term").agg(F.count("*").alias("n")).join(vocabulary, "term"), "word-counts")
    placed = windows.select("window", F.size("words").alias("length"), F.posexplode("words").alias("at", "word")).join(_small(counts, 256), "word")
    ordered = placed.groupBy("window", "length").agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("terms"))
    return ordered.where(F.size("terms") == F.col("length")).select("window", "terms")


def _runs(pos: Column, slop: int) -> Column:
    low, high = F.floor((pos - slop) / _RUN), F.floor((pos + slop) / _RUN)
    return F.when(low == high, F.array(low)).otherwise(F.array(low, high))


def phrase_matches(index: DataFrame, ordered: DataFrame, slop: int = 0) -> DataFrame:
    """``(row, window, start, length, exact)``: where windows occur.  start is the place of the window's first word as its
    rarest word (of equals the first) has it; every other word has a place at most ``slop`` from its own.  exact: no
    place differs.

    Words that a window repeats may share an occurrence if slop allows it.
    """
    run = F.floor(F.col("pos") / _RUN)
    lists = index.where("term > 0").select("row", "term", "pos")
    first, second = F.col("terms")[0], F.try_element_at("terms", F.lit(2))
    heads = materialize(ordered.select("window", "terms", F.size("terms").alias("length"), first["term"].alias("term"), first["at"].alias("at"), second["term"].alias("term2"), second["at"].alias("at2")), "window-order")

    candidates = lists.join(_small(heads.select("window", "term", "at", "length", "term2", "at2"), 160), "term").select(
        "row", "window", "length", "term2", "at2", (F.col("pos") - F.col("at")).alias("start")
    )
    candidates = candidates.where(F.col("start") >= (1 if not slop else 1 - slop))
    single = candidates.where("length = 1").select("row", "window", "start", "length", F.lit(0).alias("miss"))
    asked = candidates.where("length > 1").withColumn("wanted", F.col("start") + F.col("at2"))
    asked = asked.select("row", F.col("term2").alias("term"), F.explode(_runs(F.col("wanted"), slop)).alias("run"), "window", "length", "start", "wanted")
    needed = lists.join(_small(heads.where("length > 1").select(F.col("term2").alias("term")).distinct(), 24), "term", "left_semi").withColumn("run", run)
    far = F.abs(F.col("pos") - F.col("wanted"))
    met = asked.join(needed, ["row", "term", "run"]).where(far <= slop)
    met = met.groupBy("row", "window", "start", "length").agg(F.min(far).alias("miss"))
    two = materialize(met.unionByName(single), "candidates")

    rest = two.join(_small(heads.select("window", "terms"), 600), "window").select("row", "window", "start", F.explode(F.slice("terms", 3, 1 << 20)).alias("t"))
    rest = rest.select("row", "window", "start", F.col("t.term").alias("term"), F.col("t.at").alias("at"), (F.col("start") + F.col("t.at")).alias("wanted"))
    rest = rest.withColumn("run", F.explode(_runs(F.col("wanted"), slop)))
    rows = _small(two.where("length > 2").select("row").distinct(), 24)
    there = lists.join(rows, "row", "left_semi").withColumn("run", run)
    each = rest.join(there, ["row", "term", "run"]).where(far <= slop).groupBy("row", "window", "start", "at").agg(F.min(far).alias("far"))
    whole = each.groupBy("row", "window", "start").agg(F.count("*").alias("found"), F.max("far").alias("most"))
    checked = two.join(whole, ["row", "window", "start"], "left").where(F.coalesce("found", F.lit(0)) == F.greatest(F.col("length") - 2, F.lit(0)))
    return checked.select("row", "window", "start", "length", (F.greatest("miss", F.coalesce("most", F.lit(0))) == 0).alias("exact"))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, slop: int = 2
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items)``, one row for each row of docs.

    n_hit: words inside an exact occurrence of a window of ``size`` words; n_items and items_sha256: the items with
    such windows, their ids sorted as strings and joined by commas; n_near_items: the items with windows that occur
    exactly or with places that miss by at most ``slop``.

    Null and empty texts have no words: as documents they are clean, as items they have no window.  Rows that share an id,
    or have none, are documents each.  Items that share an id count once; windows of an item without id hit, but the item
    is neither counted nor listed.  Other columns play no part.  Without items, or with empty ones alone, every document is clean;
    without documents the result is empty.
    """
    with scratch_scope(docs.sparkSession) as kept:
        windows, of_item = item_windows(items, item_col, item_text_col, size)
        vocabulary = vocabulary_of(windows)
        index = materialize(postings(docs, vocabulary, id_col, text_col), "postings")
        found = materialize(phrase_matches(index, by_rarity(windows, vocabulary, index), slop), "matches")
        hits = found.where("exact").select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
        n_hit = hits.groupBy("row").agg(F.count("*").alias("n_hit"))
        # Documents often share their set of windows: a set's items are listed once.
        sets = found.groupBy("row").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("window")))).alias("whole"), F.sort_array(F.collect_set("window")).alias("near"))
        sets = materialize(sets, "window-sets")
        distinct = sets.select(F.explode(F.array("whole", "near")).alias("windows")).distinct()
        listed = distinct.select("windows", F.explode("windows").alias("window")).join(of_item, "window").groupBy("windows").agg(F.array_sort(F.collect_set("item")).alias("items"))
        listed = materialize(listed.select("windows", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha")), "window-set-items")
        whole = listed.select(F.col("windows").alias("whole"), F.col("n").alias("n_items"), F.col("sha").alias("items_sha256"))
        near = listed.select(F.col("windows").alias("near"), F.col("n").alias("n_near_items"))
        marked = sets.join(whole, "whole", "left").join(near, "near", "left").join(n_hit, "row", "left")
        marked = materialize(marked.select("row", "n_hit", "n_items", "items_sha256", "n_near_items"), "contaminated")
        documents = materialize(index.where("term = 0").select("row", "doc_id", "n_words"), "documents")
        kept += [documents, marked]
    none = F.lit(0).cast("long")
    return documents.join(marked, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"), F.coalesce("n_near_items", none).alias("n_near_items"),
    )
