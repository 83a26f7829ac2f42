"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ten consecutive words (the whole item if it is shorter).  A
document contains a window only if it contains the window's rarest word, so that word is the one
necessary prefix token: document words are joined to the windows on it, the position of the token
in the window and the document's length bound where the window must lie, and the words there are
compared with the window exactly.  Rarity is counted over all documents, so tokens that stand in
many documents propose almost nothing.

Documents are split into words once and saved with a row number, until all blocks are matched.  The windows are broadcast in
blocks of a fixed number of rows, without the items that hold them; a benchmark of any size is
joined block after block, so what is broadcast never grows with the data, and each block's matches
are saved.  Documents are not shuffled: only matched positions and one narrow row per document are,
keyed by the row.  Items are joined to the distinct windows that a document holds.

Words are compared after lower-casing A-Z, and only A-Z: Unicode lower case depends on what stands
beside a letter (capital sigma), so a word would not be the same in a text and in a window.

Defined results: null texts have no words; rows are judged singly, also when an id repeats or is
null; items without an id mark words but are not listed; an empty table gives an empty result,
an empty benchmark clean documents; further columns are not read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm import cluster

WINDOW = 10
#: Rows of windows in one broadcast; a row holds at most ten words.
BLOCK_ROWS = 50_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows, holders): the distinct windows as wid, window (words joined by a space) and words, and
    (wid, item) for the items that hold them.  Both are saved, so a wid stays what it is."""
    words = items.select(F.col(id_col).cast("string").alias("item"), _words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = words.select("item", "w", F.explode(starts).alias("at")).select("item", F.expr(f"slice(w, at, {size})").alias("words"))
    cut = cluster.saved(cut.select("item", F.array_join("words", " ").alias("window"), "words").distinct())
    windows = cluster.saved(cut.groupBy("window").agg(F.first("words").alias("words")).withColumn("wid", F.monotonically_increasing_id()))
    holders = cut.where("item IS NOT NULL").select("item", "window").join(windows.select("wid", "window"), "window").select("wid", "item")
    return windows, cluster.saved(holders)


def prefix_tokens(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Each window with its rarest word over all documents and where that stands in it."""
    vocabulary = windows.select(F.explode("words").alias("token")).distinct()
    # the vocabulary of one block of windows: at most WINDOW * BLOCK_ROWS words
    counts = rows.select(F.explode("low").alias("token")).join(F.broadcast(vocabulary), "token", "left_semi").groupBy("token").count()
    each = windows.select("wid", "window", "words", F.posexplode("words").alias("at", "token"))
    # counts has a row for each word of a block at most, so it too is bounded
    ranked = each.join(F.broadcast(counts), "token", "left").groupBy("wid").agg(F.first("window").alias("window"), F.first("words").alias("words"), F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "at")).alias("rarest"))
    return ranked.select(F.col("rarest.token").alias("token"), F.col("rarest.at").alias("at"), F.size("words").alias("length"), "window", "wid")


def _matches(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(row, start, length, wid): verified occurrences."""
    tokens = rows.select("row", "low", F.posexplode("low").alias("pos", "token"))
    near = tokens.join(F.broadcast(prefixes), "token").withColumn("start", F.col("pos") - F.col("at"))
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.size("low"))
    there = F.when(fits, F.array_join(F.slice("low", F.greatest(F.col("start") + 1, F.lit(1)), F.col("length")), " ") == F.col("window"))
    return near.where(F.coalesce(there, F.lit(False))).select("row", "start", "length", "wid")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: row, id, n_words, n_hit (words inside any occurrence of an item
    window) and items (the sorted ids of items with occurring windows)."""
    windows, holders = item_windows(benchmark, item_id_col, item_text_col, size)
    blocks = max(1, -(-windows.count() // block_rows))
    path = cluster.shared_dir(docs.sparkSession)
    rows = cluster.saved_at(path, docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), _words(F.col(text_col)).alias("low")))
    found = []
    for b in range(blocks):
        block = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        found.append(cluster.saved(_matches(rows, prefix_tokens(block, rows))))
    found = reduce(DataFrame.unionByName, found)
    rows = cluster.saved(rows.select("row", "id", F.size("low").cast("bigint").alias("n_words")))
    cluster.discard(docs.sparkSession, path)  # all matches are saved
    spans = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(F.greatest(a.end, s.start + s.length).alias("end"), (a.n + F.greatest(F.lit(0), s.start + s.length - F.greatest(a.end, s.start))).alias("n")),
        lambda a: a.n,
    )
    listed = found.select("row", "wid").distinct().join(holders, "wid").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = spans.select("row", covered.alias("n_hit")).join(listed, "row", "left")
    out = rows.join(hit, "row", "left")
    return out.select("row", "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
