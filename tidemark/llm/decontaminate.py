"""Benchmark decontamination by spaced seeds, by DataFrame functions alone.

Fixed masks pick some of the words behind a position and ignore the others; the hash of the picked words is joined
between documents and benchmark items. Around each hit the words of both sides are compared along its diagonal. A
document is contaminated by an item when WINDOW consecutive words of the item (the whole item, if it is shorter) meet
as many words of the document with at least a share of 0.8 equal. The masks hit every such overlap: tests check all
placements of the substitutions. Items of WINDOW words and more have heavier masks than shorter ones, so that common
phrases of a few words make no candidates.

A hit needs only the words around it, so a candidate is a document, an item, a diagonal and a stretch of STRETCH
positions. Its words come from the document's block of BLOCK words, by a join: no list of candidates is ever gathered,
and a document or block with many of them is split like any skewed key. Equality along the diagonal is one 64-bit
number, and the best window the largest count of ones in it.

A seed whose places on both sides would make more than LIGHT times as many pairs as there are places is a common phrase.
Its hits aren't paired: each window of WINDOW words around it gets further keys instead. Its other words are dealt into
one group more than it may have unequal ones, so two windows that overlap agree in all words of some group, and the hash
of the words known so far and those of a group is the next key. Keys that are still common are taken further, until so
many words are known that every pair of the key is an overlap, or few pairs are left to be compared. Equal windows are
one row throughout, so the rows stay in proportion to the places, whatever both sides share.

Items of fewer than MIN_WORDS words leave no word to ignore: they are found where all their words stand in a row.

Words are runs of letters and digits, lower-cased. Defined results: null and empty texts match nothing, nor do items
without words; every row is judged by its own text, also where rows share
a doc_id or have none (contaminated() gives what any row of an id holds, null for those without); a very long text is
cut into blocks; repeated rows give the result of one; empty tables give an empty result; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, materialize, word_hashes

#: Offsets of the words that a seed looks at, for items of at least WINDOW words and for shorter ones.
LONG_MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 8, 9, 10), (0, 1, 3, 5, 6, 10))
SHORT_MASKS = ((0, 2, 3, 4), (0, 2, 5, 6))
WINDOW, MIN_WORDS, SHARE = 15, 8, 0.8
#: Positions of a candidate, and words of a block. What a candidate looks at (its positions, the longest mask and the rest
#: of a window on both sides) has at most 64 words.
STRETCH, BLOCK = 16, 1024
REACH = WINDOW - 1
LOOK = REACH + STRETCH + 10 + REACH
#: Pairs of a seed or key, as a multiple of its places on both sides, beyond which it is told apart by further words.
LIGHT = 16
#: A benchmark of up to so many characters is broadcast; a larger one is joined by shuffles.
BROADCAST_CHARS = 8_000_000


def _seeds(texts: DataFrame, keys: list[str], masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """A row for each position and mask: keys, pos, seed."""
    offsets = sorted({o for m in masks for o in m})
    around = lambda h: F.transform(h, lambda _, i: F.struct(*[F.get(h, i + o).alias(f"w{o}") for o in offsets]))
    placed = texts.select(*keys, F.posexplode(let(word_hashes(F.col("text")), around)).alias("pos", "w")).select(*keys, "pos", "w.*")
    seeds = [F.when(F.col(f"w{m[-1]}").isNotNull(), F.xxhash64(F.lit(str(m)), *[F.col(f"w{o}") for o in m])) for m in masks]
    return placed.select(*keys, "pos", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _matched(here: Column, item: Column, start: Column, diagonal: Column) -> tuple[Column, Column]:
    """The most ones of WINDOW neighbours in a column bits, and these bits: the equal words among LOOK words of a block from start on.

    diagonal: position in the block minus position in the item.
    """
    # Words beyond the item are unequal, so a window that leaves it finds no more than one that doesn't.
    same = lambda t: F.coalesce(F.get(here, start + t) == F.get(item, start + t - diagonal), F.lit(False))
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(LOOK - 1)), F.lit(0).cast("long"), lambda a, t: F.shiftleft(a, 1).bitwiseOR(same(t).cast("long")))
    full = F.lit((1 << WINDOW) - 1).cast("long")
    best = F.greatest(*[F.bit_count(F.shiftrightunsigned("bits", s).bitwiseAND(full)) for s in range(LOOK - WINDOW + 1)])
    return best, bits


def _verbatim(texts: DataFrame, items: DataFrame, lengths: list[int], small) -> DataFrame:
    """What _found() gives, for items of a few words: the mask of such an item is its length."""
    masks = {n: tuple(range(n)) for n in lengths}
    seed = F.coalesce(*[F.when(F.size("item_h") == n, F.xxhash64(F.lit(str(m)), *[F.get("item_h", o) for o in m])) for n, m in masks.items()])
    theirs = items.select(seed.alias("seed"), "item_id", F.size("item_h").alias("window_words")).distinct()
    hits = _seeds(texts, ["doc_id", "row"], tuple(masks.values())).join(small(theirs), "seed")
    return hits.select("doc_id", "row", "item_id", "window_words", F.lit(None).cast("long").alias("bits"), F.col("window_words").alias("matched")).distinct()


def _blocks(texts: DataFrame, places: DataFrame) -> DataFrame:
    """_id, _row, _block and here (the words in reach) of the blocks in which places (doc_id, row, block) lie."""
    asked = materialize(places.groupBy("doc_id", "row").agg(F.collect_set("block").alias("blocks"))).toDF("_id", "_row", "blocks")  # as many as the text has at most
    of_text = texts["doc_id"].eqNullSafe(asked["_id"]) & (texts["row"] == asked["_row"])
    cut = lambda h: F.transform("blocks", lambda b: F.struct(b.alias("block"), F.slice(h, F.greatest(b * BLOCK - REACH, F.lit(0)) + 1, BLOCK + LOOK).alias("here")))
    blocks = texts.join(asked, of_text).select("doc_id", "row", F.explode(let(word_hashes(F.col("text")), cut)).alias("b"))
    return blocks.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("b.block").alias("_block"), "b.here")


def _in_block(places: DataFrame, blocks: DataFrame) -> DataFrame:
    return places.join(blocks, places["doc_id"].eqNullSafe(blocks["_id"]) & (places["row"] == blocks["_row"]) & (places["block"] == blocks["_block"]))


def _block(pos: Column) -> Column:
    """The block of the stretch in which a position lies."""
    return F.floor(F.floor(pos / STRETCH) * STRETCH / BLOCK).cast("int")


def _width(words: str | Column) -> Column:
    return F.least(F.lit(WINDOW), words)


def _may_differ(width: str) -> Column:
    """Words of a window that may be unequal."""
    return F.col(width) - F.ceil(F.col(width) * F.lit(SHARE))


def _crowded(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """The keys of both sides, with crowded where the pairs are too many."""
    sizes = ours.groupBy(key).agg(F.count(F.lit(1)).alias("a")).join(theirs.groupBy(key).agg(F.count(F.lit(1)).alias("b")), key)
    pairs, places = F.col("a").cast("double") * F.col("b"), F.col("a") + F.col("b")
    return sizes.select(key, (pairs > LIGHT * places).alias("crowded"))


def _item_windows(theirs: DataFrame, items: DataFrame) -> DataFrame:
    """The windows of items around their seeds: seed, off (of the seed in the window), key, width, free (offsets of the other words), win, w, item_id."""
    n, last = F.col("n"), F.element_at("mask", -1)
    off = F.sequence(F.greatest(F.lit(0), F.col("item_pos") - n + _width(n)), F.least(F.col("item_pos"), _width(n) - 1 - last))
    laid = theirs.withColumn("width", _width(n)).withColumn("off", F.explode(off)).join(items.select("item_id", "item_h").where(F.size("item_h") >= MIN_WORDS), "item_id").where(F.size("item_h") == n)
    free = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda t: ~F.array_contains("mask", t - F.col("off")))
    laid = laid.select("seed", "off", F.xxhash64("seed", "width", "off").alias("key"), "width", free.alias("free"), F.slice("item_h", F.col("item_pos") - F.col("off") + 1, F.col("width")).alias("w"), "item_id")
    return laid.withColumn("win", F.xxhash64("w")).distinct()


def _next(windows: DataFrame) -> DataFrame:
    """Windows with the keys that one more group of their words makes."""
    groups = _may_differ("width") + 1
    told = windows.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)))
    mine = F.filter("free", lambda t, i: F.pmod(i, groups) == F.col("g"))
    left = F.filter("free", lambda t, i: F.pmod(i, groups) != F.col("g"))
    told = told.withColumn("said", F.transform(mine, lambda t: F.get("w", t))).where(~F.exists("said", lambda x: x.isNull()))
    return told.select(F.xxhash64("key", "g", "said").alias("key"), "width", left.alias("free"), "win", "w").dropDuplicates(["key", "win"])


def _overlaps(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """win, item_win, window_words and matched of the overlapping windows among those of an equal key (key, width, free, win, w)."""
    found = None
    while True:
        sizes = _crowded(ours, theirs, "key")
        told = F.size("free") <= _may_differ("width")  # every pair of such a key is an overlap
        ours, theirs = (materialize(side.join(sizes, "key").withColumn("crowded", F.col("crowded") & ~told)) for side in (ours, theirs))
        few = theirs.where(~F.col("crowded")).select("key", F.col("win").alias("item_win"), F.col("w").alias("item_w"))
        same = F.size(F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda t: F.get("w", t) == F.get("item_w", t)))
        pairs = ours.where(~F.col("crowded")).join(few, "key").select("win", "item_win", F.col("width").alias("window_words"), same.alias("matched"))
        pairs = materialize(pairs.where(F.col("matched") >= F.ceil(F.col("window_words") * F.lit(SHARE))).distinct())
        found = pairs if found is None else found.unionByName(pairs)
        ours, theirs = (side.where("crowded").drop("crowded") for side in (ours, theirs))
        if theirs.isEmpty():
            return found
        ours, theirs = (materialize(_next(side)) for side in (ours, theirs))


def _of_phrases(texts: DataFrame, hits: DataFrame, theirs: DataFrame, items: DataFrame) -> DataFrame:
    """What _found() gives, for the overlaps around the places (doc_id, row, pos, seed) of crowded seeds."""
    windows = materialize(_item_windows(theirs, items))
    combos = windows.select("seed", "off", "key", "width", "free").distinct()
    places = materialize(hits.join(combos, "seed").select("doc_id", "row", (F.col("pos") - F.col("off")).alias("start"), _block(F.col("pos")).alias("block"), "key", "width", "free"))
    begin = F.col("start") - F.greatest(F.col("block") * BLOCK - REACH, F.lit(0))  # among the block's words
    words = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda t: F.get("here", begin + t))
    laid = _in_block(places, _blocks(texts, places)).withColumn("w", words).withColumn("win", F.xxhash64("w", F.transform("w", lambda x: x.isNull())))  # a hash passes over nulls
    laid = materialize(laid.select("doc_id", "row", "key", "width", "free", "win", "w"))
    pairs = _overlaps(laid.drop("doc_id", "row").dropDuplicates(["key", "win"]), windows.drop("seed", "off", "item_id").dropDuplicates(["key", "win"]))
    found = pairs.join(laid.select("doc_id", "row", "win").distinct(), "win").join(windows.select("item_id", F.col("win").alias("item_win")).distinct(), "item_win")
    return found.select("doc_id", "row", "item_id", "window_words", F.lit(None).cast("long").alias("bits"), "matched")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row (a hash that tells rows of one doc_id apart), item_id, matched and window_words of each overlap."""
    items = benchmark.select("item_id", "text").where("item_id is not null").distinct()
    items = items.withColumn("item_h", word_hashes(F.col("text"))).where(F.size("item_h") > 0).withColumn("n", F.size("item_h"))
    about = benchmark.select(F.length("text").alias("chars"), F.size(word_hashes(F.col("text"))).alias("n"))
    few = F.sort_array(F.collect_set(F.when(F.col("n").between(1, MIN_WORDS - 1), F.col("n")))).alias("few")
    size = about.agg(F.sum("chars").alias("chars"), F.bool_or(F.col("n").between(MIN_WORDS, WINDOW - 1)).alias("short"), few).first()
    small = F.broadcast if (size.chars or 0) <= BROADCAST_CHARS else (lambda df: df)
    theirs = None
    for mask in LONG_MASKS + (SHORT_MASKS if size.short else ()):
        own = items.where(F.col("n") >= WINDOW) if mask in LONG_MASKS else items.where(F.col("n").between(MIN_WORDS, WINDOW - 1))
        own = _seeds(own, ["item_id", "n"], (mask,)).withColumn("mask", F.array(*map(F.lit, mask)))
        theirs = own if theirs is None else theirs.unionByName(own)
    theirs = materialize(theirs.select("seed", "item_id", "n", F.col("pos").alias("item_pos"), "mask").distinct())

    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text").where("text is not null")
    seeds = _seeds(texts, ["doc_id", "row"], LONG_MASKS + (SHORT_MASKS if size.short else ()))
    asked = materialize(seeds.join(small(theirs.select("seed").distinct()), "seed"))
    phrases = materialize(_crowded(asked, theirs, "seed").where("crowded").select("seed"))
    hits = asked.join(phrases, "seed", "left_anti").join(small(theirs), "seed")
    stretch = F.floor(F.col("pos") / STRETCH).cast("int").alias("stretch")
    # Written out, so that a small table of candidates is broadcast to the texts, and a large one split where it is skewed.
    near = materialize(hits.select("doc_id", "row", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), stretch).distinct())
    near = near.withColumn("block", _block(F.col("stretch") * STRETCH))

    laid = _in_block(near, _blocks(texts, near)).join(small(items.select("item_id", "item_h")), "item_id")
    begin = F.greatest(F.col("block") * BLOCK - REACH, F.lit(0))  # of the block's words
    best, bits = _matched(F.col("here"), F.col("item_h"), F.col("stretch") * STRETCH - REACH - begin, F.col("diagonal") - begin)
    judged = laid.select("doc_id", "row", "item_id", _width(F.size("item_h")).alias("window_words"), bits.alias("bits")).withColumn("matched", best)
    found = judged.where(F.col("matched") >= F.ceil(F.col("window_words") * F.lit(SHARE)))
    if not phrases.isEmpty():
        found = found.unionByName(_of_phrases(texts, asked.join(phrases, "seed"), theirs.join(phrases, "seed"), items))
    if not size.few:
        return found
    return found.unionByName(_verbatim(texts, items.where(F.col("n") < MIN_WORDS), size.few, small))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched_words, window_words for each item that a document overlaps."""
    found = _found(docs, benchmark).groupBy("doc_id", "item_id")
    return found.agg(F.max("matched").cast("long").alias("matched_words"), F.max("window_words").cast("long").alias("window_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows."""
    leaks = materialize(_found(docs, benchmark).select("doc_id", "row").distinct()).toDF("_leak_id", "_leak_row")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_leak_id"]) & (F.xxhash64(docs["text"]) == leaks["_leak_row"]), "left_anti")


#: The definition itself, for unique doc_ids: every window of every item against every document, on a diagonal found by any equal word.
SQL = r"""
with dw as (
  select distinct doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
  from documents),
iw as (
  select distinct item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
  from benchmark where item_id is not null),
items as (select item_id, w, len(w) as n, least(15, len(w)) as width from iw where len(w) > 0),
d as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from dw),
i as (select item_id, n, width, unnest(w) as word, generate_subscripts(w, 1) as pos from items),
same as (
  select d.doc_id, i.item_id, i.n, i.width, d.pos - i.pos as diagonal, i.pos
  from d join i on d.word = i.word),
near as (
  select doc_id, item_id, diagonal, width, pos,
         count(*) over (partition by doc_id, item_id, diagonal order by pos range between current row and 14 following) as matched,
         n from same)
select doc_id, item_id, max(matched)::bigint as matched_words, max(width)::bigint as window_words
from near where matched >= case when width < 8 then width else ceil(width * 0.8) end group by doc_id, item_id
"""
