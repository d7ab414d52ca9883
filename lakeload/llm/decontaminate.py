"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, capitalised names and units become typed placeholders, so a question asked with other
values has the same template. Windows of template words are hashed and joined. Where a document
and an item meet, the item is aligned with the document's words around the place. The item is found
if enough words are the same, in order, or if enough template words are and the values in its slots
map one to one.

All windows of the items are indexed, as templates and as words in lower case, so a run of as many
common words of either kind is found for certain. Windows are of ``WINDOW`` words, or of half the
item's if that is less, so one changed word leaves one whole. Template windows in which neither two
words nor a third are themselves are not indexed, windows of words all are.

A window is looked up by its rarest word: a document's words are compared with those, and only where
one stands is a window hashed, at the offsets that this word has in windows. How rare a word is comes
from a count over all documents and changes what a run costs, not what it finds.

Words put in or left out move what follows them. The item is aligned with as many of the document's
words, and ``SLACK`` times as many before and after, by the longest common subsequence: the text
may have so many words put in on either side of the run that met, at one place or several.

Results for odd input: null texts count as empty; an item without words is never found, one with
placeholders only by its own words; null ids and repeated rows are taken together by id and text, one result
for each; texts are read whole; of several places in a document the best counts; ties are no matter, as
all items found are returned; empty tables give no rows; other columns are not read, and may have any
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import checked_broadcast, row_key, text_of, without, written

WINDOW = 8
# Words that may stand between parts of an item, to either side, as a share of its length.
SLACK = 0.6
# Least share of an item's words that must stand in the document at one place.
SHARE = 0.7
# Bits of a number that hold an alignment's state; two are left for the sign and a carry.
LIMB = 62
FULL = (1 << LIMB) - 1

# What stands between words.
BETWEEN = r"[^\p{L}\p{M}\p{Nd}]+"

# Abbreviations of units.
UNITS = (
    "km cm mm mi ft yd kg mg lb lbs oz ml kmh kph mph ms min mins hr hrs sec secs "
    "gb mb kb kw kwh hz khz mhz ghz usd eur gbp percent"
).split()

# --- Words and templates ----------------------------------------------------------------------


def _spaced(text: Column) -> Column:
    """The words of a text, a space before and after each."""
    return F.concat(F.lit(" "), F.regexp_replace(text, BETWEEN, " "), F.lit(" "))


def _split(spaced: Column) -> Column:
    words = F.trim(spaced)
    return F.when(words != "", F.split(words, " ")).otherwise(F.array().cast("array<string>"))


def _lower_words(text: Column) -> Column:
    return _split(F.lower(_spaced(text)))


def _templates(text: Column) -> Column:
    """Placeholders of the words' types, and other words in lower case; as many as there are words.

    Whole texts are rewritten, which is compiled code, where a function on each word is not.
    """
    named = F.regexp_replace(_spaced(text), r" \p{Lu}\p{Ll}+(?= )", " <name>")
    counted = F.regexp_replace(F.lower(named), r" \p{Nd}[^ ]*", " <num>")
    return _split(F.regexp_replace(counted, f" (?:{'|'.join(UNITS)})(?= )", " <unit>"))


def _placeholder(word: Column) -> Column:
    return F.startswith(word, F.lit("<"))


def _tokens(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and the row's ``words`` and ``templates``.

    Both come out of a generator, so that what is made of them word by word does not make them anew.
    """
    text = text_of()
    both = F.array(F.struct(_lower_words(text).alias("words"), _templates(text).alias("templates")))
    return docs.select(*row_key(), F.inline(both))


# --- Items and their windows ------------------------------------------------------------------


def prepared_items(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``item`` (a key of id and text), its ``n`` words and templates, and its window."""
    rows = benchmark.select("item_id", text_of().alias("text")).distinct()
    rows = rows.select(
        "item_id",
        F.xxhash64("item_id", "text").alias("item"),
        _lower_words(F.col("text")).alias("item_words"),
        _templates(F.col("text")).alias("item_templates"),
    )
    n = F.size("item_words")
    # Under four words none may differ.
    window = F.when(n < 4, n).otherwise(F.least(F.lit(WINDOW), F.floor(n / 2))).cast("int")
    return rows.select("*", n.alias("n"), window.alias("size")).where("n > 0")


def _word_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``word`` (a hash) and its count in all documents, for words of the items; written.

    The same words as those of ``_lower_words``, which makes a text of them in between.
    """
    own = written(items.select(F.explode(F.transform("item_words", lambda w: F.xxhash64(w))).alias("word")).distinct(), "item-words")
    each = docs.select(F.explode(F.split(text_of(), BETWEEN)).alias("w")).select(F.xxhash64(F.lower("w")).alias("word"))
    met = each.join(checked_broadcast(own), "word", "left_semi")
    return written(met.groupBy("word").agg(F.count(F.lit(1)).alias("often")), "word-counts")


def _index(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows of the items: ``hash``, ``kind``, ``size``, ``item``, ``place``, and each one's rarest
    word ``anchor`` at ``offset``; written. Rows are numbers, so many of them may be broadcast."""
    words = items.select("item", F.posexplode(F.arrays_zip("item_words", "item_templates")).alias("at", "x"))
    words = words.select("item", "at", F.xxhash64("x.item_words").alias("word"), (~_placeholder(F.col("x.item_templates"))).alias("plain"))
    known = words.join(counts, "word", "left").select(
        "item", F.struct("at", F.coalesce("often", F.lit(0)).alias("often"), "word", "plain").alias("x")
    )
    listed = known.groupBy("item").agg(F.array_sort(F.collect_list("x")).alias("own"))
    rows = items.join(listed, "item")
    places = F.sequence(F.lit(0), F.col("n") - F.col("size"))

    def entry(place: Column, kind: int) -> Column:
        size = F.col("size")
        run = F.slice("own", place + 1, size)
        may = F.filter(run, lambda x: x["plain"]) if kind else run
        rarest = F.array_min(F.transform(may, lambda x: F.struct(x["often"], x["word"], x["at"])))
        form = F.slice("item_templates" if kind else "item_words", place + 1, size)
        return F.struct(
            F.lit(kind).alias("kind"),
            size.alias("size"),
            place.alias("place"),
            F.xxhash64(F.lit(kind), form).alias("hash"),
            F.size(may).alias("plain"),
            rarest["word"].alias("anchor"),
            (rarest["at"] - place).alias("offset"),
        )

    def entries(kind: int) -> Column:
        return F.transform(places, lambda place: entry(place, kind))

    each = F.concat(entries(0), entries(1))
    windows = rows.select("item", F.explode(each).alias("x")).select("item", "x.*")
    enough = (F.col("kind") == 0) | (F.col("plain") >= 2) | (F.col("plain") * 3 >= F.col("size"))
    return written(windows.where(enough & (F.col("plain") > 0)).drop("plain"), "index")


def _hits(docs: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``item`` and ``shift`` (of the item's start) where a window met; written."""
    use = F.struct("kind", "size", "offset")
    anchors = written(index.groupBy("anchor").agg(F.collect_set(use).alias("uses")), "anchors")
    places = _tokens(docs).select("*", F.posexplode("words").alias("at", "w"))
    places = places.withColumn("anchor", F.xxhash64("w")).drop("w")
    uses = places.join(checked_broadcast(anchors), "anchor").withColumn("use", F.explode("uses"))
    start, size = F.col("at") - F.col("use.offset"), F.col("use.size")
    inside = uses.where((start >= 0) & (start + size <= F.size("words")))
    form = F.when(F.col("use.kind") == 0, F.slice("words", start + 1, size)).otherwise(
        F.slice("templates", start + 1, size)
    )
    hashed = inside.select("doc_id", "text_key", start.alias("start"), F.xxhash64("use.kind", form).alias("hash"))
    met = hashed.join(checked_broadcast(index.select("hash", "item", "place")), "hash")
    shift = (F.col("start") - F.col("place")).alias("shift")
    return written(met.select("doc_id", "text_key", "item", shift).distinct(), "hits")


# --- Alignment ------------------------------------------------------------------------------------


def _masks(words: str) -> Column:
    """For each limb of the array a map from its words to the bits of the places where they stand."""

    def limb(i: Column) -> Column:
        own = F.slice(words, i * LIMB + 1, LIMB)
        places = F.sequence(F.lit(0), F.size(own) - 1)

        def bits(word: Column) -> Column:
            return F.aggregate(
                places,
                F.lit(0).cast("long"),
                lambda m, p: F.when(F.get(own, p) == word, m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p))).otherwise(m),
            )

        return F.map_from_entries(F.transform(F.array_distinct(own), lambda w: F.struct(w, bits(w))))

    limbs = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / LIMB).cast("int"))
    return F.transform(limbs, limb)


def _states(masks: str, near: str) -> Column:
    """States of the longest common subsequence after each word of ``near``, the first one before any.

    Bit-parallel (Crochemore and others, 2001): a state has a bit for each place of the item, which is
    clear where the sequence grows by that place. Limbs are added with a carry from one to the next.
    """
    start = F.transform(masks, lambda _: F.lit(FULL).cast("long"))

    def step(states: Column, word: Column) -> Column:
        before = F.element_at(states, -1)
        pairs = F.arrays_zip(before.alias("v"), F.transform(masks, lambda m: F.coalesce(F.try_element_at(m, word), F.lit(0).cast("long"))).alias("m"))
        kind = "struct<carry:bigint,out:array<bigint>>"
        empty = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out")).cast(kind)

        def add(state: Column, x: Column) -> Column:
            v, m = x["v"], x["m"]
            total = v + v.bitwiseAND(m) + state["carry"]
            after = total.bitwiseAND(F.lit(FULL)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))
            return F.struct(
                F.shiftright(total, LIMB).alias("carry"), F.concat(state["out"], F.array(after)).alias("out")
            ).cast(kind)

        return F.concat(states, F.array(F.aggregate(pairs, empty, add, lambda s: s["out"])))

    return F.aggregate(near, F.array(start), step)


def _length(states: Column) -> Column:
    """Length of the longest common subsequence: the clear bits of the last state."""
    clear = F.transform(F.element_at(states, -1), lambda v: LIMB - F.bit_count(v))
    return F.aggregate(clear, F.lit(0), lambda n, c: n + c)


def _pairs(states: str, one: str, many: str) -> Column:
    """Places ``i`` of ``one`` and ``j`` of ``many`` that the subsequence pairs, traced from the end."""
    kind = "struct<i:int,j:int,at:array<struct<i:int,j:int>>>"

    def state(i: Column, j: Column, at: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), at.alias("at")).cast(kind)

    def step(s: Column, _: Column) -> Column:
        i, j, at = s["i"], s["j"], s["at"]
        limb = F.get(F.get(F.col(states), j), F.floor(i / LIMB).cast("int"))
        same = F.get(F.col(one), i) == F.get(F.col(many), j - 1)
        both = F.concat(at, F.array(F.struct(i.alias("i"), (j - 1).alias("j"))))
        set_bit = F.call_function("shiftright", limb, i % LIMB).bitwiseAND(F.lit(1)) == 1
        return (
            F.when((i < 0) | (j < 1), s)
            .when(F.coalesce(same, F.lit(False)), state(i - 1, j - 1, both))
            .when(set_bit, state(i - 1, j, at))
            .otherwise(state(i, j - 1, at))
        )

    steps = F.sequence(F.lit(1), F.size(one) + F.size(many))
    start = state(F.size(one) - 1, F.size(many), F.array().cast("array<struct<i:int,j:int>>"))
    return F.aggregate(steps, start, step, lambda s: s["at"])


def _beside(docs: DataFrame, items: DataFrame, hits: DataFrame) -> DataFrame:
    """Each hit's item with the document's words and templates around the place; written."""
    keys = hits.select(F.col("doc_id").alias("_k1"), F.col("text_key").alias("_k2")).distinct()
    rows = docs.select(*row_key(), text_of().alias("text"))
    same_row = rows["doc_id"].eqNullSafe(F.col("_k1")) & (rows["text_key"] == F.col("_k2"))
    candidates = rows.join(checked_broadcast(written(keys, "candidates")), same_row, "left_semi")
    texts = candidates.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    texts = written(_tokens(texts).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key"), "candidate-words")
    # Items may be long, so none of them is sent to all tasks by a count of rows.
    placed = hits.join(items, "item")
    same = texts["_id"].eqNullSafe(placed["doc_id"]) & (texts["_key"] == placed["text_key"])
    both = placed.join(texts, same)
    slack = F.ceil(F.lit(SLACK) * F.col("n")).cast("int")
    first = F.greatest(F.col("shift") - slack, F.lit(0))
    last = F.least(F.col("shift") + F.col("n") + slack, F.size("words"))
    near = {f"near_{name}": F.slice(name, first + 1, F.greatest(last - first, F.lit(0))) for name in ("words", "templates")}
    return written(both.select(*placed.columns, *[c.alias(name) for name, c in near.items()]), "beside")


def find_items(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id``, ``text_key``, ``item_id``, ``same`` and ``alike`` (shares of words), ``consistent``.

    One row for each text of an id and each item found in it.
    """
    items = written(prepared_items(benchmark), "items")
    hits = _hits(docs, _index(items, _word_counts(docs, items)))
    masked = items.select(
        "item", "item_id", "item_words", "item_templates", "n",
        _masks("item_words").alias("word_masks"), _masks("item_templates").alias("template_masks"),
    )
    beside = _beside(docs, written(masked, "masked"), hits)
    laid = beside.withColumns({
        "same": _length(_states("word_masks", "near_words")) / F.col("n"),
        "states": _states("template_masks", "near_templates"),
    })
    laid = laid.withColumn("alike", _length(F.col("states")) / F.col("n"))
    laid = written(laid.where((F.col("same") >= share) | (F.col("alike") >= share)), "laid")
    slots = F.transform(
        F.filter(
            _pairs("states", "item_templates", "near_templates"),
            lambda x: _placeholder(F.get("item_templates", x["i"])),
        ),
        lambda x: F.struct(
            F.get("item_templates", x["i"]).alias("type"),
            F.get("item_words", x["i"]).alias("a"),
            F.get("near_words", x["j"]).alias("b"),
        ),
    )
    slots = laid.select("doc_id", "text_key", "item_id", "same", "alike", slots.alias("slots"))

    def different(of) -> Column:
        return F.size(F.array_distinct(F.transform("slots", of)))

    every = different(lambda x: F.struct(x["type"], x["a"], x["b"]))
    one_way, back = different(lambda x: F.struct(x["type"], x["a"])), different(lambda x: F.struct(x["type"], x["b"]))
    judged = slots.withColumn("consistent", (every == one_way) & (every == back)).drop("slots")
    found = judged.where((F.col("same") >= share) | (F.col("consistent") & (F.col("alike") >= share)))
    best = F.max(F.struct("same", "alike", "consistent")).alias("best")
    return found.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", "best.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which an item is found, all columns kept."""
    return without(docs, written(find_items(docs, benchmark).select("doc_id", "text_key").distinct(), "leaks"))
