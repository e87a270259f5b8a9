"""Line dedup: an exact set-similarity join of lines, with DataFrame functions only.

A line's set is that of its lower-cased words between spaces. Words are ordered
by rarity (hashed counts over all lines of the corpus, in quarters of a doubling),
and a line posts its prefix: the n - ceil(n p/q) + 1 rarest of its n words. Two
lines of Jaccard similarity p/q or more share a word of their prefixes. Pairs
that do are cut by length, by position in the prefix, and by a parity sketch of
the sets (64 bits, of long lines 128); what is left is verified on the words
themselves. The smaller of two similar lines need post still fewer words as such,
n - ceil(n 2p/(p+q)) + 1. A line goes if an earlier line (by doc_id, then by place)
is similar to it.

Lines with the same words are one class. Variants of one line could make a number
of pairs that is square in the size of their group, so classes of a crowd (many
that share two neighbouring words of their prefixes) are first compared with a few
leaders of it. A class that an earlier leader removes needs no other partner: it
stays in the join as an earlier line, and is left out as a later one.

Defined cases: null text stays null and has no lines; lines without a word
(blank ones too) always stay; lines of three words or fewer at p/q = 4/5 go only
if the same words came before; rows that repeat doc_id and text are one document
and are treated alike; a null doc_id sorts first; extra columns are kept; a line
may be of any length, and is compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketforge.llm.bit_table import maybe_in, surely_not_in
from basketforge.session import ALL_JOIN_KEYS, dropped, staged
from basketforge.sources.tables import table

#: Places of the hashed word counts: bounds the table of rarities that tasks hold.
COUNT_BUCKETS = 2**18
#: Words of a line from which on its size is kept as "large" in postings.
LARGE = 2**22 - 1
#: Last words of a line's prefix by whose neighbouring pairs it looks for a leader.
STAR_WORDS = 4
#: Classes from which on a pair of words is looked at for leaders, leaders drawn of each, and how many of them a class is compared with.
CROWD, DRAWN, TRIED = 6, 8, 12
#: Words of a line from which on its sketch has 128 bits.
LONG = 64
#: Bits of a word's hash; those above hold its rarity.
HASH_BITS = 56
ROW = ["doc_id", "row_key"]


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(COUNT_BUCKETS - 1)).cast("int")


def rarity_classes(docs: DataFrame) -> Column:
    """Array by hash place: how frequent its words are, in quarters of a doubling (0: absent).

    A literal of a fixed size: as a column of a broadcast row the array would be
    copied with every line, which took twenty times as long.
    """
    words = docs.select(F.explode(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("at")).agg(F.count("*").alias("n"))
    level = F.least(F.lit(120), F.floor(F.log2("n") * 4 + 1)).cast("int")
    #: Packed on the executors: 256 rows come to the driver, for any corpus.
    packed = counts.groupBy(F.shiftright("at", 10).alias("page")).agg(F.collect_list(F.struct(F.col("at").bitwiseAND(F.lit(1023)).alias("k"), level.alias("v"))).alias("cells"))
    levels = [0] * COUNT_BUCKETS
    for r in packed.collect():
        for k, v in r["cells"]:
            levels[r["page"] << 10 | k] = v
    return F.expr(f"cast(split('{','.join(map(str, levels))}', ',') as array<bigint>)")


def _split_lines(docs: DataFrame) -> DataFrame:
    """One row per line that has words: doc_id, row_key, line, said (the line, lower-cased)."""
    # The key is made before the lines are, once for each text.
    keyed = docs.where("text is not null").select("doc_id", _row_key().alias("row_key"), F.lower("text").alias("text"))
    return keyed.select(*ROW, F.posexplode(F.split("text", "\n")).alias("line", "said")).where(F.trim("said") != "")


def _lines(docs: DataFrame, p: int, q: int) -> DataFrame:
    """One row per line that has words: its place, hash of its set, size, sketch and prefix."""
    levels = rarity_classes(docs)
    # Every place has a rarity; said so (no null), arrays are sorted as plain numbers and not as objects.
    rank = lambda h: F.shiftleft(F.coalesce(F.get(levels, _bucket(h)), F.lit(0).cast("long")), HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit(2**HASH_BITS - 1)))
    ranked = F.sort_array(F.array_distinct(F.transform(F.transform(_words(F.col("said")), lambda w: F.xxhash64(w)), rank)))
    rows = _split_lines(docs).select(*ROW, "line", ranked.alias("ranked"))
    n = F.size("ranked")
    prefix = F.when(n * (q - p) < p, F.lit(0)).otherwise(n - F.ceil(n * F.lit(p) / F.lit(q)).cast("int") + 1)
    none = F.lit(0).cast("long")
    sketch = F.aggregate("ranked", none, lambda a, h: a.bitwiseXOR(_one_bit(F.lit(1).cast("long"), h)))
    # The words of the upper half of a sketch of 128 bits: the lower half is what the two differ in.
    upper = F.aggregate("ranked", none, lambda a, h: a.bitwiseXOR(_one_bit(F.shiftright(h, 6).bitwiseAND(F.lit(1).cast("long")), h)))
    return rows.select(
        *ROW,
        "line",
        F.xxhash64("ranked").alias("same"),
        n.alias("n"),
        sketch.alias("sketch"),
        F.when(n > LONG, upper).otherwise(none).alias("upper"),
        F.transform(F.slice("ranked", F.lit(1), prefix), _low_bits).alias("prefix"),
    )


def _low_bits(h: Column) -> Column:
    return h.bitwiseAND(F.lit(2**31 - 1)).cast("int")


def _one_bit(bit: Column, h: Column) -> Column:
    return F.call_function("shiftleft", bit, h.bitwiseAND(F.lit(63)).cast("int"))


class Posting:
    """Columns of a posting: the size, the place in the prefix, the order in the corpus and a mark are packed in one number."""

    COLUMNS = ("cid", "sketch", "upper", "m")

    @staticmethod
    def packed(n: Column, at: Column, order: Column, led: Column) -> Column:
        size, place = F.least(n, F.lit(LARGE)).cast("long"), F.least(at, F.lit(2**20 - 1)).cast("long")
        return F.shiftleft(size, 41).bitwiseOR(F.shiftleft(place, 21)).bitwiseOR(F.shiftleft(order, 1)).bitwiseOR(led.cast("long"))

    def __init__(self, name: str):
        part = lambda by, bits: F.shiftright(f"m_{name}", by).bitwiseAND(F.lit(2**bits - 1))
        self.n, self.at, self.order, self.led = part(41, 22), part(21, 20), part(1, 20), part(0, 1) == 1
        self.cid, self.sketch, self.upper = (F.col(f"{c}_{name}") for c in self.COLUMNS[:3])

    @classmethod
    def named(cls, posts: DataFrame, name: str) -> DataFrame:
        return posts.withColumnsRenamed({c: f"{c}_{name}" for c in cls.COLUMNS})


def _near(x: Posting, y: Posting, p: int, q: int, first_match: bool) -> Column:
    """Length, sketch and, at the first word that both prefixes have, positional filter of a pair of postings."""
    small, large = F.least(x.n, y.n), F.greatest(x.n, y.n)
    fits = small * q >= large * p
    if first_match:
        fits = fits & ((F.least(x.n - x.at, y.n - y.at) * (p + q) >= (small + large) * p) | (large == LARGE))
    whole, upper = x.sketch.bitwiseXOR(y.sketch), x.upper.bitwiseXOR(y.upper)
    most = (small + large) * (q - p)
    both_halves = (F.bit_count(whole.bitwiseXOR(upper)) + F.bit_count(upper)) * (p + q) <= most
    return fits & (((F.bit_count(whole) * (p + q) <= most) & ((small <= LONG) | both_halves)) | (large == LARGE))


def _without(lines: Column, removed: Column) -> Column:
    """The lines between the (sorted) removed numbers, in one pass: a slice before each of them, and one after the last."""
    ends = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(lines)))
    # A one-element array names both, so that neither is made again for each slice.
    named = F.array(F.struct(lines.alias("lines"), ends.alias("ends")))
    between = F.transform(named, lambda x: F.transform(F.sequence(F.lit(1), F.size(x["ends"]) - 1), lambda k: F.slice(x["lines"], F.get(x["ends"], k - 1) + 2, F.get(x["ends"], k) - F.get(x["ends"], k - 1) - 1)))
    return F.array_join(F.flatten(F.get(between, F.lit(0))), "\n")


class LineDedup:
    """Finds, and removes, lines similar to an earlier one (Jaccard of word sets p/q or more)."""

    def __init__(self, p: int = 4, q: int = 5):
        self.p, self.q = p, q

    def removed_lines(self, docs: DataFrame) -> DataFrame:
        """Documents that lose lines, staged: doc_id, row_key, removed (line numbers from 0, in order)."""
        docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        lines = staged(_lines(docs, self.p, self.q), "lines")
        first = F.min(F.struct(*ROW, "line")).alias("first")
        alike = [F.first(c).alias(c) for c in ("n", "sketch", "upper", "prefix")]
        classes = lines.groupBy("same").agg(first, F.count("*").alias("copies"), *alike)
        # Written with a short number for each class, which the joins carry in place of its hash.
        classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "line-classes")
        gone = self._removed(docs, classes)
        state = classes.select("cid", "same", "first", "copies").join(gone.withColumn("gone", F.lit(True)), "cid", "left").drop("cid").where("copies > 1 or gone")
        judged = lines.select(*ROW, "line", "same").join(state, "same")
        out = F.col("gone").isNotNull() | ~F.struct(*ROW, "line").eqNullSafe(F.col("first"))
        # Repeated rows count a line several times: sets of line numbers make them alike.
        removed = staged(judged.where(out).groupBy(*ROW).agg(F.sort_array(F.collect_set("line")).alias("removed")), "removed-lines")
        dropped(lines, classes, gone)
        return removed

    def _removed(self, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """Numbers of the classes similar to a class that begins earlier."""
        bounds = classes.agg(F.min("first.doc_id").cast("double").alias("lo"), F.max("first.doc_id").cast("double").alias("hi")).first()
        low, span = bounds["lo"] or 0.0, max((bounds["hi"] or 0.0) - (bounds["lo"] or 0.0), 1.0)
        # The place of doc_id between the corpus's bounds: of two steps the smaller is the earlier, within a step either may be.
        order = F.coalesce(F.floor((F.col("first.doc_id").cast("double") - low) / span * (2**20 - 1)).cast("long"), F.lit(0))
        long_enough = classes.where(F.size("prefix") > 0).select("cid", "copies", "sketch", "upper", "n", "prefix", order.alias("order"))
        stars = self._stars(long_enough)
        led = self._verified(docs, stars, classes)
        pairs = self._prefix_pairs(long_enough, led)
        more = self._verified(docs, pairs, classes)
        gone = staged(led.union(more).distinct(), "line-matches")
        dropped(stars, led, pairs, more)
        return gone

    def _postings(self, classes: DataFrame, *more: str) -> DataFrame:
        """One row per class and word of its prefix; ``classes`` have a mark, led."""
        posts = classes.select("cid", "sketch", "upper", "n", "order", "led", *more, F.posexplode("prefix").alias("at", "word"))
        return posts.select("word", "cid", "sketch", "upper", Posting.packed(F.col("n"), F.col("at"), F.col("order"), F.col("led")).alias("m"), *more)

    def _stars(self, classes: DataFrame) -> DataFrame:
        """At most ``TRIED`` pairs (a, b) for each class b of a crowd: leaders a that come before b and are near.

        Leaders of a pair of words: the earliest class that has it, the most repeated one, and some drawn by hash.
        """
        # More copies first, then earlier ones: one number to take the largest of.
        weight = F.shiftleft(F.floor(F.log2("copies")).cast("long"), 20).bitwiseOR(2**20 - 1 - F.col("order"))
        # The last words of a prefix are the least rare there: variants of a line have most of them in common, and other lines seldom two of them.
        last = F.slice("prefix", F.greatest(F.lit(1), F.size("prefix") - STAR_WORDS + 1), F.lit(STAR_WORDS))
        n_pairs = F.greatest(F.lit(1), F.least(F.size("prefix"), F.lit(STAR_WORDS)) - 1)
        few = classes.withColumn("last", last).withColumn("pairs", F.slice(F.array(*(F.xxhash64(F.slice("last", k, 2)) for k in range(1, STAR_WORDS))), F.lit(1), n_pairs))
        crowds = staged(few.select(F.explode("pairs").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD), "line-crowds")
        posts = self._postings(few.select("cid", "sketch", "upper", "n", "order", F.col("pairs").alias("prefix"), weight.alias("weight"), F.lit(False).alias("led")), "weight")
        posts = staged(maybe_in(posts, F.col("word"), crowds.select("word")).join(crowds.select("word"), "word"), "line-crowded")
        whole = [F.col(c) for c in Posting.COLUMNS]
        order = F.shiftright("m", 1).bitwiseAND(F.lit(2**20 - 1))
        picks = [F.min_by(F.struct(*whole), order), F.max_by(F.struct(*whole), F.col("weight")), *(F.max_by(F.struct(*whole), F.xxhash64("cid", F.lit(k))) for k in range(DRAWN))]
        leaders = posts.groupBy("word").agg(F.array(*picks).alias("leaders"))
        met = Posting.named(posts.drop("weight"), "b").join(leaders, "word").select("*", F.explode("leaders").alias("l"))
        met = met.select(*(f"{c}_b" for c in Posting.COLUMNS), *(F.col(f"l.{c}").alias(f"{c}_a") for c in Posting.COLUMNS))
        x, y = Posting("a"), Posting("b")
        apart = F.bit_count(x.sketch.bitwiseXOR(y.sketch)) + F.bit_count(x.upper.bitwiseXOR(y.upper))
        near = met.where((x.order < y.order) & _near(x, y, self.p, self.q, False)).select(x.cid.alias("a"), y.cid.alias("b"), apart.alias("apart")).distinct()
        nth = F.row_number().over(Window.partitionBy("b").orderBy("apart", "a"))
        stars = staged(near.withColumn("nth", nth).where(F.col("nth") <= TRIED).select("a", "b"), "line-stars")
        dropped(crowds, posts)
        return stars

    def _prefix_pairs(self, classes: DataFrame, removed: DataFrame) -> DataFrame:
        """Pairs (a, b) that share a prefix word and pass every filter, where the later class is not removed yet.

        One join by word and mark: a smaller class that stays so far meets all, one
        that is removed meets only those that stay, so no two removed ones are compared.
        Both sides are made of the same postings, dealt by word once.
        """
        p, q = self.p, self.q
        marked = classes.join(removed.withColumn("led", F.lit(True)), "cid", "left").withColumn("led", F.coalesce("led", F.lit(False)))
        posts = self._postings(marked).repartition("word")
        x, y = Posting("x"), Posting("y")
        # Of a smaller line the places that count are fewer (the place of a large line is capped, so all of its count).
        counts = (x.at < x.n - F.ceil(x.n * F.lit(2 * p) / F.lit(p + q)) + 1) | (x.n == LARGE)
        staying, gone = F.array(F.lit(False)), F.array(F.lit(True))
        met = staying if removed.isEmpty() else F.when(x.led, staying).otherwise(F.concat(staying, gone))
        # An outer explode: a filter would move below the dealing, and the postings would be dealt twice. A null mark meets none.
        smaller = Posting.named(posts, "x").select("*", F.explode_outer(F.when(counts, met)).alias("mark"))
        larger = Posting.named(posts, "y").withColumn("mark", y.led)
        fits = (x.n <= y.n) & (x.cid != y.cid) & _near(x, y, p, q, True)
        # The later of two may not be removed.
        open_yet = F.when(x.led, x.order <= y.order).otherwise((y.order <= x.order) | ~y.led)
        pairs = smaller.join(larger, ["word", "mark"]).where(fits & open_yet)
        return staged(pairs.select(F.least(x.cid, y.cid).alias("a"), F.greatest(x.cid, y.cid).alias("b")).distinct(), "line-pairs", {ALL_JOIN_KEYS: "false"})

    def _verified(self, docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Of pairs (a, b), the classes (cid) whose words are similar to an earlier one's."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        wanted = staged(ids.join(classes.select("cid", "first"), "cid").select("cid", "first", F.col("first.row_key").alias("key"), F.col("first.line").alias("at")), "line-places")
        # Texts and lines that are not wanted stay where they are, as far as the filters tell.
        place = F.xxhash64("key", "at")
        found = _split_lines(maybe_in(docs, _row_key(), wanted.select("key"))).select(F.col("row_key").alias("key"), F.col("line").alias("at"), "said")
        found = maybe_in(found, place, wanted.select(place)).join(wanted, ["key", "at"])
        words = F.array_distinct(F.transform(_words(F.col("said")), lambda x: F.xxhash64(x)))
        sets = staged(found.select("cid", "first", words.alias("h")), "line-sets")
        both = pairs
        for x in "ab":
            both = both.join(sets.toDF(x, f"first_{x}", f"h_{x}"), x)
        shared, total = F.size(F.array_intersect("h_a", "h_b")), F.size("h_a") + F.size("h_b")
        alike = both.where(shared * self.q >= (total - shared) * self.p)
        out = staged(alike.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("cid")).distinct(), "line-verified")
        dropped(wanted, sets)
        return out

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the removed lines taken out of ``text``; same columns, same rows."""
        removed = self.removed_lines(docs)
        found = removed.select(F.col("doc_id").alias("lost_id"), F.col("row_key").alias("lost_key"), "removed")
        # The row travels as one column, so that its names cannot clash.
        rows = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("key"))
        # Texts that surely lose no line stay where they are.
        keys = found.select("lost_key")
        there = maybe_in(rows, F.col("key"), keys).join(found, (F.col("key") == F.col("lost_key")) & F.col("doc.doc_id").eqNullSafe(F.col("lost_id")), "left")
        text = F.col("doc.text")
        text = F.when(F.col("removed").isNull(), text).otherwise(_without(F.split(text, "\n"), F.array_sort("removed")))
        changed = there.select(*(text.alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))
        return changed.union(surely_not_in(rows, F.col("key"), keys).select("doc.*"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, n_lines (with words), n_removed, removed_lines (numbers from 0, comma-joined)."""
    docs = table(spark, folder, "documents")
    found = LineDedup().removed_lines(docs)
    n_lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    rows = docs.select("doc_id", _row_key().alias("key"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"))
    there = rows.join(found.withColumnRenamed("doc_id", "id"), (F.col("key") == F.col("row_key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return there.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"))
