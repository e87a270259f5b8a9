"""N-gram Jaccard join by parity sketches, and the groups of linked documents.

A document's set is that of its distinct word shingles, as 64-bit hashes. XOR-ing
the bits that shingles hash to gives a parity sketch: two sketches differ in at
most as many bits as the sets have elements that only one of them holds. Two
documents of similarity p/q differ in at most s (q-p)/(q+p) elements, s being the
sum of their sizes. So sizes fall into bands, each band deals the elements into
more pieces than the largest difference there, and at least one piece of a
linked pair is equal (pigeonhole): pieces are joined on the XOR of their hashes.
Empty pieces are equal in all texts and would join any two of them. So a band has
spare pieces, so that all but very few sets fill more of them than a linked pair
can differ in, and one of those is equal; only those few post empty pieces too.

Exact copies are one class from the start. In each group of equal pieces only a
few leaders are compared with the other members; components over the links found
then leave a rest of groups that hold more than one component, and only pairs
across components are compared there, so no link between classes that are still
apart is lost and no group is expanded into all its pairs. Every pair is filtered
by size and sketch, then verified on the whole texts.

Defined cases: null and empty texts, and texts without words, have an empty set
and are linked with nothing; a text of fewer words than a shingle has is one
shingle of all its words; a null doc_id is linked with nothing and its component
is null; repeated rows are linked copies; extra columns are ignored. Sets are told
apart by their hashes, not by doc_id: where a doc_id repeats with different texts,
each row has the links of its own text, and its component is named by the smallest
doc_id there.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketforge.llm.batches import slices
from basketforge.llm.bit_table import maybe_in, surely_not_in
from basketforge.llm.components import connected_components
from basketforge.session import dropped, staged
from basketforge.sources.tables import table

#: Bits of a sketch at least; larger sets have two bits an element and more, so that theirs do not fill.
SKETCH_BITS = 1024
LEADER_ORDERS = 3
STAR_ROUNDS = 3
#: Members that share one copy of their leader's text.
CHUNK = 256
#: The chance that a set leaves so many pieces empty that it posts them too, and the deviations that it comes to.
EMPTY_ODDS, EMPTY_DEVIATIONS = 1e-6, 5.0
#: Bits for each shared key in the table that tasks hold, and its least and most bits (32 MB): it only saves rows of a join.
KEY_BITS, LEAST_KEY_BITS, MOST_KEY_BITS = 8, 2**16, 2**28
#: Sets of which a task remembers that it has seen them.
SEEN = 2**17
#: Columns that tell shingle sets apart.
WHOLE = ["n", "h1", "h2"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(ids))
    n = len(ids) - width + 1
    made = ids[:n] + np.uint64(width)
    for k in range(1, width):
        made = _mix(made) + ids[k : n + k]
    return np.unique(_mix(made))


class Bands:
    """Size bands and, for each, the number of pieces, for similarity p/q."""

    def __init__(self, p: int, q: int):
        self.p, self.q, self.starts = p, q, [1]
        self._pieces: dict[int, int] = {}

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            last = self.starts[-1]
            self.starts.append(max(last + 1, -(-last * self.q**2 // self.p**2)))
        low, high = 0, len(self.starts) - 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.starts[mid] <= n else (low, mid)
        return low

    def differ(self, band: int) -> int:
        """The most elements in which a linked pair differs whose larger set is in the band."""
        self.of(self.starts[band])
        while len(self.starts) < band + 2:
            self.of(self.starts[-1])
        return 2 * (self.starts[band + 1] - 1) * (self.q - self.p) // (self.q + self.p)

    def pieces(self, band: int) -> int:
        """Pieces of a band: enough for its least set to leave fewer of them empty than would match by themselves.

        Of P pieces, n elements leave P e^-x empty on average, x = n / P. Few are as good as
        independent (Chernoff's bound); many are normal, with variance P e^-x (1 - (1 + x) e^-x).
        """
        if band not in self._pieces:
            d = self.differ(band)
            # Sets of the band before post here too, if they may link with one of this band.
            n, made = -(-self.starts[band] * self.p // self.q), d + 1

            def surely_filled(made: int) -> bool:
                x, most = n / made, made - d
                empty = made * math.exp(-x)
                if empty < 3:
                    return most > empty and most * math.log(most / empty) - most + empty >= -math.log(EMPTY_ODDS)
                return empty + EMPTY_DEVIATIONS * math.sqrt(empty * (1 - (1 + x) * math.exp(-x))) < most - 0.5

            while not surely_filled(made) and made < 64 * n:
                made += 1 + made // 64
            self._pieces[band] = made
        return self._pieces[band]

    def tables(self, n: int) -> list[int]:
        """Bands in which a set of n elements is dealt into pieces: its own, and the next if it may link there."""
        own = self.of(n)
        self.differ(own)
        following = n * self.q >= self.starts[own + 1] * self.p
        return [b for b in (own, own + 1)[: 1 + following] if self.differ(b) > 0]


def piece_keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys: (band, piece, XOR of the piece's hashes), hashed together."""
    out = []
    for band in bands.tables(len(hashes)) if len(hashes) else ():
        pieces, differ = bands.pieces(band), bands.differ(band)
        piece = (hashes >> np.uint64(11)) % np.uint64(pieces)
        piece = piece.astype(np.uint16 if pieces < 65_536 else np.int64)
        order = np.argsort(piece, kind="stable")
        sorted_piece = piece[order]
        starts = np.flatnonzero(np.r_[True, sorted_piece[1:] != sorted_piece[:-1]])
        value = np.bitwise_xor.reduceat(hashes[order], starts)
        which = sorted_piece[starts].astype(np.uint64)
        if len(which) <= differ:
            empty = np.setdiff1d(np.arange(pieces, dtype=np.uint64), which)
            which, value = np.append(which, empty), np.append(value, np.zeros(len(empty), np.uint64))
        out.append(_mix(_mix(which * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)) ^ value))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity sketch as 64-bit words: a power of two of them, so that a longer one folds to half its length."""
    size = max(SKETCH_BITS, 1 << (2 * len(hashes) - 1).bit_length())
    bits = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sign(words: int, p: int, q: int):
    def run(batches):
        bands, seen = Bands(p, q), set()
        for batch in slices(batches):
            sizes, one, two, keys, sketches = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                h = shingle_hashes(text, words)
                sizes.append(len(h))
                one.append(np.bitwise_xor.reduce(h) if len(h) else np.uint64(0))
                two.append(np.add.reduce(_mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(h) else np.uint64(0))
                # A task posts the pieces of one set once, however many copies it meets; rows without doc_id post none.
                whole = int(_mix(one[-1:]) ^ two[-1])
                again = doc_id is None or whole in seen
                if len(seen) >= SEEN:
                    seen.clear()
                if doc_id is not None:
                    seen.add(whole)
                keys.append(np.empty(0, np.int64) if again else piece_keys(h, bands).view(np.int64))
                sketches.append(sketch(h))
            ends = np.cumsum([0] + [len(k) for k in keys])
            sketch_ends = np.cumsum([0] + [len(k) for k in sketches])
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(sizes, pa.int64()),
                pa.array(np.array(one, np.uint64).view(np.int64)),
                pa.array(np.array(two, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))),
                pa.ListArray.from_arrays(pa.array(sketch_ends, pa.int32()), pa.array(np.concatenate(sketches) if keys else np.empty(0, np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "n", "h1", "h2", "keys", "sketch"])

    return run


def _verify(words: int, p: int, q: int):
    """Rows (leader, salt, kind, class, text) in order, a leader's text (kind 0) before its members' -> linked pairs."""

    def run(batches):
        now, held = None, np.empty(0, np.uint64)
        for batch in slices(batches):
            a, b = [], []
            for leader, kind, own, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                mine = shingle_hashes(text, words)
                if kind == 0:
                    now, held = leader, mine
                elif leader == now:
                    both = len(np.intersect1d(held, mine, assume_unique=True))
                    if both and q * both >= p * (len(held) + len(mine) - both):
                        a.append(min(leader, own))
                        b.append(max(leader, own))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _near(a: str, b: str, p: int, q: int) -> Column:
    """Size and sketch filters of a pair: neither rejects a linked pair.

    Sizes that pass differ by less than a factor of two, so their sketches do by one folding at most.
    """
    small, large = F.least(f"n_{a}", f"n_{b}"), F.greatest(f"n_{a}", f"n_{b}")

    def folded(own: str, other: str) -> Column:
        half = F.floor(F.size(own) / 2).cast("int")
        halves = F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) > F.size(other), halves).otherwise(F.col(own))

    one, two = folded(f"s_{a}", f"s_{b}"), folded(f"s_{b}", f"s_{a}")
    apart = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return (small * q >= large * p) & (apart * (p + q) <= (small + large) * (q - p))


def _text_hash(c: str) -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.col(c).cast("string"))


class JaccardJoin:
    """Groups of documents whose shingle sets have Jaccard similarity p/q or more."""

    def __init__(self, words: int = 5, p: int = 4, q: int = 5):
        self.words, self.p, self.q = words, p, q

    def signatures(self, docs: DataFrame) -> DataFrame:
        rows = docs.select(F.col("doc_id").cast("long"), _text_hash("text"), F.col("text").cast("string"))
        schema = "doc_id long, t long, n long, h1 long, h2 long, keys array<long>, sketch array<long>"
        return staged(rows.mapInArrow(_sign(self.words, self.p, self.q), schema), "signatures")

    def _linked(self, pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """Of distinct pairs (leader, member) of class ids, those that are linked, as (a, b) with a < b.

        A leader's text goes once to every ``CHUNK`` of its members, not to each of them.
        """
        ends = ("leader", "member")
        for side in ends:
            pairs = pairs.join(classes.select("cls", "n", "sketch", "id", "t").toDF(side, *(f"{c}_{side}" for c in ("n", "s", "id", "t"))), side)
        pairs = staged(pairs.where(_near(*ends, self.p, self.q)).select(*ends, *(f"{c}_{side}" for side in ends for c in ("id", "t"))), "near-pairs")
        chunks = pairs.groupBy("leader").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        salted = pairs.join(chunks, "leader").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("chunks")))
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), _text_hash("text").alias("t"), F.col("text").cast("string").alias("text")).where("text is not null")
        rows = None
        for kind, side in enumerate(ends):
            # Texts of documents in no pair stay where they are, as far as the filter tells.
            wanted = maybe_in(texts, F.xxhash64("id"), pairs.select(F.xxhash64(f"id_{side}").alias("code")))
            own = salted.select("leader", "salt", F.col(side).alias("cls"), F.col(f"id_{side}").alias("id"), F.col(f"t_{side}").alias("t")).distinct()
            own = own.join(wanted, ["id", "t"]).select("leader", "salt", F.lit(kind).alias("kind"), "cls", "text")
            rows = own if rows is None else rows.union(own)
        ordered = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "kind")
        links = staged(ordered.mapInArrow(_verify(self.words, self.p, self.q), "a long, b long"), "links")
        dropped(pairs)
        return links

    def _classes(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Signatures, classes of equal sets (cls, set, sketch, smallest doc_id and its text's hash), and their components (node, component)."""
        signed = self.signatures(docs)
        sets = signed.where("n > 0 and doc_id is not null")
        classes = sets.groupBy(*WHOLE).agg(F.min(F.struct("doc_id", "t")).alias("least"), F.first("sketch").alias("sketch"))
        # The numbers are written once and then only read, so they stay the same.
        classes = staged(classes.select(F.monotonically_increasing_id().alias("cls"), *WHOLE, "sketch", F.col("least.doc_id").alias("id"), F.col("least.t").alias("t")), "classes")
        postings = sets.select(F.explode("keys").alias("key"), "h1")
        shared = staged(postings.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("key"), "shared-keys")
        held = self._key_table(shared)
        members = self._members(sets, held).join(shared, "key").distinct()
        rest = staged(members.join(classes.select("h1", "cls"), "h1").select("key", "cls"), "members")
        held.unpersist()
        rows = staged(signed.select("doc_id", "t", *WHOLE), "sets")
        dropped(signed, shared)
        rest, before = staged(rest.join(rest.groupBy("key").agg(F.count("*").alias("held")), "key"), "postings"), rest
        dropped(before)
        links, tried, joined = [], [], None
        for turn in range(STAR_ROUNDS + 1):
            if rest.isEmpty():
                break
            pairs = self._stars(rest, turn) if turn < STAR_ROUNDS else self._across(rest, classes)
            if tried:
                known = reduce(DataFrame.union, tried)
                pairs = pairs.join(known.union(known.select("member", "leader")), ["leader", "member"], "left_anti")
            tried.append(staged(pairs, "pairs"))
            links.append(self._linked(tried[-1], docs, classes))
            dropped(joined)
            joined = connected_components(reduce(DataFrame.union, links))
            if turn < STAR_ROUNDS:
                before, rest = rest, staged(self._apart(rest, joined), "postings")
                dropped(before)
        dropped(rest, *tried, *links)
        return rows, classes, joined

    def groups(self, docs: DataFrame) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id (its group's smallest doc_id)."""
        rows, classes, joined = self._classes(docs)
        rows = rows.select("doc_id", *WHOLE).join(classes.select("cls", "id", *WHOLE), WHOLE, "left")
        name = F.coalesce("id", "doc_id")
        if joined is not None:
            # Only classes in links have another name than their own.
            ends = joined.union(joined.select("component", "component").distinct())
            least = ends.join(classes.select(F.col("cls").alias("node"), "id"), "node").groupBy("component").agg(F.min("id").alias("first"))
            rows = rows.join(ends.join(least, "component").select("node", "first"), F.col("cls") == F.col("node"), "left")
            name = F.coalesce("first", "id", "doc_id")
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), name).alias("component_id"))

    def parts(self, docs: DataFrame) -> DataFrame:
        """One row per document, staged: doc_id, t (hash of its text), part (number of its group; null for an empty set)."""
        rows, classes, joined = self._classes(docs)
        own = rows.select("doc_id", "t", *WHOLE).join(classes.select("cls", *WHOLE), WHOLE, "left")
        part = F.col("cls")
        if joined is not None:
            own, part = own.join(joined, own["cls"] == joined["node"], "left"), F.coalesce("component", "cls")
        out = staged(own.select("doc_id", "t", part.alias("part")), "parts")
        dropped(rows, classes, joined)
        return out

    def _key_table(self, shared: DataFrame) -> Broadcast:
        """The table of shared keys, sized by their count: 64-bit words, a power of two of them."""
        bits = min(max(1 << (KEY_BITS * shared.count()).bit_length(), LEAST_KEY_BITS), MOST_KEY_BITS)
        word = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(bits // 64 - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(F.lit(63)).cast("int"))
        #: At most MOST_KEY_BITS / 64 rows, whatever the number of keys.
        found = shared.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy()
        return shared.sparkSession.sparkContext.broadcast(words)

    def _members(self, sets: DataFrame, held: Broadcast) -> DataFrame:
        """(key, h1) of the sets, for keys that may be shared: the table passes over most others before the join."""

        def run(batches):
            table = held.value.view(np.uint64)
            for batch in batches:
                keys, h1 = batch.column(0), batch.column(1)
                flat = keys.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(h1.to_numpy(), np.diff(keys.offsets.to_numpy()))
                own = flat.view(np.uint64)
                maybe = (table[(own >> np.uint64(6)) & np.uint64(len(table) - 1)] >> (own & np.uint64(63))) & np.uint64(1) == 1
                yield pa.RecordBatch.from_arrays([pa.array(flat[maybe]), pa.array(owner[maybe])], names=["key", "h1"])

        return sets.where(F.size("keys") > 0).select("keys", "h1").mapInArrow(run, "key long, h1 long")

    def _stars(self, rest: DataFrame, turn: int) -> DataFrame:
        """Each document with one leader: the most central of its groups' members that is not yet with it.

        Later turns add one leader in a hashed order, so that the leaders change.
        """
        weight = rest.groupBy("cls").agg(F.sum("held").alias("weight"))
        known = rest.join(weight, "cls")
        if turn == 0:
            known = known.withColumn("part", F.col("cls"))
        salt = F.pmod("key", F.lit(LEADER_ORDERS))
        central = F.max(F.struct("weight", (-F.col("cls")).alias("order"), "part")).alias("central")
        drawn = F.max(F.struct(F.xxhash64(salt, F.lit(turn), "cls").alias("weight"), (-F.col("cls")).alias("order"), "part")).alias("drawn")
        leaders = known.groupBy("key").agg(central, drawn)
        kinds = ("central",) if turn == 0 else ("central", "drawn")
        named = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}.weight").alias("weight"), F.col(f"{k}.order").alias("order"), F.col(f"{k}.part").alias("lead_part")) for k in kinds))
        leaders = leaders.select("key", F.explode(named).alias("l")).select("key", "l.*")
        pairs = known.select("key", F.col("cls").alias("member"), "part").join(leaders, "key").where("part <> lead_part")
        best = pairs.groupBy("member", "kind").agg(F.max(F.struct("weight", "order")).alias("l"))
        return best.select((-F.col("l.order")).alias("leader"), "member").distinct()

    def _apart(self, rest: DataFrame, joined: DataFrame) -> DataFrame:
        """Postings of groups that still hold more than one component, with the component."""
        now = rest.select("key", "cls", "held").join(joined, rest["cls"] == joined["node"], "left")
        now = now.select("key", "cls", "held", F.coalesce("component", "cls").alias("part"))
        mixed = now.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
        return now.join(mixed, "key", "left_semi")

    def _across(self, rest: DataFrame, classes: DataFrame) -> DataFrame:
        """All pairs of a group whose members are in different components and near by size and sketch."""
        rows = rest.join(classes.select("cls", "n", "sketch"), "cls").select("key", "cls", "part", "n", "sketch")
        a, b = rows.toDF("key", "a", "part_a", "n_a", "s_a"), rows.toDF("key", "b", "part_b", "n_b", "s_b")
        near = (F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & _near("a", "b", self.p, self.q)
        return a.join(b, "key").where(near).select(F.col("a").alias("leader"), F.col("b").alias("member")).distinct()


def keep_one_of_each(docs: DataFrame, words: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """``docs`` without all but the first document of each group; rows without doc_id stay.

    A row is dropped only for one of its own group, or for one of the same doc_id
    and text: where a doc_id repeats with unlike texts, each of them stays.
    """
    parts = JaccardJoin(words, p, q).parts(docs)
    ids = staged(parts.where("doc_id is not null").groupBy("doc_id", "t").agg(F.min("part").alias("part"), F.count("*").alias("rows")), "groups")
    dropped(parts)
    firsts = ids.where("part is not null").groupBy("part").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    # Of a document in a group: whether it goes. Documents that are alone and not repeated are in no row here.
    state = ids.join(firsts, "part", "left").select(F.col("doc_id").alias("state_id"), F.col("t").alias("state_t"), "rows", (F.struct("doc_id", "t") != F.col("first")).alias("goes"))
    state = staged(state.select("state_id", "state_t", "rows", F.coalesce("goes", F.lit(False)).alias("goes")).where("goes or rows > 1"), "group-states")
    dropped(ids)
    # The row travels as one column, so that its names cannot clash.
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), _text_hash("text").alias("t"))
    code, state_code = F.when(F.col("id").isNotNull(), F.xxhash64("id", "t")), F.xxhash64("state_id", "state_t").alias("code")
    same = (F.col("id") == F.col("state_id")) & (F.col("t") == F.col("state_t"))
    # Rows that surely have no state stay where they are.
    codes = state.select(state_code)
    untouched = surely_not_in(rows, code, codes).union(maybe_in(rows, code, codes).join(state, same, "left_anti"))
    repeated = state.where(~F.col("goes"))
    maybe = maybe_in(rows, code, repeated.select(state_code))
    return untouched.select("doc.*").union(maybe.join(repeated, same).dropDuplicates(["id", "t"]).select("doc.*"))


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return JaccardJoin(words=3, p=9, q=10).groups(table(spark, folder, "documents"))
