"""Token-id store: Re-Pair grammar compression, written by Spark and read back.

File format: a folder of Parquet files, one row per block of whole documents in
ascending doc_id order: part, block, first token of the block in its part, number
of tokens, and a binary payload (``encode_block``). The payload holds the rules of
a Re-Pair grammar over the block, the expansion length of each rule, and for each
document its place among the symbols and among the tokens, so that one document,
or a range of its tokens, is decoded alone (``decode_document``).

Re-Pair here works in rounds: each round counts the pairs of neighbouring symbols
and replaces all that occur ``LEAST_COUNT`` times or more, the most frequent first,
left to right without overlap, by new symbols. A hashed count passes over the
places whose pair cannot be frequent, so late rounds cost little. It ends when no
pair is frequent or the symbols are used up. Pairs never cross a document's end.

Defined cases: null text is an empty document (the end id alone); empty tables
give an empty store; equal doc_ids are neighbours, ordered by a hash of their
text; a null doc_id comes first; extra columns are ignored.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketforge.llm import tokens
from basketforge.session import shared_folder
from basketforge.sources.tables import table

END_ID = 2
#: Tokens gathered before a block is closed; a document is never divided.
BLOCK_TOKENS = 400_000
#: A rule takes the bytes of about six symbols, so a pair must save more than that.
LEAST_COUNT = 12
SLOT_BITS = 18
#: Symbols of two bytes where the ids leave room for rules among them, else of four.
NARROW, NARROW_IDS, WIDE_RULES = 2**16, 60_000, 2**20
#: Fixed values of the file format.
MAGIC, VERSION, NULL_ID = b"BFRP", 1, -(2**63)
SCHEMA = "part int, block int, first long, n_tokens long, n_docs long, payload binary"


def _slot(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def replace_pairs(symbols: np.ndarray, ends: np.ndarray, next_symbol: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: new symbols, new document ends, and the pairs replaced (n, 2)."""
    none = symbols, ends, np.empty((0, 2), np.uint32)
    if len(symbols) < 2 or limit < 1:
        return none
    # Symbols below 2^16 make 32-bit keys, which sort several times faster.
    kind, half = (np.uint32, 16) if next_symbol + limit <= NARROW else (np.uint64, 32)
    keys = (symbols[:-1].astype(kind) << kind(half)) | symbols[1:].astype(kind)
    inside = np.ones(len(keys), bool)
    inside[ends[:-1] - 1] = False
    # No pair takes in an end symbol, so a document's symbols stay apart from its neighbours'.
    inside[(ends - 2)[ends >= 2]] = False
    slot = _slot(keys)
    at = np.flatnonzero((np.bincount(slot[inside], minlength=2**SLOT_BITS) >= LEAST_COUNT)[slot] & inside)
    keys, slot = keys[at], slot[at]
    ordered = np.sort(keys)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    counts = np.diff(np.r_[starts, len(ordered)])
    often = np.flatnonzero(counts >= LEAST_COUNT)
    if not len(often):
        return none
    chosen = ordered[starts[often[np.argsort(-counts[often], kind="stable")[:limit]]]]
    # A hash table of the pairs; where two meet in a slot, the more frequent one goes first and the other has its turn in a later round.
    slots = np.full(2**SLOT_BITS, len(chosen), np.int32)
    slots[_slot(chosen)[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]
    rule = slots[slot]
    there = (np.append(chosen, kind(0))[rule] == keys) & (rule < len(chosen))
    at, rule = at[there], rule[there]
    # Left to right without overlap: in a run of neighbouring places take every second.
    head = np.r_[True, np.diff(at) != 1] if len(at) else np.empty(0, bool)
    run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
    take = (np.arange(len(at)) - run) % 2 == 0
    at, rule = at[take], rule[take]
    used = np.flatnonzero(np.bincount(rule, minlength=len(chosen)))
    number = np.zeros(len(chosen), np.int64)
    number[used] = np.arange(len(used))
    chosen = chosen[used]
    out = symbols.copy()
    out[at] = next_symbol + number[rule]
    pairs = np.stack([chosen >> kind(half), chosen & kind(2**half - 1)], 1).astype(np.uint32)
    return np.delete(out, at + 1), ends - np.searchsorted(at + 1, ends), pairs


def encode_block(doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> bytes:
    """``ids`` of whole documents, ``ends`` their ends in it (each with its end id)."""
    symbols, at, base = ids.astype(np.uint32), ends.astype(np.int64), int(ids.max(initial=0)) + 1
    rules, rounds, made = [], [], 0
    limit = NARROW - base if base < NARROW_IDS else WIDE_RULES
    while True:
        symbols, at, pairs = replace_pairs(symbols, at, base + made, limit - made)
        if not len(pairs):
            break
        rules.append(pairs)
        rounds.append(made)
        made += len(pairs)
    grammar = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    lengths = np.ones(base + len(grammar), np.uint32)
    for k, pairs in zip(rounds, rules):
        lengths[base + k : base + k + len(pairs)] = lengths[pairs[:, 0]] + lengths[pairs[:, 1]]
    width = 2 if base + len(grammar) <= 65_536 else 4
    head = struct.pack("<4sHHIIIII", MAGIC, VERSION, width, len(doc_ids), base, len(grammar), len(rounds), len(symbols))
    names = np.array([NULL_ID if x is None else x for x in doc_ids], "<i8")
    parts = [names, at.astype("<u4"), ends.astype("<u4"), np.array(rounds, "<u4"), grammar.astype("<u4"), lengths[base:].astype("<u4"), symbols.astype(f"<u{width}")]
    return head + b"".join(x.tobytes() for x in parts)


def _spread(lengths: np.ndarray, begins: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of each of the symbols lie, one symbol after the other, and where each symbol's end there."""
    n = lengths[symbols]
    after = np.cumsum(n)
    return np.repeat(begins[symbols] - (after - n), n) + np.arange(after[-1] if len(after) else 0), after


class Block:
    """Reader of one payload."""

    def __init__(self, payload: bytes):
        size = struct.calcsize("<4sHHIIIII")
        magic, version, width, docs, self.base, rules, rounds, symbols = struct.unpack_from("<4sHHIIIII", payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of this format")
        at = size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.symbol_ends, self.ends = take("<i8", docs), take("<u4", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        self.rounds, self.rules, self.lengths = take("<u4", rounds), take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.symbols = take(f"<u{width}", symbols)

    @cached_property
    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length of each symbol, where its tokens begin, tokens): rounds of rules are expanded one after the other."""
        lengths = np.concatenate([np.ones(self.base, np.int64), self.lengths.astype(np.int64)])
        begins = np.cumsum(lengths) - lengths
        tokens = np.arange(int(lengths.sum()), dtype=np.uint32)
        for low, high in zip(self.rounds, [*self.rounds[1:], len(self.rules)]):
            made, _ = _spread(lengths, begins, self.rules[low:high].ravel())
            at = begins[self.base + int(low)]
            tokens[at : at + len(made)] = tokens[made]
        return lengths, begins, tokens

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The tokens that symbols stand for."""
        lengths, begins, tokens = self.expansions
        return tokens[_spread(lengths, begins, symbols)[0]]

    def spans(self, symbols: np.ndarray) -> np.ndarray:
        return self.expansions[0][symbols]

    def decode_document(self, nth: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens start..stop of one document; only the symbols that cover them are expanded."""
        own = self.symbols[self.symbol_ends[nth - 1] if nth else 0 : self.symbol_ends[nth]]
        after = np.cumsum(self.spans(own))
        stop = int(after[-1]) if stop is None else min(stop, int(after[-1]))
        if start >= stop:
            return np.empty(0, np.uint32)
        low, high = np.searchsorted(after, start, "right"), np.searchsorted(after, stop, "left")
        skipped = int(after[low - 1]) if low else 0
        return self.expand(own[low : high + 1])[start - skipped : stop - skipped]

    def decode_all(self) -> np.ndarray:
        return self.expand(self.symbols)


def _write(path: str, end_id: int):
    def run(batches):
        enc, part = tokens.encoder(path), TaskContext.get().partitionId()
        names, pieces, held, block, first = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(pieces)
            ends = np.cumsum([len(x) for x in pieces])
            row = [part], [block], [first], [len(ids)], [len(names)], [encode_block(names, ids, ends)]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["part", "block", "first", "n_tokens", "n_docs", "payload"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, high, ids, ends in enc.column(batch.column(1), end_id):
                begin = 0
                for doc_id, end in zip(doc_ids[low:high], ends.tolist()):
                    names.append(doc_id)
                    pieces.append(ids[begin:end])
                    held += end - begin
                    begin = end
                    if held >= BLOCK_TOKENS:
                        yield closed()
                        names, pieces, held, block, first = [], [], 0, block + 1, first + held
        if names:
            yield closed()

    return run


def write_store(docs: DataFrame, path: str, end_id: int = END_ID, tokenizer: str | None = None) -> None:
    """Write ``docs`` (doc_id, text) to the store at ``path`` in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_write(tokenizer or tokens.default_tokenizer(), end_id), SCHEMA).write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """One row per document of the store: doc_id, start, n_tokens, ids_crc32[, ids]."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    # One row per part: how many tokens lie before it.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for part, first, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                block = Block(payload)
                ids, starts = block.decode_all(), np.r_[0, block.ends[:-1]].astype(np.int64)
                own = [ids[a:b] for a, b in zip(starts, block.ends)]
                columns = [
                    pa.array([part] * len(own), pa.int32()),
                    pa.array([None if x == NULL_ID else int(x) for x in block.doc_ids], pa.int64()),
                    pa.array(first + starts, pa.int64()),
                    pa.array(block.ends - starts, pa.int64()),
                    pa.array([tokens.crc(x) for x in own], pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[starts, len(ids)], pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "within", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)

    schema = "part int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    rows = blocks.select("part", "first", "payload").mapInArrow(run, schema).join(parts, "part")
    return rows.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def op4_token_store(spark: SparkSession, folder: str) -> DataFrame:
    import uuid

    path = f"{shared_folder(spark)}/basketforge/tokens-{uuid.uuid4().hex}"
    write_store(table(spark, folder, "documents"), path)
    return read_store(spark, path, keep_ids=False)
