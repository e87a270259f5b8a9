"""Tokenizing whole texts with the ``tokenizers`` library, inside tasks.

Words repeat, so ids are kept per white-space chunk in a bounded cache, and a
batch of texts asks for each distinct chunk once. For chunks of ASCII and Latin-1
letters the pre-tokenizer's rule is applied here and the library's BPE model gives
the ids; any other chunk goes through the whole library pipeline. Both give what
``Tokenizer.encode`` of the whole text gives, since no token of this kind of
tokenizer crosses white space.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's two caches; a full cache is begun anew.
CACHE_CHUNKS = 300_000
LONG_CHUNK = 64
#: Characters of text that are encoded together; a longer text is encoded alone.
PART_CHARS = 4_000_000

#: The split rule of the word-BPE tokenizer, and its form for ASCII and Latin-1.
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_RULE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
LATIN_WORD = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
LATIN_CHUNK = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder(dict):
    """Maps a chunk without spaces to the bytes of its uint32 ids."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        rules = (str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer))
        #: Chunks are independent of one another only if white space always parts tokens.
        self.by_chunk = "Lowercase()" in rules[0] and SPLIT_RULE in rules[1] and "behavior=Removed, invert=True" in rules[1]
        if self.by_chunk:
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.levels = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            level = word if word.isascii() else word.translate(self.levels)
            got = array("I", [t.id for t in self.tokenizer.model.tokenize(level)]).tobytes()
            if len(word) <= LONG_CHUNK:
                if len(self.words) >= CACHE_CHUNKS:
                    self.words.clear()
                self.words[word] = got
        return got

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            got = b""
        elif LATIN_WORD(chunk):
            got = self._word(chunk)
        elif LATIN_CHUNK(chunk) and "<|" not in chunk:
            got = b"".join(map(self._word, LATIN_RULE.findall(chunk.lower())))
        else:
            got = self._whole(chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = got
        return got

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids of the whole text; null gives none."""
        if not text:
            return np.empty(0, np.uint32)
        if not self.by_chunk:
            return np.frombuffer(self._whole(text), np.uint32)
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), np.uint32)

    def column(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Ids of a column of whole texts, each with the end id after it, a part of the column at a time.

        Yields (first text, text after the last, ids of these texts together, end of each in them).
        """
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(texts):
            done = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, done + PART_CHARS, "right")))
            ids, ends = self._encoded(pc.fill_null(texts.slice(low, high - low), ""))
            yield low, high, np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, high - low + 1)
            low = high
        pa.default_memory_pool().release_unused()

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and the end of each text in them."""
        if not self.by_chunk:
            each = [self.ids(x) for x in texts.to_pylist()]
            return np.concatenate([*each, np.empty(0, np.uint32)]), np.cumsum([len(x) for x in each])
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.dictionary_encode(split.flatten())
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        # Chunks hold no blanks: joined and split again, they become Python strings at once.
        distinct = coded.dictionary
        one = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct)
        known = list(map(self.__getitem__, pc.binary_join(one, " ")[0].as_py().split(" "))) if len(distinct) else []
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begins = np.cumsum(lengths) - lengths
        chunk = coded.indices.to_numpy()
        n = lengths[chunk]
        after = np.cumsum(n)
        # Where each id lies among the ids of the distinct chunks.
        total = int(after[-1]) if len(after) else 0
        narrow = np.int32 if total < 2**31 else np.int64
        place = np.repeat((begins[chunk] - (after - n)).astype(narrow), n)
        place += np.arange(total, dtype=narrow)
        offsets = split.offsets.to_numpy()
        return np.frombuffer(b"".join(known), np.uint32)[place], np.concatenate([[0], after])[offsets[1:] - offsets[0]]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
