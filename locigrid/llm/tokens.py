"""Token ids of whole texts, many texts at a time."""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import pre_tokenizers

# Words, and parts of words, a worker remembers the ids of: at most about 250 bytes each, so some 16 MB for each kind.
MEMORY_WORDS = 60_000
LONGEST_WORD = 48
# Text worked on at a time.
CHUNK = 6 << 20

_BYTES = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# A run of letters, then marks that start no contraction.
_LETTERS_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")

# The same for letters that are lower case and composed as they stand.
_PLAIN = r"^(?P<core>[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def splits_at_blanks(tokenizer) -> bool:
    """Whether the ids of a text are those of its words in a row: blanks only part words and have no ids."""
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    probe = ["Ab", "c's", "1 2", "\n-x\t", "É", "'s", "á", "\u0301b", "<|endoftext|>", "x<", "\x1c", " z"]
    return all(ids(f"{a}{gap}{b}") == ids(a) + ids(b) for a in probe for b in probe for gap in (" ", "\n", "\t \r\n"))


def splits_at_marks(tokenizer) -> bool:
    """Whether a word of letters and marks has the ids of its letters in lower case, by the bare model, and of its marks."""
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    cores = ["a", "Word", "ÉTÉ", "straße", "Ñandú", "ложка", "Ab" * 9, "の", "ﬁn", "Ǆ", "s", "re"]
    marks = ["", ",", "...", "!!", "###", "?),", "_", "$$$", "|"]
    return all(ids(c + m) == _letters(tokenizer, c.lower()) + (ids(m) if m else []) for c in cores for m in marks)


def _letters(tokenizer, word: str) -> list[int]:
    """Ids of lower-case letters by the model alone, without the steps that prepare other text."""
    if not word.isascii():
        word = "".join(part for part, _ in _BYTES.pre_tokenize_str(word))
    return [t.id for t in tokenizer.model.tokenize(word)]


class Encoder:
    """Ids of texts by a vocabulary file.

    Where blanks part words for the tokenizer, each different word is encoded
    once per batch, frequent words once per worker, and a text's ids are those
    of its words. Words of letters and marks are further parted where probes
    show that this changes nothing. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        # workers outlive tasks; what they know is kept in a module of its own
        shelf = sys.modules.setdefault("_llm_token_memory", types.ModuleType("_llm_token_memory"))
        if getattr(shelf, "path", None) != path:
            shelf.path, shelf.tokenizer, shelf.words, shelf.parts = path, _tokenizer(path), {}, {}
            shelf.by_word = splits_at_blanks(shelf.tokenizer)
            shelf.by_mark = shelf.by_word and splits_at_marks(shelf.tokenizer)
        self.tokenizer, self.by_word, self.by_mark = shelf.tokenizer, shelf.by_word, shelf.by_mark
        self.words, self.parts = shelf.words, shelf.parts

    def _part(self, part: str, letters: bool) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            found = _letters(self.tokenizer, part) if letters else self.tokenizer.encode(part, add_special_tokens=False).ids
            ids = array("I", found).tobytes()
            if len(self.parts) < MEMORY_WORDS and len(part) <= LONGEST_WORD:
                self.parts[part] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.by_mark and (match := _LETTERS_MARKS.fullmatch(text)):
            core, marks = match.groups()
            low = core.lower()
            if core.isascii() or (core.isalpha() and low.isalpha() and "Σ" not in core and unicodedata.is_normalized("NFC", core)):
                return self._part(low, True) + (self._part(marks, False) if marks else b"")
        return self._whole(text)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids_of_words(self, words: pa.Array) -> list[bytes]:
        """Ids of different words; most are letters with marks, and their parts are looked up once each."""
        if self.by_mark:
            found = pc.extract_regex(words, _PLAIN)
            core, marks = (pc.if_else(found.is_valid(), found.field(k), None).dictionary_encode() for k in (0, 1))
            known = [self._part(w, True) for w in core.dictionary.to_pylist()]
            after = [self._part(w, False) if w else b"" for w in marks.dictionary.to_pylist()]
            pairs = zip(*(x.indices.fill_null(-1).to_pylist() for x in (core, marks)))
            out = [known[a] + after[b] if a >= 0 else None for a, b in pairs]
            odd = np.flatnonzero(found.is_null())
        else:
            out, odd = [None] * len(words), np.arange(len(words))
        memory = self.words
        for k, word in zip(odd.tolist(), words.take(pa.array(odd)).cast(pa.large_binary()).to_pylist()):
            ids = memory.get(word)
            if ids is None:
                ids = self._word(word)
                if len(memory) < MEMORY_WORDS and len(word) <= LONGEST_WORD:
                    memory[word] = ids
            out[k] = ids
        return out

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text's."""
        if not self.by_word:
            found = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
            bounds = np.cumsum([0] + [len(x) for x in found])
            return np.array([i for x in found for i in x], "<u4"), bounds
        if self.by_mark and not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        ids = self._ids_of_words(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(map(ids.__getitem__, codes.tolist())), "<u4")
        ends = np.concatenate(([0], np.cumsum(sizes[codes]) if len(codes) else np.zeros(0, np.int64)))
        return flat, ends[np.asarray(parts.offsets) - parts.offsets[0].as_py()]

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers; a missing text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + CHUNK, "right")) - 1)
            ids, bounds = self._chunk(texts.slice(low, high - low))
            for a, b in zip(bounds[:-1], bounds[1:]):
                yield ids[a:b]
            low = high
            # workers outlive tasks and pipelines; what a chunk took goes back to the system
            pa.default_memory_pool().release_unused()


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold enough text to be worth a pass, yet bounded."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
