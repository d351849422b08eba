"""BPE encoding and decoding by forced-boundary splitting.

A merge always yields a token of the vocabulary, so two neighbouring bytes that stand next to each
other in no token are never merged across: such a pair marks a certain cut. White space and
the borders between words, digits and marks are certain cuts as well. A text is split at all
certain cuts, each fragment is encoded on its own, and the ids are joined. Fragments seen
before come from caches of bounded size, which forget the older half when they are full.

The vocabulary file is a word-end BPE with byte alphabet (``tokenizers`` JSON); only its
vocabulary, merges and special tokens are read. Null texts count as empty and give no ids; rows
that repeat give equal rows; a null doc_id stays null. Extra columns are dropped unless asked for.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from serieslake.llm.common import keep, with_columns_of_text

VOCABULARY = "word_bpe_49k.json"
CACHED = 300_000  # chunks, and words, that each generation of a worker's caches holds at most; there are two
WORD_END = "</w>"
# fixed values: the pattern that the vocabulary was made with
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# str.split() splits at these, too, but they are no white space to the vocabulary
_SEPARATORS = "\x1c\x1d\x1e\x1f"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space as the vocabulary means it
RARE = re.compile("[^\0-\u017f]")  # letters whose class may differ between versions of Unicode
_UNSPACED = regex.compile(f"[^{WHITE}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others,
    in order, for the letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def chunks(text: str) -> list[str]:
    """The runs of a text without white space."""
    if any(mark in text for mark in _SEPARATORS):
        return _UNSPACED.findall(text)
    return text.split()


class Coder(dict):
    """Chunk -> little-endian 32-bit ids of it; a missing chunk is encoded and kept."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        library = Tokenizer.from_file(path)
        self._normalizer, self._pre_tokenizer = library.normalizer, library.pre_tokenizer
        vocabulary, merges = stored["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in stored["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.token = {i: t for t, i in {**vocabulary, **self.special}.items()}
        self.size = max(self.token) + 1
        # a fragment that ends a word carries the end mark, one that a cut ends does not
        self._ending = models.BPE(vocab=vocabulary, merges=merges, end_of_word_suffix=WORD_END)
        self._inner = models.BPE(vocab=vocabulary, merges=merges)
        self._split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._words = regex.compile(WORD_PATTERN)
        self._letters = {b: letter for b, letter in enumerate(byte_letters()) if chr(b) != letter}
        bare = [t.removesuffix(WORD_END) for t in vocabulary]
        self.neighbours = {pair for t in bare for pair in zip(t, t[1:])}
        self._encoded: dict[str, bytes] = {}
        self._older_words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def fragments(self, word: str) -> list[str]:
        """A word in byte letters, split wherever two neighbours stand together in no token."""
        cuts = [i for i in range(1, len(word)) if (word[i - 1], word[i]) not in self.neighbours]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def _encode_letters(self, letters: str) -> bytes:
        """The ids of a word in byte letters, fragment by fragment."""
        if self.neighbours.issuperset(zip(letters, letters[1:])):
            found = [t.id for t in self._ending.tokenize(letters)]
        else:
            *inner, last = self.fragments(letters)
            found = [t.id for f in inner for t in self._inner.tokenize(f)] + [t.id for t in self._ending.tokenize(last)]
        return array("I", found).tobytes()

    def _encode_word(self, word: str) -> bytes:
        ids = self._encoded.get(word)
        if ids is None:
            ids = self._older_words.get(word)
            if ids is None:
                plain = word.isascii() and word.isprintable()
                ids = self._encode_letters(word if plain else word.encode().decode("latin-1").translate(self._letters))
            if len(self._encoded) >= CACHED:
                self._older_words, self._encoded = self._encoded, {}
            self._encoded[word] = ids
        return ids

    def encode_chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            if chunk.isalpha():
                return self._encode_word(chunk.lower())
            # the most common shapes of a chunk: a word with one mark behind it
            if chunk[:-1].isalpha() and chunk[-1] in ",.;:?!":
                return self._encode_word(chunk[:-1].lower()) + self._encode_word(chunk[-1])
        if "<|" in chunk and self._split_special.search(chunk):
            parts = self._split_special.split(chunk)
            return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self.encode_chunk(p) for p in parts if p)
        if not chunk.isascii():
            if RARE.search(chunk):
                # what counts as a letter depends on the library's Unicode tables
                pieces = self._pre_tokenizer.pre_tokenize_str(self._normalizer.normalize_str(chunk))
                return b"".join(self._encode_letters(letters) for letters, _ in pieces)
            chunk = unicodedata.normalize("NFC", chunk)
        return b"".join(map(self._encode_word, self._words.findall(chunk.lower())))

    def __missing__(self, chunk: str) -> bytes:
        ids = self._older.get(chunk)
        if ids is None:
            ids = self.encode_chunk(chunk)
        if len(self) >= CACHED:
            self._older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a text, as little-endian 32-bit integers."""
        return b"".join(map(self.__getitem__, chunks(text)))

    def decode(self, ids: bytes) -> str:
        """The text of ids. The file names no decoder, so tokens are joined by single spaces."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """The coder of a vocabulary file, kept by each worker until a task of another operator begins there."""
    keep("bpe", coder.cache_clear)
    return Coder(path)


@functools.lru_cache(maxsize=2)
def _decimals(size: int) -> list[str]:
    return list(map(str, range(size)))


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def encode(documents: DataFrame, columns: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` (all by default) with ``ids``, the token ids of the whole text."""

    def ids(texts):
        own = coder(vocabulary_path(vocabulary))
        yield [np.frombuffer(own.encode(t), "<u4").astype(np.int32) for t in texts]

    return with_columns_of_text(documents, columns, "ids array<int>", ids, operator="bpe")


def digests(documents: DataFrame, columns: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` with the number of tokens and the SHA-256 of the ids and of the decoded text."""

    def digested(texts):
        own = coder(vocabulary_path(vocabulary))
        decimal = _decimals(own.size)
        counts, ids_hash, text_hash = [], [], []
        for text in texts:
            ids = own.encode(text)
            listed = np.frombuffer(ids, "<u4").tolist()
            counts.append(len(listed))
            ids_hash.append(hashlib.sha256(" ".join(map(decimal.__getitem__, listed)).encode()).hexdigest())
            text_hash.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        return counts, ids_hash, text_hash

    return with_columns_of_text(documents, columns, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digested, operator="bpe")
