"""Exact token ids of public tokenizer files, with a bounded memory of chunks.

The library needs microseconds for a chunk of text, a dictionary a fraction of one,
and texts repeat their words. A text is therefore cut where no token can span,
at ASCII white space, and every distinct chunk is encoded by the library once per
Python worker. A text that holds something for which such a cut could matter goes
to the library whole: an added token's ``<|``, or white space beyond ASCII.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache

import numpy as np

from labelloom.llm.memories import remembered

MAX_CHUNKS = 900_000
_ENCODE_AT_ONCE = 4096

# A chunk takes one space before it, as the byte-level pattern does; of longer white
# space all but the last character is a piece of its own. A chunk whose last character is a
# letter or a digit ends at one of the signs that follow words, so that a word is one chunk
# with and without them; any other goes on to white space.
_SPACED = re.compile(r" ?[^\x20\x09-\x0D.,;:!?]++(?:(?<=[\W_])[^\x20\x09-\x0D]+)?| ?[^\x20\x09-\x0D]+"
                     r"|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = re.compile(r"[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")


# A space or none, and letters that every version of Unicode has as such: one piece of the byte-level pattern.
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch


def _byte_letters() -> dict[int, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [byte for byte in range(256) if byte not in plain]
    return {byte: 256 + i for i, byte in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


@cache
def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def letters_model(path: str):
    """The library's model, if a piece of letters is all that its steps before the model make of one; else None.

    That is so with byte-level pieces as the only step and no added token that letters could hold.
    """
    tokenizer = library_tokenizer(path)
    stated = json.loads(tokenizer.to_str())
    step = stated["pre_tokenizer"] or {}
    plain = (stated["normalizer"] is None and stated["truncation"] is None and stated["padding"] is None
             and (step.get("type"), step.get("add_prefix_space"), step.get("use_regex")) == ("ByteLevel", False, True)
             and not any(_LETTERS(token["content"]) for token in stated["added_tokens"]))
    return tokenizer.model if plain else None


def file_digest(path: str) -> str:
    """SHA-256 of the tokenizer's file: its version."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _needs_whole(text: str) -> bool:
    """Whether a cut at ASCII white space could matter."""
    return "<|" in text or _SPACES.search(text) is not None


class _Places(dict):
    """Numbers chunks as they are met, and remembers which are new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self)
        self.new.append(chunk)
        return place


class ChunkEncoder:
    """Token ids or counts of texts, equal to the library's for the whole text.

    ``keep_spaces`` tells whether white space makes tokens. Without it a text is
    cut into words and white space is dropped, as the tokenizer itself does. At
    most ``max_chunks`` chunks are remembered between calls; then all are forgotten.
    """

    def __init__(self, path: str, keep_spaces: bool, max_chunks: int = MAX_CHUNKS):
        self._tokenizer = library_tokenizer(path)
        self._letters = letters_model(path) if keep_spaces else None
        self._split = (_SPACED if keep_spaces else _WORDS).findall
        self._max_chunks = max_chunks
        self._forget()

    def _forget(self) -> None:
        self._places = _Places()
        self._ids = np.zeros(1 << 16, np.uint32)
        self._starts = np.zeros(1, np.int64)
        self._used = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(texts), _ENCODE_AT_ONCE):
            part = texts[i:i + _ENCODE_AT_ONCE]
            out += [e.ids for e in self._tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _chunk_ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks. Those of letters alone go to the library's model, which needs half the time of all its steps."""
        if self._letters is None:
            return self._library(chunks)
        tokens, out = self._letters.tokenize, []
        for chunk in chunks:
            if _LETTERS(chunk):
                piece = chunk.encode().decode("latin-1").translate(_BYTE_LETTERS)
                out.append([token.id for token in tokens(piece)])
            else:
                out += self._library([chunk])
        return out

    def _learn(self) -> None:
        """Encode the new chunks and append their ids to the flat memory."""
        new, self._places.new = self._places.new, []
        for i in range(0, len(new), _ENCODE_AT_ONCE):
            encoded = self._chunk_ids(new[i:i + _ENCODE_AT_ONCE])
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            flat = np.fromiter((x for ids in encoded for x in ids), np.uint32, int(sizes.sum()))
            while self._used + len(flat) > len(self._ids):
                self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
            self._ids[self._used:self._used + len(flat)] = flat
            self._starts = np.concatenate([self._starts, self._used + np.cumsum(sizes)])
            self._used += len(flat)

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and their number per chunk."""
        self._learn()
        begin = self._starts[places]
        size = self._starts[places + 1] - begin
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self._ids[np.arange(total) + np.repeat(begin - (ends - size), size)], size

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text."""
        if len(self._places) > self._max_chunks:
            self._forget()
        out = np.zeros(len(texts), np.int64)
        known: list[tuple[int, np.ndarray]] = []
        for i, text in enumerate(texts):
            if _needs_whole(text):
                out[i] = len(self._library([text])[0])
            else:
                known.append((i, self._chunks(text)))
        self._learn()
        sizes = np.diff(self._starts)
        for i, places in known:
            out[i] = sizes[places].sum()
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        if len(self._places) > self._max_chunks:
            self._forget()
        parts: list[np.ndarray] = []
        for text in texts:
            whole = _needs_whole(text)
            parts.append(np.array(self._library([text])[0], np.uint32) if whole else self._chunks(text))
        known = [p for p in parts if p.dtype == np.int64]
        flat, size = self._gather(np.concatenate(known) if known else np.zeros(0, np.int64))
        borders = np.concatenate([[0], np.cumsum(size)])
        out, at, used = [], 0, 0
        for part in parts:
            if part.dtype == np.int64:
                at += len(part)
                out.append(flat[used:borders[at]])
                used = borders[at]
            else:
                out.append(part)
        return (np.concatenate(out) if out else flat), np.array([len(x) for x in out], np.int64)

    def _chunks(self, text: str) -> np.ndarray:
        pieces = self._split(text)
        return np.fromiter(map(self._places.__getitem__, pieces), np.int64, len(pieces))


def chunk_encoder(path: str, keep_spaces: bool) -> ChunkEncoder:
    """The encoder of this Python worker; workers are reused, and so is what they know."""
    return remembered(("chunks", path, keep_spaces), lambda: ChunkEncoder(path, keep_spaces))
