"""Token ids of whole batches of texts, word by word.

The tokenizer drops white space and never joins across it, so a text's ids are those of its words
one after the other. Each distinct word is encoded once and looked up afterwards. Words of plain
letters, digits and ASCII marks are cut by the tokenizer's own pattern and merged by rank;
all others go through the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from . import text

#: Words remembered; beyond that the memory starts anew.
MEMORY = 400_000

#: Fixed values of this kind of tokenizer: its pattern, for lower-case text of the plain characters below.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+|\n")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
SPECIAL = "<|"
WORD_END = "</w>"
#: A byte that no UTF-8 text holds, for the end of a word.
END_BYTE = b"\xff"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        letters = _byte_letters()
        ranks = {}
        for token, rank in vocab.items():
            if token.startswith(SPECIAL):
                continue
            end = token.endswith(WORD_END) and len(token) > len(WORD_END)
            body = token[: -len(WORD_END)] if end else token
            ranks[bytes(letters[c] for c in body) + END_BYTE * end] = rank
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.pieces: dict[str, list[int]] = {}

    def words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(ids of all words in a row, number of ids of each)."""
        plain = [w if PLAIN.fullmatch(w) and SPECIAL not in w else "" for w in words]
        odd = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
        ids, sizes, pieces = [], [], self.pieces
        row: list[int] = []
        at = 0
        for piece in PIECES.findall("\n".join(plain).lower() + "\n"):
            if piece == "\n":
                if not plain[at]:
                    row = next(odd).ids
                ids += row
                sizes.append(len(row))
                row, at = [], at + 1
                continue
            known = pieces.get(piece)
            if known is None:
                known = pieces[piece] = self.merge(piece.encode() + END_BYTE)
            row = row + known
        return ids, sizes

    def batch(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id behind each, n + 1 offsets)."""
        starts, ends, bounds = text.words(data, offsets)
        key, place, of = np.unique(text.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > MEMORY:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        new = self.keys[at] != key if len(self.keys) else np.ones(len(key), bool)
        if new.any():
            raw = data.tobytes()
            ids, sizes = self.words([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[place[new]].tolist(), ends[place[new]].tolist(), strict=True)])
            size = np.array(sizes, np.int32)
            first = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate((self.ids, np.array(ids, np.uint32)))
            keys = np.concatenate((self.keys, key[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.first, self.size = keys[order], np.concatenate((self.first, first))[order], np.concatenate((self.size, size))[order]
            at = np.searchsorted(self.keys, key)
        if len(self.pieces) > MEMORY // 4:
            self.pieces = {}
        size, first = self.size[at][of].astype(np.int64), self.first[at][of]
        # One id more for each text, behind its last word.
        ahead = np.concatenate(([0], np.cumsum(size)))
        places = ahead[bounds] + np.arange(len(bounds))
        out = np.full(places[-1], end_id, np.uint32)
        to = np.repeat(text.owners(bounds), size) + np.arange(ahead[-1])
        out[to] = self.ids[np.arange(ahead[-1]) + np.repeat(first - ahead[:-1], size)]
        return out, places


@cache
def encoder(path: str) -> Encoder:
    """One for each tokenizer and worker; what it has encoded stays with it."""
    return Encoder(path)
