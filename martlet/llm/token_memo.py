"""Token ids of whole texts by public tokenizers, each distinct word encoded once a worker.

Texts are cut at single spaces, where no token of the three supported kinds can cross; a
word's ids are looked up in a bounded memo, and only words not seen before reach a
tokenizer.  The ids of many texts are then gathered from flat arrays.  Ids equal those of
encoding each text whole: the tests compare both.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

MEMO_WORDS = 800_000          # words a memo holds before it starts anew
MEMO_CHARS = 32_000_000       # and their characters
BATCH_BYTES = 2_000_000       # bytes of text encoded at once


class _Codes(dict):
    """Word -> running number; unseen words are noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word):
        self[word] = code = len(self)
        self.new.append(word)
        return code


class _Store:
    """Ids of the words by code, in one growing array."""

    def __init__(self):
        self.ids = np.empty(1 << 16, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)

    def extend(self, lists) -> None:
        ends = self.ends[-1] + np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
        if ends[-1] > len(self.ids):
            grown = np.empty(int(ends[-1]) * 2, dtype=np.int32)
            grown[:self.ends[-1]] = self.ids[:self.ends[-1]]
            self.ids = grown
        self.ids[self.ends[-1]:ends[-1]] = np.fromiter(
            (i for ids in lists for i in ids), dtype=np.int32, count=int(ends[-1] - self.ends[-1]))
        self.ends = np.concatenate([self.ends, ends])

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all codes in turn, ids per code)."""
        starts = self.ends[codes]
        n = self.ends[codes + 1] - starts
        total = np.cumsum(n)
        at = np.arange(total[-1] if len(n) else 0) + np.repeat(starts - (total - n), n)
        return self.ids[at], n


class Memo:
    """``encoders`` turn a list of words into lists of ids.  Where a word is ``odd``, the
    single spaces around it are no safe cut, and ``cut`` parts its whole text instead."""

    def __init__(self, *encoders: Callable, odd: Callable | None = None,
                 cut: Callable | None = None, words: int = MEMO_WORDS, chars: int = MEMO_CHARS):
        self.encoders, self.odd, self.cut, self.most = encoders, odd, cut, (words, chars)
        self._clear()

    def _clear(self) -> None:
        self.codes, self.chars = _Codes(), 0
        self.stores = [_Store() for _ in self.encoders]
        self.flags = np.zeros(0, dtype=bool)

    def _codes_of(self, words: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.codes.__getitem__, words), dtype=np.int64, count=len(words))
        if new := self.codes.new:
            self.codes.new = []
            self.chars += sum(map(len, new))
            for store, encoder in zip(self.stores, self.encoders):
                store.extend(encoder(new))
            if self.odd:
                self.flags = np.concatenate([self.flags, np.fromiter(map(self.odd, new), dtype=bool, count=len(new))])
        return codes

    def encode(self, texts) -> list[tuple[np.ndarray, np.ndarray]]:
        """For an Arrow array of texts and each encoder: (ids of all texts in turn,
        number of ids of each text)."""
        import pyarrow.compute as pc
        if len(self.codes) > self.most[0] or self.chars > self.most[1]:
            self._clear()
        parts = pc.split_pattern(texts, " ")
        words = np.diff(parts.offsets.to_numpy())
        flat = parts.flatten().dictionary_encode()
        codes = self._codes_of(flat.dictionary.to_pylist())[flat.indices.to_numpy()]
        edges = np.concatenate([[0], np.cumsum(words)])
        if self.odd and self.flags[codes].any():
            flagged = np.concatenate([[0], np.cumsum(self.flags[codes])])[edges]
            pieces, at = [], 0
            for i in np.flatnonzero(np.diff(flagged)):
                own = self._codes_of(self.cut(texts[i].as_py()))
                pieces += [codes[at:edges[i]], own]
                at, words[i] = edges[i + 1], len(own)
            codes = np.concatenate([*pieces, codes[at:]])
            edges = np.concatenate([[0], np.cumsum(words)])
        out = []
        for store in self.stores:
            ids, n = store.gather(codes)
            out.append((ids, np.diff(np.concatenate([[0], np.cumsum(n)])[edges])))
        return out


def slices(texts, size: int = BATCH_BYTES):
    """An Arrow array of texts in slices (first row, slice) of about ``size`` bytes."""
    import pyarrow.compute as pc
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + size)) + 1
        yield start, texts.slice(start, end - start)
        start = end


# ---- byte-level BPE and piece model: a word keeps the space before it ----------------

# Both always cut between a visible character and a single space before another one (to
# the piece model U+2581 is a space too).
BEFORE_SPACE = re.compile(r"(?<=[^\s▁])(?= [^\s▁])")
_EDGE = re.compile(r"[\s▁]")


def space_is_odd(word: str) -> bool:
    return not word or bool(_EDGE.match(word[0]) or _EDGE.match(word[-1]))


def cut_before_space(text: str) -> list[str]:
    """The words of `` `` + text, each without the space it starts with."""
    return [c[1:] for c in BEFORE_SPACE.split(" " + text)]


def byte_values() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary -> the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_bpe(ranks_path: str, pattern: str) -> tuple[Callable, list[bytes]]:
    """Encoder of space + word by a byte-level BPE from its ranks (which are its ids), and
    the bytes of each id."""
    import tiktoken
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    entries = [b""] * (max(ranks.values()) + 1)
    for entry, i in ranks.items():
        entries[i] = entry
    return (lambda words: [encoding.encode_ordinary(" " + w) for w in words]), entries


def piece_model(path: str) -> tuple[Callable, list[bytes]]:
    """Encoder of words by a piece model, which puts the space itself, and the bytes of each
    id."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
               else b"" if model.is_control(i) or model.is_unknown(i)
               else model.id_to_piece(i).replace("▁", " ").encode()
               for i in range(model.vocab_size())]
    return (lambda words: model.encode(words, num_threads=1)), entries


# ---- word BPE: white space is dropped ------------------------------------------------

# The word pattern of the vocabulary's file, for lower-case text of Latin-1 letters.
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]"
                        r"|[^\t\n\x0B\x0C\r a-z0-9ß-öø-ÿ]+")
PLAIN = re.compile(r"[\x00-\x1B\x20-\x7Fß-öø-ÿÀ-ÖØ-Þ]*\Z")
WORD_END = "A"  # marks the end of a word: lower-cased text has no capital of its own


@lru_cache(maxsize=4)
def word_bpe(path: str) -> Callable:
    """Encoder of a word BPE (lower case, word ends).  Plain words are merged by its ranks,
    others and those with control strings by the tokenizer itself."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    values, ranks = byte_values(), {}
    for entry, i in vocabulary.items():
        if entry.startswith("<|") and entry.endswith("|>"):
            continue
        ended = entry.endswith("</w>") and entry != "</w>"
        raw = bytes(values[c] for c in (entry[:-4] if ended else entry))
        ranks[raw + WORD_END.encode() if ended else raw] = i
    merges = tiktoken.Encoding("word_bpe", pat_str=f"[^{WORD_END}]+{WORD_END}",
                               mergeable_ranks=ranks, special_tokens={})

    def encode(words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        for i, w in enumerate(words):
            if PLAIN.match(w) and "<|" not in w:
                out[i] = merges.encode_ordinary(
                    "".join([x + WORD_END for x in PLAIN_WORD.findall(w.lower())]))
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out
    return encode
