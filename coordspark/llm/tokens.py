"""Token ids of many texts with a tokenizer file, word by word through a bounded cache.

A text is cut at white space, and a new word by the file's splitting pattern; the library's model is asked
once for each new piece. That gives the library's own ids when its splitter never joins across white
space, drops white space, and its normalizer changes single characters only, which holds for the characters
of ``_PLAIN`` and the steps that ``Encoder`` looks for in the file. Texts with any other character, or with
the string of an added token, go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import regex

_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]*")
#: The splitting pattern in the tokenizer file.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PIECE = regex.compile(_SPLIT)
_CACHE: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the
    others, in their order, for the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(own)))}


_LETTER = _byte_letters()


class _Words(dict):
    """Word to its number; a new word gets the next one and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Encoder:
    """``ids(texts)``: the ids of each text, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, most_words: int = 600_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.whole, self.most = Tokenizer.from_file(path), most_words
        spec = json.loads(self.whole.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        kinds = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_piece = steps == ["NFC", "Replace", "Lowercase"] and split[:1] == [_SPLIT] and kinds == ["Split", "ByteLevel"]
        self.model = self.whole.model
        self.added = [x["content"] for x in spec["added_tokens"]]
        self._clear()

    def _clear(self) -> None:
        self.words, self.flat, self.at, self.n = _Words(), np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        if (ids := self.pieces.get(piece)) is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTER)
            ids = self.pieces[piece] = tuple([t.id for t in self.model.tokenize(letters)])
        return ids

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        ids: list[int] = []
        size = []
        for word in new:
            before = len(ids)
            for piece in (word,) if word.isalpha() else _PIECE.findall(word):
                ids += self._piece(piece)
            size.append(len(ids) - before)
        end = self.at[self.n] + np.cumsum(size)
        while end[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(new) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.at[self.n] : end[-1]] = ids
        self.at[self.n + 1 : self.n + 1 + len(new)] = end
        self.n += len(new)

    def _plain(self, text: str) -> bool:
        return self.by_piece and _PLAIN.fullmatch(text) is not None and not any(x in text for x in self.added)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if not text:
                out.append(np.zeros(0, np.uint32))
            elif not self._plain(text):
                out.append(np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                found = text.lower().split()
                w = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
                if self.words.new:
                    self._learn()
                a, n = self.at[w], self.at[w + 1] - self.at[w]
                o = np.cumsum(n)
                out.append(self.flat[np.repeat(a - o + n, n) + np.arange(o[-1] if len(o) else 0)])
                if len(self.words) > self.most:
                    self._clear()
        return out


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file: made once, its words kept from batch to batch."""
    if path not in _CACHE:
        _CACHE[path] = Encoder(path)
    return _CACHE[path]


def word_bpe() -> str:
    """The place of the public 49k word BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
