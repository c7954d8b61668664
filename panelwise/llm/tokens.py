"""Token ids of whole texts by a public tokenizer, word by word."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space, or a character that libraries disagree on, before a blank or a line end.
UNSAFE = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}][ \\n]"
#: A place between a visible ASCII character and a blank or a line end.
CUT = re.compile(r"(?<=[!-~])(?=[ \n])")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine (the package is installed wherever tasks run)."""
    import public_tokenizers

    return public_tokenizers.path(name)

BLANK = (" ", "\n")
#: Fixed value: the pattern by which the vocabulary that drops white space cuts a text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _pieces(word: str) -> int:
    """In how many pieces the vocabulary that drops white space cuts a word."""
    if word.isalpha() and word.isascii():
        return 1
    return len(PIECES.findall(unicodedata.normalize("NFC", word).lower()))



class Encoder:
    """Ids of texts, as the tokenizers library gives them for the whole text.

    Neither tokenizer carries anything across the border between a visible character and white space, so a text is
    the sequence of its words, each with the white space before it (``blanks=True``, byte-level vocabularies) or
    without any (``blanks=False``, vocabularies that drop white space). Distinct words of a batch go to the library
    once; up to ``cached`` of them are remembered, the others are encoded again with their next batch."""

    def __init__(self, path: str, blanks: bool, cached: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.blanks, self.cached = Tokenizer.from_file(path), blanks, cached
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of an id, or 1 if it ends a piece
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token) if blanks else token.endswith("</w>")
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word), every word a text of its own."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for e in found for x in e), np.uint32, int(lengths.sum())), lengths

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same from one text of all words, cut where a word's bytes or pieces end; one by one if that does not fit."""
        text = ("" if self.blanks else " ").join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        want = np.cumsum([len(w.encode()) if self.blanks else _pieces(w) for w in words])
        reached = np.cumsum(self.width[ids])
        if not len(ids) or reached[-1] != want[-1]:
            return self._each(words)
        ends = np.searchsorted(reached, want) + 1
        if (reached[ends - 1] != want).any() or (want[1:] == want[:-1]).any() or want[0] == 0:
            return self._each(words)
        return ids, np.diff(ends, prepend=0)

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word)."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            plain = not self.blanks or all(w[:1] in BLANK and "!" <= w[-1:] and (w[-1:] <= "~" or w[-1:].isalpha()) for w in part)
            for out, got in zip((ids, lengths), (self._joined if plain else self._each)(part), strict=True):
                out.append(got)
        return np.concatenate(ids), np.concatenate(lengths)

    def _words(self, words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, start, length) of words; ("", word) stands for a word without a blank before it, which is not remembered."""
        rows = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        heads = [i for i in missing if type(words[i]) is tuple]
        tails = missing if not heads else np.setdiff1d(missing, heads)
        ids, lengths = self._library([words[i] for i in tails])
        more, sizes_of_heads = self._each([words[i][1] for i in heads])
        ends = np.cumsum(lengths)
        pool = np.concatenate([self.ids, ids, more])
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        have = rows >= 0
        starts[have], sizes[have] = self.starts[rows[have]], np.diff(self.starts)[rows[have]]
        starts[tails], sizes[tails] = len(self.ids) + ends - lengths, lengths
        starts[heads], sizes[heads] = len(self.ids) + len(ids) + np.cumsum(sizes_of_heads) - sizes_of_heads, sizes_of_heads
        room = min(self.cached - len(self.known), len(tails))
        if room > 0:
            self.known.update(zip([words[i] for i in tails[:room]], range(len(self.known), len(self.known) + room), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + ends[:room]])
            self.ids = pool[: self.starts[-1]].copy()
        return pool, starts, sizes

    def _gather(self, flat: pa.Array, bare: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the end of each word in them; ``bare``: words without a blank before them."""
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if bare is not None:
            alone = np.flatnonzero(bare)
            first, place = np.unique(index[alone], return_inverse=True)
            heads = [words[i] for i in first]
            index = index.copy()
            index[alone] = len(words) + place
            words = [w if w[:1] == "\n" else " " + w for w in words] + [("", w) for w in heads]
            pool, starts, sizes = self._words(words)
        else:
            pool, starts, sizes = self._words(words)
        length = sizes[index]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return pool[np.repeat(starts[index] - (ends - length), length) + np.arange(total)], ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, end of each text in them); a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.blanks:
            lists = pc.ascii_split_whitespace(texts)
            ids, ends = self._gather(lists.flatten(), None)
            offsets = np.asarray(lists.offsets)
            return ids, np.concatenate([[0], ends])[offsets[1:] - offsets[0]]
        odd = np.asarray(pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False), bool)
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", texts), "\n", " \n"), " ")
        offsets = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
        flat, bare = lists.flatten(), np.zeros(int(offsets[-1]), bool)
        bare[offsets[:-1][np.diff(offsets) > 0]] = True
        ids, ends = self._gather(flat, bare)
        ends = np.concatenate([[0], ends])[offsets[1:]]
        if not odd.any():
            return ids, ends
        parts, starts = [], np.concatenate([[0], ends])
        for i in range(len(texts)):
            if odd[i]:
                words = CUT.split(texts[i].as_py())
                pool, begin, size = self._words([("", words[0])] + words[1:])
                parts.append(np.concatenate([pool[a : a + n] for a, n in zip(begin, size, strict=True)]))
            else:
                parts.append(ids[starts[i] : starts[i + 1]])
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])


_encoders: dict[tuple, Encoder] = {}


def encoder(name: str, blanks: bool) -> Encoder:
    """One encoder for each worker process; ``name`` is a public vocabulary or the path of a file."""
    if (name, blanks) not in _encoders:
        _encoders[name, blanks] = Encoder(name if os.path.sep in name else vocabulary(name), blanks)
    return _encoders[name, blanks]
