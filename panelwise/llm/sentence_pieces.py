"""Encoding and decoding with a SentencePiece BPE vocabulary by vectorised merge rounds.

The vocabulary is one of byte fallback, an identity normaliser and a blank put before the text, as the public one is. No
piece holds a blank after another character, so merges never pass from a word to the blanks before the next one, and a
text is the sequence of its words, each with the blanks before it. Distinct words of a batch are merged together: all
their symbols lie in one flat array, every round finds the best pair of each word and merges it.

Ids are kept as packed little-endian unsigned 32-bit integers (a binary column), see :func:`pack_ids`.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices
from .tokens import vocabulary

#: Fixed value: the character that stands for a blank inside pieces.
BLANK = "▁"
NEVER = np.iinfo(np.int64).max
#: Words still longer than this take the queue form when whole rounds do not fit them, or after ``ROUNDS`` rounds.
QUEUED = 512
ROUNDS = 48


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start .. start + length - 1`` of all runs, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def pack_ids(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each run of ids: little-endian unsigned 32-bit integers."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
    data = np.ascontiguousarray(ids, "<u4")
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def unpack_ids(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all values one after another, end of each value in them); a null value is empty."""
    values = pc.fill_null(packed.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    ids = np.frombuffer(whole[offsets[0] : offsets[-1]].tobytes(), "<u4")
    return ids, (offsets[1:] - offsets[0]) // 4


class Pieces:
    """The vocabulary as arrays, and the words met so far (up to ``cached``) with their ids."""

    def __init__(self, path: str, cached: int = 100_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        names = [model.id_to_piece(i) for i in range(n)]
        self.kind = np.array([1 if model.is_control(i) else 2 if model.is_unknown(i) else 3 if model.is_byte(i) else 0 for i in range(n)])
        bytes_of = np.flatnonzero(self.kind == 3)
        self.byte_ids = np.zeros(256, np.uint32)
        self.byte_ids[[int(names[i][3:5], 16) for i in bytes_of]] = bytes_of
        self.size = n
        surface = [
            b"" if k == 1 else " ⁇ ".encode() if k == 2 else bytes([int(name[3:5], 16)]) if k == 3 else name.replace(BLANK, " ").encode()
            for name, k in zip(names, self.kind, strict=True)
        ]
        self.width = np.array([len(s) for s in surface], np.int64)
        self.first = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.leads = np.array([name.startswith(BLANK) for name in names]) & (self.kind == 0)
        self.cached, self.rows = cached, {}
        self.pool, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.names, self.level, self.pair = names, np.unique([-model.get_score(i) for i in range(n)], return_inverse=True)[1], None

    # ---------------------------------------------------------------- merging

    def _prepare(self) -> None:
        """What encoding needs beyond decoding: symbols of characters, and all pairs that merge, in order."""
        names, n = self.names, self.size
        ids = {names[i]: int(i) for i in np.flatnonzero(self.kind == 0)}
        if any(BLANK in name.lstrip(BLANK) for name in ids):
            raise ValueError("a piece holds a blank after another character")
        symbols = dict(ids)  # also characters inside pieces that are no piece themselves
        for c in sorted({c for name in ids for c in name} - set(ids)):
            symbols[c] = n + len(symbols) - len(ids)
        self.known_symbols = n + len(symbols) - len(ids)
        self.of_char = np.full(0x110000, -1, np.int32)
        for name, i in symbols.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        self.of_char[ord(" ")] = self.of_char[ord(BLANK)]
        pairs = np.array(
            [
                (symbols[name[:k]] * self.known_symbols + symbols[name[k:]], i)
                for name, i in ids.items() for k in range(1, len(name)) if name[:k] in symbols and name[k:] in symbols
            ],
            np.int64,
        )
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pair, self.merged = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.rank = self.level[self.merged].astype(np.int64)  # smaller merges earlier

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; NEVER where the two do not merge."""
        key = a * self.known_symbols + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        found = (self.pair[at] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.rank[at], NEVER), np.where(found, self.merged[at], -1)

    def _queue(self, symbols: list[int]) -> list[int]:
        """One word by a priority queue: best rank first, the leftmost of equal ranks."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        rank, merged = (x.tolist() for x in self._lookup(np.array(symbols[:-1]), np.array(symbols[1:])))
        heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(rank, merged, strict=True)) if r != NEVER]
        heapq.heapify(heap)
        table = self._table()
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = m, None, after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(symbols) and (found := table.get((symbols[left], symbols[right]))):
                    heapq.heappush(heap, (found[0], left, symbols[left], symbols[right], found[1]))
        return [s for s in symbols if s is not None]

    def _table(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            left, right = np.divmod(self.pair, self.known_symbols)
            self._pairs = dict(zip(zip(left.tolist(), right.tolist()), zip(self.rank.tolist(), self.merged.tolist()), strict=True))
        return self._pairs

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, with their words (both in order of words).

        A round takes the smallest rank of each word and merges all its pairs of that rank, the leftmost of those that
        overlap. That equals one merge after another unless a symbol made so could at once merge as early or
        earlier; such a word merges only its leftmost pair in the round. Words without a pair leave the arrays."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, merged = self._lookup(symbols[:-1], symbols[1:])
        rank, merged = np.append(rank, NEVER), np.append(merged, -1)  # of each symbol and the one after it
        rank[:-1][word[1:] != word[:-1]] = NEVER
        turn = 0
        while len(symbols):
            turn += 1
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(word)))
            live = np.repeat(best != NEVER, sizes)
            if not live.all():
                done.append((symbols[~live], word[~live]))
                symbols, word, rank, merged = symbols[live], word[live], rank[live], merged[live]
                sizes, best = sizes[best != NEVER], best[best != NEVER]
                if not len(symbols):
                    break
            number = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(rank == best[number])
            runs = np.flatnonzero(np.r_[True, np.diff(at) > 1])  # pairs that overlap: every second one
            at = at[(np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))) % 2 == 0]
            made, own, level = merged[at], number[at], rank[at]
            # what each new symbol could merge with: the symbol before it (perhaps new as well) and the one after it
            new = symbols.copy()
            new[at] = made
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            left = np.maximum(at - 1, 0)
            left = np.where(gone[left], np.maximum(left - 1, 0), left)
            right = np.minimum(at + 2, len(symbols) - 1)
            has_left = (at > 0) & (word[left] == word[at])
            has_right = (at + 2 < len(symbols)) & (word[right] == word[at])
            with_left, made_left = self._lookup(new[left], made)
            with_right, made_right = self._lookup(made, symbols[right])
            with_left[~has_left], with_right[~has_right] = NEVER, NEVER
            early = np.unique(own[(with_left <= level) | (with_right <= level)])
            if len(early):
                stays = np.r_[True, np.diff(own) != 0] | ~np.isin(own, early)
                at, made, left, has_left = at[stays], made[stays], left[stays], has_left[stays]
                with_left, made_left, with_right, made_right = with_left[stays], made_left[stays], with_right[stays], made_right[stays]
            symbols = symbols.copy()
            symbols[at] = made
            rank[at], merged[at] = with_right, made_right
            rank[left[has_left]], merged[left[has_left]] = with_left[has_left], made_left[has_left]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
            if len(early) or turn == ROUNDS:  # long words that go step by step finish at once
                names, lengths = np.unique(word, return_counts=True)
                late = names if turn == ROUNDS else names[early]
                for name in np.intersect1d(late, names[lengths > QUEUED]):
                    mine = word == name
                    out = np.array(self._queue(symbols[mine].tolist()), np.int64)
                    done.append((out, np.full(len(out), name)))
                    symbols, word, rank, merged = symbols[~mine], word[~mine], rank[~mine], merged[~mine]
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        if self.pair is None:
            self._prepare()
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        start = self.of_char[chars]
        # characters without a symbol never merge; they stand as minus their code point less one
        start = np.where(start >= 0, start, -1 - chars.astype(np.int64)).astype(np.int64)
        symbols, word = self._rounds(start, word)
        lost = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if len(lost):
            inverse = {i: c for c, i in enumerate(self.of_char.tolist()) if i >= self.size} if (symbols[lost] >= self.size).any() else {}
            spelled = [chr(-1 - s if s < 0 else inverse[s]).encode("utf-8", "surrogatepass") for s in symbols[lost].tolist()]
            sizes = np.ones(len(symbols), np.int64)
            sizes[lost] = [len(s) for s in spelled]
            at = np.cumsum(sizes) - sizes
            out = np.repeat(symbols, sizes)
            out[ragged(at[lost], sizes[lost])] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            symbols, word = out, np.repeat(word, sizes)
        return symbols.astype(np.uint32), np.bincount(word, minlength=len(words)).astype(np.int64)

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, start, length) of distinct words."""
        rows = np.fromiter((self.rows.get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        parts = [self.merge([words[i] for i in missing[k : k + 20_000]]) for k in range(0, len(missing), 20_000)]
        ids = np.concatenate([self.pool, *[p[0] for p in parts]])
        lengths = np.concatenate([np.zeros(0, np.int64), *[p[1] for p in parts]])
        ends = np.cumsum(lengths) + len(self.pool)
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        have = rows >= 0
        starts[have], sizes[have] = self.starts[rows[have]], np.diff(self.starts)[rows[have]]
        starts[missing], sizes[missing] = ends - lengths, lengths
        room = max(0, min(self.cached - len(self.rows), len(missing)))
        if room and sum(len(words[i]) for i in missing[:room]) < 16 * room + 4_096:  # long words are not remembered
            self.rows.update(zip([words[i] for i in missing[:room]], range(len(self.rows), len(self.rows) + room), strict=True))
            self.starts = np.concatenate([self.starts, ends[:room]])
            self.pool = ids[: self.starts[-1]].copy()
        return ids, starts, sizes

    # ------------------------------------------------------- texts to ids and back

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, end of each text in them), without begin and end; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), bool)
        texts = pc.replace_substring(texts, BLANK, " ")
        texts = pc.if_else(pa.array(empty), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        blank = data == 0x20
        cut = blank & ~np.r_[False, blank[:-1]]  # the first blank of each run
        cut[offsets[:-1][~empty]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int64)
        flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data.tobytes())])
        coded = flat.dictionary_encode()
        pool, begin, size = self._of_words(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        lengths = size[index]
        ids = pool[ragged(begin[index], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets[1:])]
        return ids, ends

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, number of bytes of each), blanks before the first word included."""
        width = self.width[ids]
        return self.bytes[ragged(self.first[ids], width)], width

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each run of ids; a byte that is no part of a character becomes U+FFFD."""
        data, width = self.spell(ids)
        at = np.concatenate([[0], np.cumsum(width)])
        starts = np.concatenate([[0], ends[:-1]])
        # the blank before a text: of the first id that is no control id
        kind = self.kind[ids]
        shown = np.flatnonzero(kind != 1)
        lead = np.append(shown, len(ids))[np.searchsorted(shown, starts)]
        lead = np.where(lead < ends, lead, -1)
        strip = np.zeros(len(ends), bool)
        strip[lead >= 0] = self.leads[ids[lead[lead >= 0]]]
        out = []
        for i, (a, b, cut) in enumerate(zip(at[starts].tolist(), at[ends].tolist(), strip.tolist(), strict=True)):
            # control ids spell nothing, so the blank is the first byte
            part = data[a + cut : b].tobytes()
            try:
                out.append(part.decode())
            except UnicodeDecodeError:
                out.append(self._repaired(ids[starts[i] : ends[i]], cut))
        return out

    def _repaired(self, ids: np.ndarray, cut: bool) -> str:
        out, run = [], bytearray()
        for i in [*ids.tolist(), None]:
            if i is not None and self.kind[i] == 3:
                run += self.bytes[self.first[i] : self.first[i] + 1].tobytes()
                continue
            k = 0
            while k < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[k : k + size]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                k += size
            run.clear()
            if i is not None:
                out.append(self.bytes[self.first[i] : self.first[i] + self.width[i]].tobytes().decode())
        return "".join(out)[int(cut) :]


_pieces: dict[str, Pieces] = {}


def pieces(name: str) -> Pieces:
    """One vocabulary for each worker process; ``name`` is a public vocabulary or the path of a file."""
    if name not in _pieces:
        _pieces[name] = Pieces(name if os.path.sep in name else vocabulary(name))
    return _pieces[name]


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", begin: bool = True, end: bool = True, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``ids`` in place of ``text``: the ids that the sentencepiece library gives for the
    whole text, without sampling, packed as little-endian unsigned 32-bit integers.

    One row comes out for each row in, in any order of rows; equal rows stay apart. A null or empty text has only the
    begin and end ids; a null in any other column stays. Other columns are kept, also if named like a column used here
    (one already called ``ids`` is replaced). Very long texts are encoded whole: a batch is cut between texts only. An empty table gives
    an empty table. Words of equal rank merge from the left, as in the library."""
    others = [c for c in docs.columns if c not in (text, ids)]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string").alias(text))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name in others], T.StructField(ids, T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in slices(batches, text, 2 << 20):
            found, ends = own.encode(batch.column(text))
            n = len(ends)
            extra = int(begin) + int(end)
            lengths = np.diff(ends, prepend=0)
            stops = ends + extra * np.arange(1, n + 1)
            out = np.empty(len(found) + extra * n, np.uint32)
            if begin:
                out[stops - lengths - extra] = own.begin
            if end:
                out[stops - 1] = own.end
            out[ragged(stops - lengths - int(end), lengths)] = found
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pack_ids(out, stops)], names=[*others, ids])

    return rows.mapInArrow(encode, schema)


def decode_pieces(encoded: DataFrame, model: str = "piece_bpe_32k.model", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with a column ``text`` (replaced if there is one): what the library's ``decode`` gives for the packed
    ids. Null ids give an empty text; an id beyond the vocabulary is an error."""
    others = [c for c in encoded.columns if c != text]
    schema = T.StructType([*[encoded.schema[c] for c in others], T.StructField(text, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in slices(batches, ids, 2 << 20):
            found, ends = unpack_ids(batch.column(ids))
            texts = own.decode(found, ends)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(texts, pa.string())], names=[*others, text])

    return encoded.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(decode, schema)
