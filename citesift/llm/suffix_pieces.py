"""SentencePiece encoding and decoding by suffix-array matching.

A text's pieces never reach over the start of a new word, so a block of texts is encoded through its distinct
words.  They are concatenated and indexed by a suffix array; every piece of the vocabulary is found in it by
binary search, all pieces at once; the occurrences become edges, kept by position; and the edges are relaxed:
starting from single characters, the best edge over two neighbouring symbols of each word is taken until none
is left, all words of the block at once.  That is the order of a byte-pair model's merges.  Characters outside
the vocabulary become their bytes.  Decoding puts the pieces' bytes together again.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.llm import words as W
from citesift.llm.shared import fresh
from citesift.session import ship_package

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
BLOCK = 8 << 20
REMEMBER = 600_000
SHORT = 24
# a longer word is relaxed by itself, with a queue: one step a round would take as many rounds as it has characters
LONG = 64
NONE = np.iinfo(np.int32).max

_WORKER: dict[str, "Pieces"] = {}


class Pieces:
    """A byte-pair vocabulary with byte fallback, and words encoded with it."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in plain}
        self.bytes_at = next(i for i in range(n) if sp.is_byte(i) and sp.id_to_piece(i) == "<0x00>")
        self.letter = {ord(t): i for i, t in text.items() if len(t) == 1}
        self.letter_code = np.array(sorted(self.letter), dtype=np.uint32)
        self.letter_id = np.array([self.letter[c] for c in sorted(self.letter)], dtype=np.int32)
        joined = [i for i in plain if len(text[i]) > 1]
        self.ids = np.array(joined, dtype=np.int32)
        self.sizes = np.array([len(text[i]) for i in joined], dtype=np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.codes = np.zeros((len(joined), self.longest), dtype=np.int64)
        for r, i in enumerate(joined):
            self.codes[r, :len(text[i])] = [ord(c) for c in text[i]]
        # better scores merge first; equal scores are one rank, and the leftmost goes first
        scores = -np.array([sp.get_score(i) for i in joined])
        self.rank = np.full(n, NONE, dtype=np.int32)
        self.rank[self.ids] = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        self.by_text = {text[i]: i for i in joined}
        self.raw = [b""] * n
        for i, t in text.items():
            self.raw[i] = t.replace(SPACE, " ").encode("utf-8")
        for b in range(256):
            self.raw[self.bytes_at + b] = bytes([b])
        self.known: dict[str, bytes] = {}

    # -- suffix array ---------------------------------------------------------------------------------------

    def _suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Positions ordered by the text from there on, as far as the longest piece reaches.

        The first order is by as many characters as one number holds; each further one doubles its reach.
        """
        present = np.unique(codes)
        letter = np.searchsorted(present, codes) + 1
        bits = int(len(present) + 1).bit_length()
        have = min(max(1, 62 // bits), self.longest)
        key = np.zeros(len(codes), np.int64)
        for k in range(have):
            key <<= bits
            # fewer characters than one number holds: the places after the last one stay empty
            if k < len(codes):
                key[:len(codes) - k] |= letter[k:]
        order = np.argsort(key)
        while have < self.longest:
            ranked = key[order]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            key = rank * (int(rank[order[-1]]) + 2)
            key[:max(0, len(key) - have)] += rank[have:] + 1
            order = np.argsort(key)
            have *= 2
        return order

    def _ranges(self, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every piece the range of the suffix array that starts with it, by binary search for all at once."""
        padded = np.concatenate([codes, np.zeros(self.longest, np.int64)])
        reach = np.arange(self.longest)
        inside = reach[None, :] < self.sizes[:, None]
        bounds = []
        for upper in (False, True):
            lo = np.zeros(len(self.ids), np.int64)
            hi = np.full(len(self.ids), len(order), np.int64)
            while True:
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    break
                mid = (lo[live] + hi[live]) // 2
                diff = (padded[order[mid][:, None] + reach[None, :]] - self.codes[live]) * inside[live]
                first = np.argmax(diff != 0, axis=1)
                sign = diff[np.arange(len(live)), first]
                right = sign <= 0 if upper else sign < 0
                lo[live[right]] = mid[right] + 1
                hi[live[~right]] = mid[~right]
            bounds.append(lo)
        return bounds[0], bounds[1]

    def _edges(self, codes: np.ndarray) -> np.ndarray:
        """The piece that covers ``length`` characters from ``position`` at ``position * (longest + 1) + length``."""
        table = np.zeros(len(codes) * (self.longest + 1), dtype=np.int16 if len(self.rank) <= 1 << 15 else np.int32)
        order = self._suffixes(codes)
        lo, hi = self._ranges(codes, order)
        n = hi - lo
        piece = np.repeat(np.arange(len(n)), n)
        at = order[np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n) + lo[piece]]
        table[at * (self.longest + 1) + self.sizes[piece]] = self.ids[piece]
        return table

    # -- relaxing -------------------------------------------------------------------------------------------

    def _relax(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Final symbols as (word, start, stop), sorted by word and start; words do not overlap."""
        edges, wide = self._edges(codes), self.longest + 1
        sizes = end - begin
        word = np.repeat(np.arange(len(begin), dtype=np.int32), sizes)
        start = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[word]
        stop = start + 1
        done = []
        while len(word):
            m = len(word)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.empty(m, np.int64)
            np.subtract(stop[1:], start[:-1], out=length[:-1])
            # no edge has length 0, and piece 0 is none: the last symbol of a word has no rank
            length[np.append(heads[1:], m) - 1] = 0
            length[length >= wide] = 0
            rank = self.rank[edges[start * wide + length]].astype(np.int64)
            best = np.minimum.reduceat(rank * m + np.arange(m), heads)
            over = best >= NONE * m
            at = best[~over] % m
            stop[at] = stop[at + 1]
            keep = np.ones(m, bool)
            keep[at + 1] = False
            if over.any():
                finished = np.repeat(over, np.diff(np.append(heads, m)))
                done.append((word[finished], start[finished], stop[finished]))
                keep &= ~finished
            word, start, stop = word[keep], start[keep], stop[keep]
        if not done:
            z = np.zeros(0, np.int64)
            return z, z, z
        word, start, stop = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(start, kind="stable")
        return word[order], start[order], stop[order]

    def _by_queue(self, word: str) -> bytes:
        """One long word: the same steps with a queue of possible merges."""
        n = len(word)
        stop, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and stop[j] - i <= self.longest:
                piece = self.by_text.get(word[i:stop[j]])
                if piece is not None:
                    heapq.heappush(queue, (int(self.rank[piece]), i, stop[j]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, to = heapq.heappop(queue)
            if stop[i] < 0 or after[i] >= n or stop[after[i]] != to:
                continue
            j = after[i]
            stop[i], after[i], stop[j] = to, after[j], -1
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            part = word[i:stop[i]]
            piece = self.letter.get(ord(part)) if len(part) == 1 else self.by_text[part]
            out += [piece] if piece is not None else [self.bytes_at + b for b in part.encode("utf-8")]
            i = stop[i]
        return np.asarray(out, dtype="<i4").tobytes()

    def _batch(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        # a character no piece holds stands between the words
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        word, start, stop = self._relax(codes, begin, begin + sizes)
        edges_of = stop - start
        single = edges_of == 1
        code = codes[start].astype(np.uint32)
        at = np.minimum(np.searchsorted(self.letter_code, code), len(self.letter_code) - 1)
        ids = np.where(single & (self.letter_code[at] == code), self.letter_id[at], -1).astype(np.int64)
        big = np.flatnonzero(~single)
        text = "\0".join([*words, ""])
        ids[big] = [self.by_text[text[a:b]] for a, b in zip(start[big].tolist(), stop[big].tolist())]
        lost = ids < 0
        width = np.ones(len(ids), np.int64)
        raw = [text[a].encode("utf-8") for a in start[lost].tolist()]
        width[lost] = [len(r) for r in raw]
        out = np.repeat(ids, width)
        if raw:
            out[np.repeat(lost, width)] = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64) + self.bytes_at
        packed = out.astype("<i4").tobytes()
        per_word = np.zeros(len(words), np.int64)
        np.add.at(per_word, word, width)
        cuts = (4 * np.concatenate([[0], np.cumsum(per_word)])).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text; an empty text has none."""
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if len(self.known) + len(new) > REMEMBER:
            self.known = {}
            new = set(chain.from_iterable(split))
        # a word with the separator in it would fall apart: the queue takes it, like the long ones
        alone = [w for w in new if len(w) > LONG or "\0" in w]
        rest = list(new.difference(alone))
        self.known.update(zip(rest, self._batch(rest)))
        self.known.update((w, self._by_queue(w)) for w in alone)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, s)), dtype="<i4") for s in split]
        for w in new:
            if len(w) > SHORT:
                del self.known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space put before a text when it was encoded is taken off again."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode("utf-8", "replace")


def _pieces(path: str) -> Pieces:
    if path not in _WORKER:
        _WORKER[path] = Pieces(path)
    return _WORKER[path]


def encode(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """``keys``, ``n_tokens``, ``token_ids`` and ``restored`` for every row.

    ``token_ids`` are the ids that the byte-pair model gives the whole text (no begin or end ids), and
    ``restored`` tells whether decoding them gave the text again; a text that holds the model's own space
    mark (U+2581) comes back with spaces instead.  A null or empty text has no ids.  Rows with equal or null
    keys are encoded each for itself; columns not named are not read.  An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    body = fresh(docs, "body")[0]
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias(body))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            for part, raw, offs in W.blocks(batch, body, BLOCK):
                data, cuts = raw.tobytes(), offs.tolist()
                texts = [data[a:b].decode("utf-8") for a, b in zip(cuts, cuts[1:])]
                ids = pieces.encode(texts)
                same = [pieces.decode(i.tolist()) == t.replace(SPACE, " ") and SPACE not in t for i, t in zip(ids, texts)]
                sizes = np.array([len(i) for i in ids], dtype=np.int64)
                stops = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(sizes), pa.ListArray.from_arrays(stops, flat), pa.array(same, pa.bool_())],
                    names=[*keys, "n_tokens", "token_ids", "restored"])

    return rows.mapInArrow(run, f"{fields}, n_tokens bigint, token_ids array<int>, restored boolean")


def decode(rows: DataFrame, ids: str = "token_ids", keys: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """``keys`` and ``text``: the texts of columns of ids; null ids give the empty text."""
    ship_package(rows.sparkSession)
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    rows = rows.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{ids}`").alias("__ids"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            texts = [pieces.decode(i or []) for i in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keys, "text"])

    return rows.mapInArrow(run, f"{fields}, text string")
