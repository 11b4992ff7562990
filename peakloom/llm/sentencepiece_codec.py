"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The library is only asked for the vocabulary.  A text is cut into words where no piece can reach
across; the symbols of all new words of a slice lie in one flat array.  In each round every word
takes its best pair (segmented minimum of the ranks) and merges its leftmost occurrences at once;
words without a pair leave the arrays.  Occurrences merge together only when no piece made from the
merged one ranks before it, else the leftmost alone, so the result equals one merge at a time.

Ids are packed as little-endian unsigned 32-bit integers.  A null text is empty; empty texts give
the begin and end ids only.  Other columns pass through; repeated rows are encoded one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from peakloom.llm.common import chunks

SPACE = "▁"
NONE = np.iinfo(np.int32).max
# Words kept between slices of one task.
CACHE_WORDS = 100_000
# Rows, and bytes of text, that are worked on at once.
SLICE_ROWS = 256
SLICE_BYTES = 1 << 20
_CHARS = 0x110000


class PieceCodec:
    """Tables of one model; build it once per worker with :func:`codec`."""

    def __init__(self, model: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        self.size, self.bos, self.eos, self.unk = n, lib.bos_id(), lib.eos_id(), lib.unk_id()
        names = [lib.id_to_piece(i) for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        byte = [lib.is_byte(i) for i in range(n)]
        normal = {names[i]: i for i in range(n) if not special[i] and not byte[i]}
        self.byte_ids = np.full(256, self.unk, np.int64)
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(names[i][3:-1], 16)] = i
        self.has_bytes = any(byte)
        scores = np.array([lib.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        # A symbol is a piece id, or size + code point for a character that is no piece.
        self.of_char = np.arange(_CHARS, dtype=np.int64) + n
        for piece, i in normal.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        symbol = lambda part: normal.get(part, n + ord(part) if len(part) == 1 else None)
        self.span = n + _CHARS
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = symbol(piece[:cut]), symbol(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.span + b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.ranks = rank[self.merged].astype(np.int32)
        left, right = self.keys // self.span, self.keys % self.span
        early = np.zeros(int(rank.max()) + 1, bool)
        for side in (left, right):
            inner = side < n
            part = rank[side[inner]]
            early[part[self.ranks[inner] <= part]] = True
        self.alone = early
        reach = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in normal)
        self.units = re.compile("(?s).+" if reach else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # Bytes of each piece for decoding; control pieces are silent.
        raw = []
        for i in range(n):
            if lib.is_control(i):
                raw.append(b"")
            elif lib.is_unknown(i):
                raw.append(" ⁇ ".encode())
            else:
                raw.append(bytes([int(names[i][3:-1], 16)]) if byte[i] else names[i].replace(SPACE, " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.silent = np.array([lib.is_control(i) for i in range(n)])
        self.starts_space = np.array([names[i].startswith(SPACE) and not special[i] for i in range(n)])

    def _pair_rows(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair that starts at each place, and where it stands in the table."""
        key = sym[:-1] * self.span + sym[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[at] == key) & (word[:-1] == word[1:])
        return np.append(np.where(good, self.ranks[at], NONE), np.int32(NONE)), np.append(at, 0)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and how many each has."""
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_sym, done_word = [], []
        while len(sym):
            rank, row = self._pair_rows(sym, word)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = best == NONE
            hit = np.flatnonzero((rank == best) & ~over)
            if len(hit):
                run = np.r_[True, np.diff(hit) != 1] | np.r_[True, word[hit[1:]] != word[hit[:-1]]]
                first = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
                take = (hit - first) % 2 == 0
                lead = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
                hit = hit[take & (lead | ~self.alone[rank[hit]])]
                sym[hit] = self.merged[row[hit]]
            stay = ~over
            stay[hit + 1] = False
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return self._ids(sym[order], word[order], len(words))

    def _ids(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        foreign = np.flatnonzero(sym >= self.size)
        if len(foreign) and self.has_bytes:
            bytes_of = [chr(c).encode("utf-8", "replace") for c in (sym[foreign] - self.size).tolist()]
            count = np.ones(len(sym), np.int64)
            count[foreign] = [len(b) for b in bytes_of]
            plain = np.repeat(sym >= self.size, count)
            sym, word = np.repeat(sym, count), np.repeat(word, count)
            sym[plain] = self.byte_ids[np.frombuffer(b"".join(bytes_of), np.uint8)]
        elif len(foreign):
            sym[foreign] = self.unk
        return sym, np.bincount(word, minlength=n_words)

    def words(self, text: str) -> list[str]:
        return self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str], known: dict[str, bytes] | None = None) -> list[bytes]:
        """Packed ids of each text with begin and end; ``known`` keeps words between calls."""
        known = {} if known is None else known
        if len(known) > CACHE_WORDS:
            known.clear()
        split = [self.words(t) for t in texts]
        new = list({w for words in split for w in words if w not in known})
        if new:
            ids, count = self.encode_words(new)
            packed, stops = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
            known.update(zip(new, (packed[i:j] for i, j in zip([0, *stops], stops)), strict=True))
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        return [b"".join((begin, *map(known.__getitem__, words), end)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the space before the first piece, which encoding adds, goes."""
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return ""
        size = self.raw_len[ids]
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(self.raw_at[ids] - (end - size), size)
        flat = self.raw[at].tobytes()
        return (flat[1:] if self.starts_space[ids[0]] else flat).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(model: str) -> PieceCodec:
    return PieceCodec(model)


def encode(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Replaces the text column by ``ids`` (binary), and a column ``ids`` if there is one."""
    rest = [c for c in df.columns if c not in (text, "ids")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                texts = rows.column(text).to_pylist()
                for a, b in chunks(texts, SLICE_BYTES):
                    ids = codec(model).encode([t or "" for t in texts[a:b]], known)
                    part = rows.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(ids, pa.binary())], [*rest, "ids"])

    return df.select(*rest, text).mapInArrow(run, f"{fields}ids binary")


def decode(df: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the packed ids; null ids count as none."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                texts = [codec(model).decode(np.frombuffer(x.as_py() or b"", "<u4").astype(np.int64)) for x in rows.column(ids)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*rows.schema.names, "decoded"])

    return df.mapInArrow(run, f"{fields}, decoded string")
