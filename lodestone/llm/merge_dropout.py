"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The vocabulary and merge scores come from a public model file. A word's symbols are merged best score
first, leftmost of equals, from an agenda; a candidate taken from the agenda is skipped
when a keyed hash says so: of seed, document, the word's position in it and the place inside the word, so
that each occurrence of a word draws anew. With dropout 0 the ids equal the
library's. Whatever is skipped, decoding gives the text back.

All words of a batch go through their agendas side by side, in numpy: a round takes the best candidate of every
word that has one left. Nothing is remembered between words, so memory does not depend on the vocabulary of the texts.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import tidy

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
DROPOUT, SEED = 0.1, 20
#: No piece continues after a letter with a space or a line end, so merges never cross these borders: words are stretches of spaces with the
#: letters that follow, and line ends. Words of up to so many characters go side by side, of about TABLE places at a time; CHUNK bounds those that are merged together.
WIDTHS, TABLE, CHUNK = (4, 8, 12, 16, 32, 128, 512), 1 << 18, 1 << 20
NO_RANK = 1 << 24
MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15


@cache
def vocabulary(path: str):
    """(id and score of each normal piece, id of each byte, decoded bytes of each id)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, bytes_, plain = {}, {}, []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(text[3:5], 16)] = i
            plain.append(bytes([int(text[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            plain.append(b"")
        else:
            pieces[text] = (i, model.get_score(i))
            plain.append(text.replace(SPACE, " ").encode())
    if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces) or len(bytes_) < 256:
        raise ValueError("the model needs byte fallback and pieces within words")
    return pieces, bytes_, plain


class Merges:
    """The pairs of symbols that make a piece, by an open hash table; symbols are pieces and single characters, numbered."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_: dict[int, int]):
        letters = sorted({c for p in pieces for c in p})
        names = [*pieces, *[c for c in letters if c not in pieces]]
        number = {p: i for i, p in enumerate(names)}
        #: The number of a character that is in no piece, and of U+2581 itself, which stands for a space in pieces.
        self.other = len(names)
        self.ids = np.array([pieces[p][0] if p in pieces else -1 for p in names] + [-1], "i4")
        self.of_letter = np.full(0x110000, self.other, "i4")
        for c in letters:
            self.of_letter[ord(c)] = number[c]
        self.of_letter[ord(" ")], self.of_letter[ord(SPACE)] = number[SPACE], self.other
        order = {x: i for i, x in enumerate(sorted({-score for _, score in pieces.values()}))}
        rank = [order[-pieces[p][1]] for p in pieces]
        found = {}
        for p, i in zip(pieces, range(len(pieces))):
            for at in range(1, len(p)):
                if p[:at] in number and p[at:] in number:
                    found[number[p[:at]] * (self.other + 1) + number[p[at:]]] = (rank[i], i)
        bits = max(4, (4 * len(found)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.ranks, self.made = np.full(size, -1, "i8"), np.full(size, NO_RANK, "i4"), np.zeros(size, "i4")
        self.probes = 1
        for key, (r, i) in found.items():
            at, probes = int(self._slot(np.array([key], "i8"))[0]), 1
            while self.keys[at] >= 0:
                at, probes = (at + 1) % size, probes + 1
            self.keys[at], self.ranks[at], self.made[at] = key, r, i
            self.probes = max(self.probes, probes)
        self.byte = np.array([bytes_[b] for b in range(256)], "i4")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype("u8") * np.uint64(STEP)) >> self.shift).astype("i8")

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair, NO_RANK where there is none, and the symbol that it makes."""
        keys = a.astype("i8") * (self.other + 1) + b
        at = self._slot(keys)
        held = self.keys[at]
        for _ in range(self.probes):
            wrong = np.flatnonzero((held != keys) & (held >= 0))
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            held[wrong] = self.keys[at[wrong]]
        rank = np.where(held == keys, self.ranks[at], NO_RANK)
        return rank, self.made[at]


@cache
def merges(path: str) -> Merges:
    pieces, bytes_, _ = vocabulary(path)
    return Merges(pieces, bytes_)


class MergeDropout:
    """encode() gives the ids of texts, each word by a draw of its own: word i of a text by draw first + i, in 64 bits."""

    def __init__(self, path: str = PIECES, dropout: float = DROPOUT, seed: int = SEED):
        self.merges, self.plain = merges(path), vocabulary(path)[2]
        self.bar, self.seed = int(dropout * (1 << 32)), seed

    def keys(self, draws: np.ndarray) -> np.ndarray:
        """The key of each draw, which its skips hang on."""
        x = draws.astype("u8") + np.uint64(self.seed * STEP & MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def encode(self, texts: list[str], firsts: list[int]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; empty for an empty text."""
        raw = [(" " + t).encode("utf-32-le", "surrogatepass") if t else b"" for t in texts]
        code = np.frombuffer(b"".join(raw), "<u4")
        sizes = np.array([len(r) // 4 for r in raw], "i8")
        ends = np.cumsum(sizes)
        new = np.zeros(len(code) + 1, bool)
        space, line = code == 32, code == 10
        new[:-1] = line
        new[1:-1] |= line[:-1] | (space[1:] & ~space[:-1])
        new[(ends - sizes)[sizes > 0]] = True
        new[len(code)] = True
        bounds = np.flatnonzero(new)
        # The words of text k are those from before[k] on.
        before = np.searchsorted(bounds, ends - sizes)
        text_of = np.searchsorted(ends, bounds[:-1], "right")
        draws = np.array(firsts, "u8")[text_of] + (np.arange(len(bounds) - 1) - before[text_of]).astype("u8") if len(bounds) > 1 else np.zeros(0, "u8")
        symbols, starts = self.merges.of_letter[code], np.zeros(len(code), bool)
        at = 0
        while at < len(bounds) - 1:  # words of at most CHUNK characters together, and one at least
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
            low, high = int(bounds[at]), int(bounds[to])
            starts[low:high] = self._merge(symbols[low:high], bounds[at : to + 1] - low, self.keys(draws[at:to]))
            at = to
        return self._ids(code, symbols, starts, ends - sizes, ends)

    def _merge(self, symbols: np.ndarray, bounds: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Merges in place: a symbol is held where it starts; the mask says where one does."""
        n = len(symbols)
        after, before, starts = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        ranks = np.full(n, NO_RANK, "i4")
        made = np.zeros(n, "i4")
        ranks[:-1], made[:-1] = self.merges.look(symbols[:-1], symbols[1:])
        ranks[bounds[1:] - 1] = NO_RANK
        lengths = np.diff(bounds)
        least = 1
        for width in WIDTHS:
            chosen = np.flatnonzero((lengths > least) & (lengths <= width))
            least = width
            # A table has a column for each word and a row for each of its places.
            for some in np.array_split(chosen, max(1, len(chosen) * width // TABLE)):
                self._side_by_side(width, bounds[some], bounds[some + 1], keys[some], symbols, ranks, made, after, before, starts)
        for w in np.flatnonzero(lengths > least).tolist():
            self._alone(int(bounds[w]), int(bounds[w + 1]), int(keys[w]), symbols, ranks, made, after, before, starts)
        return starts

    def _side_by_side(self, width, low, high, keys, symbols, ranks, made, after, before, starts) -> None:
        bits = width.bit_length()
        rows = np.arange(width)[:, None]
        flat = low[None, :] + rows
        inside = flat < high[None, :]
        table = np.where(inside, ranks[np.where(inside, flat, 0)].astype("i8"), NO_RANK) << bits | rows
        none = NO_RANK << bits
        while len(low):
            best = table.min(axis=0)
            alive = np.flatnonzero(best < none)
            if len(alive) < 0.8 * len(low):
                low, high, keys, table, best = low[alive], high[alive], keys[alive], np.ascontiguousarray(table[:, alive]), best[alive]
                alive = np.arange(len(low))
            at = best[alive] & ((1 << bits) - 1)
            first, end_of_word = low[alive], high[alive]
            left = first + at
            middle = after[left]
            end = after[middle]
            if self.bar:
                place = (at << 40 | (middle - first) << 20 | (end - first)).astype("u8")
                taken = (((keys[alive] ^ place) * np.uint64(STEP)) >> np.uint64(32)) >= self.bar
                table[at, alive] = none
                alive, at, left, middle, end, first, end_of_word = (x[taken] for x in (alive, at, left, middle, end, first, end_of_word))
            symbols[left], after[left], starts[middle] = made[left], end, False
            table[middle - first, alive] = none
            more = np.flatnonzero(end < end_of_word)
            before[end[more]] = left[more]
            table[at, alive] = none
            rank, made[left[more]] = self.merges.look(symbols[left[more]], symbols[end[more]])
            table[at[more], alive[more]] = rank.astype("i8") << bits | at[more]
            back = np.flatnonzero(at > 0)
            prior = before[left[back]]
            rank, made[prior] = self.merges.look(symbols[prior], symbols[left[back]])
            table[prior - first[back], alive[back]] = rank.astype("i8") << bits | (prior - first[back])

    def _alone(self, low, high, key, symbols, ranks, made, after, before, starts) -> None:
        """One long word, by a heap of candidates (rank, left, middle, end)."""
        agenda = [(int(ranks[i]), i, i + 1, i + 2) for i in range(low, high - 1) if ranks[i] != NO_RANK]
        heapq.heapify(agenda)
        while agenda:
            _, left, middle, end = heapq.heappop(agenda)
            if not starts[left] or after[left] != middle or middle >= high or not starts[middle] or after[middle] != end:
                continue
            if (((key ^ ((left - low) << 40 | (middle - low) << 20 | (end - low))) * STEP & MASK) >> 32) < self.bar:
                continue
            symbols[left] = self.merges.look(symbols[left : left + 1], symbols[middle : middle + 1])[1][0]
            after[left], starts[middle] = end, False
            if end < high:
                before[end] = left
            for a, b in ((left, end), (int(before[left]), left)):
                if a >= low and b < high:
                    rank = int(self.merges.look(symbols[a : a + 1], symbols[b : b + 1])[0][0])
                    if rank != NO_RANK:
                        heapq.heappush(agenda, (rank, a, b, int(after[b])))

    def _ids(self, code, symbols, starts, lows, highs) -> list[bytes]:
        """Ids of the symbols that start in each range; a character that is no piece is written as its UTF-8."""
        at = np.flatnonzero(starts)
        ids = self.merges.ids[symbols[at]]
        odd = np.flatnonzero(ids < 0)
        counts = np.ones(len(at), "i8")
        if len(odd):
            utf8 = [chr(c).encode("utf-8", "surrogatepass") for c in code[at[odd]].tolist()]
            counts[odd] = [len(u) for u in utf8]
            out = np.repeat(ids, counts)
            out[out < 0] = self.merges.byte[np.frombuffer(b"".join(utf8), "u1")]
        else:
            out = ids
        sums = np.append(0, np.cumsum(counts))
        cut = lambda x: sums[np.searchsorted(at, x)].tolist()
        return [out[a:b].astype("<u4").tobytes() for a, b in zip(cut(lows), cut(highs))]

    def decode(self, ids) -> str:
        """The text of ids that encode() gave; the space that encoding put first is taken away."""
        return b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace")[1:]


def first_draw(doc, seed: int) -> int:
    """The draw of a document's first word, of 64 bits; the draws of its further words follow."""
    return xxhash.xxh64_intdigest(str(doc).encode(), seed)


def parts_of(batch: pa.RecordBatch, rows: int = 400):
    """Slices of a batch of ids and texts, with both as lists; bounds what encode() holds."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = PIECES, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id and ids (array<int>) for every row, from its whole text; null text counts as empty and has no ids.

    Equal (seed, id, text) have equal ids, whatever the partitioning. Ids may be null or repeated; other columns are ignored.
    """

    def run(batches):
        coder = MergeDropout(model_path, dropout, seed)
        for batch in batches:
            for part, docs, texts in parts_of(batch):
                coded = coder.encode(texts, [first_draw(d, seed) for d in docs])
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>")


def decode_documents(coded: DataFrame, model_path: str = PIECES) -> DataFrame:
    """doc_id and text from rows of doc_id and ids; null ids count as none."""

    def run(batches):
        coder = MergeDropout(model_path, 0, 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    kind = dict(coded.dtypes)["doc_id"]
    return coded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, text string")


def recode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = PIECES, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Encodes and decodes every row in one pass: doc_id, n_tokens, ids_crc32, and n_chars and text_sha256 of the decoded text."""

    def run(batches):
        coder = MergeDropout(model_path, dropout, seed)
        for batch in batches:
            for part, docs, texts in parts_of(batch):
                rows = []
                for ids in coder.encode(texts, [first_draw(d, seed) for d in docs]):
                    text = coder.decode(memoryview(ids).cast("I"))
                    rows.append((len(ids) // 4, zlib.crc32(ids), len(text), hashlib.sha256(text.encode()).hexdigest()))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "ids_crc32", "n_chars", "text_sha256"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_crc32 long, n_chars long, text_sha256 string")
