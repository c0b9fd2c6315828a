"""Token ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit integers.

Byte-level BPE never merges across its own pre-tokens, and a single space or line end before a
letter or sign always starts one. So a text is encoded chunk by chunk, and chunks that were seen
before come from a bounded cache; new ones go to the library joined by line ends, which are one
token each. Where a text's white space is not plain, or it holds an added token of the tokenizer, the whole text is encoded at once.
"""

from __future__ import annotations

import os
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.common import worker_cache

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Chunks that a generation of the cache holds, about 200 bytes each.
CACHE = 300_000


@cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()
SPACE = LETTERS[32]


def shown(letters: str) -> str:
    return letters.encode().decode("latin-1").translate(LETTERS)


def is_plain(text: str) -> bool:
    """Whether all white space is single spaces and line ends, none of them last, and no line end is first or follows white space."""
    if not text or "  " in text or " \n" in text or "\n\n" in text or text[0] == "\n" or text[-1] in " \n":
        return False
    return text.replace("\n", "").isprintable()  # other white space is not


class ChunkEncoder:
    """encode() gives the ids of each text as bytes. The cache holds two generations of at most cache_limit chunks and a batch's."""

    def __init__(self, path: str = BYTE_BPE, cache_limit: int = CACHE):
        self.tokenizer, self.limit, self.known, self.old = tokenizer(path), cache_limit, {}, {}
        self.model = self.tokenizer.model
        ends = self._ids("\n")
        #: Chunks can only be joined and split where a line end is one id of its own.
        self.end = ends[0] if len(ends) == 1 and self._ids("a\n b").tolist().count(ends[0]) == 1 else None
        self.sign = {c: self._ids(c).tobytes() for c in ".,!?"}
        #: The library cuts these out of a text before anything else.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: A chunk of letters is one pre-token and can go straight to the library's BPE model.
        self.direct = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _word(self, shown: str) -> bytes:
        """Ids of one pre-token, given by the letters that stand for its bytes."""
        found = self.model.tokenize(shown)
        return found[0].id.to_bytes(4, "little") if len(found) == 1 else array("I", [t.id for t in found]).tobytes()

    def _learn(self, missing: set[str]) -> None:
        """Adds chunks, which stand for themselves after a space or start with a line end; a last sign after a letter is a token of its own."""
        known, old, signed = self.known, self.old, []
        if old:
            again = missing & old.keys()
            known.update((c, old[c]) for c in again)
            missing -= again
        line_end = int(self.end).to_bytes(4, "little")
        if "\n" in missing:  # a run of line ends would be encoded as one
            missing.remove("\n")
            known["\n"] = line_end
        wanted, direct, word = set(), self.direct, self._word
        for c in missing:
            letters = c.isalpha()
            if not letters and c[-1:] in self.sign and c[-2:-1].isalpha():
                signed.append(c)
                c = c[:-1]
                if c in known:
                    continue
                letters = c.isalpha()
            if direct and letters:
                known[c] = word(SPACE + (c if c.isascii() else shown(c)))
            elif direct and c[0] == "\n" and c[1:].isalpha():
                known[c] = line_end + word(c[1:] if c.isascii() else shown(c[1:]))
            else:
                wanted.add(c)
        chunks = list(wanted)
        for i in range(0, len(chunks), 256):
            some = chunks[i : i + 256]
            ids = self._ids("".join(c if c[:1] == "\n" else f"\n {c}" for c in some) + "\n")
            at = (np.flatnonzero(ids == self.end) * 4).tolist()
            raw = ids.tobytes()
            known.update((c, raw[a if c[:1] == "\n" else a + 4 : b]) for c, a, b in zip(some, at, at[1:]))
        known.update((c, known[c[:-1]] + self.sign[c[-1]]) for c in signed)

    def encode(self, texts: list[str | None], end: int | None = None) -> list[bytes]:
        last = b"" if end is None else end.to_bytes(4, "little")
        if len(self.known) > self.limit:
            self.old, self.known = self.known, {}
        plain = [self.end is not None and bool(t) and is_plain(t) and not any(a in t for a in self.added) for t in texts]
        coded = iter(self._plain([t for t, p in zip(texts, plain) if p]))
        return [(next(coded) if p else self._ids(t or "").tobytes()) + last for t, p in zip(texts, plain)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The chunks of all texts are numbered once; ids are looked up for each distinct one and gathered by number."""
        if not texts:
            return []
        chunks = pc.split_pattern(pc.replace_substring(pa.array(["\n" + t for t in texts], pa.large_string()), "\n", " \n"), " ")
        numbered = chunks.values.dictionary_encode()
        names, numbers = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        known = self.known
        known[""] = b""  # before the line end that starts each text
        ids = list(map(known.get, names))
        fresh = [i for i, x in enumerate(ids) if x is None]
        self._learn({names[i] for i in fresh})
        for i in fresh:
            ids[i] = known[names[i]]
        sizes = np.fromiter(map(len, ids), "i4", len(ids)) >> 2
        starts = np.cumsum(sizes, dtype="i4") - sizes
        n = sizes[numbers]
        ends = np.cumsum(n)
        where = np.arange(int(ends[-1]), dtype="i4") + np.repeat((starts[numbers] - (ends - n)).astype("i4"), n)
        out = np.frombuffer(b"".join(ids), "<u4")[where]
        bounds = np.append(0, ends)[chunks.offsets.to_numpy()].tolist()
        return [out[a + 1 : b].tobytes() for a, b in zip(bounds, bounds[1:])]


def shared_encoder(path: str = BYTE_BPE, cache_limit: int = CACHE) -> ChunkEncoder:
    """One for all tasks of an operator that run in a worker process."""
    return worker_cache(f"encoder {path} {cache_limit}", lambda: ChunkEncoder(path, cache_limit))


def batches_of(texts: list, rows: int = 2000):
    """Slices of at most so many rows: bounds what encode() holds."""
    for i in range(0, len(texts), rows):
        yield i, texts[i : i + rows]
