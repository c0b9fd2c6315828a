"""Secret scans: fixed patterns, and strings that a random-string Markov model explains better.

Two kinds of character bigram models are trained from labelled samples, one for each style of
random string and one for ordinary identifiers. A long token whose best random model beats the
ordinary one by a margin of log-likelihood is a secret.

The ordinary samples are names made of the words of two public vocabularies, of many languages, as programs and
people write them: with signs, in camel case, with versions, dates and numbers.
"""

from __future__ import annotations

import base64
import json
import math
import random
import re
from collections.abc import Iterable
from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import carried, tidy, worker_cache

# The base patterns that the contract of the query states.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Tokens that the models judge: the signs at their ends don't count, so runs of signs are none.
CANDIDATE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_=-]{18,}[A-Za-z0-9])")
#: Tokens of this form name things and are never judged.
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Nats by which a random model must win.
MARGIN = 14.0
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STYLES = {
    "hex": "0123456789abcdef",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "urlsafe": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
}
#: Where the ordinary words come from: of one file those that end a word, of the other those that start one.
VOCABULARIES = (public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@cache
def ordinary_words(vocabularies: tuple[str, str] = VOCABULARIES) -> tuple[str, ...]:
    """ASCII words of 2 to 14 letters of both vocabularies, in lower case, in alphabetical order."""
    ended, started = vocabularies
    with open(ended, encoding="utf-8") as f:
        words = {w[: -len("</w>")] for w in json.load(f)["model"]["vocab"] if w.endswith("</w>")}
    with open(started, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    words |= {t[1:].decode().lower() for t in tokens if t[:1] == b" " and t.isascii()}
    return tuple(sorted(w for w in words if 2 <= len(w) <= 14 and w.isascii() and w.isalpha()))


def ordinary_name(rng: random.Random, words: tuple[str, ...]) -> str:
    """Words as names have them, often with a number, a version, a date or a code of few characters."""
    parts = rng.choices(words, k=rng.randint(2, 6))
    way = rng.randrange(8)
    if rng.random() < 0.35:
        day = f"{rng.randint(1990, 2039)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        clock = f"{rng.randint(0, 23):02}-{rng.randint(0, 59):02}-{rng.randint(0, 59):02}"
        extra = [str(rng.randint(0, 99)), f"v{rng.randint(0, 20)}", f"{rng.randint(0, 9)}_{rng.randint(0, 30)}", day, f"{day}T{clock}", day.replace("-", ""), str(rng.randint(0, 10**7)), f"x{rng.choice((32, 64, 86))}", f"{rng.choice('abcdefpst')}{rng.randint(0, 999)}"]
        parts.insert(rng.randint(0, len(parts)), rng.choice(extra))
    if way == 0:
        return parts[0] + "".join(w.capitalize() for w in parts[1:])
    if way == 1:
        return "".join(w.capitalize() for w in parts)
    if way == 2:
        return "_".join(parts).upper()
    if way == 3:
        return "".join(parts)
    if way == 4:
        return "-".join(w.capitalize() for w in parts)
    return ("_", "-", "/")[way - 5].join(parts)


def labelled_samples(seed: int = 7, each: int = 3000, ordinary: int = 40_000) -> list[tuple[str, str]]:
    """(string, label) with label ordinary or a style of random string; the same for the same seed."""
    rng, out = random.Random(seed), []
    for style, letters in STYLES.items():
        out += [("".join(rng.choices(letters, k=rng.randint(20, 64))), style) for _ in range(each)]
    words = ordinary_words()
    return out + [(ordinary_name(rng, words), "ordinary") for _ in range(ordinary)]


class MarkovScanner:
    """Bigram models with additive smoothing; score() is the best random model's log-likelihood less the ordinary one's."""

    def __init__(self, samples: Iterable[tuple[str, str]] | None = None, margin: float = MARGIN, smoothing: float = 0.5):
        counts: dict[str, dict[str, float]] = {}
        for text, label in labelled_samples() if samples is None else samples:
            own = counts.setdefault(label, {})
            for a, b in zip("^" + text, text):
                own[a + b] = own.get(a + b, 0) + 1
        if "ordinary" not in counts or len(counts) < 2:
            raise ValueError("samples of ordinary and of random strings are needed")
        logs = {}
        for label, own in counts.items():
            totals: dict[str, float] = {}
            for pair, n in own.items():
                totals[pair[0]] = totals.get(pair[0], 0) + n
            logs[label] = {a + b: math.log((own.get(a + b, 0) + smoothing) / (totals.get(a, 0) + smoothing * len(ALPHABET))) for a in "^" + ALPHABET for b in ALPHABET}
        base = logs.pop("ordinary")
        self.margin, self.tables = margin, [{pair: x - base[pair] for pair, x in own.items()} for own in logs.values()]

    def score(self, text: str) -> float:
        pairs = [a + b for a, b in zip("^" + text, text)]
        return max(sum(map(t.__getitem__, pairs)) for t in self.tables)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in CANDIDATE.finditer(text) if self.score(m[0]) > self.margin and not UUID.fullmatch(m[0])]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return in_order(found)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(text: str | None, scanner: MarkovScanner) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: those of the models are added where they overlap no base span."""
    base, added, at, reach = base_spans(text or ""), [], 0, 0
    for start, end in scanner.spans(text or ""):
        # reach is the end of the base spans that start before this one ends.
        while at < len(base) and base[at][1] < end:
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= start:
            added.append(("markov", start, end))
    return base, in_order(base + added)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """text with every stretch that spans cover replaced by one mark."""
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: list[tuple[str, str]] | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, base_spans, spans (arrays of kind, start, end in code points) and redacted text for every row; columns named in carry come before them.

    Null text counts as empty and stays null when redacted. Ids may be null or repeated; columns that are not carried are
    dropped. samples replace the built-in labelled samples.
    """
    import pyarrow as pa

    carry = carry or []
    names = [*carry, "doc_id", "base_spans", "spans", "redacted"]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        scanner = MarkovScanner(samples) if samples is not None else worker_cache("secrets", MarkovScanner)
        for batch in batches:
            base, every, clean = [], [], []
            for text in batch.column(len(carry) + 1).to_pylist():
                b, e = find_secrets(text, scanner)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in b])
                every.append([dict(zip(("kind", "start", "end"), s)) for s in e])
                clean.append(redacted(text, e))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry) + 1], pa.array(base, span), pa.array(every, span), pa.array(clean, pa.string())], names)

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    ddl = carried(df, carry, names[len(carry) :])
    return df.select(*carry, F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(run), f"{ddl}doc_id {dict(df.dtypes)[id_col]}, base_spans {spans}, spans {spans}, redacted string")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from secret_scan()."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(F.col("base_spans")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
