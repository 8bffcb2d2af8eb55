"""Secret scans: fixed patterns, and strings that a public tokenizer finds improbable.

Ordinary text takes few tokens; random strings fall apart into pieces of one or two characters. A candidate
(a run of 16 or more letters, digits and ``+/_=-``, or of letters and digits inside of it) whose characters per token stay under
``ratio`` is reported, unless it is a known digest or identifier. Those are hexadecimal strings, UUIDs, ISO dates,
and words and numbers, alone or joined by separators; a run of letters in one case is a word when it has fewer than 20.

Cases: a null text is an empty text without spans; very long texts are scanned whole; repeated rows give a row
each; spans that begin together come in the order of KINDS; a candidate that overlaps a span of the base is not reported;
empty tables give empty results; only the named id and text columns are looked at.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Each keyword holds one of these.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
#: Runs that may hold a digest or a random string.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
PART = re.compile("[A-Za-z0-9]{16,}")
UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
#: Hexadecimal digests, dates, and words and numbers joined by separators. Of a run of letters in one case, only 20 or more can be told from a word.
KNOWN = re.compile(r"[0-9a-f]+|[0-9A-F]+|\d{4}-\d\d-\d\d[T_-]?\d*|(?:{w})(?:[_/=+-]+(?:{w}))*=*".replace("{w}", r"\d*(?:[A-Z]?[a-z]{1,18}|[A-Z]{1,19})\d*|\d+"))
RATIO = 1.9
VOCABULARY = "byte_bpe_50k.tiktoken"

#: How files of the public vocabularies are found; a parameter, as they are not part of this repository.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(s: str) -> bool:
    return bool(KNOWN.fullmatch(s) or UUID.fullmatch(s))


def spans_of(text: str, encode, ratio: float = RATIO) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the order of KINDS."""
    found: list[tuple[str, int, int]] = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = list(CANDIDATE.finditer(text))
    found += [("hex", m.start() + h.start(), m.start() + h.end()) for m in runs for h in HEX.finditer(m[0])]
    base = sorted((a, b) for _, a, b in found)
    begins, ends = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for m in runs:
        # The run and, if it is none, its parts, so that a name before a random string doesn't hide it.
        for part in [m, *PART.finditer(text, m.start(), m.end())]:
            a, b = part.span()
            k = bisect_left(begins, b)
            if k and ends[k - 1] > a:
                continue  # the base has it
            if is_random(part[0], encode, ratio):
                found.append(("random", a, b))
                if part is m:
                    break
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def is_random(s: str, encode, ratio: float) -> bool:
    return not is_known(s) and len(s) < ratio * len(encode(s))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """One row per document: its id and ``spans``, an array of (kind, start, end)."""
    bound_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path(VOCABULARY)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end"), x)) for x in spans_of(t or "", encode, ratio)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, SPANS)], names=["id", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", doc_id)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by a marker of the first one's kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars", vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """The documents with their secrets replaced; ``length``, where there is such a column, follows the text. No row is lost."""
    bound_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            old = b.column(text).to_pylist()
            new = [t and (redacted(t, s) if (s := spans_of(t, encode, ratio)) else t) for t in old]
            columns = {n: b.column(n) for n in b.schema.names} | {text: pa.array(new, pa.string())}
            if length in columns:
                columns[length] = pa.array([len(y) if y != x else n for x, y, n in zip(old, new, columns[length].to_pylist())], columns[length].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, docs.schema)
