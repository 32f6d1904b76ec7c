"""Secrets in whole texts: stated patterns, and random strings by token efficiency.

A string that a vocabulary trained on ordinary text cuts into very short tokens is likely random.
Long runs of key characters with letters and digits are cut by a tiktoken vocabulary; those below
``RATIO`` characters a token (random base-64 has about 1.7 to 2.1, joined words 3 and more) are spans
of kind ``token``, unless they are known digests (hex of a
digest's length), UUIDs, or identifiers made of words and short numbers, or a stated span covers
them already.

Defined cases: a null or empty text has no spans and the digest of the empty string; repeated
rows are scanned each; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm import storage
from rillmark.llm.tokens import vocabulary_path

KINDS = ("assign", "access", "hex", "token")
VOCABULARY = "byte_bpe_50k.tiktoken"
RATIO = 2.2
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The same spans as those of [0-9a-f]+ that are long enough: a run is taken whole.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_PARTS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")

Span = tuple[int, int, int]


@lru_cache(maxsize=2)
def vocabulary(name: str) -> tiktoken.Encoding:
    with open(vocabulary_path(name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def stated_spans(text: str) -> list[Span]:
    """(start, kind, end) of what the three stated patterns match."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def is_identifier(run: str) -> bool:
    """Words (of one case, or capitalised) and numbers, with marks between and after them; no letter stands alone."""
    parts = _PARTS.findall(run)
    for part, following in zip(parts, [*parts[1:], ""], strict=True):
        if len(part) == 1 and (part.islower() or part.isupper() and not following[:1].islower()):
            return False
    return bool(parts) and parts[0].isalnum()


def is_known(run: str) -> bool:
    """Digests, UUIDs and identifiers made of words and numbers."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run) and len(run) in DIGEST_LENGTHS or _UUID.fullmatch(run):
        return True
    parts = re.findall(r"[A-Za-z]+|[0-9]+", run)
    return len(run) >= 4 * max(1, len(parts)) and is_identifier(run)


def random_spans(text: str, encoding: tiktoken.Encoding, ratio: float = RATIO) -> list[Span]:
    """Runs whose characters a token are fewer than ``ratio``."""
    out = []
    for m in _RUN.finditer(text):
        run = m[0]
        if not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)) or is_known(run):
            continue
        # cut in stretches: a merge never needs more, and a very long run stays linear
        tokens = sum(len(encoding.encode_ordinary(run[i : i + 512])) for i in range(0, len(run), 512))
        if len(run) < ratio * tokens:
            out.append((m.start(), 3, m.end()))
    return out


def outside(spans: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``spans`` that meet none of ``base``; both in order of their starts."""
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))  # spans of two kinds may overlap
    out = []
    for span in spans:
        i = bisect_left(starts, span[2])  # those that begin before its end
        if not i or ends[i - 1] <= span[0]:
            out.append(span)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, name: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token for every row."""
    storage.small_batches(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(name)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base = stated_spans(text or "")
                more = outside(random_spans(text or "", encoding, ratio), base)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                row = (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
