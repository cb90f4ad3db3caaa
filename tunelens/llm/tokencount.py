"""Token counts of a document's sections or fields by offset-mapped attribution.

A document is encoded once, as a whole, so its counts add up to the tokens a model sees. Each token covers a span of
characters; a sorted interval join places the spans on the sections, and a stated rule decides where a token that
crosses a border counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.llm.encoding import batches, encoder

#: ``start``: the section of the token's first character. ``end``: that of its last. ``most``: the section with most of
#: its characters, the earliest among equals.
RULES = ("start", "end", "most")
#: A section is a line with its line break.
LINES = r"[^\n]*\n|[^\n]+"
SCHEMA = "doc_id bigint, section bigint, first_char bigint, end_char bigint, n_tokens bigint, n_crossing bigint"


def place(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For token spans [first, last) and consecutive sections that start at ``starts`` and end at ``ends``: each
    token's section under ``rule``, and whether it crosses a border."""
    low = np.searchsorted(starts, first, "right") - 1
    high = np.maximum(low, np.searchsorted(starts, np.maximum(last - 1, first), "right") - 1)
    crossing = high > low
    if rule == "start":
        return low, crossing
    if rule == "end":
        return high, crossing
    chosen = low.copy()
    for i in np.flatnonzero(crossing).tolist():
        inside = np.arange(low[i], high[i] + 1)
        shared = np.minimum(ends[inside], last[i]) - np.maximum(starts[inside], first[i])
        chosen[i] = low[i] + int(np.argmax(shared))
    return chosen, crossing


def section_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", sections: str = LINES,
                   rule: str = "most") -> DataFrame:
    """One row per section of every document: doc_id, section (from 0), first_char, end_char, n_tokens, n_crossing
    (tokens counted here that also cover another section).

    ``sections`` is a pattern whose matches, in a row, cover the text. A null or empty text has one empty section with
    no tokens. Rows that repeat a doc_id give their sections again; a null doc_id stays null. No shuffle, one document
    at a time in a task; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    pattern = re.compile(sections)

    def spans(text: str) -> tuple[np.ndarray, np.ndarray]:
        ends = np.array([m.end() for m in pattern.finditer(text)] or [0], np.int64)
        return np.append(0, ends[:-1]), ends

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, spans=True)
        for batch, texts in batches(rows):
            _, token_ends, first, last = coder.encode(texts)
            yield _record(batch.column("doc_id").to_pylist(), [spans(t) for t in texts], token_ends, first, last, rule)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def field_counts(docs: DataFrame, fields: list[str], separator: str = "\n", vocabulary: str = "byte_bpe_50k.json",
                 rule: str = "most") -> DataFrame:
    """Like ``section_counts`` for the columns ``fields``, joined by ``separator`` and encoded as one text; ``section``
    is the field's place in the list. Null fields are empty; a separator belongs to the field before it."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    lengths = [F.length(v) + (len(separator) if i + 1 < len(values) else 0) for i, v in enumerate(values)]
    rows = docs.select("doc_id", F.concat_ws(separator, *values).alias("text"), F.array(*lengths).alias("sizes"))
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, spans=True)
        for batch, texts in batches(batches_in):
            _, token_ends, first, last = coder.encode(texts)
            ends = [np.cumsum(s) for s in batch.column("sizes").to_pylist()]
            spans = [(np.append(0, e[:-1]), e) for e in ends]
            yield _record(batch.column("doc_id").to_pylist(), spans, token_ends, first, last, rule)

    return rows.mapInArrow(run, SCHEMA)


def _record(ids: list, spans: list, token_ends: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> pa.RecordBatch:
    docs, numbers, starts_out, ends_out, counts, crossed = [], [], [], [], [], []
    at = 0
    for doc, (starts, ends), token_end in zip(ids, spans, token_ends.tolist()):
        where, crossing = place(first[at:token_end], last[at:token_end], starts, ends, rule)
        at = token_end
        n = len(starts)
        docs += [doc] * n
        numbers.append(np.arange(n))
        starts_out.append(starts)
        ends_out.append(ends)
        counts.append(np.bincount(where, minlength=n))
        crossed.append(np.bincount(where[crossing], minlength=n))
    numeric = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, starts_out, ends_out, counts, crossed)]
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64())] + [pa.array(x.astype(np.int64)) for x in numeric],
        ["doc_id", "section", "first_char", "end_char", "n_tokens", "n_crossing"])
