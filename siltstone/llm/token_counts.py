"""Token counts of the sections or fields of documents by offset-mapped attribution.

A document is encoded once, whole.  As the bytes of the tokens are the bytes
of the text, running sums of token lengths are the tokens' spans.  A sorted
interval join (binary search, per slice of documents) maps them to the spans
of the sections.  A token across a boundary goes by an explicit rule:
``majority``, to the section with most of its bytes, the earlier one of equals;
``start``, to the section of its first byte; ``end``, to that of its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import as_strings, raw, slices
from siltstone.llm.tokens import VOCABULARY, encode, encoder

RULES = ("majority", "start", "end")
_SCHEMA = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long"


def owners(token_ends: np.ndarray, token_lengths: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Which section each token belongs to, and whether it crosses a boundary.

    Ends are ascending positions in one buffer that tokens and sections cover.
    """
    begin = token_ends - token_lengths
    first = np.searchsorted(section_ends, begin, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    crossing = first != last
    if rule == "end":
        return last, crossing
    owner = first.copy()
    if rule == "majority":
        for t in np.flatnonzero(crossing).tolist():
            spans = np.arange(first[t], last[t] + 1)
            inside = np.minimum(section_ends[spans], token_ends[t]) - np.maximum(np.concatenate([[0], section_ends])[spans], begin[t])
            owner[t] = spans[int(np.argmax(inside))]
    return owner, crossing


def _attributer(path: str, rule: str, fields: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, token_length = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                strings = as_strings(part.column("text"))
                data, offsets = raw(strings)
                ids, _ = encode(strings.to_pylist(), path)
                if fields:
                    sizes = part.column("sizes")
                    per = np.diff(sizes.offsets.to_numpy())
                    section_ends = np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                else:
                    breaks = np.flatnonzero(data == 10) + 1
                    section_ends = np.union1d(breaks, offsets[1:])
                    section_ends = section_ends[section_ends > 0]
                    per = np.diff(np.searchsorted(section_ends, offsets, "right"))
                if not len(section_ends):
                    continue
                doc = np.repeat(np.arange(part.num_rows), per)
                lengths = token_length[ids]
                owner, crossing = owners(np.cumsum(lengths), lengths, section_ends, rule)
                n = len(section_ends)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                begin = np.concatenate([[0], section_ends[:-1]])
                base = lead[offsets[:-1]][doc]
                number = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(lead[begin] - base), pa.array(lead[section_ends] - base),
                        pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(owner[crossing], minlength=n)),
                    ],
                    ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"],
                )

    return run


def section_tokens(docs: DataFrame, rule: str = "majority", vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts by line: (doc_id, section, char_start, char_end, n_tokens, n_crossing).

    A section is a line with its line break; sections are numbered from 0 and
    their spans cover the text.  ``n_crossing`` counts those of ``n_tokens``
    that cross a boundary.  A document's counts add up to the tokens of its
    whole text.  Null and empty texts have no section; repeated rows and null
    ids are counted as any other; other columns are ignored.  One scan, no
    shuffle; only the id and the text are read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_attributer(vocabulary, rule, False), _SCHEMA)


def field_tokens(docs: DataFrame, fields: list[str], rule: str = "majority", vocabulary: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """Token counts by field of documents that are their fields, one after the other, each ended by a line break.

    As :func:`section_tokens`; a section is a field, a null one as empty, with
    the line break after it.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    parts = [F.concat(F.coalesce(F.col(f), F.lit("")), F.lit("\n")) for f in fields]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat(*parts).alias("text"), F.array(*(F.octet_length(p) for p in parts)).alias("sizes"))
    return own.mapInArrow(_attributer(vocabulary, rule, True), _SCHEMA)
