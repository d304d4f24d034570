"""Op 1: token counts by section, through character offsets.

A document is encoded once and whole; the character span of every token is
then joined to the sections' character intervals.  Both lists are sorted, so
the join is two binary searches per token.  A token that touches several
sections goes by an explicit rule:

* ``largest``: to the section it shares most characters with, ties to the
  earlier one (every token counts once);
* ``start``: to the first section it touches;
* ``split``: to all of them in proportion to the shared characters.

Sections must not overlap.  A token that touches none is not counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, public_vocabulary, text_or_empty
from .text_encoding import OUTPUT_CHARS, encoder, grouped

RULES = ("largest", "start", "split")
# Default sections: lines, cut where they are longer than this many characters.
SECTION_CHARS = 1000


def line_sections(text: str, longest: int = SECTION_CHARS) -> list[tuple[int, int]]:
    """Lines (with their line end) as spans, longer ones cut every ``longest`` characters.

    An empty text has one empty section.
    """
    out, start = [], 0
    while start < len(text):
        at = text.find("\n", start)
        end = len(text) if at < 0 else at + 1
        out.extend((s, min(s + longest, end)) for s in range(start, end, longest))
        start = end
    return out or [(0, 0)]


def attribute(tokens: np.ndarray, sections: Sequence[tuple[int, int]],
              rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, of these crossing ones) per section, in the order given."""
    spans = np.asarray(sections, dtype=np.int64).reshape(-1, 2)
    order = np.argsort(spans[:, 0], kind="stable")
    # Empty sections hold no character and never own a token.
    order = order[spans[order, 1] > spans[order, 0]]
    lo, hi = spans[order, 0], spans[order, 1]
    count = np.zeros(len(spans))
    crossing = np.zeros(len(spans), dtype=np.int64)
    if not len(order) or not len(tokens):
        return count, crossing
    start, end = tokens[:, 0], np.maximum(tokens[:, 1], tokens[:, 0] + 1)
    first = np.searchsorted(hi, start, side="right")
    last = np.searchsorted(lo, end, side="left") - 1
    one = first == last
    np.add.at(count, order[first[one]], 1)
    for s, e, a, b in zip(*(x[first < last].tolist() for x in (start, end, first, last))):
        touched = np.arange(a, b + 1)
        shared = np.minimum(hi[touched], e) - np.maximum(lo[touched], s)
        if rule == "split":
            count[order[touched]] += shared / shared.sum()
            crossing[order[touched]] += 1
        else:
            own = order[a if rule == "start" else a + int(np.argmax(shared))]
            count[own] += 1
            crossing[own] += 1
    return count, crossing


def _count(batches: Iterator[pa.RecordBatch], path: str, rule: str,
           given: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, offsets=True)
    whole = pa.float64() if rule == "split" else pa.int64()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        spans = batch.column(2).to_pylist() if given else None
        for a, b in grouped(texts):
            tokens = enc.spans(texts[a:b])
            for c, d in grouped(texts[a:b], OUTPUT_CHARS):
                sections = ([[(s["start"], s["end"]) for s in (x or [])] for x in spans[a + c:a + d]]
                            if given else [line_sections(t) for t in texts[a + c:a + d]])
                counted = [attribute(t, s, rule) for t, s in zip(islice(tokens, d - c), sections)]
                n = np.array([len(s) for s in sections])
                if not n.sum():
                    continue
                flat = np.concatenate([np.asarray(s, dtype=np.int64).reshape(-1, 2) for s in sections])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a + c, d - c).take(pa.array(np.repeat(np.arange(d - c), n))),
                    pa.array(np.concatenate([np.arange(k) for k in n]), pa.int32()),
                    pa.array(flat[:, 0]), pa.array(flat[:, 1]),
                    pa.array(np.concatenate([x for x, _ in counted])).cast(whole),
                    pa.array(np.concatenate([x for _, x in counted]))],
                    names=["doc", "section", "start", "end", "n_tokens", "n_crossing"])


def section_token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                         sections: str | None = None, vocabulary: str | None = None,
                         rule: str = "largest") -> DataFrame:
    """One row per section: ``doc_id, section, start, end, n_tokens, n_crossing``.

    ``sections`` names an ``array<struct<start:int,end:int>>`` column; without
    it the sections are :func:`line_sections`.  Null and empty texts give one
    empty section without tokens; a null array gives no rows.  Other columns
    are ignored, repeated rows are counted each, a null id stays null.
    Documents are independent of each other: there is no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or public_vocabulary("byte_bpe_50k.json")
    cols = [F.col(doc_id).alias("doc"), text_or_empty(text).alias("text")]
    if sections:
        cols.append(F.col(sections).alias("sections"))
    kind = docs.schema[doc_id].dataType.simpleString()
    count = "double" if rule == "split" else "bigint"
    out = docs.select(*cols).mapInArrow(
        on_workers(_count, path, rule, bool(sections)),
        f"doc {kind}, section int, start bigint, end bigint, n_tokens {count}, n_crossing bigint")
    return out.withColumnRenamed("doc", doc_id)
