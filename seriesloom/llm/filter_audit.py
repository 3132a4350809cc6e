"""What five quality filters remove in every order in which they can be applied."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm._kernel import span_hashes, spans_equal, text_chunks, word_bounds
from seriesloom.llm._store import Scratch

#: The filters, in the order of their bits.
LETTERS = "ABCDE"
_CAPITAL, _SYMBOL, _LEAD = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_CAPITAL[65:91] = True
_SYMBOL[list(b"#$%&*|")] = True
_LEAD[0x80:0xC0] = False


def _per_row(member: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bytes of each row are of a class: a difference of prefix sums."""
    sums = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(member[raw], out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_row: np.ndarray) -> np.ndarray:
    """Distinct words of each row: sorted hashes, where neighbours of one hash must be the same bytes."""
    hashes = span_hashes(raw, starts, ends, lower=False)
    row = np.repeat(np.arange(len(of_row) - 1), np.diff(of_row))
    order = np.lexsort((hashes, row))
    a, b = order[:-1], order[1:]
    alike = (hashes[a] == hashes[b]) & (row[a] == row[b])
    a, b = a[alike], b[alike]
    repeats = np.bincount(row[b], minlength=len(of_row) - 1)
    size = ends - starts
    true = size[a] == size[b]
    true[true] = spans_equal(raw, starts[a[true]], starts[b[true]], size[a[true]])
    out = np.diff(of_row) - repeats
    for r in np.unique(row[b[~true]]).tolist():  # a hash that stands for two words: count the row's words themselves
        out[r] = len({raw[s:e].tobytes() for s, e in zip(starts[of_row[r] : of_row[r + 1]].tolist(), ends[of_row[r] : of_row[r + 1]].tolist(), strict=True)})
    return out


def text_marks(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row the bits of the filters A to D that it fails."""
    starts, ends, of_row = word_bounds(raw, bounds)
    words = np.diff(of_row)
    fails = [
        words < 100,
        100 * distinct_words(raw, starts, ends, of_row) < 80 * words,
        100 * _per_row(_CAPITAL, raw, bounds) > 10 * _per_row(_LEAD, raw, bounds),
        _per_row(_SYMBOL, raw, bounds) > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, bounds in text_chunks(batch.column("text")):
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            rest = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([rest.column("doc_id"), rest.column("part"), pa.array(text_marks(raw, bounds), pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "marks", "digest"])


def document_marks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, marks``: the bits of the filters that each row of ``documents(doc_id, text, lang)`` fails.

    A (bit 1) has under 100 words, B (2) fewer than 80 distinct words in 100, C (4) over 10 capitals A-Z in 100
    code points, D (8) one of ``#$%&*|``, E (16) the text of a smaller doc_id. Texts leave the scan as bits and
    a SHA-256, whose least id comes from a combined minimum; it is looked up by digest and id together, so that
    the rows of a text with very many copies spread over tasks. Null text is empty, null lang the part ``''``. Rows of one id and one text
    are no copies of each other; a row without an id is a copy of nothing and nothing is a copy of it.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = Scratch(docs.sparkSession, "audit").table(rows.mapInArrow(_scan, f"doc_id {kind}, part string, marks int, digest binary"), "marks")
    first = scanned.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    late = (F.col("doc_id").isNotNull() & F.col("first").isNull()).cast("int")
    return scanned.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("marks") + 16 * late).alias("marks"))


def _steps() -> list[tuple[str, int, int, int]]:
    """All orders and places: the order, the place, the bit of the filter there and the bits of those before."""
    bits = {c: 1 << i for i, c in enumerate(LETTERS)}
    return [("".join(p), i + 1, bits[p[i]], sum(bits[c] for c in p[:i])) for p in permutations(LETTERS) for i in range(len(p))]


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step, with what the step keeps, removes and loses.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``, counts
    of documents of the part. The rows of a part and set of failed filters are counted once; the 120 orders
    are masks over at most 32 such counts a part, so their cost does not grow with the documents. A document
    is good or toxic if any row of ``labels(doc_id, quality, toxic)`` with its id says 1. An empty table
    has no parts and gives no rows.
    """
    said = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("bad"))
    marked = document_marks(docs).join(known, "doc_id", "left")
    cells = marked.groupBy("part", "marks").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))

    fixed = " ".join(":".join(map(str, step)) for step in _steps())  # one literal: 2,400 would take seconds to plan
    steps = cells.withColumn("_s", F.explode(F.split(F.lit(fixed), " ")))
    part = lambda i: F.split_part(F.col("_s"), F.lit(":"), F.lit(i))
    steps = steps.select("part", "marks", "n", "good", "bad", part(1).alias("filter_order"), *[part(i).cast("int").alias(c) for i, c in enumerate(["step", "own", "before"], 2)])
    fails, gone = F.col("marks").bitwiseAND(F.col("own")) > 0, F.col("marks").bitwiseAND(F.col("before")) > 0
    total = lambda when, what="n": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    first_of = F.lit(120) / F.bit_count("marks")  # orders in which a failed filter comes first
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("marks") == F.col("own")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "bad").alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, F.col("n") * first_of)), F.lit(0)).cast("long").alias("shapley"),
    )
