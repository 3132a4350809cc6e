"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other parameters has the
same template. Windows of the canonical words of benchmark items are hashed; documents send only windows
whose hash is in a bitmap of fixed size, and a hash join decides. Windows of one occurrence lie on one
diagonal (document position less item position); there every slot of the item must stand for one value
of the document throughout. A window with more slots than literals says little by its template; it is
exact instead: hashed with the values of its slots, it matches only the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import _kernel as K
from seriesloom.llm._bitmap import bitmap
from seriesloom.llm._rows import as_row, text_key
from seriesloom.llm._store import Scratch
from seriesloom.llm.langid import HashArray

WINDOW = 8
COVERAGE = 0.5
BITMAP_BITS = 24
#: Added to the hash of an exact window, with its length.
EXACT = 1 << 32

# Unit words that may follow a number.
UNITS = (
    "kg g mg lb lbs oz ton tons tonne tonnes km m cm mm mi mile miles yard yards ft foot feet inch inches l ml litre litres liter liters gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years percent degrees celsius fahrenheit mph kph "
    "dollar dollars cent cents euro euros pound pounds yen watt watts kw kwh volt volts hz khz mhz ghz kb mb gb tb bytes bits"
).split()

_DIGIT, _LOWER, _UPPER = (np.zeros(256, bool) for _ in range(3))
_DIGIT[0x30:0x3A], _LOWER[0x61:0x7B], _UPPER[0x41:0x5B] = True, True, True
_LETTER = _LOWER | _UPPER
_LETTER[0x80:] = True
_WORDY = _LETTER | _DIGIT
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
NUMBER, NAME, UNIT = K.U64(1), K.U64(2), K.U64(3)


def _unit_table() -> HashArray:
    raw = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    starts = np.concatenate(([0], ends[:-1]))
    keys = np.unique(K.span_hashes(raw, starts, ends))
    return HashArray(keys, np.zeros(len(keys), np.int8))


_units: list[HashArray] = []


def canonical_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical word hashes, slot values (0 for literals), and the first word of each row.

    Words lose outer punctuation; words of nothing else go. A word that starts with a digit is a number,
    a known unit after a number a unit, a capitalised word (with a small letter) that does not open a
    sentence a name. All else is literal, with A-Z lower-cased.
    """
    if not _units:
        _units.append(_unit_table())
    starts, ends, of_row = K.word_bounds(raw, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(of_row))
    solid = np.flatnonzero(_WORDY[raw]) if len(raw) else np.zeros(0, np.int64)
    none = np.zeros(0, K.U64)
    if not len(solid) or not len(starts):
        return none, none, np.zeros(len(bounds), np.int64), none
    at, to = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    keep = at <= to
    stopped = np.concatenate(([True], _STOP[raw[ends - 1]][:-1]))
    opens = stopped | np.concatenate(([True], row[1:] != row[:-1]))
    s, e = solid[np.minimum(at, len(solid) - 1)][keep], solid[to][keep] + 1
    row, opens = row[keep], opens[keep]
    words = K.span_hashes(raw, s, e)
    number = _DIGIT[raw[s]]
    lows = np.concatenate(([0], np.cumsum(_LOWER[raw])))
    name = _UPPER[raw[s]] & (lows[e] > lows[s]) & ~opens
    after = np.concatenate(([False], number[:-1] & (row[1:] == row[:-1]))) if len(s) else number
    unit = after & (_units[0].find(words) >= 0)
    slot = np.where(number | name | unit, words, K.U64(0))
    canon = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, words)))
    return K.mix(canon + K.U64(77)), slot, np.searchsorted(row, np.arange(len(bounds))), row


def _windows(canon: np.ndarray, slot: np.ndarray, lo: int, hi: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``k`` words in words lo..hi, and which of them are exact, by slots in more than half."""
    runs = K.window_hashes(canon[lo:hi], k) + K.U64(k)
    filled = np.concatenate(([0], np.cumsum(slot[lo:hi] != 0)))
    exact = 2 * (filled[k:] - filled[:-k]) > k
    if exact.any():
        runs = np.where(exact, K.window_hashes(_values(canon[lo:hi], slot[lo:hi]), k) + K.U64(EXACT + k), runs)
    return runs, exact


def _values(canon: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """A hash of each word itself, whether it is a slot or not."""
    return np.where(slot != 0, K.mix(slot + K.U64(77)), canon)


def _slots(values: np.ndarray, slot: np.ndarray, at: int, k: int, exact: bool) -> list[int]:
    """Values of the slots of a window; all words of an exact one."""
    part = values[at : at + k]
    return (part if exact else part[slot[at : at + k] != 0]).view(np.int64).tolist()


WINDOW_SCHEMA = "id long, key long, total long, plain long, at long, window long, exact boolean, slots array<long>"
ITEM_SCHEMA = WINDOW_SCHEMA + ", template long"
NAMES = ["id", "key", "total", "plain", "at", "window", "exact", "slots"]


def _item_windows(k: int):
    """All windows of each item, and its template; an item shorter than a window is one window.

    Slot values are numbered as they come in the item: which slots are equal is all that is compared. So
    items that differ in values only have the same template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            ids = batch.column(0).to_pylist()
            for lo, hi, raw, bounds in K.text_chunks(batch.column(1)):
                canon, slot, first, _ = canonical_words(raw, bounds)
                values = _values(canon, slot)
                for i in range(hi - lo):
                    number: dict[int, int] = {}
                    own = []
                    a, b = int(first[i]), int(first[i + 1])
                    size = min(k, b - a)
                    if size:
                        runs, exact = _windows(canon, slot, a, b, size)
                        plain = int((~exact).sum())
                        for j, (window, same) in enumerate(zip(runs.view(np.int64).tolist(), exact.tolist(), strict=True)):
                            slots = [number.setdefault(x, len(number)) for x in _slots(values, slot, a + j, size, same)]
                            own.append((ids[lo + i], size, len(runs), plain, j, window, same, slots))
                        template = xxhash.xxh64_intdigest(repr([x[1:] for x in own])) - (1 << 63)
                        for line in own:
                            for col, value in zip(rows, (*line, template), strict=True):
                                col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows[:6]] + [pa.array(rows[6], pa.bool_()), pa.array(rows[7], pa.list_(pa.int64())), pa.array(rows[8], pa.int64())], [*NAMES, "template"])

    return run


def _document_windows(bitmap, lengths: list[int]):
    """Windows of documents that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(bitmap.value).astype(bool)
        mask = K.U64(len(bits) - 1)
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            who, at, window, same, slots = [], [], [], [], []
            for lo, _, raw, bounds in K.text_chunks(batch.column(2)):
                canon, slot, first, row = canonical_words(raw, bounds)
                values = _values(canon, slot)
                for k in lengths:
                    if len(canon) < k:
                        continue
                    runs, exact = _windows(canon, slot, 0, len(canon), k)
                    fit = row[: len(runs)] == row[k - 1 :]
                    hit = np.flatnonzero(fit & bits[(runs & mask).astype(np.int64)])
                    for j in hit.tolist():
                        who.append(lo + int(row[j]))
                        at.append(j - int(first[row[j]]))
                        slots.append(_slots(values, slot, j, k, bool(exact[j])))
                    window.append(runs[hit].view(np.int64))
                    same.append(exact[hit])
            if who:
                pick = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pick), keys.take(pick), pa.nulls(len(who), pa.int64()), pa.nulls(len(who), pa.int64()), pa.array(at, pa.int64()),
                        pa.array(np.concatenate(window)), pa.array(np.concatenate(same)), pa.array(slots, pa.list_(pa.int64())),
                    ],
                    NAMES,
                )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of documents and benchmark items that they hold: ``doc_id, text_key, item_id, windows, coverage``.

    A pair is given if at least ``coverage`` of the item's windows stand in the document on diagonals
    whose slots are consistent: of all its windows, or of those that are not exact, so that exact windows
    take nothing from an item with other parameters. ``coverage`` is the larger share, ``windows``
    counts all that were met. An item of exact windows only matches its own words only. Null ids of documents are kept as null; items with a null id, and texts
    that are null or have no words, match nothing. Rows that repeat give the pair once. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = scratch.table(items.mapInArrow(_item_windows(window), ITEM_SCHEMA), "items")
    lengths = sorted(r[0] for r in items.select("key").distinct().collect())  # at most ``window`` values
    filled = spark.sparkContext.broadcast(bitmap(items.select("window"), BITMAP_BITS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    found = scratch.table(rows.mapInArrow(_document_windows(filled, lengths), WINDOW_SCHEMA), "windows")

    # joined by template, one of all items that differ in values only; the items come back at the end
    theirs = items.select("window", "template", "total", "plain", "exact", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")).dropDuplicates(["template", "item_at"])
    ours = found.select("window", F.col("id").alias("doc_id"), F.col("key").alias("text_key"), F.col("at").alias("doc_at"), "slots")
    met = ours.join(theirs, "window").withColumn("diagonal", F.col("doc_at") - F.col("item_at"))
    met = met.where(F.size("slots") == F.size("item_slots"))
    one = ["doc_id", "text_key", "template", "diagonal"]
    values = met.where(F.size("slots") > 0).select(*one, F.explode(F.arrays_zip("item_slots", "slots")).alias("z"))
    clash = values.groupBy(*one, F.col("z.item_slots").alias("slot")).agg((F.min("z.slots") != F.max("z.slots")).alias("clash")).where("clash")
    clash = clash.select(*[F.col(c).alias(f"c_{c}") for c in one]).distinct()
    same = [met[c].eqNullSafe(clash[f"c_{c}"]) for c in one]
    sound = met.join(clash, reduce(lambda a, b: a & b, same), "left_anti")
    met_once = sound.select("doc_id", "text_key", "template", "total", "plain", "exact", "item_at").distinct()
    hits = met_once.groupBy("doc_id", "text_key", "template").agg(F.count("*").alias("windows"), F.count_if(~F.col("exact")).alias("loose"), F.max("total").alias("total"), F.max("plain").alias("plain"))
    plain = F.when(F.col("plain") > 0, F.col("loose") / F.col("plain"))
    out = hits.withColumn("coverage", F.greatest(F.col("windows") / F.col("total"), plain)).where(F.col("coverage") >= coverage)
    named = items.select("template", F.col("id").alias("item_id")).distinct()
    return out.join(named, "template").select("doc_id", "text_key", "item_id", "windows", "coverage").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item.

    Rows alike in id and text go or stay together, null ids too. Null and empty texts stay, and all rows
    without benchmark items. No name of a further column clashes with anything here.
    """
    bad = contaminated(docs, benchmark, window, coverage).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("bad_id")) & (text_key(F.col("row.text")) == F.col("bad_key"))
    return as_row(docs).join(bad, same, "left_anti").select("row.*")
