"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

The models are learned from character 4-grams counted over all training rows. A gram is its four
characters, 16 bits each (others than the basic plane folded). All languages share one sorted array of
hashes for each order, whose rows hold the interpolated log probabilities of every language, so that a
position costs one search; positions with unseen grams back off by the next array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm._kernel import U64, mix
from seriesloom.llm._store import Scratch

ORDER = 4
PAD = 1
#: Where letters go that would fold to 32 or less: no letter of the basic plane is there.
PRIVATE = 0xE000
CHUNK_CHARS = 1 << 19
#: The discount where too few grams are seen once or twice to estimate it.
DISCOUNT = 0.75
#: Most training documents, by hash order, that give the first estimates about which all are counted.
CALIBRATION_DOCS = 4096
LENGTH_BINS = (50, 500)
TEMPERATURES = np.geomspace(0.05, 20, 25)
#: A limit is the cross-entropy that this share of a language's own texts of a length is at or below, of so many at least.
LIMIT, LEAST = 0.995, 20
#: Cells a nat in which all training rows are counted, and most of them to either side of a first estimate.
CELLS, SIDE = 4096, 1 << 15
#: Log likelihoods are added as whole numbers, so that reruns agree.
GAIN = 2.0**36
_cache: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if "letters" not in _cache:
        _cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _cache["letters"]


def char_streams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as 16-bit characters: (first, after last, characters, bounds of each text).

    Texts are lower-cased, each run of other characters than letters becomes one space, and pads
    stand before each text so that no context reaches over.
    """
    letters = _letters()
    lo, n = 0, len(texts)
    while lo < n:
        hi, size, parts = lo, 0, []
        while hi < n and (size < CHUNK_CHARS or hi == lo):
            part = (texts[hi] or "").lower()
            parts.append(part)
            size += len(part)
            hi += 1
        gap = "\n" * (ORDER - 1)
        points = np.frombuffer((gap + gap.join(parts)).encode("utf-32-le", "replace"), np.uint32)
        lengths = np.array([len(x) for x in parts], np.int64)
        ends = np.cumsum(lengths + ORDER - 1)
        solid = letters[points]
        keep = solid.copy()
        keep[1:] |= solid[:-1]  # the first of a run of others stays, as a space
        folded = (points & 0xFFFF) ^ (points >> 16)
        folded |= (folded <= 32) * np.uint32(PRIVATE)  # a letter is neither pad nor space
        chars = np.where(solid, folded, 32).astype(np.uint16)
        for k in range(ORDER - 1):
            at = ends - lengths - 1 - k
            keep[at], chars[at] = True, PAD
        places = np.concatenate(([0], np.cumsum(keep)))
        yield lo, hi, chars[keep], np.stack([places[ends - lengths], places[ends]])
        lo = hi


def grams(chars: np.ndarray) -> np.ndarray:
    """The packed 4-gram that ends at each position from the fourth."""
    c = chars.astype(U64)
    return (c[:-3] << U64(48)) | (c[1:-2] << U64(32)) | (c[2:-1] << U64(16)) | c[3:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of ``(lang, text)`` rows with their counts in this task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(counts, first)

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            texts = batch.column(1).filter(pa.array(langs == lang)).to_pylist()
            for _, _, chars, _ in char_streams(texts):
                if len(chars) >= ORDER:
                    found = grams(chars)
                    found = found[chars[3:] != PAD]
                    if len(found):
                        parts = held.setdefault(lang, [])
                        parts.append(np.unique(found, return_counts=True))
                        if len(parts) >= 16:
                            held[lang] = [merged(parts)]
    for lang, parts in held.items():
        keys, counts = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def count_grams(training: DataFrame) -> DataFrame:
    """Counts ``lang, gram, n`` of all grams over all rows of ``training(lang, text)``."""
    return training.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class HashArray:
    """Sorted 64-bit hashes with a row of values each, found by their leading bits and a short scan."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix(keys + U64(1))
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = U64(64 - bits)
        starts = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=U64) << self.shift)
        self.starts = np.append(starts, len(keys)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.hashes):
            return out
        hashes = mix(keys + U64(1))
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        todo = np.flatnonzero(at < end)
        at, end, hashes = at[todo], end[todo], hashes[todo]
        while len(todo):
            hit = self.hashes[at] == hashes
            out[todo[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            todo, at, end, hashes = todo[more], at[more] + 1, end[more], hashes[more]
        return out


def _grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, weights, len(found))


def discount(n: np.ndarray) -> float:
    """The absolute discount of one order of a language: n1 / (n1 + 2 n2) of its grams counted once and twice."""
    once, twice = float(np.count_nonzero(n == 1)), float(np.count_nonzero(n == 2))
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once and twice else DISCOUNT


def _suffix_mask(n: int) -> np.uint64:
    return U64((1 << (16 * n)) - 1)


class LanguageModels:
    """Interpolated Kneser-Ney models of all languages.

    ``tables[n]`` has log probabilities of seen n-grams, ``backoff[n]`` the log weights that contexts of
    n-grams leave to the next order. An unseen context leaves all.
    """

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        many = len(self.langs)
        by_order: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang in self.langs:
            part = counts[counts["lang"] == lang]
            keys, n = part["gram"].to_numpy(np.int64).view(U64), part["n"].to_numpy(np.float64)
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            by_order.setdefault(ORDER, []).append((keys, n))
            for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct longer grams with this suffix
                keys, n = _grouped(keys & _suffix_mask(k), np.ones(len(keys)))
                by_order.setdefault(k, []).append((keys, n))
        self.tables: dict[int, HashArray] = {}
        self.backoff: dict[int, HashArray] = {}
        letters = np.unique(np.concatenate([k for k, _ in by_order[1]])) if many else np.zeros(0, U64)
        self.uniform = -np.log(len(letters) + 1.0)
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([x for x, _ in by_order[k]])) if many else np.zeros(0, U64)
            contexts = np.unique(keys >> U64(16))
            logs = np.zeros((len(keys), many), np.float32)
            left = np.zeros((len(contexts), many), np.float32)
            lower = self._log_lower(keys, k)
            for i, (own, n) in enumerate(by_order.get(k, [])):
                own_context, totals = _grouped(own >> U64(16), n)
                _, kinds = _grouped(own >> U64(16), np.ones(len(own)))
                off = discount(n)
                weight = off * kinds / totals
                left[np.searchsorted(contexts, own_context), i] = np.log(weight)
                where = np.searchsorted(own_context, keys >> U64(16))
                known = (where < len(own_context)) & (own_context[np.minimum(where, len(own_context) - 1)] == keys >> U64(16))
                where = np.where(known, where, 0)
                seen = np.zeros(len(keys))
                seen[np.searchsorted(keys, own)] = n
                share = np.maximum(seen - off, 0) / totals[where]
                logs[:, i] = np.where(known, np.log(share + weight[where] * np.exp(lower[:, i])), lower[:, i])
            self.tables[k] = HashArray(keys, logs)
            self.backoff[k] = HashArray(contexts, left)
        self.temperature = 1.0
        self.limits = np.full((many, len(LENGTH_BINS) + 1), np.inf)

    def _log_lower(self, keys: np.ndarray, k: int) -> np.ndarray:
        if k == 1:
            return np.full((len(keys), len(self.langs)), self.uniform)
        return self.log_probs(keys & _suffix_mask(k - 1), k - 1).astype(np.float64)

    def log_probs(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log probability of the last character of each packed gram after the others, for each language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.tables[k].find(keys)
            hit = found >= 0
            out[todo[hit]] += self.tables[k].values[found[hit]]
            todo, keys = todo[~hit], keys[~hit]
            if not len(todo):
                break
            context = self.backoff[k].find(keys >> U64(16))
            known = context >= 0
            out[todo[known]] += self.backoff[k].values[context[known]]
            k -= 1
            if not k:
                out[todo] += self.uniform
                break
            keys = keys & _suffix_mask(k)
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character of each text under each language, and the characters scored; nan without a letter."""
        out = np.full((len(texts), len(self.langs)), np.nan)
        sizes = np.zeros(len(texts), np.int64)
        for lo, hi, chars, (starts, ends) in char_streams(texts):
            if len(chars) < ORDER or not self.langs:
                continue
            logs = self.log_probs(grams(chars))
            n = ends - starts
            letters = np.concatenate(([0], np.cumsum(chars > 32)))
            filled = np.flatnonzero((n > 0) & (letters[ends] > letters[starts]))
            if not len(filled):
                continue
            edges = np.stack([starts[filled] - 3, ends[filled] - 3], 1).ravel()
            sums = np.add.reduceat(np.vstack([logs, np.zeros((1, logs.shape[1]), logs.dtype)]), edges, axis=0, dtype=np.float64)[::2]
            out[lo + filled] = -sums / n[filled][:, None]
            sizes[lo + filled] = n[filled]
        return out, sizes

    def posterior(self, entropies: np.ndarray, sizes: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = -entropies * np.sqrt(np.maximum(sizes, 1))[:, None] * (self.temperature if temperature is None else temperature)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gains(self, entropies: np.ndarray, sizes: np.ndarray, own: np.ndarray, temperature: float) -> np.ndarray:
        """Log likelihood of each text's own language."""
        return np.log(np.maximum(self.posterior(entropies, sizes, temperature)[np.arange(len(own)), own], 1e-6))

    def choose_temperature(self, means: list[float]) -> None:
        """Take the first of ``TEMPERATURES`` with the highest mean log likelihood."""
        best = -np.inf
        for temperature, gain in zip(TEMPERATURES, means, strict=True):
            if gain > best + 1e-9:
                best, self.temperature = gain, temperature

    def calibrate(self, entropies: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> None:
        """Temperature by likelihood, and for each language and length the cross-entropy that one in 200 of its own texts exceeds."""
        if not len(own):
            return
        self.choose_temperature([self.gains(entropies, sizes, own, t).mean() for t in TEMPERATURES])
        bins = np.digitize(sizes, LENGTH_BINS)
        for i in range(len(self.langs)):
            for b in range(len(LENGTH_BINS) + 1):
                values = entropies[(own == i) & (bins == b), i]
                if len(values) >= LEAST:
                    self.limits[i, b] = np.quantile(values, LIMIT)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        entropies, sizes = self.cross_entropies(texts)
        known = ~np.isnan(entropies).any(1) if self.langs else np.zeros(len(texts), bool)
        lang = np.full(len(texts), "und", object)
        score, best = np.zeros(len(texts)), np.full(len(texts), np.nan)
        rejected = np.ones(len(texts), bool)
        if known.any():
            e = entropies[known]
            pick = e.argmin(1)
            lang[known] = np.array(self.langs, object)[pick]
            score[known] = self.posterior(e, sizes[known]).max(1)
            best[known] = e.min(1)
            rejected[known] = best[known] > self.limits[pick, np.digitize(sizes[known], LENGTH_BINS)]
        return pd.DataFrame({"lang_pred": lang, "score": score, "cross_entropy": best, "rejected": rejected})


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 4; null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def learn(training: DataFrame, scratch: Scratch) -> LanguageModels:
    """Models of the languages of ``training(doc_id, lang, text)``; rows without a language or text are left out."""
    rows = training.where("lang is not null and text is not null")
    counts = scratch.table(count_grams(rows.select("lang", "text")), "grams").toPandas()
    models = LanguageModels(counts)
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: i for i, x in enumerate(shared.value.langs)}
        for batch in batches:
            entropies, sizes = shared.value.cross_entropies(batch.column(1).to_pylist())
            own = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            ok = ~np.isnan(entropies).any(1)
            rest = [batch.column(i).filter(pa.array(ok)) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(sizes[ok]), pa.array(entropies[ok].tolist(), pa.list_(pa.float64())), *rest], ["own", "size", "entropies", "h", "t"])

    hashed = rows.select("lang", "text", F.xxhash64("doc_id", "lang").alias("h"), F.xxhash64("text").alias("t"))
    measured = scratch.table(hashed.mapInArrow(measure, "own long, size long, entropies array<double>, h long, t long"), "measured")
    last = measured.select("h").orderBy("h").limit(CALIBRATION_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return models
    # rows of one id, or of none, share a hash: the limit holds for them too
    pilot = measured.where(F.col("h") <= last).orderBy("h", "t").limit(CALIBRATION_DOCS).toPandas()
    models.calibrate(np.stack(pilot["entropies"]), pilot["size"].to_numpy(), pilot["own"].to_numpy())
    _calibrate_on_all(models, measured.select("own", "size", "entropies"))
    return models


def _calibrate_on_all(models: LanguageModels, measured: DataFrame) -> None:
    """What ``calibrate`` would find if it held all rows of ``measured(own, size, entropies)`` at once.

    Tasks add up the log likelihood under each temperature. Rows are counted by language, length and cell of
    cross-entropy; only the values of the cell that holds a limit are read, so that the limit is exact. The
    first estimates in ``models`` are where cells begin, and have no part in the result.
    """
    shared = measured.sparkSession.sparkContext.broadcast((models, np.where(np.isfinite(models.limits), models.limits, 0.0)))

    def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        return batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1), sizes, own

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, many = np.zeros(len(TEMPERATURES), np.int64), 0
        for batch in batches:
            if batch.num_rows:
                entropies, sizes, own = parts(batch)
                many += len(own)
                sums += np.array([np.rint(shared.value[0].gains(entropies, sizes, own, t) * GAIN).astype(np.int64).sum() for t in TEMPERATURES])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums), pa.array(np.full(len(sums), many))], ["i", "gain", "n"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                entropies, sizes, own = parts(batch)
                value, band = entropies[np.arange(len(own)), own], np.digitize(sizes, LENGTH_BINS)
                cell = np.clip(np.floor((value - shared.value[1][own, band]) * CELLS), -SIDE, SIDE).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(band), pa.array(cell), pa.array(value)], ["own", "band", "cell", "value"])

    gains = measured.mapInArrow(likelihoods, "i long, gain long, n long").groupBy("i").agg(F.sum(F.col("gain").cast("decimal(38,0)")).alias("gain"), F.sum("n").alias("n")).orderBy("i").collect()
    models.choose_temperature([float(r["gain"]) / GAIN / r["n"] for r in gains])

    dealt = measured.mapInArrow(cells, "own long, band long, cell long, value double")
    group = Window.partitionBy("own", "band")
    counted = dealt.groupBy("own", "band", "cell").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(group)).where(F.col("total") >= LEAST)
    counted = counted.withColumn("below", F.sum("n").over(group.orderBy("cell")) - F.col("n")).withColumn("at", LIMIT * (F.col("total") - 1))
    found = counted.where((F.col("below") <= F.ceil("at")) & (F.col("below") + F.col("n") > F.floor("at"))).select("own", "band", "cell", "total", "below")
    values = dealt.join(F.broadcast(found), ["own", "band", "cell"]).groupBy("own", "band", "total", "below", "value").agg(F.count("*").alias("n")).toPandas()
    models.limits[:] = np.inf
    for (i, b), part in values.sort_values("value").groupby(["own", "band"]):
        at, ends = LIMIT * (part["total"].iloc[0] - 1), part["below"].min() + part["n"].cumsum().to_numpy()
        low, high = (part["value"].to_numpy()[np.searchsorted(ends, k, "right")] for k in (np.floor(at), np.ceil(at)))
        models.limits[i, b] = np.quantile([low, high], at - np.floor(at))


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row for each input row: ``doc_id, held_out, lang_pred, score, cross_entropy, rejected``.

    Learns from rows outside the held-out fold (crc32 of the id modulo 4 is not 2) with a language and
    a text. ``lang_pred`` is the language of the lowest length-normalised cross-entropy, ties to the
    first in code point order; ``und`` with score 0 for a text that is null or has no letter, or if
    nothing was learned. ``rejected`` marks texts whose cross-entropy is above what their own
    language's texts have. Rows that repeat are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "langid")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    models = spark.sparkContext.broadcast(learn(docs.where(fold(F.col("doc_id")) != 2), scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = models.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out["lang_pred"], pa.string()), pa.array(out["score"], pa.float64()), pa.array(out["cross_entropy"], pa.float64(), from_pandas=True), pa.array(out["rejected"], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
