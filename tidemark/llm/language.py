"""Language identification with interpolated Kneser-Ney character models.

Training counts, over all training text, the four-character grams of each language's words (with start marks and an
end mark, so a gram never crosses words). From these counts come the Kneser-Ney tables: the highest order discounts
counts, lower orders discount the number of different characters that stand before a gram, and what a context loses
by discounting goes to the next lower order. Each order's probabilities and back-off weights are kept as arrays in
the order of a 64-bit hash of the gram. A text's cross-entropy is its words' summed log-probabilities over its
characters; the language with the lowest one wins. A temperature, fitted on training texts, turns the differences to
a score, and a text whose best cross-entropy is above what training texts of that language reach is rejected.

All grams of the training text count: the tables of each order are DataFrames in the shared folder. While they have at
most ``MEMORY_ROWS`` rows together, tasks get them as sorted hash arrays. Beyond that, tasks get the log-probabilities
of the ``HOT_GRAMS`` most frequent grams, and a text's other grams are joined with the tables; results are the same. So
what is kept in memory is bounded and no gram is left out. The calibration reads about ``CALIBRATION`` training texts of
each language, a tenth at most, which are chosen by a hash of their rows and not counted; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, word_lists, written

ORDER, MEMORY_ROWS, HOT_GRAMS, CALIBRATION, DISCOUNT = 4, 2_000_000, 20_000, 500, 0.75
START, END = "\x02", "\x03"
#: A model array's largest log-probability that stands for "never seen": a uniform share of this many characters.
ALPHABET = 10_000
#: Characters of a text that the calibration reads at most to be a training example of it.
LONGEST = 30_000


def positions(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each with start marks and an end mark: (grams as rows of ORDER code points, word of each)."""
    points = np.frombuffer("".join(START * (ORDER - 1) + w + END for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + ORDER)
    word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    grams = np.lib.stride_tricks.sliding_window_view(points, ORDER) if len(points) >= ORDER else np.zeros((0, ORDER), np.uint32)
    inside = word[: len(grams)] == word[ORDER - 1 :] if len(grams) else np.zeros(0, bool)
    return grams[inside], word[: len(grams)][inside]


def gram_hash(grams: np.ndarray) -> np.ndarray:
    out = np.full(len(grams), grams.shape[1], np.uint64)
    for j in range(grams.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + grams[:, j].astype(np.uint64))
    return out


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(first word of each text, and the end), the number of each word's lower-cased form, those forms."""
    first, words = word_lists(texts)
    coded = words.dictionary_encode()
    lower = pc.utf8_lower(coded.dictionary.cast(pa.string())).dictionary_encode()
    number = lower.indices.to_numpy()[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    return first, number, lower.dictionary.to_pylist()


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all texts of ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for lang in part["lang"].unique().to_pylist():
                    _, number, words = distinct_words(part.filter(pc.equal(part["lang"], lang))["text"])
                    grams, word = positions(words)
                    _, first, inverse = np.unique(gram_hash(grams), return_index=True, return_inverse=True)
                    n = np.bincount(inverse, weights=np.bincount(number, minlength=len(words))[word], minlength=len(first))
                    names = ["".join(map(chr, g)) for g in grams[first].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(n.astype(np.int64), pa.int64())], names=["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """The tables in memory; ``Tables`` is the same for any number of grams."""

    langs: list[str]
    #: For each language and order: (hashes in order, log-probabilities), and (hashes of contexts, log back-off weights).
    grams: list[list[tuple[np.ndarray, np.ndarray]]]
    contexts: list[list[tuple[np.ndarray, np.ndarray]]]

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of each gram's last character after the others, for each language."""
        parts = [np.ascontiguousarray(grams[:, ORDER - k :]) for k in range(1, ORDER + 1)]
        hashes, before = [gram_hash(x) for x in parts], [gram_hash(x[:, :-1]) for x in parts]
        out = np.empty((len(grams), len(self.langs)))
        for i in range(len(self.langs)):
            value = np.full(len(grams), -np.log(ALPHABET)) + _find(self.contexts[i][0], before[0], 0.0)
            for k in range(ORDER):
                if k:
                    value = value + _find(self.contexts[i][k], before[k], 0.0)
                seen = _find(self.grams[i][k], hashes[k], np.nan)
                value = np.where(np.isnan(seen), value, seen)
            out[:, i] = value
        return out


def _find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, missing: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(hashes), missing)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, values[at], missing)


def entropies(texts: pa.Array, model: Model, known: dict) -> np.ndarray:
    """Cross-entropy per character of each text in each language; 0 without words. known: log-probabilities of grams seen before."""
    first, number, words = distinct_words(texts)
    if not len(number):
        return np.zeros((len(texts), len(model.langs)))
    grams, word = positions(words)
    hashes, at, inverse = np.unique(gram_hash(grams), return_index=True, return_inverse=True)
    if len(known.get("hashes", ())) > 300_000:
        known.clear()
    if known:
        place = np.minimum(np.searchsorted(known["hashes"], hashes), len(known["hashes"]) - 1)
        new = known["hashes"][place] != hashes
    else:
        known |= {"hashes": np.zeros(0, np.uint64), "values": np.zeros((0, len(model.langs)))}
        new = np.ones(len(hashes), bool)
    if new.any():
        every = np.concatenate([known["hashes"], hashes[new]])
        order = np.argsort(every)
        known["values"] = np.concatenate([known["values"], model.log_probabilities(grams[at[new]])])[order]
        known["hashes"] = every[order]
    values = known["values"][np.searchsorted(known["hashes"], hashes)]
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    per_word = np.add.reduceat(values[inverse], starts)  # every word has its end mark, so at least one gram
    sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(per_word[number], axis=0)])
    chars = np.concatenate([[0], np.cumsum(np.diff(np.append(starts, len(word)))[number])])
    return -(sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, chars[first[1:]] - chars[first[:-1]])[:, None]


@dataclass
class Tables:
    langs: list[str]
    #: For each order: (lang, gram, value) with log-probabilities, and (lang, context, value) with log back-off weights.
    grams: list[DataFrame]
    contexts: list[DataFrame]
    #: Hashes, in order, and log-probabilities in each language of the grams that every task gets.
    hot: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros((0, 0)))
    #: All tables, where they are small enough.
    memory: Model | None = None
    temperature: float = 1.0
    ceilings: list[float] = field(default_factory=list)

    def by_lang(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", "value"))).alias(name))

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """gram, values (an array by language) of distinct grams of the highest order.

        Shorter grams are made distinct first, so no key of a join has more rows than there are characters.
        """
        parts = [grams]
        for k in range(ORDER - 1, 0, -1):
            parts.insert(0, parts[0].select(F.substring("gram", 2, k).alias("gram")).distinct())
        lower = None
        for k, part in enumerate(parts):
            rows = part.select("gram", F.substring("gram", 1, k).alias("context"), F.substring("gram", 2, k).alias("shorter"))
            rows = rows.join(self.by_lang(self.grams[k], "gram", "seen"), "gram", "left").join(self.by_lang(self.contexts[k], "context", "back"), "context", "left")
            if lower is not None:
                rows = rows.join(lower, "shorter")
            below = lambda i: F.lit(-float(np.log(ALPHABET))) if lower is None else F.get("below", i)  # noqa: E731, B023
            each = [F.coalesce(F.try_element_at("seen", F.lit(x)), below(i) + F.coalesce(F.try_element_at("back", F.lit(x)), F.lit(0.0))) for i, x in enumerate(self.langs)]
            found = rows.select("gram", F.array(*each).alias("values"))
            lower = found.select(F.col("gram").alias("shorter"), F.col("values").alias("below"))
        return found


def kneser_ney_tables(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """grams and contexts of ``Tables``, of all languages at once, from lang, gram, n of the highest order."""
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):  # types that continue each shorter gram
        orders.insert(0, orders[0].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")))
    grams, contexts = [], []
    for k, counted in enumerate(orders):
        rows = counted.withColumn("context", F.substring("gram", 1, k))
        weights = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (DISCOUNT * F.count("*") / F.sum("n")).alias("back"))
        rows = rows.join(weights, ["lang", "context"])
        below = F.lit(1 / ALPHABET)
        if k:
            rows = rows.withColumn("shorter", F.substring("gram", 2, k)).join(grams[-1].select("lang", F.col("gram").alias("shorter"), F.exp("value").alias("below")), ["lang", "shorter"])
            below = F.col("below")
        p = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + F.col("back") * below
        grams.append(written(rows.select("lang", "gram", F.log(p).alias("value"))))
        contexts.append(written(weights.select("lang", "context", F.log("back").alias("value"))))
    return grams, contexts


def in_memory(model: Tables) -> Model:
    """The tables as hash arrays."""

    def arrays(table: DataFrame, key: str, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
        rows = table.toPandas()
        points = np.frombuffer("".join(rows[key]).encode("utf-32-le"), np.uint32).reshape(len(rows), width) if width and len(rows) else np.zeros((len(rows), width), np.uint32)
        hashes, values, out = gram_hash(points), rows["value"].to_numpy(np.float64), []
        for lang in model.langs:
            own = np.flatnonzero((rows["lang"] == lang).to_numpy())
            own = own[np.argsort(hashes[own])]
            out.append((hashes[own], values[own]))
        return out

    grams = [arrays(t, "gram", k + 1) for k, t in enumerate(model.grams)]
    contexts = [arrays(t, "context", k) for k, t in enumerate(model.contexts)]
    return Model(model.langs, *([[order[i] for order in orders] for i in range(len(model.langs))] for orders in (grams, contexts)))


def hottest(counts: DataFrame, model: Tables, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and log-probabilities of the ``most`` most frequent grams."""
    often = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "gram").limit(most).select("gram")
    hot = model.log_probabilities(often).toPandas()
    hashes = gram_hash(np.frombuffer("".join(hot["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, ORDER))
    order = np.argsort(hashes)
    return hashes[order], np.array(hot["values"].tolist(), np.float64).reshape(-1, len(model.langs))[order]


def fit(docs: DataFrame, calibration: int = CALIBRATION, memory_rows: int = MEMORY_ROWS, hot_grams: int = HOT_GRAMS) -> Tables:
    """A model of the languages in ``docs`` (doc_id, text, lang); rows without text or lang don't count. No rows: no languages.

    A language's calibration texts have at most ``LONGEST`` characters; longer ones are counted. With fewer than 20 of
    them, nothing of that language is rejected. Repeated rows are counted, or used to calibrate, together.
    """
    usable = docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {row["lang"]: row["n"] for row in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(sizes)
    shares = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(0.1, calibration / sizes[lang])))) if langs else F.create_map()
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    chosen = (turn < F.try_element_at(shares, F.col("lang"))) & F.length("text").between(1, LONGEST) if langs else F.lit(False)
    counts = written(gram_counts(usable.where(~chosen)))
    model = Tables(langs, *kneser_ney_tables(counts), ceilings=[np.inf] * len(langs))
    if not langs:
        return model
    if sum(t.count() for t in model.grams + model.contexts) <= memory_rows:
        model.memory = in_memory(model)
    else:
        model.hot = hottest(counts, model, hot_grams)
    known = cross_entropies(usable.where(chosen).select(F.struct("lang").alias("carry"), "text"), model).select("carry.lang", "entropies").toPandas()
    if not len(known):
        return model
    found = np.array(known["entropies"].tolist(), np.float64).reshape(-1, len(langs))
    truth = known["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    best, fits = -np.inf, found.argmin(1) == truth
    for t in (0.5, 1, 2, 4, 8, 16, 32):
        logits = -found * t
        likelihood = (logits - np.log(np.exp(logits - logits.max(1, keepdims=True)).sum(1, keepdims=True)) - logits.max(1, keepdims=True))[np.arange(len(truth)), truth].sum()
        best, model.temperature = max((best, model.temperature), (likelihood, float(t)))
    for i in range(len(langs)):
        own = found[fits & (truth == i), i]
        if len(own) >= 20:
            model.ceilings[i] = float(own.mean() + 6 * own.std())
    return model


def hot_sums(texts: pa.Array, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each text: characters (with a word's end), summed log-probabilities of grams in ``hot``, and the other grams with their numbers."""
    keys, values = hot
    first, number, words = distinct_words(texts)
    grams, word = positions(words)
    hashes, at, inverse = np.unique(gram_hash(grams), return_index=True, return_inverse=True)
    place = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
    there = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
    weights = np.zeros((len(hashes), values.shape[1]))
    weights[there] = values[place[there]]
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    per_word = np.add.reduceat(weights[inverse], starts) if len(starts) else np.zeros((0, values.shape[1]))
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    sums = np.stack([np.bincount(text, weights=per_word[number, i], minlength=len(texts)) for i in range(values.shape[1])], axis=1)
    length = np.diff(np.append(starts, len(word)))
    chars = np.bincount(text, weights=length[number], minlength=len(texts)).astype(np.int64)
    # grams that are not hot: those of each such word, for each text that has the word
    cold = np.flatnonzero(~there[inverse])
    begin = np.searchsorted(word[cold], np.arange(len(words) + 1))
    many = np.diff(begin)[number]
    which = np.repeat(begin[:-1][number], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    pairs, n = np.unique(np.repeat(text, many) * len(hashes) + inverse[cold[which]], return_counts=True)
    used, code = np.unique(pairs % max(1, len(hashes)), return_inverse=True)
    names = pa.array(["".join(map(chr, g)) for g in grams[at[used]].tolist()], pa.string()).take(pa.array(code))
    ends = np.searchsorted(pairs // max(1, len(hashes)), np.arange(len(texts) + 1))
    others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([names, pa.array(n, pa.int64())], names=["gram", "n"]))
    return chars, sums, others


def cross_entropies(docs: DataFrame, model: Tables) -> DataFrame:
    """carry and entropies, per character in each language, of each row of ``docs`` (carry, text)."""
    langs, carry = len(model.langs), docs.schema["carry"].dataType.simpleString()
    broadcast = docs.sparkSession.sparkContext.broadcast(model.memory or model.hot)  # at most MEMORY_ROWS or HOT_GRAMS rows

    def run_in_memory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found = entropies(part["text"], broadcast.value, known)
                yield pa.RecordBatch.from_arrays([part["carry"], pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * langs, pa.int32()), pa.array(found.ravel()))], names=["carry", "entropies"])

    if model.memory:
        return docs.select("carry", "text").mapInArrow(run_in_memory, f"carry {carry}, entropies array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                chars, sums, others = hot_sums(part["text"], broadcast.value)
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * langs, pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([part["carry"], part["row"], pa.array(chars), sums, others], names=["carry", "row", "chars", "sums", "others"])

    rows = docs.select("carry", "text", F.monotonically_increasing_id().alias("row"))
    # numbers of rows hold only within one run, so its result is kept
    rows = written(rows.mapInArrow(run, f"carry {carry}, row long, chars long, sums array<double>, others array<struct<gram:string,n:long>>"))
    cold = rows.where(F.size("others") > 0).select("row", F.inline("others"))
    values = model.log_probabilities(cold.select("gram").distinct())
    added = cold.join(values, "gram").groupBy("row").agg(F.array(*(F.sum(F.col("n") * F.get("values", F.lit(i))) for i in range(langs))).alias("added"))
    per_char = lambda sums: F.transform(sums, lambda x: -x / F.greatest(F.lit(1), F.col("chars")))
    warm = rows.where(F.size("others") == 0).select("carry", per_char(F.col("sums")).alias("entropies"))
    both = rows.where(F.size("others") > 0).join(added, "row")
    return warm.unionByName(both.select("carry", per_char(F.zip_with("sums", "added", lambda a, b: a + b)).alias("entropies")))


def predict(docs: DataFrame, model: Tables) -> DataFrame:
    """doc_id, lang (the most likely), score (0 to 1), entropy and rejected of each row's whole text.

    Texts that are null or have no letter, and all texts of a model without languages, are ``und`` with score 0, and
    rejected. Ties go to the first language by name. A very long text is scored whole. Only doc_id and text are read.
    Repeated rows give repeated results; an empty table gives none.
    """
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")
    nothing = [F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected")]
    if not model.langs:
        return docs.select(doc_id, *nothing)
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = cross_entropies(docs.select(F.struct(doc_id, letters.alias("letters")).alias("carry"), F.when(letters, text).alias("text")), model)
    best = found.select("carry.*", "entropies", F.array_min("entropies").alias("best")).withColumn("which", F.array_position("entropies", F.col("best")).cast("int"))
    odds = F.aggregate("entropies", F.lit(0.0), lambda a, x: a + F.exp((F.col("best") - x) * model.temperature))
    of_lang = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("which"))
    known: list[Column] = [of_lang(model.langs), 1 / odds, F.col("best"), F.col("best") > of_lang(model.ceilings)]
    return best.select("doc_id", *(F.when(F.col("letters"), value).otherwise(F.lit(default)).alias(name) for value, default, name in zip(known, ("und", 0.0, 0.0, True), ("lang", "score", "entropy", "rejected"), strict=True)))
