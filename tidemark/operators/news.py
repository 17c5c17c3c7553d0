"""News: selection, deduplication, day tables and the cleaning job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import distinct_on
from ..sources.written import written
from . import asof, segments


def select_news(items: DataFrame, subjects: DataFrame, start: str, end: str, prefix: str, code: str, lang: str = "en", longer_than: int = 300) -> DataFrame:
    """Items of a subject in a time range and language with a long enough body, the newest of each plain headline."""
    wanted = subjects.where(F.col("symbol").like(f"{prefix}%") | (F.col("symbol") == code))
    rows = items.where(F.col("published_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")) & (F.col("lang") == lang) & F.col("text").isNotNull() & (F.length("text") > longer_than))
    joined = rows.join(wanted, "event_id").withColumn("norm", T.plain_headline(F.col("headline")))
    return distinct_on(joined, ("norm",), F.col("published_at").desc(), F.col("event_id"))


def latest_update(items: DataFrame) -> DataFrame:
    """The highest update of each symbol's headline."""
    rows = items.withColumn("norm", T.without_update(F.col("headline"))).withColumn("update_no", T.update_number(F.col("headline")))
    return distinct_on(rows, ("symbol", "norm"), F.col("update_no").desc(), F.col("published_at").desc(), F.col("event_id"))


def _exact_keys(items: DataFrame) -> DataFrame:
    """Adds the cleaned body and what rows are equal by, so that the passes can go without texts."""
    rows = items.withColumn("_cleaned", T.clean_text(F.col("text")))
    return rows.withColumns({"_body": F.md5(T.without_spaces(F.col("text"))), "_head": T.without_spaces(F.col("headline")), "_clean": F.md5("_cleaned")})


def _first_of_equal(rows: DataFrame) -> DataFrame:
    newest, oldest = (F.col("published_at").desc(), F.col("event_id")), (F.col("published_at"), F.col("event_id"))
    rows = distinct_on(distinct_on(rows, ("symbol", "_body"), *newest), ("symbol", "_head"), *newest)
    return distinct_on(rows, ("symbol", "_clean"), *oldest).drop("_body", "_head", "_clean")


def exact_dedup(items: DataFrame) -> DataFrame:
    """Keeps the first of equal bodies and of equal headlines (newest first, spaces ignored), then of equal cleaned bodies (oldest first)."""
    return _first_of_equal(_exact_keys(items).drop("_cleaned"))


def common_length(a: str, b: str, least: float = 0.0) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; or some number below ``least`` if it is below that."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for j, c in enumerate(b):
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
        if j % 64 == 63 and len(a) - row.bit_count() + len(b) - j - 1 < least:  # even if all the rest were common
            return 0
    return len(a) - row.bit_count()


def indel_ratio(a: Column, b: Column, above: float = 0.0) -> Column:
    """Similarity 2 * LCS / total length; 0 where a side is missing. What is found to be under ``above`` may be told as 0."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([2 * common_length(s, t, above * (len(s) + len(t)) / 2 - 1e-6) / (len(s) + len(t)) if s and t else 0.0 for s, t in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(ratio, "double")(a, b)


#: Characters that are counted each on their own; all others are one class.
COUNTED = " etaoinshrdlucmfwypvbgkjqxz"


def character_counts(text: Column) -> Column:
    """How often a text has each of the counted characters, and all others."""
    n = F.length(text)
    own = [n - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in COUNTED]
    return F.array(*own, n - sum(own[1:], own[0]))


def common_at_most(a: Column, b: Column) -> Column:
    """No common subsequence is longer than what two texts have of each class of characters."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def drop_near_previous(items: DataFrame, column: str, ratio: float, keys: tuple[str, ...] = ("symbol",), similarity: Column | None = None, seconds: int = 30 * 86_400) -> DataFrame:
    """Drops a row that is more similar than ``ratio`` to the row before it in time, whether or not that one is dropped.

    A key's rows are taken in spans of so many seconds, each with the last row of those before it, so a key with most of
    the rows is many tasks. Pairs whose lengths, or whose counts of characters, rule it out never reach the similarity
    function. Rows of one time go by event_id. Null texts and times, and first rows, stay.
    """
    rows = items.withColumn("_own", F.struct(F.col(column).alias("text"), character_counts(F.col(column)).alias("counts"))).withColumn("segment", segments.span("published_at", seconds))
    rows = segments.previous(rows, keys, ("published_at", "event_id"), "_own", "_last").withColumn("_before", F.col("_last.text"))
    n, m = F.length(column), F.length("_before")
    may = (2 * F.least(n, m) > ratio * (n + m)) & (F.lit(True) if similarity is not None else 2 * common_at_most(F.col("_own.counts"), F.col("_last.counts")) > ratio * (n + m))
    rows = rows.withColumn("_close", F.coalesce(may, F.lit(False)))
    # other rows pass no text to the function
    own, other = F.when(F.col("_close"), F.col(column)), F.when(F.col("_close"), F.col("_before"))
    alike = indel_ratio(own, other, ratio) if similarity is None else similarity
    return rows.withColumn("_alike", alike).where(~F.col("_close") | (F.coalesce("_alike", F.lit(0.0)) <= ratio)).select(*items.columns)


def _numbered(items: DataFrame) -> DataFrame:
    """The items as a table, each with a number, and with the length and character counts of its text."""
    return written(items.withColumns({"_row": F.monotonically_increasing_id(), "_n": F.length("text"), "_counts": character_counts(F.col("text"))}))


def _drop_near_texts(rows: DataFrame, texts: DataFrame, ratio: float, keys: tuple[str, ...] = ("symbol",), seconds: int = 30 * 86_400) -> DataFrame:
    """``drop_near_previous`` by text for rows of ``texts`` (see ``_numbered``) that come without it.

    Only numbers, lengths and counts are sorted; the texts of pairs that these don't rule out are then looked up. Texts
    are longer than their table's file tells, so they are never broadcast.
    """
    placed = rows.withColumn("_own", F.struct("_row", "_n", "_counts")).withColumn("segment", segments.span("published_at", seconds))
    placed = segments.previous(placed, keys, ("published_at", "event_id"), "_own", "_last")
    n, m = F.col("_n"), F.col("_last._n")
    may = (2 * F.least(n, m) > ratio * (n + m)) & (2 * common_at_most(F.col("_counts"), F.col("_last._counts")) > ratio * (n + m))
    pairs = placed.where(may).select("_row", F.col("_last._row").alias("_other"))
    found = texts.select("_row", "text").hint("merge")  # shuffled once for both sides of a pair
    own = pairs.join(found, "_row").select(F.col("_row").alias("_own"), F.col("text").alias("_text"), F.col("_other").alias("_row"))
    close = own.join(found, "_row").where(indel_ratio(F.col("_text"), F.col("text"), ratio) > ratio)
    return rows.join(close.select(F.col("_own").alias("_row")), "_row", "left_anti")


def _drop_near(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Drops rows near the one before by text, then of those left by headline. Texts are compared once: what is left is written."""
    return drop_near_previous(written(_drop_near_texts(rows.drop("text"), texts, 0.6)), "headline", 0.9)


def drop_near_duplicates(items: DataFrame) -> DataFrame:
    """Drops rows near the one before by text, then of those left by headline."""
    texts = _numbered(items)
    return texts.join(_drop_near(texts, texts).select("_row").hint("merge"), "_row", "left_semi").select(*items.columns)


def levenshtein_similarity(column: str) -> Column:
    """1 - edits / longer length against ``_before``, natively; a substitution is one edit."""
    return 1 - F.levenshtein(column, "_before") / F.greatest(F.length(column), F.length("_before"), F.lit(1))


def ids_by_day(items: DataFrame, date: Column) -> DataFrame:
    """Ids of each (date, symbol) in time order; the texts stay where they are."""
    rows = items.groupBy(date.alias("date"), "symbol").agg(F.array_sort(F.collect_list(F.struct("published_at", "event_id"))).alias("items"))
    return rows.select("date", "symbol", F.transform("items", lambda x: x["event_id"]).alias("ids"))


def by_day(items: DataFrame, date: Column) -> DataFrame:
    """Texts of each (date, symbol) in time order."""
    rows = items.groupBy(date.alias("date"), "symbol").agg(F.array_sort(F.collect_list(F.struct("published_at", "event_id", "text"))).alias("items"))
    return rows.select("date", "symbol", F.transform("items", lambda x: x["event_id"]).alias("ids"), F.transform("items", lambda x: x["text"]).alias("texts"))


def env_panel(bars: DataFrame, items: DataFrame, filings: DataFrame) -> DataFrame:
    """One row for each (date, symbol) with a price: close, news of the day (none: an empty list), the last 10-K and 10-Q of the day."""
    day_news = ids_by_day(items, F.col("published_at").cast("date"))
    last = filings.groupBy(F.col("filing_date").alias("date"), "symbol").agg(
        F.max_by(F.when(F.col("filing_type") == "10-K", F.col("filing_id")), F.struct(F.col("filing_type") == "10-K", "available_at", "filing_id")).alias("filing_k"),
        F.max_by(F.when(F.col("filing_type") == "10-Q", F.col("filing_id")), F.struct(F.col("filing_type") == "10-Q", "available_at", "filing_id")).alias("filing_q"),
    )
    joined = bars.select("date", "symbol", "close").join(day_news, ["date", "symbol"], "left").join(last, ["date", "symbol"], "left")
    return joined.withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def as_maps(panel: DataFrame) -> DataFrame:
    """The day table: one row per date with maps from symbol to price, news and filings."""

    def to_map(column: str, keep: Column) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(keep, F.struct("symbol", column))))).alias(column)

    return panel.groupBy("date").agg(to_map("close", F.lit(True)), to_map("ids", F.size("ids") > 0), to_map("filing_k", F.col("filing_k").isNotNull()), to_map("filing_q", F.col("filing_q").isNotNull()))


def symbol_subset(days: DataFrame, symbol: str) -> DataFrame:
    """A symbol's part of the day table; days whose news lack it are left out."""
    out = days.where(F.map_contains_key("ids", F.lit(symbol)))
    return out.select("date", *(F.try_element_at(c, F.lit(symbol)).alias(c) for c in ("close", "ids", "filing_k", "filing_q")))


def filing_extract(contents: DataFrame, index_k: DataFrame, index_q: DataFrame) -> DataFrame:
    """Content joined with both indexes on its address, rows with nulls dropped, with US Eastern time."""
    index = index_k.unionByName(index_q)
    joined = contents.join(index, "url").dropna("any")
    return joined.withColumn("eastern", F.from_utc_timestamp("available_at", "America/New_York"))


def sentiment(items: DataFrame, lexicon: DataFrame, key: str = "event_id") -> DataFrame:
    """Positive, negative and neutral shares of each text's words by a small lexicon (word, polarity), and three sentences on them.

    Words are counted per text before they meet the lexicon, so a text's repeats are joined once.
    """
    words = items.select(key, F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word != ''")
    counts = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    scored = counts.join(lexicon, "word", "left").groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("polarity") > 0, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("polarity") < 0, F.col("n")).otherwise(0)).alias("m"))
    shares = scored.select(key, (F.col("p") / F.col("n")).alias("positive"), (F.col("m") / F.col("n")).alias("negative"), ((F.col("n") - F.col("p") - F.col("m")) / F.col("n")).alias("neutral"))
    text = F.format_string("The positive score is %.4f. The neutral score is %.4f. The negative score is %.4f.", "positive", "neutral", "negative")
    return shares.withColumn("sentences", text)


def clean_job(items: DataFrame, calendar: DataFrame) -> DataFrame:
    """The whole cleaning of a news feed: updates, datelines, exact and near duplicates, session and trading dates.

    Cleaned texts are written once; the passes take keys of them, and rows meet their texts again at the end.
    """
    texts = _numbered(_exact_keys(items.withColumn("text", T.trim_dateline(F.col("text")))).withColumn("text", F.col("_cleaned")).drop("_cleaned"))
    rows = latest_update(texts.drop("text")).drop("norm", "update_no")
    rows = _drop_near(written(_first_of_equal(rows)), texts)  # read twice
    rows = written(rows.select("_row", asof.session_date(F.col("published_at")).alias("date")))  # read twice
    days = asof.next_trading_day(rows.select("date").distinct(), calendar)
    dated = rows.join(days, "date", "left")
    return texts.join(dated.hint("merge"), "_row").select("date", *items.columns, "trading_date")
