"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, hardneg, language, licenses, minhash, mixing, packing, phrases, quality, rules, substrings, suffixes, tokenfiles
from .common import documents, ensure_checkpoint_dir


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_policy(rules.ledger(documents(spark, sf_dir)))
    base = F.col("fail_bits").bitwiseAND(F.lit(rules.mask("base"))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = documents(spark, sf_dir).select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    readings = mixing.schedule(docs, figures=True)
    first = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return readings.groupBy("row").agg(*first, F.sum(mixing.n_words(F.col("text"))).alias("taken"), F.min("position").alias("position")).drop("row")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, sf_dir), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = fingerprints.fingerprints(documents(spark, sf_dir))
    return trees.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        fingerprints.likeness("", "edited_").alias("near_edited"),
        fingerprints.likeness("", "next_").alias("near_next"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = quality.fold(F.col("doc_id")) == 0
    model = language.fit(docs.where(~held_out))
    found = language.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_passages(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op11_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.summary(files)


def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def queries() -> dict:
    every = op1_packing, op2_substrings, op3_rules, op4_mixing, op5_licenses, op6_minhash, op7_fingerprints, op8_language, op9_quality, op10_suffixes, op11_tokenfiles, op12_hardneg, op13_phrases
    return {f.__name__: f for f in every}


#: Words, as SQL: runs of characters other than ASCII white space.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _repeats(length: int, kept: str) -> str:
    """DuckDB SQL that removes the words of windows that a smaller doc_id has."""
    return f"""
WITH w AS (SELECT doc_id, text, {WORDS} AS words FROM documents),
     starts AS (SELECT doc_id, unnest(range(1, len(words) - {length} + 2)) AS i, words FROM w WHERE len(words) >= {length}),
     windows AS (SELECT doc_id, i, array_to_string(words[i:i + {length - 1}], ' ') AS win FROM starts),
     smallest AS (SELECT win, min(doc_id) AS low FROM windows GROUP BY win),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {length})) AS i FROM windows JOIN smallest USING (win) WHERE low < doc_id),
     lost AS (SELECT doc_id, list(i) AS spots FROM gone GROUP BY doc_id),
     left_over AS (SELECT w.doc_id, w.text, len(words) AS n_words, coalesce(len(spots), 0) AS n_removed,
                   CASE WHEN spots IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(spots, x[2])), lambda x: x[1]) END AS words FROM w LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, {kept} FROM left_over"""


def _position(demand: str, total: str, number: str) -> str:
    """DuckDB SQL of mixing.position."""
    out = "NULL"
    knots, schedules = mixing.KNOTS, mixing.SCHEDULES
    for k, weights in enumerate(schedules):
        areas = [(t1 - t0) * (a + b) / 2 for t0, t1, a, b in zip(knots, knots[1:], weights, weights[1:], strict=False)]
        asked = f"(({demand}) / {total} * {sum(areas)}::DOUBLE)"
        inverse, before = f"{knots[-1]}::DOUBLE", sum(areas)
        for j in range(len(areas) - 1, -1, -1):
            before -= areas[j]
            a, slope = weights[j], (weights[j + 1] - weights[j]) / (knots[j + 1] - knots[j])
            inside = f"{knots[j]}::DOUBLE + 2 * ({asked} - {before}::DOUBLE) / ({a}::DOUBLE + sqrt({a * a}::DOUBLE + {2 * slope}::DOUBLE * ({asked} - {before}::DOUBLE)))"
            inverse = f"CASE WHEN {asked} < {before + areas[j]}::DOUBLE THEN {inside} ELSE {inverse} END"
        out = f"CASE WHEN {number} % {len(schedules)} = {k} THEN CASE WHEN {total} > 0 THEN {inverse} ELSE 0 END ELSE {out} END"
    return out


MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
     n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM s),
     w AS (SELECT *, [3e0, 1e0, 2e0][number % 3 + 1] AS weight FROM n),
     f AS (SELECT *, 2e0 * source_size / weight AS "full" FROM w),
     l AS (SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(2e0 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
           FROM f WINDOW b AS (ORDER BY "full", number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     t AS (SELECT source, source_size, number, least(2e0 * source_size, weight * (SELECT min_by(level, "full") FROM l WHERE level <= "full")) AS target FROM l),
     p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.number,
                  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY turn, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
     r AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS one, greatest(0, least(size, floor(target)::BIGINT - start - source_size)) AS two FROM p)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
       CASE WHEN one > 0 THEN round({_position("start", "target", "number")}, 9) END AS position FROM r"""


def _rules_sql() -> str:
    bits = " + ".join(f"CASE WHEN {fails} THEN {rules.BITS[name]} ELSE 0 END" for name, fails in rules.RULES.items())
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS words FROM documents),
     l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
     g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
     k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
     r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
     m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
           FROM l LEFT JOIN r USING (doc_id)),
     b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {rules.mask("base")} <> 0 AS base_failed, fail_bits & {rules.mask(rules.CURRENT)} = 0 AS kept, fail_bits FROM b"""


def _licenses_sql() -> str:
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"({sorted(set(t.split()))!r}, '{label}')" for label, t in licenses.TEMPLATES)
    return rf"""
WITH w AS (SELECT doc_id, {low} AS low, {words.format("low")} AS words FROM documents),
     phrases(p, label) AS (VALUES {phrases}), templates(t, label) AS (VALUES {templates}),
     at AS MATERIALIZED (SELECT doc_id, label, unnest(list_filter(range(0, len(words)), lambda i: words[i + 1:i + len(p)] = p)) AS i FROM w, phrases WHERE list_has_all(words, p)),
     base AS (SELECT doc_id, count(*) AS n, min(i) AS low, max(i) AS high, list_sort(list_distinct(list(label))) AS labels FROM "at" GROUP BY doc_id),
     l AS (SELECT doc_id, list_distinct({words.format("x")}) AS words FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS x FROM w) WHERE len(words) >= 3),
     hits AS (SELECT doc_id, label, len(list_intersect(words, t)) / len(t)::DOUBLE AS c FROM l, templates WHERE list_has_any(words, t) AND len(list_intersect(words, t)) >= ceil({licenses.THRESHOLD} * len(t) - 1e-9)),
     more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS c FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, base.low AS first_word, base.high AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1e0 ELSE coalesce(c, 0e0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)""".replace(" at AS", ' "at" AS')


def _tree_sql(name: str, text: str, source: str) -> str:
    """DuckDB SQL of fingerprints.tree, as a common table expression."""
    ends = lambda x: f"list_filter(range(1, len({x}) + 1), lambda k: k = len({x}) OR substring({x}[k], 1, 1) IN {fingerprints.ENDS})"
    up = lambda x, e: f"list_transform(range(1, len({e}) + 1), lambda i: md5(array_to_string({x}[CASE WHEN i = 1 THEN 1 ELSE {e}[i - 1] + 1 END:{e}[i]], '')))"
    return f"""{name}1 AS (SELECT doc_id, list_transform(regexp_extract_all({text}, '{fingerprints.PIECES}'), lambda x: md5(x)) AS leaves FROM {source}),
     {name}2 AS (SELECT *, {ends("leaves")} AS ends FROM {name}1),
     {name}3 AS (SELECT doc_id, leaves, {up("leaves", "ends")} AS paragraphs FROM {name}2),
     {name}4 AS (SELECT *, {ends("paragraphs")} AS ends FROM {name}3),
     {name} AS (SELECT doc_id, leaves, sha256(array_to_string({up("paragraphs", "ends")}, '')) AS root FROM {name}4)"""


def _fingerprints_sql() -> str:
    near = "CASE WHEN a.root = {0}.root THEN 1e0 ELSE len(list_intersect(a.leaves, {0}.leaves)) / greatest(len(list_distinct(list_concat(a.leaves, {0}.leaves))), 1)::DOUBLE END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
     e AS (SELECT *, substring(t, 1, length(t) - length(t) // 2) || substring(nt, 1, length(t) // 2) AS ed FROM n),
     {_tree_sql("a", "t", "e")},
     {_tree_sql("b", "ed", "e")},
     {_tree_sql("c", "nt", "e")}
SELECT e.doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, a.root AS fingerprint, b.root AS edited_fingerprint,
       {near.format("b")} AS near_edited, {near.format("c")} AS near_next
FROM e JOIN a USING (doc_id) JOIN b USING (doc_id) JOIN c USING (doc_id)"""


HARD_NEGATIVES = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.id AS anchor, a.label = x.label AS same, x.id, list_inner_product(a.q, x.q)::BIGINT AS score FROM v a JOIN v x ON a.id <> x.id WHERE a.id % 50 = 0),
     p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
     n AS (SELECT p.anchor, p.id AS positive, p.score AS positive_score, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
           FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score FROM n WHERE rank <= 3"""


PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS words FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
     w AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM p),
     z AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
     f AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
     c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS words, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
     s AS (SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
           FROM c JOIN z USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(words[:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(words[cut + 1:], ' ')),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
     x AS (SELECT lang, phrase, max(longer) AS longer FROM (SELECT lang, f AS longer, unnest([array_to_string(string_split(phrase, ' ')[:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase FROM f WHERE k > 2) GROUP BY lang, phrase),
     o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR longer < a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substrings": _repeats(13, "sha256(array_to_string(words, ' ')) AS kept_sha256"),
        "op3_rules": _rules_sql(),
        "op4_mixing": MIXING,
        "op5_licenses": _licenses_sql(),
        "op7_fingerprints": _fingerprints_sql(),
        "op13_phrases": PHRASES,
        "op12_hardneg": HARD_NEGATIVES,
        "op10_suffixes": _repeats(50, "sha256(CASE WHEN n_removed = 0 THEN text ELSE array_to_string(words, ' ') END) AS text_sha256"),
    }
