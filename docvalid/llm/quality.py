"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histogram of character classes and that of its language's common words
are compared with the language's references by Jensen-Shannon distance (the square
root of the divergence in bits, 0 to 1).  The references are the sums over all
documents of the language that pass the base rules.  Texts below the minimum lengths
are not judged by a histogram, which says little about them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SEPARATORS, plain, table, written

MIN_WORDS, MOST_REPEATED = 50, 50
#: From so many characters and words a histogram is compared, and the greatest distances that are kept.
MIN_CHARS, MIN_COMMON = 200, 100
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.28, 0.26

# The most common function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "nicht", "ein", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "una"],
}


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often ``use`` reads it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_list(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATORS))


def _repeats(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more, compared as texts."""

    def one(ws: Column) -> Column:
        # a window's words hold no space, so their text is the window's alone
        window = lambda i: F.struct(F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("text"), i.alias("at"))
        return F.array_sort(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), window))

    def again(sorted_: Column) -> Column:
        same = lambda x, k: F.coalesce(x["text"] == F.get(sorted_, k)["text"], F.lit(False))
        return F.transform(F.filter(sorted_, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["at"])

    places = F.array_sort(let(let(words, one), again))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")))["n"]


def _repeat_words(words: Column) -> Column:
    """As _repeats; most texts repeat no window, which hashes show in less time: equal windows have equal hashes."""
    hashes = let(words, lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))))
    none = (F.size(words) < 4) | let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(none, F.lit(0).cast("long")).otherwise(_repeats(words))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and the base columns of a table (doc_id, lang, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("words", word_list(F.col("text")))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0)
    return rows.select(
        "doc_id", "lang", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.when(F.instr(text, "\n") > 0, let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))).otherwise(F.lit(0)).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def _histograms(rows: DataFrame) -> DataFrame:
    """chars: letters and others, upper case, digits, punctuation, symbols, white space; common: the language's words, and all else."""
    text = F.coalesce("text", F.lit(""))
    upper, digits, marks = (F.regexp_count(text, F.lit(p)).cast("long") for p in (r"\p{Lu}", r"[0-9]", r"[.,;:!?'\"()\[\]{}/_=+@^~`\\-]"))
    rows = rows.withColumns({"upper": upper, "digits": digits, "marks": marks, "n_chars": F.length(text).cast("long")})
    letters = F.col("word_chars") - F.col("upper") - F.col("digits") - F.col("marks") - F.col("n_symbols")
    chars = F.array(letters, "upper", "digits", "marks", "n_symbols", F.col("n_chars") - F.col("word_chars"))
    common = None
    for lang, ws in COMMON_WORDS.items():
        counts = let(F.filter("words", lambda w: w.isin(ws)), lambda k: F.array(*[(F.size(k) - F.size(F.array_remove(k, w))).cast("long") for w in ws]))
        common = F.when(F.col("lang") == lang, counts) if common is None else common.when(F.col("lang") == lang, counts)
    rows = rows.withColumn("found", common)
    others = F.col("n_words") - F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("chars", chars).withColumn("common", F.concat("found", F.array(others))).drop("text", "words", "found", "upper", "digits", "marks")


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts of the same length, null if either is empty or null."""

    def of(pair: Column) -> Column:
        total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
        p_all, q_all = total(pair["p"]), total(pair["q"])
        shares = F.zip_with(pair["p"], pair["q"], lambda x, y: F.struct((x / p_all).alias("p"), (y / q_all).alias("q")))
        part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        terms = F.transform(shares, lambda s: (part(s["p"], (s["p"] + s["q"]) / 2) + part(s["q"], (s["p"] + s["q"]) / 2)) / 2)
        bits = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
        return F.when((p_all > 0) & (q_all > 0), F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), bits))))

    doubles = lambda h: F.transform(h, lambda x: x.cast("double"))
    return let(F.struct(doubles(a).alias("p"), doubles(b).alias("q")), of)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_chars: float = MOST_CHAR_DISTANCE, most_words: float = MOST_WORD_DISTANCE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and both distances for every row of ``docs``.

    kept is false where base_failed, else whether neither distance is above its
    limit.  char_distance is null below MIN_CHARS characters, word_distance below
    MIN_COMMON words and for languages without COMMON_WORDS; a null distance rejects
    nothing.  A null text has no words and fails the base rules; rows without a
    language form a language of their own.  Repeated rows are judged each.  An empty
    table gives an empty result; other columns are left out.
    """
    docs = plain(docs, doc_id=docs[f"`{id_col}`"].cast("long"), lang=docs[f"`{lang_col}`"].cast("string"), text=docs[f"`{text_col}`"].cast("string"))
    rows = _histograms(base_counts(docs))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    rows = written(rows, "histograms")
    classes = 6
    longest = max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(classes)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(longest)]
    per = rows.where("NOT base_failed").groupBy("lang").agg(*sums)
    # a language with fewer words has nulls at the end
    per = per.select(F.col("lang").alias("of"), F.array(*[f"c{i}" for i in range(classes)]).alias("char_ref"), F.filter(F.array(*[f"w{i}" for i in range(longest)]), lambda x: x.isNotNull()).alias("word_ref"))
    rows = rows.join(per, rows.lang.eqNullSafe(per.of), "left")
    rows = rows.withColumn("char_distance", F.when(F.col("n_chars") >= MIN_CHARS, js_distance(F.col("chars"), F.col("char_ref"))))
    rows = rows.withColumn("word_distance", F.when((F.col("n_words") >= MIN_COMMON) & F.col("common").isNotNull(), js_distance(F.col("common"), F.col("word_ref"))))
    far = (F.coalesce("char_distance", F.lit(0.0)) > most_chars) | (F.coalesce("word_distance", F.lit(0.0)) > most_words)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on all documents; distances to six places, as two engines may add in different orders."""
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lists(lang, list) AS (
  VALUES {lists}
), words_ AS (
  SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM rows_
), windows_ AS (
  SELECT id, word, i, lead(word) OVER w AS second, lead(word, 2) OVER w AS third FROM words_ WINDOW w AS (PARTITION BY id ORDER BY i)
), twice AS (
  SELECT id, i, third IS NOT NULL AND count(*) OVER (PARTITION BY id, word, second, third) > 1 AS found FROM windows_
), covered AS (
  SELECT id, found OR coalesce(lag(found) OVER w, false) OR coalesce(lag(found, 2) OVER w, false) AS within FROM twice WINDOW w AS (PARTITION BY id ORDER BY i)
), repeated AS (
  SELECT id, count(*) FILTER (within) AS n FROM covered GROUP BY id
), base AS (
  SELECT r.*, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(text) AS BIGINT) AS n_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    len(regexp_extract_all(text, '\p{{Lu}}')) AS upper_, len(regexp_extract_all(text, '[0-9]')) AS digits,
    len(regexp_extract_all(text, '[.,;:!?''"()\[\]{{}}/_=+@^~`\\-]')) AS marks
  FROM rows_ r LEFT JOIN repeated USING (id)
), judged AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    n_words < {least} OR 100 * n_repeat_words > {repeated} * n_words AS base_failed FROM base
), counts AS (
  SELECT id, lang, base_failed, 'chars' AS kind, unnest([word_chars - upper_ - digits - marks - n_symbols, upper_, digits, marks, n_symbols, n_chars - word_chars]) AS n, unnest(range(6)) AS k FROM judged
), found AS (
  SELECT j.id, j.lang, base_failed, n_words, unnest(list) AS word, unnest(range(len(list))) AS k FROM judged j JOIN lists l ON l.lang = j.lang
), known AS (
  SELECT f.id, f.lang, base_failed, n_words, f.k, count(w.word) AS n FROM found f LEFT JOIN words_ w ON w.id = f.id AND w.word = f.word GROUP BY ALL
), histograms AS (
  SELECT id, lang, base_failed, kind, k, n FROM counts
  UNION ALL SELECT id, lang, base_failed, 'words', k, n FROM known
  UNION ALL SELECT id, lang, base_failed, 'words', 99, n_words - sum(n) FROM known GROUP BY id, lang, base_failed, n_words
), refs AS (
  SELECT lang, kind, k, sum(n) AS n FROM histograms WHERE NOT base_failed GROUP BY ALL
), shares AS (
  SELECT h.id, h.kind, CAST(h.n AS DOUBLE) / nullif(sum(h.n) OVER of, 0) AS p, CAST(r.n AS DOUBLE) / nullif(sum(r.n) OVER of, 0) AS q
  FROM histograms h JOIN refs r ON r.kind = h.kind AND r.k = h.k AND r.lang IS NOT DISTINCT FROM h.lang WINDOW of AS (PARTITION BY h.id, h.kind)
), distances AS (
  SELECT id, kind, sqrt(greatest(0.0, least(1.0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)))) AS d
  FROM shares WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY id, kind
), both_ AS (
  SELECT j.*, CASE WHEN n_chars >= {chars} THEN c.d END AS char_distance, CASE WHEN n_words >= {common} THEN w.d END AS word_distance
  FROM judged j LEFT JOIN distances c ON c.id = j.id AND c.kind = 'chars' LEFT JOIN distances w ON w.id = j.id AND w.kind = 'words'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance, 0) <= {far_chars} AND coalesce(word_distance, 0) <= {far_words} AS kept,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM both_
""".format(lists=", ".join(f"('{lang}', {words})" for lang, words in COMMON_WORDS.items()), least=MIN_WORDS, repeated=MOST_REPEATED, chars=MIN_CHARS, common=MIN_COMMON, far_chars=MOST_CHAR_DISTANCE, far_words=MOST_WORD_DISTANCE)
