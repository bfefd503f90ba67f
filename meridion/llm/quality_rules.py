"""Line-first quality rules with DataFrame functions only.

Each line of a text is judged on its own: boilerplate phrases, navigation, missing punctuation, symbols
and shouting fail it. Failing lines go; a document that loses more than half of its word characters
that way is rejected, as is one that fails the base rules (few words, or mostly repeated words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import packed, unpacked

SPACE = r"[ \t-\r]"
SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = (
    r"(all rights reserved|licensed under|released under the|copyright (\(c\)|©)|cookie (policy|settings|consent)|privacy policy|terms (of (use|service)|and conditions)"
    r"|enable javascript|subscribe to our|sign (in|up) (to|for)|log in to|share (this|on) (facebook|twitter)|skip to (main )?content|click here to|lorem ipsum)"
)
NAVIGATION = r"([|»›•·>][^|»›•·>]*){2}"
ENDING = r"[.!?:;,…。！？)\]}\"'”’»]" + SPACE + "*$"
FEW_WORDS = 5  # a line with fewer and no ending is a heading or menu item
BOILERPLATE_CHARS = 300  # a longer line is prose that mentions such words
NAV_WORDS = 12  # a line with more is prose, whatever separators it has
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEPT_PERCENT = 50
HASH_MASK = -1  # bits of the windows' hashes: all; words are compared, so fewer only cost time


def _blank(line: Column) -> Column:
    return ~line.rlike("[^ \\t-\\r]")


def line_fails(line: Column) -> Column:
    """True for a line, with a word in it, that a rule removes. What a rule counts is only counted where its marks occur."""
    n_words = F.size(F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), SPACE + "+"))
    chars = F.length(F.regexp_replace(line, SPACE + "+", ""))
    n_symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS + "+", ""))
    n_shouts = F.length(line) - F.length(F.regexp_replace(line, "[!?]+", ""))
    return (
        (~line.rlike(ENDING) & (n_words < FEW_WORDS))
        | (line.rlike(SYMBOLS) & (n_symbols * 10 > chars))
        | (line.rlike("[!?].*[!?].*[!?]") & (n_shouts * 2 > n_words + 4))
        | (line.rlike("[|»›•·>]") & (n_words <= NAV_WORDS) & line.rlike(NAVIGATION))
        | ((F.length(line) <= BOILERPLATE_CHARS) & line.rlike("(?i)" + BOILERPLATE))
    )


def judge(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and, under ``_q``, a struct of counts, verdict and cleaned text.

    Null texts have no words, fail the base rules and stay null; so do empty ones. Every row is judged
    on its own whole text, so repeats, ties and empty tables need no rule.
    """
    t = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    t = t.withColumn("_trim", F.btrim("_t", F.lit(" \t\n\x0b\x0c\r")))
    t = t.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", SPACE + "+")))
    t = t.withColumn("_n", F.size("_words").cast("long")).withColumn("_packed", F.array_join("_words", ""))
    # A key is a 3-word window's hash with the low bits replaced by its position, so equal windows are neighbours once sorted.
    t = t.withColumn("_low", F.expr("cast(shiftleft(1L, cast(ceil(log2(_n + 2)) as int)) as bigint)"))
    keys = f"transform(slice(_words, 1, cast(greatest(_n - 2, 0) as int)), (w, i) -> (xxhash64(w, get(_words, i + 1), get(_words, i + 2)) & {HASH_MASK}L & -_low) | i)"
    t = t.withColumn("_keys", F.sort_array(F.expr(keys)))
    same = "(x & -_low) = (get(_keys, {k}) & -_low)"
    equal = " and ".join(f"get(_words, cast(x & (_low - 1) as int) + {d}) = get(_words, cast(get(_keys, {{k}}) & (_low - 1) as int) + {d})" for d in range(3))
    twice = " or ".join(f"coalesce({same.format(k=k)} and {equal.format(k=k)}, false)" for k in ("j - 1", "j + 1"))
    # Where a neighbour has the hash but not the words, all windows of that hash are compared.
    clash = " or ".join(f"coalesce({same.format(k=k)}, false)" for k in ("j - 1", "j + 1"))
    any_equal = " and ".join(f"get(_words, cast(x & (_low - 1) as int) + {d}) = get(_words, cast(y & (_low - 1) as int) + {d})" for d in range(3))
    twice = f"{twice} or (({clash}) and exists(_keys, y -> y <> x and (y & -_low) = (x & -_low) and {any_equal}))"
    t = t.withColumn("_twice", F.expr(f"filter(_keys, (x, j) -> {twice})"))
    spread = F.expr("size(array_distinct(flatten(transform(_twice, x -> array(x & (_low - 1), (x & (_low - 1)) + 1, (x & (_low - 1)) + 2)))))")
    t = t.withColumn("_all", F.split("_t", "\n"))
    t = t.withColumn("_lines", F.filter("_all", lambda x: ~_blank(x)))
    t = t.withColumn("_good", F.filter("_all", lambda x: _blank(x) | ~line_fails(x)))
    t = t.withColumn("_clean", F.array_join("_good", "\n"))
    counts = {
        "n_words": F.col("_n"),
        "word_chars": F.length("_packed").cast("long"),
        "n_symbols": (F.length("_packed") - F.length(F.regexp_replace("_packed", SYMBOLS + "+", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": spread.cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_lines_removed": (F.size("_all") - F.size("_good")).cast("long"),
        "kept_chars": F.length(F.regexp_replace("_clean", SPACE + "+", "")).cast("long"),
    }
    t = t.select(*docs.columns, "_clean", *[c.alias("_q_" + k) for k, c in counts.items()])
    base_failed = (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q_n_words"))
    kept = ~base_failed & (100 * F.col("_q_kept_chars") >= KEPT_PERCENT * F.col("_q_word_chars"))
    verdict = F.struct(*[F.col("_q_" + k).alias(k) for k in counts], base_failed.alias("base_failed"), kept.alias("kept"), F.when(F.col("text").isNotNull(), F.col("_clean")).alias("clean_text"))
    return t.select(*docs.columns, verdict.alias("_q"))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row."""
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "kept_chars"]
    return judge(slim).select("doc_id", *[f"_q.{n}" for n in names])


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with the failing lines cut from their texts and the same columns."""
    # A filter is not pushed through a projection that numbers rows; pushed down, it would write out all steps again and again.
    numbered = judge(packed(docs)).withColumn("_mark", F.monotonically_increasing_id())
    good = numbered.where(F.col("_q.kept") & (F.col("_mark") >= 0))
    return unpacked(good.select("doc_id", F.col("_q.clean_text").alias("text"), "_rest"), docs)


def _duck(s: str) -> str:
    return s.replace("'", "''")


_W = r"[ \t-\r]+"
REPORT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_W}'), lambda x: x <> '') AS ws FROM d),
k AS (SELECT doc_id, t, ws, array_to_string(ws, '') AS packed FROM w),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT doc_id, l, regexp_replace(l, '{_W}', '', 'g') AS p, len(list_filter(regexp_split_to_array(l, '{_W}'), lambda x: x <> '')) AS n FROM ln WHERE regexp_matches(l, '[^ \\t-\\r]')),
lf AS (SELECT doc_id, l, p, ((length(l) <= {BOILERPLATE_CHARS} AND regexp_matches(l, '(?i){_duck(BOILERPLATE)}'))
    OR (n <= {NAV_WORDS} AND regexp_matches(l, '{_duck(NAVIGATION)}'))
    OR (n < {FEW_WORDS} AND NOT regexp_matches(l, '{_duck(ENDING)}'))
    OR (length(p) - length(regexp_replace(p, '{SYMBOLS}+', '', 'g'))) * 10 > length(p)
    OR (length(p) - length(regexp_replace(p, '[!?]+', '', 'g'))) * 2 > n + 4) AS fails FROM lw),
la AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT l) AS n_distinct, count(*) FILTER (fails) AS n_removed, coalesce(sum(length(p)) FILTER (NOT fails), 0) AS kept_chars FROM lf GROUP BY doc_id),
r AS (SELECT k.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(packed) AS BIGINT) AS word_chars,
    CAST(length(packed) - length(regexp_replace(packed, '{SYMBOLS}+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines - n_distinct, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars
  FROM k LEFT JOIN cov ON cov.doc_id = k.doc_id LEFT JOIN la ON la.doc_id = k.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  (n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words AND 100 * kept_chars >= {KEPT_PERCENT} * word_chars) AS kept,
  n_lines, n_lines_removed, kept_chars
FROM r
"""
