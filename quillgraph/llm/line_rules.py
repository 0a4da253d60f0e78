"""Line-first cleaning: judge every line, drop the failures, then judge what the document lost.

A word is a run of characters other than blank, tab, line feed, vertical tab,
form feed and carriage return; a line is what stands between line feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import compute_once

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: What a line of boilerplate says.
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under|released under|copyright|\(c\) [0-9]{4}|cookie|javascript|lorem ipsum"
    r"|privacy policy|terms of (use|service)|click here|sign (in|up)|log ?in\b|subscribe|read more|share (on|this)"
)
#: A line ends a sentence, closing quotes and brackets aside.
TERMINAL = r"[.!?…:;。！？][\"'”’»)\]]*[ \t\r\x0b\x0c]*$"
#: Separators of menus and breadcrumbs.
NAVIGATION = "|»›•>"

MAX_PUNCTUATION = 0.2
MAX_SEPARATORS = 0.2
MIN_KEPT = 0.5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20


def has_word(line: Column) -> Column:
    return line.rlike("[^ \t-\r]")


def _bare(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def line_fails(line: Column) -> Column:
    """Whether a line breaks the punctuation, the navigation or the boilerplate rule.

    Punctuation: it ends no sentence, or over a fifth of its characters are
    neither letters, digits, marks nor space.  Navigation: over a fifth as many
    separators as words.  Boilerplate: it holds a fixed phrase.
    """
    bare = _bare(line)
    marks = F.length(F.regexp_replace(bare, r"[\p{L}\p{N}\p{M}]+", ""))
    words = F.size(F.split(F.trim(line), "[ \t-\r]+"))
    separators = F.length(line) - F.length(F.translate(line, NAVIGATION, ""))
    return (
        ~line.rlike(TERMINAL)
        | (marks > MAX_PUNCTUATION * F.length(bare))
        | (separators > MAX_SEPARATORS * words)
        | line.rlike(BOILERPLATE)
    )


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text.

    Equal hashes only tell which texts need the exact count: there the windows
    themselves are sorted, equal neighbours give the positions.
    """
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(1), F.size(words) - WINDOW + 1),
            lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(WINDOW)), " ").alias("w"), i.alias("at")),
        )
    )

    def positions(ordered: Column) -> Column:
        def twice(entry: Column, j: Column) -> Column:
            before, after = F.get(ordered, j - 1)["w"], F.get(ordered, j + 1)["w"]
            return F.coalesce(before == entry["w"], F.lit(False)) | F.coalesce(after == entry["w"], F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, twice), lambda e: e["at"]))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda total, s: total + s)

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    exact = once(windows, lambda ordered: once(positions(ordered), covered))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), exact).otherwise(0).cast("long")


def clean_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Line verdicts, base counts and the verdict of each document.

    Returns ``doc_id``, ``text`` without its failed lines, the counts
    ``n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines
    n_failed_lines``, ``kept_chars`` (non-space characters of the lines that
    stay), ``base_failed`` and ``kept``.  A document that passes the base test
    is kept if its lines keep at least ``MIN_KEPT`` of its characters.

    A null text counts as empty and fails the base test; lines without a word
    neither fail nor count.  Ids may be null or repeat: every row is judged by
    itself.  Nothing is shuffled.
    """
    source = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = compute_once(
        source,
        words=F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != ""),
        lines=F.filter(F.split("text", "\n"), has_word),
    )
    judged = compute_once(
        split,
        hashed=F.transform("words", lambda w: F.xxhash64(w)),
        good=F.filter("lines", lambda line: ~line_fails(line)),
    )
    windows = compute_once(
        judged,
        hashes=F.when(
            F.size("words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - WINDOW),
                lambda i: F.xxhash64(*[F.get("hashed", i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    counted = compute_once(
        windows,
        n_words=F.size("words").cast("long"),
        word_chars=F.length(_bare(F.col("text"))).cast("long"),
        n_symbols=(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=repeated_words(F.col("words"), F.col("hashes")),
        n_lines=F.size("lines").cast("long"),
        n_failed_lines=(F.size("lines") - F.size("good")).cast("long"),
        kept_chars=F.length(_bare(F.array_join("good", ""))).cast("long"),
        text=F.array_join("good", "\n"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return counted.select(
        F.col("doc_id").alias(doc_id),
        F.col("text").alias(text),
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        *["n_lines", "n_failed_lines", "kept_chars"],
        base.alias("base_failed"),
        (~base & (F.col("kept_chars") >= MIN_KEPT * F.col("word_chars"))).alias("kept"),
    )


ORACLE = r"""
WITH given AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM given
), windows AS (
  SELECT rid, i, array_to_string(words[i : i + 4], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5)
), twice AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS following
  FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT rid, sum(least(5, coalesce(following - i, 5)))::BIGINT AS n FROM twice GROUP BY rid
), judged AS (
  SELECT *, list_filter(lines, lambda l: regexp_matches(l, '[.!?…:;。！？]["''”’»)\]]*[ \t\r\x0B\x0C]*$')
    AND length(regexp_replace(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'), '[\p{L}\p{N}\p{M}]', '', 'g'))
      <= 0.2 * length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))
    AND length(regexp_replace(l, '[^|»›•>]', '', 'g'))
      <= 0.2 * len(regexp_split_to_array(regexp_replace(l, '^ +| +$', '', 'g'), '[\x20\x09-\x0D]+'))
    AND NOT regexp_matches(l, '(?i)all rights reserved|licensed under|released under|copyright|\(c\) [0-9]{4}|cookie|javascript|lorem ipsum|privacy policy|terms of (use|service)|click here|sign (in|up)|log ?in\b|subscribe|read more|share (on|this)')
  ) AS good
  FROM split
), counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(good))::BIGINT AS n_failed_lines,
    length(regexp_replace(array_to_string(good, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS kept_chars
  FROM judged LEFT JOIN repeats USING (rid)
)
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars >= 0.5 * word_chars AS kept
FROM counted
"""
