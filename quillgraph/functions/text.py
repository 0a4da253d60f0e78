"""String functions as Column expressions (no Python in the hot path)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions import fixed_values as fv
from quillgraph.session import bound

SPACE = r"[\s\x1C-\x1F]"
CJK = "[\\x{4e00}-\\x{9fff}]"
WORD_RUN = "(?U)[\\w\\x{4e00}-\\x{9fff}]+"


# --- small helpers -------------------------------------------------------------
def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Trim every Unicode space, not only U+0020; text that neither starts nor ends with one is not searched."""

    def trimmed(s: Column) -> Column:
        ends = F.concat(F.substring(s, 1, 1), F.substring(s, -1, 1))
        return F.when(ends.rlike(f"(?U){SPACE}"), F.regexp_replace(s, f"(?U)^{SPACE}+|{SPACE}+$", "")).otherwise(s)

    return bound(c, trimmed)


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank; a single blank is no match, so most text is only read."""
    return F.trim(F.regexp_replace(c, f"(?U)[{SPACE}&&[^ ]]{SPACE}*| {SPACE}+", " "))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True when any of ``words`` is a substring of ``c``."""
    condition = F.lit(False)
    for word in words:
        condition = condition | c.contains(word)
    return condition


def first_value(c: Column, table: Mapping[str, str] | Iterable[tuple[str, str]], default=None) -> Column:
    """Value of the first table entry whose key is a substring of ``c``."""
    entries = table.items() if isinstance(table, Mapping) else table
    choices = [F.when(c.contains(key), F.lit(value)) for key, value in entries]
    if default is not None:
        choices.append(default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(*choices)


def matching_words(c: Column, words: Iterable[str]) -> Column:
    """Array of the listed words contained in ``c``, in list order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: c.contains(w))


def replace_all(c: Column, table: Mapping[str, str]) -> Column:
    """Apply substring replacements one after another."""
    for source, target in table.items():
        c = F.replace(c, F.lit(source), F.lit(target))
    return c


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """First regex match, or the empty string."""
    return F.regexp_extract(c, pattern, group)


# --- cleaning --------------------------------------------------------------------
def noise_line(line: Column) -> Column:
    """Blank lines, page numbers and running headers; the patterns are tried on lines that start like one of them."""
    page = "|".join(f"(?:{p})" for p in fv.PAGE_LINE_PATTERNS)
    header = "|".join(f"(?:{p})" for p in fv.HEADER_LINE_PATTERNS)
    may_be = F.substring(line, 1, 1).isin(fv.NOISE_LINE_STARTS)
    return (line == "") | (may_be & (line.rlike(f"(?Uid)(?:{page})") | line.rlike(f"(?Ud)(?:{header})")))


def clean_document_text(c: Column, title: Column | None = None) -> Column:
    """Line-level cleaning of a statute, case or FAQ text.

    Newline and space normalisation, full-width punctuation, removal of noise,
    title and template lines, first-occurrence line distinct, and collapse of
    repeated punctuation.
    """
    out = F.regexp_replace(text_or_empty(c), "\r\n?|\f", "\n")
    out = F.translate(
        out,
        fv.ASCII_PUNCTUATION + "　\t�",
        fv.FULLWIDTH_PUNCTUATION + "  ",
    )
    lines = F.transform(F.split(out, "\n"), collapse_space)
    lines = F.filter(lines, lambda line: ~noise_line(line) & ~line.isin(fv.TEMPLATE_LINES))
    if title is not None:
        heading = collapse_space(text_or_empty(title))
        lines = bound(heading, lambda h: F.filter(lines, lambda line: (h == "") | (line != h)))
    out = F.array_join(F.array_distinct(lines), "\n")
    out = F.regexp_replace(out, f"([{fv.COLLAPSIBLE_FULLWIDTH}])\\1+", "$1")
    return strip(F.regexp_replace(out, "[ ]{2,}", " "))


def clean_text(c: Column) -> Column:
    """Lighter cleaning used for knowledge-base fields."""
    out = F.regexp_replace(text_or_empty(c), "\r\n?", "\n")
    out = F.translate(out, "　�", " ")
    lines = F.filter(F.transform(F.split(out, "\n"), strip), lambda line: line != "")
    out = F.array_join(lines, "\n")
    out = F.regexp_replace(out, f"([{fv.COLLAPSIBLE_MIXED}])\\1+", "$1")
    return strip(F.regexp_replace(out, "[ \t]{2,}", " "))


def normalize_key(c: Column) -> Column:
    """Comparison key: lower case without spaces and common punctuation."""
    squeezed = F.regexp_replace(F.lower(text_or_empty(c)), f"(?U){SPACE}+", "")
    return F.translate(squeezed, fv.KEY_PUNCTUATION, "")


def drop_adjacent_repeats(lines: Column) -> Column:
    """Keep an array element only when it differs from its predecessor."""
    return F.filter(
        lines,
        lambda line, i: F.when(i == 0, line != "").otherwise(line != F.get(lines, i - 1)),
    )


# --- tokens ------------------------------------------------------------------------
def words(c: Column) -> Column:
    """Unicode word runs of the lower-cased text, with repeats."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(WORD_RUN), F.lit(0))


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def search_tokens(c: Column) -> Column:
    """Words plus the character bigrams of longer words holding CJK characters."""
    plain = words(c)
    with_bigrams = F.flatten(
        F.transform(
            plain,
            lambda w: F.when(
                (F.length(w) > 2) & w.rlike(CJK),
                F.concat(
                    F.array(w),
                    F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2))),
                ),
            ).otherwise(F.array(w)),
        )
    )
    return F.when(c.rlike(CJK), with_bigrams).otherwise(plain)


def fallback_terms(c: Column) -> Column:
    """CJK runs of two or more characters, then words longer than one character."""
    runs = F.regexp_extract_all(c, F.lit(f"{CJK}{{2,}}"), F.lit(0))
    plain = F.filter(F.split(F.lower(c), "(?U)\\W+"), lambda w: F.length(w) > 1)
    return F.concat(runs, plain)


def estimate_tokens(c: Column) -> Column:
    """Rough token count: 0.6 per character, at least one for non-empty text."""
    n = F.length(text_or_empty(c))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n * fv.TOKENS_PER_CHAR))).cast("int")


def sentences(c: Column) -> Column:
    """Split after sentence marks, keeping the mark."""
    parts = F.split(strip(text_or_empty(c)), "(?U)(?<=[.!?。！？；;])\\s*")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def claims(c: Column) -> Column:
    """First four clauses of a conclusion or reasoning step."""
    parts = F.transform(F.split(text_or_empty(c), fv.CLAIM_SPLIT_PATTERN), strip)
    return F.slice(F.filter(parts, lambda s: s != ""), 1, fv.MAX_CLAIMS_PER_TEXT)


# --- similarities ----------------------------------------------------------------------
def char_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda ch: ch != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two distinct arrays; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def char_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(char_set(a), char_set(b))


def coverage(part: Column, whole: Column) -> Column:
    """Share of the distinct array ``part`` found in ``whole``; 0 when empty."""
    n = F.size(part)
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / n)


def char_overlap(a: Column, b: Column) -> Column:
    return coverage(char_set(strip(text_or_empty(a))), char_set(strip(text_or_empty(b))))


# --- law and article names --------------------------------------------------------------
def law_short_name(law: Column) -> Column:
    return first_value(law, [(name, name) for name in fv.ARTICLE_LAWS], strip(law))


def _without_country(c: Column) -> Column:
    return F.replace(F.translate(c, "《》", ""), F.lit(fv.COUNTRY), F.lit(""))


def normalize_article_name(article: Column, default_law: Column | None = None) -> Column:
    """``law + article`` in short form; text without an article is only stripped."""
    fallback = law_short_name(text_or_empty(default_law)) if default_law is not None else F.lit("")

    def named(cleaned: Column) -> Column:
        number = F.regexp_extract(cleaned, fv.ARTICLE_PATTERN, 0)
        prefix = first_value(cleaned, [(name, name) for name in fv.ARTICLE_LAWS], fallback)
        return F.when(number == "", cleaned).otherwise(F.concat(prefix, number))

    return bound(_without_country(strip(text_or_empty(article))), named)


def normalize_articles_in_text(c: Column, default_law: Column) -> Column:
    """Rewrite every article reference inside a text to its short form."""
    any_law = "|".join(fv.ARTICLE_LAWS)

    def shortened(law: str, text: Column) -> Column:
        short = F.regexp_replace(
            text, f"(?:《?{fv.COUNTRY}(?:{any_law})》?)?{law}({fv.ARTICLE_PATTERN})", f"{law}$1"
        )
        short = F.regexp_replace(
            short, f"《?{fv.COUNTRY}{law}》?(?:{any_law})?({fv.ARTICLE_PATTERN})", f"{law}$1"
        )
        return F.when(text.contains(law), short).otherwise(text)

    out = text_or_empty(c)
    for law in fv.ARTICLE_LAWS:
        out = bound(out, partial(shortened, law))
    # the first character is looked at before what stands before it
    bare = f"(?={fv.ARTICLE_PATTERN[0]})(?<!{'|'.join(fv.ARTICLE_LAWS)}){fv.ARTICLE_PATTERN}"
    return F.regexp_replace(out, F.lit(bare), F.concat(law_short_name(text_or_empty(default_law)), F.lit("$0")))


def normalize_keywords(keywords: Column, default_law: Column | None = None) -> Column:
    def one(k: Column) -> Column:
        return bound(
            replace_all(clean_text(k), fv.ENTITY_ALIASES),
            lambda cleaned: F.when(cleaned.rlike(fv.ARTICLE_PATTERN), normalize_article_name(cleaned, default_law)).otherwise(cleaned),
        )

    filled = F.coalesce(keywords, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(filled, one), lambda k: k != ""))


def chinese_numeral(n: Column) -> Column:
    """Chinese numeral of an integer below 10 000."""
    digits = F.array(*[F.lit(ch) for ch in fv.ZH_DIGITS])
    units = F.array(*[F.lit(u) for u in fv.ZH_UNITS])
    text = n.cast("string")
    parts = F.transform(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.when(F.substr(text, i, F.lit(1)) == "0", F.lit(fv.ZH_DIGITS[0])).otherwise(
            F.concat(
                F.get(digits, F.substr(text, i, F.lit(1)).cast("int")),
                F.get(units, F.length(text) - i),
            )
        ),
    )
    joined = F.regexp_replace(F.array_join(parts, ""), "零+", "零")
    joined = F.regexp_replace(F.regexp_replace(joined, "零$", ""), "一十", "十")
    return F.when(n <= 0, F.lit(fv.ZH_DIGITS[0])).otherwise(joined)


def after_label(c: Column) -> Column:
    """Text after the first ``::`` of a node label."""
    return F.regexp_replace(strip(text_or_empty(c)), "(?s)^.*?::", "")
