"""Tokens, stems, segments and spans as column expressions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import vocab


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable holds it, where a column would be computed at each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_ascii(text: Column) -> Column:
    """As many bytes as characters."""
    return F.octet_length(text) == F.char_length(text)


def strip_column(text: Column) -> Column:
    """`strip` of what costs nothing to mention: a text between two printable ASCII characters stays as it is, unsearched."""
    printable = lambda at: F.substring(text, at, 1).between("!", "~")
    return F.when(printable(1) & printable(-1), text).otherwise(strip(text))


def non_blank(text: Column) -> Column:
    """The trimmed text, or null where nothing is left (OP-47)."""
    return F.nullif(strip(text), F.lit(""))


def any_of(patterns: Iterable[str]) -> str:
    """One pattern for all; if each begins at a word's bound, that is asked once and not by each."""
    patterns = list(patterns)
    if all(p.startswith(r"\b") for p in patterns):
        return r"\b(?:" + "|".join(p[2:] for p in patterns) + ")"
    return "(?:" + "|".join(patterns) + ")"


def words_pattern(words: Iterable[str]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def phrase(text: Column) -> Column:
    """Lower-case runs of letters and digits, joined by single spaces (OP-40)."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def phrase_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def letters(text: Column) -> Column:
    """Lower-case runs of letters, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))


def singular(token: Column) -> Column:
    """A token of more than three letters without its last s."""
    return F.when(token.endswith("s") & (F.length(token) > 3), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def claim_stem(token: Column) -> Column:
    """OP-41."""
    return F.when(token.startswith("actuat"), "actuat").when(token.startswith("strain"), "strain").otherwise(singular(token))


def claim_stems(text: Column) -> Column:
    """Stems of the words that are no stop words, in order (OP-38)."""
    kept = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0), lambda t: ~t.isin(vocab.CLAIM_STOPWORDS))
    return F.transform(kept, claim_stem)


def numeric_tokens(text: Column) -> Column:
    """OP-39."""
    return F.filter(F.regexp_extract_all(F.replace(F.lower(text), F.lit("/"), F.lit("")), F.lit("[a-z°]+"), 0), lambda t: ~t.isin(vocab.NUMERIC_STOPWORDS))


def numeric_stems(text: Column) -> Column:
    """OP-42."""
    return F.array_distinct(F.transform(numeric_tokens(text), singular))


def numbers(text: Column) -> Column:
    """Numbers in order, without thousands separators (OP-36)."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?U)" + vocab.NUMBER), 0), lambda n: F.replace(n, F.lit(","), F.lit("")))


def value_of(number: Column) -> Column:
    """OP-43."""
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double")


def overlap(left: Column, right: Column) -> Column:
    """OP-45."""
    return F.size(F.array_intersect(left, right))


def within(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def sentences(text: Column) -> Column:
    """Non-blank sentences with their marks (OP-50)."""
    return F.filter(F.transform(F.split(strip(text), vocab.SENTENCE_BREAK, -1), strip), lambda s: s != "")


def spans(text: Column, pattern: str) -> Column:
    """match, start and end (code points, end exclusive) of each match of a pattern of positive width (OP-57).

    What lies between the matches comes from split; lengths of both give the places.
    """
    upto = lambda a, n: F.length(F.array_join(F.slice(a, 1, n), ""))

    def placed(x: Column) -> Column:
        start = lambda i: upto(x["between"], i + 1) + upto(x["found"], i)
        return F.transform(x["found"], lambda m, i: F.struct(m.alias("match"), start(i).alias("start"), (start(i) + F.length(m)).alias("end")))

    return let(F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found")), placed)


def first_span(text: Column, pattern: str) -> Column:
    """match and prefix, the text before it, of the first match of a pattern; null without one. Nothing after it is looked at."""
    found = F.struct(F.regexp_extract(text, pattern, 0).alias("match"), F.element_at(F.split(text, pattern, 2), 1).alias("prefix"))
    return let(found, lambda x: F.when(x["match"] != "", x))


def before(text: Column, span: Column) -> Column:
    return F.substring(text, F.lit(1), span["start"])


def after(text: Column, span: Column) -> Column:
    return F.substring(text, span["end"] + 1, F.length(text))


def fold(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text.casefold())
    for mark in filter(unicodedata.combining, set(plain)):
        plain = plain.replace(mark, "")
    return plain


def at_once(texts: pd.Series, change: Callable[[str], str]) -> pd.Series:
    """A change that goes character by character, made to all texts in one; to each by itself where one has the mark between them."""
    given = texts.dropna()
    if given.empty:
        return texts
    changed = change("\x00".join(given)).split("\x00")
    if len(changed) != len(given):
        changed = [change(t) for t in given]
    return pd.Series(changed, given.index).reindex(texts.index)


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Case-folded, decomposed, without combining marks (OP-33): no built-in normalises Unicode."""
    return at_once(text, fold)


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML character references resolved: no built-in does."""
    return text if text.isna().all() else text.map(html.unescape, na_action="ignore")


def spell(text: str) -> str:
    """Greek letters as words of their own."""
    for letter in set(text) & vocab.GREEK.keys():
        text = text.replace(letter, f" {vocab.GREEK[letter]} ")
    return text


@F.pandas_udf(T.StringType())
def folded_and_spelt(text: pd.Series) -> pd.Series:
    """`folded`, with Greek letters spelt out (OP-34)."""
    return at_once(text, lambda t: spell(fold(t)))


def in_ascii(text: Column, otherwise: Callable[[Column], Column]) -> Column:
    """ASCII text in lower case; only other text goes to a worker. Compute it once, as a column, where it is mentioned often."""
    plain = is_ascii(text)
    return F.when(plain, F.lower(text)).otherwise(otherwise(F.when(~plain, text)))


def plain_fold(text: Column) -> Column:
    return in_ascii(text, folded)


def plain_title(text: Column) -> Column:
    """A title's letters: folded, Greek ones spelt out, which ASCII text has none of."""
    return in_ascii(text, folded_and_spelt)


def title_tokens(plain: Column) -> Column:
    """Words of a `plain_title`, in singular (OP-35)."""
    return F.transform(F.regexp_extract_all(plain, F.lit(r"(?U)[^\W_]+"), 0), singular)


def tokens_with_greek(text: Column) -> Column:
    return title_tokens(plain_title(text))


#: An ampersand that begins no reference with a semicolon.
BARE_AMPERSAND = "&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)"


def clean_markup(text: Column, closed: bool = False) -> Column:
    """Tags out, references resolved, white space collapsed (OP-10); null for blank text.

    HTML also knows old references without a semicolon; if `closed`, those stay as they are.
    """
    bare = F.regexp_replace(text, "<[^>]+>", " ")
    if closed:
        bare = F.regexp_replace(bare, BARE_AMPERSAND, "&amp;")
    coded = F.contains(bare, F.lit("&"))
    resolved = F.when(coded, unescaped(F.when(coded, bare))).otherwise(bare)
    return F.when(non_blank(text).isNotNull(), strip(F.regexp_replace(resolved, r"(?U)\s+", " ")))


def spaced(text: Column) -> Column:
    """No space before closing marks or after an opening bracket (OP-14)."""
    closed = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+([,.;:!?%)\]])", "$1"), r"(?U)([(])\s+", "$1")
    return strip(F.regexp_replace(closed, r"(?U)\s+", " "))
