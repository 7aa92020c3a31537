"""Cleaning of product texts, as columns."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("english", "italian", "german", "french", "spanish")
#: ASCII punctuation but for the underscore.
PUNCTUATION = r"[!-/:-@\[-^`{-~]+"


def stop_words(spark: SparkSession, languages: Sequence[str] = LANGUAGES, without: Sequence[str] = ("man",), more: Sequence[str] = ("via",)) -> list[str]:
    """Spark's own lists for some languages. German has "man", which is a word of products in English."""
    from pyspark.ml.feature import StopWordsRemover

    words = {w.lower() for x in languages for w in StopWordsRemover.loadDefaultStopWords(x)}
    return sorted((words - set(without)) | set(more))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


# Fixed value: the pattern decides the result.
def strip_urls(text: Column) -> Column:
    """Addresses that end in .com, with the character before them."""
    return F.regexp_replace(text, r"(www\S+)*(.\S+\.com)", "")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, " ")


def drop_short(text: Column, most: int = 2) -> Column:
    return F.array_join(F.filter(tokens(text), lambda w: F.length(w) > most), " ")


# Fixed value: the pattern decides the result.
def drop_numbers(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z]*[0-9]+[a-z]*)", "")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def drop_words(text: Column, words: Sequence[str]) -> Column:
    lost = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    return F.array_join(F.filter(tokens(text), lambda w: ~F.array_contains(lost, w)), " ")


def shorten_runs(text: Column) -> Column:
    """Three of a character where more stand in a row."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1$1")


_SPACE, _SIGN = r" \t\n\x0b\f\r", r"\p{L}\p{N}_"
_EYES, _NOSE, _MOUTH = "[:;=8]", "[o*'-]?", r"[)\](\[dDpP/\\:}{@|]"
# The kinds of tokens of short posts, tried in this order at each place. They use no look-around and no
# classes whose meaning differs between engines, so SQL engines read them alike.
POST_TOKENS = {
    "address": rf"(?:https?://|www\.)[^{_SPACE}<>]+",
    "emoticon": f"[<>]?{_EYES}{_NOSE}{_MOUTH}|{_MOUTH}{_NOSE}{_EYES}[<>]?|</?3",
    "tag": rf"<[^>{_SPACE}]+>",
    "arrow": "-+>|<-+",
    "handle": f"@[{_SIGN}]+",
    "hashtag": f"#+[{_SIGN}]+(?:['-]+[{_SIGN}]+)*",
    "mail": rf"[{_SIGN}.+-]+@[{_SIGN}-]+(?:\.[{_SIGN}-]+)+",
    "word": r"\p{L}[\p{L}'_-]+\p{L}",
    "number": r"[+-]?\p{Nd}+[,/.:-]\p{Nd}+[+-]?",
    "plain": f"[{_SIGN}]+",
    "dots": rf"\.(?:[{_SPACE}]*\.)+",
    "sign": f"[^{_SPACE}]",
}
POST_TOKEN = "|".join(f"(?:{p})" for p in POST_TOKENS.values())


def post_tokens(text: Column, reduce_len: bool = True) -> Column:
    """The tokens of a short post: addresses, emoticons, handles, hashtags, words with their apostrophes and dashes, numbers,
    rows of dots, single signs. With reduce_len longer runs of a character count as three. Null stays null."""
    return F.regexp_extract_all(shorten_runs(text) if reduce_len else text, F.lit(POST_TOKEN), F.lit(0))


def lemma(word: Column) -> Column:
    """The singular of an English noun, by rules on its end."""
    n = F.length(word)
    ends = lambda *of: functools.reduce(Column.__or__, [word.endswith(e) for e in of])
    cut = lambda k, more="": F.concat(F.left(word, n - k), F.lit(more))
    return (
        F.when(ends("men") & (n > 3), cut(2, "an"))
        .when(n <= 3, word)
        .when(ends("ies") & (n > 4), cut(3, "y"))
        .when(ends("sses", "xes", "ches", "shes", "zzes"), cut(2))
        .when(ends("ss", "us", "is") | ~word.endswith("s"), word)
        .otherwise(cut(1))
    )


def lemmatise(text: Column) -> Column:
    return F.array_join(F.transform(tokens(text), lemma), " ")


def preprocess(text: Column, words: Sequence[str], segmented: Column | None = None) -> Column:
    """The whole chain. segmented: the lowered text without addresses, split into words where they are glued."""
    x = strip_urls(F.lower(text)) if segmented is None else segmented
    x = ascii_only(drop_numbers(drop_short(strip_punctuation(x))))
    return F.array_join(F.transform(post_tokens(drop_words(squeeze(x), words)), lemma), " ")


def has_word(text: Column, word: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), word, F.lit(" ")))


def position(text: Column, word: Column) -> Column:
    """Where a text first has another, from 0; -1 if nowhere."""
    return F.position(word, text) - 1


# The forms of labels in their dimensions.
def canonical_label(label: Column, attribute: Column) -> Column:
    """The form of a label that its dimension has, whatever the case."""
    x, a = F.upper(label), F.lower(attribute)
    neck, length, collar, fit = a == "neckdesign", a == "length", a == "collardesign", a == "fit"
    return (
        F.when(neck & (x == "V-NECK"), F.lit("V NECK"))
        .when(neck & (x == "OFF-SHOULDER"), F.lit("OFF SHOULDER"))
        .when(length & x.isin("SHORT", "MEDIUM", "KNEE"), F.concat(x, F.lit(" LENGTH")))
        .when(length & (x == "MAXI"), F.lit("LONG"))
        .when(collar & x.isin("MAO", "STAND UP", "POLO"), F.concat(x, F.lit(" COLLAR")))
        .when(fit & x.isin("REGULAR", "RELAXED", "SLIM"), F.concat(x, F.lit(" FIT")))
        .otherwise(x)
    )


def followed_by(words: Column, word: Column, after: str) -> Column:
    """Whether a word of the list is followed by a given one, whatever the case."""
    low = F.transform(words, F.lower)
    pairs = F.zip_with(low, F.slice(low, 2, F.greatest(F.size(low), F.lit(1))), lambda a, b: (a == F.lower(word)) & (b == after.lower()))
    return F.exists(pairs, lambda p: F.coalesce(p, F.lit(False)))


# Fixed value: the separators decide the result.
def multi_words(text: Column, separators: str = r"/|,|to|and| |&|-") -> Column:
    """The distinct parts of an attribute's text, lowered, split at the listed separators and nowhere else."""
    return F.array_distinct(F.filter(F.split(F.lower(text), separators), lambda w: w != ""))


def third_slash(text: Column) -> Column:
    """What stands before the third slash; before the only one if there is one."""
    return F.when(F.length(F.regexp_replace(text, "[^/]", "")) == 1, F.substring_index(text, "/", 1)).otherwise(F.substring_index(text, "/", 3))


def folder_name(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, "[0-9]", "")), " ", "")


def price(text: Column) -> Column:
    """A price out of its text: a comma is a decimal point, signs of money don't count."""
    return F.replace(F.regexp_replace(text, r"[^0-9,.]", ""), F.lit(","), F.lit(".")).try_cast("double")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<.+?>", " ")


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?[^?]*$", "")


def absolute(url: Column, site: str) -> Column:
    return F.when(url.startswith("/"), F.concat(F.lit(site), url)).otherwise(url)


def search_url(site: str, term: Column) -> Column:
    return F.concat(F.lit(site), F.array_join(tokens(term), "%20"))


def image_name(i: Column, when: Column) -> Column:
    return F.concat(F.lit("image"), i.cast("string"), F.lit("_"), F.date_format(when, "ddMMyyyy"), F.lit(".jpeg"))
