"""Text clean-up, words and labels, as built-in expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed patterns. Unicode white space and word characters are spelled out since
# \s and \w mean ASCII only in Java.
SPACE = r"\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
LINK = rf"(https?://|www\.)[^{SPACE}]+"
EMOJI = (
    r"[\x{2000}-\x{10FFFF}&&["  # one comparison settles most letters
    r"\x{1F300}-\x{1FAFF}"  # pictographs, faces, transport, skin tones
    r"\x{1F1E6}-\x{1F1FF}"  # flags
    r"\x{2600}-\x{27BF}"  # symbols and dingbats
    r"\x{2B00}-\x{2BFF}"  # arrows and stars
    r"\x{1F000}-\x{1F0FF}"  # tiles and cards
    r"\x{E0020}-\x{E007F}"  # flag tags
    r"\x{FE0F}\x{200D}\x{20E3}"  # variation selector, joiner, keycap
    "]]+"
)
BREAK = "<br>"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def remove_links(text) -> Column:
    return F.regexp_replace(_col(text), LINK, " ")


def remove_emojis(text) -> Column:
    return F.regexp_replace(_col(text), EMOJI, " ")


def clean_text(text) -> Column:
    """Lower case; everything but word characters and white space goes."""
    return F.regexp_replace(F.lower(_col(text)), f"[^{WORD}{SPACE}]", "")


def words(text) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(_col(text), f"[{SPACE}]+"), lambda w: w != "")


def terms(text, stop: list[str] = ()) -> Column:
    """Words of at least two characters other than ``stop``, of text that went
    through ``clean_text``."""
    pieces = F.split(_col(text), f"[{SPACE}]+")
    if not stop:
        return F.filter(pieces, lambda w: F.length(w) >= 2)
    return F.filter(pieces, lambda w: (F.length(w) >= 2) & ~w.isin(list(stop)))


def remove_stopwords(text, stop: list[str]) -> Column:
    pieces = F.split(_col(text), f"[{SPACE}]+")
    if not stop:
        return F.array_join(words(text), " ")
    return F.array_join(F.filter(pieces, lambda w: (w != "") & ~w.isin(list(stop))), " ")


def stop_words(spark: SparkSession, language: str = "russian") -> list[str]:
    """The stop-word list Spark ships for ``language`` (about 150 words)."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)


def wrap_label(text, every: int = 5, mode: str = "clean") -> Column:
    """Break a label into lines of ``every`` words, joined by ``<br>``.

    ``clean`` keeps all words and adds no break at the ends. ``exact`` gives the
    lines of the original report: a break also after the last line, a leading
    break when there is no full line before it, and the last ``every`` words
    lost when the word count is a multiple of ``every``. Text that already holds
    a break is left alone.
    """
    if mode not in ("clean", "exact"):
        raise ValueError(f"unknown mode {mode!r}")
    column = _col(text)

    def wrap(parts: Column) -> Column:
        if mode == "clean":
            return F.regexp_replace(_lines(parts, every), f"({BREAK}| )$", "")
        count = F.size(parts)
        kept = F.when(count % every != 0, count).otherwise(F.greatest(count - every, F.lit(0)))
        body = F.regexp_replace(_lines(F.slice(parts, F.lit(1), kept), every), " $", BREAK)
        return F.concat(F.when(count <= every, BREAK).otherwise(""), body)

    # the one-element array has the words split once however often they are used
    wrapped = F.transform(F.array(words(column)), wrap)[0]
    return F.when(column.contains(BREAK), column).otherwise(wrapped)


def _lines(word_array: Column, every: int) -> Column:
    """All words, a break after each full line and a space after the others."""
    ended = F.transform(
        word_array,
        lambda w, i: F.concat(w, F.when((i + 1) % every == 0, BREAK).otherwise(" ")),
    )
    return F.array_join(ended, "")


def series_name(text) -> Column:
    """``a, b`` shown as ``a - b``."""
    return F.replace(_col(text), F.lit(", "), F.lit(" - "))


def word_line(word_array, count: int = 10) -> Column:
    """The first ``count`` words with bars between them."""
    return F.array_join(F.slice(_col(word_array), 1, count), " | ")


def answer_text(answer) -> Column:
    """The text of a stored naming answer, in either of its two JSON shapes."""
    column = _col(answer)
    return F.coalesce(
        F.get_json_object(column, "$.choices[0].text"),
        F.get_json_object(column, "$.choices[0].message.content"),
    )
