import unicodedata

import pytest
from pyspark.sql import functions as F

from townpulse.functions import text as T


def test_clean_text_keeps_letters_of_any_script(values):
    assert values(
        T.clean_text("text"),
        ["Привет, Мир! Ёлка_1", "don't—stop NOW", "Ça va? №5", ""],
    ) == ["привет мир ёлка_1", "dontstop now", "ça va 5", ""]


def test_clean_text_on_decomposed_letters_drops_only_marks(values):
    composed, apart = "й", unicodedata.normalize("NFD", "й")
    assert values(T.clean_text("text"), [composed, apart]) == ["й", "и"]


def test_links_with_and_without_scheme(values):
    assert values(
        T.remove_links("text"),
        ["см. https://a.b/c?d=1 тут", "www.site.ru/x", "http://a\nb", "no link", "awww. ok"],
    ) == ["см.   тут", " ", " \nb", "no link", "awww. ok"]


def test_emojis_modifiers_joiners_flags(values):
    family = "\U0001f468‍\U0001f469‍\U0001f467"
    assert values(
        T.remove_emojis("text"),
        ["ок \U0001f44d\U0001f3fd!", f"{family}", "\U0001f1f7\U0001f1fa флаг", "☀️ день", "1 а"],
    ) == ["ок  !", " ", "  флаг", "  день", "1 а"]


def test_words_split_on_unicode_space(values):
    assert values(T.words("text"), ["", " a b \t\n c ", " "]) == [[], ["a", "b", "c"], []]


def test_terms_need_two_characters(values):
    assert values(T.terms("text"), ["я не a ok _x"]) == [["не", "ok", "_x"]]


def test_stop_words_keep_order_and_repeats(spark, values):
    stop = T.stop_words(spark, "russian")
    assert len(stop) > 100 and "и" in stop
    assert values(T.remove_stopwords("text", stop), ["дом и сад и дом"]) == ["дом сад дом"]
    assert values(T.remove_stopwords("text", []), ["a  b"]) == ["a b"]


WORDS = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12".split()


@pytest.mark.parametrize(
    "count, exact, clean",
    [
        (0, "<br>", ""),
        (3, "<br>w1 w2 w3<br>", "w1 w2 w3"),
        (5, "<br>", "w1 w2 w3 w4 w5"),
        (7, "w1 w2 w3 w4 w5<br>w6 w7<br>", "w1 w2 w3 w4 w5<br>w6 w7"),
        (10, "w1 w2 w3 w4 w5<br>", "w1 w2 w3 w4 w5<br>w6 w7 w8 w9 w10"),
        (
            12,
            "w1 w2 w3 w4 w5<br>w6 w7 w8 w9 w10<br>w11 w12<br>",
            "w1 w2 w3 w4 w5<br>w6 w7 w8 w9 w10<br>w11 w12",
        ),
    ],
)
def test_wrap_label(values, count, exact, clean):
    label = " ".join(WORDS[:count])
    assert values(T.wrap_label("text", 5, "exact"), [label]) == [exact]
    assert values(T.wrap_label("text", 5), [label]) == [clean]


def test_wrap_label_leaves_broken_labels_alone(values):
    assert values(T.wrap_label("text", 2), ["a b c<br>", None]) == ["a b c<br>", None]
    with pytest.raises(ValueError):
        T.wrap_label("text", 2, "other")


def test_exact_wrapping_can_merge_labels_clean_does_not(values):
    ten = ["a b c d e f g h i j", "a b c d e k l m n o"]
    assert len(set(values(T.wrap_label("text", 5, "exact"), ten))) == 1
    assert len(set(values(T.wrap_label("text", 5), ten))) == 2


def test_series_name_and_word_line(values):
    assert values(T.series_name("text"), ["дороги, ямы, лёд"]) == ["дороги - ямы - лёд"]
    assert values(T.word_line(T.words("text"), 2), ["a b c"]) == ["a | b"]


def test_answer_text_reads_both_shapes(values):
    assert values(
        T.answer_text("text"),
        [
            '{"choices":[{"text":" тема "}]}',
            '{"choices":[{"message":{"content":"дороги"}}]}',
            '{"error":1}',
            "not json",
        ],
    ) == [" тема ", "дороги", None, None]


def test_text_functions_stay_in_the_jvm(spark):
    rows = spark.createDataFrame([("a",)], "text string")
    ready = T.remove_stopwords(T.clean_text(T.remove_emojis(T.remove_links("text"))), ["a"])
    plan = rows.select(F.lit(1), ready)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
