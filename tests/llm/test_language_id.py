import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es or nt ea ti to st it".split(), "de": "sch ein ver keit ung ge be der ich ö ü ä ß te auf zu".split()}
FOREIGN = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
}


def prose(dice: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(dice.choice(SYLLABLES[lang]) for _ in range(dice.randint(1, 4))) for _ in range(words)).capitalize() + "."


@pytest.fixture(scope="module")
def model(spark):
    dice = random.Random(1)
    rows = [(k, prose(dice, lang, dice.choice((5, 20, 80, 300))), lang) for k, lang in enumerate(["en", "de"] * 60)]
    return language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))


def test_texts_of_languages_not_learnt_and_garbage_are_rejected(model):
    dice = random.Random(2)
    garbage = [" ".join("".join(dice.choice("bcdfghjklmnpqrstvwxz") for _ in range(dice.randint(3, 9))) for _ in range(n)) for n in (30, 1000)]
    coded = [base64.b64encode(dice.randbytes(n)).decode() for n in (150, 30000)]
    assert model.judge([*FOREIGN.values(), *garbage, *coded, "1234 !"])[2] == [True] * 8


def test_texts_of_learnt_languages_stay_whatever_their_length(model):
    dice = random.Random(3)
    texts = [(lang, prose(dice, lang, n)) for lang in SYLLABLES for n in (1, 2, 3, 10, 100, 2000) for _ in range(8)]
    names, _, rejected = model.judge([t for _, t in texts])
    assert sum(rejected) <= 1
    assert [n for (_, t), n in zip(texts, names) if len(t) > 60] == [lang for lang, t in texts if len(t) > 60]


def test_a_language_of_one_row_and_one_of_no_letters(spark):
    rows = [(1, "Kaikki ihmiset syntyvät vapaina", "fi"), (2, "123", "xx")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.judge(["ihmiset vapaina", None])[2] == [False, True]


def test_centroids_and_floors_come_from_all_learning_rows(spark):
    dice = random.Random(4)
    rows = [(k, prose(dice, lang, dice.choice((5, 20, 80, 300))), lang) for k, lang in enumerate(["en", "de"] * 60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), clusters=1, sample_per_language=6)
    for k, lang in enumerate(model.languages):
        vectors = [language_id.vector(t, model.idf) for _, t, l in rows if l == lang]
        total = np.sum(vectors, axis=0)
        assert np.allclose(model.centroids[k], total / np.linalg.norm(total), atol=1e-5)
        lows = {}
        for own, (_, t, _) in zip(vectors, (r for r in rows if r[2] == lang)):
            rest = (total - own) / np.linalg.norm(total - own)
            for head in language_id.beginnings(t):
                x = language_id.vector(head, model.idf)
                lows.setdefault(language_id.level(np.count_nonzero(x)), []).append(float(rest @ x))
        floors = [0.5 * min(min(v) for at, v in lows.items() if at >= n) for n in range(max(lows) + 1)]  # of so few rows the quantile is the least
        assert np.allclose(model.least[k][: len(floors)], floors, atol=1e-4)
