import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.llm import languages as L

EN = "The office phone is answered by a person. We keep our prices on the wall every day. Bring a photo of the problem with you. Our crew also takes on window cleaning for homes."
DE = "Unsere Preise hängen immer an der Wand. Die Werkstatt liegt hinter der alten Mühle. Bringen Sie ein Foto vom Schaden mit. Sonntags haben wir leider geschlossen."
RU = "Цены висят на стене каждый день. Принесите фотографию поломки с собой. Мастерская стоит за старой мельницей. По воскресеньям мы закрыты."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lab, "clash") for i, (t, lab) in enumerate([(EN, "en"), (DE, "German"), (RU, "ru-RU")] * 20)]
    rows += [(100, EN, "de", ""), (101, DE, None, ""), (102, EN + "\n" + DE, "en", ""), (103, "", None, ""), (104, None, None, ""), (105, "12345 | 555-1234", "en", ""), (106, RU, "xx", ""), (107, EN, "en_GB", ""), (108, EN + " 7:30 https://a.example/der/die/das", "English", ""), (109, (DE + " ") * 500, "n/a", ""), (101, DE, None, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, main string")


def test_found(docs):
    m = L.train(docs)
    got = {tuple(r) for r in L.found(L.by_document(L.classify(docs, m))).collect()}
    assert got == {(100, "en"), (101, "de"), (102, "en"), (102, "de"), (106, "ru"), (109, "de")}


def test_empty(docs):
    none = docs.limit(0)
    assert L.found(L.by_document(L.classify(none, L.train(none)))).count() == 0


def test_labels(spark):
    labs = ["en", "EN", "eng", "en_GB", "fr-CA", "Spanish", " Deutsch ", "und", "xx", "n/a", "", None, "unknown", "zh-CN", "tlh-Latn"]
    df = spark.createDataFrame([(x,) for x in labs], "lang string").select(L.label_code(F.col("lang")).alias("c"))
    assert [r.c for r in df.collect()] == ["en", "en", "en", "en", "fr", "es", "de", None, None, None, None, None, None, "zh", None]


def test_grams_do_not_cross_sentences():
    both, one = L.grams(["ab cd", "ef gh"]), L.grams(["ab cd"])
    assert np.array_equal(both[0], one[0]) and both[0].sum() > 0
