import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.language import _BITS, _BYTES, CharModels, document_languages, fit_models, language_stretches, named_language

SENTENCES = {
    "en": "the old baker opens the shop before sunrise|we walked along the river with our neighbours|nobody knows whether the train will arrive today|she keeps every letter in a wooden box|they should think about what the children need|this kitchen smells of fresh bread and coffee".split("|"),
    "de": "der alte bäcker öffnet den laden vor sonnenaufgang|wir gingen mit unseren nachbarn am fluss entlang|niemand weiß ob der zug heute noch ankommt|sie bewahrt jeden brief in einer kiste auf|man sollte überlegen was die kinder brauchen|diese küche riecht nach frischem brot und kaffee".split("|"),
    "fr": "le vieux boulanger ouvre la boutique avant le lever du soleil|nous avons marché le long de la rivière avec nos voisins|personne ne sait si le train arrivera aujourd'hui|elle garde chaque lettre dans une boîte en bois|il faudrait penser à ce dont les enfants ont besoin|cette cuisine sent le pain frais et le café".split("|"),
}
DOC = "doc_id long, text string, lang string, named string, language string"


def text(rng, language, n):
    return ". ".join(" ".join(rng.sample(w := rng.choice(SENTENCES[language]).split(), len(w))) for _ in range(n)) + "."


def documents(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        language = rng.choice(list(SENTENCES))
        label = language if rng.random() > 0.1 else rng.choice(["en", "de", "fr"])
        rows.append((i, text(rng, language, 8), label, language))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, label, "x", "y") for i, t, label, *_ in rows], DOC)


def test_probabilities_sum_to_one():
    words = Counter("the then they this that thing bath bathe thé".split())
    models = CharModels(["a", "b"], 4, {c: i + 3 for i, c in enumerate(sorted(set("".join(words)) - {"é"}))}).fit({"a": words, "b": Counter(["other", "hot"])})
    symbols = [*models.alphabet.values(), *range(_BYTES, 1 << _BITS), 2]
    for context in ([1, models.alphabet["t"], models.alphabet["h"]], [models.alphabet["b"], models.alphabet["a"], models.alphabet["t"]], [3, 3, 3]):
        key = np.array([(((context[0] << _BITS | context[1]) << _BITS) | context[2]) << _BITS | c for c in symbols], np.uint64)
        total = models._prob(key, 4).sum(axis=0)
        assert np.allclose(total, 1, atol=1e-4), (context, total)
    score = models.score(["the", "hot", "unseenword", "語"])
    assert score[0].argmax() == 0 and score[1].argmax() == 1 and np.isfinite(score).all() and len(models.score([])) == 0
    with pytest.raises(ValueError):
        CharModels(["a"], 6, {})


def test_scripts_of_thousands_of_characters(spark):
    rng = random.Random(4)
    scripts = {"zh": range(0x4E00, 0x4E00 + 10_000, 2), "ja": range(0x4E01, 0x4E01 + 10_000, 2)}
    say = lambda k: ". ".join(" ".join("".join(chr(rng.choice(scripts[k])) for _ in range(3)) for _ in range(12)) for _ in range(12)) + "."
    rows = [(i, say(k), k, k) for i, k in enumerate(["zh", "ja"] * 120)] + [(1000 + i, say(k), None, k) for i, k in enumerate(["zh", "ja"] * 40)]
    best = {r["doc_id"]: (r["lang"], r["share"]) for r in document_languages(language_stretches(frame(spark, rows))).orderBy("share").collect()}
    assert sum(best[i][0] == truth for i, _, _, truth in rows if i >= 1000) >= 76


def test_held_out_accuracy_with_wrong_labels(spark):
    rows = documents()
    found = document_languages(language_stretches(frame(spark, rows))).collect()
    best = {}
    for r in found:
        if r["share"] > best.get(r["doc_id"], (None, 0))[1]:
            best[r["doc_id"]] = (r["lang"], r["share"], r["confidence"])
    assert sum(best[i][0] == truth for i, _, _, truth in rows) / len(rows) >= 0.99
    assert np.mean([best[i][2] for i, *_ in rows]) > 0.95
    assert all(0.999 < sum(r["share"] for r in found if r["doc_id"] == i) < 1.001 for i in (0, 1, 2))


def test_mixed_documents_and_rejection(spark):
    rng = random.Random(9)
    mixed = [(1000, text(rng, "en", 6) + "\n" + text(rng, "fr", 3), None), (1001, "zqx wvk qqzt xxv zzkw qvx zkqx wwx qqk. " * 20, None)]
    got = language_stretches(frame(spark, documents() + mixed)).filter("doc_id >= 1000").orderBy("doc_id", "stretch").collect()
    assert [(r["lang"], r["stretch"]) for r in got if r["doc_id"] == 1000] == [("en", 0), ("fr", 1)]
    assert {r["lang"] for r in got if r["doc_id"] == 1001} == {"und"} and all(r["confidence"] == 0 for r in got if r["doc_id"] == 1001)
    first = [r for r in got if r["doc_id"] == 1000]
    assert first[0]["first_word"] == 0 and first[1]["first_word"] == first[0]["n_words"]


def test_edges(spark):
    edge = [(2000, None, "en"), (2001, "", "en"), (2002, "123 ... !!!", None), (2003, text(random.Random(1), "de", 20_000), "xx"), (2004, "ok", "EN")]
    got = language_stretches(frame(spark, documents() + edge)).filter("doc_id >= 2000").collect()
    assert {r["doc_id"] for r in got} == {2003, 2004} and {r["lang"] for r in got if r["doc_id"] == 2003} == {"de"}
    assert language_stretches(frame(spark, [])).count() == 0
    assert fit_models(frame(spark, [(1, "no label at all", None)])) is None
    assert document_languages(language_stretches(frame(spark, []))).count() == 0


@pytest.mark.parametrize("label,code", [("en", "en"), ("EN", "en"), ("en-GB", "en"), ("en_US", "en"), ("eng", "en"), ("English", "en"), ("Deutsch", "de"), ("ger", "de"), ("de_AT", "de"), ("pt-BR", "pt"), ("Français", "fr"), (" it ", "it"), ("xx", None), ("und", None), ("unknown", None), ("", None), (None, None), ("zxx", None)])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "lang string").select(named_language(F.col("lang"))).first()[0] == code
