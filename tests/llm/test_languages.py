import random

import numpy as np
import pytest

from folioscope.llm import languages as L

SENTENCES = {
    "en": ["The company reported lower sales in the fourth quarter", "Management expects stable demand for gaskets next year", "Their warranty costs rose because of freight rates"],
    "de": ["Das Unternehmen meldete im vierten Quartal niedrigere Umsätze", "Der Vorstand erwartet für das kommende Jahr eine stabile Nachfrage", "Die Kosten für Gewährleistung stiegen wegen der Frachtkosten"],
    "fr": ["La société a publié au quatrième trimestre un chiffre d'affaires plus faible", "La direction prévoit une demande stable pour l'année prochaine", "Les coûts de garantie ont augmenté en raison de la hausse du fret"],
    "ja": ["同社は第四四半期に売上高の減少を発表しました。", "経営陣は来年度について安定した需要を予想しています。"],
    "ru": ["Компания сообщила о снижении выручки в четвёртом квартале", "Руководство ожидает стабильный спрос в следующем году"],
}


def corpus(n=60, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SENTENCES))
        label = lang if rng.random() > 0.15 else rng.choice(list(SENTENCES))
        out.append((label, "\n".join(rng.choice(SENTENCES[lang]) for _ in range(4))))
    return out


@pytest.fixture(scope="module")
def model():
    return L.fit(corpus(150))


def test_labels():
    for label in ("en", "EN", "en-US", "en_GB", "eng", "English", " english "):
        assert L.language_of_label(label) == "en"
    assert L.language_of_label("nld") == L.language_of_label("Dutch") == L.language_of_label("nl-NL") == "nl"
    assert L.language_of_label("sv-SE") == L.language_of_label("Swedish") == "sv"
    for label in (None, "", "und", "unknown", "xx", "klingon"):
        assert L.language_of_label(label) is None


def test_label_column_agrees(spark):
    labels = ["en", "EN", "pt-BR", "pt_br", "fra", "German", " ja ", "und", "", None, "unknown", "zh-CN", "qq-CN", "e", "en-"]
    df = spark.createDataFrame([(x,) for x in labels], "lang string")
    assert [r[0] for r in df.select(L.label_column("lang")).collect()] == [L.language_of_label(x) for x in labels]


def test_lines_held_out_upper_case_and_without_accents(model):
    unseen = {"en": "Management reported stable costs in the fourth quarter", "de": "Der vorstand meldete hohere kosten im kommenden jahr", "fr": "LA SOCIÉTÉ PRÉVOIT UNE HAUSSE DES COÛTS", "ja": "経営陣は売上高の減少を予想しています。", "ru": "РУКОВОДСТВО СООБЩИЛО О СНИЖЕНИИ СПРОСА"}
    for lang, line in unseen.items():
        [r] = model.lines(line)
        assert r["lang"] == lang and r["confidence"] > 0.6


def test_unseen_words_fall_back_to_letters(model):
    assert "nachfragen" not in model.rows and model.languages[int(model.unseen("nachfragen").argmax())] == "de"
    assert model.unseen("zzzzqqqq").shape == (len(model.languages),)


def test_figures_blank_and_null_have_no_language(model):
    assert model.lines("1,234 | 5.6%\n\n--- \n") == model.lines("") == model.lines(None) == []


SCHEMA = "doc_id bigint, text string, lang string, lines string"


def test_found_lines_stretches_and_documents(spark, model):
    mixed = "\n".join([SENTENCES["en"][0], "", SENTENCES["de"][0], "1,234", SENTENCES["de"][1], SENTENCES["en"][1]])
    rows = [(1, mixed, "English"), (1, mixed, "English"), (2, SENTENCES["fr"][0], None), (3, SENTENCES["ru"][0], "ru-RU"), (4, None, "en"), (5, "12 34", "en"), (6, SENTENCES["de"][2], "fra")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    lines = L.line_languages(df, model)
    assert sorted(tuple(r) for r in L.mislabelled_lines(lines).collect()) == [(1, 3, "de"), (1, 5, "de"), (2, 1, "fr"), (6, 1, "de")]
    runs = sorted({tuple(r)[:4] for r in L.stretches(lines).collect()})
    assert runs[:3] == [(1, 1, 1, "en"), (1, 3, 5, "de"), (1, 6, 6, "en")]
    docs = {r["doc_id"]: r for r in L.document_languages(lines).collect()}
    assert docs[1]["languages"] == ["de", "en"] and docs[4]["lang"] is None and docs[4]["confidence"] == 0.0 and docs[3]["lang"] == "ru"
    assert L.mislabelled_lines(L.line_languages(df.where("false"), model)).count() == 0


def test_sample_is_bounded_and_the_same_in_any_order(spark):
    rows = [(i, t, lang, "x") for i, (lang, t) in enumerate(corpus(200))]
    a = L.sample(spark.createDataFrame(rows, SCHEMA), each=5)
    b = L.sample(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), each=5)
    assert a == b and len(a) == 5 * len(SENTENCES)
    assert L.sample(spark.createDataFrame([], SCHEMA)) == [] and L.fit([]).lines("some words") != []


def test_a_script_that_one_language_has_is_evidence(model):
    for text in ("Да, выросла", "Выросла", "нe рaскрывaется"):  # unseen words; Latin letters inside Cyrillic ones
        [r] = model.lines(text)
        assert r["lang"] == "ru" and r["confidence"] > 0.9, text
    assert model.lines("Тhe соmраny")[0]["lang"] == "en"  # look-alikes inside Latin words


def lively(n=3000, seed=1):
    rng = random.Random(seed)
    return [(lang, " ".join(rng.sample(rng.choice(SENTENCES[lang]).split(" "), k=4))) for lang in [rng.choice(["en", "de", "fr", "ru"]) for _ in range(n)]]


SWEDISH = "Företaget rapporterade lägre försäljning under fjärde kvartalet och väntar sig högre kostnader"


def test_a_language_that_no_label_names_is_unknown(spark):
    model = L.fit(lively())
    assert model.lines(SWEDISH)[0]["lang"] == L.UNKNOWN and model.lines(SENTENCES["de"][0])[0]["lang"] == "de"
    df = spark.createDataFrame([(1, SWEDISH, "sv", "x"), (2, SWEDISH, "en", "x"), (3, SWEDISH, None, "x")], SCHEMA)
    assert sorted(tuple(r) for r in L.mislabelled_lines(L.line_languages(df, model)).collect()) == [(2, 1, "und"), (3, 1, "und")]


def test_languages_come_from_the_labels():
    swedish = [("sv", SWEDISH)] * 40
    assert L.fit(lively() + swedish).lines(SWEDISH)[0]["lang"] == "sv"
    wrong = [("sv", t) for lang, t in lively(60, 5) if lang == "en"]
    assert "sv" not in L.fit(lively() + wrong).languages


def test_lines_of_a_sampled_text_are_chosen_all_over_it(spark):
    text = "\n".join(f"line {i} " + "x" * 3000 for i in range(500))
    [(lang, got)] = L.sample(spark.createDataFrame([(1, text, "en", "x")], SCHEMA))
    lines = got.split("\n")
    assert lang == "en" and len(lines) == L.LINES and max(int(x.split(" ")[1]) for x in lines) > 400 and all(len(x) <= L.CHARS for x in lines)


def test_long_texts_in_one_pass(spark, model):
    text = "\n".join([SENTENCES["de"][0], SENTENCES["en"][0]] * 20_000)
    df = spark.createDataFrame([(1, text, "en", "x")], SCHEMA)
    assert L.stretches(L.line_languages(df, model)).count() == 40_000


def test_a_language_with_lines_in_another_ones_texts_is_no_wrong_label():
    english, russian = {"the": 90_000, "sales": 40_000, "of": 70_000}, {"продаж": 500, "рост": 400, "заводах": 300}
    mixed = L.Counter(english | {w: n // 20 for w, n in russian.items()})
    size = L.Counter(en=20_000, ru=200, sv=150)
    assert L._named(L.defaultdict(L.Counter, en=mixed, ru=L.Counter(russian), sv=L.Counter(the=90, sales=40, of=70)), size) == ["en", "ru"]


def test_held_out_lines_are_weighed_together(model, monkeypatch):
    held = [(lang, t.lower().split(" ")[:n], 1 + n % 3) for n, (lang, t) in enumerate(corpus(60), 1)] + [("xx", ["unsure"], 2), ("de", ["qqq", "absatz"], 1)]
    apart = [L._suits(model, [x]) for x in held]

    def log(fallback, smooth):  # by each line and its first words, as texts are scored
        weighed = L.LanguageModel(model.languages, model.words, model.grams, model.scripts, fallback, smooth)
        parts = [(lang, ws[:k], n) for lang, ws, n in held if lang in model.languages for k in (1, 2, 3, len(ws))]
        return sum(n * np.log(weighed.posterior(ws)[model.languages.index(lang)]) for lang, ws, n in parts)

    for at_once in (L.WEIGHED, 30):
        monkeypatch.setattr(L, "WEIGHED", at_once)
        logs, parts, lines, least = L._suits(model, held)
        assert logs == pytest.approx([log(*x) for x in L._TRIED]) and logs == pytest.approx([sum(x) for x in zip(*[a[0] for a in apart])])
        assert (parts, lines, least) == (sum(a[1] for a in apart), sum(a[2] for a in apart), min(a[3] for a in apart))
    assert L._suits(model, []) == ([0.0] * len(L._TRIED), 0, 0, 1.0)


def test_lines_are_those_of_each_line():
    texts = ["Sales rose,\n\n (5) \n_a1b\u3000c", "", "\n", "売上高は増加 of\tsales\nТhe соmраny\rДа", "ΟΔΟΣ:Β x\u0301 \u0301a İz ΑΣ\u00adΒ"]
    for text in texts:
        assert L._lines_of(text) == [" ".join(ws) for line in text.split("\n") if (ws := L.words_of(line))]
