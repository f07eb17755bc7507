import pytest

from folioscope.llm import languages as L
from folioscope.llm import pairs as P
from llm.test_languages import SENTENCES, corpus

Q = "What drove the change in capital spending of the Rail Systems segment at Velmora in FY2012?"
CLEAN = [
    "Capital spending rose because of higher freight rates.", "Capital spending fell following port congestion.", "Demand for polished films weakened in Oriva.", "The company sells valves and polished films.",
    "Higher freight rates reduced the gross margin of Rail Systems.", "Management expects that labor stoppages will weigh on the capital spending of the segment.", "The amortization of software rose.", "Manufacturing and the consolidation of plants continued.",
    "We operate sites near Oriva; their costs rose after port congestion.",
] * 3


@pytest.fixture(scope="module")
def models():
    spoken = L.fit(corpus(150) + [("en", "\n".join(CLEAN))] * 2)
    return spoken, P.TerminalModel.fit(CLEAN + [t for _, t in corpus(80)])


def kind(models, answer, question=Q, flag=None):
    return P.defect(question, answer, flag, P.CopyDetector(question or ""), *models)


@pytest.mark.parametrize("text", [None, "", "  \n", "​", "-", "--", "...", "**", "{}", "[ ]", "```\n```", "<answer></answer>", "N/A", "n/a", "null", "TBD", " **null** "])
def test_empty(models, text):
    assert kind(models, text) == "empty"


@pytest.mark.parametrize("text", [Q, Q.lower().rstrip("?") + ".", f"**{Q}**\n", f'You asked: "{Q}"', f"{Q} {Q}", Q.rstrip("?"), Q.replace("a", "а")])
def test_copies(models, text):
    assert kind(models, text) == "copies_question"


@pytest.mark.parametrize("text", ["I don't know.", "**Answer:** I cannot answer this from the passages given.", "Thank you for the question. The provided filings do not contain the answer to this question about Velmora. Please consult the full filing.", "After reviewing the passages: No answer can be given: none of the retrieved pages discusses Optics. More pages would be needed.", "As an automated assistant I am not able to give financial advice.", "I'm afraid I must decline to comment on Velmora.", "Unable to determine capital spending on the basis of the context.", "This information isn’t available in the supplied documents.", "Dazu liegen keine Angaben vor."])
def test_refusals(models, text):
    assert kind(models, text) == "refusal"


def test_copies_are_decided_by_the_bytes_left(models, monkeypatch):
    gold = [(Q, t) for t in CLEAN]
    most = P.CopyDetector.fit(gold)
    d = P.CopyDetector(Q, most)
    assert all(d.is_copy(t) for t in (Q, f"You asked: {Q}", f"Question: {Q}")) and not any(d.is_copy(f"{Q} {t}") or d.is_copy(t) for t in CLEAN)
    assert d.left(Q) == 0 < d.left(f"{Q} Optics and Rail") and not d.is_copy(f"{Q} Yes") and not d.is_copy(f"{Q} 12.5%") and not d.is_copy("What drove the change?")
    monkeypatch.setattr(P.CopyDetector, "left", lambda self, response: 0)
    assert any(d.is_copy(f"{Q} {t}") for t in CLEAN)  # without compression answers pass for copies
    assert P.CopyDetector.fit([]) == P.BYTES_LEFT


def test_the_terminal_model_decides(models):
    _, terminal = models
    assert terminal.ends("because", "of") < 0.03 < terminal.ends("freight", "rates") and terminal.ends("fell", ",") < 0.03
    assert P.shape("12,345.67") == P.shape("7.5") == "9.9" and P.shape("4,1") == "9,9" and P.shape("1,234") == P.shape("7") == "9" and P.shape(",") == ","
    bare = [t.rstrip(".") for t in CLEAN]
    assert not any(P.breaks_off(t, terminal) for t in bare)
    assert any(P.breaks_off(t, P.TerminalModel()) for t in bare)  # a model that has seen nothing takes them for broken


@pytest.mark.parametrize("text", ["Да, выросла.", "Выросла", SENTENCES["ru"][1].split(" ")[0] + " спрос"])
def test_short_answers_in_another_script(models, text):
    assert kind(models, text) == "other_language"


@pytest.mark.parametrize("text", ["<" + "a" * 500 + "></x>", "<p class='" + "b " * 300 + "'>"])
def test_long_markup_is_empty(models, text):
    assert kind(models, text) == "empty"


@pytest.mark.parametrize("text", ["2.61 per cent", "0.8136 per cent (FY2012: 0.5 per cent)", "83,659.5 m2", "in thousands of US dollars, 20,228.8"])
def test_figures_have_no_language(models, text):
    assert kind(models, text) is None


@pytest.mark.parametrize("text", [SENTENCES["de"][1] + ".", SENTENCES["fr"][2] + ".", SENTENCES["ja"][0], SENTENCES["ru"][0] + "."])
def test_other_languages(models, text):
    assert kind(models, text) == "other_language"


@pytest.mark.parametrize("text", ["Capital spending rose because of the", "Capital spending fell,", "Demand weakened (including", "Capital spending fell, of which $", "Sales of valves and amort", "Demand for polished", "The points are. The remaining\n- **Rail Systems", "Capital spending rose to $4,1", "Capital spending fell following port congestion and its", "Manufacturing and the consoli"])
def test_truncated(models, text):
    assert kind(models, text) == "truncated"


@pytest.mark.parametrize(
    "text",
    [
        "Capital spending rose because of higher freight rates.", "Rail Systems and Cold Chain", "The main points are:\n- polished films\n- port congestion\n- higher freight rates", "$12.5 million", "197.4 (dollars in millions)", "(FY2012: $9,131.)", "26.04 mi", "Yes", "No.",
        "The filings do not break this out for Oriva, but at group level the picture is clear. Capital spending fell following port congestion.", "Capital spending is not a metric that this company reports; as a lender it manages the gross margin instead.",
        f"{Q} Capital spending rose because of higher freight rates.", "There were none in the period.", "Film Coatings nettle syringes, Oriva: capital spending, port congestion 6,635 6,637", "44.82%",
    ],
)
def test_sound_answers(models, text):
    assert kind(models, text) is None
    assert kind(models, text, flag=True) is None


def test_answers_in_the_question_s_language(models):
    german = "Der Vorstand erwartet im kommenden Jahr was für eine Nachfrage?"
    assert kind(models, SENTENCES["de"][2] + ".", german) is None
    assert kind(models, "Management expects stable demand for gaskets next year.", german) == "other_language"
    assert kind(models, "Capital spending rose because of the", None) == "truncated"


def test_over_a_table(spark, models):
    rows = [("a", Q, None, None, 1), ("a", Q, None, None, 1), ("b", Q, "I don't know.", False, 1), ("c", Q, "Rail Systems and Cold Chain", True, 1), ("d", None, "Capital spending rose because of the", None, 1), ("f", Q, "Sorry.", True, 1), ("g", Q, "Sorry.", None, 1), (None, Q, "-", True, 1), ("e", Q, "Capital spending fell. " * 30_000, False, 1)]
    df = spark.createDataFrame(rows, "grade_id string, question string, generated_answer string, insufficient_evidence boolean, defect int")
    got = sorted((r["grade_id"] or "", r["defect"]) for r in P.defects(df, df, *models).collect())
    assert got == [("", "empty"), ("a", "empty"), ("b", "refusal"), ("d", "truncated"), ("f", "refusal")]
    assert P.defects(df.where("false"), df, *models).count() == 0


def test_models_are_of_all_documents_and_gold_answers(spark):
    texts = corpus(400) + [("en", "\n".join(CLEAN))]
    rows = [(i, label, t) for i, (label, t) in enumerate(texts)] + [(9000, None, "a label is missing here"), (9001, "en", None)]
    documents = spark.createDataFrame(rows, "doc_id int, lang string, text string").repartition(3)
    gold = [(f"What was figure {i} of the plant?", f"{i} units of steel") for i in range(3100)]
    graded = spark.createDataFrame([*gold, *gold[:50], ("q", None)], "question string, gold_answer string")
    spoken, terminal, most = P.models(documents, graded)
    whole, every = L.fit(texts), P.TerminalModel.fit([t for _, _, t in rows if t] + [a for _, a in gold])
    assert (spoken.languages, spoken.words.keys(), spoken.fallback, spoken.smooth) == (whole.languages, whole.words.keys(), whole.fallback, whole.smooth)
    assert all(abs(spoken.words[w] - v).max() < 1e-9 for w, v in whole.words.items()) and abs(spoken.strange - whole.strange) < 1e-9
    assert terminal == every and terminal.one["units"][0] >= 3100
    assert most == P.CopyDetector.fit(gold)


ODD = ["Sales rose, 5,1 and 5,1 (2%).\nCosts fell", "ΑΣ:Β ΟΔΟΣ. İx a’b\n^ c ^", "___", "a_b\n__", "x\u0301 \u0301a  o’n-e\u200b\u3000two\n\u200b \n", "", "y!z.\n\n\n3;", "売上高 増加。 a;b"] * 2


def test_contexts_are_those_of_each_token(monkeypatch):
    seen, ended = P.defaultdict(P.Counter), P.defaultdict(P.Counter)
    for text in ODD:  # one token after the other
        for line in P.reading_form(text).rstrip().split("\n"):
            tokens = [t.lower() for t in P._TOKEN.findall(line)]
            for before, t, after in zip(["^", *tokens], tokens, [*tokens[1:], "."]):
                if t[0].isalpha():
                    for kind, item in ((P.WORD, t), (P.PAIR, f"{before} {t}")):
                        seen[kind][item] += 1
                        ended[kind][item] += after in ".;!?。"
                else:
                    seen[P.MARK][P.shape(t)] += 1
        if tokens and not tokens[-1][0].isalpha():
            ended[P.MARK][P.shape(tokens[-1])] += 1
    assert P.TerminalModel.fit(ODD) == P.TerminalModel.of(seen, ended)
    monkeypatch.setattr(P, "AT_ONCE", 3)  # in many parts
    assert P.TerminalModel.fit(ODD) == P.TerminalModel.of(seen, ended)


def test_a_word_that_comes_again_is_read_once(monkeypatch):
    read = []
    monkeypatch.setattr(P, "reading_form", lambda text: read.append(text) or text)
    monkeypatch.setattr(L, "same_alphabet_form", lambda text: read.append(text) or text)
    texts = ["\n".join(f"Qvarna{i % 50} zelubo{i % 30}" for i in range(k, k + 200)) for k in range(100)]
    P.TerminalModel.fit(texts)
    assert len(L.fit([("en", t) for t in texts]).words) == 2
    assert sum(map(len, read)) < sum(map(len, texts)) / 10


def test_pairs_are_judged_together(models, monkeypatch):
    spoken, terminal = models
    answers = [None, "-", Q, "I don't know.", "Sorry.", "", "Да, выросла.", SENTENCES["de"][1] + ".", "Capital spending fell,", "44.82%", *CLEAN, *[t for _, t in corpus(60)]]
    questions = [Q, None, ""] * (len(answers) // 3) + [Q] * (len(answers) % 3)
    each = [tuple(P.defect(q, a, flag, P.CopyDetector(q or ""), spoken, terminal) for flag in (False, True)) for q, a in zip(questions, answers)]
    calls, posteriors = [], L.LanguageModel.posteriors
    monkeypatch.setattr(L.LanguageModel, "posteriors", lambda self, *x: calls.append(1) or posteriors(self, *x))
    assert P.found(questions, answers, P.BYTES_LEFT, spoken, terminal) == each and len(calls) == 2
    monkeypatch.setattr(P, "CHARS_AT_ONCE", 50)
    assert P.found(questions, answers, P.BYTES_LEFT, spoken, terminal) == each
    assert P.found([], [], P.BYTES_LEFT, spoken, terminal) == []
