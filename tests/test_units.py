import math
import random
from itertools import product

import numpy as np
import pytest

from folioscope.operators import units as u
from folioscope.operators.units import asked_unit, branches, common_units, quantities, same_figure_other_unit


def factors(text):
    return [(k, n, f) for _, k, n, f in quantities(text)]


@pytest.mark.parametrize(
    "text, kind, number, factor",
    [
        ("$563,191", "money", 563191, 0),
        ("US$9,131,142 in whole dollars", "money", 9131142, 1),
        ("2.084bn USD", "money", 2.084, 1e9),
        ("(0.7878)bn USD", "money", -0.7878, 1e9),
        ("$(30818)M", "money", -30818, 1e6),
        ("$-9.5 million", "money", -9.5, 1e6),
        ("-186570 (in thousands of dollars).", "money", -186570, 1e3),
        ("(10,516) (dollars in millions)", "money", -10516, 1e6),
        ("(in millions) $14,871", "money", 14871, 1e6),
        ("in thousands of US dollars, 33,742,225", "money", 33742225, 1e3),
        ("USD 409,392 (000s)", "money", 409392, 1e3),
        ("62.56 million pounds", "weight", 62.56, 453592.37),
        ("1.430 kt", "weight", 1.43, 1e6),
        ("60,940 t", "weight", 60940, 1e3),
        ("a ratio of 0.6241", "share", 0.6241, 1),
        ("0.1029 (expressed as a decimal)", "share", 0.1029, 1),
        ("6,472bp", "share", 6472, 1e-4),
        ("9 per cent", "share", 9, 0.01),
        ("7,178 thousand barrels", "volume", 7178, 158.987294928),
        ("13,133,549 sq. ft. for the year.", "area", 13133549, 0.09290304),
        ("**26.04 mi**, as stated on page 65", "length", 26.04, 1609.344),
        ("34212 GJ", "energy", 34212, 1e3 / 3.6),
        ("11.65 yrs.", "term", 11.65, 12),
        ("the figure was ９.５ ｋｍ", "length", 9.5, 1e3),
    ],
)
def test_figures_with_units(text, kind, number, factor):
    [(k, n, f)] = factors(text)
    assert (k, n) == (kind, number) and math.isclose(f, factor, rel_tol=1e-9)


def test_years_and_pages_are_no_quantities():
    assert factors("for the year ended December 31, 2014; see page 12 and FY2013, p. 7") == []
    assert factors(None) == factors("") == []


def test_unit_of_the_question():
    assert asked_unit("What was it? (USD millions)") == ("money", 1e6)
    assert asked_unit("Answer in USD thousands.") == ("money", 1e3)
    assert asked_unit("Give the figure in billions of US dollars.") == ("money", 1e9)
    assert asked_unit("Give it in square feet.") == ("area", 0.09290304)
    assert asked_unit("What was the goodwill in FY2013?") is None and asked_unit(None) is None


def test_a_label_far_from_its_number_counts():
    assert factors("see page" + " " * 60 + "12") == [] and factors("note     7, 8 says 5 km") == [("length", 5.0, 1e3)]


def cost(path, numbers, costs, states):
    total = 0.0
    for i, (k, n) in enumerate(zip(path, numbers)):
        if i:
            j, before = path[i - 1], numbers[i - 1]
            if n and before:
                total += min((math.log(abs(n) * states[k]) - math.log(abs(before) * states[j])) ** 2 / (2 * u.WALK**2), u.OUTLIER)
            total += costs[i][k] - (0 if j == k else math.log(u.SWITCH))
    return total


def test_viterbi_is_the_cheapest_path():
    rng = random.Random(1)
    states = [1.0, 1e3, 1e6, 1e9]
    for _ in range(60):
        numbers = [rng.choice([0.0, 1.7, 1700.0, -1.69, 5.0, 5000.0, 2e6]) for _ in range(rng.randrange(1, 5))]
        costs = np.array([[rng.choice([0.0, 4.0, 14.0]) for _ in states] for _ in numbers])
        score, paths = branches(numbers, costs, states)
        for first in range(4):
            best = min(cost((first, *rest), numbers, costs, states) for rest in product(range(4), repeat=len(numbers) - 1))
            assert math.isclose(-score[first], best, abs_tol=1e-9) and math.isclose(cost(paths[first], numbers, costs, states), best, abs_tol=1e-9)


COLUMNS = "grade_id string, qid string, question string, gold_answer string, generated_answer string, extra int"


def figures(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], COLUMNS)
    return {r["grade_id"]: [(f["field"], f["factor"]) for f in r["figures"]] for r in common_units(df).collect()}


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], COLUMNS)
    return sorted(r[0] for r in same_figure_other_unit(common_units(df)).collect())


def test_found_pairs(spark):
    rows = [
        ("a", "q1", "How much?", "$5,000 thousand", "It was $5.0 million."),
        ("b", "q1", "How much?", "$5,000 thousand", "It was $5,000K."),  # another spelling
        ("c", "q1", "How much?", "$5,000 thousand", "It was $5.2 million."),  # another value
        ("d", "q2", "How much? (USD millions)", "$12.5", "$12,500 thousand"),  # the question's unit
        ("e", "q2", "How much? (USD millions)", "$12.5", "USD 12.5 million"),
        ("f", "q3", "How heavy?", "7 kilotonnes", "7 thousand tonnes"),
        ("g", "q3", "How heavy?", "7 kilotonnes", "15,432,358 lb"),
        ("h", "q4", "How long?", "(66.57) quarters", None),
        ("i", None, None, "24 months", "2 years, or 24 months"),
        ("i", None, None, "24 months", "2 years, or 24 months"),  # repeated
        ("j", "q5", "", "$(3.5) billion", "-$3,500 million"),
        ("k", "q5", "", "$(3.5) billion", "$3,500 million"),  # another sign
        ("l", "q6", "", "", "$1"),
        ("m", "q7", "How much?", "$1.704B", "1.704 dollars"),  # the number alone is no figure
        ("n", "q8", "How much?", "0%", "0 bps"),
    ]
    want = ["a", "d", "g", "i", "j", "n"]
    assert found(spark, rows) == want
    assert found(spark, rows * 300) == want  # the same for a question with thousands of answers
    assert found(spark, [r for r in rows if r[0] == "?"]) == []


def test_long_texts_and_values(spark):
    long = "word " * 50_000 + "10 km"
    df = spark.createDataFrame([("a", "q", "", "10,000 m", long, 0)], COLUMNS)
    [row] = common_units(df).collect()
    assert [(f["field"], f["value"], f["unit"]) for f in row["figures"]] == [("gold", 10000.0, "m"), ("answer", 10000.0, "m")]
    assert found(spark, [("a", "q", "", "10,000 m", long)]) == ["a"]


def test_bare_numbers_take_the_unit_that_fits(spark):
    assert figures(spark, [("a", "q", "How much? (USD millions)", "1,544", "It was 1,544,000 then.")])["a"] == [("gold", 1e6), ("answer", 1e3)]
    rows = [("a", "q", "How much? (USD millions)", "$12.5", "$12.5"), ("b", "q", "How much? (USD millions)", "$12.5", "$12,500,000"), ("c", "q", "How much? (USD millions)", "$12.5", "It was 12,500.")]
    assert figures(spark, rows) == {"a": [("gold", 1e6), ("answer", 1e6)], "b": [("gold", 1e6), ("answer", 1.0)], "c": [("gold", 1e6), ("answer", 1e3)]}
    assert found(spark, rows) == ["b", "c"]


def test_without_viterbi_rows_are_lost(spark, monkeypatch):
    rows = [("a", "q", "How much? (USD millions)", "$12.5", "$12,500,000"), ("b", "q", "How much? (USD millions)", "$12.5", "$12.5")]
    assert found(spark, rows) == ["a"]
    monkeypatch.setattr(u, "branches", lambda numbers, costs, states: (np.zeros(len(states)), np.array([[int(c.argmin()) for c in costs]] * len(states))))
    df = spark.createDataFrame([(*r, 1) for r in rows], COLUMNS).toPandas()
    off = [u._decoded(u._figures(r.question, r.gold_answer, r.generated_answer), {})[0] for r in df.itertuples()]
    assert [f[1]["factor"] for f in off] == [1.0, 1.0]  # both as plain dollars: the second is no longer as large as its gold answer


def test_a_stated_unit_is_evidence_that_a_whole_question_can_outvote(spark):
    one = [("a", "q", "How much?", "$5.25", "It was $5.25 million.")]
    assert figures(spark, one)["a"] == [("gold", 1.0), ("answer", 1e6)]
    many = [(f"a{i}", "q", "How much?", "$5.25", "It was $5.25 million.") for i in range(30)] + [("b", "q", "How much?", "$5.25", "USD 5,250 thousand"), ("c", "r", "How much?", "$5.25", "It was $5.25 million.")]
    got = figures(spark, many)
    assert got["a0"] == [("gold", 1e6), ("answer", 1e6)] and got["b"] == [("gold", 1e6), ("answer", 1e3)]
    assert got["c"] == [("gold", 1.0), ("answer", 1e6)]  # another question
    assert found(spark, many) == []  # as stated, none is equal


def test_a_misstated_unit_between_two_that_agree():
    chain = [("gold", "$1.704B"), ("answer", "$1.704"), ("answer", "$1,704 million")]
    figs = u._figures("How much?", "$1.704B", "1.704 million dollars, that is $1,704 million")
    decoded, _ = u._decoded(figs, {})
    assert len(chain) == len(decoded) == 3
    assert [(f["named"], f["factor"]) for f in decoded] == [(1e9, 1e9), (1e6, 1e9), (1e6, 1e6)]


def test_repeated_and_differing_rows_of_one_id(spark):
    df = spark.createDataFrame([("a", "q", "", "5 km", "5,000 m", 1)] * 3 + [("a", "q", "", "5 km", "6 m", 1), (None, None, None, None, None, 1)], COLUMNS)
    assert sorted((r["grade_id"] or "", len(r["figures"])) for r in common_units(df).collect()) == [("", 0), ("a", 2), ("a", 2)]
