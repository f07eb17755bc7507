"""Quantities recorded in different units, brought to one common unit for each kind.

Every figure in a text is read with what the text says of its unit. The readings of one figure (the
*device* is the question asked: its gold answer, and every answer given to it) are those of one level.
A hidden Markov model has the unit as its hidden state: a reading's log value plus the log of the state's
factor is the level, which should stay as it was from one reading to the next; what a text says of its unit is evidence for
a state, and how strong depends on how it says it. Viterbi decodes the states, and the value in the common unit follows.

The readings of a question form a tree: every answer's figures are a chain that begins with the gold answer. For each
state of the gold figure, Viterbi gives the best path through an answer and its score; the scores of all answers are
added up, which tasks do before the shuffle, and the best state of the gold figure decides which paths hold. So the
result is the likeliest assignment of the whole question, however many answers it has and however they are spread.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.readingform import reading_form
from folioscope.lineage import is_small, written

# For each kind its common unit, and what one of each unit is in it.
COMMON = {"money": "USD", "share": "fraction", "weight": "kg", "area": "m2", "energy": "kWh", "volume": "m3", "length": "m", "term": "month"}
SCALES = {"thousand": 1e3, "thousands": 1e3, "million": 1e6, "millions": 1e6, "billion": 1e9, "billions": 1e9, "trillion": 1e12, "trillions": 1e12}
MONEY_MARKS = {"k": 1e3, "m": 1e6, "mm": 1e6, "mn": 1e6, "mln": 1e6, "b": 1e9, "bn": 1e9, "tn": 1e12, "(000s)": 1e3, "(000)": 1e3, "(000,000s)": 1e6}
UNITS = {
    "share": {"%": 0.01, "percent": 0.01, "per cent": 0.01, "pct": 0.01, "bp": 1e-4, "bps": 1e-4, "basis point": 1e-4, "basis points": 1e-4, "(expressed as a decimal)": 1.0, "as a decimal": 1.0, "as a fraction of one": 1.0, "as a ratio": 1.0},
    "weight": {"kg": 1.0, "kgs": 1.0, "kilogram": 1.0, "kilograms": 1.0, "g": 1e-3, "gram": 1e-3, "grams": 1e-3, "t": 1e3, "mt": 1e3, "ton": 1e3, "tons": 1e3, "tonne": 1e3, "tonnes": 1e3, "metric ton": 1e3, "metric tons": 1e3, "metric tonnes": 1e3, "kt": 1e6, "kiloton": 1e6, "kilotons": 1e6, "kilotonne": 1e6, "kilotonnes": 1e6, "megatonnes": 1e9, "lb": 0.45359237, "lbs": 0.45359237, "pound": 0.45359237, "pounds": 0.45359237, "oz": 0.028349523125, "ounces": 0.028349523125},
    "area": {"m2": 1.0, "m²": 1.0, "sqm": 1.0, "sq m": 1.0, "sq. m.": 1.0, "square meter": 1.0, "square meters": 1.0, "square metre": 1.0, "square metres": 1.0, "km2": 1e6, "km²": 1e6, "sq km": 1e6, "square kilometers": 1e6, "square kilometres": 1e6, "ha": 1e4, "hectare": 1e4, "hectares": 1e4, "acre": 4046.8564224, "acres": 4046.8564224, "sq ft": 0.09290304, "sq. ft.": 0.09290304, "sq. ft": 0.09290304, "sqft": 0.09290304, "ft2": 0.09290304, "ft²": 0.09290304, "square foot": 0.09290304, "square feet": 0.09290304, "square yards": 0.83612736, "sq mi": 2589988.110336, "square miles": 2589988.110336},
    "energy": {"wh": 1e-3, "kwh": 1.0, "kilowatt-hour": 1.0, "kilowatt-hours": 1.0, "kilowatt hours": 1.0, "mwh": 1e3, "megawatt-hour": 1e3, "megawatt-hours": 1e3, "megawatt hours": 1e3, "gwh": 1e6, "gigawatt-hour": 1e6, "gigawatt-hours": 1e6, "gigawatt hours": 1e6, "twh": 1e9, "terawatt-hours": 1e9, "mj": 1 / 3.6, "megajoules": 1 / 3.6, "gj": 1e3 / 3.6, "gigajoule": 1e3 / 3.6, "gigajoules": 1e3 / 3.6, "tj": 1e6 / 3.6, "terajoule": 1e6 / 3.6, "terajoules": 1e6 / 3.6, "mmbtu": 293.07107},
    "volume": {"m3": 1.0, "m³": 1.0, "cubic meter": 1.0, "cubic meters": 1.0, "cubic metre": 1.0, "cubic metres": 1.0, "l": 1e-3, "liter": 1e-3, "liters": 1e-3, "litre": 1e-3, "litres": 1e-3, "hectoliters": 0.1, "hectolitres": 0.1, "kl": 1.0, "kiloliters": 1.0, "kilolitres": 1.0, "megaliters": 1e3, "megalitres": 1e3, "gal": 0.003785411784, "gallon": 0.003785411784, "gallons": 0.003785411784, "us gallon": 0.003785411784, "us gallons": 0.003785411784, "u.s. gallons": 0.003785411784, "bbl": 0.158987294928, "bbls": 0.158987294928, "barrel": 0.158987294928, "barrels": 0.158987294928, "kbbl": 158.987294928, "mmbbl": 158987.294928, "cubic feet": 0.028316846592},
    "length": {"m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0, "cm": 0.01, "centimeters": 0.01, "km": 1e3, "kms": 1e3, "kilometer": 1e3, "kilometers": 1e3, "kilometre": 1e3, "kilometres": 1e3, "mi": 1609.344, "mile": 1609.344, "miles": 1609.344, "ft": 0.3048, "foot": 0.3048, "feet": 0.3048, "yards": 0.9144},
    "term": {"month": 1.0, "months": 1.0, "mos": 1.0, "quarter": 3.0, "quarters": 3.0, "year": 12.0, "years": 12.0, "yr": 12.0, "yrs": 12.0},
}

_BY_SPELLING = {s: (kind, f) for kind, units in UNITS.items() for s, f in units.items()}


def _any_of(spellings) -> str:
    return "|".join(re.escape(s).replace(r"\ ", r"\s+") for s in sorted(spellings, key=len, reverse=True))


_SCALE = _any_of(SCALES)
_UNIT = _any_of(_BY_SPELLING)
_DOLLARS = r"USD|US\s?\$|(?:U\.?S\.?\s+)?dollars?"
_NUMBER = re.compile(
    rf"(?:\(?\bin\s+(?P<ahead>{_SCALE})(?:\s+of\s+(?P<aheadcur>{_DOLLARS}))?\)?,?\s+)?"
    r"(?P<ratio>\ba\s+ratio\s+of\s+)?"
    r"(?P<neg>[-−](?=\s?(?:US\s?\$|USD|\$|\()))?\s?"
    r"(?P<cur>US\s?\$|\bUSD|\$)?\s?"
    r"(?<![A-Za-z0-9.,])(?P<sign>[-−])?(?P<open>\(\s?[-−]?)?(?P<cur2>\$)?(?P<num>(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)(?P<close>\s?\))?(?![,.]?\d)",
    re.I,
)
#: What the pattern above can begin with, besides a space: far quicker to look for.
_START = re.compile(r"[-−(.$\d]|\b(?:in\s|a\s+r|us)", re.I)
_TAIL = re.compile(
    rf"\s?(?:(?P<scale>{_SCALE})\b\s*)?(?:(?P<mark>{_any_of(MONEY_MARKS)})(?!\w)\s*)?(?:(?P<dollars>{_DOLLARS})\b)?(?:(?P<unit>{_UNIT})(?!\w))?"
    rf"(?:\s?\((?:(?:USD|US\$|\$|dollars)\s+)?in\s+(?P<behind>{_SCALE})(?:\s+of\s+(?:{_DOLLARS}))?\))?(?P<whole>\s*\bin\s+whole\s+dollars)?",
    re.I,
)
_LABEL = r"\b(?:pages?|pp?\.|notes?|item|FY|fiscal(?:\s+year)?|year|December|January|February|March|April|May|June|July|August|September|October|November)"
_LABELLED = (re.compile(_LABEL + r"\s*(?=\d)", re.I), re.compile(_LABEL + r"\s*\d{1,2}(?:,\s*|\s+)(?=\d)", re.I))
_ASKED = re.compile(rf"\bUSD\s+(?:in\s+)?(?P<a>{_SCALE})\b|\b(?P<b>{_SCALE})\s+of\s+(?:{_DOLLARS})\b|\(in\s+(?P<c>{_SCALE})\)|\bin\s+(?P<whole>whole\s+(?:US\s+)?dollars|(?:US\s+)?dollars|USD)\b(?!\s+(?:in\s+)?(?:{_SCALE}))|(?:\(|\bin\s+)(?:(?P<us>{_SCALE})\s+)?(?:of\s+)?(?P<u>{_UNIT})(?=\s*[).?,;]|$)", re.I)
_SPACES, _DIGIT = re.compile(r"\s+"), re.compile(r"\d")


def asked_unit(question: str | None) -> tuple[str, float] | None:
    """Kind and factor of the unit a question asks its answer in, or None."""
    m = None
    for m in _ASKED.finditer(reading_form(question) or ""):
        pass
    if not m:
        return None
    if m["u"]:
        kind, factor = _BY_SPELLING[_SPACES.sub(" ", m["u"].lower())]
        return kind, factor * SCALES.get((m["us"] or "").lower(), 1.0)
    scale = m["a"] or m["b"] or m["c"]
    return "money", SCALES[scale.lower()] if scale else 1.0


def quantities(text: str | None) -> list[tuple[str, str, float, float]]:
    """Every figure of a text in order: (as written, kind, number, factor).

    The kind is '' where nothing names one, the factor 0 where nothing names a unit or scale; a
    currency sign alone gives the kind ``money`` and the factor 0. Years, dates and page numbers
    without a unit are left out.
    """
    text, out, done = reading_form(text) or "", [], 0
    if not _DIGIT.search(text):
        return out
    labels = {x.end() for r in _LABELLED for x in r.finditer(text)}
    past = 0
    for start in _START.finditer(text):
        if start.start() < past or not (m := _NUMBER.match(text, start.start())):
            continue
        past = m.end()
        if m.start("num") < done:  # it belongs to the unit before
            continue
        value = float(m["num"].replace(",", ""))
        if m["sign"] or m["neg"] or (m["open"] and (m["close"] or re.search("[-−]", m["open"]))):
            value = -value
        end = m.end() if m["close"] is None or m["open"] else m.start("close")
        t = _TAIL.match(text, end)
        done = t.end()
        currency = m["cur"] or m["cur2"] or m["aheadcur"] or t["dollars"] or t["whole"]
        kind, factor, mark, unit = "", 0.0, (t["mark"] or "").lower(), _SPACES.sub(" ", (t["unit"] or "").lower())
        scale = SCALES.get((m["ahead"] or t["scale"] or t["behind"] or "").lower(), 0.0)
        if m["ratio"]:
            kind, factor = "share", 1.0
        elif currency or (t["behind"] and not unit):
            kind = "money"
            scale = scale or MONEY_MARKS.get(mark, 0.0)
            # a metre's or a tonne's sign after a currency sign is a scale
            factor = scale or (1.0 if t["dollars"] or t["whole"] or m["aheadcur"] else 0.0)
        elif unit or mark:
            spelling = unit or mark
            if spelling not in _BY_SPELLING:
                continue
            kind, factor = _BY_SPELLING[spelling]
            factor *= scale or 1.0
        elif scale:
            factor = scale
        elif m.start("num") in labels or re.fullmatch(r"(?:19|20)\d\d", m["num"]):
            continue
        out.append((text[m.start() : max(end, t.end())].strip(), kind, value, factor))
    return out


# --- the hidden Markov model ---------------------------------------------------------------------

#: Cost of a state other than the one evidence is for: what the text of an answer states, what a gold answer states or its question asks for, and what an answer may mean without a word of it.
STATED, GOLD, MEANT = 14.0, 60.0, 4.0
#: Chance of another unit in the next reading, width of a jump of the level that counts as none, and the cost of one that is.
SWITCH, WALK, OUTLIER = 0.05, 0.02, 10.0
#: Scales of money.
MONEY = (1.0, 1e3, 1e6, 1e9, 1e12)

_BASE = {kind: sorted(set(units.values())) for kind, units in UNITS.items()} | {"money": list(MONEY)}


def _same(a: float, b: float) -> bool:
    return math.isclose(a, b, rel_tol=1e-9)


def states_of(kind: str, *more: float) -> list[float]:
    """The factors that a reading may have: those of the kind's units, and of other ones that are named."""
    out = list(_BASE[kind])
    out += [f for k, f in enumerate(more) if f and not any(_same(f, s) for s in [*out, *more[:k]])]
    return sorted(out)


def branches(numbers: list[float], costs: np.ndarray, states: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi from the end of a chain: for each state of its first reading, the best score of the rest, and the states of that path.

    ``costs`` has for each reading what each state costs. Going from one reading to the next costs the squared jump of the
    level log|number * factor| over twice ``WALK`` squared, ``OUTLIER`` at most, and -log(``SWITCH``) where the
    state is another. A zero has no level and adds no jump. Ties go to the smaller factor.
    """
    n, m = len(numbers), len(states)
    logs = np.log(np.array(states))
    score, came = np.zeros(m), []
    switch = np.where(np.eye(m, dtype=bool), 0.0, -math.log(SWITCH))
    for i in range(n - 2, -1, -1):
        step = -switch - costs[i + 1][None, :] + score[None, :]
        if numbers[i] and numbers[i + 1]:
            jump = (math.log(abs(numbers[i + 1])) + logs[None, :]) - (math.log(abs(numbers[i])) + logs[:, None])
            step = step - np.minimum(jump**2 / (2 * WALK**2), OUTLIER)
        best = step.argmax(axis=1)
        score = step[np.arange(m), best]
        came.append(best)
    paths = np.empty((m, n), dtype=int)
    paths[:, 0] = np.arange(m)
    for i, best in enumerate(reversed(came), 1):
        paths[:, i] = best[paths[:, i - 1]]
    return score, paths


def _costs(chain: list[dict], states: list[float], asked: float) -> np.ndarray:
    """What each state costs each reading: the stated unit has its evidence; a gold answer without one takes the unit asked for, else plain dollars; an answer without one may mean either."""
    out = np.zeros((len(chain), len(states)))
    for i, r in enumerate(chain):
        gold = r["field"] == "gold"
        if r["named"]:
            meant, cost = (r["named"],), GOLD if gold else STATED
        elif gold:
            meant, cost = (asked or 1.0,), GOLD
        else:
            meant, cost = tuple(x for x in (asked, 1.0 if r["kind"] == "money" else 0.0) if x), MEANT
        if meant:
            out[i] = [0.0 if any(_same(s, x) for x in meant) else cost for s in states]
    return out


FIGURES = "array<struct<field:string,written:string,kind:string,number:double,named:double,asked:double,factor:double,value:double,unit:string>>"
#: Of each kind that gold and answer have: the first gold figure, its states, what each costs, and the answer's score for each.
LEVELS = "array<struct<kind:string,first:double,states:array<double>,costs:array<double>,scores:array<double>>>"


def _chains(figures: list[dict]) -> Iterator[tuple[str, list[dict], list[float], np.ndarray, np.ndarray, np.ndarray]]:
    """Of each kind: its figures, their states, costs, and what ``branches`` gives."""
    kinds: dict[str, list[dict]] = {}
    for f in figures:
        kinds.setdefault(f["unit_kind"], []).append(f)
    for kind, chain in kinds.items():
        asked = chain[0]["asked"]
        states = states_of(kind, asked, *[f["named"] for f in chain])
        costs = _costs(chain, states, asked)
        yield (kind, chain, states, costs, *branches([f["number"] for f in chain], costs, states))


def _figures(question: str | None, gold: str | None, answer: str | None) -> list[dict]:
    """Figures of both texts with their kind: the one they name, else that of the question, else money where the gold answer is money."""
    asked_kind, asked = asked_unit(question) or ("", 0.0)
    found = [dict(zip(("field", "written", "kind", "number", "named"), ("gold", *q))) for q in quantities(gold)]
    alone, money = len(found) == 1, [f["kind"] for f in found if f["kind"]][:1] == ["money"]
    found += [dict(zip(("field", "written", "kind", "number", "named"), ("answer", *q))) for q in quantities(answer)]
    out = []
    for f in found:
        answered = f["field"] == "answer"
        kind = f["kind"] or (asked_kind if asked_kind and (answered or alone) else "money" if f["named"] and money and answered else "")
        if kind:
            out.append(f | {"unit_kind": kind, "asked": asked if asked_kind == kind else 0.0})
    return out


def _decoded(figures: list[dict], levels: dict[tuple[str, float], float]) -> tuple[list[dict], list[dict]]:
    """Figures with their factor and value, and the levels of the kinds that both texts have; ``levels`` has states of gold figures that the whole question decides."""
    factors, found = {}, []
    for kind, chain, states, costs, score, paths in _chains(figures):
        first = chain[0]
        at = int((score - costs[0]).argmax())
        if first["field"] == "gold":
            given = levels.get((kind, first["number"]))
            at = next((i for i, s in enumerate(states) if given and _same(s, given)), at if given else int((-costs[0]).argmax()))
            if any(f["field"] == "answer" for f in chain):
                found.append({"kind": kind, "first": first["number"], "states": states, "costs": [float(c) for c in costs[0]], "scores": [float(x) for x in score]})
        for f, k in zip(chain, paths[at]):
            factors[id(f)] = states[k]
    out = [{k: f[k] for k in ("field", "written", "number", "named", "asked")} | {"kind": f["unit_kind"], "factor": factors[id(f)], "value": f["number"] * factors[id(f)], "unit": COMMON[f["unit_kind"]]} for f in figures]
    return out, found


def common_units(df: DataFrame) -> DataFrame:
    """Figures of every graded answer and its gold answer, in one common unit for each kind.

    ``df`` has ``grade_id, qid, question, gold_answer, generated_answer`` (others are ignored).
    Returns ``grade_id, qid, figures``, one row for each distinct ``grade_id``; a repeated row adds
    nothing, and of rows that share a ``grade_id`` and differ, each comes out. A null or empty text
    has no figures; rows with a null ``qid`` are a question; a null ``grade_id`` stays null. A figure has
    ``named``, the factor its text states (0: none), beside ``factor``, the one decoded, so a wrong unit in a text can be seen.

    Texts are read once. Of the answers' scores only sums cross the shuffle; where they speak against the state that
    the gold answer has by itself, which is rare, that question's answers are decoded again under the other state.
    """

    @F.pandas_udf(f"figures {FIGURES}, levels {LEVELS}")
    def read(question: pd.Series, gold: pd.Series, answer: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_decoded(_figures(*x), {}) for x in zip(question, gold, answer)], columns=["figures", "levels"])

    rows = df.select("grade_id", "qid", "question", "gold_answer", "generated_answer")
    once = written(rows.select("grade_id", "qid", read("question", "gold_answer", "generated_answer").alias("r")).select("grade_id", "qid", "r.*"), "figures")
    state = F.explode(F.arrays_zip("l.states", "l.costs", "l.scores")).alias("s")
    key = ["qid", "kind", "first"]
    each = once.select("qid", F.explode("levels").alias("l")).select("qid", "l.kind", "l.first", state).select(*key, "s.states", "s.costs", "s.scores")
    total = each.groupBy(*key, "states").agg((F.sum("scores") - F.max("costs")).alias("total"), F.max("costs").alias("costs"))
    chosen = total.groupBy(*key).agg(F.max_by("states", F.struct("total", -F.col("states"))).alias("state"), F.max_by("states", F.struct(-F.col("costs"), -F.col("states"))).alias("own"))
    other = written(chosen.where("state <> own").drop("own"), "other-levels")
    if other.isEmpty():
        return once.select("grade_id", "qid", "figures").distinct()

    @F.pandas_udf(FIGURES)
    def again(question: pd.Series, gold: pd.Series, answer: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([_decoded(_figures(q, g, a), {(x["kind"], x["first"]): x["state"] for x in found})[0] for q, g, a, found in zip(question, gold, answer, levels)], dtype=object)

    # as many entries for a question as it has figures in its gold answers
    listed = other.groupBy("qid").agg(F.collect_list(F.struct("kind", "first", "state")).alias("levels"))
    listed = written(listed, "questions-to-decode-again")
    asked = F.broadcast(listed) if is_small(other) else listed
    same = rows["qid"].eqNullSafe(listed["qid"])
    redone = rows.join(asked, same).select("grade_id", rows["qid"], again("question", "gold_answer", "generated_answer", "levels").alias("figures"))
    kept = once.join(asked.select("qid"), once["qid"].eqNullSafe(listed["qid"]), "left_anti").select("grade_id", "qid", "figures")
    return kept.unionByName(redone).distinct()


def same_figure_other_unit(figures: DataFrame, *, tolerance: float = 0.005) -> DataFrame:
    """``grade_id`` whose answer states a figure of the gold answer's kind, equal to it within ``tolerance`` but in another unit or scale.

    Two spellings of one unit have one factor and are no difference. A gold figure of zero equals zero only. A unit that a text
    states is taken as stated here, also where the model holds it to be wrong; a gold answer without one takes the unit asked for, else
    plain dollars; an answer without one takes the unit decoded.
    """
    stated = lambda x: F.when(x["named"] > 0, x["named"]).when(x["field"] == "gold", F.when(x["asked"] > 0, x["asked"]).otherwise(1.0)).otherwise(x["factor"])
    of = lambda field: F.transform(F.filter("figures", lambda x: x["field"] == field), lambda x: F.struct(x["kind"].alias("kind"), x["number"].alias("number"), stated(x).alias("own")))
    match = F.exists(
        "gold",
        lambda g: F.exists(
            "given",
            lambda a: (a["kind"] == g["kind"]) & (F.abs(a["number"] * a["own"] - g["number"] * g["own"]) <= tolerance * F.abs(g["number"] * g["own"])) & (F.abs(a["own"] - g["own"]) > 1e-9 * g["own"]),
        ),
    )
    return figures.select("grade_id", of("gold").alias("gold"), of("answer").alias("given")).where(match).select("grade_id").distinct()
