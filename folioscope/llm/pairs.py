"""Broken prompt and response pairs, each with its kind of defect.

Copies of the prompt are found by compressing the response with the prompt as a zstandard dictionary: by the bytes that
are left of it, against what is left where an answer follows; refusals by a dictionary of declining sentences, other languages
by the words of each language, and responses that break off by a model of the contexts in which texts end.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.readingform import reading_form
from folioscope.llm.languages import LanguageModel, Pieces, fit_all, in_parts, label_column, tallied, tally_lines, words_of
from folioscope.llm.shared import written
from folioscope.operators.units import quantities

# What stands in for an answer, once marks are gone.
STAND_INS = {"na", "n a", "none", "null", "nil", "nan", "tbd", "tba", "undefined", "empty", "blank", "no answer", "answer", "no response", "todo", "placeholder"}

# Sentences that decline, by language, and sentences around an answer that say nothing.
_ABOUT = r"(?:filings?|context|passages?|documents?|excerpts?|pages?|materials?|sources?|information|texts?|reports?|data|question|answer)"
DECLINES = [
    r"\b(?:can ?not|can't|could not|couldn't|(?:not|un)\s?able to|impossible to|not possible to|not in a position to)\b.{0,60}\b(?:answer|respond|response|determine|say|tell|give|provide|find|locate|identify|help|assist|comment|advise|comply|confirm|establish|discuss|offer|know|infer|assess)",
    rf"\b{_ABOUT}\b.{{0,40}}\b(?:do|does|did)(?: not|n't) (?:contain|mention|include|provide|disclose|state|specify|give|have|address|cover|show|report|discuss|offer|reveal|say|allow|support)\b",
    rf"\b{_ABOUT}\b.{{0,40}}\b(?:is|are|was|were)(?: not|n't) (?:available|provided|stated|disclosed|mentioned|given|found|included|present|specified|covered|contained|discussed|sufficient|enough)\b",
    r"\b(?:i|we) (?:do not|don't) (?:know|have)\b",
    r"\bno (?:answer|response|information|data|evidence|mention|figure)s?\b.{0,30}\b(?:can|could|is|are|was|were|possible|given|found|available|provided|context|passages)\b",
    r"\b(?:not enough|not sufficient|insufficient|lack of) (?:information|evidence|context|data|details?)\b",
    r"\b(?:must|have to|will|would) decline\b|\bdecline to\b|\b(?:i|we) (?:won't|will not|refuse to)\b.{0,20}\b(?:answer|comment|respond|provide)",
    r"\boutside (?:of )?(?:the scope|what)\b|\bbeyond the scope\b",
    r"\bnone of the (?:retrieved|provided|given|supplied|available)\b",
    r"\bkann\b.{0,60}\bnicht\b.{0,20}\b(?:beantworte\w*|angeben|bestimm\w*|sagen)|\bkeine (?:angaben|informationen|antwort)\b|\bweiß (?:es |ich )?(?:leider )?nicht|\bnicht (?:möglich|enthalten|verfügbar)\b.{0,40}(?:antwort|auskunft|unterlagen|$)",
    r"\bne (?:peux|peut|puis|permet\w*|contien\w*|mentionn\w*) pas\b|\baucune (?:réponse|information)\b|\bimpossible de (?:répondre|déterminer|dire)|\bje ne sais pas\b|\bpas assez d'informations\b",
    r"\bno (?:puedo|podemos|es posible|se puede|dispongo|contien\w*|mencion\w*) .{0,30}(?:respond\w*|contest\w*|determinar|información|respuesta|decir)|\bno hay (?:suficiente )?información\b|\bno lo sé\b",
    r"\bnão (?:posso|podemos|é possível|se pode|contêm|mencionam) .{0,30}(?:respond\w*|determinar|informação|informações|resposta|dizer)|\bnão há informaç\w+|\bnão sei\b",
    r"\bnon (?:posso|possiamo|è possibile|contengono|so) .{0,30}(?:rispond\w*|determinare|informazioni|risposta|dire)|\bnon ci sono (?:abbastanza )?informazioni\b",
    r"\bkan\b.{0,40}\bniet\b.{0,20}\b(?:beantwoorden|bepalen|zeggen)|\bgeen (?:antwoord|informatie)\b|\bweet (?:ik )?(?:het )?niet\b",
    r"не могу|невозможно (?:ответить|определить)|нет (?:информации|данных|ответа)|не содерж\w+ (?:ответа|информации)",
    r"(?:お答え|回答|判断)(?:は|を)?(?:でき|いたしかね)|わかりません|分かりません|(?:情報|記載)(?:が|は)(?:ありません|不足)",
]
FRAMES = [
    r"^(?:thank you|thanks)\b.{0,40}$",
    r"^(?:after|having|based on|upon)\b.{0,12}(?:review|read|check|consider)\w*.{0,40}$",
    r"^(?:please|kindly)\b.{0,80}$",
    r"^(?:sorry|i am sorry|i'm sorry|apologies|unfortunately|answer|response|note|ok|okay|sure|certainly)$",
    r"^(?:more|additional|further) (?:pages|information|context|documents|details|data)\b.{0,40}$",
    r"^(?:danke|merci|gracias|obrigad[oa]|grazie|bedankt|bitte|antwort|réponse|respuesta|resposta|risposta|antwoord)\b.{0,40}$",
]
_DECLINES, _FRAMES = re.compile("|".join(DECLINES)), re.compile("|".join(FRAMES))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|[。！？\n:]+\s*")
_TAG, _MARK = re.compile(r"<[^<>]*>"), re.compile(r"[*_#`~|>]+")
_NOT_WORD = re.compile(r"[\W_]+")
# Words around a repeated question that add no answer.
AROUND = {"you", "asked", "the", "question", "q", "was", "is", "your", "query", "prompt", "user", "asks", "about", "repeat", "restated", "frage", "pregunta", "domanda", "vraag", "pergunta"}

# Words that something must follow, by language.
GOES_ON = {
    *"a an the and or nor but of in on at by for from with without to into onto as its their our his her my your this these those which who whose because including such is are was were be been has have had will would may might should could than per via between during mainly versus".split(),
    *"der die das den dem des ein eine einen einem einer und oder mit von vom zu zum zur für auf im bei aus nach über unter durch wegen sowie".split(),
    *"le la les un une des du de et ou à au aux en dans par pour avec sur sans que qui dont".split(),
    *"el los las una unos unas y o del al con por para sin sobre que cuyo".split(),
    *"os as um uma uns umas e do da dos das no na nos nas com por sem que".split(),
    *"il lo gli i uno di del della dei delle da dal dalla nel nella con per su senza che ed".split(),
    *"het een en of van op met voor door uit aan bij naar over onder zonder te die dat".split(),
    *"и или в на с со по для о об из за к ко от при под над без что который".split(),
}

_TERMINAL = ".!?。！？…"
_CLOSING = "\"'”’»)]}*_`"
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d[\d.,]*|[^\w\s]")
_TOKENS = Pieces(lambda piece: (piece,) if piece == "\n" else tuple(map(str.lower, _TOKEN.findall(reading_form(piece)))))
#: What follows the last word of a sentence, line or text, among tokens; and how many of these are counted at a time.
_STOPS, AT_ONCE = {"", "\n", *".;!?。"}, 500_000


@lru_cache(maxsize=64)  # an answer is looked at several times in a row
def plain(text: str) -> str:
    """Reading form without tags and marks."""
    return _MARK.sub("", _TAG.sub(" ", reading_form(text))).strip()


def is_empty(text: str | None) -> bool:
    """Null, blank, marks or markup only, or a stand-in for no answer."""
    if text is None:
        return True
    left = _NOT_WORD.sub(" ", plain(text)).strip().lower()
    return not left or left in STAND_INS


_RAW = zstandard.DICT_TYPE_RAWCONTENT
#: Small tables, as prompts and copies of them are short: a compressor takes a few kilobytes and microseconds.
_SMALL = zstandard.ZstdCompressionParameters(compression_level=1, window_log=12, hash_log=10, chain_log=10, write_content_size=False, write_checksum=False, write_dict_id=False)
#: What a repeated question may stand in; part of the dictionary, so that it leaves few bytes.
_FRAME = "repeat restated prompt query user asks about your question was you asked the question "
#: Bytes that a copy may leave more than the prompt itself, where no answers were there to fit it on; and the share of the prompt's bytes that may be missing from a copy.
BYTES_LEFT, MISSING = 6, 0.2
# Whole answers that are too short for bytes to tell.
SHORT = {"yes", "no", "none", "ja", "nein", "oui", "non", "sí", "si", "sim", "não", "nee", "да", "нет", "はい", "いいえ"}


def _plain_words(text: str) -> list[str]:
    return _NOT_WORD.sub(" ", plain(text).lower()).split()


def _compressor(dictionary: bytes):
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(compression_params=_SMALL)
    return zstandard.ZstdCompressor(compression_params=_SMALL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=_RAW))


#: Kinds of what the detector counts.
COPIES, ANSWERED = "copies", "answered"


class CopyDetector:
    """Compressor of responses with one prompt as dictionary; ``most`` is how many bytes a copy may leave more than the prompt itself."""

    def __init__(self, prompt: str, most: int = BYTES_LEFT):
        self.words, self.most = _plain_words(prompt), most
        self.text = " ".join(self.words).encode()
        self.primed = _compressor(_FRAME.encode() + self.text)
        self.least = len(self.primed.compress(self.text))

    def left(self, response: str) -> int:
        """Bytes that the prompt as dictionary leaves of a response, over what it leaves of itself."""
        return len(self.primed.compress(" ".join(_plain_words(response)).encode())) - self.least

    def is_copy(self, response: str) -> bool:
        """Whether the response holds the prompt and nothing of an answer.

        The prompt as dictionary must leave next to nothing of the response, and the response as dictionary next
        to nothing of the prompt. A figure that the prompt lacks, or an answer of one word, which are too short for that, are looked at after.
        """
        words = _plain_words(response)
        if not words or not self.words or self.left(response) > self.most:
            return False
        text = " ".join(words).encode()
        held = _compressor(text)
        if len(held.compress(self.text)) - self.least > MISSING * len(self.text):
            return False
        return not any(w in SHORT or not w.isalpha() for w in set(words) - set(self.words))

    @staticmethod
    def fit(pairs: Iterable[tuple[str, str]]) -> int:
        """``most`` from (question, gold answer) pairs: between what framed copies of the questions leave and what is left where the gold answer follows the question, at the least error."""
        seen = defaultdict(Counter)
        for question, answer in pairs:
            CopyDetector.tally(seen, question, answer)
        return CopyDetector.most_of(seen)

    @staticmethod
    def tally(seen: dict[str, Counter], question: str, answer: str) -> None:
        """Counts the bytes that are left of a copy of the question, and where its gold answer follows."""
        d = CopyDetector(question)
        if d.words and _plain_words(answer):
            seen[COPIES][str(max(d.left(f"You asked: {question}"), d.left(f"Question: {question}")))] += 1
            seen[ANSWERED][str(d.left(f"{question} {answer}"))] += 1

    @staticmethod
    def most_of(seen: dict[str, Counter]) -> int:
        """``most`` of what was counted."""
        copies, answered = ({int(left): n for left, n in seen.get(kind, {}).items()} for kind in (COPIES, ANSWERED))
        if not copies:
            return BYTES_LEFT
        wrong = lambda most: sum(n for left, n in copies.items() if left > most) + sum(n for left, n in answered.items() if left <= most)
        return min(range(min(copies), max(copies) + 1), key=lambda most: (wrong(most), -most))


def refuses(text: str, flagged: bool | None) -> bool:
    """Whether every sentence declines or frames, and one declines at least. A flagged pair may do with frames alone that are apologies."""
    said = [s.strip(" .!?;,-–—'\"“”").lower() for s in _SENTENCE.split(plain(text).replace("’", "'"))]
    said = [s for s in said if s and _NOT_WORD.sub("", s)]
    kinds = ["decline" if _DECLINES.search(s) else "frame" if _FRAMES.search(s) else "content" for s in said]
    if not kinds or "content" in kinds:
        return False
    return "decline" in kinds or (bool(flagged) and any(re.match("sorry|i am sorry|i'm sorry|apologies|unfortunately", s) for s in said))


def shape(token: str) -> str:
    """A figure by its form (``12,345.67`` is ``9.9``, ``4,1``, whose last group is short, ``9,9``), another mark as it is."""
    if not token[0].isdigit():
        return token
    return re.sub(r"[.]9+$", ".9", re.sub(r"^9+(?:,999)*(?![9])", "9", re.sub(r"\d", "9", token)))


#: Kinds of what the terminal model counts.
WORD, PAIR, MARK = "word", "pair", "mark"


@dataclass
class TerminalModel:
    """How often a text ended or went on after its last word, or last two, in complete texts."""

    one: dict[str, tuple[int, int]] = field(default_factory=dict)  # word: (seen, ended)
    two: dict[str, tuple[int, int]] = field(default_factory=dict)
    marks: dict[str, tuple[int, int]] = field(default_factory=dict)  # shape of a figure, or punctuation: (seen, at the end of a text)
    starts: set[str] = field(default_factory=set)  # proper beginnings of words
    tails: dict[str, tuple[int, int]] = field(default_factory=dict)  # three or two letters: (in words, at their end)

    @classmethod
    def fit(cls, texts: Iterable[str]) -> TerminalModel:
        seen, ended = defaultdict(Counter), defaultdict(Counter)
        cls.tally(seen, ended, texts)
        return cls.of(seen, ended)

    @classmethod
    def tally(cls, seen: dict[str, Counter], ended: dict[str, Counter], texts: Iterable[str]) -> None:
        """Counts the texts' words, alone and after what is before them, and marks, and those of them that end a sentence or the text."""
        flat = [""]
        for text in texts:
            lines = text.rstrip().split("\n")
            while len(lines) > 1 and not reading_form(lines[-1]).strip():
                lines.pop()
            flat += chain.from_iterable(map(_TOKENS.__getitem__, " \n ".join(lines).split(" ")))
            flat.append("")
            if len(flat) > AT_ONCE:
                cls._count(seen, ended, flat)
                flat = [""]
        cls._count(seen, ended, flat)

    @staticmethod
    def _count(seen: dict[str, Counter], ended: dict[str, Counter], flat: list[str]) -> None:
        """Counts tokens of texts with an empty one before, between and after the texts, and a line feed between lines."""
        ids: dict[str, int] = defaultdict()
        ids.default_factory = ids.__len__
        text, line, start = ids[""], ids["\n"], ids["^"]
        a = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
        names = [*ids]
        before, here, after = a[:-2], a[1:-1], a[2:]
        word, stop = np.array([t[:1].isalpha() for t in names])[here], np.array([t in _STOPS for t in names])[after]
        mark = ~word & (here != text) & (here != line)

        def add(counts: Counter, of: np.ndarray, named: Callable[[int], str]) -> None:
            items, times = np.unique(of, return_counts=True)
            for i, n in zip(items.tolist(), times.tolist()):
                counts[named(i)] += n

        pair = np.where((before == text) | (before == line), start, before) * len(names) + here
        last = stop & word
        for counts, kept in ((seen, word), (ended, last)):
            add(counts[WORD], here[kept], names.__getitem__)
            add(counts[PAIR], pair[kept], lambda i: f"{names[i // len(names)]} {names[i % len(names)]}")
        add(seen[MARK], here[mark], lambda i: shape(names[i]))
        add(ended[MARK], here[mark & (after == text)], lambda i: shape(names[i]))

    @classmethod
    def of(cls, seen: dict[str, Counter], ended: dict[str, Counter]) -> TerminalModel:
        """The model of what was counted; of pairs those that were there more than once."""
        one = {c: (n, ended[WORD][c]) for c, n in seen[WORD].items()}
        two = {c: (n, ended[PAIR][c]) for c, n in seen[PAIR].items() if n > 1}
        inside, last = Counter(), Counter()
        for w in one:
            for k in (2, 3):
                inside.update(w[i : i + k] for i in range(1, len(w) - k + 1))
                if len(w) > k:
                    last[w[-k:]] += 1
        tails = {t: (n, last[t]) for t, n in inside.items()}
        return cls(one, two, {m: (n, ended[MARK][m]) for m, n in seen[MARK].items()}, {w[:k] for w, (n, _) in one.items() if n > 1 for k in range(2, len(w))}, tails)

    def whole_word(self, word: str) -> bool:
        """Whether an unseen word ends as words do: by its last three letters, or two where those are rare."""
        for k in (3, 2):
            n, e = self.tails.get(word[-k:], (0, 0))
            if n >= 2 or k == 2:
                return (e + 0.2) / (n + 1.0) >= 0.3
        return True

    def ends(self, before: str, last: str) -> float:
        """Probability that a text is complete after these tokens."""
        if not last[0].isalpha():
            form = shape(last)
            n, e = self.marks.get(form, (0, 0))
            if last[0].isdigit():  # a figure is whole if it is well formed, or others have its form, wherever they stand
                return 0.5 if form in ("9", "9.9") or n > 2 else 0.02
            return (e + 0.2) / (n + 10.0)
        n1, e1 = self.one.get(last, (0, 0))
        if not n1:
            return 0.01 if last in self.starts or not self.whole_word(last) else 0.5
        p1 = (e1 + 0.1) / (n1 + 1.0)
        n2, e2 = self.two.get(f"{before} {last}", (0, 0))
        return (e2 + 2 * p1) / (n2 + 2.0)


def breaks_off(text: str, model: TerminalModel, *, least: float = 0.03) -> bool:
    """Whether a text that isn't empty ends inside a word, sentence or figure.

    The model says how likely a text ends after its last tokens; an open bracket or mark, which it doesn't see, ends none. What is unlikely
    may still be a name, or a figure with its unit, and words that something must follow are looked up where the model has seen too little of them.
    """
    t = reading_form(text).rstrip()
    bare = plain(t).rstrip()
    core = bare.rstrip(_CLOSING + " ")
    if not core:
        return False
    open_ = t.count("**") % 2 or t.count("```") % 2 or t.count("(") > t.count(")")
    if open_ or core[-1] in _TERMINAL or core[-1] == "%":
        return bool(open_)
    tokens = [x.lower() for x in _TOKEN.findall(core)]
    if not tokens:
        return False
    before, last = tokens[-2] if len(tokens) > 1 else "^", tokens[-1]
    if re.search("[぀-ヿ一-鿿]$", core):
        return _sentence_in_kana(core)
    if model.ends(before, last) < least:
        found = quantities(bare)
        if found and bare.rstrip("\"'”’»].").endswith(found[-1][0].rstrip(".")) and not found[-1][0][-1].isdigit():
            return False  # a figure with its unit
        return not (last[0].isalpha() and core[-len(last)].isupper() and last not in model.one)  # an unseen name
    return len(tokens) > 1 and last in GOES_ON and model.one.get(last, (0, 0))[0] < 20


_PARTICLE = re.compile("[はがをにでとのもへや]")


def _sentence_in_kana(core: str) -> bool:
    """Whether a text in Japanese without a full stop is a sentence that breaks off: it ends in a particle or has two of them; names and figures have none or one."""
    return bool(_PARTICLE.match(core[-1])) or len(_PARTICLE.findall(core)) >= 2


def other_language(question: str, answer: str, model: LanguageModel, *, sure: float = 0.9, weight: float = 0.5) -> bool:
    """Whether both languages are clear and differ; texts without words but those of figures and their units are never clear.

    Answers are of another kind than the lines the model was fitted on, so their evidence has half the ``weight``.
    """
    return other_languages([(question, answer)], model, sure=sure, weight=weight)[0]


def other_languages(pairs: list[tuple[str, str]], model: LanguageModel, *, sure: float = 0.9, weight: float = 0.5) -> list[bool]:
    """``other_language`` of many pairs, which are scored together."""
    out, at, said, asked = [False] * len(pairs), [], [], {}
    for k, (question, answer) in enumerate(pairs):
        if question not in asked:
            asked[question] = words_of(question)
        if asked[question] and (words := words_of(_without_figures(answer))):
            at.append(k)
            said.append(words)
    if not at:
        return out
    rows = {question: i for i, question in enumerate(q for q, words in asked.items() if words)}
    pa, _ = model.posteriors(said, weight)
    pq, _ = model.posteriors([asked[q] for q in rows], weight)
    own = [rows[pairs[k][0]] for k in at]
    differ = (pa.argmax(axis=1) != pq.argmax(axis=1)[own]) & (pa.max(axis=1) >= sure) & (pq.max(axis=1)[own] >= sure)
    for k, x in zip(at, differ.tolist()):
        out[k] = x
    return out


def _without_figures(answer: str) -> str:
    said = reading_form(answer) if answer.isascii() else answer
    for written, *_ in quantities(answer):
        said = said.replace(written, " ")
    return said


def defect(question: str | None, answer: str | None, flagged: bool | None, copies: CopyDetector, languages: LanguageModel, terminal: TerminalModel) -> str | None:
    """The one defect of a pair, or None; the first that holds of empty, copies_question, refusal, other_language, truncated."""
    said = _defect_said(answer, flagged, copies)
    return said or _defect_of(answer, other_language(question or "", answer, languages), terminal)


def _defect_said(answer: str | None, flagged: bool | None, copies: CopyDetector) -> str | None:
    """A defect that neither language nor end decides, or None."""
    if is_empty(answer):
        return "empty"
    if copies.is_copy(answer):
        return "copies_question"
    return "refusal" if refuses(answer, flagged) else None


def _defect_of(answer: str, other: bool, terminal: TerminalModel) -> str | None:
    """The defect of an answer without one of those; ``other``: whether it is in another language."""
    return "other_language" if other else "truncated" if breaks_off(answer, terminal) else None


#: Characters of pairs whose languages are found at a time.
CHARS_AT_ONCE = 200_000


def found(questions: list[str | None], answers: list[str | None], copies: int, languages: LanguageModel, terminal: TerminalModel) -> list[tuple[str | None, str | None]]:
    """``defect`` of many pairs, without and with a flag."""
    first = [_defect_said(a, False, CopyDetector(q or "", copies)) for q, a in zip(questions, answers)]
    left = [k for k, x in enumerate(first) if x is None]
    out = [(x, x) for x in first]
    others = (x for part in in_parts([(questions[k] or "", answers[k]) for k in left], lambda pair: sum(map(len, pair)), CHARS_AT_ONCE) for x in other_languages(part, languages))
    for k, other in zip(left, others):
        kind = _defect_of(answers[k], other, terminal)
        out[k] = kind, "refusal" if _APOLOGY.search(answers[k].lower()) and refuses(answers[k], True) else kind
    return out


def models(documents: DataFrame, graded: DataFrame) -> tuple[LanguageModel, TerminalModel, int]:
    """Languages, terminal contexts, and ``most`` of copies, of all documents (``text, lang``) and all different gold answers (``question, gold_answer``) of the pairs.

    Tasks count what they read; the driver gets a number for each item, of pairs of words for those that were there more than once.
    """
    read = documents.where(F.col("text").isNotNull()).select(F.lit(None).cast("string").alias("question"), "text", label_column("lang").alias("label"), F.lit(False).alias("gold"))
    gold = graded.where("gold_answer IS NOT NULL").select("question", F.col("gold_answer").alias("text"), F.lit(None).cast("string").alias("label"), F.lit(True).alias("gold")).distinct()

    def tally(seen: dict[str, Counter], ended: dict[str, Counter], questions: list, texts: list, labels: list, golds: list) -> None:
        TerminalModel.tally(seen, ended, texts)
        for question, text, label, is_gold in zip(questions, texts, labels, golds):
            if is_gold:
                CopyDetector.tally(seen, question or "", text)
            tally_lines(seen, label, text)

    counted = tallied(read.unionByName(gold), tally).where(f"kind <> '{PAIR}' OR n > 1")
    seen, ended = defaultdict(Counter), defaultdict(Counter)
    for b in counted.orderBy("kind", "item").toArrow().to_batches():
        for kind, item, n, e in zip(*(c.to_pylist() for c in b.columns)):
            seen[kind][item] = n
            if e:
                ended[kind][item] = e
    return fit_all(documents, seen), TerminalModel.of(seen, ended), CopyDetector.most_of(seen)


_APOLOGY = re.compile("sorry|apolog|unfortunately")


def defects(pairs: DataFrame, flags: DataFrame, languages: LanguageModel, terminal: TerminalModel, key: str = "grade_id", *, copies: int = BYTES_LEFT) -> DataFrame:
    """``key, defect`` of every broken pair, once also where a row is repeated.

    ``pairs`` has ``key, question, generated_answer``; ``flags`` has ``key, insufficient_evidence``, true if any row of a key is. A null answer is
    empty; a null question leaves out copies and other languages; a null or missing flag says nothing. Of rows
    that share a key and differ, each gives its own defect. Texts are judged where they are, with and without a flag: only pairs that it makes
    a difference for look it up.
    """
    shared = pairs.sparkSession.sparkContext.broadcast((languages, terminal))

    @F.pandas_udf("plain string, flagged string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        spoken, ends = shared.value
        for question, answer in batches:
            yield pd.DataFrame(found([*question], [*answer], copies, spoken, ends), columns=["plain", "flagged"])

    # called non-deterministic, or the plan would judge a pair once for each use of the result
    judged = pairs.select(key, judge.asNondeterministic()("question", "generated_answer").alias("d")).select(key, "d.*")
    judged = written(judged.where("coalesce(plain, flagged) IS NOT NULL").distinct(), "judged-pairs")
    open_ = judged.where("NOT plain <=> flagged")
    flagged = flags.join(open_.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max("insufficient_evidence").alias("_flag"))
    looked_up = open_.join(flagged, key, "left").select(key, F.when(F.col("_flag"), F.col("flagged")).otherwise(F.col("plain")).alias("defect"))
    return judged.where("plain <=> flagged").select(key, F.col("plain").alias("defect")).unionByName(looked_up).where("defect IS NOT NULL").distinct()
