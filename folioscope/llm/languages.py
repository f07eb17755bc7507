"""Languages of documents, of their lines and of stretches of lines, by word-first backoff.

A known word gives its log frequency in every language; an unseen one falls back to its character
n-grams, the longest that are known first, then shorter ones, and to its script. The scores of a line's words add
up to a posterior over the languages, whose highest value is the confidence. The languages are those that the documents'
labels name; a line of which hardly a word is known in any of them is in none.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.readingform import LOOKALIKES, reading_form, same_alphabet_form
from folioscope.llm.shared import written

# For each language its two-letter code, three-letter codes and English name.
NAMES = {
    "bg": ("bul", "bulgarian"), "ca": ("cat", "catalan"), "cs": ("ces", "cze", "czech"), "da": ("dan", "danish"), "de": ("deu", "ger", "german"), "el": ("ell", "gre", "greek"),
    "en": ("eng", "english"), "es": ("spa", "spanish"), "et": ("est", "estonian"), "fi": ("fin", "finnish"), "fr": ("fra", "fre", "french"), "hr": ("hrv", "croatian"),
    "hu": ("hun", "hungarian"), "it": ("ita", "italian"), "ja": ("jpn", "japanese"), "ko": ("kor", "korean"), "lt": ("lit", "lithuanian"), "lv": ("lav", "latvian"),
    "nl": ("nld", "dut", "dutch"), "no": ("nor", "norwegian"), "pl": ("pol", "polish"), "pt": ("por", "portuguese"), "ro": ("ron", "rum", "romanian"), "ru": ("rus", "russian"),
    "sk": ("slk", "slo", "slovak"), "sl": ("slv", "slovenian"), "sv": ("swe", "swedish"), "tr": ("tur", "turkish"), "uk": ("ukr", "ukrainian"), "zh": ("zho", "chi", "chinese"),
}
_CODES = {name: code for code, names in NAMES.items() for name in (code, *names)}
#: What stands for a language that none of the labels names.
UNKNOWN = "und"

#: Documents of each label that the model is fitted on, those of the least hash; at most this many texts of at most ``LINES`` lines, those of the least hash, of ``CHARS`` characters each reach the driver.
SAMPLE, LINES, CHARS = 200, 60, 1000
LONGEST, SHORTEST = 4, 1
#: Weights of a word's n-grams against known words, and of a line's log score for the confidence, of which the fit takes what suits held-out lines best; lines held out, one of so many.
FALLBACKS, SMOOTHS, HELD_OUT = (0.5, 1.0, 1.5), (0.35, 0.5, 0.7, 1.0), 10
#: A label's language whose words are to this share known in one other language, with a tenth of its lines at most, is a wrong label for that one.
SWALLOWED = 0.7

_WORD = re.compile(r"[^\W\d_]+")
_EAST = re.compile(r"[぀-ヿㇰ-ㇿ㐀-䶿一-鿿가-힯]")
_LATIN, _LIKE_LATIN = re.compile(r"[a-zß-öø-ɏ]"), re.compile(r"[Ͱ-ԯԱ-֏]")
# First and last letters of scripts, by Unicode block.
_SCRIPTS = (("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))


def script_of(word: str) -> str:
    """Script of a word's first letter."""
    c = ord(word[0])
    return next((name for name, a, b in _SCRIPTS if a <= c <= b), "other")


def language_of_label(label: str | None) -> str | None:
    """Two-letter code a label names (code, code with a region, three-letter code or English name, any case), else None."""
    if label is None:
        return None
    plain = label.strip().lower()
    return _CODES.get(plain) or (_CODES.get(re.split(r"[-_]", plain)[0]) if re.fullmatch(r"[a-z]{2,3}[-_]\w{2,8}", plain) else None)


def label_column(column: str):
    """``language_of_label`` as a column expression."""
    plain = F.lower(F.trim(F.col(column)))
    names = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return F.coalesce(names[plain], F.when(plain.rlike(r"^[a-z]{2,3}[-_]\w{2,8}$"), names[F.regexp_extract(plain, r"^([a-z]{2,3})", 1)]))


_CYRILLIC = {latin: letter for letter, latin in LOOKALIKES.items() if "а" <= letter <= "я"}


def _one_alphabet(word: str) -> str:
    """A word with letters of two alphabets in one: in that of which it has more letters that look like none of the other, Latin if as many."""
    cyrillic = sum("а" <= c <= "я" and c not in LOOKALIKES for c in word) - sum(bool(_LATIN.match(c)) and c not in _CYRILLIC for c in word)
    if cyrillic <= 0:
        return reading_form(word.upper()).lower()  # more capitals than small letters look alike
    return "".join(_CYRILLIC.get(c, c) for c in word)


def words_of(line: str) -> list[str]:
    """Words of a line in lower case; text written without spaces gives its characters' pairs."""
    return _words(same_alphabet_form(line).lower())


def _words(lower: str) -> list[str]:
    words = _WORD.findall(lower)
    if lower.isascii():
        return words
    if _LIKE_LATIN.search(lower):
        words = [_one_alphabet(w) if _LIKE_LATIN.search(w) and _LATIN.search(w) else w for w in words]
    if not _EAST.search(lower):
        return words
    return [x for w in words for x in ([w[i : i + 2] for i in range(max(1, len(w) - 1))] if _EAST.search(w) else [w])]


def _grams(word: str, n: int) -> list[str]:
    w = f"␂{word}␃"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class LanguageModel:
    """Log frequencies of words (rows of a matrix), n-grams and scripts, a value for each language."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[int, dict[str, np.ndarray]]
    scripts: dict[str, np.ndarray]
    fallback: float = FALLBACKS[0]
    smooth: float = SMOOTHS[1]
    strange: float = 0.0  # a line of four words or more of which a smaller share is known is in no language

    def __post_init__(self) -> None:
        self.rows = {w: i for i, w in enumerate(self.words)}
        self.matrix = np.array(list(self.words.values())) if self.words else np.zeros((0, len(self.languages)))
        self.memo: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        """Items as lists and their values as one matrix each, which travel much faster than an array for each item."""
        packed = lambda d: ([*d], np.array([*d.values()]).reshape(len(d), len(self.languages)).astype(np.float32))
        return self.__dict__ | {"words": packed(self.words), "grams": {n: packed(g) for n, g in self.grams.items()}, "matrix": None, "rows": None, "memo": {}}

    def __setstate__(self, state: dict) -> None:
        unpacked = lambda p: dict(zip(p[0], p[1].astype(float)))
        self.__dict__.update(state | {"words": unpacked(state["words"]), "grams": {n: unpacked(g) for n, g in state["grams"].items()}})
        self.rows = {w: i for i, w in enumerate(self.words)}
        self.matrix = state["words"][1].astype(float)

    def backoff(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """What the n-grams of a word that isn't known say, the longest that are known, less where few are, and what its script says; 0 where nothing is known."""
        none = np.zeros(len(self.languages))
        script = self.scripts.get(script_of(word), none)
        for n in range(min(LONGEST, len(word) + 2), SHORTEST - 1, -1):
            hits = [v for g in _grams(word, n) if (v := self.grams[n].get(g)) is not None]
            if hits:
                return np.mean(hits, axis=0) * min(1.0, len(hits) / 2), script
        return none, script

    def unseen(self, word: str) -> np.ndarray:
        """Score of a word that isn't known."""
        if (seen := self.memo.get(word)) is not None:
            return seen
        grams, script = self.backoff(word)
        score = self.fallback * grams + script
        if len(self.memo) < 200_000:
            self.memo[word] = score
        return score

    def posteriors(self, lines: list[list[str]], smooth: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each line of words the probability of each language, and the share of its words that are known. No line may be empty.

        The words' scores are added up and flattened by ``smooth``."""
        flat, sizes, at = self._rows_of(lines)
        starts = np.cumsum(sizes) - sizes
        known = at >= 0
        if known.all():
            scores = self.matrix[at]
        else:
            scores = np.empty((len(flat), len(self.languages)))
            scores[known] = self.matrix[at[known]]
            scores[~known] = [self.unseen(flat[k]) for k in np.flatnonzero(~known).tolist()]
        total = (self.smooth if smooth is None else smooth) * np.add.reduceat(scores, starts, axis=0)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), np.add.reduceat(known.astype(float), starts) / sizes

    def _rows_of(self, lines: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All words of the lines, the number of each line's, and each word's row of the matrix, -1 for one that isn't known."""
        flat = [*chain.from_iterable(lines)]
        return flat, np.fromiter(map(len, lines), np.int64, len(lines)), np.fromiter(map(self.rows.get, flat, repeat(-1)), np.int64, len(flat))

    def posterior(self, words: list[str], smooth: float | None = None) -> np.ndarray:
        return self.posteriors([words], smooth)[0][0]

    def texts(self, texts: Iterable[str | None]) -> Iterator[list[dict]]:
        """For each text ``line_no, lang, confidence, words`` of every line that has words. Equal scores go to the first code.

        Lines are scored together, some ten thousand words at a time."""
        held: list[list[tuple[int, list[str]]]] = []
        size = 0
        for text in texts:
            held.append([(i, words) for i, line in enumerate(same_alphabet_form(text or "").lower().split("\n"), 1) if (words := _words(line))])
            size += sum(len(w) for _, w in held[-1])
            if size > 20_000:
                yield from self._scored(held)
                held, size = [], 0
        yield from self._scored(held)

    def _scored(self, held: list[list[tuple[int, list[str]]]]) -> Iterator[list[dict]]:
        every = [w for lines in held for _, w in lines]
        if every:
            p, known = self.posteriors(every)
            best = p.argmax(axis=1)
            langs, sure = [self.languages[k] for k in best], p[np.arange(len(best)), best].tolist()
            for k in np.flatnonzero(known < self.strange):
                if len(every[k]) >= 4:
                    langs[k], sure[k] = UNKNOWN, 1.0 - float(known[k])
        at = 0
        for lines in held:
            yield [{"line_no": n, "lang": langs[k], "confidence": sure[k], "words": len(w)} for k, (n, w) in enumerate(lines, at)]
            at += len(lines)

    def lines(self, text: str | None) -> list[dict]:
        return next(self.texts([text]))


def _table(counts: dict[str, Counter], languages: list[str], floor: float, least: int) -> dict[str, np.ndarray]:
    """Log relative frequency of each item in every language, smoothed by ``floor``, less its mean over languages."""
    totals = np.array([sum(counts[lang].values()) for lang in languages], dtype=float)
    total = sum((counts[lang] for lang in languages), Counter())
    size = max(1, len(total))
    out = {}
    for item, n in total.items():
        if n >= least:
            v = np.log((np.array([counts[lang][item] for lang in languages], dtype=float) + floor) / (totals + floor * size))
            out[item] = v - v.mean()
    return out


def _counted(lines: Iterable[tuple[str, list[str]]]) -> dict[str, Counter]:
    words = defaultdict(Counter)
    for label, ws in lines:
        words[label].update(ws)
    return words


def _model(words: dict[str, Counter], languages: list[str]) -> LanguageModel:
    """A model of each language's words and how often they are there."""
    words = defaultdict(Counter, {label: words[label] for label in languages if label in words})
    scripts, grams = defaultdict(Counter), {n: defaultdict(Counter) for n in range(SHORTEST, LONGEST + 1)}
    for label in languages:
        for w, n in words[label].items():
            scripts[label][script_of(w)] += n
            for size in grams:
                for g in _grams(w, size):
                    grams[size][label][g] += min(n, 20)  # a frequent word doesn't make its letters frequent
    return LanguageModel(languages, _table(words, languages, 0.5, 2), {n: _table(grams[n], languages, 0.5, 2) for n in grams}, _table(scripts, languages, 0.5, 1))


def _named(words: dict[str, Counter], size: Counter) -> list[str]:
    """The languages of the labels, without those that are wrong labels only: few lines (``size``), whose words are mostly known in one other language."""
    total = {label: c.total() for label, c in words.items()}
    # known is what the other has more than once, and a tenth as often, or it is there by some lines of this language in its texts
    known = lambda w, n, a, b: words[b][w] > 1 and 10 * words[b][w] * total[a] >= (n - 1) * total[b]
    share = lambda a, b: sum(n for w, n in words[a].items() if known(w, n, a, b)) / max(1, total[a])
    wrong = {a for a in words for b in words if size[a] * 10 <= size[b] and share(a, b) >= SWALLOWED}
    return sorted(set(words) - wrong) or ["en"]


def _clear(model: LanguageModel, lines: list[str]) -> Iterator[tuple[str, str, bool]]:
    """(language found, line, whether it is held out) of the lines, words joined by spaces, whose language is clear."""
    p, _ = model.posteriors([line.split(" ") for line in lines])
    for k, line, top in zip(p.argmax(axis=1).tolist(), lines, p.max(axis=1).tolist()):
        if top >= 0.8:
            yield model.languages[k], line, xxhash.xxh3_64_intdigest(line) % HELD_OUT == 0


#: Weights that are tried.
_TRIED = [(f, s) for f in FALLBACKS for s in SMOOTHS]


def in_parts[T](items: Iterable[T], size: Callable[[T], int], most: int) -> Iterator[list[T]]:
    """The items in order, in lists that end with the item that brings their size over ``most``."""
    part, held = [], 0
    for x in items:
        part.append(x)
        held += size(x)
        if held > most:
            yield part
            part, held = [], 0
    if part:
        yield part


#: Words of held-out lines that are weighed at a time.
WEIGHED = 50_000


def _suits(model: LanguageModel, held: Iterable[tuple[str, list[str], int]]) -> tuple[list[float], int, int, float]:
    """For held-out lines (language, words, how often they were there) and their first words alone the sum of the log probabilities under each of the weights, and their number; the number of lines of four words or more, and the least share of known words of one."""
    logs, parts, lines, least = np.zeros(len(_TRIED)), 0, 0, 1.0
    for part in in_parts(held, lambda x: len(x[1]), WEIGHED):
        found = _suits_part(model, part)
        logs, parts, lines, least = logs + found[0], parts + found[1], lines + found[2], min(least, found[3])
    return logs.tolist(), parts, lines, least


def _suits_part(model: LanguageModel, held: list[tuple[str, list[str], int]]) -> tuple[np.ndarray, int, int, float]:
    flat, sizes, rows = model._rows_of([ws for _, ws, _ in held])
    starts, known, times = np.cumsum(sizes) - sizes, rows >= 0, np.array([n for *_, n in held])
    shares, long = np.add.reduceat(known.astype(float), starts) / sizes, sizes >= 4
    # what words, n-grams and scripts say of each word
    said = np.zeros((len(flat), 3, len(model.languages)))
    said[known, 0] = model.matrix[rows[known]]
    unseen = np.flatnonzero(~known).tolist()
    if unseen:
        backoff = {w: model.backoff(w) for w in {flat[k] for k in unseen}}
        said[unseen, 1:] = [backoff[flat[k]] for k in unseen]
    heads = [said[starts]]
    for n in (1, 2):
        heads.append(heads[-1] + np.where((sizes > n)[:, None, None], said[np.minimum(starts + n, len(flat) - 1)], 0.0))
    at = {lang: k for k, lang in enumerate(model.languages)}
    named = [k for k, (lang, *_) in enumerate(held) if lang in at]
    sums, truth = np.stack([*heads, np.add.reduceat(said, starts)])[:, named], np.array([at[held[k][0]] for k in named], dtype=np.int64)

    def sum_log(fallback: float, smooth: float) -> float:
        total = smooth * (sums[:, :, 0] + fallback * sums[:, :, 1] + sums[:, :, 2])
        total -= total.max(axis=2, keepdims=True)
        return float(((total[:, np.arange(len(truth)), truth] - np.log(np.exp(total).sum(axis=2))) * times[named]).sum())

    return np.array([sum_log(*x) if named else 0.0 for x in _TRIED]), 4 * int(times[named].sum()), int(times[long].sum()), float(shares[long].min(initial=1.0))


def _weigh(model: LanguageModel, logs: list[float], parts: int, lines: int, least: float) -> LanguageModel:
    """Sets the weights that give held-out lines, and their first words alone, the highest mean log probability; and how strange a line must be to be in no language."""
    if parts:
        model.fallback, model.smooth = max(zip(_TRIED, logs), key=lambda x: round(x[1] / parts, 9))[0]
        model.strange = 0.3 * least if lines >= 200 else 0.0
    return model


def fit(samples: list[tuple[str, str]]) -> LanguageModel:
    """A model of (label, text) pairs.

    In a second round a line counts for the language found for it, if that is clear, so wrong labels and mixed texts lose
    their weight. One line of ``HELD_OUT`` is left out of it, and the weights are those that suit these lines best.
    """
    lines = [(label, line) for label, text in samples for line in _lines_of(text)]
    words = _counted((label, line.split(" ")) for label, line in lines)
    languages = _named(words, Counter(label for label, _ in lines))
    first = _model(words, languages)
    if not lines:
        return first
    clear = [*_clear(first, [line for _, line in lines])]
    model = _model(_counted((lang, line.split(" ")) for lang, line, out in clear if not out), languages)
    return _weigh(model, *_suits(model, ((lang, line.split(" "), 1) for lang, line, out in clear if out)))


#: Different items that a task counts before it gives their numbers on.
ITEMS = 500_000
#: (group, item) to how often it was there, and how often at an end.
Tally = dict[str, Counter]


def tallied(rows: DataFrame, tally: Callable[..., None]) -> DataFrame:
    """``kind, item, n, ended``: what ``tally(seen, ended, *columns)`` counts of the rows, one batch after the other, by kind and item; combined in each task, so that few rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            kinds = [k for k, c in seen.items() for _ in c]
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([x for c in seen.values() for x in c], pa.string()), pa.array([n for c in seen.values() for n in c.values()], pa.int64()), pa.array([ended[k][x] for k, c in seen.items() for x in c], pa.int64())], names=["kind", "item", "n", "ended"])

        seen, ended = defaultdict(Counter), defaultdict(Counter)
        for b in batches:
            tally(seen, ended, *(c.to_pylist() for c in b.columns))
            if sum(map(len, seen.values())) > ITEMS:
                yield made()
                seen, ended = defaultdict(Counter), defaultdict(Counter)
        yield made()

    return rows.mapInArrow(run, "kind string, item string, n long, ended long").groupBy("kind", "item").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended"))


class Pieces(dict):
    """What ``of`` makes of a piece of text between spaces; short ones are kept, ``MOST`` at a time, as most come again. A line feed is a piece of its own and stays one."""

    MOST, LONGEST = 50_000, 40

    def __init__(self, of: Callable[[str], object]):
        super().__init__()
        self.of = of

    def __missing__(self, piece: str) -> object:
        made = self.of(piece)
        if len(piece) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = made
        return made


_SAID = Pieces(lambda piece: piece if piece == "\n" else " ".join(words_of(piece)))


def _lines_of(text: str) -> list[str]:
    """The words of each line that has some, joined by spaces."""
    said = " ".join(filter(None, map(_SAID.__getitem__, text.replace("\n", " \n ").split(" "))))
    return [line for x in said.split("\n") if (line := x.strip(" "))]


#: Kinds of what ``tally_lines`` counts: words of a label, and lines of labels.
WORDS, LABELS = "words ", "labels"


def tally_lines(seen: Tally, label: str | None, text: str | None) -> None:
    """Counts the lines and words of a labelled text."""
    if label and text:
        if lines := _lines_of(text):
            seen[WORDS + label].update(" ".join(lines).split(" "))
            seen[LABELS][label] += len(lines)


def fit_all(documents: DataFrame, counts: dict[str, Counter], text: str = "text", label: str = "lang") -> LanguageModel:
    """What ``fit`` makes of the texts of all documents whose label names a language; ``counts`` is what ``tally_lines`` counted of them. Tasks read the texts; counts of words come to the driver."""
    words = {kind.removeprefix(WORDS): c for kind, c in counts.items() if kind.startswith(WORDS)}
    languages = _named(words, counts.get(LABELS, Counter()))
    first = _model(words, languages)
    if not words:
        return first
    context = documents.sparkSession.sparkContext
    one, many = context.broadcast(first), "held "

    def tally(seen: Tally, ended: Tally, texts: list[str]) -> None:
        held: list[str] = []
        for k, t in enumerate(texts, 1):
            held += _lines_of(t)
            if held and (len(held) > 2_000 or k == len(texts)):
                own = defaultdict(list)
                for lang, line, out in _clear(one.value, held):
                    if out:  # as a line, the same ones once
                        seen[many + lang][line] += 1
                    else:
                        own[lang].append(line)
                for lang, lines in own.items():
                    seen[WORDS + lang].update(" ".join(lines).split(" "))
                held = []

    second = written(tallied(documents.where(F.col(text).isNotNull() & label_column(label).isNotNull()).select(text), tally), "clear-lines")
    own = defaultdict(Counter)
    for r in second.where(F.col("kind").startswith(WORDS)).orderBy("kind", "item").toArrow().to_pylist():
        own[r["kind"].removeprefix(WORDS)][r["item"]] = r["n"]
    model = _model(own, languages)
    two = context.broadcast(model)

    def suits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs, parts, lines, least = _suits(two.value, ((kind.removeprefix(many), item.split(" "), n) for kind, item, n in zip(*(c.to_pylist() for c in b.columns))))
            yield pa.RecordBatch.from_arrays([pa.array([logs], pa.list_(pa.float64())), pa.array([parts], pa.int64()), pa.array([lines], pa.int64()), pa.array([least])], names=["logs", "parts", "lines", "least"])

    each = second.where(F.col("kind").startswith(many)).select("kind", "item", "n").mapInArrow(suits, "logs array<double>, parts long, lines long, least double")
    r = each.agg(*[F.sum(F.col("logs")[k]).alias(f"l{k}") for k in range(len(_TRIED))], F.sum("parts").alias("parts"), F.sum("lines").alias("lines"), F.min("least").alias("least")).first()
    return _weigh(model, [r[f"l{k}"] or 0.0 for k in range(len(_TRIED))], r["parts"] or 0, r["lines"] or 0, 1.0 if r["least"] is None else r["least"])


def sample(documents: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", each: int = SAMPLE) -> list[tuple[str, str]]:
    """(language, text) of at most ``each`` documents of each label that names a language: those with the least hash of the key, and of each the ``LINES`` lines with the least hash, in any order, cut at ``CHARS`` characters."""
    rows = documents.where(F.col(text).isNotNull() & label_column(label).isNotNull())
    rows = rows.select(label_column(label).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).alias("text"))
    thin = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    # a threshold on the hash keeps four times the sample at most in each language, before the exact cut
    ranked = rows.join(F.broadcast(thin), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= F.lit(4.0 * each))
    hashed = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), F.substring(x, 1, CHARS).alias("x")))
    lines = F.array_join(F.transform(F.slice(F.array_sort(hashed), 1, LINES), lambda x: x["x"]), "\n")
    cut = ranked.select("lang", "h", lines.alias("text")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= each)
    return [(r["lang"], r["text"]) for r in cut.select("lang", "text").orderBy("lang", "text").collect()]


def line_languages(documents: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``key, label_lang, lines`` for each row, where ``lines`` has ``line_no, lang, confidence, words`` of every line with words.

    Lines are split at the line feed and numbered from 1, blank ones counted. A null or empty text
    has no lines; a label that names no language gives a null ``label_lang``; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<line_no:int,lang:string,confidence:double,words:int>>")
    def lines(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in texts:
            yield pd.Series([*m.texts(s)], index=s.index, dtype=object)

    # called non-deterministic, or exploding the result would make the plan judge a text twice
    found = documents.select(F.col(key), label_column(label).alias("label_lang"), lines.asNondeterministic()(F.col(text)).alias("lines"))
    if not model.strange:
        return found
    # a language that only this label names is what an unknown one is
    named = F.when(F.col("label_lang").isin(model.languages), None).otherwise(F.col("label_lang"))
    as_named = F.transform("lines", lambda x: x.withField("lang", F.when(x["lang"] == UNKNOWN, F.coalesce(named, F.lit(UNKNOWN))).otherwise(x["lang"])))
    return found.withColumn("lines", F.when(named.isNull(), F.col("lines")).otherwise(as_named))


def mislabelled_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, line_no, lang`` of each line that is not in the language its document's label names, once also for repeated rows."""
    rows = lines.select(key, "label_lang", F.explode("lines").alias("x"))
    return rows.where(F.col("label_lang").isNull() | (F.col("label_lang") != F.col("x.lang"))).select(key, "x.line_no", "x.lang").distinct()


def stretches(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, from_line, to_line, lang, confidence``: runs of lines in one language; lines without words don't end a run. The confidence is the mean of the lines', by words."""

    @F.pandas_udf("array<struct<from_line:int,to_line:int,lang:string,confidence:double>>")
    def runs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for found in s:
                own = []
                for x in found if found is not None else ():
                    mass = x["confidence"] * x["words"]
                    if own and own[-1]["lang"] == x["lang"]:
                        own[-1] |= {"to_line": x["line_no"], "mass": own[-1]["mass"] + mass, "words": own[-1]["words"] + x["words"]}
                    else:
                        own.append({"from_line": x["line_no"], "to_line": x["line_no"], "lang": x["lang"], "mass": mass, "words": x["words"]})
                out.append([{"from_line": r["from_line"], "to_line": r["to_line"], "lang": r["lang"], "confidence": round(r["mass"] / r["words"], 6)} for r in own])
            yield pd.Series(out, index=s.index, dtype=object)

    return lines.select(key, F.explode(runs.asNondeterministic()("lines")).alias("s")).select(key, "s.from_line", "s.to_line", "s.lang", "s.confidence")


def document_languages(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, label_lang, lang, confidence, languages``: the language with most words, the share of words in it times their confidence, and all languages in code order. A text without words has a null language and confidence 0."""
    by = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["lang"])))
    mass = lambda code: F.aggregate("lines", F.lit(0.0), lambda a, x: a + F.when(x["lang"] == code, x["confidence"] * x["words"]).otherwise(0.0))
    total = F.aggregate("lines", F.lit(0), lambda a, x: a + x["words"])
    scored = lines.withColumn("_by", F.transform(by, lambda c: F.struct((-mass(c)).alias("m"), c.alias("c")))).withColumn("_top", F.array_min("_by"))
    return scored.select(key, "label_lang", F.col("_top.c").alias("lang"), F.round(F.coalesce(-F.col("_top.m") / total, F.lit(0.0)), 6).alias("confidence"), by.alias("languages"))
