"""Language of a text and of each of its segments, by a word-first backoff.

Method: a word that the model knows scores by its log frequency in each language; a word it does not know falls back
to character n-grams, the longest first, each place of the word taking the longest n-gram that is known.  A segment
is a sentence or, where neighbouring sentences agree, a run of them; its language is the one with the best summed
score and its confidence the share of that language in the tempered scores.

The model is fitted on a bounded sample of labelled texts.  Labels may be wrong: sentences that the first model
assigns to another language than their label change sides before the next fit.  Everything here is plain Python.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np

# What names each language, and some of its commonest words to start from.
NAMES = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish", "pt": "pt por portuguese",
    "it": "it ita italian", "pl": "pl pol polish", "ru": "ru rus russian", "uk": "uk ukr ukrainian", "zh": "zh zho chi chinese",
}
COMMON = {
    "en": "the of and to is are that in it for with as on be at by this have from or one which you not all there when can each if how many an",
    "de": "der die das und ist nicht ein eine zu von mit auf für den dem des sich werden es wird wenn wie viele oder sind aus an im bei nur",
    "fr": "le la les de des et est un une du en que qui dans pour sur pas plus avec ne se au par sont ce il ou chaque combien lorsque vous",
    "es": "el la los las de y es un una en que por con para no se del al lo como más cada hay si cuántos cuando su son te entre",
    "pt": "o a os as de e é um uma em que por com para não se do da no na como mais cada há quantos quando são você entre ao dos",
    "it": "il lo la i gli le di e è un una in che per con non si del della al come più ogni ci sono se quanti quando tra da nel",
    "pl": "i w na z do nie się że jest to o od za po jak ile dla oraz który która są każdy przez liczb tylko czy lub gdy być ze",
    "ru": "и в на не что с по для из как это к от за если сколько или при между чтобы число только каждый есть до вам он она все",
    "uk": "і в на не що з за для із як це до від та якщо скільки або при між щоб число тільки кожен є вам він вона всі й у",
    "zh": "的 是 在 有 和 了 不 个 为 中 请 求 出 多少 如果 每个 从 到 一 两 一个 之间",
}
LANGUAGES = tuple(NAMES)
# Cyrillic in Latin letters, as common romanisations have it, and what differs for Ukrainian.
LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".split()))
LATIN_UK = LATIN | {"г": "h", "ґ": "g", "и": "y", "і": "i", "ї": "yi", "є": "ye"}
# Letters whose plain spelling is more than the letter without its mark.
PLAIN = {"de": {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}, "pl": {"ł": "l"}}
_LABELS = {name: code for code, names in NAMES.items() for name in names.split()}
LONGEST_GRAM = 5
#: Sentences with fewer words (or characters of Chinese) are headings or scraps.
LEAST_WORDS, LEAST_HAN = 3, 4
#: Scores are divided by this before they become confidences.
TEMPERATURE = 2.0
CONFIDENT = 0.7

_HAN = "㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{_HAN}]|[^\W\d_{_HAN}]+(?:['’ʼ][^\W\d_{_HAN}]+)*")
_SENTENCE = re.compile(r"[^.!?。！？…]*[.!?。！？…]+[\"'»”)\]]*|[^.!?。！？…]+")
_RULE = re.compile(r"^\s*(?:[-=*_~#]{3,}.*|.*[-=*_~]{3,})\s*$")
_CODE = re.compile(r"[{};=]\s*$|^\s*(?:def |for |while |if |return |print|import |class |#include|\w+\s*=)|\w\(.*\)\s*$|^\s*[>|]")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_INVISIBLE = re.compile(r"[­​-‏⁠﻿]")


def named_languages(label: str | None) -> set[str]:
    """The languages a stored label names, by code, regional code or English name; it may name several."""
    out = set()
    for part in re.split(r"[^A-Za-z_\-]+", label or ""):
        bare = part.lower().strip("-_")
        code = _LABELS.get(bare) or _LABELS.get(re.split(r"[-_]", bare)[0])
        if code:
            out.add(code)
    return out


def words_of(text: str) -> list[str]:
    """Words in small letters and composed form; Chinese characters stand alone."""
    return _WORD.findall(unicodedata.normalize("NFC", _INVISIBLE.sub("", text)).lower())


def _romanised(word: str, table: dict) -> str:
    return "".join(table.get(c, c) for c in word).replace("_", "").replace("'", "").replace("’", "")


def respelt(words: list[str], code: str) -> list[list[str]]:
    """The same words as they are spelt without marks or in Latin letters, where that differs."""
    if code in ("ru", "uk"):
        return [[_romanised(w, t) for w in words] for t in ((LATIN,) if code == "ru" else (LATIN_UK, LATIN | LATIN_UK | {"г": "g", "и": "i", "ї": "i"}))] if any("а" <= w[0] <= "ї" for w in words) else []
    table = str.maketrans(PLAIN.get(code, {}))
    strip = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    out = [[strip(w.translate(table)) for w in words]]
    if code == "de":
        out.append([strip(w.replace("ß", "ss")) for w in words])
    return [v for v in out if v != words]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of prose: no rules, headings, fenced or plain code, sample data."""
    out, at, fenced = [], 0, False
    for line in re.split(r"(\r\n|\r|\n)", text):
        start, at = at, at + len(line)
        if line in ("\r\n", "\r", "\n") or not line.strip():
            continue
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or _RULE.match(line) or _CODE.search(line):
            continue
        for m in _SENTENCE.finditer(line):
            piece = m.group(0)
            if not piece.strip():
                continue
            words = words_of(piece)
            han = sum(1 for w in words if "㐀" <= w[0] <= "鿿" or "豈" <= w[0] <= "﫿")
            if han >= LEAST_HAN or len([w for w in words if len(w) > 1]) >= LEAST_WORDS:
                lead = len(piece) - len(piece.lstrip())
                out.append((start + m.start() + lead, start + m.start() + len(piece.rstrip())))
    return out


def _grams(word: str, n: int):
    padded = f" {word} "
    return (padded[i : i + n] for i in range(len(padded) - n + 1))


class Model:
    """Log frequencies of words, and of n-grams by length, per language."""

    def __init__(self, words: dict[str, np.ndarray], grams: dict[str, np.ndarray], unseen: np.ndarray):
        self.words, self.grams, self.unseen = words, grams, unseen
        self._held: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        """Scores of a word: its own, or the mean over its places of the longest known n-gram from there on."""
        known = self.words.get(w)
        if known is not None:
            return known
        held = self._held.get(w)
        if held is None:
            padded, total, places, at = f" {w} ", np.zeros(len(LANGUAGES)), 0, 0
            while at < len(padded):
                for n in range(min(LONGEST_GRAM, len(padded) - at), 0, -1):
                    g = self.grams.get(padded[at : at + n])
                    if g is not None:
                        total, at = total + g, at + n
                        break
                else:
                    total, at = total + self.unseen, at + 1
                places += 1
            held = total / max(1, places)
            if len(self._held) < 200_000:
                self._held[w] = held
        return held

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(LANGUAGES))
        for w in words:
            if len(w) > 1 or w >= "㐀":  # single letters are variables
                out = out + self.word(w)
        return out

    def classify(self, words: list[str]) -> tuple[str | None, float]:
        """Language and confidence; none without a word."""
        s = self.scores(words)
        if not s.any():
            return None, 0.0
        best = int(s.argmax())
        return LANGUAGES[best], float(1 / np.exp((s - s[best]) / TEMPERATURE).sum())

    def segments(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence): sentences, neighbours of one language joined."""
        out: list[list] = []
        for s, e in sentences(text or ""):
            words = words_of(text[s:e])
            code, sure = self.classify(words)
            if code is None:
                continue
            if out and out[-1][2] == code:
                n, m = out[-1][4], len(words)
                out[-1][1], out[-1][3], out[-1][4] = e, (out[-1][3] * n + sure * m) / (n + m), n + m
            else:
                out.append([s, e, code, sure, len(words)])
        return [tuple(x[:4]) for x in out]

    def sentence_languages(self, text: str | None, confident: float = CONFIDENT) -> set[str]:
        """The languages of at least one whole sentence each."""
        found = set()
        for s, e in sentences(text or ""):
            code, sure = self.classify(words_of(text[s:e]))
            if code and sure >= confident:
                found.add(code)
        return found

    def document(self, text: str | None) -> tuple[str | None, float]:
        """The language with the most words of prose, with the share of that in the sure ones; a text without a
        sentence is judged by all its words."""
        weight: Counter = Counter()
        for s, e in sentences(text or ""):
            words = words_of(text[s:e])
            code, sure = self.classify(words)
            if code:
                weight[code] += len(words) * sure
        if weight:
            code, most = min(weight.items(), key=lambda x: (-x[1], x[0]))
            return code, most / sum(weight.values())
        return self.classify(words_of(text or ""))


def _tables(counts: dict[str, list[float]], smooth: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Log frequencies centred over the languages, so that no language gains by knowing fewer words."""
    names = list(counts)
    if not names:
        return {}, np.zeros(len(LANGUAGES))
    a = np.array([counts[w] for w in names]) + smooth
    logs = np.log(a / a.sum(0, keepdims=True))
    centre = np.log(smooth / a.sum(0))
    return dict(zip(names, logs - logs.mean(1, keepdims=True))), centre - centre.mean()


def fit_once(labelled: list[tuple[list[str], int, float]]) -> Model:
    """A model from (words, language number, weight); Latin, small and accented forms are the words as they stand."""
    counts: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(LANGUAGES))
    for i, code in enumerate(LANGUAGES):
        for w in COMMON[code].split():
            counts[w][i] += 2.0
    for words, i, weight in labelled:
        for w in words:
            if len(w) > 1 or w >= "㐀":
                counts[w][i] += weight
    # every language the same mass, so rare languages are not drowned
    total = np.array([sum(c[i] for c in counts.values()) for i in range(len(LANGUAGES))])
    scale = np.maximum(total, 1.0).max() / np.maximum(total, 1.0)
    grams: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(LANGUAGES))
    for w, c in counts.items():
        for i, n in enumerate(c):
            if n:
                weight = math.log1p(n)
                for size in range(1, LONGEST_GRAM + 1):
                    for g in _grams(w, size):
                        grams[g][i] += weight
    words, _ = _tables({w: [n * s for n, s in zip(c, scale)] for w, c in counts.items()}, 0.5)
    return Model(words, *_tables(grams, 0.5))


def train(labelled: list[tuple[str | None, str | None]], rounds: int = 3) -> Model:
    """A model from (text, label); labels that name no or several languages only take part after the first fit."""
    items = []
    for text, label in labelled:
        names = named_languages(label)
        only = LANGUAGES.index(next(iter(names))) if len(names) == 1 else None
        for s, e in sentences(text or ""):
            items.append((words_of(text[s:e]), only))
    # at first a language's common words and its labels vouch for a sentence together
    first = [(w, i, 1.0) for w, i in items if i is not None]
    model = fit_once(first + [(v, i, 0.5) for w, i, _ in first for v in respelt(w, LANGUAGES[i])])
    for _ in range(rounds):
        sided = []
        for words, i in items:
            code, sure = model.classify(words)
            if code and sure >= 0.5:
                i = LANGUAGES.index(code)
                # a sentence vouches for its other spellings too, but less than one that is really spelt so
                sided += [(words, i, 1.0), *((v, i, 0.5) for v in respelt(words, code))]
        model = fit_once(sided)
    return model
