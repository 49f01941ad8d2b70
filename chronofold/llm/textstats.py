"""Text statistics per document, and what kind of text its lines are: prose, list, table or junk.

Every line is reduced to statistics: its form (a sentence, an enumeration's entry, a table's cell, markup, letters that are no language, a shout and
so on), its length, and its shares of digits and of signs. A hidden Markov model with a state per kind labels the lines of each
document by Viterbi, so that lines that say little by themselves (bare names, the end of a wrapped sentence, a parameter of a
template) follow their surroundings. Label shares are then summed up per document by characters. Lines are labelled for many
documents at a time.

The model is fitted by expectation and maximisation on all lines of all documents, from chances that say no more than which
forms belong to which kind, so a state keeps its meaning; before it the letter pairs of all texts are counted, whose chances tell unusual letters from
those of the corpus. The lines' classes are worked out once and written to the shared folder (see ``settled``); a round reads them and brings only sums
to the driver. Letters count as no language only if they are unlike the corpus and also unlike any language: too many words
without vowels, runs of consonants, capitals at the ends of words, marks before words. A language that the corpus doesn't have is read as prose.

Defined cases: null, empty and blank texts and redirects have no kind and shares of 0; the statistics count all lines, the shares of kinds all but
headings, category links and stub marks; a document without other lines has no kind; line length and number are not limited; the kind is null for a
document of which at least half is prose, and ties go by the order list, table, junk; an empty table is described by the chances as they start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.common import settled

STATES = ("prose", "list", "table", "junk")
#: Words that are common in the languages of the corpus, by language so that one can be added; a word counts whatever the text's language.
COMMON_WORDS = {
    "en": """the of and a an to in was is are were be been it its that this these which who whom by had has have not no from with without on
        for as at but or most more than than after before until when there their his her he she they one two about into over all
        between also only other some such during""",
    "de": """der die das den dem des ein eine einer einem einen und oder von vom im in zu zum zur ist sind war waren wurde wurden wird mit für
        auf aus als am an dass sich nicht noch nach bei bis über unter durch ohne um auch nur sie er es dieser diese dieses seit
        mehr""",
    "es": """el la los las lo un una unos unas de del y o que en por para con sin su sus se es son fue fueron era ha han al no más como pero
        aunque todavía desde hasta entre sobre muy según hay este esta""",
    "fr": """le les un une des du et ou que qui dont en dans par pour sur sous au aux est sont était a été ont il elle son sa ses leur ne pas
        plus mais avec sans cette ce bien selon encore depuis on se""",
    "ja": """の は を に が で と も へ や から まで より など する した して された される ある いる である だった という という によれば にわたり""",
    "ru": """и в во на не но а что по из с со от до для как был была были без за о об он она они это этот эта или при после лет более же к
        у его её их все хотя сих пор году том который которая""",
}
COMMON = frozenset(w for text in COMMON_WORDS.values() for w in text.split())

FORMS = ("sentence", "short", "lower", "entry", "cell", "pipe", "markup", "gibberish", "tail", "shout")
(SENTENCE, SHORT, LOWER, ENTRY, CELL, PIPE, MARKUP, GIBBERISH, TAIL, SHOUT) = range(10)
#: Chance of each form in each state, where the fit starts: which forms are a kind's own, which are met in it, which are strange to it.
_OWN, _MET, _STRANGE = 1.0, 0.1, 0.008
_KINDS_OF = {
    "prose": ({SENTENCE, TAIL}, {SHORT, LOWER}),
    "list": ({ENTRY, SHORT}, {LOWER}),
    "table": ({CELL, PIPE}, {SHORT}),
    "junk": ({MARKUP, GIBBERISH, SHOUT}, {SHORT, LOWER, PIPE}),
}
#: Chance that a line has its neighbour's kind, with and without a blank line between, where the fit starts.
STAY, STAY_APART = 0.91, 0.55
#: Rounds of the fit, and how many lines the chances at its start count for.
ROUNDS, WEIGHT = 6, 400.0
#: The further statistics of a line with the bounds of their classes: characters, percent of digits and percent of signs. They count less than
#: its form, from which they are not independent.
_BOUNDS = ((4, 14, 28, 50, 90), (1, 12, 35), (4, 10, 20, 40))
TEMPER = 0.25


@dataclass(frozen=True)
class Model:
    """Logarithms of chances: of the first state, of the next state (without and with a blank line before), of each statistic's classes by state; and
    of letter pairs."""

    start: np.ndarray
    move: np.ndarray
    emit: tuple[np.ndarray, ...]
    pairs: dict[str, float]


_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_JAPANESE_WORD = regex.compile(r"\p{Han}+|\p{Hiragana}+|\p{Katakana}[\p{Katakana}ー]*|\p{Latin}+|\p{Cyrillic}+")
_ASIDE = regex.compile(r"={1,6}[^=].*=\s*|\[\[\s*(?:Category|Kategorie|Catégorie|Categoría|Категория|カテゴリ)\s*:.*\]\]\s*|\{\{\s*(?:[\w -]*-)?stub\s*[^{}]*\}\}", regex.I)
_REDIRECT = regex.compile(r"[\s﻿]*#\s*(?:redirect|weiterleitung|redirection|redirección|перенаправление|転送)\b?[\s:]*\[\[", regex.I)
_ENTRY = regex.compile(r"(?:[*•·‣▪◦–—-]|[#;:*]+)\s*\S|\(?\d{1,4}[.)]\s+\S|\(?[a-z][.)]\s+\S|</?(?:li|ul|ol|dl|dt|dd)\b")
_INLINE = regex.compile(r"[^.!?。|•·]+(?:\s[|•·]\s[^.!?。|•·]+){2,}")
_CELL = regex.compile(r"\{\||\|\}|\|-|!|\|[^|]*\|\||</?(?:table|tr|td|th|tbody|caption)\b|[^;]*;[^;]*;|[^\t]*\t[^\t]*\t|\S.*?\S?\s{3,}\S.*|\|.*\|$|[|+:=-]{4,}$")
_TWO_CELLS = regex.compile(r"[^;\t.!?。]{1,60}[;\t][^;\t.!?。]{0,30}")
_PARAMETER = regex.compile(r"\|\s*[\w\s]{1,40}=|\|\s*\{\{\{|\}\}+\s*$|\|\s*<!--")
_MARKUP = regex.compile(
    r"\{\{|__\p{L}+__|\[\[\s*(?:File|Image|Datei|Fichier|Archivo|Файл|ファイル)\s*:|&lt;|</?(?:div|span|br|strong|font|nowiki|p|b|i|error|includeonly|noinclude)\b|#\p{L}+:|<!--",
    regex.I,
)
_TAGS = regex.compile(r"<ref[^<>]*/>|<ref[^<>]*>.*?</ref>|\{\{(?:cn|citation needed|fact)[^{}]*\}\}|</?[a-z][^<>]*>|&nbsp;|[​﻿]", regex.I)
_LINK = regex.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]|'{2,}")
_END = regex.compile(r"[.!?。！？…][\"'”»）)\]]*\s*$")
_JAPANESE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_BEFORE = regex.compile(r"(?:^|\s)[,.;:](?=[\[\]']*[\p{L}\p{N}])")
_RUN = regex.compile(r"(\p{L})\1{4,}")
_AFTER = regex.compile(r"[\p{L}\p{N}][,.;:](?=\s|$)")
_BROKEN = regex.compile(r"[ÃÂÐÑ][\x80-™]|ï¿½|�|â€")
_ODD = regex.compile(r"[ÃÂÐÑ�ï]|â€")
_KANA = regex.compile(r"\p{Hiragana}")
_CYRILLIC = regex.compile(r"\p{Cyrillic}")
_VOWELS = frozenset("aeiouyäöüæœøåαεηιουωаеёиоуыэюяіїє")
_PILE = regex.compile(r"[b-df-hj-np-tv-xz]{5,}")
_CAPITAL_END = regex.compile(r"(?<![\p{L}])\p{Ll}+\p{Lu}(?![\p{L}])")
_CAPITAL = regex.compile(r"(?<![\p{L}])\p{Lu}\p{Ll}+(?![\p{L}])")
_SPACED = regex.compile(r"[^;|]+(?:;\s+[^;|]+){2,};?")
_OTHER_SCRIPT = regex.compile(r"(?:(?!\p{Latin})\p{L}){3}")
_CUT = regex.compile(r"[|;•·\t]|\s{3,}")
_ECHO = regex.compile(r"(\p{L}{1,3})\1{1,}\p{L}?|\p{L}*(\p{L})\2{3,}\p{L}*")
_COMMA_CELLS = regex.compile(r"[^,]*(?:,(?!\s)[^,]*){2,}")
_CODE_END = regex.compile(r"[;{}()\[\]:,=>\\]$")
_CODE_SIGNS = regex.compile(r"[=(){}\[\];_\"'<>\\/+*#@$&|:]")
_DATA = regex.compile(r"[{\[].*[}\]],?|[\w\"'.-]+\s*[:=]\s*\S.*[,;{\[]|\s*[}\])]+[,;]?")
_TAGGED = regex.compile(r"[<{&​﻿\xa0]")
_SEPARATOR = regex.compile(r"[|•·,、]")
_COMMAS = regex.compile(r"(?:\s*[^\s,.!?]+(?:\s+[^\s,.!?]+){0,3},){2,}\s*[^\s,.!?]+(?:\s+[^\s,.!?]+){0,3}")


def _words(line: str) -> list[str]:
    """Words; where words aren't written apart, stretches of one script."""
    return _WORD.findall(line) if line.isascii() or not _JAPANESE.search(line) else _JAPANESE_WORD.findall(line)


def _letters(line: str) -> Iterator[str]:
    """Pairs of neighbouring letters of each word, its ends included."""
    for w in _words(line.lower()):
        w = f" {w} "
        for i in range(len(w) - 1):
            yield w[i : i + 2]


#: Letter pairs are counted in about so many characters at a time; pairs of letters below the limit (Latin, Greek, Cyrillic) by their place in a table.
_PIECE, _LOW = 1 << 21, 0x530
_SPACE = regex.compile(r"\s")
_SCRIPTS = [regex.compile(x) for x in (r"\p{Han}", r"\p{Hiragana}", r"\p{Katakana}", r"\p{Latin}", r"\p{Cyrillic}")]
_LETTER, _MARK = regex.compile(r"\p{L}"), regex.compile(r"\p{M}")
_KATAKANA, _LONG = 3, 6


@cache
def _char_classes() -> np.ndarray:
    """By code point: 16 x (1 for a letter, 2 for a mark) + the number of its script, or ``_LONG``; 255 for those not met yet."""
    return np.full(0x110000, 255, np.uint8)


def _char_class(c: str) -> int:
    script = next((k for k, x in enumerate(_SCRIPTS, 1) if x.match(c)), _LONG if c == "ー" else 0)
    return 16 * (1 if _LETTER.match(c) else 2 if _MARK.match(c) else 0) + script


#: Places of other letters and of marks in ``_places``; no letters have these code points.
_HIGH, _MARKED = 1, 2


@cache
def _places() -> np.ndarray:
    """By code point: that of a letter below ``_LOW``, 32 for what is no letter, ``_HIGH``, ``_MARKED``; 65535 for those not met yet."""
    return np.full(0x110000, 65535, np.uint16)


def _points(text: str) -> np.ndarray:
    """The code points of a text in small letters, between spaces."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    places = _places()
    if (new := places[points] == 65535).any():
        for c in np.unique(points[new]).tolist():
            _char_classes()[c] = found = _char_class(chr(c))
            places[c] = _MARKED if found >= 32 else 32 if found < 16 else c if c < _LOW else _HIGH
    return points


def _pairs_in(points: np.ndarray, japanese: bool) -> np.ndarray:
    """The pairs of ``_letters`` as first code point << 21 | second; Japanese letters, in whose lines no pair is ever looked up, as 0, and no pairs after them."""
    found = _char_classes()[points]
    extra = np.zeros(0, np.int64)
    if japanese:
        script = found & 15
        long = script == _LONG
        if long.any():  # part of the word only after katakana
            before = np.maximum.accumulate(np.where(long, 0, np.arange(len(script))))
            script = np.where(long, np.where(script[before] == _KATAKANA, _KATAKANA, 0), script)
        letters = np.where(script > 0, np.where((script <= _KATAKANA) & ~long, 0, points), 32).astype(np.int64)
        first, second = letters[:-1], letters[1:].copy()
        turn = (script[:-1] != script[1:]) & (script[:-1] > 0) & (script[1:] > 0)  # a word ends and the next begins
        extra = (32 << 21) | second[turn]
        second[turn] = 32
    else:
        inside = found >= 16
        mark = found >= 32
        if (mark[1:] & ~inside[:-1]).any():  # a word doesn't begin with a mark
            at = np.arange(len(points))
            inside &= np.maximum.accumulate(np.where(inside & ~mark, at, -1)) > np.maximum.accumulate(np.where(inside, -1, at))
        letters = np.where(inside, points, 32).astype(np.int64)
        first, second = letters[:-1], letters[1:]
    kept = (first != 0) & ((first != 32) | (second != 32))
    return np.concatenate([(first[kept] << 21) | second[kept], extra])


def _pieces(texts: Iterable[str | None]) -> Iterator[tuple[str, bool]]:
    """All texts, joined or cut at white space to about the size of a piece, and whether they are of those with Japanese letters."""
    held: dict[bool, list[str]] = {False: [], True: []}
    size = {False: 0, True: 0}
    for text in filter(None, texts):
        kind = not text.isascii() and bool(_JAPANESE.search(text))
        at = 0
        while at < len(text):
            cut = _SPACE.search(text, at + _PIECE) if len(text) > at + _PIECE else None
            end = cut.start() if cut else len(text)
            held[kind].append(text[at:end])
            size[kind] += end - at
            at = end
            if size[kind] >= _PIECE:
                yield "\n".join(held[kind]), kind
                held[kind], size[kind] = [], 0
    for kind, parts in held.items():
        if parts:
            yield "\n".join(parts), kind


class _PairCounts:
    """How often each pair is met, see ``_pairs_in``."""

    def __init__(self) -> None:
        self.low = np.zeros(_LOW * _LOW, np.int64)
        self.high: dict[int, int] = {}

    def add(self, texts: Iterable[str | None]) -> None:
        for text, japanese in _pieces(texts):
            points = _points(text)
            places = _places()[points]
            marks = np.flatnonzero(places == _MARKED)
            if not japanese and len(marks) * 50 <= len(places):
                for i in marks.tolist():  # a part of the word only after its letters
                    places[i] = 32 if places[i - 1] == 32 else points[i] if points[i] < _LOW else _HIGH
                marks = marks[:0]
            if japanese or len(marks):
                pairs = _pairs_in(points, japanese)
                first, second = pairs >> 21, pairs & 0x1FFFFF
                low = (first < _LOW) & (second < _LOW)
                self.low += np.bincount(first[low] * _LOW + second[low], minlength=len(self.low))
                pairs = pairs[~low]
            else:  # the same for texts whose words are runs of letters
                both = places[:-1].astype(np.int64)
                both *= _LOW
                both += places[1:]
                counts = np.bincount(both, minlength=len(self.low)).reshape(_LOW, _LOW)
                counts[32, 32], counts[_HIGH], counts[:, _HIGH] = 0, 0, 0
                self.low += counts.ravel()
                high = places == _HIGH
                at = np.flatnonzero(high[:-1] | high[1:])
                letter = lambda i: np.where(high[i], points[i], places[i]).astype(np.int64)
                pairs = (letter(at) << 21) | letter(at + 1)
            for p, n in zip(*(x.tolist() for x in np.unique(pairs, return_counts=True))):
                self.high[p] = self.high.get(p, 0) + n

    def items(self) -> tuple[list[int], list[int]]:
        at = np.flatnonzero(self.low)
        return [*((at // _LOW << 21) | at % _LOW).tolist(), *self.high], [*self.low[at].tolist(), *self.high.values()]


def _pair_chances(counts: dict[int, int]) -> dict[str, float]:
    """Logarithms of the chances of the second letter after the first."""
    heads: dict[int, int] = {}
    for p, c in counts.items():
        heads[p >> 21] = heads.get(p >> 21, 0) + c
    return {chr(p >> 21) + chr(p & 0x1FFFFF): float(np.log((c + 0.5) / (heads[p >> 21] + 30))) for p, c in counts.items()}


def _likeness(line: str, pairs: dict[str, float]) -> float:
    """Mean logarithm of the chances of a line's letter pairs; 0 without a fitted corpus."""
    if not pairs:
        return 0.0
    n, total = 0, 0.0
    for p in _letters(line):
        n, total = n + 1, total + pairs.get(p, -7.0)
    return total / n if n else 0.0


#: A line below is unlike the corpus, by the mean logarithm of its letter pairs' chances.
UNLIKE = -3.7


def _readable(text: str, words: list[str], pairs: dict[str, float]) -> bool:
    """Does a line of words read like a language, going by its marks and its letters?"""
    if _ODD.search(text) and len(_BROKEN.findall(text)) * 6 > len(text):
        return False
    n = len(words)
    if _JAPANESE.search(text):
        return not text.startswith(("。", "、")) and len(_KANA.findall(text)) * 12 >= len(_JAPANESE.findall(text))
    if not n or max(map(len, words)) > 40 or max(map(len, text.split())) > 45 or sum(map(len, words)) > 14 * n or _RUN.search(text):
        return False
    if len(_BEFORE.findall(text)) > len(_AFTER.findall(text)):
        return False
    low = [w.lower() for w in words]
    if n >= 8 and len(set(low)) * 4 < n and len(set(low)) < 12:
        return False
    if len(_CAPITAL_END.findall(text)) > len(_CAPITAL.findall(text)):
        return False
    if n < 4:
        return True
    plain = normalize("NFD", " ".join(low))
    long = [w for w in plain.split(" ") if len(w) > 1]
    bare = sum(map(_VOWELS.isdisjoint, long))
    if bare * 2 > len(long) and not _OTHER_SCRIPT.search(text):
        return False
    if n < 6:
        return True
    odd = (bare * 16 >= len(long)) + (len(_PILE.findall(plain)) * 12 >= n) + (sum(map(plain.count, _VOWELS)) * 10 < 3 * sum(map(len, low)))
    return not (odd and not _OTHER_SCRIPT.search(text) and _likeness(text, pairs) < UNLIKE or odd >= 2 and not pairs)


def _plain(line: str) -> str:
    plain = line
    if _TAGGED.search(plain):
        plain = _TAGS.sub(" ", plain)
    if "[[" in plain or "''" in plain:
        plain = _LINK.sub(r"\1", plain)
    return plain.strip()


_ASCII = regex.compile(r"[\x00-\x7f]+")
_ASCII_DIGITS = bytes(c for c in range(128) if chr(c).isdigit())
_ASCII_PLAIN = bytes(c for c in range(128) if chr(c).isalnum() or chr(c).isspace())


def _plain_and_digits(line: str) -> tuple[int, int]:
    """How many characters are letters, digits or white space, and how many are digits; those of ASCII by bytes."""
    own = line.encode("ascii", "ignore")
    rest = "" if len(own) == len(line) else _ASCII.sub("", line)
    plain = len(own) - len(own.translate(None, _ASCII_PLAIN)) + sum(map(str.isalnum, rest)) + sum(map(str.isspace, rest))
    return plain, len(own) - len(own.translate(None, _ASCII_DIGITS)) + sum(map(str.isdigit, rest))


def line_stats(line: str, pairs: dict[str, float]) -> tuple[int, ...]:
    """Form, characters, words, letters in words, signs, ends like a sentence, common words, digits; of a stripped line."""
    chars = len(line)
    if "&" in line:
        line = unescape(line)
    words = _words(line)
    common = sum(w in COMMON for w in map(str.lower, words))
    plain, digits = _plain_and_digits(line)
    return (_form(line, words, pairs), chars, len(words), sum(map(len, words)), max(chars - plain, 0), int(bool(_END.search(line[-12:]))), common, digits)


def _form(line: str, words: list[str], pairs: dict[str, float]) -> int:
    plain = _plain(line)
    if not plain and line.startswith("<ref"):
        return TAIL
    if _PARAMETER.match(line):
        return MARKUP
    ends = bool(_END.search(plain[-12:]))
    if _MARKUP.match(line) and not (ends and len(plain) > 60 and not plain.startswith("{{")):
        return MARKUP
    if plain != line:
        words = _words(plain)
    n = len(words)
    japanese = bool(_JAPANESE.search(plain))
    cuts = len(_CUT.findall(plain))
    running = n >= 6 and n >= 4 * (cuts + 1) or japanese and len(plain) > 24 and "。" in plain
    if not running and not ends and _SPACED.fullmatch(plain):
        return ENTRY
    if not (running and line[0] not in "|!") and _CELL.match(line):
        return CELL
    if line[0] == "|":
        return PIPE
    if _ENTRY.match(line) and not (running and n >= 8 and line[0] not in "*#;:•-"):
        return ENTRY
    if not japanese and not running and _COMMA_CELLS.fullmatch(plain) and not _DATA.fullmatch(plain):
        return CELL
    if _SEPARATOR.search(plain) and not ends and (_INLINE.fullmatch(plain) or _COMMAS.fullmatch(plain) and not any(w.lower() in COMMON for w in words)):
        return ENTRY
    if _INLINE.fullmatch(plain) and _SEPARATOR.search(plain):
        return ENTRY
    low = [w.lower() for w in words]
    if not n:
        return (TAIL if ends or "</ref>" in line else SHORT) if any(map(str.isdigit, plain)) else SHOUT
    if not japanese and (n <= 8 and (n > 1 and len(set(low)) == 1 or all(_ECHO.fullmatch(w) for w in low)) or plain.endswith("!!")):
        return SHOUT
    signs = len(_CODE_SIGNS.findall(plain))
    if not japanese and signs * 9 >= len(plain) and (_CODE_END.search(plain) or _DATA.fullmatch(plain) or "=" in plain or "()" in plain):
        return MARKUP
    readable = _readable(plain, words, pairs)
    if japanese:
        if not readable and len(plain) > 14:
            return GIBBERISH
        return SENTENCE if ends and len(plain) > 8 or len(plain) > 24 else TAIL if ends else SHORT
    if n >= 6 or len(plain) > 45:
        return SENTENCE if readable else GIBBERISH
    if not readable:
        return GIBBERISH
    if _TWO_CELLS.fullmatch(line) and not ends:
        return CELL
    return TAIL if ends else LOWER if plain[0].islower() else SHORT


def _classes(stats: np.ndarray) -> np.ndarray:
    """Form, and classes of length, digits and signs, by line."""
    chars = np.maximum(stats[:, 1], 1)
    return np.stack([stats[:, 0], *(np.searchsorted(b, x, side="right") for b, x in zip(_BOUNDS, (stats[:, 1], 100 * stats[:, 7] // chars, 100 * stats[:, 4] // chars)))], axis=1)


_SIZES = (len(FORMS), *(len(b) + 1 for b in _BOUNDS), 2)


def _packed(classes: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The classes of a line, and whether a blank line stands before, in one number."""
    return np.ravel_multi_index((*classes.T, apart), _SIZES).astype(np.uint16)


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    *classes, apart = np.unravel_index(packed, _SIZES)
    return np.stack(classes, axis=1), apart


def at_start() -> Model:
    """The chances where the fit starts; statistics other than the form say nothing yet."""
    form = np.array([[_OWN if f in own else _MET if f in met else _STRANGE for f in range(len(FORMS))] for own, met in _KINDS_OF.values()])
    k = len(STATES)
    move = np.stack([np.where(np.eye(k, dtype=bool), s, (1 - s) / (k - 1)) for s in (STAY, STAY_APART)])
    emit = (form / form.sum(axis=1, keepdims=True), *(np.full((k, len(b) + 1), 1 / (len(b) + 1)) for b in _BOUNDS))
    return Model(np.log(np.full(k, 1 / k)), np.log(move), tuple(map(np.log, emit)), {})


def _scores(model: Model, classes: np.ndarray) -> np.ndarray:
    return sum((TEMPER if c else 1.0) * model.emit[c].T[classes[:, c]] for c in range(classes.shape[1]))


def _expect(model: Model, classes: np.ndarray, apart: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected states by line, moves by state, state and blank line before, and first states, over all documents."""
    return _states(model, np.exp(_scores(model, classes)), apart, lengths)


def _states(model: Model, chance: np.ndarray, apart: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_expect``, from the chances of the lines' statistics by state."""
    k = len(STATES)
    move = np.exp(model.move)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    starts, long = first[order], lengths[order]
    ahead, back = np.zeros((len(chance), k)), np.ones((len(chance), k))
    now = np.exp(model.start) * chance[starts]
    ahead[starts] = now / now.sum(axis=1, keepdims=True)
    moves = np.zeros((2, k, k))
    many = [int(np.searchsorted(-long, -at, side="left")) for at in range(int(long[0]) if len(long) else 0)]
    for at in range(1, len(many)):
        rows = starts[: many[at]] + at
        now = np.einsum("ij,ijk->ik", ahead[rows - 1], move[apart[rows]]) * chance[rows]
        ahead[rows] = now / now.sum(axis=1, keepdims=True)
    for at in range(len(many) - 1, 0, -1):
        rows = starts[: many[at]] + at
        later = chance[rows] * back[rows]
        both = ahead[rows - 1][:, :, None] * move[apart[rows]] * later[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        for gap in (0, 1):
            moves[gap] += both[apart[rows] == gap].sum(axis=0)
        now = np.einsum("ijk,ik->ij", move[apart[rows]], later)
        back[rows - 1] = now / now.sum(axis=1, keepdims=True)
    states = ahead * back
    states /= states.sum(axis=1, keepdims=True)
    return states, moves, states[starts].sum(axis=0)


def _sums(model: Model, packed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What a round needs of some documents, whose lines have the numbers ``packed``, one after another in an array; those of more documents add up."""
    classes, apart = _unpacked(np.arange(np.prod(_SIZES)))
    states, moves, first = _states(model, np.exp(_scores(model, classes))[packed], apart[packed], lengths)
    counts = [np.bincount(packed, states[:, s], len(classes)) for s in range(len(STATES))]
    seen = [np.bincount(classes[:, c], counts[s], e.shape[1]) for c, e in enumerate(model.emit) for s in range(len(STATES))]
    return np.concatenate([first, moves.ravel(), *seen])


def _maximised(begin: Model, sums: np.ndarray) -> Model:
    """The model of the sums of all documents."""
    k, at = len(STATES), 0

    def next_of(*shape: int) -> np.ndarray:
        nonlocal at
        at += int(np.prod(shape))
        return sums[at - int(np.prod(shape)) : at].reshape(shape)

    first = next_of(k) + WEIGHT * np.exp(begin.start)
    moves = next_of(2, k, k) + WEIGHT * np.exp(begin.move)
    emit = []
    for c, before in enumerate(begin.emit):
        seen = next_of(*before.shape) + (WEIGHT * np.exp(before) if c == 0 else 1.0)
        emit.append(np.log(seen / seen.sum(axis=1, keepdims=True)))
    return Model(np.log(first / first.sum()), np.log(moves / moves.sum(axis=2, keepdims=True)), tuple(emit), begin.pairs)


def fit(texts: Iterable[str | None], rounds: int = ROUNDS) -> Model:
    """A model of some texts, here and now; see ``text_statistics`` for that of a table."""
    texts = [t for t in texts if t]
    counts = _PairCounts()
    counts.add(texts)
    begin = at_start()
    model = begin = Model(begin.start, begin.move, begin.emit, _pair_chances(dict(zip(*counts.items()))))
    stats, apart, _, lengths, _, _ = _lines(texts, begin.pairs)
    if not len(stats):
        return model
    packed = _packed(_classes(stats), apart)
    for _ in range(rounds):
        model = _maximised(begin, _sums(model, packed, lengths))
    return model


def viterbi(model: Model, classes: np.ndarray, apart: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best state of each line. ``classes``, ``apart`` (a blank line before): lines of all documents, one after another; ``lengths``: lines by document."""
    n, k = len(classes), len(STATES)
    if not n:
        return np.zeros(0, np.int8)
    emit, move = _scores(model, classes), model.move
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    starts, long = first[order], lengths[order]
    back = np.zeros((n, k), np.int8)
    score = model.start + emit[starts]
    final = score.copy()
    for at in range(1, int(long[0])):
        m = int(np.searchsorted(-long, -at, side="left"))  # documents longer than at
        rows = starts[:m] + at
        through = score[:m, :, None] + move[apart[rows]]
        back[rows] = through.argmax(axis=1)
        score = through.max(axis=1) + emit[rows]
        final[:m] = score
    out = np.zeros(n, np.int8)
    state = final.argmax(axis=1)
    for at in range(int(long[0]) - 1, -1, -1):
        m = int(np.searchsorted(-long, -at, side="left"))
        rows = starts[:m] + at
        out[rows] = state[:m]
        state[:m] = back[rows, state[:m]]
    return out


MOST_CACHED = 300_000


class _Cache(dict):
    """Statistics of lines that were seen, as lines repeat; emptied when full."""

    def __init__(self, pairs: dict[str, float]) -> None:
        super().__init__()
        self.pairs = pairs

    def of(self, line: str) -> tuple[int, ...]:
        found = self.get(line)
        if found is None:
            found = line_stats(line, self.pairs)
            if len(self) >= MOST_CACHED:
                self.clear()
            if len(line) < 3000:
                self[line] = found
        return found


def _lines(texts: list[str | None], pairs: dict[str, float], cache: _Cache | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines that have a kind: statistics, whether a blank line or an aside stands before, and document; lines by document; and statistics and documents of
    the asides."""
    cache = _Cache(pairs) if cache is None else cache
    stats, apart, owner, asides, aside_owner = [], [], [], [], []
    for i, text in enumerate(texts):
        gap, last = False, None
        for line in (text or "").splitlines():
            line = line.strip(" \t\r\n　\xa0﻿​")
            if not line:
                gap = True
                continue
            found = cache.of(line)
            if line[0] in "=[{" and _ASIDE.fullmatch(line):
                asides.append(found)
                aside_owner.append(i)
                gap = True
                continue
            if line == last and found[0] in (SHORT, LOWER, TAIL):  # the same again
                found = (SHOUT, *found[1:])
            stats.append(found)
            apart.append(gap)
            owner.append(i)
            gap, last = False, line
    of = np.array(owner, np.int64)
    table = lambda x: np.array(x, np.int64).reshape(-1, 8)
    return table(stats), np.array(apart, np.int64), of, np.bincount(of, minlength=len(texts)), table(asides), np.array(aside_owner, np.int64)


_COLUMNS = [("n_words", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64()), ("punctuated_line_share", pa.float64()), ("common_word_share", pa.float64()), *((f"{s}_share", pa.float64()) for s in STATES), ("doc_kind", pa.string())]
SCHEMA = "doc_id bigint, n_words bigint, mean_word_length double, symbol_ratio double, punctuated_line_share double, common_word_share double, prose_share double, list_share double, table_share double, junk_share double, doc_kind string"


#: What a text has whatever the model's chances: its statistics, whether it is a redirect, and of each of its lines that have a kind the classes in one
#: number (see ``_packed``) and the characters.
_FIXED = 5
_SEEN = [*_COLUMNS[:_FIXED], ("redirect", pa.bool_()), ("classes", pa.binary()), ("chars", pa.binary())]
_SEEN_SCHEMA = "doc_id bigint, n_words bigint, mean_word_length double, symbol_ratio double, punctuated_line_share double, common_word_share double, redirect boolean, classes binary, chars binary"
#: Lines that a round takes at a time, or those of one document.
MOST_LINES = 300_000


def _fixed(texts: list[str | None], pairs: dict[str, float], cache: _Cache | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The columns that the model's chances don't change, and the classes, blank lines before and characters of all lines that have a kind."""
    n = len(texts)
    redirect = np.array([bool(_REDIRECT.match(t or "")) for t in texts], bool)
    table, apart, owner, lengths, asides, aside_owner = _lines(texts, pairs, cache)
    every, all_owner = np.concatenate([table, asides]), np.concatenate([owner, aside_owner])
    total = lambda c: np.bincount(all_owner, every[:, c], minlength=n)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    words = total(2)
    columns = {
        "n_words": words.astype(np.int64),
        "mean_word_length": share(total(3), words),
        "symbol_ratio": share(total(4), total(1)),
        "punctuated_line_share": share(total(5), np.bincount(all_owner, minlength=n)),
        "common_word_share": share(total(6), words),
        "redirect": redirect,
        "lengths": lengths,
    }
    return columns, _classes(table), apart, table[:, 1]


def _kinds(model: Model, classes: np.ndarray, apart: np.ndarray, chars: np.ndarray, lengths: np.ndarray, redirect: np.ndarray) -> dict[str, np.ndarray | list]:
    """The columns of the kinds."""
    n = len(lengths)
    owner, labels = np.repeat(np.arange(n), lengths), viterbi(model, classes, apart, lengths)
    whole = np.bincount(owner, chars, minlength=n)
    by_state = np.stack([np.bincount(owner[labels == s], chars[labels == s], minlength=n) for s in range(len(STATES))])
    most = by_state[1:].argmax(axis=0) + 1 if n else []
    case = (whole > 0) & (by_state[0] * 2 < whole) & ~redirect
    share = lambda a: np.divide(a, whole, out=np.zeros(n), where=whole > 0)
    return {**{f"{s}_share": np.where(redirect, 0.0, share(by_state[k])) for k, s in enumerate(STATES)}, "doc_kind": [STATES[k] if c else None for k, c in zip(most, case)]}


def describe(texts: list[str | None], model: Model, cache: _Cache | None = None) -> dict[str, np.ndarray | list]:
    """The statistics of many texts, by column."""
    columns, classes, apart, chars = _fixed(texts, model.pairs, cache)
    lengths, redirect = columns.pop("lengths"), columns.pop("redirect")
    return columns | _kinds(model, classes, apart, chars, lengths, redirect)


def _slices(batches: Iterable[pa.RecordBatch], most: int, column: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs of at most so many bytes of a column, or one row."""
    for whole in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < whole.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
            yield whole.slice(at, end - at)
            at = end


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)


def pair_counts(documents: DataFrame) -> dict[int, int]:
    """The letter pairs of all texts. As Japanese letters are left out, there are at most as many as alphabets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _PairCounts()
        for batch in _slices(batches, 16_000_000, 1):
            counts.add(batch.column(1).to_pylist())
        pairs, n = counts.items()
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    return {r.pair: r.n for r in documents.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").collect()}


def seen(documents: DataFrame, pairs: dict[str, float]) -> DataFrame:
    """A row per document with what the rounds and the labels need, see ``_SEEN``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(pairs)
        for batch in _slices(batches, 16_000_000, 1):
            columns, classes, apart, chars = _fixed(batch.column(1).to_pylist(), pairs, cache)
            ends = np.cumsum(columns.pop("lengths"))[:-1]
            columns["classes"] = [x.tobytes() for x in np.split(_packed(classes, apart), ends)]
            columns["chars"] = [x.tobytes() for x in np.split(chars.astype(np.int32), ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[c], t) for c, t in _SEEN)], ["doc_id", *(c for c, _ in _SEEN)])

    return documents.mapInArrow(run, _SEEN_SCHEMA)


def fitted(lines: DataFrame, pairs: dict[str, float], rounds: int = ROUNDS) -> Model:
    """A model of all documents of ``seen``. A round brings one row of sums a task to the driver, where they are added in the order of the tasks."""
    begin = at_start()
    model = begin = Model(begin.start, begin.move, begin.emit, pairs)
    for _ in range(rounds):
        chances = Model(model.start, model.move, model.emit, {})

        def run(batches: Iterator[pa.RecordBatch], chances: Model = chances) -> Iterator[pa.RecordBatch]:
            sums = 0.0
            for batch in _slices(batches, 2 * MOST_LINES, 0):
                lengths = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) // 2
                if lengths.any():
                    sums = sums + _sums(chances, _flat(batch.column(0), np.uint16), lengths)
            if np.ndim(sums):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tolist()], pa.list_(pa.float64()))], ["part", "sums"])

        found = lines.select("classes").mapInArrow(run, "part int, sums array<double>").collect()
        if not found:
            break
        model = _maximised(begin, np.sum([r.sums for r in sorted(found, key=lambda r: r.part)], axis=0))
    return model


def _labelled(lines: DataFrame, model: Model) -> DataFrame:
    """``SCHEMA`` from the rows of ``seen``."""
    chances = Model(model.start, model.move, model.emit, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2 * MOST_LINES, _FIXED + 2):
            *fixed, redirect, classes, chars = batch.columns
            lengths = pc.binary_length(classes).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            found = _kinds(chances, *_unpacked(_flat(classes, np.uint16)), _flat(chars, np.int32), lengths, redirect.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(found[c], t) for c, t in _COLUMNS[_FIXED:])], ["doc_id", *(c for c, _ in _COLUMNS)])

    return lines.mapInArrow(run, SCHEMA)


def text_statistics(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: Model | None = None) -> DataFrame:
    """A row per document, see ``SCHEMA``. The model is fitted to all documents, now, or given. Nothing is shuffled but counts of letter pairs; a task holds
    about 16 MB of text at a time, or one document."""
    documents = documents.select(documents[id_column].cast("bigint").alias("doc_id"), documents[text_column].alias("text"))
    if model is not None:
        return _labelled(seen(documents, model.pairs), model)
    pairs = _pair_chances(pair_counts(documents))
    lines = settled(seen(documents, pairs))
    return _labelled(lines, fitted(lines, pairs))
