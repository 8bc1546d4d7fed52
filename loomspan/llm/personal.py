"""Personal information in free text: weak supervision and a span classifier.

1. Candidates: patterns of generous shape propose spans of five kinds. A person is proposed by a
   family name (listed, or with an ending that listed ones share), by a listed given name in front of
   a capitalised word, or by a title or phrase that introduces names; a bare number as an id by a
   label in front of it. A name has at most ``MOST_GIVEN`` given names and initials; nothing else
   limits how far a span may reach.
2. Labelers: shape, gazetteer and context labelers vote on every candidate (+1, -1, or 0 for no
   opinion).
3. Aggregation: the votes of all candidates of the whole corpus are counted by kind and vote vector.
   There are at most 3^labelers vectors a kind, so the counts are small whatever the corpus; on them
   expectation-maximisation estimates each labeler's reliability and the probability of each vector.
4. Span classifier: a logistic regression per kind learns those probabilities from the votes, the
   neighbouring words and the shape of the span. It is fitted on a bounded sample of candidates
   (about ``sample`` per kind, taken by hash); steps 1 to 3 and the classification cover all texts.
5. Spans with probability 0.5 or more are kept, the longer one where two overlap.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import Stored

KINDS = ("email", "phone", "id_number", "address", "person")
#: Candidates per kind on which the span classifier is fitted: about so many, chosen by hash.
SAMPLE = 5_000
THRESHOLD = 0.5
#: Given names and initials of one person.
MOST_GIVEN = 3
#: Words of a name that a title or phrase introduces, particles included.
MOST_WORDS = 6

# --- fixed values: word lists of the labelers
STREET_LAST = "street st road rd avenue ave lane ln court ct close row drive dr boulevard blvd way terrace crescent hill gardens grove mews parade square highway circle cir trail parkway pkwy alley crossing walk gracht straat laan kade plein"
STREET_FIRST = "rue avenue chemin boulevard impasse allée place quai route via piazza viale corso largo rua praça"
STREET_NUMBER_LAST = "calle avenida plaza paseo camino carrera ronda ulica ul. via piazza am im zum zur alte neue obere untere große kleine"
STREET_ENDING = "straße strasse str. weg platz gasse allee gracht graben ufer ring damm laan straat gatan vägen vej gate steig hof"
PARTICLES = "van von der den de del della di da du af av zu zum ter ten la le el bin ibn al"
TITLES = "dr dr. prof prof. mr mr. mrs mrs. ms ms. herr frau mme m. sr. sra. don doña ing. dipl."
STOP = (
    "the a an of to by and or for with from on in at as is was were are be we i you he she it they our my your his her their this that these those not no if when while after before under near over across "
    "asked thanks thank according regards kind dear hello hi signed collected checked re-checked contact operator curator collector sammler collecteur colector please send call ring phone whether values carry note that dr prof "
    "der die das den dem des ein eine und oder von mit bei für im am zum zur el la los las un una y de en con por le les une et du au aux chez pour par"
)
INTRODUCES = (
    "dear", "hello", "hi", "thanks to", "thank you", "regards", "sincerely", "signed", "according to", "author", "reviewer", "contact", "operator", "curator", "collector", "sammler", "collecteur", "colector",
    "written by", "signed by", "reviewed by", "collected by", "checked by", "reported by", "approved by", "on behalf of", "dr", "prof", "professor", "mr", "mrs", "ms", "herr", "frau", "mme", "sr", "sra", "doña",
)
ID_LABELS = "ssn|social security(?: number| no)?|passport(?: number| no)?|identity(?: card)?(?: number| no)?|national id(?: number| no)?|national insurance(?: number| no)?|insurance number|tax id|personal id|personnummer|dni|nie|nino|cpf|aadhaar|ausweis(?:nummer|-nr)?"
CUES = {
    "email": r"(?:mail(?:to)?|contact|kontakt|send|user|cc|bcc|to|from|write|reach|questions|reply|owner|address)\W*(?:to\W*)?$",
    "phone": r"(?:tel|phone|telefon|téléphone|teléfono|call|ring|mobile|mobil|fax|voice|handy|reached|dial|whatsapp|cell|☎)\W*(?:at|on|under|no|number)?\W*$",
    "id_number": r"(?:passport|security|insurance|identity|identité|national_id|dni|nie|ssn|nino|cpf|aadhaar|ausweis|card|\bid\b|pass|personnummer|number)\b[^\d]*$",
    "address": r"(?:address|adresse|anschrift|dirección|addr|lives|living|resides|wohnt|habite|vive|home|parcel|deliver\w*|ship\w*|indirizzo)\b[^\d]{0,30}$",
    "person": r"(?:\bdr|\bprof|\bmr|\bmrs|\bms|operator|curator|collect\w*|sammler|colector|regards|asked|thanks to|according to|\bby|dear|author|reviewer|contact|name|nom|signed)\b\W*(?:/\W*\w+\W*)*$",
}
COUNTER_CUES = {
    "email": r"(?:such as|and|ticket|version|release|earlier|run)\W*$",
    "phone": r"(?:lot|job|ticket|doi|gene|accession|chunk|file|run|md5|start|end|interval|n50|primer|version|release|rss|node)\W*[\w.,#:/=-]{0,6}$",
    "id_number": r"(?:lot|job|ticket|doi|gene|accession|chunk|file|run|md5|start|end|interval|primer|version|release|node|tel\W*|phone|call|ring)\W*[\w.,#:/=-]{0,6}$",
    "address": r"(?:plot|field|centromere|exon|chunk|version|release|at least|over|(?:sampled|grown|planted|found) (?:at|in|near))\W*$",
    "person": r"(?:cultivar|index|the|accession|species|gene|family)\W*$",
}
AFTER_CUES = {
    "email": r"\W*(?:asked|wrote|said|sent|before|or|if|for)\b",
    "phone": r"\W*(?:ext|extension|durchwahl|x\d|\((?:home|office|work|mobile|cell)|or|when|if|$)",
    "id_number": r"\W*(?:issued|expires|valid|was|belongs|on file|$)",
    "address": r"\W*(?:\w+ floor|floor|flat|apartment|apt|suite|unit|\d{4,5}\b|\d\. og|$)",
    "person": r"\W*(?:signed|wrote|said|asked|reported|checked|for the|whether|on \d|group|department|\d{1,2}\.\d|\d{4}-|\((?:[a-z]{2}-\d)|$)",
}
AFTER_COUNTER = {
    "email": r"[@\d]",
    "phone": r"\s*(?:bp|kb|mb|gb|%|records|reads|\.\.)",
    "id_number": r"\s*(?:bp|kb|mb|gb|%|records|reads|\.\.|lines)",
    "address": r"\s*(?:bp|kb|mb|%|plants|seedlings|samples|rows|reads)",
    "person": r"\s*(?:index|correction|family|cultivar|test|method|score|transform|algorithm|distance)",
}

_L = r"[^\W\d_]"
_W = rf"{_L}[\w’'-]*+"
_SP = r"[ \t\u00a0\u2009\u202f]{1,3}"


def _any(words: str) -> str:
    return "|".join(re.escape(w) for w in sorted(words.split(), key=len, reverse=True))


_LABEL = r"[\w-]+"
_AFTER_AT = re.compile(rf"{_LABEL}(?:\.{_LABEL})*")
_AT_WORD = re.compile(r"(?i)(?<=[\w])(?: ?[\[({] ?at ?[\])}] ?| at )(?=\w)")
_BRACKET_AT = re.compile(r"[\[({] ?at")
_DOT_DOMAIN = re.compile(rf"(?i){_LABEL}(?:(?:\.| ?[\[({{] ?dot ?[\])}}] ?| dot ){_LABEL})*")
_DOT = re.compile(r"(?i)\.|dot")
_SPELT_DOT = re.compile(r"(?i) dot |[\[({] ?dot ?[\])}]")
_DOT_LEFT = re.compile(r"(?i)(?: dot | ?[\[({] ?dot ?[\])}] ?)$")
_PHONE = re.compile(
    r"""(?<![\w+./,@#-])(?:
      \+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?)(?:[ .-]?\d{2,5}){1,5}
    | 00\d{2}(?:[ -]\d{2,6}){1,5}
    | \(\d{2,5}\)[ ]?\d{3,6}(?:[ -]?\d{3,4})?
    | 0\d{1,5}[/ ]\d{3,8}(?:[ -]\d{2,6}){0,4}
    | 0\d{1,4}-\d{3,8}-\d{2,6}
    | 0\d(?:[ .-]\d\d){4}
    | (?:1[-. ])?\d{3}([-. ])\d{3}\1\d{4}
    | \d{2}-\d{2,4}-\d{3,7}
    )(?!\w|[-./,]?\d)""",
    re.X,
)
_ID = re.compile(
    r"""(?<![\w./,@#+-])(?:
      \d{3}([- ])\d{2}\1\d{4}
    | \d{6}[-+]\d{4}
    | \d{8}-?[A-Za-z]
    | [A-Za-z]{2}[ ]?(?:\d{2}[ ]?){3}[A-Za-z]
    | [A-Za-z]{1,3}\d{6,9}
    | [A-Za-z]\d{2}[A-Za-z]\d{5}
    | [XYZxyz]-(?:\d{4}-){2}\d{2}
    | [XYZxyz]-?\d{7}-?[A-Za-z]
    | \d{4}[ ]\d{4}[ ]\d{4}
    | \d{3}\.\d{3}\.\d{3}-\d{2}
    )(?!\w|[-./,]\d|[ ]\d{4}\b)""",
    re.X,
)
#: A digit run that an id may hold; searched first, as a pattern that starts with a digit is found fast.
_ID_DIGITS = re.compile(
    r"""\d(?<!\d\d)(?:
      (?<=[A-Za-z]\d)\d{5,8}
    | (?<=[A-Za-z]\d)\d[A-Za-z]\d{5}
    | (?<=[A-Za-z][ ]\d|[A-Za-z]{2}\d)\d(?:[ ]?\d{2}){2}[ ]?[A-Za-z]
    | (?:(?<=[XYZxyz]-\d)|(?<=[XYZxyz]\d))\d{6}-?[A-Za-z]
    | (?<=[XYZxyz]-\d)\d{3}-\d{4}-\d{2}
    | \d{2}([- ])\d{2}\1\d{4}
    | \d{5}[-+]\d{4}
    | \d{7}-?[A-Za-z]
    | \d{3}[ ]\d{4}[ ]\d{4}
    | \d{2}\.\d{3}\.\d{3}-\d{2}
    )(?!\w)""",
    re.X,
)
#: A number without shape is an id only if a label stands in front of it.
_ID_LABELLED = re.compile(rf"(?i)(?<!\w)(?:{ID_LABELS})(?:\W{{0,3}}(?:number|no|nr|is|was))?[\W_]{{1,4}}([A-Z]{{0,3}}\d(?:[ .-]?\d){{5,13}}[A-Z]?)(?!\w|[-./,]\d)")
_CAP = r"[A-ZÀ-ÖØ-ÞĀ-Ž][\w’'-]*+"
_ADDRESS = re.compile(
    rf"""(?<![\w./,:=#+-])\d{{1,5}}(?:[A-Za-z](?!\w)|-[A-Za-z](?!\w)|\ (?:bis|ter)(?!\w))?,?{_SP}(?:
      (?:{_CAP}\.?{_SP}){{1,3}}(?i:{_any(STREET_LAST)})(?!\w)
    | {_CAP}(?i:(?<=gracht)|(?<=straat)|(?<=laan)|(?<=kade))
    | (?i:(?:{_any(STREET_FIRST)}){_SP}(?:(?:de|des|du|la|le|les|della|delle|dello|dei|di|del|da|dos){_SP}|[dl]['’]){{0,2}}){_W}(?:{_SP}{_CAP}){{0,2}}
    )""",
    re.X,
)
_ENDS = "|".join(f"(?<={_L}{_L}{e})" for e in STREET_ENDING.replace("str.", "str").split())
_ADDRESS_LAST = re.compile(
    rf"""(?<![\w-])(?<!\d[ ])(?<!\d[a-zA-Z][ ])(?:
      (?:{_any(STREET_NUMBER_LAST)}){_SP}(?:{_W}{_SP}){{0,3}}?{_W}
    | {_L}++(?:{_ENDS})\.?
    ),?{_SP}\d{{1,4}}(?:\ ?[a-z](?![\w’'])|-[A-Za-z](?!\w))?(?![\w,.]?\d|\w)""",
    re.X | re.I,
)
_NO_STREET = frozenset("at of in and on was from bp to with by or is for".split())
#: What opens one of the costlier patterns, all found in one pass over the lower-case text: words (with
#: the character behind them) and endings of streets that stand in front of a number, labels of ids, and
#: what introduces a name. The value is the pattern it opens and its length.
_STREET_WORD, _STREET_END, _LABEL_OF_ID, _INTRODUCTION = range(4)
_OPENERS = ahocorasick.Automaton()
_BLANKS = " \t\u00a0\u2009\u202f"
for _word in STREET_NUMBER_LAST.split():
    for _space in _BLANKS:
        _OPENERS.add_word(f"{_word}{_space}", (_STREET_WORD, len(_word) + 1))
for _word in STREET_ENDING.split():
    _OPENERS.add_word(_word, (_STREET_END, len(_word)))
for _word in re.sub(r"\(\?:[^)]*\)\??", "", ID_LABELS).split("|"):
    _OPENERS.add_word(_word, (_LABEL_OF_ID, len(_word)))
for _word in INTRODUCES:
    for _space in (*_BLANKS, "\n", ".", ",", ":"):
        _OPENERS.add_word(f"{_word}{_space}", (_INTRODUCTION, len(_word) + 1))
_OPENERS.make_automaton()
_NAME_TOKEN = rf"(?:{_L}\.|{_W})"
_CAP_WORD = re.compile(_CAP)
_GAP = re.compile(_SP)
_WORD = re.compile(_W)
_INTRODUCED = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(re.escape(w) for w in sorted(INTRODUCES, key=len, reverse=True))})(?!\w)[.,:]{{0,2}}(?:{_SP}|\n{{1,2}})")
_TAIL = re.compile(rf",{_SP}({_W}(?:{_SP}(?:{_L}\.|{_W}(?=$|[\W])))?|{_L}\.)")
_WORD_BEFORE = re.compile(r"([^\W\d_]+|\S)\W{0,3}$")
_WORD_AFTER = re.compile(r"\W{0,3}?([^\W\d_]+|[^\s\w])")
_PARTICLE = frozenset(PARTICLES.split())
_TITLE = frozenset(TITLES.split())
_STOP = frozenset(STOP.split())
_CUE = {k: re.compile(v, re.I) for k, v in CUES.items()}
_COUNTER = {k: re.compile(v, re.I) for k, v in COUNTER_CUES.items()}
_AFTER = {k: re.compile(v, re.I) for k, v in AFTER_CUES.items()}
_AFTER_NOT = {k: re.compile(v, re.I) for k, v in AFTER_COUNTER.items()}


@dataclass
class Names:
    """Gazetteer of given and family names, and the endings that several family names share."""

    given: frozenset[str]
    family: frozenset[str]
    endings: frozenset[str] = field(default_factory=frozenset)
    #: Finds given names (value: their length), odd family names and shared endings (value: minus their length).
    marks: ahocorasick.Automaton | None = None

    @staticmethod
    def of(rows: list[tuple[str | None, str | None]], ending: int = 4, least: int = 3) -> Names:
        given = frozenset(n.casefold() for n, k in rows if n and k == "given")
        family = frozenset(n.casefold() for n, k in rows if n and k == "family")
        count: dict[str, int] = {}
        for name in family:
            for part in re.split(r"[-’' ]", name):
                if len(part) > ending:
                    count[part[-ending:]] = count.get(part[-ending:], 0) + 1
        # a shorter ending counts if many names have it after many different letters
        short: dict[str, list[str]] = {}
        for name in family:
            for part in re.split(r"[-’' ]", name):
                if len(part) > ending:
                    short.setdefault(part[1 - ending :], []).append(part[-ending])
        stems = {e for e, c in short.items() if len(c) >= 2 * least and len(set(c)) > least}
        endings = frozenset(stems | {e for e, c in count.items() if c >= least and e[1:] not in stems})
        odd = (f for f in family if f[-ending:] not in endings and f[1 - ending :] not in endings)
        marks = ahocorasick.Automaton()
        for n, k in rows:
            if n and k == "given":
                marks.add_word(n.lower(), len(n.lower()))
        for n in (*endings, *odd):  # a name that is both counts as a family name, which may take what is in front
            marks.add_word(n.lower(), -len(n.lower()))
        if len(marks):
            marks.make_automaton()
        return Names(given, family, endings, marks if len(marks) else None)

    def family_like(self, word: str) -> bool:
        low = word.casefold()
        return low in self.family or any(low.endswith(e) and len(low) > len(e) for e in self.endings)


def _lower(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) > 1 else x for c in text)


def _local_part(text: str, at: int) -> int:
    """Start of the run of address characters that ends at ``at``."""
    a = at
    while a and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):
        a -= 1
    return a


def _email(text: str, low: str) -> list[tuple[int, int]]:
    out = []
    at = text.find("@")
    while at >= 0:
        a, right = _local_part(text, at), _AFTER_AT.match(text, at + 1)
        if right:
            while a < at and text[a] in ".+%-":
                a += 1
            if a < at and ("." in right.group() or "dot" in text[right.end() : right.end() + 6].lower()):
                out.append((a, right.end()))
        at = text.find("@", at + 1)
    for m in _AT_WORD.finditer(text) if "dot" in low or _BRACKET_AT.search(low) else ():
        a, right = _local_part(text, m.start()), _DOT_DOMAIN.match(text, m.end())
        while a and (dot := _DOT_LEFT.search(text, max(0, a - 8), a)) and (more := _local_part(text, dot.start())) < dot.start():
            a = more  # a spelt-out dot in front of it
        if a < m.start() and right and ((m.group().strip().lower() != "at" and _DOT.search(right.group())) or _SPELT_DOT.search(right.group())):
            out.append((a, right.end()))
    return out


def _openings(low: str) -> tuple[bool, list[int], list[int]]:
    """(whether an address with the number last may occur, starts of labels of ids, starts of introductions)."""
    street, labels, introductions = False, [], []
    for end, (kind, length) in _OPENERS.iter(low):
        if kind == _STREET_END:
            street = street or low[end + 1 : end + 7].lstrip(f"., {_BLANKS}")[:1].isdigit()
            continue
        start = end - length + 1
        if start and (low[start - 1].isalnum() or low[start - 1] == "_"):
            continue
        if kind == _STREET_WORD:
            street = True
        else:
            (labels if kind == _LABEL_OF_ID else introductions).append(start)
    return street, labels, introductions


def _may_end_in_number(low: str) -> bool:
    return _openings(low)[0]


def _ids(text: str, labels: list[int] = ()) -> list[tuple[int, int]]:
    out, done = [], 0
    for d in _ID_DIGITS.finditer(text):
        for at in range(max(done, d.start() - 4), d.start() + 1):
            m = _ID.match(text, at)
            if m and m.end() >= d.end():
                out.append(m.span())
                done = m.end()
                break
    out += [m.span(1) for at in labels if (m := _ID_LABELLED.match(text, at))]
    return list(dict.fromkeys(out))


def _case_of(word: str) -> str:
    return "U" if word.isupper() and len(word) > 1 else "T" if word[:1].isupper() else "l"


def _given_like(token: str, upper: bool, names: Names) -> bool:
    """Whether a token in front of a family name may be a given name or an initial."""
    if token.endswith("."):
        return len(token) == 2
    low = token.casefold()
    if low in names.given:
        return True
    return token[0].isupper() and low not in _STOP and low not in _TITLE and (upper or not token.isupper() or len(token) == 1) and len(token) > 1


def _word_left(text: str, at: int) -> int:
    """Start of the name word or initial that ends, but for spaces, at ``at``; -1 if there is none."""
    e = at
    while e and at - e < 3 and text[e - 1] in " \t\u00a0\u2009\u202f":
        e -= 1
    if e > 1 and text[e - 1] == ".":
        s = e - 2
        return s if text[s].isalpha() and not (s and (text[s - 1].isalnum() or text[s - 1] in "_@+")) else -1
    if e == at:
        return -1
    s = e
    while s and (text[s - 1].isalnum() or text[s - 1] in "_’'-"):
        s -= 1
    while s < e and not text[s].isalpha():
        s += 1
    if s == e or s and text[s - 1] in "@+" or s > 1 and text[s - 1] == "." and not (text[s - 2].isalpha() and (s == 2 or not text[s - 3].isalnum())):
        return -1
    return s


def _by_family(text: str, b: int, ending: int, names: Names) -> tuple[int, int] | None:
    """The name whose family name, or the family name in front of whose given names, ends at ``b``."""
    a = b
    while a and (text[a - 1].isalpha() or text[a - 1] in "’'-" and a < b and text[a].isalpha()):
        a -= 1
    while a < b and not text[a].isalpha():
        a += 1
    if a and (text[a - 1].isalnum() or text[a - 1] in "_’'-@.+"):
        return None
    family = text[a:b]
    if len(family) == ending and family.casefold() not in names.family:
        return None  # an ending alone is no name
    if b < len(text) and text[b] == "@":
        return None
    upper = family.isupper()
    start, at, given = a, a, 0
    while (s := _word_left(text, at)) >= 0:
        word = text[s:at].rstrip()
        if not given and word.casefold() in _PARTICLE:
            pass
        elif given < MOST_GIVEN and _given_like(word, upper, names):
            given += 1
            start = s
        else:
            break
        at = s
    if given:
        return start, b
    tail = _TAIL.match(text, b)
    if tail:
        words = tail.group(1).split()
        first = words[0]
        if _given_like(first, upper, names) and (first.casefold() in names.given or first.endswith(".") or _case_of(first) == _case_of(family)):
            end = tail.end() if len(words) == 1 or (words[1].endswith(".") and len(words[1]) == 2) or words[1].casefold() in names.given else b + tail.group().index(first) + len(first)
            return at, end  # particles in front of the family name belong to it
    return None


def _forward(text: str, at: int, names: Names, least: int) -> tuple[int, int] | None:
    """A name of capitalised words, initials and particles from ``at`` on, with a whole word at its end."""
    end, pos, whole, count = at, at, 0, 0
    while count < MOST_WORDS:
        if text[pos + 1 : pos + 2] == "." and text[pos].isupper():
            pos += 2
        elif m := _CAP_WORD.match(text, pos):
            low = m.group().casefold()
            if low in _STOP or low in _TITLE or any(c.isdigit() or c == "_" for c in m.group()):
                break
            pos = m.end()
            if m.end() - m.start() > 1:
                whole += 1
                end = pos
        elif count and (m := _WORD.match(text, pos)) and m.group() in _PARTICLE:
            pos = m.end()
        else:
            break
        count += 1
        gap = _GAP.match(text, pos)
        if not gap and text[pos - 1] != ".":
            break
        pos = gap.end() if gap else pos
    if count < 2 or whole < least or end == at or text[end : end + 1] in ("@", "_"):
        return None
    return at, end


def _person(text: str, low: str, names: Names, introductions: list[int]) -> list[tuple[int, int]]:
    if names.marks is None:
        return []
    found: dict[tuple[int, int], None] = {}
    for last, length in names.marks.iter(low):
        b = last + 1
        after = text[b : b + 2]
        if after[:1].isalnum() or after[:1] in ("_", "’", "'") or after[:1] == "-" and after[1:].isalpha():
            continue
        if length < 0:
            span = _by_family(text, b, -length, names)
        else:
            a = b - length
            span = None if a and (text[a - 1].isalnum() or text[a - 1] in "_’'-@.+") or not text[a].isupper() else _forward(text, a, names, 2)
        if span:
            found[span] = None
    for at in introductions:
        m = _INTRODUCED.match(text, at)
        if m and (span := _forward(text, m.end(), names, 1)):
            found[span] = None
    return list(found)


def _votes(kind: str, text: str, a: int, b: int, names: Names) -> str:
    """One sign per labeler: '+', '-' or '0'."""
    value = text[a:b]
    before, after = text[max(0, a - 45) : a].rsplit("\n", 1)[-1], text[b : b + 24].split("\n", 1)[0]
    v = [
        1 if _CUE[kind].search(before) else 0,
        -1 if _COUNTER[kind].search(before) else 0,
        1 if _AFTER[kind].match(after) else 0,
        -1 if _AFTER_NOT[kind].match(after) else 0,
    ]
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        domain = re.split(r"(?i)@| ?[\[({] ?at ?[\])}] ?| at ", value)[-1]
        labels = [x for x in re.split(r"(?i)\.| ?[\[({] ?dot ?[\])}] ?| dot ", domain) if x]
        local = value[: len(value) - len(domain)]
        v += [
            1 if len(labels) > 1 and labels[-1].isalpha() and len(labels[-1]) > 1 else -1,
            1 if any(c.isalpha() for c in local) else -1,
            -1 if labels and all(x.isdigit() for x in labels) else 1 if len(labels) > 1 else 0,
        ]
    elif kind == "phone":
        v += [
            1 if value[0] == "+" or value.startswith("00") else 0,
            1 if value[0] in "(0+" or re.fullmatch(r"(?:1[-. ])?\d{3}([-. ])\d{3}\1\d{4}", value) else -1,
            1 if 8 <= digits <= 14 else -1,
        ]
    elif kind == "id_number":
        groups = re.findall(r"[A-Za-z]+|\d+", value)
        v += [
            1 if len(groups) >= 3 else 0,
            1 if 7 <= digits <= 12 else -1,
            -1 if re.fullmatch(r"[A-Za-z]{3}\d{6,9}", value) else 1 if re.search(r"[A-Za-z]$|^[A-Za-z]{1,2}\W?\d", value) else 0,
        ]
    elif kind == "address":
        words = re.findall(rf"{_L}+", value)
        v += [
            1 if any(w.casefold() in STREET_LAST.split() or w.casefold() in STREET_FIRST.split() or w.casefold() in ("calle", "avenida", "plaza") for w in words) or re.search(r"(?i)(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|gracht|graben)\b", value) else 0,
            1 if all(w[0].isupper() or len(w) <= 7 for w in words) and any(w[0].isupper() and len(w) > 1 for w in words) else -1,
            1 if re.match(r"\d{1,3}\b|\d+[a-c-]|.*\b\d{1,3}[a-c]?$", value) else 0,
        ]
    else:
        tokens = re.findall(rf"{_L}\.|{_W}", value)
        low = [t.casefold() for t in tokens]
        known_given = any(t in names.given for t in low)
        initial = any(len(t) == 2 and t[1] == "." for t in tokens)
        v += [
            1 if known_given else 0,
            1 if any(t in names.family for t in low) else 0,
            -1 if len(tokens) < 2 else 1 if initial or len([t for t in low if t not in _PARTICLE]) >= 2 else -1,
            -1 if low[0] in _STOP and low[0] not in _PARTICLE else 0,
            1 if names.family_like(tokens[-1]) or value.find(",") > 0 and names.family_like(value[: value.index(",")].split()[-1]) else 0,
        ]
    return "".join("+" if x > 0 else "-" if x < 0 else "0" for x in v)


def _shape(value: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in value[:24]))


def candidates(text: str | None, names: Names) -> list[tuple[int, int, int, str, str, str]]:
    """(kind, start, end, votes, word before, word after) of each candidate span of a whole text."""
    if not text:
        return []
    low = _lower(text)
    spans = [(0, a, b) for a, b in _email(text, low)]
    spans += [(1, *m.span()) for m in _PHONE.finditer(text) if sum(c.isdigit() for c in m.group()) >= 8]
    street, labels, introductions = _openings(low)
    spans += [(2, a, b) for a, b in _ids(text, labels)]
    spans += [(3, *m.span()) for m in _ADDRESS.finditer(text) if not _NO_STREET.intersection(m.group().lower().split())]
    if street:
        spans += [(3, *m.span()) for m in _ADDRESS_LAST.finditer(text)]
    spans += [(4, a, b) for a, b in _person(text, low, names, introductions)]
    out = []
    for k, a, b in spans:
        w0 = _WORD_BEFORE.search(text, max(0, a - 24), a)
        w1 = _WORD_AFTER.match(text, b)
        out.append((k, a, b, _votes(KINDS[k], text, a, b, names), w0.group(1).casefold() if w0 else "", w1.group(1).casefold() if w1 else ""))
    return out


#: Prior of a labeler's votes (-, 0, +) on spans that are none and on spans that are one.
VOTE_PRIOR = np.array([[0.50, 0.35, 0.15], [0.05, 0.25, 0.70]])
#: Weight of that prior, as a share of the candidates.
PRIOR_WEIGHT = 0.1


def estimate(counts: dict[str, int], rounds: int = 60) -> tuple[np.ndarray, dict[str, float]]:
    """EM over vote vectors: (reliability of each labeler, probability that a vector's spans are true).

    The model has, for each labeler and class, the shares of its votes -, 0 and +, so a labeler that
    votes alike on both classes tells nothing, and one that only ever votes one way may tell much.
    The prior of the shares keeps the classes from changing places where nearly all candidates are of
    one class. The reliability of a labeler is the share of its votes (without 0) that are right.
    """
    patterns = sorted(counts)
    votes = np.array([["-0+".index(c) for c in p] for p in patterns]).reshape(len(patterns), -1)
    n = np.array([counts[p] for p in patterns], dtype=float)
    labelers = np.arange(votes.shape[1])
    onehot = np.eye(3)[votes]  # vector, labeler, vote
    share = np.repeat(VOTE_PRIOR[:, None, :], len(labelers), axis=1)
    prior = 0.5
    p = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        logs = np.log(share)[:, labelers, votes].sum(-1)
        odds = np.log(prior / (1 - prior)) + logs[1] - logs[0]
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        weight = np.stack([(1 - p) * n, p * n])
        cast = np.einsum("cv,vlk->clk", weight, onehot) + VOTE_PRIOR[:, None, :] * (PRIOR_WEIGHT * n.sum() + 1)
        share = cast / cast.sum(-1, keepdims=True)
        prior = float(np.clip((n @ p + 1) / (n.sum() + 2), 0.05, 0.95))
    right = n @ (onehot[:, :, 2] * p[:, None] + onehot[:, :, 0] * (1 - p)[:, None])
    return right / np.maximum(n @ (onehot[:, :, 2] + onehot[:, :, 0]), 1e-9), dict(zip(patterns, p.tolist()))


def _features(votes: str, before: str, after: str, value: str) -> list[str]:
    return [*(f"{i}{c}" for i, c in enumerate(votes)), f"b:{before}", f"a:{after}", f"s:{_shape(value)}"]


@dataclass
class Model:
    """Per kind: a bias and the weights of the features; and the gazetteer the candidates need."""

    names: Names
    bias: list[float]
    weights: list[dict[str, float]]
    reliability: list[list[float]]

    def probability(self, kind: int, votes: str, before: str, after: str, value: str) -> float:
        w = self.weights[kind]
        z = self.bias[kind] + sum(w.get(f, 0.0) for f in _features(votes, before, after, value))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def keep(self, found: list[tuple[int, int, int, str, str, str, str]]) -> list[tuple[int, int, int, str]]:
        """(kind, start, end, value) of the spans that stay, in order of position."""
        scored = [(e - s, self.probability(k, v, b, a, x), k, s, e, x) for k, s, e, v, b, a, x in found]
        taken: list[tuple[int, int, int, str]] = []  # (start, end, kind, value) in order of position
        for _, p, k, s, e, x in sorted(scored, key=lambda t: (-t[0], -t[1], t[3])):
            if p >= THRESHOLD:
                at = bisect_left(taken, (s,))
                if (not at or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e):
                    taken.insert(at, (s, e, k, x))
        return [(k, s, e, x) for s, e, k, x in taken]


def _fit(rows: list[tuple[str, str, str, str]], target: np.ndarray, least: int = 5, steps: int = 300) -> tuple[float, dict[str, float]]:
    """Logistic regression on soft labels; features seen fewer than ``least`` times are left out."""
    feats = [_features(*r) for r in rows]
    seen: dict[str, int] = {}
    for fs in feats:
        for f in fs:
            seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= least))}
    row = np.array([i for i, fs in enumerate(feats) for f in fs if f in index], dtype=np.int64)
    col = np.array([index[f] for fs in feats for f in fs if f in index], dtype=np.int64)
    w, bias = np.zeros(len(index)), 0.0
    g2, b2 = np.full(len(index), 1e-8), 1e-8
    for _ in range(steps):
        z = bias + np.bincount(row, w[col], len(rows))
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        g = np.bincount(col, err[row], len(index)) / len(rows) + 1e-4 * w
        gb = err.mean()
        g2, b2 = g2 + g * g, b2 + gb * gb
        w -= 0.5 * g / np.sqrt(g2)
        bias -= 0.5 * gb / math.sqrt(b2)
    return bias, {f: float(w[i]) for f, i in index.items()}


def find_candidates(df: DataFrame, doc_id: str, text: str, names: Names, whole: bool = False) -> DataFrame:
    """``doc_id`` and ``found``, an array of candidate structs, of each text with candidates.

    With ``whole``, of every row, and with its text in a third column.
    """
    kind = dict(df.dtypes)[doc_id]
    ddl = f"doc_id {kind}, found array<struct<k:int,s:int,e:int,v:string,b:string,a:string,x:string>>" + (", text string" if whole else "")
    struct = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("v", pa.string()), ("b", pa.string()), ("a", pa.string()), ("x", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                cols: list[list] = [[] for _ in range(7)]
                sizes, keep = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    found = candidates(t, names)
                    if found or whole:
                        keep.append(i)
                        sizes.append(len(found))
                        for f in found:
                            for c, x in zip(cols, (*f, t[f[1] : f[2]])):
                                c.append(x)
                flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, struct)], fields=list(struct))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat)
                out = [part.column(0).take(pa.array(keep, pa.int64())), lists, *([part.column(1)] if whole else [])]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "found", "text"][: len(out)])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return (rows if whole else rows.where("text is not null")).mapInArrow(run, ddl)


def train(found: DataFrame, names: Names, sample: int = SAMPLE) -> Model:
    """Estimate reliabilities over all candidates and fit the span classifiers on a bounded sample.

    A candidate is in the sample if its hash, as a number in [0, 1), is below sample / candidates of its
    kind; so about ``sample`` rows a kind reach the driver, from however many partitions.
    """
    spans = found.select("doc_id", F.inline("found"))
    counts = spans.groupBy("k", "v").count().collect()  # at most 3^labelers rows a kind
    votes: list[dict[str, int]] = [{} for _ in KINDS]
    for r in counts:
        votes[r["k"]][r["v"]] = r["count"]
    share = F.shiftrightunsigned(F.xxhash64("doc_id", "s", "x", "v"), 11) / F.lit(float(1 << 53))
    below = F.lit(0.0)
    for k, v in enumerate(votes):
        below = F.when(F.col("k") == k, sample / max(1, sum(v.values()))).otherwise(below)
    rows: list[list[tuple[str, str, str, str]]] = [[] for _ in KINDS]
    for r in spans.where(share < below).select("k", "v", "b", "a", "x").collect():
        rows[r["k"]].append((r["v"], r["b"], r["a"], r["x"]))
    bias, weights, reliability = [], [], []
    for k in range(len(KINDS)):
        if not rows[k]:
            bias.append(-1.0)
            weights.append({})
            reliability.append([])
            continue
        r, p = estimate(votes[k])
        reliability.append(r.tolist())
        rows[k].sort()
        b, w = _fit(rows[k], np.array([p[x[0]] for x in rows[k]]))
        bias.append(b)
        weights.append(w)
    return Model(names, bias, weights, reliability)


def gazetteer(name_parts: DataFrame, name: str = "name", kind: str = "kind", most: int = 1_000_000) -> Names:
    """The reference list of names, which must have at most ``most`` rows."""
    rows = name_parts.select(name, kind).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the name list has over {most} rows")
    return Names.of([(r[0], r[1]) for r in rows])


def spans_of(found: DataFrame, model: Model) -> DataFrame:
    """(doc_id, kind, value): one row per distinct value of a kind in a text."""
    ddl = f"doc_id {dict(found.dtypes)['doc_id']}, kind string, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, values = [], [], []
            for i, cand in enumerate(batch.column(1).to_pylist()):
                kept = model.keep([tuple(c.values()) for c in cand])
                for k, x in dict.fromkeys((k, x) for k, _, _, x in kept):
                    at.append(i)
                    kinds.append(KINDS[k])
                    values.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["doc_id", "kind", "value"])

    return found.mapInArrow(run, ddl)


def personal_spans(docs: DataFrame, name_parts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal information of every text, as (doc_id, kind, value).

    Null and empty texts have none; repeated texts are treated one by one; texts are searched whole;
    an empty table, or an empty name list, gives no rows (of kind person).
    """
    names = gazetteer(name_parts)
    found = Stored(find_candidates(docs, doc_id, text, names), "spans").df
    return spans_of(found, train(found, names))


def redact(docs: DataFrame, name_parts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``doc_id`` and ``text`` with each span replaced by its kind, as in ``[EMAIL]``.

    All occurrences of a kept span's text position are replaced and nothing else is changed; null
    texts stay null, rows are neither added nor lost.
    """
    names = gazetteer(name_parts)
    found = Stored(find_candidates(docs, doc_id, text, names, whole=True), "spans").df
    model = train(found, names)

    def clean(t: str | None, cand: list[dict]) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for k, s, e, _ in model.keep([tuple(c.values()) for c in cand]):
            out += [t[at:s], f"[{KINDS[k].upper()}]"]
            at = e
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t, c) for t, c in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return found.mapInArrow(run, f"doc_id {dict(found.dtypes)['doc_id']}, text string")
