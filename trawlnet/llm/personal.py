"""Personal information inside free text (problem 9).

Texts are first deobfuscated by a transducer that keeps, for each character it writes, the span of the source it stands
for: invisible characters vanish, width variants and dashes become plain, letters of another script that look Latin become
Latin within Latin words, and runs of spelled digits become digits. Identifiers are found in that text and mapped back to
the source. Names are found by what stands before or after them: an introducing phrase, a title, a verb of speech, or an
identifier beside them.

Two-word towns are learned from the corpus itself, from addresses whose postcode ends them. Addresses that end with a town
need that to know where it ends: both ends are kept for them until they're joined with the learned towns.

Defined results: null and empty texts have no items; spans don't overlap (an identity number goes before an address, email,
phone and name); repeated texts give the same spans each; nothing is cut from long texts, and no item is too long.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.session import spread

# Letters that look Latin, invisible characters, dashes and spelled digits.
_LOOK = dict(zip("аеорсухіјѕԁһАВЕКМНОРСТХУІЈЅοαερυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhABEKMHOPCTXYIJSoaepuvABEZHIKMNOPTYX"))
_GONE = frozenset("­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿")
_DASHES = frozenset("‐‑‒–—―−﹣－")
_DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_SPELLED = re.compile(rf"\b(?:{'|'.join(_DIGITS)})(?:[ ,-]+(?:{'|'.join(_DIGITS)})){{6,}}\b", re.I)
_LATIN_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(f"[A-Za-z][{''.join(_LOOK)}]|[{''.join(_LOOK)}][A-Za-z]")
_SPECIAL = re.compile(f"[{''.join(_GONE)}{''.join(_DASHES)}\u00a0\u2009\u202f\u3000\uff01-\uff5e]|(?![0-9])\\d")


def normalise(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The deobfuscated text, and for each of its characters begin and end in the source (None: the same places)."""
    lower = text.lower()
    spelled = sum(map(lower.count, _DIGITS)) > 6 and _SPELLED.search(text)
    if not spelled and (text.isascii() or not _SPECIAL.search(text) and not _MIXED.search(text)):
        return text, None, None
    chars, begins, ends = [], [], []
    for i, c in enumerate(text):
        if c in _GONE:
            continue
        if not c.isascii():
            if c in _DASHES:
                c = "-"
            elif c in "   　":
                c = " "
            elif "！" <= c <= "～" or c.isdigit():
                c = unicodedata.normalize("NFKC", c)[:1]
                if c.isdecimal():
                    c = str(unicodedata.decimal(c))
        chars.append(c)
        begins.append(i)
        ends.append(i + 1)
    if any(c in _LOOK for c in chars):
        for m in _LATIN_WORD.finditer("".join(chars)):
            w = m.group()
            if any(x in _LOOK for x in w) and any("a" <= x.lower() <= "z" for x in w):
                chars[m.start() : m.end()] = [_LOOK.get(x, x) for x in w]
    out = "".join(chars)
    if spelled:
        parts, nb, ne, at = [], [], [], 0
        for m in _SPELLED.finditer(out):
            parts.append(out[at : m.start()])
            nb += begins[at : m.start()]
            ne += ends[at : m.start()]
            for w in re.finditer(r"[a-z]+", m.group(), re.I):
                parts.append(_DIGITS[w.group().lower()])
                nb.append(begins[m.start() + w.start()])
                ne.append(ends[m.start() + w.end() - 1])
            at = m.end()
        out, begins, ends = "".join([*parts, out[at:]]), nb + begins[at:], ne + ends[at:]
    return out, begins, ends


_L = r"[^\W\d_]"
_WORD = rf"{_L}(?:{_L}|['’\-](?={_L}))*"

_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sDOT\s)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9.+_%-]*[A-Za-z0-9_])?"
_LOCALS = rf"{_LOCAL}(?:(?:\s?[\[({{]\s?dot\s?[\])}}]\s?|\sDOT\s){_LOCAL})*"
_AT_WORD = re.compile(r"\s?[\[({]\s?at\s?[\])}]\s?|\sAT\s|\sat\s(?=\S+(?:\s\S+)?\sdot\s)")
_AT_BRACKET = re.compile(r"[\[({]\s?at")
_BEFORE_AT = re.compile(rf"(?<![A-Za-z0-9.+_%-]){_LOCALS}$")
_BEFORE_AT_PLAIN = re.compile(rf"(?<![A-Za-z0-9.+_%-]){_LOCAL}(?:\sdot\s{_LOCAL})*$")
_AFTER_AT = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}(?![\w@])")
_AFTER_AT_PLAIN = re.compile(rf"{_LABEL}(?:\sdot\s{_LABEL})*\sdot\s[A-Za-z]{{2,24}}\b")
#: Endings of file names, which aren't top-level domains.
_FILES = frozenset("png jpg jpeg gif webp svg ico css js json html htm pdf gz xml txt".split())

_ID = re.compile(
    r"(?<![\w.+/-])(?:"
    r"[12] \d\d \d\d \d\d \d{3} \d{3} \d\d|\d{4} \d{4} \d{4}(?! ?\d)|\d{3}-\d\d-\d{4}|"
    r"[A-Z]{2}([ -]?)\d\d\1\d\d\1\d\d\1[A-D]|\d{8}-?[A-Z]|\d\d\.\d{3}\.\d{3}-?[A-Z]"
    r")(?![\w/]|-\d|\.\d)",
)
_LOOSE_ID = re.compile(r"(?<![\w.+/-])(?:\d{9}|\d{3} \d\d \d{4}|[12]\d{14}|\d{12})(?![\w/]|-\d|\.\d)")
#: Words that announce an identity number.
_ID_CUE = re.compile(r"(?:SSN|[Nn]umber|ID:?|[Nn]uméro|documento|[Nn]úmero|nummer|[Čč]íslo|[Nn]umer|номер|[Pp]assport|番号：?|\()$")

_PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(0\)[ ]?)?\d{1,5}(?:(?: / |[ ./-])\d{1,8}){0,5}|"
    r"00\d{2}[ ./-]?\d{1,4}(?:[ ./-]\d{2,8}){1,5}|"
    r"\(0?\d{2,5}\) ?\d{3,8}(?:[ -]\d{2,4}){0,2}|(?:1[ .-])?\d{3}([.-])\d{3}\1\d{4}|1[2-9]\d{2}[2-9]\d{6}|"
    r"0\d(?:[ .]\d\d){4}|0\d{4} \d{6}|0\d{2} \d{4} \d{4}|0\d{2,4}[ /]\d{5,8}(?:[ -]\d{1,4})?"
    r")(?!\w|-\d|\.\d|:\d)",
)

_NUMBER = r"\d{1,4}"
_SEP = r"(?:,[ \n]\s*| - |\s*\n\s*)"
_CAP = rf"(?=[^\W\d_a-z])(?!{_L}\b\.){_WORD}"
_KIND_EN = r"(?:Street|St|Lane|Ln|Road|Rd|Row|Close|Drive|Dr|Avenue|Ave|Boulevard|Blvd|Way|Court|Ct|Square|Terrace|Place|Crescent|Gardens|Hill)\b\.?"
_TOWN = rf"{_CAP}(?:[ ]{_CAP}){{0,2}}"
_POST_LAST = re.compile(
    rf"(?<![\w/.-]){_NUMBER}[a-z]?\s(?:(?:[NSEW]\.|North|South|East|West)\s)?(?:{_CAP}\s){{1,3}}{_KIND_EN}"
    rf"(?:,?\s(?:(?:Apt|Flat|Unit|Suite|Apartment)\.?\s?\w{{1,5}}|#\s?\w{{1,5}}))?{_SEP}(?P<town>{_TOWN}),\s(?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}}|[A-Z]{{2}}\s\d{{5}}(?:-\d{{4}})?)(?!\w)"
)
_TYPE_FR = r"(?:rue|avenue|av\.|quai|impasse|boulevard|bd\.?|bl\.|place|chemin|allée|allées|cours|route|passage|square|sentier)"
_TYPE_ES = r"(?:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Pza\.|Paseo|Camino|Ronda|Carretera|Travesía|Rua|Praça|Largo|Travessa|Via|Piazza|Corso)"
_END_DE = r"(?:straße|strasse|str\.|gasse|weg|ufer|platz|allee|ring|damm|hof|steig|graben|markt|berg)"
_STREETS = (
    rf"{_NUMBER}(?:\s?[a-z]\b|\s(?:bis|ter|quater))?,?\s{_TYPE_FR}\s(?:{_WORD}[ ]){{0,4}}?{_WORD}"
    rf"|{_TYPE_ES}\s(?:{_WORD}\s){{0,4}}?{_WORD},?\s{_NUMBER}(?:,\s(?:bajo|ático|\d{{1,2}}\.?[ºª°o](?:\s?\w{{1,3}})?))?"
    rf"|(?:{_CAP}(?:-{_CAP})?{_END_DE}|{_L}+{_END_DE}|(?:Am|An|Im|In|Zum|Zur|Auf|Unter|Hinter|Beim)(?:\s(?:der|den|dem))?(?:\s{_CAP}){{1,3}})\s{_NUMBER}(?:\s?[a-z]\b)?"
    rf"|(?:(?:Na|Nad|Pod|Před|Při|Za|U|V|Ve|K|Ke|Do)\s{_WORD}(?:\s{_WORD})?|{_CAP})\s{_NUMBER}/{_NUMBER}[a-z]?"
    rf"|(?:ul\.|al\.|ул\.|пр\.|οδός)\s(?:{_WORD}\s){{0,2}}{_WORD},?\s(?:д\.\s)?{_NUMBER}[a-zа-я]?"
)
_POST_FIRST = re.compile(rf"(?<![\w/])(?:{_STREETS}){_SEP}(?:\d{{5}}|\d{{3}}\s\d\d|\d\d-\d{{3}}|\d{{6}})\s(?P<town>{_CAP})(?P<more>[ ]{_CAP})?")

_CODE_LAST = re.compile(r", (?:[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}|[A-Z]{2}\s\d{5})")
_CODE_FIRST = re.compile(r"[0-9](?<=[\s,].)(?:\d{4}|\d\d\s\d\d|\d-\d{3}|\d{5})\s(?=[^\W\d_a-z])")
#: What identity and phone numbers lie in, but for three characters before and two after.
_FIGURES = re.compile(r"[0-9][0-9 ()./-]{5,}")
_AFTER_CODE = re.compile(r"(?:\S*\s){3}")
#: More words than an address has before its postcode, and a name with its title before an identifier.
_ADDRESS_WORDS, _NAME_WORDS = 24, 10


def _begin(norm: str, end: int, words: int, least: int = 0) -> int:
    """Where text begins that holds so many words before `end`, or `least`."""
    reach = 12 * words
    while end - reach > least and len(norm[end - reach : end].split()) <= words:
        reach *= 2
    return max(least, end - reach)


def _addresses(norm: str) -> Iterator[re.Match]:
    """Addresses, found by their postcodes."""
    for form, code in ((_POST_LAST, _CODE_LAST), (_POST_FIRST, _CODE_FIRST)):
        done = 0
        for c in code.finditer(norm):
            at = _begin(norm, c.start(), _ADDRESS_WORDS, done)
            end = after.end() if (after := _AFTER_CODE.match(norm, c.end())) else len(norm)
            while at < c.start() and (m := form.search(norm, at, end)) and m.start() < c.start():
                if m.end() >= c.end():
                    yield m
                    done = m.end()
                    break
                at = m.end()


def _in_figures(form: re.Pattern, norm: str, figures: list[tuple[int, int]]) -> Iterator[re.Match]:
    """The form's matches within the places that `_FIGURES` found."""
    done = 0
    for lo, hi in figures:
        for m in form.finditer(norm, max(done, lo - 3), hi + 6):
            done = m.end()
            yield m


def _signs(norm: str) -> list[tuple[int, int, bool]]:
    """Where at signs lie with the spaces beside them, plain or spelled out; and whether one is a bare word."""
    out = []
    at = norm.find("@")
    while at >= 0:
        out.append((at - (at > 0 and norm[at - 1].isspace()), at + 1 + (at + 1 < len(norm) and norm[at + 1].isspace()), False))
        at = norm.find("@", at + 1)
    if "AT" in norm or "at" in norm and ("dot" in norm or _AT_BRACKET.search(norm)):
        out += [(m.start(), m.end(), m.group() == " at ") for m in _AT_WORD.finditer(norm)]
        out.sort()
    return out


def _before_sign(norm: str, at: int, form: re.Pattern) -> int | None:
    """Where the local part begins that ends at an at sign."""
    reach = 64
    while True:
        begin = max(0, at - reach)
        local = form.search(norm[begin:at])
        if begin == 0 or not local or local.start() > 12:  # longer than a spelled dot, so nothing before belongs to it
            return begin + local.start() if local else None
        reach *= 4


def _is_announced(norm: str, at: int) -> bool:
    """Whether words that announce an identity number, or the border of a table's cells, stand before a place."""

    def bare(k: int) -> int:
        while k and norm[k - 1].isspace():
            k -= 1
        return k

    k = bare(at)
    if norm.endswith("<td>", 0, k):
        return norm.endswith("</td>", 0, bare(k - 4))
    return bool(_ID_CUE.search(norm, max(0, k - 16), k))  # no such word is longer


#: Titles before names, in ten languages.
_TITLE = (
    r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Miss|Sir|Frau|Herr|Hr|Fr|Sr|Sra|Srta|Dra|Dña|Don|Doña|Mme|Mlle|M|Ing|Mgr|MUDr|Bc|Pan|Pani|pan|paní|pani|Dipl|г-жа|г-н|κ|κα|Sig)\b\.?(?:\s|-Ing\.\s))"
)
_I = rf"{_L}\."
_NAME = rf"(?:{_I}\s(?:{_I}\s)?{_WORD}|{_WORD},\s{_WORD}(?:\s{_I})?|{_WORD}\s(?:{_I}\s){{0,2}}{_WORD})"
#: Phrases that introduce a person, in ten languages; the name follows, for those of the second list on the next line.
_CUES = (
    "According to|Please call|Hand-over from|Ticket opened by|The parcel for|the parcel for|public form still shows|author=|Author:|\"owner\": \"|Contact person:|"
    "Laut|Bitte rufen Sie|Ansprechpartner:|Ansprechpartnerin:|D’après|D'après|Appelez|Selon|Según|Llame a|Segundo|Ligue para|Podle|zvedne to|Według|"
    "Ответственный:|Ответственная:|По словам|Υπεύθυνος:|Σύμφωνα με|担当：|担当者：|担当:|Info:"
).split("|")
_CLOSINGS = (
    "Regards|regards|Sincerely|Cheers|Yours|Grüße|Grüßen|Cordialement|Saludos|Atentamente|Cumprimentos|Atenciosamente|S pozdravem|Z poważaniem|Pozdrawiam|"
    "С уважением|Με εκτίμηση"
).split("|")
_THEN_NAME = re.compile(rf"\s*(?:{_TITLE})*(?P<name>{_NAME})")
_LINE_NAME = re.compile(rf",?[ ]*\n\s*(?:{_TITLE})*(?P<name>{_NAME})")
_WHEN = re.compile(rf"\bWhen\s(?:{_TITLE})*(?P<name>{_NAME})\srestarted\b")
_TO = re.compile(rf"\s*to\s(?:{_TITLE})*(?P<name>{_NAME})\s(?=is\b)")
_AFTER_ID = re.compile(rf"\s?(?:\((?:{_TITLE})*(?P<inner>{_NAME})\)|(?:von|de|of|osoby|da|do|van|για)\s(?:{_TITLE})*(?P<name>{_NAME}))")
#: Verbs of speech after a name, and words of meeting and signing before one, that any
#: text may have, with titles; without letters that may be large.
_SPEECH = "said says wrote writes asked asks replied replies told reported reports confirmed confirms suggested agreed noted explained sagte sagt schrieb écrit dijo escribió disse".split()
_MET = (
    "meet|met|poke with|poke to|alk to|alked to|alk with|alked with|contact|hank|hanks to|emailed|I am|y name is|igned by|ritten by|ent by|eviewed by|eported by|ssigned to|Dr|Dr.|Prof.|Mr|Mr.|Mrs|"
    "Mrs.|Ms|Ms.|Frau|Herr|Sr.|Sra.|Mme|Mlle"
).split("|")
_BIG = rf"(?=[^\W\d_a-zß-öø-ÿ]){_L}{{2,}}(?:['’\-]{_L}+)*"
_BIG_NAME = rf"{_BIG}\s(?:{_I}\s){{0,2}}{_BIG}"
_NEXT_BIG = re.compile(rf"(?:{_TITLE})*(?P<name>{_BIG_NAME}|{_I}\s{_BIG})")
_LAST_BIG = re.compile(rf"(?<![\w'’-])(?P<name>{_BIG_NAME})$")
#: Words that can't be part of a name although they stand where one does.
_PLAIN = frozenset(
    "the a an our this that these those each every some any its his her their your my we you they it is was in on at of to for and or but by from with "
    "memory tel mail email phone fax order part batch page row version ticket der die das ein eine und von la le les el los las un une una".split()
)


def _is_name(name: str) -> bool:
    parts = [p for p in re.findall(_WORD, name) if len(p) > 1]
    return bool(parts) and not any(p.lower() in _PLAIN for p in parts)


def _capital(name: str) -> bool:
    return all(not p[0].islower() for p in re.findall(_WORD, name))


def find(text: str, towns: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items of a text in code points, in order and without overlap."""
    return [(lo, far if far and town in towns else hi, kind) for lo, hi, kind, far, town in spans(text)]


def spans(text: str | None) -> list[tuple[int, int, str, int | None, str | None]]:
    """(start, end, kind, far end, town): as find() has them. An address that may end with a town of two words has its far
    end and that town, to be decided by whether it is one."""
    if not text:
        return []
    norm, begins, ends = normalise(text)
    taken: list[tuple[int, int, str]] = []
    far_ends: dict[int, tuple[int, str]] = {}
    used = bytearray(len(norm))

    def take(lo: int, hi: int, kind: str) -> bool:
        if lo >= hi or any(used[lo:hi]):
            return False
        used[lo:hi] = b"\x01" * (hi - lo)
        taken.append((lo, hi, kind))
        return True

    figures = [m.span() for m in _FIGURES.finditer(norm)]
    for m in _in_figures(_ID, norm, figures):
        take(m.start(), m.end(), "id_number")
    for m in _in_figures(_LOOSE_ID, norm, figures):
        if _is_announced(norm, m.start()):
            take(m.start(), m.end(), "id_number")
    for m in _addresses(norm):
        g = m.groupdict()
        if not g.get("more"):
            take(m.start(), m.end(), "address")
        elif take(m.start(), m.end("town"), "address"):
            far_ends[m.start()] = m.end(), g["town"] + g["more"]
            used[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    for lo, hi, plain in _signs(norm):
        host = (_AFTER_AT_PLAIN if plain else _AFTER_AT).match(norm, hi)
        if host and host.group().rsplit(".", 1)[-1].lower() not in _FILES:
            if (begin := _before_sign(norm, lo, _BEFORE_AT_PLAIN if plain else _BEFORE_AT)) is not None:
                take(begin, host.end(), "email")
    for m in _in_figures(_PHONE, norm, figures):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            take(m.start(), m.end(), "phone")

    for cues, form in ((_CUES, _THEN_NAME), (_CLOSINGS, _LINE_NAME)):
        for cue in cues:
            at = norm.find(cue)
            while at >= 0:
                m = form.match(norm, at + len(cue)) if at == 0 or not norm[at - 1].isalpha() or not cue[0].isascii() else None
                if m and _is_name(m["name"]):
                    take(*m.span("name"), "name")
                    if cue == "Hand-over from" and (to := _TO.match(norm, m.end("name"))) and _is_name(to["name"]):
                        take(*to.span("name"), "name")
                at = norm.find(cue, at + len(cue))
    for m in _WHEN.finditer(norm) if "restarted" in norm else ():
        if _is_name(m["name"]):
            take(*m.span("name"), "name")
    for lo, hi, kind in list(taken):
        if kind in ("email", "phone", "id_number"):
            if kind == "id_number" and (m := _AFTER_ID.match(norm, hi)):
                which = "inner" if m["inner"] else "name"
                if _is_name(m[which]):
                    take(*m.span(which), "name")
            begin = _begin(norm, lo, _NAME_WORDS)
            window = norm[begin:lo]
            if at := _nearest(window):
                b, e = at
                if _is_name(window[b:e]) and (window[e] != "," or _capital(window[b:e])):
                    take(begin + b, begin + e, "name")
    for word in _MET:
        at = norm.find(cue := f"{word} ")
        while at >= 0:
            if (m := _NEXT_BIG.match(norm, at + len(cue))) and _is_name(m["name"]):
                take(*m.span("name"), "name")
            at = norm.find(cue, at + len(cue))
    for word in _SPEECH:
        at = norm.find(cue := f" {word} ")
        while at >= 0:
            if (m := _LAST_BIG.search(norm, _begin(norm, at, _NAME_WORDS), at)) and _is_name(m["name"]):
                take(*m.span("name"), "name")
            at = norm.find(cue, at + len(cue))
    taken.sort()
    if begins is None:
        return [(lo, hi, kind, *far_ends.get(lo, (None, None))) for lo, hi, kind in taken]
    out = []
    for lo, hi, kind in taken:
        far, town = far_ends.get(lo, (None, None))
        out.append((begins[lo], ends[hi - 1], kind, ends[far - 1] if far else None, town))
    return out


_TITLES = frozenset("dr prof mr mrs ms miss sir frau herr hr fr sr sra srta dra dña don doña mme mlle ing mgr pan pani paní".split())
_ENDS = re.compile(r"(?:\s?\((?:tel:)?|\s?<\s?(?:mailto:)?|\s\|\s(?:tel:)?|\s/\s(?:mailto:|tel:)?|;\s?mail=(?:mailto:)?|\",\s?\"phone\":\s?\"(?:tel:)?|</td>\s?<td>(?:tel:)?|,\s(?:tel:)?)$")
_LAST_NAMES = re.compile(rf"(?<![\w'’-])(?P<name>{_WORD},\s{_WORD}(?:\s{_I})?|(?:{_WORD}\s)?(?:{_I}\s){{1,2}}{_WORD}|{_WORD}\s{_WORD})$")


def _nearest(window: str) -> tuple[int, int] | None:
    """Where the name lies that ends just before an identifier, if one does."""
    if not (sep := _ENDS.search(window)):
        return None
    m = _LAST_NAMES.search(window, 0, sep.start())
    if not m:
        return None
    # The last match to begin is the name itself: two words, or an initial with the words on its sides.
    name = m["name"]
    words = name.split()
    if words[0].lower().rstrip(".") in _TITLES and len(words) > 2:
        m_start = m.start() + name.index(words[1])
    elif len(words) == 2 and not name[:-1].count(",") and words[0].lower().rstrip(".") in _TITLES:
        return None
    else:
        m_start = m.start()
    return m_start, sep.start()


def redact(text: str | None, towns: frozenset[str] = frozenset()) -> str | None:
    """The text with typed placeholders in place of its items; null stays null."""
    if not text:
        return text
    return spliced(text, find(text, towns))


def spliced(text: str | None, items: list[tuple[int, int, str]]) -> str | None:
    """The text with placeholders in place of the items, which are in order."""
    if not text or not items:
        return text
    out, at = [], 0
    for lo, hi, kind in items:
        out += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join([*out, text[at:]])


def learn_towns(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(town): the two-word towns of addresses that a postcode ends, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {m["town"] for t in b.column(0).to_pylist() for m in _POST_LAST.finditer(normalise(t)[0]) if " " in m["town"]}
            yield pa.RecordBatch.from_pydict({"town": pa.array(list(found), pa.string())})

    texts = documents.select(F.col(text_col).alias("text")).where(r"text rlike '[A-Z]{1,2}[0-9]{1,2}[A-Z]?\\s[0-9][A-Z]{2}|[A-Z]{2}\\s[0-9]{5}'")
    return texts.mapInArrow(run, "town string").distinct()


_SPANS = "doc_id bigint, text_hash bigint, start_char bigint, end_char bigint, kind string, far_end bigint, town string"


def _spans(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The spans of all documents, with the towns decided by a join; beyond broadcast size that's one of small rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, h, *item) for i, h, t in zip(*(c.to_pylist() for c in b.columns)) for item in spans(t)]
            cols = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in _SPANS.split(", ")])

    texts = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = spread(texts.where("text is not null")).mapInArrow(run, _SPANS)
    # Rows without a town have a key of their own each, so no task gets all of them.
    key = F.coalesce("town", F.concat_ws("\u0001", F.lit(""), "doc_id", "text_hash", "start_char"))
    towns = learn_towns(documents, text_col).withColumnRenamed("town", "_town")
    both = rows.join(towns, key == F.col("_town"), "left")
    return both.withColumn("end_char", F.when(F.col("_town").isNotNull(), F.col("far_end")).otherwise(F.col("end_char"))).drop("_town", "town", "far_end")


def found(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char, kind): one row for each item of each document."""
    return _spans(documents, id_col, text_col).drop("text_hash")


def redacted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): all documents with placeholders for their items; texts are joined with their own spans, by id and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [spliced(t, [(x["start_char"], x["end_char"], x["kind"]) for x in own or ()]) for t, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array(out, pa.string())})

    own = _spans(documents, id_col, text_col).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start_char", "end_char", "kind"))).alias("spans"))
    own = own.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    texts = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    both = texts.join(own, texts["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, text string")
