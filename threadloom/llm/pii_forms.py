"""Invented personal information of many forms, with what looks like it and is none, for training and testing the tagger of :mod:`pii`.

The tables hold few notations and names, so the tagger also learns from sentences made here.  ``made(rng)`` gives a text and its spans; with
``held=True`` names, words, domains, formats and sentences are others, none of which training sees, so that agreement on them
shows what was learnt and not what was remembered.
"""

from __future__ import annotations

import base64
import re

import numpy as np

_GIVEN = (
    "James Mary Robert Linda Michael Susan David Karen Richard Nancy Thomas Betty Charles Sandra Daniel Ashley Matthew Emily Anthony Donna Mark Carol Paul Amanda Steven Laura Kevin Sharon Brian Cynthia "
    "Hans Greta Klaus Ute Jürgen Sabine Wolfgang Heike Pierre Chloé Jean Amélie Luc Camille Étienne Margaux José Carmen Luis Lucía Javier Inés Miguel Rocío Giulia Marco Paolo Chiara João Beatriz Rui Mariana "
    "Lars Astrid Erik Freja Mikko Aino Piotr Agnieszka Jan Katarzyna Ivan Olga Dmitri Natalia Yuri Svetlana Ahmed Fatima Omar Layla Hassan Zainab Mehmet Elif Raj Priya Arjun Ananya Vikram Deepa "
    "Hiroshi Yuki Kenji Sakura Min-jun Ji-woo Li Fang Ming Xia Tao Jing Nguyen Linh Somchai Siti Budi Kwame Amara Chidi Ngozi Thabo Zanele Aroha Tane Leilani Sofia Noah Olivia Liam Emma Lucas Mia"
).split()
_FAMILY = (
    "Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Walker Hall Allen Young King Wright Scott Green Baker Adams Nelson Carter Mitchell "
    "Schmidt Müller Schneider Fischer Weber Meyer Wagner Becker Hoffmann Krüger Dubois Moreau Laurent Lefèvre Rousseau Girard García Martínez López Sánchez Ramírez Torres Rossi Russo Ferrari Bianchi Silva Santos "
    "Pereira Costa Hansen Johansson Nilsson Virtanen Korhonen Kowalski Nowak Wójcik Novák Petrov Ivanova Sokolov Haddad Al-Farsi Hussein Yılmaz Demir Sharma Patel Gupta Reddy Iyer Tanaka Suzuki Yamamoto Kim Park Choi "
    "Li Wang Zhang Liu Huang Zhou Tran Pham Suwan Wijaya Okafor Mensah Adeyemi Nkosi Dlamini Parata Kealoha O'Brien McCarthy MacDonald van-Dijk de-Vries Papadopoulos Popescu Horvat Kovács Jensen Lindqvist Eriksen"
).split()
_GIVEN_HELD = "John Wei Pedro Helen George Ruth Frank Alice Peter Julia Sven Ingrid Antoine Claire Diego Elena Matteo Bruna Oskar Hanna Pavel Irina Yusuf Noor Sanjay Meera Haruto Aiko Chen Mei Kofi Abena".split()
_FAMILY_HELD = "Smith Chen Almeida Roberts Turner Phillips Evans Parker Collins Keller Vogel Bernard Fontaine Navarro Ortega Conti Moretti Berg Dahl Mazur Volkov Khan Rahman Aydin Joshi Nair Sato Watanabe Zhao Boateng Owusu".split()
_SYLLABLES = "ba lo mir ten ka vo sel ri dan hu fe gor ny pas tul er is an mar ko le sha wen dor pi va ste bru cha no".split()
_PLACES = "London Leeds Bristol Boston Denver Austin Portland Chicago Seattle Oakland Berlin Hamburg Köln München Paris Lyon Nantes Bordeaux Madrid Sevilla Valencia Roma Milano Torino Lisboa Porto Utrecht Delft Oslo Malmö Kraków Praha Wien Graz Zürich Genève Dublin Cork Toronto Ottawa Sydney Perth".split()
_PLACES_HELD = "Springfield Manchester Houston Dresden Leipzig Lille Bilbao Napoli Braga Rotterdam Bergen Gdańsk Brno Linz Galway Halifax Brisbane".split()
_STREETS = "Oak Maple Cedar Main High Church Park Mill Station Victoria King Queen Elm Washington Lincoln Baker Garden River Spring School Bridge Forest Lake Highland Franklin Jefferson Chestnut Meadow Sunset Willow".split()
_STREETS_HELD = "Evergreen Abbey Harrison Juniper Walnut Orchard Castle Madison Prospect Linden".split()
_KINDS = "Street St. Avenue Ave. Road Rd. Lane Drive Court Blvd. Terrace Way Place Close Square Crescent St Ave Rd Dr Ln".split()
_WORDS = "acme globex initech umbrella northwind contoso fabrikam widget bluebird redwood silver harbour cloud data logic pixel quantum vertex atlas orbit ember falcon granite lotus maple nova prime summit vista zenith".split()
_WORDS_HELD = "uni stark hooli soylent wayne cyber tundra meadow copper kite".split()
_TOPS = "com org net io co.uk de fr es it nl se pl ch at eu info dev app gov ca".split()
_TOPS_HELD = "edu com.au co.jp pt be biz ac.uk us".split()
_ROLES = "info support sales admin office contact hello billing jobs press team help no-reply service".split()
_TITLE_A = (
    "Visual Google Apache Microsoft Amazon Open Release Pull Merge Quick Deep Machine Data Cloud Power Smart Black White Red Blue Green New North South East West Big Great Grand Central National Global United "
    "Project Team Error Build Test Unit Source File User Session Web Mobile Home Product Customer Service Monday Friday January March Last First Next Best General Public Private Daily Weekly System Network Key Main Final Active"
).split()
_TITLE_B = (
    "Cloud Code Request Notes Start Learning Science Console Shell Friday House Hat Sky Deal York Jersey America Africa Coast Apple Wall Canyon Park Bank States Kingdom Apollo Lead Message Server Runner Tests Control "
    "Manager Login Story Browser App Page Launch Support Desk Morning Release Quarter Week Practice Meeting Report Digest Update Check Layer Drive Office Table Index View Panel Folder Search Query Filter Menu Window Market Branch"
).split()
_TITLE_A_HELD = "Visual Android Continuous Neural Silicon Summer Annual Pending Static Virtual Docker Redis Hard Front Back Golden Empty Missing Remote".split()
_TITLE_B_HELD = "Studio Delivery Engine Valley Sprint Review Change Method Machine Image Cluster Reset Door Gate Record Value Origin".split()

_SENTENCES = (
    "Please contact {N} at {E}.|You can reach {N} on {P} or by mail at {E}.|{N} lives at {A}.|Her number is {P}.|His ID is {I}.|Send it to {A}, attention {N}.|Reported by {N} <{E}>|From: {N} <{E}>|To: {E}|Cc: {E}, {E}|"
    "assigned to {N}|reviewer: {N}|Author: {N}|{N} said that the build fails.|Ask {N} or {N} about it.|I talked with {N} yesterday.|call {P} after five|phone: {P}|Tel. {P}|mobile {P}|fax {P}, mail {E}|The customer ({N}, {P}) asked again.|"
    "my address is {A}|Ship to: {A}|billing address {A}|address={A}|{I}|number {I} is on file|The applicant's {I} was wrong.|identity {I}, name {N}|name: {N}\\nphone: {P}\\nmail: {E}|\"email\": \"{E}\"|\"name\": \"{N}\", \"phone\": \"{P}\"|"
    "user {E} logged in|login failed for {E}|mailto:{E}|{N}, {A}|Regards, {N}|Thanks {N}!|Signed, {N}\\n{A}|Meet {N} at the {X}.|{N} opened the {X}.|Use {X} and not {X}.|The {X} is in {X}.|See {X}|open {X}|{X}: {X}|version {X}|from {X} to {X}|"
    "We moved from {X}, says {N}.|{X} was updated|In {X} nothing changed.|{N}'s ticket|by {N} on {X}|- {N}\\n- {N}\\n- {X}|* {E}|patient {N}, born {X}|{X} {N}|Dr. {N} will call.|Mr. {N} lives near {X}|contact: {P} / {E}|{N} ({E})|{N} wrote:"
).replace("\\n", "\n").split("|")
_SENTENCES_HELD = (
    "Forward this to {E} please.|The owner is {N}.|Our office: {A}.|Dial {P} for help.|The form lists {I}.|Yours, {N}|Hi {N}, any news?|email {E} and phone {P}|it was {N} who asked|We use {X} daily.|Start {X} first.|Is {X} ready?|resident of {A}|registered as {I}|"
    "the new {X} page|met {N} in town|write to {E}"
).split("|")


def _digits(rng: np.random.Generator, form: str) -> str:
    """'#': any digit, '9': none but 0, '%': a capital."""
    return "".join(str(rng.integers(10)) if c == "#" else str(rng.integers(1, 10)) if c == "9" else "ABCDEFGHJKLMNPRSTWXYZ"[rng.integers(21)] if c == "%" else c for c in form)


_PHONES = (
    "(9##) 9##-####|9##-9##-####|9##.9##.####|+1 9## 9## ####|+1-9##-9##-####|1-9##-9##-####|+44 20 #### ####|+44 7### ######|020 #### ####|0#### ######|07### ######|+49 30 ########|+49 9## #######|030/#######|0## #### ####|+33 9 ## ## ## ##|0# ## ## ## ##|06 ## ## ## ##|"
    "07 ## ## ## ##|01.##.##.##.##|+34 6## ### ###|0034 6## ### ###|6## ### ###|+39 06 #### ####|+31 6 ########|+41 79 ### ## ##|+46 70 ### ## ##|+91 98### #####|+81 3-####-####|+55 11 9####-####|(0##) ###-####|+48 ### ### ###|9##-####-####|+4930########|+1 (9##) 9##-####"
).split("|")
_PHONES_HELD = "+61 2 #### ####|(0#) #### ####|+32 4## ## ## ##|+353 1 ### ####|+351 9## ### ###|+1.9##.9##.####|(9##)9##-####|9## 9## ####".split("|")
_IDS = (
    "SSN ###-##-####|###-##-####|SSN ### ## ####|SSN: 9##-##-####|NI number %% ## ## ## %|%% ## ## ## %|%%######%|DNI ########%|########%|NIE X#######%|Steuer-ID ## ### ### ###|passport number %#######|passport %########|passport no. %#######|CPF ###.###.###-##|BSN #########|"
    "Aadhaar #### #### ####|PESEL ###########|SIN ### ### ###|personnummer ######-####|social security number 9##-##-####|tax ID ## ### ### ###|Personalausweis %########|national ID #########|driver's license %### #### ####"
).split("|")
_IDS_HELD = "SSN ###.##.####|SSN #########|passport number %%######|DNI ########-%|NI number %%-######-%|NIE Y-#######-%|tax ID ###/###/###|ID card ###-######".split("|")
_NUMBERS = (
    "v#.#.#|#.##.#|9##.9#.#.9|9#.9##.9#.9#|10.0.0.9|127.0.0.1:8080|20##-0#-1#|20##-0#-1#T1#:##:##Z|1#:##:##|#/#/20##|9#####|9#######|order 9#####|ticket 9####|port 9###|#### rows|9#.#### N, 9#.#### E|9#.####, -9#.####|line 9##|9##-9##|pages 9#-9#|$9##.##|€ 9.###,##|9## ms|"
    "9##,### bytes|id=9#######|commit 9a#f##c#|9f##a#c#-##9a-4##c-a#f#-####9##a##f#|sha256:9a##f##c##|ISBN 978-9-##-######-#|#.#e-##|9x9##|HTTP/1.1 4##|error E0###|build 9###.9#|0x9f##a#|1## 2## 3##|timeout=9####|pid 9####|1##_###_###"
).split("|")


# Words of a public tokenizer's vocabulary, filled by ``learn_words``: those written small, and those only written with a capital.
_COMMON: list[str] = []
_PROPER: list[str] = []


def learn_words(ranks: str) -> None:
    """Reads the words of a tokenizer's file of ranks; names and words of the held-out forms are left out."""
    with open(ranks, "rb") as file:
        tokens = {base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in file}
    words = {t[1:] for t in tokens if re.fullmatch(r" [A-Za-z][a-z]{2,10}", t)}
    hidden = {w.lower() for w in (*_GIVEN_HELD, *_FAMILY_HELD, *_STREETS_HELD, *_PLACES_HELD, *_TITLE_A_HELD, *_TITLE_B_HELD, *_WORDS_HELD)}
    names = {w.lower() for w in (*_GIVEN, *_FAMILY)}
    _COMMON[:] = sorted(w for w in words if w.islower() and w not in hidden | names and len(w) > 3)
    _PROPER[:] = sorted(w for w in words if w[0].isupper() and w.lower() not in words | hidden)


def _chained(rng: np.random.Generator, values: list[str]) -> str:
    """A word whose neighbouring letters stand so in one of the values."""
    out = _one(rng, values)[:2]
    for _ in range(int(rng.integers(2, 7))):
        after = [v[k + 2] for v in values for k in range(len(v) - 2) if v[k : k + 2].lower() == out[-2:].lower()]
        if not after:
            break
        out += _one(rng, after)
    return out.capitalize()


def _random_phone(rng: np.random.Generator) -> str:
    mark, size = _one(rng, " -. "), int(rng.integers(8, 11))
    groups: list[str] = []
    while size > 0:
        n = min(size, int(rng.integers(2, 5)))
        n = size if size - n == 1 else n
        groups.append("#" * n)
        size -= n
    if rng.random() < 0.3:
        groups[0] = f"({groups[0]})"
    lead = _one(rng, ("+9", "+9#", "+9##", "+9#", "00 9#"))
    if rng.random() < 0.4:
        return _digits(rng, groups[0].replace("#", "0", 1) + mark + mark.join(groups[1:]))
    return _digits(rng, lead + (mark if rng.random() < 0.8 else "") + mark.join(groups))


def _random_id(rng: np.random.Generator) -> str:
    key = _one(rng, ("SSN", "DNI", "NIE", "NI number", "passport number", "passport no.", "passport", "Steuer-ID", "tax ID", "tax number", "social security number", "social security", "national ID", "ID card", "BSN", "CPF", "identity number", "Personalausweis"))
    groups = ["".join("%" if rng.random() < 0.15 else "#" for _ in range(rng.integers(2, 5))) for _ in range(rng.integers(2, 5))]
    return _digits(rng, key + _one(rng, (" ", " ", " ", ": ")) + ("%" if rng.random() < 0.3 else "") + _one(rng, ("", "-", " ", ".")).join(groups))


_SMALL = "the a of to and in is was by with for who that at on it we they has from as not but or if when my your our his her their this be are were can will said asked wrote".split()


def _one(rng: np.random.Generator, values):
    return values[int(rng.integers(len(values)))]


def _syllabic(rng: np.random.Generator) -> str:
    return "".join(_one(rng, _SYLLABLES) for _ in range(rng.integers(2, 4))).capitalize()


def name(rng: np.random.Generator, held: bool = False) -> str:
    given, family = (_GIVEN_HELD, _FAMILY_HELD) if held else (_GIVEN, _FAMILY)

    def word(listed: list[str]) -> str:
        r = rng.random()
        if held or r < 0.45:
            return _one(rng, listed)
        return _syllabic(rng) if r < 0.55 else _chained(rng, listed) if r < 0.75 or not _PROPER else _one(rng, _PROPER)

    g, f = word(given), word(family)
    f = f.replace("-", " ") if rng.random() < 0.7 else f
    r = rng.random()
    initial = _one(rng, "ABCDEFGHJKLMNPRSTW")
    out = f"{g} {f}" if r < 0.62 else f"{g} {initial}. {f}" if r < 0.74 else f"{initial}. {f}" if r < 0.84 else f"{f}, {g}" if r < 0.92 else f"{g} {f}-{_one(rng, family).split('-')[-1]}"
    r = rng.random()
    return out.upper() if r < 0.05 else out.lower() if r < 0.08 and "." not in out else out


def email(rng: np.random.Generator, held: bool = False) -> str:
    plain = lambda s: re.sub(r"[^a-z]", "", s.lower()) or "kim"
    g, f = plain(_one(rng, _GIVEN_HELD if held else _GIVEN)), plain(_one(rng, _FAMILY_HELD if held else _FAMILY))
    local = _one(rng, (g, f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}", f"{g}{rng.integers(1, 99)}", f"{g[0]}.{f}", _one(rng, _ROLES), f"{f}.{g}", f"{g}+{_one(rng, _WORDS)}", f"{g}-{f}"))
    word = _one(rng, _WORDS_HELD if held else _WORDS)
    domain = word if rng.random() < 0.6 else f"{_one(rng, ('mail', 'my', 'eu', 'corp'))}.{word}" if rng.random() < 0.5 else f"{word}-{_one(rng, _WORDS_HELD if held else _WORDS)}"
    at = "@" if held or rng.random() < 0.88 else _one(rng, (" [at] ", " (at) ", " @ ", "%40"))
    out = f"{local}{at}{domain}.{_one(rng, _TOPS_HELD if held else _TOPS)}"
    return out.upper() if rng.random() < 0.03 else out.title() if rng.random() < 0.03 else out


def address(rng: np.random.Generator, held: bool = False) -> str:
    street, place = _one(rng, _STREETS_HELD if held else _STREETS), _one(rng, _PLACES_HELD if held else _PLACES)
    if _COMMON and not held:
        street = _one(rng, _COMMON if rng.random() < 0.6 else _PROPER).capitalize() if rng.random() < 0.6 else street
        place = _one(rng, _PROPER) if rng.random() < 0.6 else place
    n = str(rng.integers(1, 2000)) + (_one(rng, "abc") if rng.random() < 0.08 else "")
    last = _one(rng, _FAMILY_HELD if held else _FAMILY).split("-")[-1]
    flat = _one(rng, ("", "", "", f", Apt {rng.integers(1, 60)}{_one(rng, 'ABC')}", f", Suite {rng.integers(100, 999)}", f" #{rng.integers(1, 40)}"))
    after = _one(rng, ("", "", f" {_digits(rng, '9####')}", f", {_one(rng, ('CA', 'NY', 'TX', 'IL', 'OR', 'MA', 'WA'))} {_digits(rng, '9####')}", f" {_digits(rng, '%%9 9%%')}"))
    r = rng.random()
    if r < 0.55:
        return f"{n} {street} {_one(rng, _KINDS)}{flat}, {place}{after}"
    zip_ = _digits(rng, "9####")
    if r < 0.68:
        return f"{_one(rng, (street, last))}{_one(rng, ('straße', 'strasse', 'weg', 'platz', 'allee', 'gasse'))} {n}, {zip_} {place}"
    if r < 0.78:
        return f"{n} {_one(rng, ('rue', 'avenue', 'boulevard', 'place'))} {_one(rng, ('de la ', 'du ', 'de ', 'des ', ''))}{street}, {zip_} {place}"
    if r < 0.88:
        return f"{_one(rng, ('Calle', 'Avenida', 'Plaza', 'Calle de', 'Via', 'Rua', 'Viale'))} {last} {n}, {zip_ if rng.random() < 0.7 else ''} {place}".replace("  ", " ")
    if r < 0.94:
        return f"{street}{_one(rng, ('straat', 'gatan', 'vej', 'laan'))} {n}, {_digits(rng, '9### %%') if rng.random() < 0.5 else zip_} {place}"
    return f"{n} {street} {_one(rng, _KINDS)}, {place}, {_one(rng, ('UK', 'USA', 'Canada', 'Ireland', 'Australia'))}"


def nothing(rng: np.random.Generator, held: bool = False) -> str:
    """What looks like personal information and is none."""
    a, b = (_TITLE_A_HELD, _TITLE_B_HELD) if held else (_TITLE_A, _TITLE_B)
    r, word = rng.random(), _one(rng, _WORDS)
    if r < 0.5:
        if _COMMON and not held and rng.random() < 0.75:
            return " ".join(_one(rng, _COMMON).capitalize() for _ in range(int(rng.integers(2, 4))))
        return f"{_one(rng, a)} {_one(rng, b)}" + (f" {_one(rng, b)}" if rng.random() < 0.2 else "")
    if r < 0.8:
        return _digits(rng, _one(rng, _NUMBERS))
    return _one(rng, (
        f"git@{word}.com:{_one(rng, _WORDS)}/{word}.git", f"@{word}/{_one(rng, _WORDS)}@{_digits(rng, '9.#.#')}", f"{word}@{_digits(rng, '9.##.#')}", f"https://{word}.com/{_one(rng, _WORDS)}?id={rng.integers(1000)}", f"src/{word}/{_one(rng, _WORDS)}.py",
        f"{word.title()}Service", f"{word}_{_one(rng, _WORDS)}", f"@{word}", f"{_one(rng, _PLACES)}", f"{_one(rng, _GIVEN)}", f"{_one(rng, _STREETS)} {_one(rng, _TITLE_B)}", f"{word}.{_one(rng, _WORDS)}()", f"{_one(rng, _STREETS)} {_one(rng, _KINDS)}", f"#{rng.integers(1, 9999)}",
    ))


def _worded(rng: np.random.Generator) -> str:
    """A sentence of any words round one or two slots, so that what stands beside them is not learnt by heart."""

    def some(most: int) -> str:
        words = [_one(rng, _COMMON) if rng.random() < 0.6 else _one(rng, _SMALL) for _ in range(rng.integers(0, most))]
        return " ".join(words)

    first = some(6)
    if first and rng.random() < 0.8:
        first = first[0].upper() + first[1:]
    out = first + (_one(rng, (" ", " ", " ", ", ", ": ", " (", " - ", "; ", "\n", ' "', "=", " <")) if first else "")
    for k in range(1 + int(rng.random() < 0.35)):
        out += _one(rng, ("{N}", "{N}", "{N}", "{N}", "{X}", "{X}", "{X}", "{E}", "{P}", "{I}", "{A}")) if not k else f"{some(5)} ".lstrip() + _one(rng, ("{N}", "{N}", "{X}", "{P}", "{A}"))
        out += _one(rng, (" ", " ", " ", ", ", ". ", "? ", ") ", "'s ", "; ", "\n", '" ', "> ", "! "))
    last = some(6)
    return out + (last[:1].upper() + last[1:] if last and out.rstrip()[-1:] in ".!?" and rng.random() < 0.8 else last) + (_one(rng, (".", ".", "", "?", "!")) if last else "")


def phrase(rng: np.random.Generator, held: bool = False) -> tuple[str, list[tuple[int, int, int]]]:
    """A made sentence and its spans (start, end, place in ``TYPES``)."""
    make = {
        "N": (4, lambda: name(rng, held)), "E": (0, lambda: email(rng, held)), "A": (3, lambda: address(rng, held)), "P": (1, lambda: _random_phone(rng) if not held and rng.random() < 0.4 else _digits(rng, _one(rng, _PHONES_HELD if held else _PHONES))),
        "I": (2, lambda: _random_id(rng) if not held and rng.random() < 0.35 else _digits(rng, _one(rng, _IDS_HELD if held else _IDS))), "X": (None, lambda: nothing(rng, held)),
    }
    out, spans = "", []
    sentence = _one(rng, _SENTENCES_HELD if held else _SENTENCES)
    if _COMMON and not held and rng.random() < 0.65:
        sentence = _worded(rng)
    for part in re.split(r"(\{[A-Z]\})", sentence):
        if re.fullmatch(r"\{[A-Z]\}", part):
            kind, value = make[part[1]]
            text = value()
            if kind is not None:
                spans.append((len(out), len(out) + len(text), kind))
            out += text
        else:
            out += part
    return out, spans


def made(rng: np.random.Generator, carrier: str = "", held: bool = False) -> tuple[str, list[tuple[int, int, int]]]:
    """A text of one to four made sentences, set into ``carrier`` (a text without personal information) at white space."""
    places = sorted(rng.choice([m.end() for m in re.finditer(r"\s+|^|$", carrier)], rng.integers(1, 5)).tolist())
    out, spans, at = "", [], 0
    for p in places:
        out += carrier[at:p]
        text, found = phrase(rng, held)
        if out and not out[-1].isspace():
            out += " "
        spans += [(s + len(out), e + len(out), k) for s, e, k in found]
        out += text + _one(rng, (" ", " ", "\n"))
        at = p
    return out + carrier[at:], spans
