"""Labelled spans for training the tagger of :mod:`threadloom.llm.pii`.

Training rows carry no human labels, so spans are labelled by the patterns below (one alternative for each notation seen
in the training rows).  They are used by ``pii_train`` only to make labels and to measure held-out agreement; the operator
itself finds spans with the trained tagger.
"""

from __future__ import annotations

import re

TYPES = ("email", "phone", "id_number", "street_address", "person_name")

_DOMAIN = r"[A-Za-z][\w-]*(?:(?:\.| \(dot\) )[A-Za-z][\w-]*)+"
EMAIL = re.compile(rf"(?<![\w@/.+%-])[A-Za-z0-9][\w.+-]*(?:@| @ | \[at\] | \(at\) |%40){_DOMAIN}(?![\w@]|:\w)", re.I)

PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+(?=(?:\d ?){9,14}(?!\d))\d{1,3}(?: ?\d{1,5}){2,6}|0034(?: \d{3}){3}|\(\d{3}\) \d{3}-\d{4}|1-\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}"
    r"|0\d{2} \d{4} \d{4}|0\d{2}/\d{5}-\d{3}|0\d(?: \d\d){4})(?![\w/-]|\.\d)"
)
ID = re.compile(
    r"(?<![\w.+/-])(?:(?:SSN )?\d{3}-\d{2}-\d{4}|(?:SSN )?\d{3} \d{2} \d{4}|(?:NI number )?QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|(?:DNI )?\d{8}[A-Z]|(?:Steuer-ID )?\d{2} \d{3} \d{3} \d{3}|(?:passport number )?X\d{7})(?![\w/-]|\.\d)"
)
_N = r"[A-ZÄÖÜ][a-zäöüß]+"
_CITY = rf"(?:\d{{5}} )?{_N}(?:[ -][A-ZÄÖÜ][a-zäöü]+)?(?: \d{{5}}(?!\d))?"
ADDRESS = re.compile(
    r"(?<![\w.-])(?:"
    rf"\d+[a-z]? {_N} (?:Street|St\.|Avenue|Ave\.?|Road|Rd\.?|Lane|Drive|Court|Blvd\.?)(?:, Apt \d+[A-Z]?)?, {_CITY}"
    rf"|\d+(?: bis)? rue du {_N}, {_CITY}|Calle de {_N} \d+(?:, \d\.º [A-Z])?, {_CITY}"
    rf"|{_N}(?:straße|weg) \d+[a-z]?, {_CITY})"
)

# Names of the training rows, and the syllables that its family names are made of.
GIVEN = (
    "Linnea Orin Gideon Selka Ivo Tamsin Mira Yorick Emric Wim Halla Nadja Vesna Fenna Petra Ulla Rhea Jessa Corin Tobin Maro "
    "Xenia Andor Soren Zelda Kaspar Yvaine Dalia Quill Ana-Lou"
).split()
STEMS = "Mard Halv Korp Zann Achter Osk Pell Bren Dross Nuri Ilv Sil Strand Tarv Vell Wrob Ekwe Quen".split()
ENDS = "akova otti imba ison ersby elund amoto enfeld urski aquez anwe otova".split()
OTHER_FAMILIES = ["Szöldér", "van der Mosk", "de Larrouval", "al-Qeshmi", "O'Tarrigan"]

_FAMILY = rf"(?:(?:{'|'.join(STEMS)})(?:{'|'.join(ENDS)})|{'|'.join(OTHER_FAMILIES)}|O’Tarrigan)"
_GIVEN = rf"(?:{'|'.join(GIVEN)})"
NAME = re.compile(
    rf"(?<![\w.-])(?:(?:{_GIVEN}|[A-Z]\.)(?:[ -][A-Z]\.)? {_FAMILY}|{_FAMILY}, (?:{_GIVEN}|[A-Z]\.))(?![\w@-])"
    rf"|(?<=_)(?:(?:{_GIVEN}|[A-Z]\.)(?:[ -][A-Z]\.)? {_FAMILY}|{_FAMILY}, (?:{_GIVEN}|[A-Z]\.))(?=_)",
    re.I,
)


def _underscored(pattern: re.Pattern, text: str):
    """Spans of ``pattern``; a pair of underscores set round a value as emphasis is not part of it."""
    flat = re.sub(r"(?<!\w)_(?=\S)|(?<=\S)_(?!\w)", " ", text)
    return pattern.finditer(flat)


def label(text: str) -> list[tuple[int, int, int]]:
    """(start, end, type index) of every labelled span, without overlaps; e-mails and addresses win over names."""
    spans: list[tuple[int, int, int]] = []
    text = re.sub(r"\\[nrt]", "  ", text)  # an escape within JSON text ends a word; the length stays
    for k, pattern in enumerate((EMAIL, PHONE, ID, ADDRESS, NAME)):
        for m in _underscored(pattern, text):
            s, e = m.span()
            if k == 0 and re.match(r"git(@| @ )", m.group(0)):
                continue
            if all(e <= a or s >= b for a, b, _ in spans):
                spans.append((s, e, k))
    return sorted(spans)
