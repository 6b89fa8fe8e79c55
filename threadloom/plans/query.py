"""The query language: a lenient parser to a small boolean tree, simplified and compiled to column expressions.

Bare words and phrases, ``field:``, AND / OR / NOT, ``+`` / ``-``, parentheses, ``"…"~n`` and ``"…"*``, wildcards, ``<regex>`` and
``/regex/`` over whole terms, ``[a TO b]`` / ``{a TO b}``, ``IN [a b]``, ``*``, ``field:*`` (ignored), ``^boost``, and the modifiers
``all:`` / ``visible:`` / ``hidden:``.  Parsing never fails: what cannot be read is noted in ``diagnostics`` and left out.

A document is a row with one column ``norm_<field>`` for each text field (see ``functions.text.normal_form``), an array
``paths_<field>`` for each path field, and ``modified_ts``.  Terms and phrases then are substring searches in code generated by the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_FIELDS = ("content", "user", "agent", "toolcall", "toolresult")
PATH_FIELDS = ("dirs", "files", "paths")
FIELDS = (*TEXT_FIELDS, *PATH_FIELDS, "working_dir", "modified_ts")
ALIASES = {"wd": "working_dir"}
MODES = ("all", "visible", "hidden")


@dataclass(frozen=True)
class Leaf:
    """kind: term, phrase, regex, path, literal, range, set."""

    kind: str
    field: str
    values: tuple = ()
    slop: int = 0
    prefix: bool = False
    low_open: bool = False
    high_open: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class Bool:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    boost: float = 1.0


ALL, NONE = Bool(must_not=()), None  # an empty clause is true of every document; None stands for "no clause"


@dataclass
class Query:
    text: str
    mode: str | None
    tree: object
    diagnostics: list[str] = field(default_factory=list)
    certain: bool = True
    bare: bool = False
    error: str | None = None  # the one thing that a search refuses: visibility modifiers that conflict


def analyze(text: str) -> list[str]:
    """The analyzer of ``functions.text``, for query text."""
    return [t.lower() if len(t.encode()) < 40 else "\u0001" for t in re.findall(r"[^\W_]+", text)]


def extract_mode(text: str) -> tuple[str, str | None, str | None]:
    """(text without modifiers, mode, error): modifiers are whole unquoted tokens between white space and parentheses."""
    modes: list[str] = []

    def take(m: re.Match) -> str:
        if m.group(1) is None:
            return m.group(0)
        modes.append(m.group(1).lower())
        return " "

    out = re.sub(r'"(?:\\.|[^"\\])*"?|(?<![^\s()])(all|visible|hidden):(?![^\s()])', take, text, flags=re.I)
    if len(set(modes)) > 1:
        return out.strip(), None, "conflicting visibility modifiers"
    return (out.strip(), modes[0], None) if modes else (text, None, None)


_TOKEN = re.compile(
    r"""\s*(?:
      (?P<open>\()|(?P<close>\))
    | (?P<phrase>"(?:\\.|[^"\\])*")(?:~(?P<slop>\d+)|(?P<star>\*))?
    | (?P<range>(?P<lo>[\[{])\s*(?P<a>\S+)\s+TO\s+(?P<b>[^\s\]}]+)\s*(?P<hi>[\]}]))
    | (?P<set>IN\s*\[(?P<items>[^\]]*)\])
    | (?P<angle><(?:\\.|[^\\>])*>)(?=[\s)^]|$)
    | (?P<slash>/(?:\\.|[^\\/])+/)(?=[\s)^]|$)
    | (?P<field>[A-Za-z_]+):
    | (?P<boost>\^(?P<factor>\d+(?:\.\d+)?))
    | (?P<sign>[+-])(?=\S)
    | (?P<word>(?:\\.|[^\s()"^\\])+)
    | (?P<junk>.)
    )""",
    re.X,
)


class _Parser:
    def __init__(self, text: str, defaults: tuple[str, ...]):
        self.defaults, self.diagnostics, self.certain, self.items, at = defaults, [], True, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None or m.end() == at:
                break
            kind = m.lastgroup if m.lastgroup in ("open", "close", "field", "sign", "word", "junk") else next((k for k in ("phrase", "range", "set", "angle", "slash", "boost") if m.group(k)), None)
            if kind:
                self.items.append((kind, m))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def _is(self, word: str) -> bool:
        p = self.peek()
        return p is not None and p[0] == "word" and p[1].group("word") == word

    def parse(self, fields: tuple[str, ...] | None = None, inner: bool = False):
        """OR of ANDs; juxtaposition is AND."""
        groups, current = [], []
        while (p := self.peek()) is not None:
            if p[0] == "close":
                self.at += 1
                if inner:
                    break
                self.diagnostics.append("unmatched )")
                continue
            if self._is("OR") or self._is("||"):
                self.at += 1
                groups.append(current)
                current = []
                continue
            if self._is("AND") or self._is("&&"):
                self.at += 1
                continue
            sign, node = self.unary(fields)
            if node is not NONE:
                current.append((sign, node))
        groups.append(current)
        parts = [self.group(g) for g in groups if g]
        if not parts:
            return NONE
        return parts[0] if len(parts) == 1 else Bool(should=tuple(parts))

    @staticmethod
    def group(items: list):
        if len(items) == 1 and items[0][0] != "-":
            return items[0][1]
        return Bool(must=tuple(n for s, n in items if s != "-"), must_not=tuple(n for s, n in items if s == "-"))

    def unary(self, fields):
        sign = ""
        while True:
            if self._is("NOT"):
                self.at += 1
                sign = "" if sign == "-" else "-"
            elif (p := self.peek()) is not None and p[0] == "sign":
                self.at += 1
                sign = p[1].group("sign")
            else:
                break
        node = self.primary(fields)
        while (p := self.peek()) is not None and p[0] == "boost":
            self.at += 1
            if node is not NONE:
                node = replace(node, boost=node.boost * float(p[1].group("factor")))
        return sign, node

    def primary(self, fields):
        p = self.peek()
        if p is None:
            return NONE
        self.at += 1
        kind, m = p
        if kind == "field":
            name = ALIASES.get(m.group("field").lower(), m.group("field").lower())
            if name not in FIELDS:
                self.diagnostics.append(f"unknown field {name}")
                following = self.peek()
                if following is not None and following[0] == "word" and following[1].start("word") == m.end():
                    self.at += 1
                    return self.over(None, lambda f: self.phrase(f, f"{m.group('field')} {following[1].group('word')}"))
                return self.over(None, lambda f: self.phrase(f, m.group("field")))
            following = self.peek()
            if following is None:
                self.diagnostics.append(f"nothing after {name}:")
                return NONE
            return self.primary((name,))
        if kind == "open":
            return self.parse(fields, inner=True)
        if kind == "phrase":
            value = re.sub(r"\\(.)", r"\1", m.group("phrase")[1:-1])
            slop, star = int(m.group("slop") or 0), bool(m.group("star"))
            return self.over(fields, lambda f: self.phrase(f, value, slop, star, quoted=True))
        if kind == "range":
            return self.over(fields, lambda f: self.range(f, m))
        if kind == "set":
            return self.over(fields, lambda f: Leaf("set", f, tuple(t for x in m.group("items").split() for t in analyze(x))))
        if kind in ("angle", "slash"):
            raw = m.group(kind)[1:-1]
            pattern = re.sub(r"\\([<>/])", r"\1", raw)
            if _unsafe(pattern):
                self.diagnostics.append(f"unsupported regex {pattern}")
                return self.over(fields, lambda f: self.phrase(f, raw))
            return self.over(fields, lambda f: Leaf("regex", f, (pattern,)))
        if kind == "word":
            word = m.group("word")
            if word == "*":
                if fields:  # field:* is an empty clause
                    return NONE
                return ALL
            if re.search(r"(?<!\\)(?:\\\\)*\*", word) and (fields is None or fields[0] not in (*PATH_FIELDS, "working_dir")):
                return self.over(fields, lambda f: Leaf("regex", f, (_wildcard(word),)))
            return self.over(fields, lambda f: self.phrase(f, re.sub(r"\\(.)", r"\1", word)))
        if kind == "close" or kind == "sign":
            self.diagnostics.append("misplaced " + m.group(0).strip())
        elif kind == "junk":
            self.diagnostics.append("ignored " + m.group(0).strip())
        return NONE

    def over(self, fields, make):
        leaves = [x for f in (fields or self.defaults) if (x := make(f)) is not NONE]
        return NONE if not leaves else leaves[0] if len(leaves) == 1 else Bool(should=tuple(leaves))

    def phrase(self, name: str, value: str, slop: int = 0, prefix: bool = False, quoted: bool = False):
        if name == "working_dir":
            return Leaf("literal", name, (value.lower(),))
        if name in PATH_FIELDS:
            return Leaf("path", name, (value.replace("\\", "/").rstrip("/").lower(),))
        if name == "modified_ts":
            return Leaf("range", name, (value, value))
        terms = tuple(analyze(value))
        if not terms:
            return NONE
        if len(terms) == 1:
            return Leaf("term", name, terms)
        if slop and len(terms) > 2:
            self.certain = False
        return Leaf("phrase", name, terms, slop=slop, prefix=prefix)

    def range(self, name: str, m: re.Match):
        def bound(text: str):
            if text == "*":
                return None
            if name == "modified_ts":
                return text
            terms = analyze(text)
            return terms[0] if len(terms) == 1 else None

        return Leaf("range", name, (bound(m.group("a")), bound(m.group("b"))), low_open=m.group("lo") == "{", high_open=m.group("hi") == "}")


def _unsafe(pattern: str) -> bool:
    """Look-around, back references, anchors and broken patterns are no regular expressions over whole terms."""
    if re.search(r"\(\?[=!<]|\\[1-9]|\\[bBAzZ]|(?<!\\)(?:\\\\)*[\^$](?![^\[]*\])", pattern):
        return True
    try:
        re.compile(pattern)
    except re.error:
        return True
    return False


def _wildcard(word: str) -> str:
    out, k = [], 0
    while k < len(word):
        if word[k] == "\\" and k + 1 < len(word):
            out.append(re.escape(word[k + 1].lower()))
            k += 2
            continue
        out.append(".*" if word[k] == "*" else re.escape("".join(c.lower() for c in word[k])))
        k += 1
    return "".join(out)


def parse(text: str, defaults: tuple[str, ...] | Callable[[str | None], tuple[str, ...]] = ("content",)) -> Query:
    """``defaults``: the fields of words without a prefix, or a function that gives them for the query's visibility mode (None: none named)."""
    rest, mode, error = extract_mode(text)
    p = _Parser(rest, defaults(mode) if callable(defaults) else defaults)
    tree = p.parse()
    bare = bool(re.fullmatch(r"[^\W_]+(?:\s+[^\W_]+)+", rest.strip())) and not re.search(r"\b(?:AND|OR|NOT|IN|TO)\b", rest)
    return Query(rest, mode, ALL if tree is NONE else tree, ([error] if error else []) + p.diagnostics, p.certain, bare, error)


def fold(tree):
    """True, False, or the tree with constant parts folded away."""
    if isinstance(tree, Leaf):
        return False if tree.kind == "set" and not tree.values else tree
    must, should, must_not = [fold(x) for x in tree.must], [fold(x) for x in tree.should], [fold(x) for x in tree.must_not]
    if any(x is False for x in must) or any(x is True for x in must_not):
        return False
    must, must_not = [x for x in must if x is not True], [x for x in must_not if x is not False]
    if should and not tree.must:
        if any(x is True for x in should):
            should = []
        else:
            should = [x for x in should if x is not False]
            if not should:
                return False
    if not must and not should and not must_not:
        return True
    return replace(tree, must=tuple(must), should=tuple(x for x in should if x is not True), must_not=tuple(must_not))


def _q(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}&#~<>-])", r"\\\1", text)


def leaf_condition(leaf: Leaf) -> Column:
    if leaf.field == "modified_ts":
        low, high = leaf.values
        c, ts = F.lit(True), F.col("modified_ts")
        if low is not None and str(low).lstrip("-").isdigit():
            c = c & (ts > int(low) if leaf.low_open else ts >= int(low))
        if high is not None and str(high).lstrip("-").isdigit():
            c = c & (ts < int(high) if leaf.high_open else ts <= int(high))
        return F.coalesce(c, F.lit(False))
    if leaf.kind == "literal":
        return F.coalesce(F.lower("working_dir").contains(leaf.values[0]), F.lit(False))
    if leaf.kind == "path":
        return F.exists(F.col(f"paths_{leaf.field}"), lambda p: F.concat(F.lit("/"), F.lower(p)).contains("/" + leaf.values[0].lstrip("/")))
    norm = F.col(f"norm_{leaf.field}")
    if leaf.kind == "term":
        return norm.contains(f" {leaf.values[0]} ")
    if leaf.kind == "set":
        out = F.lit(False)
        for v in leaf.values:
            out = out | norm.contains(f" {v} ")
        return out
    if leaf.kind == "phrase":
        if leaf.slop == 0:
            return norm.contains(f" {' '.join(leaf.values)}" + ("" if leaf.prefix else " "))
        n, terms = leaf.slop, [_q(t) for t in leaf.values]
        forward = rf" {terms[0]} " + "".join(rf"(?:\S+ ){{0,{n}}}{t} " for t in terms[1:])
        if len(terms) == 2 and n >= 2:  # the second word before the first: |Δ| counts the turn too
            return norm.rlike(forward) | norm.rlike(rf" {terms[1]} (?:\S+ ){{0,{n - 2}}}{terms[0]} ")
        return norm.rlike(forward)
    terms = F.filter(F.split(norm, " "), lambda t: (t != "") & (t != "\u0001"))
    return F.exists(terms, word_condition(leaf))


def word_condition(leaf: Leaf) -> Callable[[Column], Column]:
    """The condition of a term, set, regex or range on one indexed word."""
    if leaf.kind in ("term", "set"):
        return lambda t: t.isin(*leaf.values)
    if leaf.kind == "regex":
        return lambda t: t.rlike(rf"^(?:{leaf.values[0]})$")
    low, high = leaf.values

    def inside(t: Column) -> Column:
        c = F.lit(True)
        if low is not None:
            c = c & (t > low if leaf.low_open else t >= low)
        if high is not None:
            c = c & (t < high if leaf.high_open else t <= high)
        return c

    return inside


def condition(tree, on: Callable[[Leaf], Column] = leaf_condition) -> Column:
    """The matching condition of a folded tree; ``on``: that of a leaf."""
    if isinstance(tree, bool):
        return F.lit(tree)
    if isinstance(tree, Leaf):
        return on(tree)
    out = None
    for x in tree.must:
        out = condition(x, on) if out is None else out & condition(x, on)
    if not tree.must and tree.should:
        for x in tree.should:
            out = condition(x, on) if out is None else out | condition(x, on)
    for x in tree.must_not:
        out = ~condition(x, on) if out is None else out & ~condition(x, on)
    return F.lit(True) if out is None else out


def every_leaf(tree) -> list[Leaf]:
    """Leaves of all clauses, excluding ones too, each once."""
    if isinstance(tree, bool):
        return []
    if isinstance(tree, Leaf):
        return [tree]
    return list(dict.fromkeys(x for part in (tree.must, tree.should, tree.must_not) for n in part for x in every_leaf(n)))


def leaves(tree, positive: bool = True) -> list[Leaf]:
    """Leaves of the positive clauses, in order."""
    if isinstance(tree, bool):
        return []
    if isinstance(tree, Leaf):
        return [tree] if positive else []
    return [x for part in (tree.must, tree.should) for n in part for x in leaves(n, positive)]


def highlight_terms(text: str) -> list[str]:
    """Words to be marked in a snippet: without quotes, operators, field prefixes and wildcards, each once."""
    plain = re.sub(r"(?i)\b(?:" + "|".join((*FIELDS, *ALIASES)) + r"):", " ", extract_mode(text)[0])
    out: list[str] = []
    for w in re.findall(r"[^\W_]+", re.sub(r"(?<!\S)(?:AND|OR|NOT|IN|TO)(?!\S)|(?<!\S)-\S+", " ", plain)):
        if w.lower() not in out:
            out.append(w.lower())
    return out
