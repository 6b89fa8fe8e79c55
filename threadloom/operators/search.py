"""Search over a table of documents: matching, metadata filters, scope, ranking, limits and snippets.

A document row has a key, text fields, path fields and catalog columns; ``indexed`` adds the analyzed forms.  The relevance order is the
exact global order of score times recency, not a re-rank of the pages fetched.  Statistics for BM25 are one row (documents, average
lengths, document frequencies of the query's terms), computed with partial aggregation; so a search is two scans
and a top-k without a shuffle of documents.  The postings form of the index answers the same queries by semi joins on terms.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, date, datetime, time, tzinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import GAP, LONG_TOKEN_BYTES, compact, normal_path, path_suffixes, raw_form, token_count, with_gaps, words
from threadloom.plans import query as ql
from threadloom.util import dealt

K1, B = 1.2, 0.75
#: Rows by output: None is no limit.
LIMITS = {"json": 20, "screen": 2_000, "markdown": 2_000, "zip": None}
PHRASE_BOOST = 5.0
WEEK = 604_800.0
SNIPPET, LEAD = 240, 60


@dataclass
class Filters:
    agent: str | None = None
    session_id: str | None = None
    branch: str | None = None
    after: int | None = None
    before: int | None = None
    min_lines: int | None = None
    include_sub_agents: bool = False
    derivations: tuple[str, ...] | None = None
    live_only: bool = False
    trashed: bool | None = False  # None: either
    superseded: bool | None = False

    def active(self) -> int:
        """Number of filters that differ from the default."""
        d = Filters()
        return sum(getattr(self, k) != getattr(d, k) for k in self.__dataclass_fields__)

    def merged(self, explicit: dict) -> Filters:
        """Saved defaults with explicit flags over them."""
        return Filters(**{**self.__dict__, **{k: v for k, v in explicit.items() if v is not None}})


@dataclass
class Request:
    query: str = ""
    filters: Filters = field(default_factory=Filters)
    scope: str | None = None  # a directory; None: everywhere
    case_sensitive_scope: bool = False
    sort: str = "time"
    limit: int = 20
    now: int = 0
    mode: str = "all"  # visibility of bare words where the query names none


def parse_date(raw: str, end_of_day: bool, zone: tzinfo = UTC) -> int:
    """Epoch seconds of an RFC 3339 time or a local day."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", raw):
        local = datetime.combine(date.fromisoformat(raw), time(23, 59, 59) if end_of_day else time(), zone)
        if local.astimezone(UTC).astimezone(zone).replace(tzinfo=None) != local.replace(tzinfo=None):
            raise ValueError(f"no such local time: {raw}")
        return int(local.timestamp())
    at = datetime.fromisoformat(raw.replace("Z", "+00:00"))
    if at.tzinfo is None:
        raise ValueError(f"a time needs its zone: {raw}")
    return int(at.timestamp())


def parse_dir(raw: str, branch: str | None = None) -> tuple[str, str | None]:
    """PATH[:BRANCH], split at the last colon that is no drive letter's."""
    head, colon, tail = raw.rpartition(":")
    if not colon or len(head) <= 1 or "/" in tail and not head:
        return raw, branch
    if branch is not None:
        raise ValueError("the branch is given twice")
    return head, tail


def indexed(documents: DataFrame, text_fields: dict[str, str], path_fields: dict[str, str] | None = None) -> DataFrame:
    """Adds ``norm_<field>`` and ``len_<field>`` for text columns and ``paths_<field>`` for columns with arrays of paths."""
    # Generated columns are evaluated once: conditions on them cannot be pushed below, where each would analyze the text again.
    once = lambda df, forms: df.select("*", F.inline(F.array(F.struct(*forms))))
    out = once(documents, [raw_form(F.coalesce(F.col(c), F.lit(""))).alias(f"__raw_{n}") for n, c in text_fields.items()])
    out = once(out, [with_gaps(F.col(f"__raw_{n}"), F.col(c)).alias(f"norm_{n}") for n, c in text_fields.items()]).drop(*[f"__raw_{n}" for n in text_fields])
    for name in text_fields:
        out = out.withColumn(f"len_{name}", token_count(F.col(f"norm_{name}")))
    for name, column in (path_fields or {}).items():
        out = out.withColumn(f"paths_{name}", F.array_distinct(F.flatten(F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), path_suffixes))))
    return out


def matching(documents: DataFrame, text: str, defaults: tuple[str, ...] = ("content",)) -> DataFrame:
    return documents.where(ql.condition(ql.fold(ql.parse(text, defaults).tree)))


# Fields of words without a prefix, by visibility: ``visible`` and ``hidden`` stand for the content that is shown and the content that is not.
MODES = {"all": ("content",), "visible": ("_visible",), "hidden": ("_hidden",)}


def parsed(text: str, mode: str = "all", modes: dict[str, tuple[str, ...]] | None = None) -> ql.Query:
    """The query, its bare words over the fields of its visibility mode (``mode`` where it names none); conflicting modes are an error."""
    q = ql.parse(text, lambda named: (modes or MODES)[named or mode])
    if q.error:
        raise ValueError(q.error)
    return q


def sessions_matching(parts: DataFrame, key: str, text: str, mode: str = "visible") -> DataFrame:
    """Keys whose parts together match.  parts: key, the analyzed fields (``indexed``), and ``shown``: whether the part is visible.

    Each part is tested for every leaf alone and the outcomes are joined by ``bool_or``, so the text of a session is never put together and a
    session of any length is tested by many tasks.  Words with a field prefix are not limited by visibility.  Phrases lie within one part.
    """
    tree = ql.fold(parsed(text, mode).tree)
    leaves = ql.every_leaf(tree)
    if not leaves:
        return parts.select(key).distinct() if tree is True else parts.select(key).limit(0)

    def on_part(leaf: ql.Leaf) -> Column:
        if leaf.field not in ("_visible", "_hidden"):
            return ql.leaf_condition(leaf)
        return ql.leaf_condition(replace(leaf, field="content")) & (F.col("shown") if leaf.field == "_visible" else ~F.col("shown"))

    flags = parts.groupBy(key).agg(*[F.bool_or(on_part(leaf)).alias(f"__{k}") for k, leaf in enumerate(leaves)])
    return flags.where(ql.condition(tree, lambda leaf: F.coalesce(F.col(f"__{leaves.index(leaf)}"), F.lit(False)))).select(key)


def matches_document(documents: DataFrame, text: str, key: str, value: object) -> DataFrame:
    """The document with the key if it matches, else none."""
    return matching(documents.where(F.col(key) == value), text).limit(1)


def find(documents: DataFrame, expression: str, key: str = "doc_id", column: str = "text", regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(key, nth, start, end): byte ranges of a text's occurrences of an expression, literal or regular, as a reader looks through one text.

    A leading ``(?j)`` or ``(?-j)`` (whether to jump to the first hit) is no part of the expression, unless a back slash stands before it.
    Nothing to look for, and matches of no length, give no rows; an expression that is none is an error.
    """
    rest = expression
    while m := re.match(r"\(\?-?j\)", rest):
        rest = rest[m.end() :]
    rest = rest[1:] if re.match(r"\\\(\?-?j\)", rest) else rest
    if not rest:
        return documents.where(F.lit(False)).select(key, F.lit(0).alias("nth"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    if regex:
        re.compile(rest)
    pattern = ("" if case_sensitive else "(?iu)") + (rest if regex else ql._q(rest))
    between, held = F.split(column, pattern, -1), F.regexp_extract_all(column, F.lit(f"({pattern})"), 1)
    sizes = F.transform(F.arrays_zip(between.alias("b"), held.alias("h")), lambda x: F.struct(F.octet_length(x["b"]).alias("b"), F.octet_length(x["h"]).alias("h")))
    kind = "struct<at:int,out:array<struct<start:int,end:int>>>"
    step = lambda a, x: F.struct((a["at"] + x["b"] + F.coalesce(x["h"], F.lit(0))).alias("at"), F.when(x["h"] > 0, F.array_append(a["out"], F.struct((a["at"] + x["b"]).alias("start"), (a["at"] + x["b"] + x["h"]).alias("end")))).otherwise(a["out"]).alias("out"))
    ranges = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind), step, lambda a: a["out"])
    return documents.select(key, F.posexplode(ranges).alias("nth", "r")).select(key, "nth", "r.start", "r.end")


def filter_condition(f: Filters, columns: list[str], live: Column | None = None) -> Column:
    """Metadata filters; a filter on a column the table lacks is an error of the caller, defaults on lacking columns hold."""
    c = F.lit(True)
    if f.agent is not None:
        c = c & (F.col("agent") == f.agent)
    if f.session_id is not None:
        c = c & (F.col("session_id") == f.session_id)
    if f.branch is not None:
        c = c & F.coalesce(F.col("branch") == f.branch, F.lit(False))
    if f.after is not None:
        c = c & (F.col("modified_ts") >= f.after)
    if f.before is not None:
        c = c & (F.col("modified_ts") <= f.before)
    if f.min_lines is not None:
        c = c & (F.col("lines") >= f.min_lines)
    if f.derivations is not None:
        c = c & F.col("derivation_type").isin(*f.derivations)
    elif not f.include_sub_agents and "derivation_type" in columns:
        c = c & (F.col("derivation_type") != "sub_agent")
    if f.live_only:
        c = c & (live if live is not None else F.lit(False))
    if f.trashed is not None and "trashed" in columns:
        c = c & (F.coalesce("trashed", F.lit(False)) == f.trashed)
    if f.superseded is not None and "superseded_by" in columns:
        c = c & (F.col("superseded_by").isNotNull() == f.superseded)
    return c


def scope_condition(path: str, columns: list[str], case_sensitive: bool = False) -> Column:
    """Documents whose project or working directory is the path, compared by components."""
    want = _components(path, case_sensitive)
    c = F.lit(False)
    for name in ("project", "cwd"):
        if name in columns:
            have = normal_path(F.col(name)) if not case_sensitive else F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(name), r"/\.(?=/|$)", ""), "/+", "/"), "(.)/$", "$1")
            c = c | F.coalesce(have == want, F.lit(False))
    return c


def _components(path: str, case_sensitive: bool) -> str:
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    out = ("/" if path.replace("\\", "/").startswith("/") else "") + "/".join(parts)
    return out if case_sensitive else out.lower()


def recency(now: int) -> Column:
    return 1.0 + F.exp(-F.greatest(F.lit(now) - F.col("modified_ts"), F.lit(0)).cast("double") / WEEK)


def _count(leaf: ql.Leaf) -> Column:
    """Occurrences of a term or exact phrase in its field."""
    text = " " + " ".join(leaf.values)
    return F.regexp_count(F.col(f"norm_{leaf.field}"), F.lit(ql._q(text) + "(?= )")).cast("double")


def scored(documents: DataFrame, text: str, defaults: tuple[str, ...] = ("content",), corpus: DataFrame | None = None) -> DataFrame:
    """Matching documents with their BM25 ``score``: the sum over positive clauses; regex, prefix and other clauses count 1."""
    q = ql.parse(text, defaults)
    tree = ql.fold(q.tree)
    corpus = documents if corpus is None else corpus
    positive = ql.leaves(tree)
    exact = [x for x in positive if x.kind == "term" or x.kind == "phrase" and not x.slop and not x.prefix]
    boosts = [(x, x.boost) for x in exact]
    if q.bare:  # a bare query of several words: documents that hold it as one phrase rank higher
        boosts += [(ql.Leaf("phrase", f, tuple(ql.analyze(q.text))), PHRASE_BOOST) for f in defaults]
    # A phrase's idf is the sum over its words, as for the words alone.
    words_ = sorted({(x.field, w) for x, _ in boosts for w in x.values})
    one = corpus.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in sorted({x.field for x, _ in boosts})],
        *[F.count_if(F.col(f"norm_{f}").contains(f" {w} ")).alias(f"df{k}") for k, (f, w) in enumerate(words_)],
    ).first()  # one row of numbers; as literals they let the scoring scan stay one generated stage
    score = F.lit(0.0)
    for leaf, boost in boosts:
        tf = _count(leaf)
        idf = sum(math.log(1 + (one["n"] - df + 0.5) / (df + 0.5)) for df in (one[f"df{words_.index((leaf.field, w))}"] for w in leaf.values))
        norm = K1 * (1 - B + B * F.col(f"len_{leaf.field}") / (one[f"avg_{leaf.field}"] or 1.0))
        score = score + F.when(tf > 0, boost * idf * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)
    for leaf in positive:
        if leaf not in exact:
            score = score + F.when(ql.condition(leaf), leaf.boost).otherwise(0.0)
    return documents.where(ql.condition(tree)).withColumn("score", score)


def search(
    documents: DataFrame, request: Request, key: str = "doc_id", defaults: tuple[str, ...] = ("content",), live: DataFrame | None = None, modes: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """The best ``limit`` documents (at least 1): time order, or relevance times recency; an empty query lists the most recent.

    ``modes``: fields of bare words by visibility mode, over columns of the documents; the query's own mode goes before the request's.
    """
    columns = documents.columns
    if modes is not None:
        defaults = modes[parsed(request.query, request.mode, modes).mode or request.mode]
    c = filter_condition(request.filters, columns, F.col("is_live") if live is not None else None)
    if request.scope is not None:
        c = c & scope_condition(request.scope, columns, request.case_sensitive_scope)
    base = documents
    if live is not None:  # markers of running sessions: few by nature; the join decides by their size
        base = base.join(live.select("agent", "session_id", F.lit(True).alias("is_live")).distinct(), ["agent", "session_id"], "left").withColumn("is_live", F.coalesce("is_live", F.lit(False)))
    limit = max(1, request.limit)
    if request.sort == "relevance" and request.query.strip():
        hits = scored(base, request.query, defaults, base).where(c).withColumn("score", F.col("score") * recency(request.now))
        return hits.orderBy(F.desc("score"), F.desc("modified_ts"), F.asc(key)).limit(limit)
    hits = base.where(c)
    if request.query.strip():
        hits = matching(hits, request.query, defaults)
    return hits.withColumn("score", F.col("modified_ts").cast("float")).orderBy(F.desc("modified_ts"), F.asc(key)).limit(limit)


def _ranges(leaf: ql.Leaf, tokens: Column) -> Column:
    """array<struct<first, last>>: the places of a leaf over the words of its field, as ``ql.leaf_condition`` finds them."""
    every = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.get(tokens, i)
    span = lambda first, last: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))
    if leaf.kind != "phrase":
        is_one = ql.word_condition(leaf)
        listed = lambda t: is_one(t) if leaf.kind in ("term", "set") else (t != "") & (t != GAP) & is_one(t)
        return F.transform(F.filter(every, lambda i: listed(word(i))), lambda i: span(i, i))
    k = len(leaf.values)
    if not leaf.slop:

        def begins(i: Column) -> Column:
            c = word(i) == leaf.values[0]
            for n, v in enumerate(leaf.values[1:], 1):
                at = F.get(tokens, i + n)  # null beyond the end
                c = c & F.coalesce(at.startswith(v) if leaf.prefix and n == k - 1 else at == v, F.lit(False))
            return c

        return F.transform(F.filter(every, begins), lambda i: span(i, i + (k - 1)))

    def further(v: str, gap: int) -> Callable[[Column], Column]:
        after = lambda r: F.sequence(r["last"] + 1, F.greatest(r["last"] + 1, F.least(r["last"] + 1 + gap, F.size(tokens) - 1)))
        return lambda r: F.transform(F.filter(after(r), lambda i: F.coalesce(word(i) == v, F.lit(False))), lambda i: span(r["first"], i))

    def chained(values: tuple[str, ...], gap: int) -> Column:
        """The words in order with at most ``gap`` others between two of them."""
        out = F.transform(F.filter(every, lambda i: word(i) == values[0]), lambda i: span(i, i))
        for v in values[1:]:
            out = F.array_distinct(F.flatten(F.transform(out, further(v, gap))))
        return out

    out = chained(leaf.values, leaf.slop)
    if k == 2 and leaf.slop >= 2:
        out = F.array_union(out, chained(leaf.values[::-1], leaf.slop - 2))
    return out


def _whole(leaf: ql.Leaf) -> Column:
    """array<struct<term, position, words>> of a leaf over a field that is no text: the path suffixes that begin with it, by their place in
    ``paths_<field>``, or the one value."""
    one = lambda term, position: F.struct(term.cast("string").alias("term"), position.cast("int").alias("position"), F.lit(1).alias("words"))
    if leaf.kind == "path":
        at = F.transform(F.col(f"paths_{leaf.field}"), lambda p, i: one(p, i))
        return F.filter(at, lambda x: F.lower(x["term"]).startswith(leaf.values[0].lstrip("/")))
    value = F.col("modified_ts" if leaf.field == "modified_ts" else "working_dir")
    return F.when(ql.leaf_condition(leaf), F.array(one(value, F.lit(0)))).otherwise(F.array().cast("array<struct<term:string,position:int,words:int>>"))


def occurrences(documents: DataFrame, text: str, key: str = "doc_id", defaults: tuple[str, ...] = ("content",)) -> DataFrame:
    """(key, field, term, position, words): where the positive clauses stand in matching documents, each place once.

    ``position`` counts the words of the field from 0, ``words`` is the length of the place and ``term`` its words: one for terms, sets,
    regular expressions, wildcards and ranges, all from the first to the last for phrases.  Paths count their suffixes instead, and
    ``working_dir`` and ``modified_ts`` are one value.  No positive clause: an empty table.
    """
    tree = ql.fold(ql.parse(text, defaults).tree)
    hits = documents.where(ql.condition(tree))
    wanted: dict[str, list[ql.Leaf]] = {}
    for leaf in ql.leaves(tree):
        if leaf not in wanted.setdefault(leaf.field, []):
            wanted[leaf.field].append(leaf)
    out = hits.where(F.lit(False)).select(key, F.lit("").alias("field"), F.lit("").alias("term"), F.lit(0).alias("position"), F.lit(1).alias("words"))
    for name, leaves in sorted(wanted.items()):
        if name not in (*ql.PATH_FIELDS, "working_dir", "modified_ts"):
            held = hits.select(key, F.split(F.trim(f"norm_{name}"), " ").alias("__tokens"))
            places = F.array_distinct(F.flatten(F.array(*[_ranges(x, F.col("__tokens")) for x in leaves])))
            at = held.select(key, "__tokens", F.inline(places))
            size = F.col("last") - F.col("first") + 1
            every = at.select(key, F.lit(name).alias("field"), F.array_join(F.slice("__tokens", F.col("first") + 1, size), " ").alias("term"), F.col("first").alias("position"), size.alias("words"))
        else:
            every = hits.select(key, F.lit(name).alias("field"), F.inline(F.array_distinct(F.flatten(F.array(*[_whole(x) for x in leaves])))))
        out = out.unionByName(every)
    return out


def entries(documents: DataFrame, key: str, fields: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, field, key, tf, positions, len, *keep): the postings of each document, made inside its row; nothing is shuffled."""

    def of(column: str) -> Column:
        places = F.transform(words(F.col(column)), lambda w, k: F.struct(w.alias("w"), k.alias("k")))
        return F.array_sort(F.filter(places, lambda x: F.octet_length(x["w"]) < LONG_TOKEN_BYTES))

    out = None
    for name, column in fields.items():
        rows = dealt(documents).select(F.col(key), *keep, F.explode(F.array(of(column))).alias("__s")).withColumn("len", F.size("__s")).where("len > 0")
        starts = F.filter(F.sequence(F.lit(0), F.col("len") - 1), lambda i: (i == 0) | (F.get("__s", i)["w"] != F.get("__s", i - 1)["w"]))
        rows = rows.withColumn("__b", F.explode(F.array(starts)))
        runs = F.transform(F.arrays_zip(F.col("__b").alias("a"), F.array_append(F.slice("__b", F.lit(2), F.size("__b")), F.col("len")).alias("z")), lambda r: F.struct(
            F.get("__s", r["a"])["w"].alias("term"), (r["z"] - r["a"]).alias("tf"), F.transform(F.slice("__s", r["a"] + 1, r["z"] - r["a"]), lambda x: x["k"]).alias("positions")))
        part = rows.select(key, *keep, "len", F.lit(name).alias("field"), F.inline(runs))
        out = part if out is None else out.unionByName(part)
    return out


def postings(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, key, tf, positions): the inverted index of one text."""
    return entries(documents.select(key, text.alias("__text")), key, {"content": "__text"}).select("term", key, "tf", "positions")


def _minus(k: int):
    return lambda x: x - k


def by_postings(index: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of the documents that match a query of terms, AND, OR and NOT over one field, by semi and anti joins on postings."""
    every = documents.select(key)

    def keys(tree) -> DataFrame:
        if isinstance(tree, bool):
            return every if tree else every.limit(0)
        if isinstance(tree, ql.Leaf):
            if tree.kind == "regex":
                return index.where(F.col("term").rlike(rf"^(?:{tree.values[0]})$")).select(key).distinct()
            if tree.kind in ("term", "set"):
                return index.where(F.col("term").isin(*tree.values)).select(key).distinct()
            parts = index.where(F.col("term").isin(*tree.values)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
            at = [F.coalesce(F.try_element_at("at", F.lit(t)), F.array().cast("array<int>")) for t in tree.values]
            starts = at[0]
            for k, p in enumerate(at[1:], 1):
                starts = F.array_intersect(starts, F.transform(p, _minus(k)))
            return parts.where(F.size(starts) > 0).select(key)
        out = None
        for x in tree.must:
            out = keys(x) if out is None else out.join(keys(x), key, "left_semi")
        if not tree.must and tree.should:
            for x in tree.should:
                out = keys(x) if out is None else out.unionByName(keys(x))
            out = out.distinct()
        out = every if out is None else out
        for x in tree.must_not:
            out = out.join(keys(x), key, "left_anti")
        return out

    return keys(ql.fold(ql.parse(text).tree))


def snippet(text: str | None, terms: list[str], limit: int = SNIPPET) -> str:
    """The surroundings of the first occurrence, escaped, white space collapsed, occurrences in <b>, ellipses where cut."""
    flat = " ".join((text or "").split())
    pattern = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + r")(?![^\W_])", re.I) if terms else None
    first = pattern.search(flat) if pattern else None
    start = max(0, first.start() - LEAD) if first else 0
    part = flat[start : start + limit]
    out, at = [], 0
    for m in pattern.finditer(part) if pattern else ():
        out += [html.escape(part[at : m.start()], quote=False), "<b>", html.escape(m.group(0), quote=False), "</b>"]
        at = m.end()
    out.append(html.escape(part[at:], quote=False))
    marked = re.sub(r"</b>( ?)<b>", r"\1", "".join(out))
    return ("…" if start else "") + marked + ("…" if start + limit < len(flat) else "")


def with_snippets(hits: DataFrame, text: str, column: str = "text", limit: int = SNIPPET) -> DataFrame:
    """Adds ``snippet`` (see :func:`snippet`, which gives the same text) to the hits that are shown."""
    terms = sorted(ql.highlight_terms(text), key=len, reverse=True)
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s+", " "))
    pattern = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(terms) + r")(?![\p{L}\p{N}])"  # words of letters and digits need no quoting
    first = F.regexp_instr(flat, F.lit(pattern)) if terms else F.lit(0)
    start = F.greatest(first - LEAD, F.lit(1))
    part = F.substr(flat, start, F.lit(limit))
    marked = F.regexp_replace(part, pattern, "\u0002$1\u0003") if terms else part
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    joined = F.regexp_replace(escaped, "\u0003( ?)\u0002", "$1")
    shown = F.regexp_replace(F.regexp_replace(joined, "\u0002", "<b>"), "\u0003", "</b>")
    cut = lambda c: F.when(c, "…").otherwise("")
    return hits.withColumn("snippet", F.concat(cut(start > 1), shown, cut(start + limit - 1 < F.length(flat))))


def bm25(tf: float, df: float, n: float, length: float, average: float) -> float:
    """The score of one word, for tests."""
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def projected(hits: DataFrame, origins: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field, source, start, end): ranges of hits in a field, as ranges of the parts the field was joined from.

    hits: key, field, start, end.  origins: key, field, source, start, end (the part's place in the field).  Interval overlap within one
    document's field; a hit across two parts gives one range in each.
    """
    h, o = hits.alias("h"), origins.alias("o")
    on = (F.col(f"h.{key}") == F.col(f"o.{key}")) & (F.col("h.field") == F.col("o.field")) & (F.col("h.start") < F.col("o.end")) & (F.col("h.end") > F.col("o.start"))
    start, end = F.greatest("h.start", "o.start") - F.col("o.start"), F.least("h.end", "o.end") - F.col("o.start")
    return h.join(o, on).select(F.col(f"h.{key}"), F.col("h.field"), "o.source", start.alias("start"), end.alias("end"))


DISCOVERY = ("session_id", "agent", "project", "branch", "cwd", "created", "modified", "lines", "first_msg_role", "first_user_msg_content", "last_msg_role", "last_msg_content", "derivation_type", "is_sidechain", "slug")


def discovery(hits: DataFrame, cap: int = 512) -> DataFrame:
    """The compact record of each hit: the session columns it has, snippet, score and is_live; texts collapsed and cut."""
    kinds = dict(hits.dtypes)
    extra = [c for c in ("snippet", "score", "is_live") if c in kinds]
    return hits.select(*[compact(F.col(c), cap).alias(c) if kinds[c] == "string" else F.col(c) for c in DISCOVERY if c in kinds], *extra)
