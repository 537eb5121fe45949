"""Secret scans by a trigram inverted index, with DataFrame functions only.

From each rule's expression follows a Boolean query over the trigrams that any
match must hold, letters in lower case. The index has, for every trigram that
some query names, the keys of the documents that hold it. Intersecting these
postings per conjunction gives candidate documents for each rule, and only there
the expression runs. A rule without a mandatory trigram runs on every document.

A document's key is a hash of its id and text, so rows without id are spread as
well; documents that share a key share their candidates, which only adds checks.
The candidates' keys are broadcast up to ``BROADCAST_ROWS`` and joined by
shuffle beyond; texts are not moved for the former.

Cases: null text counts as empty (and stays null in ``redact``); very long texts
are scanned whole; repeated rows are scanned each; ids may be null or of any
type; an empty table gives an empty table; ``scan`` replaces a column ``secret_spans``,
all others are kept whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm._spark import prepare, settle


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: This group must have so many characters; a match that fails is dropped.
    group: int = 0
    least: int = 0


#: Kinds in the order in which equal starts are listed; the first three are the base rules.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the runs of [0-9a-f]+ that have 16 characters
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("login", r"""[a-z][a-z0-9+]{2,15}://[^\x00-\x20:/@"']{1,64}:[^\x00-\x20:/@"']{3,64}@"""),
)
BASE = ("assign", "access", "hex")
#: Strings that a run of literals and small classes is expanded to at most.
MAX_STRINGS = 32

#: Keys of candidates that are broadcast at most, of some 40 bytes each.
BROADCAST_ROWS = 1 << 18
#: Matches that are put in place in one fold; more go block by block.
FOLD = 256

#: A query is an AND of ORs: each conjunct is a set of alternatives, each a set of trigrams. Empty: no trigram is mandatory.
Query = list[frozenset[frozenset[str]]]
#: One part of an expression: the letters it may be (None: too many), or the branches of a group; and how often it comes at least and at most.
_Part = tuple[frozenset[str] | list[list] | None, int, float]

_ATOM = re.compile(r"\\x(?P<hex>[0-9a-fA-F]{2})|\\(?P<escape>[^0-9A-Za-z])|\\(?P<kind>[A-Za-z])|\[(?P<no>\^?)(?P<set>\]?(?:\\.|[^\]\\])*)\]|(?P<any>\.)|(?P<open>\((?:\?:)?)|(?P<edge>[\^$])|(?P<char>[^|()])", re.S)
_TIMES = re.compile(r"(?:(?P<mark>[?*+])|\{(?P<least>\d+)(?P<comma>,?)(?P<most>\d*)\})[?+]?")


def trigrams(pattern: str) -> Query:
    """The trigrams, in lower case, that any match of the expression must hold.

    Expressions may have letters, escapes, sets, groups, choices, repeats and leading flags.
    """
    branches, at = _branches(pattern, re.match(r"(?:\(\?[a-z]+\))?", pattern).end())  # type: ignore[union-attr]
    if at != len(pattern):
        raise ValueError(f"not read beyond {at}: {pattern}")
    return _either([_query(b) for b in branches]) if len(branches) > 1 else _query(branches[0])


def _branches(pattern: str, at: int) -> tuple[list[list[_Part]], int]:
    """The choices from a place to the end of the group there, and where that is."""
    out: list[list[_Part]] = [[]]
    while at < len(pattern) and pattern[at] != ")":
        if pattern[at] == "|":
            out.append([])
            at += 1
            continue
        m = _ATOM.match(pattern, at)
        if m is None or (m["open"] and pattern[m.end() : m.end() + 1] == "?"):
            raise ValueError(f"not read at {at}: {pattern}")
        at = m.end()
        item: frozenset[str] | list[list] | None = None
        if m["open"]:
            item, at = _branches(pattern, at)
            at += 1
        elif m["edge"]:
            continue
        elif m["hex"]:
            item = frozenset(chr(int(m["hex"], 16)).lower())
        elif m["escape"] or m["char"]:
            item = frozenset((m["escape"] or m["char"]).lower())
        elif m["set"] and not m["no"] and not re.search(r"\\[A-Za-wyz]|.-.", m["set"]):
            item = frozenset(c.lower() for c in re.sub(r"\\x([0-9a-fA-F]{2})|\\(.)", lambda x: chr(int(x[1], 16)) if x[1] else x[2], m["set"]))
        least, most = 1, 1.0
        if times := _TIMES.match(pattern, at):
            at = times.end()
            least, most = {"?": (0, 1.0), "*": (0, float("inf")), "+": (1, float("inf"))}.get(times["mark"]) or (int(times["least"]), float(times["most"] or ("inf" if times["comma"] else times["least"])))
        out[-1].append((item, least, most))
    return out, at


def _query(parts: list[_Part]) -> Query:
    out: Query = []
    run = {""}

    def close() -> None:
        sets = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run)
        if all(sets):
            out.append(sets)

    for item, least, most in parts:
        once = least == most == 1
        if once and isinstance(item, frozenset) and len(run) * len(item) <= MAX_STRINGS:
            run = {s + c for s in run for c in item}
            continue
        close()
        run = {""}
        if least and isinstance(item, list):
            out += _either([_query(b) for b in item]) if len(item) > 1 else _query(item[0])
        elif least and item is not None and len(item) <= MAX_STRINGS:
            run = set(item)
            if least > 1 or most > 1:
                run = {c * min(least, 3) for c in item} if len(item) == 1 else {""}
                close()
                run = {""}
    close()
    return out


def _either(queries: list[Query]) -> Query:
    """One conjunct for the choice between queries; none if one of them asks for nothing."""
    if not all(queries):
        return []
    alternatives: set[frozenset[str]] = set()
    for query in queries:
        options = {frozenset()}
        for conjunct in query:
            options = {a | b for a in options for b in conjunct}
        alternatives |= options
    return [frozenset(alternatives)]


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col)


def postings(df: DataFrame, names: list[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index for these trigrams: trigram int (its place in names), doc (the key)."""
    lowered = df.select(_key(id_col, text_col).alias("doc"), F.lower(F.col(text_col)).alias("low"))
    held = ", ".join(f"CASE WHEN contains(low, {_sql(t)}) THEN array({i}) ELSE cast(array() AS array<int>) END" for i, t in enumerate(names))
    return lowered.select("doc", F.explode(F.expr(f"concat({held})")).alias("trigram"))


def candidates(df: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> tuple[DataFrame | None, list[int]]:
    """doc and found, the numbers of the rules whose queries the postings meet; the rules that have no query."""
    queries = [trigrams(r.pattern) for r in rules]
    names = sorted({t for q in queries for c in q for a in c for t in a})
    free = [i for i, q in enumerate(queries) if not q]
    if not names:
        return None, free
    held = postings(df, names, id_col, text_col).groupBy("doc").agg(F.collect_set("trigram").alias("held"))

    def all_of(numbers: list[int]) -> str:
        return f"size(array_intersect(held, array({', '.join(map(str, numbers))}))) = {len(numbers)}"

    def meets(query: Query) -> str:
        return " AND ".join("(" + " OR ".join(all_of(sorted(map(names.index, a))) for a in sorted(c, key=sorted)) + ")" for c in query)

    met = ", ".join(f"CASE WHEN {meets(q)} THEN {i} END" for i, q in enumerate(queries) if q)
    return held.select("doc", F.expr(f"array_compact(array({met}))").alias("found")).filter(F.size("found") > 0), free


_NONE = "cast(array() AS array<struct<start:int,rank:int,end:int,kind:string>>)"


def _spans(text: str, rule: Rule) -> str:
    """SQL for the matches of one rule, leftmost first and apart, as (start, rank, end, kind); places count code points.

    Places follow from the lengths of the gaps and matches before: summed up for blocks
    of FOLD matches first, then within each, so the work is not the square of the matches.
    """
    pattern = _sql(rule.pattern)
    order = RULES.index(rule) if rule in RULES else len(RULES)
    extract = lambda group: f"regexp_extract_all({text}, {pattern}, {group})"
    gaps = f"slice(split({text}, {pattern}, -1), 1, size(m))"
    sizes = f"zip_with(zip_with({gaps}, m, (g, y) -> named_struct('g', char_length(g), 'm', char_length(y))), {extract(rule.group)}, (x, t) -> named_struct('g', x.g, 'm', x.m, 't', char_length(t)))"
    blocks = f"transform(sequence(0, cast(floor((size(z) - 1) / {FOLD}) AS int)), b -> slice(z, b * {FOLD} + 1, {FOLD}))"
    firsts = "aggregate(parts, named_struct('place', 0, 'places', cast(array() AS array<int>)), (s, part) -> named_struct('place', s.place + aggregate(part, 0, (a, x) -> a + x.g + x.m), 'places', concat(s.places, array(s.place))), s -> s.places)"
    span = f"named_struct('start', s.place + x.g, 'rank', {order}, 'end', s.place + x.g + x.m, 'kind', '{rule.kind}')"
    more = f"concat(s.found, array({span}))"
    if rule.least:
        more = f"CASE WHEN x.t >= {rule.least} THEN {more} ELSE s.found END"
    within = f"aggregate(part, named_struct('place', start, 'found', {_NONE}), (s, x) -> named_struct('place', s.place + x.g + x.m, 'found', {more}), s -> s.found)"
    out = f"flatten(zip_with(parts, {firsts}, (part, start) -> {within}))"
    for name, value in (("parts", blocks), ("z", sizes), ("m", extract(0))):  # each is computed once
        out = f"transform(array({value}), {name} -> {out})[0]"
    return f"CASE WHEN rlike({text}, {pattern}) THEN {out} ELSE {_NONE} END"


def _scanned(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """row (all columns), whole (the text) and spans of every row."""
    prepare(df.sparkSession)
    found, free = candidates(df, rules, id_col, text_col)
    rows = df.select(F.struct(*df.columns).alias("row"), _key(id_col, text_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("whole"))
    if found is not None:
        found = settle(found)
        small = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(found) if small else found, "doc", "left")
    each = [_spans("whole", r) if i in free else f"CASE WHEN array_contains(found, {i}) THEN {_spans('whole', r)} ELSE {_NONE} END" for i, r in enumerate(rules)]
    return rows.select("row", "whole", F.expr(f"array_sort(concat({', '.join(each)}))").alias("spans"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``secret_spans``: array of (start, rank, end, kind), sorted by start and then by the order of the rules."""
    found = _scanned(df.drop("secret_spans"), id_col, text_col, rules)
    return found.select("row.*", F.col("spans").alias("secret_spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The table with each secret replaced by [REDACTED]; overlapping spans become one."""
    step = "named_struct('place', greatest(s.place, x.end), 'gaps', CASE WHEN x.start >= s.place THEN concat(s.gaps, array(substring(whole, s.place + 1, x.start - s.place))) ELSE s.gaps END)"
    rest = "array_join(concat(s.gaps, array(substring(whole, s.place + 1))), '[REDACTED]')"
    cut = f"CASE WHEN size(spans) > 0 THEN aggregate(spans, named_struct('place', 0, 'gaps', cast(array() AS array<string>)), (s, x) -> {step}, s -> {rest}) ELSE row.`{text_col}` END"
    return _scanned(df, id_col, text_col, rules).select(*((F.expr(cut) if c == text_col else F.col("row")[c]).alias(c) for c in df.columns))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans of each base kind, sha256 of the base spans, and all spans."""
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return scan(df.select(id_col, text_col), id_col, text_col).select(
        id_col, *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans")
    )
