"""Row-level text, url and query rules, as SQL fragments of either dialect."""

from __future__ import annotations

from corpusloom.functions.constants import (
    LOCALE_EXEMPT,
    LOW_VALUE_MARKERS,
    LOW_VALUE_SECTIONS,
    SKIP_EXTENSIONS,
    SNIPPET_CHARS,
    SNIPPET_LEAD,
    STOPWORDS,
    TERM,
    TRACKING_PARAMS,
)
from corpusloom.functions.dialect import Spark, quote


def tokens(d: Spark, t: str) -> str:
    """Terms of the index, in order and with repeats."""
    return d.filter(d.map(d.find_all(t, TERM), "tk", "lower(tk)"), "tk", f"tk NOT IN ({', '.join(map(quote, STOPWORDS))})")


def normalised(d: Spark, t: str) -> str:
    return f"lower({d.collapse(t)})"


def content_hash(d: Spark, t: str) -> str:
    return d.sha(normalised(d, t))


def routing_key(d: Spark, url: str, t: str) -> str:
    """The url where there is one, else the content hash."""
    return f"CASE WHEN length({url}) > 0 THEN {url} ELSE {content_hash(d, t)} END"


def rendezvous(d: Spark, key: str, shards: list[str]) -> str:
    """Shard with the greatest 64-bit hash of key and name; hex strings compare as the numbers do."""
    if len(shards) == 1:
        return f"'{shards[0]}'"
    best = f"greatest({', '.join(f'''substring({d.sha(f'''concat({key}, '|{s}')''')}, 1, 16)''' for s in shards)})"
    return "CASE " + " ".join(f"WHEN substring({d.sha(f'''concat({key}, '|{s}')''')}, 1, 16) = {best} THEN '{s}'" for s in shards) + " END"


def host(d: Spark, url: str) -> str:
    """Host in lower case, without user and port; empty where there is none."""
    return f"lower({d.group(url, r'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)')})"


def domain_of(d: Spark, url: str) -> str:
    return d.replace(host(d, url), r"^www\.")


def source_host(d: Spark, url: str, source: str) -> str:
    """Host of the url; where the url is empty, what follows ``trusted-docs:`` in the source."""
    return f"CASE WHEN length({url}) > 0 THEN {host(d, url)} WHEN lower({source}) LIKE 'trusted-docs:%' THEN substring(lower({source}), 14) ELSE '' END"


def canonical_url(d: Spark, url: str) -> str:
    """Url without fragment, tracking and blank parameters and doubled slashes; empty for assets and other schemes."""
    base = d.group(url, r"^([^#]*)")
    scheme = f"lower({d.group(base, r'^([A-Za-z][A-Za-z0-9+.-]*):')})"
    netloc = f"lower({d.group(base, r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)')})"
    path = d.replace(d.group(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)"), ";[^/;]*$")
    clean = d.replace(f"CASE WHEN {path} = '' THEN '/' ELSE {path} END", "/{2,}", "/")
    query = d.group(base, r"\?(.*)$")
    named = f"lower({d.group('pp', r'^([^=]*)')})"
    kept = d.filter(d.split(query, "&"), "pp", f"{d.like('pp', '^[^=]*=.')} AND NOT {d.like(named, '^utm_')} AND NOT {d.has(d.words(TRACKING_PARAMS), named)}")
    params = d.join(kept, "&")
    asset = d.like(f"lower({path})", r"\.(" + "|".join(SKIP_EXTENSIONS) + ")$")
    return f"CASE WHEN {scheme} NOT IN ('http', 'https') OR {asset} THEN '' ELSE concat({scheme}, '://', {netloc}, {clean}, CASE WHEN {params} = '' THEN '' ELSE concat('?', {params}) END) END"


def localized(d: Spark, url: str) -> str:
    """Whether the first step of the path is a language other than the exempt ones."""
    path = d.group(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")
    first = f"lower({d.group(path, '^/*([^/]*)')})"
    return f"({d.like(path, '^/[A-Za-z]{2}(-[A-Za-z]{2})?(/|$)')} AND NOT {d.has(d.words(LOCALE_EXEMPT), first)})"


def low_value(d: Spark, section: str, t: str) -> str:
    """Navigation and other blocks that aren't worth an index entry."""
    name = d.replace(normalised(d, f"coalesce({section}, '')"), "^[¶ ]+|[¶ ]+$")
    text = normalised(d, f"coalesce({t}, '')")
    marks = " OR ".join(f"contains({text}, '{m}')" for m in LOW_VALUE_MARKERS)
    return f"({d.has(d.words(LOW_VALUE_SECTIONS), name)} OR {marks} OR (length({text}) < 260 AND {d.count_in(f'''coalesce({t}, '')''', '|')} >= 3))"


def snippet(d: Spark, t: str, query: str) -> str:
    """Window of the text round the first query word of more than two characters."""
    low = f"lower({t})"
    terms = d.filter(d.split(d.collapse(f"lower({query})"), " "), "st", "length(st) > 2")
    first = f"coalesce({d.least_of(d.filter(d.map(terms, 'st', f'''instr({low}, st)'''), 'sp', 'sp > 0'))}, 1)"
    start = f"greatest(0, {first} - 1 - {SNIPPET_LEAD})"
    cut = d.strip(f"substring({t}, {start} + 1, {SNIPPET_CHARS})")
    return f"concat(CASE WHEN {start} > 0 THEN '…' ELSE '' END, {cut}, CASE WHEN {start} + {SNIPPET_CHARS} < length({t}) THEN '…' ELSE '' END)"


def query_tokens(d: Spark, q: str) -> str:
    return d.size(d.find_all(q, "[A-Za-z0-9_.:/-]+"))


def query_profile(d: Spark, q: str) -> str:
    """``exact`` for quoted spans, identifiers and up to two tokens, else ``natural_language``."""
    name, marks = "[A-Za-z0-9]+[_./:-][A-Za-z0-9_.:/-]+", "chr(34), chr(39)"
    quoted = f"concat('[', {marks}, '][^', {marks}, ']+[', {marks}, ']')"
    span = f"rlike({q}, {quoted})" if d.name == "spark" else f"regexp_matches({q}, {quoted})"
    return f"CASE WHEN {span} OR {d.like(q, name)} OR {query_tokens(d, q)} <= 2 THEN 'exact' ELSE 'natural_language' END"
