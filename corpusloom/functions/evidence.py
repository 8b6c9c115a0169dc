"""Scalar evidence rules over a query, a result's title and snippet, and a sentence, as SQL fragments."""

from __future__ import annotations

from corpusloom.functions.constants import (
    AUTHORITY,
    CLAIM_STOPWORDS,
    DEFINES,
    JUDGMENT_TERMS,
    NEGATION_TERMS,
    OTHER_AUTHORITY,
    QUERY_STOPWORDS,
    TOPICS,
    TRADEOFF_TERMS,
    TRUSTED_AUTHORITY,
    WORD,
)
from corpusloom.functions.dialect import Spark

EDGE = r"^[._+#-]+|[._+#-]+$"


def words(d: Spark, t: str) -> str:
    return d.distinct(d.find_all(f"lower({t})", WORD))


def bare_words(d: Spark, t: str) -> str:
    """Words without marks at their ends."""
    return d.distinct(d.filter(d.map(d.find_all(f"lower({t})", WORD), "bw", d.replace("bw", EDGE)), "bw", "bw <> ''"))


def query_terms(d: Spark, q: str) -> str:
    return d.distinct(d.filter(d.find_all(f"lower({q})", WORD), "qt", f"length(qt) > 1 AND NOT {d.has(d.words(QUERY_STOPWORDS), 'qt')}"))


def share(d: Spark, hits: str, of: str, empty: str = "1e0") -> str:
    return f"coalesce({d.divide(d.size(hits), d.size(of))}, {empty})"


def coverage(d: Spark, terms: str, t: str) -> str:
    """Share of the terms that stand in the text as substrings; 1 without terms."""
    return share(d, d.filter(terms, "cv", f"contains(lower({t}), cv)"), terms)


def term_in(d: Spark, term: str, tokens: str) -> str:
    """Whether a term or one of its plural forms is among the tokens."""
    plain = f"length({term}) <= 3 OR {d.like(term, '[0-9-]')}"
    plural = f"{d.has(tokens, f'''concat({term}, 's')''')} OR {d.has(tokens, f'''concat({term}, 'es')''')} OR ({term} LIKE '%y' AND {d.has(tokens, f'''concat(substring({term}, 1, length({term}) - 1), 'ies')''')})"
    return f"({d.has(tokens, term)} OR (NOT ({plain}) AND ({plural})))"


def matched(d: Spark, terms: str, tokens: str) -> str:
    return d.filter(terms, "mt", term_in(d, "mt", tokens))


def token_coverage(d: Spark, terms: str, t: str) -> str:
    return share(d, matched(d, terms, bare_words(d, t)), terms)


def identifiers(d: Spark, q: str) -> str:
    """All-capital words of three and more characters, and words with a digit or a hyphen, in lower case."""
    caps = d.map(d.find_all(q, r"\b[A-Z][A-Z0-9_-]{2,}\b"), "ic", "lower(ic)")
    marked = d.filter(d.map(d.find_all(q, "[A-Za-z0-9][A-Za-z0-9_+.#-]*"), "im", d.replace("lower(im)", EDGE)), "im", f"im <> '' AND {d.like('im', '[0-9-]')}")
    return d.union(caps, marked)


def is_judgment(d: Spark, q: str) -> str:
    return f"({d.size(d.common(d.find_all(f'lower({q})', '[a-z0-9-]+'), d.words(JUDGMENT_TERMS)))} > 0)"


def definition_terms(d: Spark, q: str) -> str:
    """Terms of what a definition query asks for; empty for other queries."""
    low = d.replace(f"lower({d.replace(q, f'^{d.space}+|{d.space}+$')})", r"[?.!]+$")
    what = d.replace(d.group(low, rf"^what\s+is\s+(.+)$"), r"\s+(in|for|within|inside|on)\s+.*$")
    mean, define = d.group(low, r"^what\s+does\s+(.+?)\s+mean$"), d.group(low, r"^define\s+(.+)$")
    subject = f"CASE WHEN {d.like(low, '^what[ ]+is[ ]+.')} THEN {what} WHEN {mean} <> '' THEN {mean} ELSE {define} END"
    return d.filter(bare_words(d, f"({subject})"), "dt", f"length(dt) > 1 AND NOT {d.has(d.words(QUERY_STOPWORDS), 'dt')}")


def is_underspecified(d: Spark, q: str, terms: str, ids: str, defs: str) -> str:
    shape = d.like(f"lower(trim({q}))", r"^(should\b|is\b|are\b|which\b|how\s+should\b|what\s+should\b)")
    return f"({d.size(defs)} = 0 AND {d.size(ids)} = 0 AND {shape} AND {d.size(d.minus(terms, d.words(JUDGMENT_TERMS)))} <= 1)"


def relevance(d: Spark, terms: str, defs: str, title: str, snip: str) -> str:
    tc, sc = coverage(d, terms, title), coverage(d, terms, snip)
    ids = d.filter(terms, "ri", f"({d.like('ri', '[0-9-]')} OR length(ri) <= 5)")
    base = f"(CASE WHEN {tc} > 0 THEN 0.72e0 * {tc} + 0.28e0 * {sc} ELSE 0.5e0 * {sc} END)"
    bonus = f"0.12e0 * {share(d, d.filter(ids, 'rm', f'contains(lower({title}), rm)'), ids, '0e0')}"
    subject = token_coverage(d, defs, f"concat({title}, ' ', {snip})")
    floor = f"CASE WHEN {d.size(defs)} > 0 AND {subject} >= 0.6e0 THEN 0.46e0 + 0.28e0 * {subject} ELSE 0e0 END"
    return f"CASE WHEN {d.size(terms)} = 0 THEN 1e0 ELSE least(1e0, greatest(0e0, {base} + {bonus}, {floor})) END"


def defines(d: Spark, defs: str, bare: str, sentence: str) -> str:
    """Whether a sentence (with its bare words) defines the subject; true for queries that ask for no definition."""
    got = share(d, matched(d, defs, bare), defs)
    ids = d.filter(defs, "di", d.like("di", "[0-9-]"))
    enough = f"CASE WHEN {d.size(ids)} > 0 THEN {d.size(d.minus(ids, bare))} = 0 AND {got} >= 0.4e0 ELSE {got} >= 0.6e0 END"
    return f"({d.size(defs)} = 0 OR (({enough}) AND {d.like(f'lower({sentence})', DEFINES)}))"


def support_base(d: Spark, terms: str, ids: str, title_words: str, w: str) -> str:
    """Share of the query's terms in a sentence's words ``w`` (with their marks), in the title, and of its identifiers."""
    return f"0.65e0 * {share(d, matched(d, terms, w), terms)} + 0.2e0 * {share(d, d.common(terms, title_words), terms)} + 0.25e0 * {share(d, d.common(ids, w), ids, '0e0')}"


def support(d: Spark, base: str, terms: str, defs: str, is_definition: str, judgment: str, w: str) -> str:
    """How far a sentence supports an answer, 0..1: at least 0.34 for definitions, less for judgments without tradeoffs."""
    score = f"(CASE WHEN {d.size(defs)} > 0 AND {is_definition} THEN greatest({base}, 0.34e0) ELSE {base} END)"
    hits = d.size(d.common(w, d.words(TRADEOFF_TERMS)))
    judged = f"CASE WHEN NOT {judgment} THEN {score} WHEN {hits} = 0 THEN 0.45e0 * {score} ELSE {score} + least(0.2e0, 0.05e0 * {hits}) END"
    return f"CASE WHEN {d.size(terms)} = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, {judged})) END"


def claim_tokens(d: Spark, terms: str, sentence: str) -> str:
    out = d.words(sorted(set(CLAIM_STOPWORDS) | set(NEGATION_TERMS)))
    return d.filter(bare_words(d, sentence), "ct", f"length(ct) > 2 AND NOT {d.has(out, 'ct')} AND NOT {d.has(terms, 'ct')}")


def polarity(d: Spark, terms: str, sentence: str) -> str:
    """-1 where a negation is among the three words before a query term, else 1."""
    toks = d.find_all(f"lower({sentence})", "[a-z0-9][a-z0-9_+.#\\x27-]*")
    before = d.slice(toks, "greatest(1, pi - 3)", "least(3, pi - 1)")
    hit = f"{d.has(terms, d.at(toks, 'pi'))} AND pi > 1 AND {d.size(d.common(before, d.words(NEGATION_TERMS)))} > 0"
    return f"CASE WHEN {d.any(d.range('1', d.size(toks)), 'pi', hit)} THEN -1 ELSE 1 END"


def jaccard(d: Spark, a: str, b: str) -> str:
    return f"CASE WHEN {d.size(a)} = 0 OR {d.size(b)} = 0 THEN 0e0 ELSE {d.divide(d.size(d.common(a, b)), d.size(d.union(a, b)))} END"


def comparable(d: Spark, a: str, b: str) -> str:
    return f"({d.size(a)} > 0 AND {d.size(b)} > 0 AND ({d.size(d.common(a, b))} >= 2 OR {jaccard(d, a, b)} >= 0.18e0))"


def authority(d: Spark, host: str, source: str) -> str:
    exact = " ".join(f"WHEN {host} = '{h}' THEN {v}e0" for h, v in AUTHORITY.items())
    under = " ".join(f"WHEN {host} LIKE '%.{h}' THEN {v}e0" for h, v in AUTHORITY.items())
    return f"CASE {exact} {under} WHEN {source} LIKE 'trusted-docs:%' THEN {TRUSTED_AUTHORITY}e0 ELSE {OTHER_AUTHORITY}e0 END"


def topic_authority(d: Spark, host: str, base: str, rel: str, terms: str) -> str:
    topics = " ".join(f"WHEN {host} = '{h}' THEN {d.size(d.common(terms, d.words(t)))}" for h, t in TOPICS.items())
    affinity = f"least(1e0, (CASE {topics} ELSE 0 END) / cast(greatest(1, least(2, {d.size(terms)})) as double))"
    return f"greatest(0e0, least(1e0, {base} * (0.45e0 + 0.55e0 * greatest({rel}, {affinity}))))"


def title_overlap(d: Spark, query_tokens: str, title_tokens: str) -> str:
    q = d.distinct(query_tokens)
    return share(d, d.common(q, title_tokens), q, "0e0")
