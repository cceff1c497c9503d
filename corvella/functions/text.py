"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Ligatures and what they stand for (fixed values).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: The same by their glyph names (fixed values).
LIGATURE_NAMES = {"FB00": "ff", "FB01": "fi", "FB02": "fl", "FB03": "ffi", "FB04": "ffl", "FB05": "st", "FB06": "st"}
#: Letters that extraction tears off their words (fixed values).
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝŸÑÇ"
#: What is cut out of prose, in order, and what takes its place (fixed values).
CITATIONS = [
    (r"https?://\S+", ""),
    (r"\[\d+(?:[,–\-]\d+)*\]", ""),
    (r"(?<!\n)\.\s+\d{1,3}(?:[,–\-]\d{1,3})*(?=\s|$)", ". "),
    (r",\s+\d{1,3}(?:[,–\-]\d{1,3})*(?=\s|$)", ", "),
    (r"(?<=\s)\d{1,3}(?:[,–\-]\d{1,3})+(?=\s|$)", ""),
    (r"\s+([.,;])", "$1"),
    (r"  +", " "),
]
#: Words that tell a direction, tried in order: first those against, then those for (fixed values).
AGAINST = [
    "not immunoreactive", "not reactive", "non-reactive", "not identified", "not detected", "not expressed", "no recurrence", "no metastasis", "no pleomorphism", "no cytologic atypia", "no atypia", "no mitoses",
    "not seen", "not observed", "non-", "absent", "negative", "lacking", "without", "no ", "not ",
]
FOR = ["present", "positive", "expressed", "immunoreactive", "reactive", "identified", "detected", "seen", "observed", "exhibits", "shows", "found"]
#: Words with a polarity, and words that turn round one among the three tokens after them (fixed values).
UPWARD = ["positive", "present", "increased", "detected", "high", "expressed", "elevated", "overexpressed", "upregulated"]
DOWNWARD = ["negative", "absent", "decreased", "low", "reduced", "downregulated", "lost", "undetected"]
NEGATIONS = ["not", "no", "without", "lack", "lacking", "never", "neither", "nor"]
#: Abbreviations that never end a sentence, and words that never end one (fixed values).
ABBREVIATIONS = ["fig", "figs", "et al", "vs", "approx", "dept", "no", "nos", "e.g", "i.e", "cf", "ref", "refs"]
CONNECTORS = ["and", "or", "but", "the", "a", "an", "of", "in", "on", "at", "to", "for", "with", "by", "that", "which", "who", "as", "if", "than"]
#: Endings that mark how something is expressed, cut off the end of a name (fixed values).
MARKERS = [" expression", " positivity", " staining", " immunoreactivity"]
SCOPE_KEYS = ["population", "disease_stage", "treatment", "method", "tissue", "timepoint", "comparator", "subgroup"]


def fix_ligatures(text: str | Column) -> Column:
    """Ligatures spelled out, by character or glyph name, and accented letters put back to their words."""
    t = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), LIGATURES.items(), _c(text))
    t = reduce(lambda t, x: F.regexp_replace(t, rf"(?i)\s*/uni{x[0]}\s*", x[1]), LIGATURE_NAMES.items(), t)
    t = F.regexp_replace(t, f"([A-Za-z{ACCENTED}]) ([{ACCENTED}])", "$1$2")
    return F.regexp_replace(t, f"([{ACCENTED}]) ([A-Za-z{ACCENTED}])", "$1$2")


def remove_citations(text: str | Column) -> Column:
    """Cut links and numbers of citations in brackets, after full stops and commas, and in lists; years stay."""
    return reduce(lambda t, x: F.regexp_replace(t, x[0], x[1]), CITATIONS, _c(text))


def is_reference_entry(text: str | Column) -> Column:
    """Whether a text looks like an entry of a reference list: numbered, two authors or more, or an author with et al. and a year."""
    t = F.trim(_c(text))
    year = t.rlike(r"\b(19|20)\d{2}\b")
    numbered = t.rlike(r"^\d+\.\s+") & (t.rlike(r"[A-Z][a-z]+\s+[A-Z][\.,]") | (year & (t.rlike(r"\b(doi|DOI|http|www|PMID|ISBN)") | (F.length(t) > 100))))
    authors = F.size(F.regexp_extract_all(t, F.lit(r"([0-9A-Za-z_][0-9A-Za-z_\u00C0-\u024F]+,\s+[A-Z]\.)"), 1)) >= 2
    et_al = t.rlike(r"^[A-Z][a-z]+[\s,]+[A-Z]") & F.substring(t, 1, 150).rlike(r"(?i)\bet\s+al\.") & year
    return numbered | authors | et_al


def clean_text(text: str | Column) -> Column:
    return F.when(is_reference_entry(text), "").otherwise(remove_citations(text))


def paragraph_class(text: str | Column) -> Column:
    """table, figure or narrative, by how the paragraph begins; list marks count as rows of a table."""
    head = F.lower(F.substring(F.trim(_c(text)), 1, 50))
    return F.when(head.rlike("^(table |[-|*•])"), "table").when(F.startswith(head, F.lit("figure ")), "figure").otherwise("narrative")


def is_cut_off(text: str | Column) -> Column:
    """Whether a paragraph stops in mid-sentence: at a hyphen or comma, an abbreviation, or a connecting word without a final mark."""
    t = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    tokens = F.transform(F.split(F.lower(t), r"\s+"), lambda x: F.regexp_replace(x, "[.,;:]+$", ""))
    last = F.element_at(tokens, -1)
    two = F.when(F.size(tokens) >= 2, F.concat(F.element_at(tokens, F.size(tokens) - 1), F.lit(" "), last))
    return (
        F.when(t == "", False).when(t.rlike("[-,]$"), True).when(last.isin(*ABBREVIATIONS) | F.coalesce(two.isin(*ABBREVIATIONS), F.lit(False)), True)
        .when(t.rlike("[.?!)\\]\"'»]$"), False).otherwise(last.isin(*CONNECTORS))
    )


def sentences(text: str | Column) -> Column:
    """The sentences of a text: it is cut after . ! or ? where white space follows; blank ones go."""
    marked = F.regexp_replace(_c(text), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def citation_line(pos: Column, pmcid: Column, te: Column, text: Column) -> Column:
    return F.concat(F.lit("[S"), pos.cast("string"), F.lit("|"), pmcid, F.lit("|"), te.cast("string"), F.lit("] "), text)


def parse_citation(ref: str | Column) -> Column:
    """(position, paper, element) of S<position>|<paper>|<element>; null if it is no such reference."""
    parts = F.split(_c(ref), r"\|")
    ok = _c(ref).rlike(r"^S\d+\|PMC[A-Za-z0-9_-]+\|\d+$")
    return F.when(ok, F.struct(F.expr(f"try_cast(substring({_name(ref)}, 2, instr({_name(ref)}, '|') - 2) as bigint)").alias("pos"), parts[1].alias("pmcid"), parts[2].cast("long").alias("te_id")))


def _name(ref: str | Column) -> str:
    if not isinstance(ref, str):
        raise TypeError("a column's name is expected")
    return ref


def strip_marker(name: str | Column) -> Column:
    """A name in lower case without the first expression marker that ends it."""
    n = F.lower(F.trim(_c(name)))
    out = n
    for m in reversed(MARKERS):
        out = F.when(F.endswith(n, F.lit(m)), F.substring(n, F.lit(1), F.length(n) - len(m))).otherwise(out)
    return out


def infer_direction(text: str | Column) -> Column:
    low = F.lower(_c(text))
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    return F.when(has(AGAINST), "negative").when(has(FOR), "positive").otherwise("unclear")


def scope_prefix(columns: dict[str, Column]) -> Column:
    """[scope: key=value | ...] of the fields that are not blank, and nothing if all are."""
    parts = [F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{k}="), F.trim(c.cast("string")))) for k, c in columns.items()]
    joined = F.concat_ws(" | ", *parts)
    return F.when(joined != "", F.concat(F.lit("[scope: "), joined, F.lit("] "))).otherwise("")


def joined_fields(*columns: Column) -> Column:
    """Fields that are not blank, joined by ' | ': what gets embedded."""
    return F.concat_ws(" | ", *(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def normal_claim(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", " "))


def safe_filename(name: str | Column, longest: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(_c(name), r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), 1, longest)


def numbers(text: str | Column) -> Column:
    """Numbers that begin a word: CD20 has none."""
    return F.regexp_extract_all(_c(text), F.lit(r"\b(\d+(?:\.\d+)?)"), 1)


def mentions(text: str | Column, kind: str) -> Column:
    """Numbers of the figures or tables a text mentions, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(rf"(?i){kind}(?:ure|le)?\.?\s+(\d+)"), 1))


def caption_number(text: str | Column) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract({_name(text)}, '(?i)^(?:fig(?:ure)?|tab(?:le)?)[.]?\\\\s+(\\\\d+)', 1), '') as bigint)")


def unrepeated(text: str | Column) -> Column:
    """A text that is one unit two to five times over, once."""
    t = _c(text)
    out = t
    for k in range(5, 1, -1):
        unit = F.substring(t, F.lit(1), (F.length(t) / k).cast("int"))
        out = F.when((F.length(t) > 0) & (F.length(t) % k == 0) & (F.repeat(unit, F.lit(k)) == t), unit).otherwise(out)
    return out


def keyword_hits(text: str | Column, words: list[str]) -> Column:
    low = F.lower(_c(text))
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def gene_like(text: str | Column, blocked: list[str]) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\b([A-Z][A-Z0-9]{2,6})\b"), 1)), F.array(*map(F.lit, blocked)) if blocked else F.array().cast("array<string>"))


def polarity(text: str | Column, window: int = 3) -> Column:
    """+1 or -1 if all polar words of a text agree, else 0. A negation among the `window` tokens before one turns it round, as does a leading non-."""
    tokens = F.split(F.trim(F.lower(_c(text))), r"\s+")

    def sign(t: Column, i: Column) -> Column:
        non = F.startswith(t, F.lit("non-"))
        bare = F.when(non, F.substring(t, F.lit(5), F.length(t))).otherwise(t)
        base = F.when(bare.isin(*UPWARD), 1).when(bare.isin(*DOWNWARD), -1).otherwise(0)
        before = F.slice(tokens, F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window)))
        return F.when(non | F.exists(before, lambda b: b.isin(*NEGATIONS)), -base).otherwise(base)

    signs = F.array_distinct(F.filter(F.transform(tokens, sign), lambda x: x != 0))
    return F.when(F.size(signs) == 1, signs[0]).otherwise(0)


def reason_code(reason: str | Column, patterns: dict[str, str]) -> Column:
    out: Column = F.lit("OTHER")
    for code, pattern in reversed(list(patterns.items())):
        out = F.when(_c(reason).rlike(pattern), code).otherwise(out)
    return out


def tolerant_double(text: str | Column) -> Column:
    """A number from text, null where there is none."""
    return F.expr(f"try_cast(nullif(trim({_name(text)}), '') as double)")


def mod_of_md5(key: Column, n: int) -> Column:
    """The md5 of a key, as a number of 128 bits, modulo n (Horner's rule over its hex digits)."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(key), i, F.lit(1))) - 1)
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % n)


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Jaccard similarity of two arrays as sets; what two empty ones give differs from use to use."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


#: How paragraphs begin that say nothing about a study (fixed values).
BOILERPLATE = ["copyright", "open access", "conflict of interest", "author contributions", "funding", "acknowledg", "received:", "correspondence"]


def is_relevant(text: str | Column) -> Column:
    """Whether a paragraph is worth reading: no boilerplate, byline, reference or link to one, and four words or more."""
    t = F.trim(_c(text))
    low = F.lower(t)
    boiler = reduce(lambda a, b: a | b, (F.startswith(low, F.lit(b)) for b in BOILERPLATE))
    byline = t.rlike(r"^(?:[A-Z][a-z]+ [A-Z]\.? [A-Z][a-z]+,? ?){2,}")
    link = low.rlike(r"crossref|doi\.org/10\.") | t.rlike(r"\d{4};\d+")
    return ~(boiler | byline | link | is_reference_entry(t)) & (F.size(F.split(t, r"\s+")) >= 4)


def numeric_contradiction(a: str | Column, b: str | Column, ratio: float = 2.0) -> Column:
    """Whether two texts have just one number each, above 0, and these differ by the ratio or more."""
    x, y = numbers(a), numbers(b)
    p, q = F.try_element_at(x, F.lit(1)).cast("double"), F.try_element_at(y, F.lit(1)).cast("double")
    return F.when((F.size(x) == 1) & (F.size(y) == 1) & (p > 0) & (q > 0), F.greatest(p, q) >= ratio * F.least(p, q)).otherwise(False)
