"""Text preparation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A word: letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
#: Where a page prints its number, in the order in which the patterns are tried.
PAGE_NUMBER = (r"(?:^|\n)\s*(\d{1,4})\s*(?:\n|$)", r"(?i)\bpage\s+(\d{1,4})(?:\s+of\s+\d+)?\b", r"[-–—]\s*(\d{1,4})\s*[-–—]")
PAGE_ZONE = 300
#: What makes a text's shape.
LEGAL_HEADER = r"^\s*(SECTION\.?\s*\d+|Article\s+[IVXLC]+|AMENDMENT\s+[IVXLC0-9]+)\b"
NUMBERED_HEADER = r"^\s{0,3}(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+[A-Z][A-Za-z]"
CODE_MARK = r"```|^\s{4,}\S|^\t\S"
EQUATION_MARK = r"[∑∫∏√≤≥≈±∞∂∇]|\\[a-zA-Z]+\{|\$[^$.!?\n]{1,40}[=+\-*/^_\\][^$.!?\n]{0,40}\$"
#: Names of chunk kinds.
KINDS = {"raw": ["child", "leaf", "raw", "chunk"], "parent": ["parent", "section", "chapter", "paragraph"], "summary": ["summary", "raptor_summary", "abstract"]}


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """At most one empty line in a row, single spaces, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " +", " "))


def tokens(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least; none for an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4.0))).cast("long")


def printed_page(text: Column, physical: Column) -> Column:
    """The number that a page prints in its first or last 300 characters, if it is 1 to 9999; else its place in the file."""
    t = F.coalesce(text, F.lit(""))
    zones = (F.substring(t, 1, PAGE_ZONE), F.right(t, F.lit(PAGE_ZONE)))
    found = [F.regexp_extract(zone, pattern, 1).try_cast("int") for zone in zones for pattern in PAGE_NUMBER]
    return F.coalesce(*(F.when(n.between(1, 9999), n) for n in found), physical)


def sentences(text: Column) -> Column:
    """Cut after . ! or ? and white space."""
    return F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+")


def units(text: Column, longer_than: int = 10) -> Column:
    """Stripped sentences of more than ten characters; without any, the whole text."""
    kept = F.filter(F.transform(sentences(text), strip), lambda s: F.length(s) > longer_than)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.coalesce(text, F.lit(""))))


def chunk_kind(kind: Column) -> Column:
    """raw, parent or summary for their many names; nothing is raw, other names stay."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    out = F.when(low == "", "raw")
    for name, names in KINDS.items():
        out = out.when(low.isin(names), name)
    return out.otherwise(low)


def text_shape(text: Column) -> Column:
    """How a text is built: legal clauses, numbered sections, code, equations or prose."""
    t = F.coalesce(text, F.lit(""))
    count = lambda p, flags: F.regexp_count(t, F.lit(f"(?{flags}){p}"))
    equations = count(EQUATION_MARK, "U") >= 4
    return (
        F.when(strip(t) == "", "empty").when(count(LEGAL_HEADER, "mU") >= 2, "legal_clause")
        .when(count(NUMBERED_HEADER, "mU") >= 3, F.when(equations, "numbered_spec_academic").otherwise("numbered_spec"))
        .when(t.rlike(f"(?mU){CODE_MARK}"), "code_heavy").when(equations, "academic_dense").otherwise("prose")
    )


def structural_units(text: Column, shape: Column) -> Column:
    """A text cut before each header of its shape, stripped, without empty pieces."""
    t = F.coalesce(text, F.lit(""))
    cut = lambda p: F.filter(F.transform(F.split(t, f"(?mU)(?={p})"), strip), lambda u: u != "")
    return F.when(shape == "legal_clause", cut(LEGAL_HEADER)).when(shape.startswith("numbered_spec"), cut(NUMBERED_HEADER)).otherwise(F.array(t))


def text_hash(*parts: Column) -> Column:
    """SHA-256 of parts, each ended by a zero byte."""
    return F.sha2(F.concat(*(F.concat(F.coalesce(p.cast("string"), F.lit("")).cast("binary"), F.unhex(F.lit("00"))) for p in parts)), 256)


def safe_name(text: Column) -> Column:
    """A document id from a file name: lower case, spaces as underscores."""
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))


def page_of_chunk(chunk_id: Column) -> Column:
    """The page number in a chunk's id, else 0."""
    return F.coalesce(F.regexp_extract(chunk_id, r"page_(\d+)", 1).try_cast("int"), F.lit(0))


def host(url: Column) -> Column:
    """The url's host without www., lower-cased; null without one."""
    return F.regexp_replace(F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))), r"^www\.", "")


def salvaged_json(text: Column, schema: str) -> Column:
    """A struct from a model's reply: the whole reply without code fences, else what stands from its first brace to its last."""
    bare = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^```(?:json)?\s*$|^```(?:json)?|```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), F.from_json(c, schema))
    return F.coalesce(valid(bare), valid(inner))


def first_code_block(text: Column) -> Column:
    """The inside of the first fenced block; empty without one."""
    return F.regexp_extract(text, r"(?s)```[a-zA-Z]*\n(.*?)```", 1)
