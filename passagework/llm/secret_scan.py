"""Secrets in texts by patterns and by sliding-window entropy, on built-in functions only (operator 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The base kinds in order, each with its pattern, the group that is measured and its least length.
#: A run of characters that is too short fails from its start on, so that its least length can stand in the pattern.
BASE_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What entropy is measured on: long runs of the characters of encoded keys.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Character classes (first that fits) and the bits a character that a window must reach. Windows of 20 hold 4.32 at most.
CLASSES = ((r"^[0-9a-fA-F]+$", 3.05), (r"^[A-Za-z0-9]+$", 3.65), (r"", 3.85))
#: Candidates that are no secrets: UUIDs, words, placeholders, alphabets in order, one character over and over. No pattern
#: repeats a group, as java.util.regex needs a stack frame for each turn of one.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]?[a-z]+$|^[A-Z]+$",
    r"(?i)example|placeholder|changeme|dummy|x{6}",
    r"(?i)abcdefghij|0123456789",
    r"^(.)\1*$",
)
#: Joined words are none either: candidates without a digit, a padding sign or a capital inside a word.
UNLIKE_WORDS = r"[^A-Za-z/_+-]|[A-Za-z][A-Z]"
#: Characters of a candidate or of a text that one step holds at a time.
PIECE = 1024
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="


def _sql(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else 'r"' + text.replace('"', r"\x22") + '"'


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
_NONE = f"cast(array() AS {_SPANS})"


def _with(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for ``value``, which is computed once. (A column that a lambda names may be computed each turn.)"""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, step: str) -> str:
    """SQL: the running sums or maxima of an array, by doubling: each turn takes in (``step``) what stands 1, 2, 4, ... before."""
    turns = f"if(size({values}) < 2, cast(array() AS array<int>), sequence(0, cast(ceil(log2(size({values}))) AS int) - 1))"
    return f"aggregate({turns}, {values}, (s, k) -> transform(s, (v, i) -> if(i < shiftleft(1, k), v, {step.format('s[i - shiftleft(1, k)]')})))"


def _found(text: str, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans (start, kind, end, value) of the pattern's matches, leftmost first, whose group is long enough.

    split() gives the text between the matches and regexp_extract_all() the matches, so that running sums of their lengths
    are the places, in code points. Texts without a match stop at the first test.
    """
    p = _sql(pattern)
    lengths = "transform(m.hits, (hit, i) -> length(m.gaps[i]) + length(hit))"
    spans = _with(
        "m",
        f"named_struct('hits', regexp_extract_all({text}, {p}, 0), 'gaps', split({text}, {p}, -1), 'values', regexp_extract_all({text}, {p}, {group}))",
        _with(
            "ends",
            _with("lengths", lengths, _running("lengths", "v + {}")),
            f"""filter(transform(m.hits, (hit, i) -> named_struct('start', ends[i] - length(hit), 'kind', {kind}, 'end', ends[i], 'value', m.values[i])),
                x -> length(x.value) >= {least})""",
        ),
    )
    return F.when(F.col(text).rlike(pattern), F.expr(spans)).otherwise(F.expr(_NONE))


def _entropy(text: str, window: int) -> str:
    """SQL: the highest entropy in bits a character over windows of ``text``, a candidate's piece.

    Entropy is log2(w) - sum(c * log2(c)) / w over the counts c of a window's characters. A step takes one character
    in and one out, which changes two counts and two terms of the sum. The counts are one string, whose character at a
    letter's place has its count over '0' as its code.
    """
    term = lambda c: f"if({c} < 2, 0D, ({c}) * log2({c}))"
    count = lambda of, place: f"(ascii(substring({of}, {place}, 1)) - 48)"
    put = lambda of, place, by: f"overlay({of} PLACING char(48 + {by}) FROM {place} FOR 1)"
    come = _with(
        "n", count("s.counts", "x.come"), f"named_struct('counts', {put('s.counts', 'x.come', 'n + 1')}, 'sum', s.sum + {term('n + 1')} - {term('n')}, 'go', x.go, 'low', s.low)"
    )
    gone = _with("n", count("y.counts", "y.go"), f"named_struct('counts', {put('y.counts', 'y.go', 'n - 1')}, 'sum', y.sum + {term('n - 1')} - {term('n')}, 'low', y.low)")
    gone = f"if(y.go = 0, named_struct('counts', y.counts, 'sum', y.sum, 'low', y.low), {gone})"
    lowest = f"named_struct('counts', t.counts, 'sum', t.sum, 'low', if(x.i + 1 >= {window}, least(t.low, t.sum), t.low))"
    codes = f"transform(split({text}, ''), c -> instr('{_ALPHABET}', c))"
    steps = f"transform(codes, (c, i) -> named_struct('i', i, 'come', c, 'go', if(i >= {window}, codes[i - {window}], 0)))"
    whole = f"aggregate({steps}, named_struct('counts', repeat('0', {len(_ALPHABET)}), 'sum', 0D, 'low', 1e9D), (s, x) -> {_with('t', _with('y', come, gone), lowest)}, s -> log2({window}) - s.low / {window})"
    return _with("codes", codes, whole)


def _entropy_spans(candidates: str, base: str, window: int) -> Column:
    """Candidates outside the base spans that the allow-list doesn't name and whose class's threshold a window reaches.

    Candidates don't overlap each other. So in the sorted spans, one is outside all base spans if those before it end
    by its start and what stands next to it starts no earlier than its end.
    """
    ends = _running("ends", "greatest(v, {})")
    apart = f"filter(transform(q.spans, (x, i) -> if(x.kind < {len(BASE_KINDS)} or (i > 0 and q.ends[i - 1] > x.start) or coalesce(get(q.spans, i + 1).start < x.end, false), null, x)), x -> x is not null)"
    apart = _with(
        "q", _with("spans", f"array_sort(concat({base}, {candidates}))", f"named_struct('spans', spans, 'ends', {_with('ends', f'transform(spans, x -> if(x.kind < {len(BASE_KINDS)}, x.end, 0))', ends)})"), apart
    )
    allowed = " or ".join(f"x.value rlike {_sql(p)}" for p in ALLOWED) + f" or not x.value rlike {_sql(UNLIKE_WORDS)}"
    threshold = "case " + " ".join(f"when x.value rlike {_sql(p)} then {bits}D" for p, bits in CLASSES[:-1]) + f" else {CLASSES[-1][1]}D end"
    pieces = f"transform(cut, (c, i) -> if(i = 0, c, concat(right(cut[i - 1], {window - 1}), c)))"  # each window lies in one piece
    reaches = _with("cut", f"regexp_extract_all(x.value, '.{{1,{PIECE}}}', 0)", _with("least", threshold, f"exists({pieces}, piece -> {_entropy('piece', window)} >= least)"))
    return F.when(F.size(candidates) > 0, F.expr(f"filter(if(size({base}) = 0, {candidates}, {apart}), x -> not ({allowed}) and {reaches})")).otherwise(F.expr(_NONE))


def secret_spans(docs: DataFrame, text_col: str = "text", window: int = 20, base_col: str = "base_spans", extra_col: str = "extra_spans") -> DataFrame:
    """``docs`` and two arrays of spans (start, kind, end, value), each sorted; columns of those names, in any case of letters, are replaced.

    Kinds 0 to 2 are BASE_KINDS, 3 is entropy. Places are code points, the end exclusive. A null text counts as empty
    and has no spans; nulls elsewhere, repeated rows and other columns stay; an empty table gives no rows. Each row
    stands alone, so that nothing is shuffled and a hot source is no hot task. The work grows with a text's length and,
    but for a logarithm, with its matches.
    """
    own = "_s"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    kept = [c for c in docs.columns if c.lower() not in (base_col.lower(), extra_col.lower())]
    text, base, candidates = f"{own}text", f"{own}base", f"{own}candidates"
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(text_col), F.lit("")).alias(text))
    kinds = [_found(text, i, pattern, group, least).alias(f"{own}{name}") for i, (name, pattern, group, least) in enumerate(BASE_KINDS)]
    rows = rows.select("*", *kinds, _found(text, len(kinds), CANDIDATE, 0, window).alias(candidates))
    rows = rows.withColumn(base, F.array_sort(F.concat(*(f"{own}{name}" for name, *_ in BASE_KINDS))))
    return rows.select(*(F.col(f"`{c}`") for c in kept), F.col(base).alias(base_col), _entropy_spans(candidates, base, window).alias(extra_col))


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{name}'" for name, *_ in BASE_KINDS) + ", 'entropy'"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.kind], x.start, x.end)), ',')")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): secret_spans() as counts, a digest and one string."""
    found = secret_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    counts = [F.expr(f"cast(size(filter(base_spans, x -> x.kind = {i})) AS bigint)").alias(f"n_{name}") for i, (name, *_) in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("array_sort(concat(base_spans, extra_spans))").alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span of the text replaced by ``mark``; spans that overlap become one mark.

    The text's column is found whatever the case of its name. A null text stays null; all other columns stay. The kept parts are cut from pieces of the text, so that the work grows
    with the text, not with its length times its spans.
    """
    text_col = text_col if text_col in docs.columns else next((c for c in docs.columns if c.lower() == text_col.lower()), text_col)
    base, extra = "_base_spans", "_extra_spans"
    while {base, extra} & {c.lower() for c in docs.columns}:
        base, extra = f"_{base}", f"_{extra}"
    found = secret_spans(docs, text_col, base_col=base, extra_col=extra)
    # each mark's gap before it: from the greatest end so far to a start that is not before it
    cut = f"regexp_extract_all(`{text_col}`, '(?s).{{1,{PIECE}}}', 0)"
    of = lambda x: f"cast({x} div {PIECE} AS int)"  # noqa: E731  the piece that holds code point x

    def part(a: str, b: str) -> str:
        """SQL: code points a to b, from the pieces that hold them."""
        first, last = f"substring(t.cut[{of(a)}], {a} % {PIECE} + 1)", f"if({b} % {PIECE} = 0, '', substring(t.cut[{of(b)}], 1, {b} % {PIECE}))"
        between = f"array_join(slice(t.cut, {of(a)} + 2, {of(b)} - {of(a)} - 1), '')"
        return f"if({a} = {b}, '', if({of(a)} = {of(b)}, substring(t.cut[{of(a)}], {a} % {PIECE} + 1, {b} - {a}), concat({first}, {between}, {last})))"

    gaps = "filter(transform(t.spans, (x, i) -> named_struct('a', if(i = 0, 0, t.ends[i - 1]), 'b', x.start)), g -> g.a <= g.b)"
    spans = _with("spans", f"array_sort(concat({base}, {extra}))", f"named_struct('cut', {cut}, 'n', length(`{text_col}`), 'spans', spans, 'ends', {_with('ends', 'transform(spans, x -> x.end)', _running('ends', 'greatest(v, {})'))})")
    tail = _with("a", "t.ends[size(t.ends) - 1]", part("a", "t.n"))
    clean = F.expr(_with("t", spans, f"array_join(concat(transform({gaps}, g -> {part('g.a', 'g.b')}), array({tail})), '{mark}')"))
    changed = F.when((F.size(base) > 0) | (F.size(extra) > 0), clean).otherwise(F.col(text_col))
    return found.select(*(changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
