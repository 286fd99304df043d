"""Text functions: Column to Column, expressions that Catalyst sees; only cuts by tokens and overlaps pass through folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chars as C
from . import folds


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_of(x: Column | str) -> Column:
    """x, or the empty text for null."""
    return F.coalesce(col(x), F.lit(""))


def let(value: Column, f) -> Column:
    """f of value, worked out once: value is the only element of an array, and f sees that element.

    Inside a higher-order function an expression is worked out anew for each element; this binds it.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def exploded(df: DataFrame, array: str, pos: str, value: str) -> DataFrame:
    """df with a row for each element of array: its place and itself. Rows whose array is null or empty go.

    posexplode brings a filter on the array's size, which moves below what makes the array and runs its Python functions a second time;
    posexplode_outer brings none.
    """
    return df.select("*", F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def sub(x: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(x, F.lit(pattern), F.lit(to))


def found(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


#: What (?U)\s is: white space, Unicode's too.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space, Unicode's too, at both ends."""
    return F.btrim(x, F.lit(SPACES))


def rstrip(x: Column) -> Column:
    return F.rtrim(x, F.lit(SPACES))


def lstrip(x: Column) -> Column:
    return F.ltrim(x, F.lit(SPACES))


_OTHER_SPACES = SPACES.replace(" ", "")


def collapse(x: Column) -> Column:
    """Each run of white space as one space, none at the ends. Single spaces, nearly all of it, aren't replaced."""
    return F.trim(sub(x, rf"[{_OTHER_SPACES}][{SPACES}]*| [{SPACES}]+", " "))


# ---- cleaning ----------------------------------------------------------------------------------


def strip_markup(x: Column | str) -> Column:
    """Without <tags>, and &nbsp; as a space."""
    return F.replace(sub(text_of(x), "<[^>]+>"), F.lit("&nbsp;"), F.lit(" "))


def markup_counts(x: Column | str) -> Column:
    """struct(markup_tag_count, nbsp_entity_count)."""
    untagged = sub(text_of(x), "<[^>]+>")
    return F.struct(count(text_of(x), "<[^>]+>").alias("markup_tag_count"), count(untagged, "&nbsp;").alias("nbsp_entity_count"))


_PAIRS = (
    ("collapsed_cjk_spacing_count", rf"(?U)(?<=[{C.FAMILY}])\s+(?=[{C.FAMILY}])"),
    ("tightened_punctuation_spacing_count", rf"(?U)(?<=[{C.FAMILY}])\s+(?=[{C.TIGHT_PUNCTUATION}])"),
    ("tightened_bracket_spacing_count", rf"(?U)(?<=[{C.OPENING}])\s+(?=[{C.FAMILY}])"),
    ("tightened_punctuation_spacing_count", rf"(?U)\s+(?=[{C.TIGHT_PUNCTUATION}])"),
    ("tightened_bracket_spacing_count", rf"(?U)(?<=[{C.OPENING}])\s+"),
    ("tightened_bracket_spacing_count", rf"(?U)\s+(?=[{C.CLOSING}])"),
)


def tighten_spacing(x: Column | str) -> Column:
    """Without white space between CJK characters, before punctuation and inside CJK brackets; Latin words keep theirs.

    Lookaround removes in one pass what pairwise replacement needs several for.
    """
    out = text_of(x)
    for _, pattern in _PAIRS:
        out = sub(out, pattern)
    return out


def tighten_counts(x: Column | str) -> Column:
    """struct of how many gaps tighten_spacing takes out, by reason."""
    totals: dict[str, Column] = {}
    now = text_of(x)
    for name, pattern in _PAIRS:
        totals[name] = totals.get(name, F.lit(0)) + count(now, pattern)
        now = sub(now, pattern)
    return F.struct(*[v.alias(k) for k, v in totals.items()])


def normalize_body(x: Column | str, collapse_blank: bool = True) -> Column:
    """Line feeds only, no white space at line ends, at most one blank line (if collapse_blank), stripped."""
    out = sub(text_of(x), r"\r\n?", "\n")
    out = sub(out, r"(?U)[^\S\n]+(?=\n|\z)")
    out = sub(out, r"\n{3,}", "\n\n") if collapse_blank else out
    return strip(out)


def normalize_subtitle(x: Column | str) -> Column:
    """Text of subtitles: no markup, tidy lines, single spaces, tight CJK. A line feed between CJK characters goes too."""
    out = sub(normalize_body(strip_markup(x)), r"[ \t]+", " ")
    return strip(sub(tighten_spacing(out), r"\n{3,}", "\n\n"))


def needs_space(left: Column, right: Column) -> Column:
    """Whether two fragments are joined by a space: not inside brackets, before punctuation or beside CJK."""
    a, b = rstrip(left), lstrip(right)
    return ~(
        (a == "") | (b == "") | a.rlike(r"[(\[{\"'“‘「『《【]\z") | b.rlike(r"\A[,.;:!?，。！？、；：)\]}\"'”’」』）》】]") | a.rlike(rf"[{C.FAMILY}]\z") | b.rlike(rf"\A[{C.FAMILY}]")
    )


def joined_fragments(parts: Column) -> Column:
    """struct(text, inserted): an array of fragments as one text, spaced by needs_space, and how many spaces that put in; blank ones go."""
    clean = F.filter(F.transform(parts, lambda p: strip(strip_markup(p))), lambda p: p != "")

    def step(a: Column, p: Column) -> Column:
        spaced = (a["text"] != "") & needs_space(a["text"], p)
        return let(spaced, lambda s: F.struct(F.concat(a["text"], F.when(s, " ").otherwise(""), p).alias("text"), (a["inserted"] + s.cast("int")).alias("inserted")))

    return F.aggregate(clean, F.struct(F.lit("").alias("text"), F.lit(0).alias("inserted")), step)


def join_fragments(parts: Column) -> Column:
    """An array of fragments as one text; see joined_fragments."""
    return joined_fragments(parts)["text"]


def cue_line(x: Column | str) -> Column:
    """struct(text, inserted): one cue as one line, and the spaces put between its lines."""
    return let(joined_fragments(F.split(normalize_subtitle(x), "\n")), lambda j: F.struct(strip(j["text"]).alias("text"), j["inserted"].alias("inserted")))


def normalize_cue(x: Column | str) -> Column:
    """One cue as one line."""
    return cue_line(x)["text"]


def repair_confusables(token: Column) -> Column:
    """0, 1 and 5 as o, l and s inside a token of five characters or more that is nearly all letters."""
    digits, letters = F.length(sub(token, r"[^0-9]")), F.length(sub(token, r"[^A-Za-z]"))
    out = sub(token, r"(?<=[A-Za-z])0(?=[A-Za-z])", "o")
    out = sub(out, r"(?<=[a-z])1(?=[a-z])", "l")
    out = sub(out, r"(?<=[A-Za-z])5(?=[A-Za-z])", "s")
    out = sub(out, r"\A5(?=[A-Za-z]{3})", "s")
    out = sub(out, r"\A0(?=[A-Za-z]{4})", "o")
    return F.when((F.length(token) >= 5) & digits.between(1, 2) & (letters >= 3), out).otherwise(token)


def normalize_speech(x: Column | str, remove_repeated: bool = True) -> Column:
    """Recognised speech: no spaces between ideographs or before CJK marks, confusable tokens repaired, repeated phrases once."""
    out = sub(text_of(x), rf"(?U)(?<=[{C.BASIC_IDEOGRAPH}])\s+(?=[{C.BASIC_IDEOGRAPH}])")
    out = sub(out, rf"(?U)\s+(?=[{C.SPEECH_PUNCTUATION}])")
    marked = F.split(sub(out, r"(?U)\b([A-Za-z0-9]{5,})\b", "\u0001$1\u0001"), "\u0001")
    out = F.array_join(F.transform(marked, lambda p, i: F.when(i % 2 == 1, repair_confusables(p)).otherwise(p)), "")
    return strip(sub(out, rf"([{C.BASIC_IDEOGRAPH}]{{3,20}})\1{{1,5}}", "$1") if remove_repeated else out)


# ---- tokens, sentences, splits -----------------------------------------------------------------

WORD = r"[A-Za-z0-9]+(?:['\-][A-Za-z0-9]+)*"


def quarter_up(n: Column) -> Column:
    return F.floor((n + 3) / 4)


def estimate_tokens(x: Column | str, mode: str = "tokens") -> Column:
    """Estimated tokens: one for a CJK character, a quarter of each word's length, a quarter of all other marks; at least 1.

    Empty text has none. mode ``chars``: the number of characters.
    """
    t = text_of(x)
    if mode == "chars":
        return F.length(t).cast("long")
    family = F.length(sub(t, rf"[^{C.FAMILY}]"))
    words = F.aggregate(found(t, WORD), F.lit(0).cast("long"), lambda a, w: a + quarter_up(F.length(w)))
    rest = F.length(sub(sub(t, WORD), rf"(?U)[\s{C.FAMILY}]"))
    return F.when(t == "", F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), family + words + quarter_up(rest))).cast("long")


#: Ends of sentences: CJK and Latin marks; full stops but in ellipses, decimals, initials, acronyms and titles. What stands
#: before a full stop is only looked at where there is one.
_END = (
    r"(?:[。！？!?]|(?=\.)(?<!\d(?=\.\d))(?<!\p{L}(?=\.\p{L}\.))\.(?!\.)"
    r"(?!(?<=\b[A-Za-z]\.[A-Za-z]\.)\s?\p{Ll})"
    r"(?!(?<=(?i:(?<![A-Za-z])(?:mr|mrs|ms|dr|prof|sr|jr|st)\.))\s?\p{Lu}))"
    r"[”\"'’」)\]}]*"
)


def split_sentences(x: Column | str) -> Column:
    """Array of the sentences of a text, stripped, white space collapsed."""
    marked = sub(collapse(text_of(x)), _END, "$0\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")  # collapsed: no other white space is left


def hard_split(x: Column | str, size: int) -> Column:
    """Pieces of size characters, stripped, blank ones left out."""
    t = text_of(x)
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: strip(F.substr(t, i, F.lit(size)))), lambda p: p != "")


def split_by_tokens(x: Column | str, size: int) -> Column:
    """Pieces, from the left, each as long as its estimate stays within size; stripped, blank ones left out. See folds.cut_by_tokens."""
    t = text_of(x)
    return F.get(folds.pieces_of(F.array(t), F.array(F.lit(size + 1)), size), F.lit(0))


def truncate_tail(x: Column | str, size: int) -> Column:
    """The last of split_by_tokens; with size 0 or less the stripped text."""
    return strip(text_of(x)) if size <= 0 else F.coalesce(F.try_element_at(split_by_tokens(strip(text_of(x)), size), F.lit(-1)), F.lit(""))


def tail_sentences(x: Column | str, k: int, size: int = 0) -> Column:
    """The last k sentences, joined by spaces, cut by truncate_tail if size is given."""
    sentences = split_sentences(x)
    tail = F.array_join(F.slice(sentences, F.greatest(F.size(sentences) - k + 1, F.lit(1)), F.lit(k)), " ")
    return truncate_tail(tail, size) if size > 0 else tail


def last_section_title(x: Column | str) -> Column:
    """Title of the last ``## `` heading, or the empty text."""
    titles = F.regexp_extract_all(text_of(x), F.lit(r"(?m)^##\s+(.+?)\s*$"), F.lit(1))
    return F.coalesce(F.try_element_at(titles, F.lit(-1)), F.lit(""))


# ---- overlaps ----------------------------------------------------------------------------------


def meaningful_length(x: Column, punctuation: str = C.OVERLAP_PUNCTUATION) -> Column:
    """Characters that are neither white space nor punctuation."""
    return F.length(sub(x, rf"(?U)[\s{punctuation}]"))


def is_meaningful(x: Column) -> Column:
    """Whether an overlap says something: 2 characters of CJK text; else two words or 8 characters."""
    t = strip(x)
    alike = t.rlike(rf"[\p{{L}}\p{{N}}{C.FAMILY}]")
    return alike & F.when(t.rlike(f"[{C.FAMILY}]"), meaningful_length(t) >= 2).otherwise((F.size(F.split(t, r"(?U)\s+")) >= 2) | (F.length(t) >= 8))


def leading_overlap(previous: Column | str, current: Column | str) -> Column:
    """The longest beginning of current that previous ends with and that is_meaningful; else empty.

    Candidate lengths are found in one pass over both, so the costlier test of meaning runs on few.
    """
    a, b = rstrip(text_of(previous)), lstrip(text_of(current))

    def longest(p: Column) -> Column:
        said = F.filter(p["n"], lambda n: is_meaningful(F.left(p["b"], n)))
        return F.left(p["b"], F.coalesce(F.get(said, F.lit(0)), F.lit(0)))

    return let(F.struct(b.alias("b"), folds.shared_lengths(a, b).alias("n")), longest)


def leading_overlap_in_fold(previous: Column, current: Column) -> Column:
    """leading_overlap for use inside higher-order functions, where no Arrow function can stand.

    Only places where previous has the first characters of current are compared further.
    """

    def longest(p: Column) -> Column:
        a, b, head = p["a"], p["b"], F.left(p["b"], F.lit(8))
        most = F.least(F.length(a), F.length(b))
        lengths = F.when(most > 0, F.sequence(most, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        near = F.filter(lengths, lambda n: F.substr(a, F.length(a) - n + 1, F.least(n, F.lit(8))) == F.left(head, n))
        said = F.filter(near, lambda n: F.endswith(a, F.left(b, n)) & is_meaningful(F.left(b, n)))
        return F.left(b, F.coalesce(F.get(said, F.lit(0)), F.lit(0)))

    return let(F.struct(rstrip(text_of(previous)).alias("a"), lstrip(text_of(current)).alias("b")), longest)


def trim_overlap(previous: Column | str, current: Column | str) -> Column:
    """struct(text, overlap_trimmed, collapsed_to_empty, overlap_chars): current without its leading overlap."""
    def cut(p: Column) -> Column:
        b, n = p["b"], p["n"]
        rest = F.when(n > 0, lstrip(F.substr(b, n + 1))).otherwise(b)
        return F.struct(rest.alias("text"), (n > 0).alias("overlap_trimmed"), (rest == "").alias("collapsed_to_empty"), n.alias("overlap_chars"))

    return let(strip(text_of(current)), lambda b: let(F.struct(b.alias("b"), F.length(leading_overlap_in_fold(previous, b)).alias("n")), cut))


# ---- names, dates, escapes ---------------------------------------------------------------------


def sanitize_filename(x: Column | str, most: int = 200) -> Column:
    return F.left(F.btrim(sub(text_of(x), r'[/\\:*?"<>|]', "_"), F.lit(" .")), F.lit(most))


def compact_dates(x: Column | str) -> Column:
    """Array of the yyyymmdd in a text that stand alone and are real dates."""
    return F.filter(found(text_of(x), r"(?<![A-Za-z0-9])\d{8}(?![A-Za-z0-9])"), lambda d: F.try_to_date(d, "yyyyMMdd").isNotNull())


def frontmatter_date(x: Column | str) -> Column:
    """yyyymmdd as yyyy-mm-dd if it is a real date, else unchanged."""
    t = text_of(x)
    return F.when(t.rlike(r"\A\d{8}\z"), F.coalesce(F.date_format(F.try_to_date(t, "yyyyMMdd"), "yyyy-MM-dd"), t)).otherwise(t)


def yaml_scalar(x: Column | str) -> Column:
    """As a double-quoted scalar with JSON's escapes."""
    inner = F.regexp_extract(F.to_json(F.struct(text_of(x).alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)
    return inner


def escape_markdown(x: Column | str) -> Column:
    return sub(text_of(x), r"([\\`*_{}\[\]()#+!<>|])", r"\\$1")


def encode_url(x: Column | str) -> Column:
    """Percent-encoded but for the characters that URLs use as they are."""
    out = F.replace(F.url_encode(text_of(x)), F.lit("+"), F.lit("%20"))
    for c in ":/?&=#%~+,@":
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


# ---- quality -----------------------------------------------------------------------------------
# Fixed values, from here to the lenient types: the patterns, word lists and limits of the checks.


def quality_tokens(x: Column | str) -> Column:
    """Latin words in lower case and single CJK characters."""
    return F.transform(found(text_of(x), rf"[A-Za-z0-9]+|[{C.FAMILY}]"), F.lower)


def visible_length(x: Column | str) -> Column:
    return F.length(sub(text_of(x), r"(?U)\s"))


def family_length(x: Column | str) -> Column:
    return F.length(sub(text_of(x), rf"[^{C.FAMILY}]"))


def has_family(x: Column | str, least: int) -> Column:
    """Whether a text has so many CJK characters; the rest of it isn't copied, as family_length does."""
    return text_of(x).rlike(rf"(?:[{C.FAMILY}][^{C.FAMILY}]*+){{{least}}}")


def punctuation_length(x: Column | str) -> Column:
    return F.length(sub(text_of(x), f"[^{C.QUALITY_PUNCTUATION}]"))


def looks_truncated(x: Column | str) -> Column:
    """Whether a last line seems cut off."""
    t = strip(text_of(x))
    more = lambda a, b: F.length(sub(t, f"[^{a}]")) > F.length(sub(t, f"[^{b}]"))
    unbalanced = more(r"(", r")") | more("（", "）") | more(r"\[", r"\]") | more("{", "}") | more("“", "”") | more("‘", "’") | (F.length(sub(t, '[^"]')) % 2 == 1)
    ended = t.rlike(r"[.!?。！？*`\")）」>\-:：]\z") | t.startswith("#") | (F.length(t) < 10)
    unfinished = t.rlike(r"[，,、；;—-]\z") | t.rlike(r"(?i)(?:and|or|but|because|so|to|with|for|of|in|on|at|by|the|a|an)\z") | t.rlike(r"(?:的|了|和|与|并|但|而|及|在|把|将|对|让|给|从|向|为|等)\z")
    return F.when(t == "", True).when(ended, False).when(unfinished | unbalanced, True).otherwise((F.length(t) > 120) & t.rlike(r"[\p{L}\p{N}]\z"))


def blocks(x: Column | str) -> Column:
    """Array of the blocks between blank lines, stripped."""
    return F.filter(F.transform(F.split(normalize_body(x, False), r"\n\s*\n"), strip), lambda b: b != "")


SEAM = "<!-- loomtext-chunk-seam -->"


def block_type(b: Column) -> Column:
    """empty, seam, hr, code, heading, quote, list or body."""
    lines = F.filter(F.transform(F.split(b, "\n"), strip), lambda s: s != "")
    first, one = F.get(lines, F.lit(0)), F.size(lines) == 1
    return (
        F.when(F.size(lines) == 0, "empty")
        .when(one & (first == SEAM), "seam")
        .when(one & first.rlike(r"\A-{3,}\z"), "hr")
        .when(first.startswith("```") | first.startswith("~~~"), "code")
        .when(F.forall(lines, lambda s: s.startswith("#")), "heading")
        .when(F.forall(lines, lambda s: s.startswith(">")), "quote")
        .when(first.rlike(r"\A(?:[-*+]\s|\d+\.\s)"), "list")
        .otherwise("body")
    )


def is_titleish(x: Column) -> Column:
    """Whether a line of ASCII words looks more like a heading than like a fragment."""
    t = strip(x)
    words = found(t, r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?")
    titled = F.size(F.filter(words, lambda w: w.rlike(r"\A[A-Z]") | (w.rlike("[A-Z]") & ~w.rlike("[a-z]"))))
    return (t != "") & ~t.contains("\n") & ~t.rlike(r"[.!?,:;]") & F.size(words).between(1, 6) & (titled >= F.greatest(F.lit(1), F.size(words) - 1))


def is_incomplete(x: Column) -> Column:
    """Whether a body block looks like one half of a split paragraph."""
    t = rstrip(x)
    words = F.size(found(t, r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"))
    return (
        F.when((t == "") | t.rlike(r"[。！？!?；;]\z") | t.rlike(r"\A(?:[-*+]\s|\d+\.\s|#|>)"), False)
        .when(t.rlike(r"[，、；：,:(\[{（【《「『-]\z"), True)
        .when(t.rlike(f"[{C.FAMILY}]"), ~t.rlike("[，。！？；：,:;!?]") & (meaningful_length(t) >= 8))
        .when(words > 0, (words >= 3) & ~is_titleish(t) & (F.length(t) >= 12))
        .otherwise(F.length(t) >= 16)
    )


def is_fragment(x: Column) -> Column:
    """Whether a paragraph is a short fragment of CJK subtitles."""
    t = strip(x)
    n = meaningful_length(t, C.QUALITY_PUNCTUATION)
    return (t != "") & ~t.rlike(r"\A(?:[-*+]\s|\d+\.\s)") & (family_length(t) >= 4) & ((n <= 10) | ((n <= 22) & ~t.rlike(r"[。！？!?；;]\z")))


def is_strong_quality_overlap(x: Column) -> Column:
    t = strip(x)
    n = meaningful_length(t, C.QUALITY_PUNCTUATION)
    return (t != "") & F.when(t.rlike(f"[{C.FAMILY}]"), n >= 4).otherwise((n >= 12) & (F.size(quality_tokens(t)) >= 3))


def is_strong_seam(x: Column) -> Column:
    t = strip(x)
    ended = t.contains("\n") | t.rlike(r"[。！？!?；;]\z")
    n = meaningful_length(t)
    return (t != "") & F.when(t.rlike(f"[{C.FAMILY}]"), (n >= 4) & ended).otherwise((n >= 12) & (ended | (F.size(F.split(t, r"(?U)\s+")) >= 3)))


# ---- lenient types -----------------------------------------------------------------------------


def lenient_long(x: Column | str, default: int = 0) -> Column:
    return F.coalesce(col(x).try_cast("bigint"), F.lit(default))


def lenient_double(x: Column | str) -> Column:
    return col(x).try_cast("double")


def lenient_bool(x: Column | str, default: bool = False) -> Column:
    t = F.lower(F.btrim(col(x)))
    return F.when(t.isin("1", "true", "yes", "on", "y"), True).when(t.isin("0", "false", "no", "off", "n"), False).otherwise(F.lit(default))
