"""Text projections and predicates (N1-N13) as built-in column expressions.

Every function takes column(s) and returns a column; nothing here leaves the
JVM.  Lengths are code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plane() -> Iterator[str]:
    return (chr(c) for c in range(0x80, 0xFFFE) if not 0xD800 <= c < 0xE000)


def _base(letter: str) -> str:
    """The letter under the accents of a lower-case letter, or the letter."""
    parts = unicodedata.normalize("NFKD", letter)
    marked = len(parts) > 1 and all(unicodedata.combining(m) for m in parts[1:])
    return parts[0] if marked and parts[0].isalpha() else letter


# Characters whose compatibility form is one other character.
COMPATIBLE = {c: n for c in _plane() if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c}
FULLWIDTH, HALFWIDTH = "".join(COMPATIBLE), "".join(COMPATIBLE.values())
WIDE_BLANKS = " " + "".join(chr(c) for c in range(0x2000, 0x200B)) + "  　"
# Characters whose compatibility form is several characters: three dots, Latin
# ligatures and Roman numerals.
LIGATURES = {
    c: unicodedata.normalize("NFKC", c)
    for c in ["…", *map(chr, range(0xFB00, 0xFB07)), *map(chr, range(0x2160, 0x2180))]
    if len(unicodedata.normalize("NFKC", c)) > 1
}
# Accented letters and their base letters (search folding).
FOLDED = {c: _base(c) for c in _plane() if c.islower() and _base(c) != c}
ACCENTED, UNACCENTED = "".join(FOLDED), "".join(FOLDED.values())

# Supersets of the characters with a compatibility form, of wide characters with their
# marks, and of the accented letters, in few ranges: a text without any of them needs
# no look at each character.
COMPATIBLE_CLASS = "[\\x{A0}-\\x{BF}\\x{17F}-\\x{FFFF}]"
WIDE_CLASS = "[\\x{200B}-\\x{10FFFF}]"
ACCENTED_CLASS = "[\\x{E0}-\\x{FFFF}]"

# Sentence marks and CJK punctuation of the clean-up rules.
MARKS = "。！？.!?；;：:"
CJK_PUNCT = "，。！？；：“”‘’（）【】"
CJK_PUNCT_WIDE = "，。！？；：、‘’“”（）《》〈〉"
BLANKS = " \t\n\r\f\x0b"

HAN = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}"
ALNUM = "\\p{L}\\p{M}\\p{N}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of blank, line breaks included, from both ends."""
    return F.btrim(col(c), F.lit(BLANKS))


def nfkc(c: Column | str) -> Column:
    """Compatibility forms that occur in page text: width, blanks, ligatures.

    One ``translate`` for the one-to-one part; one plain ``replace`` per
    character that becomes several, where the text has any of them.
    """

    def spelled(x: Column) -> Column:
        out = x
        for source, target in LIGATURES.items():
            out = F.replace(out, F.lit(source), F.lit(target))
        return F.when(x.rlike(f"[{''.join(LIGATURES)}]"), out).otherwise(x)

    return bound(col(c), lambda x: F.when(
        x.rlike(COMPATIBLE_CLASS), bound(nfkc_same_length(x), spelled)).otherwise(x))


def nfkc_same_length(c: Column | str) -> Column:
    """Only the one-to-one part, so positions stay those of the input."""
    return F.translate(col(c), FULLWIDTH + WIDE_BLANKS, HALFWIDTH + " " * len(WIDE_BLANKS))


def normalize_text(c: Column | str) -> Column:
    """N1. Look-around makes the CJK blank removal a single pass."""
    cjk = f"[\\p{{IsHan}}{CJK_PUNCT}]"

    def closed(x: Column) -> Column:
        t = F.translate(x, "​⁠", "")
        return F.regexp_replace(t, f"(?=\\s)(?<={cjk})\\s+(?={cjk})", "")

    t = bound(nfkc(c), lambda x: F.when(x.rlike(WIDE_CLASS), closed(x)).otherwise(x))
    return strip(F.regexp_replace(join_wrapped_lines(t), "[ \\t]{2,}|\\t", " "))


def join_wrapped_lines(c: Column | str) -> Column:
    """Undo line wraps: drop the hyphen of a broken word, keep one line break
    after a sentence mark, turn the others into blanks, at most two in a row.

    Patterns test the blank before the look-behind, which most positions then
    never reach.
    """

    def joined(x: Column) -> Column:
        t = bound(x, lambda y: F.when(
            F.contains(y, F.lit("-")), F.regexp_replace(y, "-(?<=\\p{L}-)\\s*\\n\\s*(?=\\p{L})", "")
        ).otherwise(y))
        t = F.regexp_replace(t, f"(?=\\s)(?<=[{MARKS}])\\s*\\n\\s*", "\n")
        t = F.regexp_replace(t, f"(?=\\s)(?<![{MARKS}])\\s*\\n\\s*(?=\\S)", " ")
        return bound(t, lambda y: F.when(
            F.contains(y, F.lit("\n\n\n")), F.regexp_replace(y, "\\n{3,}", "\n\n")).otherwise(y))

    return bound(col(c), lambda x: F.when(F.contains(x, F.lit("\n")), joined(x)).otherwise(x))


def remove_spurious_spaces(c: Column | str) -> Column:
    """N2. Blanks between CJK characters or digits, odd blanks inside Latin
    words, and words printed letter by letter (three letters or more).

    Each gap between two single letters is first marked on both sides; a gap
    goes when a marked gap touches it, so the fixed-width look-around never
    recurses however long the run is.
    """
    t = _without_odd_blanks(c)
    marked = F.regexp_replace(
        t, "(?=[ \\t])(?<=\\b[A-Za-z])([ \\t]+)(?=[A-Za-z]\\b)", "\u0001$1\u0002"
    )
    joined = F.regexp_replace(
        marked,
        "(?<=\\x02[A-Za-z])\\x01[ \\t]+\\x02|\\x01[ \\t]+\\x02(?=[A-Za-z]\\x01)",
        "",
    )
    return F.translate(joined, "\u0001\u0002", "")


def _without_odd_blanks(c: Column | str) -> Column:
    cjk = f"[\\p{{IsHan}}0-9{CJK_PUNCT_WIDE}]"
    t = F.regexp_replace(col(c), f"(?=[ \\t])(?<={cjk})[ \\t]+(?={cjk})", "")
    return F.regexp_replace(
        t,
        "(?=[^\\x00-\\x7f])(?<=[A-Za-z])[\\x{00A0}\\x{2000}-\\x{200B}\\x{202F}\\x{2060}]+(?=[A-Za-z])",
        "",
    )


def single_spaced(c: Column | str) -> Column:
    """N2 on text whose blanks become single ones anyway: with gaps of one
    blank, one look-around pass joins letter runs."""
    t = _without_odd_blanks(F.regexp_replace(col(c), "[ \\t]+", " "))
    return F.regexp_replace(
        t,
        " (?=[A-Za-z]\\b)(?:(?<=\\b[A-Za-z] )(?=[A-Za-z] [A-Za-z]\\b)|(?<=\\b[A-Za-z] [A-Za-z] ))",
        "",
    )


def inline(c: Column | str) -> Column:
    """N3. One readable line out of wrapped lines."""
    t = F.regexp_replace(col(c), "[\\t ]+", " ")
    t = F.regexp_replace(t, " ?[\\n\\r][ \\n\\r]*", "\n")
    t = F.btrim(t, F.lit(" \n"))
    t = F.regexp_replace(t, "-\\n(?=[a-z])", "")
    t = F.regexp_replace(t, "\\n(?<=[A-Za-z0-9_]\\n)(?=[A-Za-z0-9_])", " ")
    return single_spaced(F.replace(t, F.lit("\n"), F.lit("")))


def comparison_key(c: Column | str) -> Column:
    """N4. Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(nfkc(c)), "[^\\p{L}\\p{N}]", "")


def fold(c: Column | str) -> Column:
    """Lower case without accents; same number of characters as the input."""
    narrow = bound(col(c), lambda x: F.when(
        x.rlike(COMPATIBLE_CLASS), F.translate(x, FULLWIDTH, HALFWIDTH)).otherwise(x))
    return bound(F.lower(narrow), lambda x: F.when(
        x.rlike(ACCENTED_CLASS), F.translate(x, ACCENTED, UNACCENTED)).otherwise(x))


def search_projection(c: Column | str) -> Column:
    """N5. The searchable form: folded, letters and digits only."""
    return F.regexp_replace(fold(nfkc(c)), "[^\\p{L}\\p{N}]", "")


def token_units(c: Column | str) -> Column:
    """N7 in twentieths of a token, so that no sum depends on float order and
    units of parts add up: 20 per Han character, max(20, 5 x length) per run
    of other letters or digits, 7 per other visible symbol."""
    x = col(c)
    runs = F.regexp_extract_all(x, F.lit(f"[{ALNUM}&&[^{HAN}]]+"), F.lit(0))
    latin = F.aggregate(
        runs, F.lit(0), lambda acc, run: acc + F.greatest(F.lit(20), F.length(run) * 5)
    )
    han = F.regexp_count(x, F.lit(f"[{HAN}]"))
    symbols = F.regexp_count(x, F.lit(f"[^{ALNUM}\\s{WIDE_BLANKS}]"))
    return latin + han * 20 + symbols * 7


def estimated_tokens(c: Column | str) -> Column:
    """N7. At least one token for any text."""
    x = col(c)
    estimate = F.ceil(token_units(x) / 20).cast("int")
    return F.when(x.isNull() | (x == ""), F.lit(0)).otherwise(F.greatest(F.lit(1), estimate))


def tokens(c: Column | str) -> Column:
    """N8. Words of 2-40 letters or digits, then Han single characters and
    pairs over the Han-only sequence, as an array with repeats."""
    x = F.lower(col(c))
    words = F.filter(
        F.split(x, f"[^{ALNUM}]+"), lambda w: (F.length(w) >= 2) & (F.length(w) <= 40)
    )

    def grams(han: Column) -> Column:
        singles = F.sequence(F.lit(1), F.length(han))
        pairs = F.when(F.length(han) > 1, F.sequence(F.lit(1), F.length(han) - 1)).otherwise(
            F.expr("cast(array() as array<int>)")
        )
        return F.concat(
            F.transform(singles, lambda i: F.substring(han, i, F.lit(1))),
            F.transform(pairs, lambda i: F.substring(han, i, F.lit(2))),
        )

    han = F.array(F.regexp_replace(x, "[^\\x{4E00}-\\x{9FFF}]", ""))
    extra = F.when(x.rlike("[\\x{4E00}-\\x{9FFF}]"), F.flatten(F.transform(han, grams)))
    return F.concat(words, F.coalesce(extra, F.expr("cast(array() as array<string>)")))


def simple_tokens(c: Column | str) -> Column:
    """The token rule of Q1: each Han character, or a run of ASCII word
    characters, over the normalised lower-case text."""
    return F.regexp_extract_all(
        F.lower(normalize_text(c)), F.lit("[\\p{IsHan}]|[a-z0-9_]+"), F.lit(0)
    )


def needs_ocr_correction(c: Column | str) -> Column:
    """N9. Replacement glyphs, empty squares or private-use characters."""
    return col(c).rlike("[�□]|\\p{Co}")


def printed_page_token(c: Column | str) -> Column:
    """The part of N10 before evaluation: lower case, prefix and brackets off."""
    t = F.regexp_replace(F.lower(nfkc(c)), "^\\s*/?\\s*p\\.?\\s*/?\\s*", "")
    return F.regexp_replace(t, "[()\\[\\]{}（）【】,，、:：/／.\\s]", "")


def page_label_token(c: Column | str) -> Column:
    """N10 for declared page labels: also a page word around the number, or
    the number after the last separator."""
    t = strip(nfkc(c))
    direct = printed_page_token(
        F.regexp_replace(F.regexp_replace(t, "^第(?=\\d+页$)", ""), "页$", "")
    )
    suffix = F.regexp_extract(t, "(?:^|[-_:/\\s])第?(\\d{1,4})页?$", 1)
    return F.when(direct.rlike("^(?:\\d{1,4}|[ivxlcdm]{1,10})$"), direct).otherwise(suffix)


def bound(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), body)[0]


# Roman digits in rising order.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_value(c: Column | str) -> Column:
    """Subtractive roman value of a lower-case token: a digit right before a
    larger one counts negative."""
    sizes = F.array(*[F.lit(v) for v in ROMAN.values()])
    values = F.transform(
        F.split(col(c), ""), lambda d: F.get(sizes, F.instr(F.lit("".join(ROMAN)), d) - 1)
    )
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))

    def add(state: Column, value: Column) -> Column:
        taken = F.when(state["last"] < value, 2 * state["last"]).otherwise(0)
        return F.struct((state["total"] + value - taken).alias("total"), value.alias("last"))

    return F.aggregate(values, start, add, lambda s: s["total"])


def printed_page(token: Column) -> Column:
    """N10. ``struct(value, style)`` of a cleaned token, or null."""
    value = F.when(token.rlike("^\\d{1,4}$"), token.try_cast("int")).when(
        token.rlike("^[ivxlcdm]{1,10}$"), roman_value(token)
    )
    style = F.when(token.rlike("^\\d"), "arabic").otherwise("roman")
    return bound(
        value, lambda v: F.when(v > 0, F.struct(v.alias("value"), style.alias("style")))
    )


# Fixed value: four numbers are a network address, not a place in an outline.
ADDRESS = "\\d{1,3}(?:\\.\\d{1,3}){3}(?!\\.?\\d)"

# Chinese numerals.
CHINESE_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5,
                  "六": 6, "七": 7, "八": 8, "九": 9}
CHINESE_UNITS = {"十": 10, "百": 100, "千": 1000}
NUMERALS = "0-9一二三四五六七八九十百千零〇两"


def chinese_value(c: Column | str) -> Column:
    """Value of a numeral: a unit counts its digit (one when there is none),
    and a trailing digit counts itself."""
    x = col(c)
    digit = "零〇一二两三四五六七八九"
    value = lambda d: F.translate(d, "零〇一二两三四五六七八九", "001223456789").cast("int")
    total = F.lit(0)
    for unit, size in CHINESE_UNITS.items():
        hits = F.regexp_extract_all(x, F.lit(f"([{digit}]?){unit}"), F.lit(1))
        total = total + F.aggregate(
            hits,
            F.lit(0),
            lambda acc, d: acc + F.greatest(F.coalesce(value(d), F.lit(1)), F.lit(1)),
        ) * size
    tail = value(F.regexp_extract(x, f"([{digit}])$", 1))
    return total + F.coalesce(tail, F.lit(0))


def sequence_key(c: Column | str) -> Column:
    """N11. Leading sequence of a title as an int array, else null."""
    t = col(c)
    marked = F.regexp_extract(t, f"(?i)^第\\s*([{NUMERALS}]+)\\s*[篇部卷章节]", 1)
    named = F.regexp_extract(t, "(?i)^(?:chapter|part|section)\\s+([0-9]+)", 1)
    plain = F.regexp_extract(t, "^(\\d+(?:\\.\\d+)*)", 1)
    token = F.when(marked != "", marked).when(named != "", named).otherwise(plain)
    return sequence_token_key(token)


def sequence_token_key(token: Column) -> Column:
    """Numbers of any length may stand in a text; those beyond 64 bits are no key."""
    numbers = F.transform(F.split(token, "\\."), lambda p: p.try_cast("bigint"))
    known = bound(numbers, lambda n: F.when(~F.exists(n, lambda v: v.isNull()), n))
    return F.when(token.rlike("^\\d+(?:\\.\\d+)*$"), known).when(
        token.rlike("^[一二三四五六七八九十百千零〇两]+$"), F.array(chinese_value(token))
    )


def title_without_sequence(c: Column | str) -> Column:
    return F.regexp_replace(
        col(c),
        f"(?i)^(?:(?:第\\s*[{NUMERALS}]+\\s*[篇部卷章节])|(?:chapter|part|section)\\s+\\S+"
        "|(?:\\d+(?:\\.\\d+)*))[\\s、.．:：\\-]*",
        "",
    )


def escape_markdown(c: Column | str) -> Column:
    """N12. Back-slash Markdown delimiters, entities for HTML ones."""
    t = F.replace(col(c), F.lit("\\"), F.lit("\\\\"))
    t = F.replace(t, F.lit("&"), F.lit("&amp;"))
    t = F.replace(t, F.lit("<"), F.lit("&lt;"))
    t = F.replace(t, F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(t, "([`*_\\[\\]])", "\\\\$1")


def safe_name(c: Column | str, default: str = "Untitled") -> Column:
    """N12. Characters that are illegal in file names become dashes."""
    name = strip(F.regexp_replace(col(c), '[\\\\/:*?"<>|]', "-"))
    return F.when(name == "", F.lit(default)).otherwise(name)


def accept_correction(original: Column | str, recognized: Column | str, in_bytes: bool = False) -> Column:
    """N13. The re-read text if it is plausibly the same passage, else null.  With
    ``in_bytes`` edits are counted in UTF-8 bytes, as DuckDB's ``levenshtein`` does."""
    text = inline(recognized)
    left = F.regexp_replace(F.lower(inline(original)), f"[^{ALNUM}]", "")
    right = F.regexp_replace(F.lower(text), f"[^{ALNUM}]", "")
    ratio = F.length(right) / F.length(left)
    longest = F.greatest(F.length(left), F.length(right))
    # One character for each byte.
    sides = [F.decode(F.encode(c, "UTF-8"), "ISO-8859-1") for c in (left, right)] if in_bytes else [left, right]
    similar = 1 - F.levenshtein(*sides) / longest >= 0.58
    return F.when(
        (F.length(left) >= 2)
        & (F.length(right) >= 2)
        & ratio.between(0.55, 1.65)
        & similar,
        text,
    )
