"""Text expressions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fraction glyphs by numerator and denominator.
FRACTIONS = {
    (1, 2): "½", (1, 3): "⅓", (2, 3): "⅔", (1, 4): "¼", (3, 4): "¾", (1, 5): "⅕", (2, 5): "⅖", (3, 5): "⅗", (4, 5): "⅘",
    (1, 6): "⅙", (5, 6): "⅚", (1, 7): "⅐", (1, 8): "⅛", (3, 8): "⅜", (5, 8): "⅝", (7, 8): "⅞", (1, 9): "⅑", (1, 10): "⅒",
}
# Pairs rewritten before a unit of measure.
UNIT_PAIRS = [(1, 2), (1, 3), (2, 3), (1, 4), (3, 4), (1, 8), (3, 8), (5, 8), (7, 8)]
# Unit words, of the model path (whole words) and of the cleanup path (beginnings).
UNITS = "cup|cups|tsp|tbsp|teaspoon|teaspoons|tablespoon|tablespoons|pound|pounds|oz|lb|lbs|quart|pint|gallon|stick|sticks"
UNIT_STARTS = "cup|tsp|tbsp|teaspoon|tablespoon|pound|oz|lb|quart|pint|gallon|cloves?|stick"
# Replacements of the cleanup path.
LIGATURES = {
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ft", "\ufb06": "st",
    "\u2014": "--", "\u2013": "-", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u00a0": " ",
}
# Seasonings that begin a list item.
SEASONINGS = "Salt|Pepper|Cayenne|Paprika|Sugar|Flour|Oil|Butter|Water|Milk|Cream|Egg|Eggs|Vinegar|Lemon|Lime|Wine|Stock|Broth|Yeast"
# Fraction glyphs, all and those that follow a whole number.
GLYPHS = "¼½¾⅓⅔⅛⅜⅝⅞⅕⅖⅗⅘⅙⅚⅐⅑⅒"
GLYPHS_SHORT = "¼½¾⅓⅔⅛⅜⅝⅞"
# A word boundary whose word characters are letters, digits and _ in any script, other number signs included.
W = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def let(c: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def first_is(c: Column, pattern: str) -> Column:
    """Whether the first character after white space is of the class."""
    return F.regexp_like(c, F.lit(f"^{SPACE}*{pattern}"))


def math_to_text(c: Column) -> Column:
    """Bodies of <math> tags: fractions to glyphs or n/d, other commands and braces dropped; outside as it is."""

    def body(b: Column) -> Column:
        for (n, d), glyph in FRACTIONS.items():
            b = F.regexp_replace(b, rf"\\frac\{{0*{n}\}}\{{0*{d}\}}", glyph)
        b = F.regexp_replace(b, r"\\frac\{0*(\d+)\}\{0*(\d+)\}", "$1/$2")
        return F.regexp_replace(F.regexp_replace(b, r"\\[a-zA-Z]+(?U:\s*)", ""), r"[{}]", "")

    def part(p: Column) -> Column:
        end = F.instr(p, "</math>")
        return F.when(end > 0, F.concat(body(F.substring(p, F.lit(1), end - 1)), F.substring(p, end + 7, F.length(p)))).otherwise(F.concat(F.lit("<math>"), p))

    parts = F.split(c, "<math>", -1)
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), part)
    return F.when(F.instr(c, "<math>") > 0, F.concat(F.element_at(parts, 1), F.array_join(rest, ""))).otherwise(c)


#: The named signs of HTML, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def strip_tags(c: Column) -> Column:
    """Without tags; blank gives the empty text."""
    return strip(F.regexp_replace(c, r"</?[a-zA-Z][^>]*>", ""))


def element_text(c: Column) -> Column:
    """Texts between tags, stripped, one a line; comments, scripts and styles have none. Null and blank give the empty text."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "<b>")
    out = F.array_join(F.filter(F.transform(F.split(plain, r"</?[a-zA-Z][^>]*>", -1), strip), lambda t: t != ""), "\n")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def each_match(c: Column, pattern: str, f) -> Column:
    """c with f of every match of pattern in its place, in one pass from left to right."""
    parts, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    rest = F.zip_with(found, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda m, after: F.concat(f(m), after))
    return F.when(F.regexp_like(c, F.lit(pattern)), F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))).otherwise(c)


def _glyph(pair: Column) -> Column:
    """The glyph of n/d with one digit each and either slash; null where there is none."""
    known = F.create_map(*(F.lit(x) for (n, d), glyph in FRACTIONS.items() if d < 10 for x in (f"{n}/{d}", glyph)))
    return F.try_element_at(known, F.translate(pair, "\u2044", "/"))


def mixed_fractions(c: Column) -> Column:
    """Digit, numerator, slash, denominator to the digit and a glyph, where there is one; what was looked at once isn't again."""
    return each_match(c, r"\d\d[\x{2044}/]\d", lambda m: F.coalesce(F.concat(F.substring(m, 1, 1), _glyph(F.substring(m, 2, 3))), m))


def bare_fractions(c: Column) -> Column:
    """Numerator, fraction slash, denominator, no digit beside them, to a glyph."""
    return each_match(c, r"(?<!\d)\d\x{2044}\d(?!\d)", lambda m: F.coalesce(_glyph(m), m))


def unit_fractions(c: Column) -> Column:
    """Plain fractions before a unit word to glyphs, drawn to a whole number before them."""
    ahead = rf"(?=(?U:\s+)(?:{UNITS})(?!{W}))"

    def all_of(x: Column) -> Column:
        for n, d in UNIT_PAIRS:
            glyph = FRACTIONS[n, d]
            x = F.regexp_replace(x, rf"(?iu)(\d)(?U:\s+){n}/{d}{ahead}", f"$1{glyph}")
            x = F.regexp_replace(x, rf"(?iu)(?<!\d){n}/{d}{ahead}", glyph)
        return x

    return let(c, lambda x: F.when(F.contains(x, F.lit("/")), all_of(x)).otherwise(x))


def clean_line(c: Column) -> Column:
    """A recognised line as Markdown text."""

    def tagless(x: Column) -> Column:
        x = F.regexp_replace(math_to_text(x), r"(?s)<b>(.*?)</b>", r"**$1**")
        x = F.regexp_replace(x, r"(?s)<i>(.*?)</i>", r"*$1*")
        return F.regexp_replace(x, r"</?[a-zA-Z][^>]*>", "")

    c = let(c, lambda x: F.when(F.contains(x, F.lit("<")), tagless(x)).otherwise(x))
    c = let(c, lambda x: F.when(F.regexp_like(x, F.lit(r"\d[/\x{2044}]\d")), unit_fractions(bare_fractions(mixed_fractions(x)))).otherwise(x))
    c = F.regexp_replace(c, rf"^{SPACE}*[•●◆▪]{SPACE}+", "- ")
    return strip(F.regexp_replace(c, r"[ \t]{2,}|\t", " "))


def whole_line_bold(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^\*\*.+?\*\*$"))


def quantity_start(c: Column) -> Column:
    s = F.regexp_replace(c, f"^{SPACE}+", "")
    number = rf"^\d+(?:[{GLYPHS_SHORT}]|{SPACE}*[-–]{SPACE}*[{GLYPHS_SHORT}]|/\d+|\.\d+)?{SPACE}"
    return F.regexp_like(s, F.lit(f"^[{GLYPHS}]")) | F.regexp_like(s, F.lit(number))


def seasoning_item(c: Column) -> Column:
    return F.regexp_like(strip(c), F.lit(rf"(?iu)^(?:{SEASONINGS})s?(?!{W})")) & (F.length(c) < 40)


def sentence_like(c: Column) -> Column:
    end = F.regexp_like(c, F.lit(rf"[.!?]{SPACE}*$"))
    return F.regexp_like(c, F.lit(r"^\p{Lu}")) & end & (F.size(F.split(strip(c), f"{SPACE}+")) >= 3)


def continuation(c: Column) -> Column:
    return let(strip(c), lambda s: (s != "") & (F.regexp_like(s, F.lit(r"^[(\p{Ll}]")) | ((F.length(s) < 40) & ~sentence_like(s))))


def data_label(c: Column) -> Column:
    return F.regexp_like(c, F.lit(rf"(?iu)^{SPACE}*\d+{SPACE}*(?:[°%]|mL|ml|cm|mm|km|cup|tsp|tbsp|oz|lb|g(?!{W})|kg)"))


def looks_like_prose(c: Column) -> Column:
    return (c != "") & ~data_label(c) & (F.instr(c, "|") == 0) & F.regexp_like(c, F.lit(r"^\p{L}")) & F.regexp_like(c, F.lit(r"(?:\p{Ll}[^\p{Ll}]*){3}"))


def font_heading(c: Column, height: Column, median: Column) -> Column:
    """Whether a taller line is a heading."""
    short = (F.length(c) < 60) & (F.length(c) > 0) & (median > 0) & (height > median * 1.35)
    shape = ~F.startswith(c, F.lit("**")) & F.regexp_like(c, F.lit(r"\p{Ll}")) & ~F.regexp_like(c, F.lit(r"^\p{Nd}"))
    return short & shape & ~F.regexp_like(c, F.lit(r"(?i)http|www\.")) & ~F.regexp_like(c, F.lit(rf"[.!,);:]{SPACE}*$"))


def ligatures(c: Column) -> Column:
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def has_numeric(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"\p{N}"))


# Rewrites of misread fractions over a whole page, in order: (pattern, replacement); U stands for a unit ahead.
U = rf"(?=(?U:\s+)(?:{UNIT_STARTS}))"
S = r"(?U:\s*)"
FIXUPS = [
    (rf"¥{S}[%/]", "½"),
    (rf"(?iu)(?<!{W})Ys(?!{W}){U}", "¼"),
    (rf"['`]{S}[/\\]{S}[«<.,]", "¼"),
    (rf"(?imu)^{S}%\.{U}", "¼"),
    (rf"(?imu)^{S}%{U}", "½"),
    (rf"(\d½)\d(?!{W})", "$1"),
    (rf"(\d)['`]?{S}[%/][.,]?(?=(?U:\s))", "$1½"),
    (rf"(?iu)(?<!\d)4%{U}", "¼"),
    (rf"(?iu)(?<=(?U:\s))%{U}", "½"),
    *((rf"(?iu)(?<!{W}){n}/{d}(?!{W}){U}", FRACTIONS[n, d]) for n, d in [(1, 2), (1, 4), (3, 4), (1, 3), (2, 3), (1, 8)]),
    *((rf"(?iu)(\d)(?U:\s+){n}/{d}{U}", f"$1{FRACTIONS[n, d]}") for n, d in [(1, 2), (1, 4), (3, 4)]),
    (rf"(?iu)'{S}/{S}2{U}", "½"),
    (rf"(?iu)'{S}/{S}4{U}", "¼"),
    (rf"(?iu)Y{S}={S}\}}(?={S}[-–]{S}[½1/]?{S}(?:{UNIT_STARTS}))", "¼"),
    (rf"(?iu)(?<!{W})Y[=.]{S}{U}", "¼"),
    (rf"(?iu)(?<!{W})Y[.,«»<>]+{U}", "¼"),
    (rf"(?iu)(\d)%[:;,.]+{U}", "$1½"),
    (rf"(?imu)^{S}2[»«]{U}", "½"),
    (rf"(?imu)^{S}1[»«]{U}", "¼"),
]


def fraction_fixups(c: Column) -> Column:
    def all_of(x: Column) -> Column:
        for pattern, by in FIXUPS:
            x = F.regexp_replace(x, pattern, by)
        return x

    # every rule needs one of these signs, or a Y that stands alone or before an equals sign
    need = rf"[¥%/\\½»«]|(?iu:(?<!{W})Y(?:[=.,<>]|s(?!{W}))|Y{S}=)"
    return let(c, lambda x: F.when(F.regexp_like(x, F.lit(need)), all_of(x)).otherwise(x))


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
