"""Text rules of lines and pages as plain Python, for Arrow batches: the same results as the expressions of `text` and `noise`.

Facts of a token are looked up once a worker and kept, so a line costs little more than its split. `Noise` takes the words
of Zipf frequency RARE or more: no rule here asks whether a word is rarer than that.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa

from quiresmith.functions import noise
from quiresmith.functions import text as T

Batches = Iterator[pa.RecordBatch]
#: White space by Unicode's property; Python's own has the separators 1C to 1F besides.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Tokens whose facts a worker keeps.
KEPT = 200_000

TAG = re.compile(r"</?[a-zA-Z][^>]*>")
BOLD, ITALIC = re.compile(r"<b>(.*?)</b>", re.S), re.compile(r"<i>(.*?)</i>", re.S)
MATH = [(re.compile(rf"\\frac\{{0*{n}\}}\{{0*{d}\}}"), glyph) for (n, d), glyph in T.FRACTIONS.items()] + [(re.compile(r"\\frac\{0*([0-9]+)\}\{0*([0-9]+)\}"), r"\1/\2"), (re.compile(rf"\\[a-zA-Z]+{WHITE}*"), ""), (re.compile(r"[{}]"), "")]
GLYPH = {f"{n}/{d}": glyph for (n, d), glyph in T.FRACTIONS.items() if d < 10}
FRACTION, MIXED, BARE = re.compile(r"[0-9][/\u2044][0-9]"), re.compile(r"[0-9][0-9][/\u2044][0-9]"), re.compile(r"(?<![0-9])[0-9]\u2044[0-9](?![0-9])")
AHEAD = rf"(?={WHITE}+(?:{T.UNITS})(?!\w))"
UNIT = [(f"{n}/{d}", re.compile(rf"([0-9]){WHITE}+{n}/{d}{AHEAD}", re.I), re.compile(rf"(?<![0-9]){n}/{d}{AHEAD}", re.I), T.FRACTIONS[n, d]) for n, d in T.UNIT_PAIRS]
BULLET, BLANKS, LINES = re.compile(r"\s*[•●◆▪]\s+"), re.compile(r"[ \t]+"), re.compile(r"\n{3,}")


def _math(s: str) -> str:
    first, *rest = s.split("<math>")
    for part in rest:
        body, end, after = part.partition("</math>")
        if end:
            for pattern, by in MATH:
                body = pattern.sub(by, body)
            first += body + after
        else:
            first += "<math>" + part
    return first


def unit_fractions(s: str) -> str:
    if "/" in s:
        for pair, mixed, plain, glyph in UNIT:
            if pair in s:
                s = plain.sub(glyph, mixed.sub(rf"\g<1>{glyph}", s))
    return s


def clean_line(s: str) -> str:
    """See text.clean_line."""
    if "<" in s:
        s = TAG.sub("", ITALIC.sub(r"*\1*", BOLD.sub(r"**\1**", _math(s) if "<math>" in s else s)))
    if ("/" in s or "\u2044" in s) and FRACTION.search(s):
        pair = lambda m: m.replace("\u2044", "/")
        s = MIXED.sub(lambda m: m[0][0] + GLYPH[pair(m[0][1:])] if pair(m[0][1:]) in GLYPH else m[0], s)
        s = unit_fractions(BARE.sub(lambda m: GLYPH.get(pair(m[0]), m[0]), s))
    s = BULLET.sub("- ", s, count=1) if BULLET.match(s) else s
    return (BLANKS.sub(" ", s) if "  " in s or "\t" in s else s).strip()


def _python(pattern: str) -> tuple[str, int]:
    """A pattern of text.FIXUPS for Python's engine."""
    flags = 0
    for head, bits in (("(?imu)", re.I), ("(?iu)", re.I)):
        if pattern.startswith(head):
            pattern, flags = pattern[len(head) :], bits
    # a line begins after any of these; what follows here always needs a further character
    pattern = re.sub(r"^\^", lambda _: r"(?:\A|(?<=\r)(?!\n)|(?<=[\n\x85\u2028\u2029]))", pattern)
    for java, here in ((T.W, r"\w"), (r"(?U:\s*)", f"{WHITE}*"), (r"(?U:\s+)", f"{WHITE}+"), (r"(?U:\s)", WHITE), (r"\d", "[0-9]")):
        pattern = pattern.replace(java, here)
    return pattern, flags


def _needs(pattern: str) -> str:
    """A sign that every match of a pattern of text.FIXUPS has, or none."""
    pair = re.search(r"[1-9]/[1-9]", pattern)
    return pair[0] if pair else next((c for c in "¥½" if pattern.startswith(c) or f"{c})" in pattern), "%" if re.search(r"%(?!/|\])", pattern) else "")


FIXUPS = [(re.compile(*_python(p)), re.sub(r"\$(\d)", r"\\g<\1>", by), _needs(p)) for p, by in T.FIXUPS]
SIGNS = re.compile(r"[¥%/\\½»«]")
LONE_Y = re.compile(rf"(?<!\w)y(?:[=.,<>]|s(?!\w))|y{WHITE}*=", re.I)


def fraction_fixups(s: str) -> str:
    """See text.fraction_fixups."""
    if SIGNS.search(s) or ("y" in s or "Y" in s) and LONE_Y.search(s):
        for pattern, by, need in FIXUPS:
            if need in s:
                s = pattern.sub(by, s)
    return s


def ligatures(s: str) -> str:
    for a, b in T.LIGATURES.items():
        if a in s:
            s = s.replace(a, b)
    return s


BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
DIGIT = re.compile("[\\d" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), noise.DIGIT.removeprefix(r"[\p{Nd}")))
DATA = re.compile(r"\s*[0-9]+\s*(?:[°%]|mL|ml|cm|mm|km|cup|tsp|tbsp|oz|lb|g(?!\w)|kg)", re.I)
VOWEL, CLUSTER, ASCII_DIGIT = re.compile("[aeiouy]"), re.compile("[bcdfghjklmnpqrstvwxz]{4}"), re.compile("[0-9]")
LISTED = noise.ALLOWED_WORDS | noise.HEADER_WORDS
FRONT_RULE, BACK_RULE = re.compile(r"[|:]+\s+"), re.compile(r"\s+[|:]+\s*\Z")
category = unicodedata.category


def lines_of(text: str) -> list[str]:
    return [x.rstrip() for x in BREAK.split(text)]


def has_numeric(s: str) -> bool:
    return ASCII_DIGIT.search(s) is not None or not s.isascii() and any(category(c)[0] == "N" for c in s)


def is_lower(c: str) -> bool:
    return "a" <= c <= "z" or c > "\x7f" and category(c) == "Ll"


def shouted(s: str) -> bool:
    kinds = {category(c) for c in s}
    return "Lu" in kinds and not kinds & {"Ll", "Lt"}


def unwrap_hyphens(lines: list[str]) -> list[str]:
    """See formatting.unwrap_hyphens."""
    rows = [x.rstrip() for x in lines]
    out, at = [], 0
    while at < len(rows):
        s = rows[at]
        if s.endswith("-") and at + 1 < len(rows) and rows[at + 1] and is_lower(rows[at + 1][0]):
            s = s[:-1] + rows[at + 1]
            at += 1
        out.append(s)
        at += 1
    return out


class Noise:
    """The rules of `noise` over a lexicon: words with their Zipf frequencies, where those are RARE or more."""

    def __init__(self, zipf: dict[str, float]):
        self.zipf = zipf
        self.words: dict[str, bool] = {}
        self.seen: dict[str, tuple] = {}

    def is_word(self, token: str) -> bool:
        got = self.words.get(token)
        if got is None:
            w = token.lower().strip(noise.WORD_EDGE)
            got = len(w) > 1 and (has_numeric(w) or w in LISTED or self.zipf.get(w, 0.0) >= noise.RARE and VOWEL.search(w) is not None and CLUSTER.search(w) is None)
            if len(self.words) >= KEPT:
                self.words.clear()
            self.words[token] = got
        return got

    def facts(self, token: str) -> tuple:
        """Letters; whether it is a word, is common, is calm, and is a name if it stands alone."""
        got = self.seen.get(token)
        if got is None:
            b = token.strip(noise.BARE_EDGE)
            low, loud = b.lower(), shouted(b)
            zipf = self.zipf.get(low, 0.0)
            got = (sum(map(str.isalpha, token)), self.is_word(token), zipf >= noise.COMMON, b != "" and not (loud and len(b) > 1), loud and len(b) < 9 and zipf < noise.USUAL and low not in noise.HEADER_WORDS)
            if len(self.seen) >= KEPT:
                self.seen.clear()
            self.seen[token] = got
        return got

    def garbage(self, line: str) -> bool:
        s = line.strip()
        if not s:
            return False
        rows = [self.facts(t) for t in s.split()]
        chars, n = len(s), len(rows)
        letters = sum(r[0] for r in rows)
        words = sum(r[1] for r in rows)
        if (chars < 3 and letters < 2) or (chars > 5 and letters * 20 < chars * 7):
            return True
        if (n < 5 and chars < 30 and words == 0) or (n > 1 and words * 5 < n * 2) or (chars < 7 and not DIGIT.search(s)):
            return True
        if n == 1 and rows[0][4]:
            return True
        return chars < 35 and not any(r[3] for r in rows) and sum(r[2] for r in rows) < max(1, n // 2)

    def _debris(self, row: list[str], edge: str) -> int:
        for k, t in enumerate(row[:3]):
            b = t.strip(edge)
            if b and (len(b) > 2 or b.lower() in noise.ONE_CHAR_WORDS or has_numeric(b) or self.is_word(b)):
                return k
        return min(3, len(row))

    def trim_margins(self, line: str) -> str:
        s = FRONT_RULE.sub("", x, count=1) if FRONT_RULE.match(x := line.lstrip()) else x
        row = s.split()
        if n := self._debris(row, noise.FRONT_EDGE):
            s = " ".join(row[n:])
        s = s.rstrip()
        if s[-1:] in ("|", ":"):
            s = BACK_RULE.sub("", s)
        row = s.split()[::-1]
        if n := self._debris(row, noise.BACK_EDGE):
            s = " ".join(row[n:][::-1])
        return s

    def title(self, s: str) -> bool:
        """Whether a line has the shape of a title and two words or more."""
        if not 6 <= len(s) <= 80 or "|" in s or s[-1] in ",;.!?" or DIGIT.match(s) or DATA.match(s) or not any(map(is_lower, s)):
            return False
        row = s.split()
        long = [t for t in row if len(t.strip(noise.BARE_EDGE)) > 3]
        return bool(long) and all(category(t[0]) == "Lu" or category(t[0])[0] != "L" for t in long) and sum(map(self.is_word, row)) > 1

    def mark_headings(self, text: str) -> str:
        rows = lines_of(text)
        last = max((i for i, s in enumerate(rows) if s), default=-1)
        out = []
        for i, s in enumerate(rows):
            if s and i < last and not (i and rows[i - 1].strip()) and ((after := rows[i + 1].strip()) == "" or prose_like(after)) and self.title(s):
                out.append(f"## {s}")
            else:
                out.append(s + "  " if s else "")
        return "\n".join(out).strip()

    def clean_page(self, text: str) -> str:
        """A recognised page as Markdown, all cleanup steps in order."""
        merged = unwrap_hyphens(lines_of(ligatures(unicodedata.normalize("NFC", text))))
        kept = [s for s in map(self.trim_margins, merged) if not self.garbage(s)]
        return self.mark_headings(LINES.sub("\n\n", BLANKS.sub(" ", fraction_fixups("\n".join(kept)))))


def prose_like(s: str) -> bool:
    """See text.looks_like_prose; s isn't empty."""
    return s[0].isalpha() and "|" not in s and sum(map(is_lower, s)) > 2 and DATA.match(s) is None


def mapped(f: Callable[[str], str], at: int) -> Callable[[Batches], Batches]:
    """Batches with f of the texts in column `at`; nulls stay."""

    def run(it: Batches) -> Batches:
        for batch in it:
            done = pa.array([f(t) if t is not None else None for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([done if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return run
