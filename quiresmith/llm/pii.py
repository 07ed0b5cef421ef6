"""Personal data: fixed base patterns, and spans that weak supervision adds.

Base kinds are exact: leftmost non-overlapping matches, failing ones dropped. A greedy base match that swallows its
neighbours fails and hides a card or phone number; for those, and for further kinds (`secret`, `ssn`, `iban`, `person`), cheap rules propose candidates, and labelers of three sorts vote on each: regular expressions over
its shape, gazetteers over the words before it, and context around it. A vote is for, against or none. Over
all documents Spark counts how often each combination of votes and shape features occurs; expectation-
maximisation over these counts (votes independent given the truth, reliabilities per labeler) gives every
combination a posterior, and a logistic classifier trained on the posteriors decides which candidates become
spans. Combinations are few whatever the corpus, so the driver sees a bounded table, never documents.

Defined cases: null and empty texts have no spans; spans are code points, end exclusive; candidates that
overlap a base span, or an earlier candidate, are dropped, secrets of over 200 characters keep the parts that are free; with no candidates the base spans alone are
returned; repeated rows alike; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, materialise, table, tidy

BASE = ("email", "ip", "card", "phone")
ADDED = ("card", "phone", "secret", "ssn", "iban", "person")
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban", "person")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(t: str) -> list[tuple[int, int]]:
    """Matches of EMAIL, looked for at each @, so that long runs without one cost nothing: no local part holds an @."""
    out, at, least = [], t.find("@"), 0
    while at >= 0:
        a = at
        while a > least and t[a - 1] in LOCAL:
            a -= 1
        least = at + 1
        m = DOMAIN.match(t, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            least = m.end()
        at = t.find("@", least)
    return out


def _ips(t: str) -> list[tuple[int, int]]:
    """Matches of IP that are addresses: of each run of numbers and dots, number by number in fours."""
    out = []
    for m in DOTTED.finditer(t):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str | None) -> list[list[tuple[int, int]]]:
    """Spans of each base kind."""
    if not t:
        return [[], [], [], []]
    emails = _emails(t)
    if not DIGIT.search(t):
        return [emails, [], [], []]
    ips = _ips(t) if "." in t else []
    cards = [m.span() for m in CARD.finditer(t) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(t) if 9 <= len(_digits(m[0])) <= 15] if "+" in t else []
    return [emails, ips, cards, phones]


# Word lists of the labelers.
SECRET_KEYS = frozenset("password passwd pwd pass passphrase token secret apikey api_key api-key accesskey access_key access-key auth bearer credential credentials private_key client_secret key".split())
CARD_KEYS = frozenset("card visa mastercard amex credit debit karte carte tarjeta pan".split())
PHONE_KEYS = frozenset("phone tel telephone call mobile fax cell telefon tél teléfono contact".split())
SSN_KEYS = frozenset("ssn social security".split())
IBAN_KEYS = frozenset("iban account konto compte cuenta".split())
HASH_KEYS = frozenset("commit sha sha1 sha256 md5 checksum etag revision rev isbn issn order invoice version page id".split())
TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame señor señora".split())
GIVEN = frozenset("james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen anna maria peter hans klaus pierre marie jean juan carlos carmen jose".split())
NOT_NAMES = frozenset("president chairman chairwoman speaker minister secretary mayor senator right wrong big small who no yes pepper house january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())
PERSON_KEYS = frozenset("name contact by from signed author regards sincerely called".split())

VALUE = re.compile(r"[:=]\s{0,2}[\"'“]?([^\s\"'”,;<>]{6,})")
#: A value longer than this may hold other things, which split it.
LONG = 200
TOKEN = re.compile(r"[0-9][A-Za-z0-9+/_=-]*")
TOKEN_LEFT = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-="
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NUMBER = re.compile(r"(?<![0-9+])(?:[3-6][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5}|[3-6][0-9]{12,18})(?![0-9])")
CALL = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,2}[ .-]?[0-9]{2,4}(?![0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
PERSON = re.compile(r"(?<![^\W_])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?")
WORD_BEFORE = re.compile(r"([^\W_][\w-]*)\W{0,4}\Z")
# Formats of keys that issuers publish.
ISSUED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}\Z|gh[pousr]_[A-Za-z0-9]{36,}\Z|xox[abprs]-[A-Za-z0-9-]{10,}\Z|sk-[A-Za-z0-9_-]{20,}\Z|AIza[A-Za-z0-9_-]{35}\Z|eyJ[A-Za-z0-9_-]{10,}")
HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")

#: Ends of compound names of secrets, as in db_password.
KEY_ENDS = ("_key", "_token", "_secret", "password")

LABELERS = ("shape", "entropy", "checksum", "keyword", "other_keyword", "name", "assignment", "quoted", "prose", "issued")


def _named(word: str, keys: frozenset[str]) -> bool:
    """Whether a word before a value, in lower case, names its kind; compound names of secrets count for every kind."""
    return word in keys or word.endswith(KEY_ENDS)


def _name(v: str) -> int:
    """What the gazetteers say of the words after a title: given names for, offices, days and the like against."""
    words = [w.lower() for w in v.replace(".", " ").split() if w.lower() not in TITLES]
    return -1 if NOT_NAMES.intersection(words) else 1 if GIVEN.intersection(words) else 0


def _iban_ok(v: str) -> bool:
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _entropy(v: str) -> float:
    n = np.unique(np.frombuffer(v.encode("utf-8", "surrogatepass"), np.uint8), return_counts=True)[1]
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def votes(kind: str, v: str, t: str, a: int, b: int) -> tuple[list[int], int]:
    """Votes of the labelers (1, -1 or 0), and a code of shape features below 144."""
    before = t[max(0, a - 40) : a]
    m = WORD_BEFORE.search(before)
    word = m[1].lower() if m else ""
    digits, letters = sum(c.isdigit() for c in v), sum(c.isalpha() for c in v)
    h = _entropy(v)
    mixed = digits > 0 and letters > 0
    keys = {"card": CARD_KEYS, "phone": PHONE_KEYS, "secret": SECRET_KEYS, "ssn": SSN_KEYS, "iban": IBAN_KEYS, "person": PERSON_KEYS}[kind]
    if kind == "secret":
        shape = 1 if len(v) >= 16 and (HEX.match(v) and letters or mixed) else -1 if not digits else 0
    elif kind in ("card", "phone"):  # written in groups, or in a row of its own
        shape = 1 if not v.isdigit() or not (t[a - 1 : a].isalnum() or t[b : b + 1].isalnum()) else -1
    else:
        shape = 1
    if kind == "card":
        check = 1 if 13 <= digits <= 19 and luhn(_digits(v)) else -1
    elif kind == "phone":
        check = 0 if 9 <= digits <= 15 else -1
    elif kind == "iban":
        check = 1 if _iban_ok(v) else -1
    elif kind == "ssn":
        check = -1 if v[:3] in ("000", "666") or v[0] == "9" or v[4:6] == "00" or v[7:] == "0000" else 1
    else:
        check = 0
    tail = before.rstrip("\"'“ ")
    got = [
        shape,
        0 if kind in ("card", "phone", "person") else 1 if h >= 3 and mixed else -1 if h < 2.5 else 0,
        check,
        1 if _named(word, keys) else 0,
        -1 if word in HASH_KEYS else 0,
        _name(v) if kind == "person" else 0,
        1 if tail[-1:] in (":", "=") else 0,
        1 if before[-1:] in ("\"", "'", "“") and t[b : b + 1] in ("\"", "'", "”") else 0,
        -1 if kind == "secret" and (not digits and v.rstrip(".!?").isalpha() or "://" in v or "|" in v) else 0,
        1 if kind == "secret" and ISSUED.match(v) else 0,
    ]
    length = min(3, max(0, (len(v) - 1).bit_length() - 3))
    return got, (ADDED.index(kind) * 4 + length) * 6 + min(2, int(h)) * 2 + mixed


def _keyed(t: str, at: int) -> bool:
    """Whether the word before a place names a secret; a value without digits needs that to be a candidate."""
    m = WORD_BEFORE.search(t[max(0, at - 40) : at])
    return m is not None and _named(m[1].lower(), SECRET_KEYS)


#: Of candidates that overlap, the first kind here stays.
PREFER = ("person", "iban", "ssn", "phone", "card", "secret")


def _values(t: str) -> Iterator[tuple[int, int]]:
    """Whole values after : or =; a long URL ends where a value inside it begins, so that its parameters are judged too."""
    at = 0
    while m := VALUE.search(t, at):
        a, at = m.span(1)
        keyed = _keyed(t, m.start())
        if at - a > LONG and not keyed and (t.startswith("//", a) or "://" in m[1]):
            inner = VALUE.search(t, a + LONG, at)
            at = inner.start() if inner else at
        b = a + len(t[a:at].rstrip(".!?)"))
        if keyed or DIGIT.search(t, a, b):
            yield a, b


class Taken:
    """Disjoint spans in order, to ask what overlaps them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)

    def gaps(self, a: int, b: int) -> list[tuple[int, int]]:
        """What the spans leave of a..b, parts of 6 characters or more."""
        out, k = [], bisect_right(self.ends, a)
        while k < len(self.starts) and self.starts[k] < b:
            out.append((a, self.starts[k]))
            a = max(a, self.ends[k])
            k += 1
        return [(x, y) for x, y in [*out, (a, b)] if y - x >= 6]


def candidates(t: str | None, taken: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, code) of the candidates of a text, apart from spans already taken."""
    if not t:
        return []
    found: list[tuple[int, int, str]] = []
    if "=" in t or ":" in t:
        found += [(*s, "secret") for s in _values(t)]
    if DIGIT.search(t):
        for m in TOKEN.finditer(t):
            a, b = m.span()
            while a and t[a - 1] in TOKEN_LEFT:
                a -= 1
            if b - a >= 16:
                if t[a] == "=":
                    a += 1
                k = t.find("=", a, b)  # key=value in one run: the value alone
                found.append((k + 1 if 0 <= k < b - 6 else a, b, "secret"))
        if "-" in t:
            found += [(*m.span(), "ssn") for m in SSN.finditer(t)]
        found += [(*m.span(), "card") for m in NUMBER.finditer(t)]
        if "+" in t:
            found += [(*m.span(), "phone") for m in CALL.finditer(t)]
        found += [(*m.span(), "iban") for m in IBAN.finditer(t)]
    if "r" in t or "s" in t:
        found += [(*m.span(), "person") for m in PERSON.finditer(t)]
    out, free = [], Taken(taken)
    for a, b, kind in sorted(set(found), key=lambda x: (PREFER.index(x[2]), x[0], -x[1])):
        parts = [(a, b)]
        if b <= a or free.overlaps(a, b):
            if kind != "secret" or b - a <= LONG:
                continue
            parts = free.gaps(a, b)
        for a, b in parts:
            free.add(a, b)
            v, shape = votes(kind, t[a:b], t, a, b)
            code = 0
            for x in v:
                code = code * 3 + x + 1
            out.append((ADDED.index(kind), a, b, code * 144 + shape))
    return sorted(out)


def unpack(code: int) -> tuple[np.ndarray, int]:
    v, shape = divmod(code, 144)
    return np.array([v // 3**i % 3 - 1 for i in range(len(LABELERS) - 1, -1, -1)]), shape


class SpanClassifier:
    """Label model and final classifier, fitted on (code, count) over the whole corpus."""

    def __init__(self, counts: dict[int, int], rounds: int = 200):
        self.codes = sorted(counts)
        n = np.array([counts[c] for c in self.codes], float)
        parts = [unpack(c) for c in self.codes]
        self.votes = np.array([p[0] for p in parts]).reshape(-1, len(LABELERS))
        self.shapes = np.array([p[1] for p in parts], int)
        self.reliability, self.prior, self.posterior = self._em(n, rounds)
        self._fit(n)

    def _em(self, n: np.ndarray, rounds: int):
        v = self.votes + 1
        share = v.mean(1) - 1 if len(v) else np.empty(0)
        post = 1 / (1 + np.exp(-6 * share))  # starts from the balance of votes
        k = len(LABELERS)
        table_ = np.full((2, k, 3), 1 / 3)
        prior = 0.5
        for _ in range(rounds if len(v) else 0):
            before = post
            prior = (1 + (n * post).sum()) / (2 + n.sum())
            for y, w in ((0, n * (1 - post)), (1, n * post)):
                for j in range(k):
                    # a prior of the size of a few votes keeps each labeler better than chance
                    table_[y, j] = np.bincount(v[:, j], w, 3) + np.array([[2, 1, 0.5], [0.5, 1, 2]][y])
                    table_[y, j] /= table_[y, j].sum()
            log = [np.log(p) + sum(np.log(table_[y, j, v[:, j]]) for j in range(k)) for y, p in ((0, 1 - prior), (1, prior))]
            post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            if np.abs(post - before).max() < 1e-9:
                break
        return table_, prior, post

    @staticmethod
    def _features(v: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        kind, rest = shapes // 24, shapes % 24
        hot = [np.eye(len(ADDED))[kind], np.eye(4)[rest // 6], np.eye(3)[rest % 6 // 2], (rest % 2)[:, None]]
        return np.concatenate([v > 0, v < 0, *hot, np.ones((len(v), 1))], axis=1).astype(float)

    def _fit(self, n: np.ndarray) -> None:
        """Newton steps of an L2-regularised logistic regression on the posteriors."""
        width = 2 * len(LABELERS) + len(ADDED) + 9
        self.w = np.zeros(width)
        if not len(n):
            return
        x = self._features(self.votes, self.shapes)
        weight = n / n.sum() * min(n.sum(), 1e4)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            g = x.T @ (weight * (p - self.posterior)) + 0.1 * self.w
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(width)
            step = np.linalg.solve(h, g)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def accepted(self, threshold: float = 0.5) -> list[int]:
        """Codes whose candidates become spans; a failed check digit is a veto."""
        if not self.codes:
            return []
        p = 1 / (1 + np.exp(-np.clip(self._features(self.votes, self.shapes) @ self.w, -30, 30)))
        check = self.votes[:, LABELERS.index("checksum")]
        return [c for c, q, k in zip(self.codes, p, check, strict=True) if q >= threshold and k >= 0]


SPANS = "array<struct<kind:int,a:int,b:int,code:long>>"
CANDIDATE = pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("code", pa.int64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, base_sha256, found): base spans, and the candidates."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            counts, base, shas, found = [[], [], [], []], [], [], []
            for t in batch.column(1).to_pylist():
                spans = base_spans(t)
                for c, s in zip(counts, spans, strict=True):
                    c.append(len(s))
                text = ",".join(f"{k}:{a}:{b}" for k, s in zip(BASE, spans, strict=True) for a, b in s)
                base.append([{"kind": k, "a": a, "b": b, "code": -1} for k, s in enumerate(spans) for a, b in s])
                shas.append(hashlib.sha256(text.encode()).hexdigest())
                found.append([{"kind": KINDS.index(ADDED[k]), "a": a, "b": b, "code": c} for k, a, b, c in candidates(t, [x for s in spans for x in s])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.list_(CANDIDATE)), pa.array(shas, pa.string()), pa.array(found, pa.list_(CANDIDATE))],
                ["id", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "found"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base {SPANS}, base_sha256 string, found {SPANS}")


def fit(scanned: DataFrame) -> SpanClassifier:
    """The classifier, from counts over every candidate of the corpus; a few hundred codes reach the driver."""
    counts = scanned.select(F.explode("found.code").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return SpanClassifier({r.code: r.n for r in counts.toLocalIterator()})


def label(scanned: DataFrame, model: SpanClassifier) -> DataFrame:
    """scanned with `spans`: the base spans and the accepted candidates by kind, then start."""
    codes = [int(c) for c in model.accepted()]
    keep = F.filter("found", lambda c: c["code"].isin(codes)) if codes else F.array().cast(SPANS)
    names = F.array(*(F.lit(k) for k in KINDS))
    every = F.array_sort(F.concat("base", keep))  # by kind, then start
    return scanned.withColumn("spans", F.array_join(F.transform(every, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["a"], c["b"])), ","))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by <kind>; all columns and rows stay, a null text stays null.

    The model is fitted on all of docs first; then each text is scanned again where it is read, so no text
    is shuffled.
    """
    scanned = materialise(scan(docs, id_col, text_col), "pii")
    codes = set(fit(scanned).accepted())
    discard(scanned)
    names = docs.columns
    at = names.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, text_col):
            out = [_redacted(t, codes) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(tidy(run), docs.schema)


def _redacted(t: str | None, codes: set[int]) -> str | None:
    if not t:
        return t
    base = base_spans(t)
    spans = [(a, b, k) for k, s in zip(BASE, base, strict=True) for a, b in s]
    spans += [(a, b, ADDED[k]) for k, a, b, c in candidates(t, [x for s in base for x in s]) if c in codes]
    out, at = [], 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
        if b <= at:
            continue
        out += [t[at : max(a, at)], f"<{k}>" if a >= at else ""]
        at = b
    return "".join([*out, t[at:]])


def op1_weak_supervision_pii(spark, sf_dir: str) -> DataFrame:
    scanned = materialise(scan(table(spark, sf_dir, "documents")), "pii")
    got = label(scanned, fit(scanned))
    return got.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
