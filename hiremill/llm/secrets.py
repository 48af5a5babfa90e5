"""Secret scans: fixed credential patterns, and values in credential context weighed by their guess cost."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiremill.llm.common import once

#: Fixed patterns, in the order in which spans of one start are listed.
ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "guess")
#: Where a credential may stand that the patterns above leave out: a credential word, a link of a few
#: characters, and a value; or the password of a URL.
_WORD = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_ -]?key"
    r"|credentials?|bearer|auth|login|pin|key)"
)
#: Matches are searched from every credential word, so that one cannot swallow the next; what follows a
#: mere space is no value if it is a credential word itself or ends like the left side of an assignment.
CONTEXT = re.compile(
    rf"(?<![A-Za-z0-9])(?=(?i:{_WORD.replace('|key)', ')')})"
    r"(?:[\"'`]?[ \t]{0,3}(?:[:=]{1,2}|=>|->|\bis\b|\bwas\b)[ \t]{0,3}"
    rf"|[ \t](?!(?i:{_WORD})(?![A-Za-z0-9])|[^\s\"'`<>]*[:=][\"'`]?(?:\s|$)))[\"'`]?([^\s\"'`<>]))",
    re.ASCII,
)
VALUE_END = re.compile(r"[\s\"'`<>]", re.ASCII)
URL_PASSWORD = re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,15}://[^\s:/@\"']*+:([^\s/@\"']++)@", re.ASCII)
#: A value is reported if it takes at least ten to this power guesses, has this many characters,
#: and is of two classes: letters or digits, and digits, symbols or inner capitals. Marks that join words in
#: prose ("well-known", "and/or") are no symbols. A brute-forced character costs as much as the value's alphabet has.
LEAST_LOG10 = 10.0
LEAST_CHARS = 8
#: A text without any of these, lower-cased, has no match of the pattern; plain search is far faster.
ASSIGN_GATE = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_GATE = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "login", "pin")

#: The most common words of leaked passwords, most common first.
COMMON_WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login princess sunshine football "
    "baseball shadow superman michael batman trustno1 hello freedom whatever hunter ranger jordan harley "
    "buster soccer hockey killer george charlie andrew daniel thomas jessica pepper ginger summer winter "
    "spring autumn orange purple silver golden flower cheese computer internet secret access pass test "
    "user root guest default change changeme temp demo server system network database backup service "
    "public private token key code home work love money magic happy star blue green black white red cat "
    "dog fish bird tiger lion eagle house apple banana cookie coffee chocolate music guitar family friend "
    "mother father sister brother king queen angel devil heaven world space moon sun fire water earth "
    "january february march april may june july august september october november december monday "
    "tuesday wednesday thursday friday saturday sunday"
).split()
#: Rows of a keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4@8310!$5+7", "aabeioisstt")


@dataclass(frozen=True)
class Lexicon:
    """Ranks of words; the longest of them, and the first three letters that a word begins with in either direction."""

    ranks: dict[str, int]
    longest: int
    beginnings: frozenset[str]

    @classmethod
    def of(cls, words: Iterable[str]) -> Lexicon:
        ranks: dict[str, int] = {}
        for word in words:
            ranks.setdefault(word, len(ranks) + 1)
        return cls(ranks, max(map(len, ranks)), frozenset(w[:3] for r in ranks for w in (r, r[::-1])))


def _neighbours() -> set[tuple[str, str]]:
    return {pair for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False) for pair in ((a, b), (b, a))}


LEXICON = Lexicon.of(COMMON_WORDS)
NEIGHBOURS = _neighbours()
#: Words of a corpus that are ranked after those above, by their number in all documents, and the letters they have.
CORPUS_WORDS = 5000
WORD_CHARS = (4, 16)
DATE = re.compile(
    r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)$"
)
LONGEST_DATE = 10
#: Costs of one segment, in powers of ten: a brute-forced character, a date, and the choice to begin a segment.
CHAR_COST = 1.0
DATE_COST = math.log10(365 * 120)
YEAR_COST = math.log10(120)
SEGMENT_COST = math.log10(2)
#: Longest unit of a repeat.
LONGEST_UNIT = 8
#: Marks between letters or between digits.
JOINERS = re.compile(r"(?<=[^\W\d_])[-/_.,:;&+|()]+(?=[^\W\d_])|(?<=\d)[-/_.,:;&+|()]+(?=\d)")


def word_cost(segment: str, lexicon: Lexicon = LEXICON) -> float | None:
    """Guesses for a common word: its rank, doubled for capitals, for letter substitutions and for reversal."""
    low = segment.lower()
    best = None
    for word, extra in ((low, 0), (low[::-1], 1), (low.translate(LEET), 1), (low.translate(LEET)[::-1], 2)):
        if word in lexicon.ranks:
            cost = math.log10(lexicon.ranks[word]) + extra * math.log10(2)
            best = cost if best is None else min(best, cost)
    return best if best is None or segment == low else best + math.log10(2)


def date_cost(segment: str) -> float | None:
    if not DATE.match(segment):
        return None
    return YEAR_COST if len(segment) == 4 else DATE_COST


def walk_cost(length: int) -> float:
    """Guesses for a run along a keyboard row: a starting key, a direction and a length."""
    return math.log10(len(KEY_ROWS) * 12 * 2 * max(length, 1))


def alphabet_cost(value: str) -> float:
    """Power of ten of the characters that each brute-forced one of the value may be."""
    size = sum(n for n, kind in ((10, str.isdigit), (26, str.islower), (26, str.isupper)) if any(map(kind, value)))
    return max(CHAR_COST, math.log10(max(1, size + 33 * any(not c.isalnum() for c in value))))


def is_mixed(value: str) -> bool:
    """Whether a value has digits, symbols or inner capitals beside letters, or symbols beside digits."""
    letters = any(map(str.isalpha, value))
    digits = any(map(str.isdigit, value))
    symbols = any(not c.isalnum() for c in JOINERS.sub("", value))
    inner = any(a.islower() and b.isupper() for a, b in zip(value, value[1:], strict=False))
    return letters + digits + symbols + inner > 1


class RunEnds:
    """The cheapest segment that ends at a place, of those whose cost is the logarithm of their length plus a constant.

    Starts are added in ascending order. A longer segment gains on a shorter one as both grow, so starts stand
    on a stack, each with the place where the one below it takes over, and every start is added and removed once.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[int, float, float]] = []

    def add(self, start: int, cost: float, end: int) -> None:
        while self.stack:
            below, below_cost, overtaken = self.stack[-1]
            if below_cost + math.log10(end - below) <= cost + math.log10(end - start):
                return
            ratio = 10 ** min(cost - below_cost, 300.0)
            place = (ratio * start - below) / (ratio - 1) if ratio > 1 else math.inf
            if overtaken > place or len(self.stack) == 1:
                self.stack.append((start, cost, place))
                return
            self.stack.pop()
        self.stack.append((start, cost, math.inf))

    def least(self, end: int) -> float:
        while len(self.stack) > 1 and self.stack[-1][2] <= end:
            self.stack.pop()
        start, cost, _ = self.stack[-1]
        return cost + math.log10(end - start)


def guess_cost(value: str, char_cost: float = CHAR_COST, lexicon: Lexicon = LEXICON, enough: float = math.inf) -> float:
    """Power of ten of the guesses the cheapest segmentation of the value takes.

    Segments are words, dates, repeats of a unit, keyboard walks and brute-forced spans, at any place; costs
    add up. The program keeps the cheapest cost of every prefix. Words and dates have bounded length; repeats
    and walks of any length are taken from `RunEnds`, so its time grows with the length alone. Where no way
    to go on can cost less than `enough`, it ends with a cost of at least that.
    """
    n = len(value)
    if not n:
        return 0.0
    best = [0.0] * (n + 1)
    brute = [math.inf] * (n + 1)
    walk_from, walks = 0, RunEnds()
    repeat_from = [0] * (LONGEST_UNIT + 1)
    repeats = [RunEnds() for _ in range(LONGEST_UNIT + 1)]
    low = value.lower()
    plain = low.translate(LEET)
    reach = max(lexicon.longest, LONGEST_DATE)
    begun: deque[int] = deque()
    for end in range(1, n + 1):
        at = end - 1
        brute[end] = min(best[at] + SEGMENT_COST, brute[at]) + char_cost
        cheapest = brute[end]
        start = end - 3
        if start >= 0 and (value[start].isdigit() or low[start:end] in lexicon.beginnings or plain[start:end] in lexicon.beginnings):
            begun.append(start)
        while begun and begun[0] < end - reach:
            begun.popleft()
        for start in begun:
            segment = value[start:end]
            for cost in (word_cost(segment, lexicon), date_cost(segment)):
                if cost is not None:
                    cheapest = min(cheapest, best[start] + SEGMENT_COST + cost)
        if at and (low[at - 1], low[at]) not in NEIGHBOURS:
            walk_from, walks = at, RunEnds()
        if end - walk_from >= 3:
            walks.add(end - 3, best[end - 3], end)
            cheapest = min(cheapest, walks.least(end) + SEGMENT_COST + walk_cost(1))
        for unit in range(1, LONGEST_UNIT + 1):
            if at >= unit and value[at] != value[at - unit]:
                repeat_from[unit], repeats[unit] = at - unit + 1, RunEnds()
            start = end - max(2 * unit, 3)
            if start >= repeat_from[unit]:
                repeats[unit].add(start, best[start], end)
                cost = unit * char_cost - math.log10(unit)
                cheapest = min(cheapest, repeats[unit].least(end) + SEGMENT_COST + cost)
        best[end] = cheapest
        if end % 16 == 0 and enough < math.inf:
            first = min(walk_from, end - reach, *repeat_from[1:])
            if end - first <= 64 and min(brute[end], *best[max(first, 0) : end + 1]) >= enough:
                return max(enough, min(brute[end], best[end]))
    return best[n]


def _any_in(parts: Sequence[str], text: str) -> bool:
    return any(part in text for part in parts)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind."""
    found = []
    if _any_in(ASSIGN_GATE, text.lower()):
        found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def guessed_spans(
    text: str, taken: Sequence[tuple[int, int, str]], lexicon: Lexicon = LEXICON
) -> list[tuple[int, int, str]]:
    """Values in credential context that take many guesses and that no span of the fixed patterns overlaps.

    A value ends with its token. Of the values that begin inside one token, the first that no span overlaps
    decides for all, so the time grows with the text alone.
    """
    values = []
    if "://" in text:
        values = [m.span(1) for m in URL_PASSWORD.finditer(text)]
    if _any_in(CONTEXT_GATE, text.lower()):
        end = -1
        for match in CONTEXT.finditer(text):
            start = match.start(1)
            if start >= end:
                stop = VALUE_END.search(text, start)
                end = stop.start() if stop else len(text)
            values.append((start, end))
    found = []
    last = decided = -1
    spans = sorted((s, e) for s, e, _ in taken)
    starts = [s for s, _ in spans]
    furthest = list(accumulate((e for _, e in spans), max))
    for start, end in sorted(values):
        if start < last or end == decided:
            continue
        token = end
        while end > start and text[end - 1] in ".,;:!?)]}":
            end -= 1
        before = bisect_left(starts, end)
        if end - start < LEAST_CHARS or (before and furthest[before - 1] > start):
            continue
        decided = token
        value = text[start:end]
        if is_mixed(value) and guess_cost(value, alphabet_cost(value), lexicon, LEAST_LOG10) >= LEAST_LOG10:
            found.append((start, end, "guess"))
            last = end
    return found


def find_secrets(text: str | None, lexicon: Lexicon = LEXICON) -> list[tuple[int, int, str]]:
    """All spans by start and kind; offsets in code points, the end not included."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + guessed_spans(text, base, lexicon), key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: Sequence[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def corpus_words(docs: DataFrame, text: str = "text", most: int = CORPUS_WORDS) -> tuple[str, ...]:
    """The most frequent words of all documents, `most` of them at most; every occurrence counts.

    Words are counted where they stand and merged by shuffle; only the words returned reach the driver. Ties go by
    the words themselves.
    """
    least, longest = WORD_CHARS
    pattern = F.lit(rf"(?<!\p{{L}})\p{{L}}{{{least},{longest}}}(?!\p{{L}})")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), pattern, F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return tuple(r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect())


def with_secrets(docs: DataFrame, text: str = "text", words: Sequence[str] = ()) -> DataFrame:
    """The documents with `secrets`: an array of kind, start, end, value and log10_guesses.

    log10_guesses is that of the value alone: group 2 of an assignment, the whole match otherwise. `words` are
    taken as common, after the library's own.
    """
    known = tuple(words)

    @F.pandas_udf("array<struct<kind: string, start: long, end: long, value: string, log10_guesses: double>>")
    def compute(texts: pd.Series) -> pd.Series:
        lexicon = _lexicon(known)
        return pd.Series([[_described(t, s, lexicon) for s in find_secrets(t, lexicon)] for t in texts], dtype=object)

    return docs.withColumn("secrets", compute(F.col(text)))


def _lexicon(words: tuple[str, ...]) -> Lexicon:
    return once(("lexicon", words), lambda: Lexicon.of([*COMMON_WORDS, *words]))


def _described(text: str, span: tuple[int, int, str], lexicon: Lexicon) -> dict:
    start, end, kind = span
    value = text[start:end]
    if kind == "assign":
        value = ASSIGN.match(text, start, end)[2]
    return {"kind": kind, "start": start, "end": end, "value": value, "log10_guesses": guess_cost(value, alphabet_cost(value), lexicon)}


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess.

    Defined cases: a null text is an empty one, with no span, zero counts and the digest of the empty
    string; a null id stays null; repeated rows stay repeated; an empty table gives an empty result;
    other columns are ignored. Values of any length are weighed whole. Words are ranked by their number in all documents
    (`corpus_words`).
    """
    known = corpus_words(docs)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(known)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                spans = find_secrets(text, lexicon)
                base = [s for s in spans if s[2] != "guess"]
                counts = [sum(s[2] == kind for s in spans) for kind in KINDS]
                out.append((doc_id, *counts[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), counts[3]))
            frame = pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])
            yield frame.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInPandas(digest, schema)
