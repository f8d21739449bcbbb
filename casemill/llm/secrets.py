"""Secret scans with a guess-cost estimate of credential values.

Three base patterns find assignments, access keys and hex runs. A wider pattern finds values in a credential context
(a key word before a separator, or the user part of a URL). For each such value dynamic programming finds the cheapest
way to guess it: every prefix's cost is the least over its last piece - a word (any case, common letter swaps), a date,
a repeat, a keyboard walk or a brute-force span - and values of at least GUESSES (log10) become spans of kind ``guess``.
A date is a possible day (or a year) between other characters than digits. A repeat's unit has UNIT characters at most
and costs what its own cheapest segmentation does, found by the same recursion.

The scan works on UTF-8 bytes (letter case is ASCII only) and reports code points.

Odd input: a null text is empty; a null id is kept; repeated rows give repeated rows; an empty table gives an empty
result; other columns are not read (redact keeps them).
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")
#: Credential contexts. The value is group 1 or 2. Key words that end ordinary words (bypass) begin a word or a part of one.
CONTEXT = re.compile(
    rb"""(?:(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z]))|(?<![a-z])(?:db|my|sql|pg|user|admin|root|mail|smtp|ftp|ssh|http|o))(?:pass|auth|bearer)"""
    rb"""|pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)["']?\x20*(?::=|=>|[:=])\x20*["']?([^\s"'<>,;&]{6,})"""
    rb"""|(?<=[a-z0-9+.-])://[^\s:/@"'<>]+:([^\s/@"'<>]{6,})@""",
    re.IGNORECASE,
)
#: One of these is in any text that CONTEXT or ASSIGN matches.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"bearer", b"://")
#: log10 of the guesses from which a value counts as a secret.
GUESSES = 8.0
#: Characters of a repeat's unit.
UNIT = 24
REDACTED = "[redacted]"

# Common words of passwords and of texts about them, most common first; the words of VOCABULARY follow.
VOCABULARY = "word_bpe_49k.json"
WORDS = """
password pass word admin user login root test guest welcome secret token key access letmein master qwerty dragon monkey
football baseball shadow sunshine princess iloveyou hello love summer winter spring autumn monday friday january june july
august october november december company change changeme default example sample temp temporary demo data server system
service public private secure security account email name none null true false required optional invalid value string
number field enter your forgot reset hint here this that with from have will must should please never share keep safe
home house water happy friend family mother father superman batman michael jordan robert daniel thomas charlie george
freedom computer internet apple orange banana cookie coffee pepper ginger tiger lion eagle star wars king queen blue green
red black white silver gold north south east west one two three four five six seven eight nine ten abc
""".split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SWAPS = {ord(a): b for a, b in zip("@4830!15$7", "aabeoiisst", strict=True)}


@functools.cache
def ranks() -> tuple[dict[str, float], int]:
    """log10 of each word's rank, and the longest word's length."""
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ends = (t[:-4] for t in sorted(vocab, key=vocab.get) if t.endswith("</w>"))
    words = dict.fromkeys([*WORDS, *(w for w in ends if len(w) >= 3 and w.isascii() and w.isalpha())])
    return {w: math.log10(i + 1) for i, w in enumerate(words)}, max(map(len, words))


_PLACE = {c: (r, i + r * 0.5) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row)}
_NEAR = {a: {b for b in _PLACE if b != a and abs(_PLACE[a][0] - _PLACE[b][0]) <= 1 and abs(_PLACE[a][1] - _PLACE[b][1]) <= 1} for a in _PLACE}
_DATE = re.compile(r"(?<!\d)(?=((\d{4})(?!\d)|(\d{6})(?!\d)|(\d{8})(?!\d)|(\d\d?)([-/.])(\d\d?)\6(\d{4}|\d\d)(?!\d)|(\d{4})([-/.])(\d\d?)\10(\d\d?)(?!\d)))")
_DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
WALK = math.log10(47)  # a walk's first key
_PIECE = 0.3  # log10 for choosing the kind of one more piece


def _char_cost(c: str) -> float:
    """log10 of the characters of c's class."""
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33) if c.isascii() else 2.0


def _brute(value: str) -> list[float]:
    """log10 guesses of each prefix by its characters' classes."""
    return [0.0, *itertools.accumulate(map(_char_cost, value))]


def _lower(value: str) -> str:
    return value.lower() if len(value.lower()) == len(value) else value


def _day(a: str, b: str) -> bool:
    """Whether two numbers are a day and a month, or a month and a day."""
    return any(1 <= m <= 12 and 1 <= d <= _DAYS[m - 1] for d, m in ((int(a), int(b)), (int(b), int(a))))


def _dates(value: str):
    """(start, end, log10 guesses) of the dates in a value: years of the last and this century, days with or without marks."""
    century = lambda y: len(y) == 2 or y[:2] in ("19", "20")
    for m in _DATE.finditer(value):
        whole, year, six, eight = m[1], m[2], m[3], m[4]
        if year:
            if century(year):
                yield m.start(), m.start() + 4, 2.1
            continue
        if six:
            ok = _day(six[:2], six[2:4]) or _day(six[2:4], six[4:])
        elif eight:
            ok = (century(eight[4:]) and _day(eight[:2], eight[2:4])) or (century(eight[:4]) and _day(eight[4:6], eight[6:]))
        elif m[5]:
            ok = century(m[8]) and _day(m[5], m[7])
        else:
            ok = century(m[9]) and _day(m[11], m[12])
        if ok:
            yield m.start(), m.start() + len(whole), 4.6


def _turns(low: str) -> list[int | None]:
    """For each place, the changes of direction up to it of the keyboard walk that it goes on with; None where it begins one."""
    out: list[int | None] = [None] * len(low)
    way = None
    for j in range(1, len(low)):
        if low[j] not in _NEAR.get(low[j - 1], ()):
            continue
        (r, x), (s, y) = _PLACE[low[j - 1]], _PLACE[low[j]]
        old, way = way, (s - r, y > x)
        out[j] = 0 if out[j - 1] is None else out[j - 1] + (way != old)
    return out


def _words_and_dates(value: str) -> list[tuple[int, int, float, str]]:
    n, out = len(value), []
    rank, longest = ranks()
    low = _lower(value)
    plain = low.translate(SWAPS)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for text, more in ((low[i:j], 0.0), (plain[i:j], 0.6)):
                if text in rank:
                    case = value[i:j]
                    out.append((i, j, rank[text] + more + (0.0 if case == case.lower() else 0.3 if case[0].isupper() else 0.9), "word"))
                    break
    return out + [(i, j, cost, "date") for i, j, cost in _dates(value)]


def pieces(value: str, unit: int = UNIT) -> list[tuple[int, int, float, str]]:
    """The pieces other than brute force that can make up parts of a value: start, end, log10 guesses, kind. Walks and
    repeats may end at any place, so a long value can have many; guess_cost doesn't write them out."""
    n, out, turns = len(value), _words_and_dates(value), _turns(_lower(value))
    for i in range(n):
        j = i + 1
        while j < n and turns[j] is not None:
            j += 1
            if j - i >= 4:
                out.append((i, j, WALK + 0.8 * (turns[j - 1] - turns[i + 1]) + math.log10(j - i), "walk"))
        for period in range(1, unit + 1):
            times = 2
            while value[i : i + period] == value[i + (times - 1) * period : i + times * period] and i + times * period <= n:
                if times * period >= 3:
                    out.append((i, i + times * period, unit_cost(value[i : i + period]) + math.log10(times), "repeat"))
                times += 1
    return out


def _best_start(starts: list[tuple[float, int]], a: float, s: int, j: int) -> float:
    """The least a + log10(j - s) of starts (a, s) by rising s, with a new last one. A start that an earlier one undercuts
    once stays undercut (the gap between the logarithms only shrinks), as does one whose a a later one doesn't exceed, so
    both are taken out."""
    while starts and starts[-1][0] >= a:
        starts.pop()
    starts.append((a, s))
    kept: list[tuple[float, int]] = []
    least = math.inf
    for a, s in starts:
        if (cost := a + math.log10(j - s)) < least:
            least = cost
            kept.append((a, s))
    starts[:] = kept
    return least


@functools.lru_cache(1 << 16)
def unit_cost(unit: str) -> float:
    """What a repeat's unit costs: its own cheapest segmentation, repeats of shorter units among its pieces."""
    return guess_cost(unit, len(unit) // 2)


def guess_cost(value: str, unit: int = UNIT) -> float:
    """log10 of the guesses that the cheapest segmentation of a value needs; unit: the characters of a repeat's unit at most."""
    n = len(value)
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost, _ in _words_and_dates(value):
        ending.setdefault(j, []).append((i, cost))
    turns = _turns(_lower(value))
    best, brute = [0.0], [0.0]  # least cost of a prefix; of one that ends in a brute-force span
    walks: list[tuple[float, int]] = []
    runs = [0] * (unit + 1)  # for each period, how many places in a row repeat what is a period before
    repeats: list[dict[int, list[tuple[float, int]]]] = [{} for _ in runs]
    for j in range(1, n + 1):
        costs = [min(brute[j - 1] if j > 1 else math.inf, best[j - 1] + _PIECE) + _char_cost(value[j - 1])]
        brute.append(costs[0])
        costs += [best[i] + _PIECE + cost for i, cost in ending.get(j, ())]
        if turns[j - 1] is None:
            walks = []
        elif j >= 4 and turns[j - 2] is not None and turns[j - 3] is not None:
            costs.append(_best_start(walks, best[j - 4] - 0.8 * turns[j - 3], j - 4, j) + _PIECE + WALK + 0.8 * turns[j - 1])
        for p in range(1, min(unit + 1, j)):
            if value[j - 1] != value[j - 1 - p]:
                runs[p], repeats[p] = 0, {}
                continue
            runs[p] += 1
            times = 3 if p == 1 else 2
            if runs[p] >= (times - 1) * p:
                s = j - times * p
                starts = repeats[p].setdefault(j % p, [])
                costs.append(_best_start(starts, best[s] + unit_cost(value[s : s + p]), s, j) - math.log10(p) + _PIECE)
        best.append(min(costs))
    return best[n] - _PIECE if n else 0.0


def scan(text: str | None, least: float = GUESSES) -> tuple[list[tuple[int, int, str]], float | None]:
    """Spans (start, end, kind) in code points, by start and then kind; the highest cost of a credential value."""
    raw = (text or "").encode()
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw)]
    low, top = raw.lower(), None
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw) if len(m[2]) >= 6]
        for m in CONTEXT.finditer(raw):
            g = 1 if m[1] is not None else 2
            cost = guess_cost(m[g].decode(errors="replace"))
            top = cost if top is None else max(top, cost)
            if cost >= least:
                found.append((m.start(g), m.end(g), "guess"))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    if found and len(raw) != len(text):
        at = {0: 0}
        here = chars = 0
        for b in sorted({x for s in found for x in s[:2]}):
            chars += len(raw[here:b].decode(errors="ignore"))
            at[b] = chars
            here = b
        found = [(at[a], at[b], k) for a, b, k in found]
    return found, top


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan_batches(least: float):
    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                done = [scan(t, least) for t in batch.column(1).to_pylist()]
                count = lambda kind: pa.array([sum(s[2] == kind for s in d[0]) for d in done], pa.int64())  # noqa: B023, E731
                base = [hashlib.sha256(written(s for s in d[0] if s[2] != "guess").encode()).hexdigest() for d in done]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0), "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "n_guess": count("guess"), "base_sha256": pa.array(base, pa.string()), "spans": pa.array([written(d[0]) for d in done], pa.string()), "log10_guesses": pa.array([d[1] for d in done], pa.float64())}
                )

    return run


def find_secrets(docs: DataFrame, least: float = GUESSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of counts and spans for each row; log10_guesses is the highest cost of its credential values (null: none)."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, log10_guesses double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan_batches(least), schema)


def without_spans(text: str, spans, mark: str = REDACTED) -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, least: float = GUESSES, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows with their secrets replaced, and their length column (if there is one) brought up to date."""
    names = docs.columns
    at = names.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                texts = batch.column(at).to_pylist()
                new = [without_spans(t, s) if t and (s := scan(t, least)[0]) else t for t in texts]
                cols = batch.columns
                cols[at] = pa.array(new, batch.schema.field(at).type)
                if length is not None:
                    old = batch.column(length).to_pylist()
                    cols[length] = pa.array([o if t is u else len(u) for o, t, u in zip(old, texts, new, strict=True)], batch.schema.field(length).type)
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
