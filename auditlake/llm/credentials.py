"""Problem 5: credentials in source code and snippets, reported by line and redacted in place.

Candidates are the values of string literals (pieces joined by + count as one), of settings lines, of connection
strings, of authorization headers, of comments that speak of a login, and private key blocks. A logistic regression
scores each from three kinds of evidence: how likely its characters are under Markov chains of credentials and of
ordinary words, the identifiers around it, and its path. Its training rows are labelled weakly, by patterns, which are
no evidence themselves; they are all candidates that patterns label. The evidence is written once and read in each
round of the fit, which adds up losses and gradients of all rows where they lie. Its weights are held near known ones,
which decide alone where there is nothing to learn from. Scores are calibrated on a part held out. A last exact check
drops masked values, references, plain identifiers, paths and hashes.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.storage import spread, staged

_LITERAL = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`'
CHAIN = re.compile(rf"(?:{_LITERAL})(?:\s*\+\s*(?:{_LITERAL}))*")
PIECE = re.compile(_LITERAL)
#: What precedes a value in its line, turned around: a name and an assignment, with a type in between, or a name and a
#: sign of an argument; what was looked up before an alternative to a missing value; an earlier literal argument.
NAMED_BEFORE = re.compile(r"[^\S\n]*\(?[^\S\n]*>?=[^\S\n]*(?:[\]\w<>?.\[]+[^\S\n]*:[^\S\n]*)?[\"'\]]*([\w.\-]*[A-Za-z_])|[^\S\n]*[:,(][^\S\n]*[\"']?([\w.\-]*[A-Za-z_])")
FALLBACK_BEFORE = re.compile(r"[^\S\n]*(?:\|\||\?\?|:\?|ro\b)[^\S\n]*(?:\)[\"']([\w.\-]+)[\"']\()?([\w.]*[A-Za-z_])")
ARGUMENT_BEFORE = re.compile(r"[^\S\n]*,[^\S\n]*[\"'`]")
#: A call that logs in: its arguments name the user and then the password.
LOGIN = re.compile(r"(?i)(?:connect|login|log_in|credential|sign_?in|authenticate)\w*[^\S\n]*\(")
NEWLINE = re.compile(r"\n")
#: A user and a password given to a command.
COMMAND = re.compile(r"(?:\s-u|--user)[ =]+([^\s:'\"`]+):([^\s'\"`]+)")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=]{32,}")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
SETTING = re.compile(r"^[ \t]*([A-Za-z_][\w.\-]*)=([^\s\"'`;,(){}<>]+)[ \t]*\r?$", re.M)
COMMENT = re.compile(r"(?:(?<![:\w\"'`])//|^[ \t]*#|/\*|^[ \t]*\*)[^\n]*", re.M)
SPEAKS = re.compile(r"(?i)\b(?:pw|pwd|pass|password|passwd|passphrase|login|secret|token|key|credentials?)\b")
COMMENT_WORD = re.compile(r"(?<!\S)[^\s\"'`,;]+")
USERINFO = re.compile(r"://([^:/\s@]*):([^@\s/]+)@")
PARAMETER = re.compile(r"(?i)[?&;](?:password|passwd|pwd|secret|token|api_?key|access_?key)=([^&;\s\"']+)")
SCHEME = re.compile(r"(?i)^\s*(bearer|basic|token|apikey)\s+(\S+)\s*$")
DEFAULT = re.compile(r"\$\{([\w.\-]+):([^}]+)\}")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

#: The forms of well-known tokens, as their issuers publish them.
ISSUED = re.compile(
    r"(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|glpat-[\w\-]{20,}|npm_[A-Za-z0-9]{36}|"
    r"xox[abeoprs]-\d+-[\w\-]{8,}|[a-z]{2,5}_(?:live|prod|test|dev|stg)_[A-Za-z0-9]{16,}|AIza[\w\-]{35}|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,}|SG\.[\w\-]{16,}\.[\w\-]{16,}"
)
SECRET_WORDS = {"password", "passwd", "passphrase", "pwd", "pass", "pw", "secret", "credential", "credentials", "apikey", "passcode"}
SECRET_PAIRS = {
    ("api", "key"), ("access", "key"), ("access", "token"), ("auth", "token"), ("signing", "key"), ("encryption", "key"), ("private", "key"),
    ("refresh", "token"), ("bearer", "token"), ("bot", "token"), ("master", "key"), ("account", "key"), ("deploy", "token"), ("session", "secret"),
}
LABEL_PAIRS = {
    ("password", "hint"), ("password", "field"), ("password", "reset"), ("token", "url"), ("token", "header"), ("secret", "path"),
    ("cache", "key"), ("public", "key"), ("trace", "key"), ("secret", "name"), ("token", "type"), ("key", "id"), ("key", "name"),
}
HOLLOW = re.compile(
    r"(?i)\*{3,}|x{6,}|\.{3,}|\$\{[^}:]*\}|\$\(|\{\{|%\(|<[^>]*>|^\{[^}]*\}$|change_?-?me|replace_?-?me|dummy|insert-|your[-_]|place_?holder|example|redacted|"
    r"^(?:none|null|todo|tbd|secret|password|passwd|test|unset|empty|foobar|undefined)$|^(.)\1+$|^(?:vault|env|ssm|kms|secret|file):|getenv|environ|"
    r"BEGIN (?:[A-Z]+ )*PUBLIC KEY|^data:|ABCDEFGHIJ|abcdefghij|0123456789"
)
LABELLED = re.compile(r"^/?[a-z][\w\-]*(?:/[\w\-]+)+$|^[a-z]\w*(?:\.[a-z]\w*)+$|^[a-z]+(?:_[a-z]+)+$|^X-[A-Z]|^[a-z]+(?:[A-Z][a-z]+)+$|(?i:^[a-z_\-]*(?:password|token|secret|header)[a-z_\-]*$)")
HEX = re.compile(r"[0-9a-fA-F]{16,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
WORDY = re.compile(r"^[a-z]+(?:-[a-z]+)+$")

#: Values at least as long that no form or name calls a credential are data.
BLOB = 60

CANDIDATE = "origin string, record_id string, path string, context string, key string, value string, line_no int, starts array<int>, ends array<int>, label int"


def words_of(name: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(name)]


def is_secret_name(words: list[str]) -> bool:
    """Whether a name speaks of a credential, and not of a label, place or public part of one."""
    pairs = set(zip(words, words[1:]))
    if words[:2] == ["secret", "label"]:
        return False
    return bool(pairs & SECRET_PAIRS or SECRET_WORDS & set(words)) and not pairs & LABEL_PAIRS


_secret_names: dict[str, bool] = {}


def _speaks_of_secrets(name: str) -> bool:
    """is_secret_name of a name's words, remembered up to a bound."""
    known = _secret_names.get(name)
    if known is None:
        if len(_secret_names) >= 100_000:
            _secret_names.clear()
        known = _secret_names[name] = is_secret_name(words_of(name))
    return known


def hollow(value: str) -> bool:
    """Whether a value is masked, a placeholder or a reference."""
    return bool(HOLLOW.search(value))


def no_case(key: str, value: str) -> bool:
    """The exact check: masked values, placeholders, references, plain identifiers, paths, and hashes under other names."""
    return hollow(value) or value.islower() and bool(LABELLED.search(value)) and not WORDY.match(value) or bool(HEX.fullmatch(value)) and not _speaks_of_secrets(key)


def weak_label(context: str, words: list[str], value: str) -> int | None:
    """1 or 0 where patterns say so; none where they say nothing."""
    if hollow(value):
        return 0
    if context == "pem" or ISSUED.search(value):
        return 1
    if LABELLED.search(value):
        return 0
    if context in ("url", "header"):
        return 1
    if is_secret_name(words) and len(value) >= 6 and " " not in value:
        return 1
    if HEX.fullmatch(value) or not re.search(r"\d", value) or len(value) < 16 or len(value) >= BLOB:
        return 0
    return None


class Places:
    """Where lines begin in a text, and what stands before a place in its line, however long the line is.

    Patterns of what precedes a place are matched backwards from it, in the text turned around.
    """

    def __init__(self, text: str):
        self.turned, self.size = text[::-1], len(text)
        self.ends = [m.start() for m in NEWLINE.finditer(text)]
        self.logins = [m.end() for m in LOGIN.finditer(text)]

    def line(self, at: int) -> int:
        """The number of lines that end before a place."""
        return bisect_left(self.ends, at)

    def before(self, pattern: re.Pattern, at: int) -> tuple[str, ...] | None:
        """The groups of what a turned pattern takes before a place, read forwards; none if it takes nothing."""
        m = pattern.match(self.turned, self.size - at)
        return tuple((g or "")[::-1] for g in m.groups()) if m else None

    def logs_in(self, at: int) -> bool:
        """Whether a call that logs in began in the line of a place."""
        nth, line = bisect_right(self.logins, at), self.line(at)
        return nth > 0 and self.logins[nth - 1] > (self.ends[line - 1] if line else -1)


def _inner(value: str, key: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, context, name) of the parts of a literal's value that are credentials by their form."""
    if "://" in value:
        yield from ((x.start(2), x.end(2), "url", "connection password") for x in USERINFO.finditer(value))
    if "=" in value:
        yield from ((x.start(1), x.end(1), "url", "connection password") for x in PARAMETER.finditer(value))
    if "${" in value:
        yield from ((x.start(2), x.end(2), "default", x.group(1)) for x in DEFAULT.finditer(value))
    if " " in value and (scheme := SCHEME.match(value)):
        yield scheme.start(2), scheme.end(2), "header", f"{key} authorization"


def candidates(text: str, places: Places | None = None) -> Iterator[tuple[str, str, str, int, list[int], list[int]]]:
    """(context, key, value, start, piece starts, piece ends) of everything in a text that could be a credential.

    Values under names that speak of credentials may have any length, other literals have 12 characters at least.
    """
    places = places or Places(text)
    for m in PEM.finditer(text):
        end = PEM_END.search(text, m.end())
        stop = end.start() if end else len(text)
        bodies = list(PEM_BODY.finditer(text, m.end(), stop))
        if bodies:
            yield "pem", "private key", bodies[0].group(), m.start(), [b.start() for b in bodies], [b.end() for b in bodies]
    for m in CHAIN.finditer(text):
        raw = m.group()
        if len(raw) < 3 or "PRIVATE KEY" in raw:
            continue
        at = m.start()
        pieces = [(p.start() + at + 1, p.end() + at - 1) for p in PIECE.finditer(raw)] if "+" in raw else [(at + 1, m.end() - 1)]
        value = "".join(text[a:b] for a, b in pieces) if len(pieces) > 1 else raw[1:-1]
        if not value:
            continue
        named = places.before(NAMED_BEFORE, at)
        key = named[0] or named[1] if named else ""
        if not named and (fallback := places.before(FALLBACK_BEFORE, at)):
            key = fallback[0] or fallback[1]
        login = not (named and named[0]) and places.before(ARGUMENT_BEFORE, at) is not None and places.logs_in(at)
        if login:
            key = "login password"
        one, found = len(pieces) == 1, False
        for a, b, context, name in _inner(value, key):
            found = True
            if one:
                yield context, name, value[a:b], pieces[0][0] + a, [pieces[0][0] + a], [pieces[0][0] + b]
            else:
                yield context, name, value[a:b], pieces[0][0], [p[0] for p in pieces], [p[1] for p in pieces]
        if found or "://" in value or len(value.split(None, 1)) != 1 or value[0].isspace() or value[-1].isspace():
            continue
        if _speaks_of_secrets(key) or (len(value) >= 12 and not value.isalpha()):
            yield "login" if login else "literal", key, value, pieces[0][0], [p[0] for p in pieces], [p[1] for p in pieces]
    for m in COMMAND.finditer(text):
        yield "url", "connection password", m.group(2), m.start(2), [m.start(2)], [m.end(2)]
    for m in SETTING.finditer(text):
        if _speaks_of_secrets(m.group(1)):
            yield "setting", m.group(1), m.group(2), m.start(2), [m.start(2)], [m.end(2)]
    for m in COMMENT.finditer(text):
        if SPEAKS.search(m.group()) and not CHAIN.search(m.group()):
            name = " ".join(SPEAKS.findall(m.group()))
            for w in COMMENT_WORD.finditer(m.group()):
                value = w.group().rstrip(".:)")
                if re.search(r"[A-Za-z]", value) and (re.search(r"\d", value) or WORDY.match(value)) and not value.startswith(("/", "*", "#", "(")):
                    start = m.start() + w.start()
                    yield "comment", f"{name} password", value, start, [start], [start + len(value)]


class Values:
    """The characters of many values in one array, with a mark before each: sums over a value's characters at once."""

    def __init__(self, values: list[str]):
        raw = np.frombuffer(("\x7f" + "\x7f".join(values) + "\x7f").encode("ascii", "replace"), np.uint8)
        self.sizes = np.fromiter(map(len, values), np.int64, len(values))
        self.first = np.concatenate(([0], np.cumsum(self.sizes + 1)[:-1])) if len(values) else np.zeros(0, np.int64)
        self.raw, self.codes = raw, np.clip(raw.astype(np.int64) - 31, 0, 96)

    def sums(self, numbers: np.ndarray) -> np.ndarray:
        """Sums of a number for each character over each value and the mark before it."""
        return np.add.reduceat(numbers, self.first) if len(self.first) else np.zeros(0)

    def share(self, low: str, high: str) -> np.ndarray:
        return self.sums(((self.raw[:-1] >= ord(low)) & (self.raw[:-1] <= ord(high))).astype(float)) / np.maximum(1, self.sizes)

    def entropy(self) -> np.ndarray:
        """Bits a character."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        inside = np.ones(len(owner), bool)
        inside[self.first] = False
        keys, counts = np.unique(owner[inside] * 97 + self.codes[:-1][inside], return_counts=True)
        shares = counts / np.maximum(1, self.sizes[keys // 97])
        return np.bincount(keys // 97, -shares * np.log2(shares), len(self.sizes))


def pairs_of(values: list[str]) -> np.ndarray:
    """How often each character of many values follows each."""
    codes = Values(values).codes
    return np.bincount(codes[:-1] * 97 + codes[1:], minlength=97 * 97).reshape(97, 97)


class Markov:
    """A chain of characters of order one over printable ASCII, other characters as one."""

    def __init__(self, values: list[str], counts: np.ndarray | None = None):
        """counts: pairs_of the values where they are counted already; counts add up."""
        counts = (pairs_of(values) if counts is None else counts) + 1.0
        self.logs = np.log(counts / counts.sum(1, keepdims=True))

    def means(self, values: Values) -> np.ndarray:
        return values.sums(self.logs[values.codes[:-1], values.codes[1:]]) / (values.sizes + 1)


HASHED = 65_536
DENSE = 20
RUNS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9./_\-]+")


def _shape(value: str) -> str:
    """The kinds of characters a value runs through; mixed if it runs through many."""
    shape = RUNS.sub(lambda m: "a" if m.group().islower() else "A" if m.group().isupper() else "9" if m.group().isdigit() else "x", value[:64])
    return shape if len(shape) <= 12 and len(value) <= 64 else f"mixed {len(value) > 64}"


def _slot(text: str) -> int:
    """The slot of some evidence; identifiers and contexts share none with values and paths."""
    at = zlib.crc32(text.encode("utf-8")) % (HASHED // 2)
    return at if text[0] in "wpc" else at + HASHED // 2


#: What a scorer knows before it has seen a row: weights of identifiers and contexts, and of the constant.
KNOWN = {f"w:{w}": 4.0 for w in SECRET_WORDS} | {f"p:{a} {b}": 4.0 for a, b in SECRET_PAIRS} | {f"p:{a} {b}": -5.0 for a, b in LABEL_PAIRS} | {"c:url": 4.0, "c:header": 4.0, "c:pem": 6.0}
CONSTANT = -2.0


def _known_weights() -> np.ndarray:
    w = np.zeros(DENSE + HASHED)
    w[0] = CONSTANT
    for text, weight in KNOWN.items():
        w[DENSE + _slot(text)] += weight
    return w


#: Set in a slot's number where it weighs a quarter, as parts of a path do.
QUARTER = 1 << 20


class Evidence:
    """What is known of candidates (context, key, value, path): numbers of their characters, and weighted slots of the
    identifiers around them, their context, their value's beginning and their path. No pattern that labels is among it.
    """

    def _hold(self, dense: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> None:
        """dense: rows of DENSE numbers; slots: of all rows one after another, counts of them each row's."""
        self.dense, self.marked, self.counts = dense, slots, counts
        self.slots, self.weights = slots & (QUARTER - 1), np.where(slots & QUARTER, 0.25, 1.0)
        self.owner = np.repeat(np.arange(len(counts)), counts)

    def __init__(self, rows: list[tuple[str, str, str, str]], chains: tuple[Markov, Markov]):
        values = Values([r[2] for r in rows])
        n, size = np.maximum(1, values.sizes), values.sizes
        likely, ordinary = chains[0].means(values), chains[1].means(values)
        digits, upper, lower = values.share("0", "9"), values.share("A", "Z"), values.share("a", "z")
        mixed = (digits > 0) & (upper > 0) & (lower > 0)
        columns = (
            np.ones(len(rows)), likely - ordinary, ordinary, np.minimum(n, 64) / 64, digits, upper, lower, 1 - digits - upper - lower, values.entropy() / 6,
            digits + values.share("a", "f") + values.share("A", "F"), size < 8, size >= 20, mixed, mixed & (size >= 20), size >= BLOB,
            values.share("-", "-"), values.share(".", "."), values.share("/", "/"), values.share("_", "_"), (digits > 0) & (upper > 0) & (lower == 0),
        )
        slots: list[int] = []
        counts = np.zeros(len(rows), np.int64)
        names: dict[str, list[int]] = {}
        paths: dict[str, list[int]] = {}
        for i, (context, key, value, path) in enumerate(rows):
            named = names.get(key)
            if named is None:
                words = words_of(key)
                named = names[key] = [_slot(f"w:{w}") for w in words] + [_slot(f"p:{a} {b}") for a, b in zip(words, words[1:])]
            placed = paths.get(path)
            if placed is None:
                placed = paths[path] = [_slot(f"d:{part.lower()}") | QUARTER for part in re.split(r"[\\/.]", path)]
            slots += [*named, _slot(f"c:{context}"), _slot(f"v:{value[:4]}"), _slot(f"s:{_shape(value)}"), *placed]
            counts[i] = len(named) + 3 + len(placed)
        self._hold(np.stack([np.asarray(c, float) for c in columns], 1), np.array(slots, np.int64), counts)

    def packed(self) -> tuple[list[bytes], list[bytes]]:
        """Each row's numbers, and its slots, as bytes."""
        numbers, slots = self.dense.astype("<f4"), self.marked.astype("<i4")
        ends = np.cumsum(self.counts)
        return [row.tobytes() for row in numbers], [slots[a:b].tobytes() for a, b in zip(ends - self.counts, ends)]

    @classmethod
    def unpacked(cls, dense: pa.BinaryArray, slots: pa.BinaryArray) -> Evidence:
        """The evidence of rows that were packed, read in place."""

        def flat(column: pa.BinaryArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
            _, at, data = column.buffers()
            at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
            return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view(kind), np.diff(at) // 4

        numbers, (held, counts) = flat(dense, "<f4")[0], flat(slots, "<i4")
        evidence = cls.__new__(cls)
        evidence._hold(numbers.astype(float).reshape(-1, DENSE), held.astype(np.int64), counts.astype(np.int64))
        return evidence

    def scores(self, w: np.ndarray) -> np.ndarray:
        return self.dense @ w[:DENSE] + np.bincount(self.owner, w[DENSE + self.slots] * self.weights, len(self.dense))

    def gradient(self, errors: np.ndarray) -> np.ndarray:
        """Sums of the rows' evidence, each times its error."""
        return np.concatenate((errors @ self.dense, np.bincount(self.slots, self.weights * errors[self.owner], HASHED)))


def held_out(value: str) -> bool:
    """Whether rows of a value calibrate instead of train: a fifth of the values."""
    return zlib.crc32(value.encode("utf-8")) % 5 == 0


def losses(scores: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum of the logistic losses, and the error of each row."""
    loss = np.logaddexp(0, scores) - labels * scores
    return float(loss.sum()), 1 / (1 + np.exp(-np.clip(scores, -30, 30))) - labels


def fit(sums: Callable[[np.ndarray], tuple[float, np.ndarray]], known: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Weights of least loss, held near known ones, by L-BFGS; sums gives a loss and gradient over all rows for weights.

    Every round is one pass over all rows; it ends earlier where no step makes the loss a ten-thousandth less.
    """

    def whole(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, g = sums(w)
        return value + penalty / 2 * float((w - known) @ (w - known)), g + penalty * (w - known)

    w, steps = known.copy(), []
    value, g = whole(w)
    size = 1.0
    for _ in range(rounds):
        d, parts = -g, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            parts.append(a)
            d = d - a * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, float(np.abs(g).max()))
        for (s, y), a in zip(steps, reversed(parts)):
            d = d + (a - (y @ d) / (s @ y)) * s
        v, h = whole(w + size * d)
        if v > value + 1e-4 * size * float(g @ d):
            size /= 4
            if size < 1e-4:
                break
            continue
        s, y = size * d, h - g
        if s @ y > 1e-10:
            steps = [*steps[-7:], (s, y)]
        less = value - v
        w, value, g, size = w + s, v, h, 1.0
        if less < 1e-4 * max(1.0, value):
            break
    return w


Sums = Callable[[np.ndarray, np.ndarray | None], tuple[float, np.ndarray]]


class Scorer:
    """Logistic regression with an L2 penalty towards known weights, calibrated by a second one on rows held out.

    penalty is worth so many rows: with none to learn from, the known weights score; with thousands they hardly count.
    """

    def __init__(self, rows: list[tuple[str, str, str, str, int]], penalty: float = 2.0, rounds: int = 40):
        """rows of (context, key, value, path, label)."""
        labels = np.array([r[4] for r in rows], float)
        held = np.array([held_out(r[2]) for r in rows], bool)
        chains = (Markov([r[2] for r in rows if r[4] == 1]), Markov([r[2] for r in rows if r[4] == 0]))
        evidence = Evidence([r[:4] for r in rows], chains)
        self._train(chains, lambda w, line: sums_of(evidence, labels, held, w, line), penalty, rounds)

    @classmethod
    def over(cls, chains: tuple[Markov, Markov], sums: Sums, penalty: float = 2.0, rounds: int = 40) -> Scorer:
        """A scorer of rows that lie elsewhere: sums gives sums_of all of them."""
        scorer = cls.__new__(cls)
        scorer._train(chains, sums, penalty, rounds)
        return scorer

    def _train(self, chains: tuple[Markov, Markov], sums: Sums, penalty: float, rounds: int) -> None:
        self.chains = chains
        self.weights = fit(lambda w: sums(w, None), _known_weights(), penalty, rounds)
        self.scale = fit(lambda line: sums(self.weights, line), np.array([0.0, 1.0]), 10.0, rounds)

    def chances(self, evidence: Evidence) -> np.ndarray:
        scores = self.scale[0] + self.scale[1] * evidence.scores(self.weights)
        return 1 / (1 + np.exp(-np.clip(scores, -30, 30)))

    def probabilities(self, rows: list[tuple[str, str, str, str]]) -> np.ndarray:
        """How probable it is of each (context, key, value, path) that its value is a credential."""
        return self.chances(Evidence(rows, self.chains))


def sums_of(evidence: Evidence, labels: np.ndarray, held: np.ndarray, weights: np.ndarray, line: np.ndarray | None) -> tuple[float, np.ndarray]:
    """The loss and gradient of some rows: of weights over those that train, or of a scale of scores over those held out."""
    scores = evidence.scores(weights)
    if line is None:
        loss, errors = losses(scores[~held], labels[~held])
        every = np.zeros(len(scores))
        every[~held] = errors
        return loss, evidence.gradient(every)
    scores = scores[held]
    loss, errors = losses(line[0] + line[1] * scores, labels[held])
    return loss, np.array([errors.sum(), errors @ scores])


def texts(sources: DataFrame, observations: DataFrame) -> DataFrame:
    """(origin, record_id, path, text) of both tables; rows delivered twice count once."""
    a = sources.select(F.lit("sources").alias("origin"), F.col("source_id").cast("string").alias("record_id"), F.col("file_path").alias("path"), F.col("raw_source").alias("text"))
    b = observations.select(
        F.lit("observations").alias("origin"), F.col("observation_id").alias("record_id"), F.col("code_location.file_path").alias("path"), F.col("finding_snippet").alias("text")
    )
    return a.unionByName(b).where("record_id is not null and length(text) > 0")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [*[pa.string()] * 6, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()]
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    for batch in batches:
        rows = []
        for origin, record, path, text in zip(*(c.to_pylist() for c in batch.columns)):
            places = Places(text)
            for context, key, value, start, starts, ends in candidates(text, places):
                label = weak_label(context, words_of(key), value)
                rows.append((origin, record, path, context, key, value, places.line(start) + 1, starts, ends, label))
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of characters in the values of each label: one row of a task."""
    counts = np.zeros((2, 97, 97), np.int64)
    for batch in batches:
        labels, values = (c.to_pylist() for c in batch.columns)
        for label in (0, 1):
            counts[label] += pairs_of([v for v, x in zip(values, labels) if x == label])
    yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])


EVIDENCE = f"{CANDIDATE}, held boolean, no_case boolean, dense binary, slots binary"


def _evident(chains: tuple[Markov, Markov], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(c, k, v, p or "") for p, c, k, v in zip(*(batch.column(n).to_pylist() for n in ("path", "context", "key", "value")))]
        dense, slots = Evidence(rows, chains).packed()
        more = [pa.array([held_out(r[2]) for r in rows], pa.bool_()), pa.array([no_case(r[1], r[2]) for r in rows], pa.bool_()), pa.array(dense, pa.binary()), pa.array(slots, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "held", "no_case", "dense", "slots"])


def scored(sources: DataFrame, observations: DataFrame) -> DataFrame:
    """All candidates with their calibrated probability, and whether the exact check drops them.

    All candidates that patterns label train the classifier, and every candidate is scored. A task sends its sums alone
    to the driver: a number for each weight.
    """
    found = staged(spread(texts(sources, observations)).mapInArrow(_extract, CANDIDATE), "p5-candidates")
    context = found.sparkSession.sparkContext
    cores = context.defaultParallelism
    counts = np.zeros((2, 97, 97), np.int64)
    for row in found.where("label is not null").select("label", "value").coalesce(cores).mapInArrow(_counted, "counts binary").toLocalIterator():
        counts += np.frombuffer(row.counts, np.int64).reshape(counts.shape)
    chains = (Markov([], counts[1]), Markov([], counts[0]))
    evidence = staged(found.mapInArrow(partial(_evident, chains), EVIDENCE), "p5-evidence")
    labelled = evidence.where("label is not null").select("label", "held", "dense", "slots")

    def sums(weights: np.ndarray, line: np.ndarray | None) -> tuple[float, np.ndarray]:
        sent = context.broadcast((weights, line))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, line = sent.value
            loss, total = 0.0, np.zeros(len(weights if line is None else line))
            for batch in batches:
                if batch.num_rows:
                    label, held, dense, slots = batch.columns
                    more, gradient = sums_of(Evidence.unpacked(dense, slots), label.to_numpy().astype(float), held.to_numpy(zero_copy_only=False), weights, line)
                    loss, total = loss + more, total + gradient
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["loss", "gradient"])

        rows = labelled.where("held" if line is not None else "not held").coalesce(cores).mapInArrow(add, "loss double, gradient binary").collect()  # one for each core
        sent.destroy()
        return sum(r.loss for r in rows), sum((np.frombuffer(r.gradient) for r in rows), np.zeros(len(weights if line is None else line)))

    model = context.broadcast(Scorer.over(chains, sums))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = model.value.chances(Evidence.unpacked(batch.column("dense"), batch.column("slots"))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(chances, pa.float64())], [*batch.schema.names[:-2], "probability"])

    return evidence.drop("held").mapInArrow(score, f"{CANDIDATE}, no_case boolean, probability double")


def sure(candidates_: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The candidates of at least that probability that pass the exact check."""
    return candidates_.where((F.col("probability") >= threshold) & ~F.col("no_case"))


def lines(sources: DataFrame, observations: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(origin, record_id, line_no): the lines on which credentials start.

    Null and empty texts hold none; a line counts once, however many credentials start on it or copies of the row
    there are. A null path adds no evidence. Line ends are \\n; a \\r before it belongs to the line.
    """
    return sure(scored(sources, observations), threshold).select("origin", "record_id", "line_no").distinct()


def redacted(sources: DataFrame, observations: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(origin, record_id, n_redacted, redacted): the texts that hold credentials, each value replaced by asterisks.

    Quotes, names, line ends and everything else around a value stay; each piece keeps its length.
    """
    found = sure(scored(sources, observations), threshold)
    spans = found.select("origin", "record_id", F.explode(F.arrays_zip("starts", "ends")).alias("s")).groupBy("origin", "record_id").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    # Texts of rows delivered twice are told apart only after the join, which leaves the few with credentials.
    rows = texts(sources, observations).join(spans, ["origin", "record_id"]).dropDuplicates(["origin", "record_id"])

    def mask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, marks in zip(frame["text"], frame["spans"]):
                parts, at = [], 0
                for s in marks:
                    a, b = max(at, s["starts"]), s["ends"]
                    if b > a:
                        parts += [text[at:a], "*" * (b - a)]
                        at = b
                out.append("".join(parts) + text[at:])
            yield pd.DataFrame({"origin": frame["origin"], "record_id": frame["record_id"], "n_redacted": frame["spans"].map(len), "redacted": out})

    return rows.select("origin", "record_id", "text", "spans").mapInPandas(mask, "origin string, record_id string, n_redacted int, redacted string")
