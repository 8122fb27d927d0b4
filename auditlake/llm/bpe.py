"""Byte-pair encoding as a lazily determinised transducer, and incremental UTF-8 decoding.

The merges of a byte-level vocabulary are compiled into a transducer over the bytes of one pre-token. Its
configurations are pairs (tokens chosen but not yet emitted, bytes of the token being read). Two neighbouring
tokens may follow each other only if merging their joined bytes gives exactly these two tokens again; an encoding
all of whose neighbours agree is the encoding that the merges give. Subsets of configurations are determinised when
first met; tokens that all live configurations share are emitted at once, so the lookahead is bounded by the
configurations' pending tokens.
"""

from __future__ import annotations

import base64
import re

import regex

#: The pre-token pattern of the vocabulary, once for ASCII texts and once for all texts.
ASCII_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
UNICODE_PATTERN = (
    r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The vocabulary of a file of lines "base64 rank"."""
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class _State:
    """A set of configurations (pending tokens, trie node), oldest first, and the tokens if the pre-token ends here."""

    __slots__ = ("configs", "end", "last", "next")

    def __init__(self, last: int, configs: tuple, end: tuple):
        self.last, self.configs, self.end = last, configs, end
        self.next: dict[int, tuple[_State, tuple]] = {}


class BpeTransducer:
    """Encodes texts; holds at most max_states determinised states and whole-word edges of max_chars characters, and starts anew beyond.

    Words of more than LONG characters, which seldom come again, are not kept.
    """

    LONG = 64

    def __init__(self, ranks: dict[bytes, int], max_states: int = 400_000, max_chars: int = 8_000_000):
        self.ranks = ranks
        self.max_states, self.max_chars = max_states, max_chars
        self.pieces = {rank: token for token, rank in ranks.items()}
        self._plant()
        self.made_of: dict[int, tuple[int, int]] = {}
        self.agree: dict[int, bool] = {}
        self._ascii = re.compile(ASCII_PATTERN).findall
        self._unicode = regex.compile(UNICODE_PATTERN).findall
        self._reset()

    def _plant(self) -> None:
        """The trie of all tokens: edges by node and byte, the token that ends at a node, whether edges leave it."""
        edges: dict[int, int] = {}
        token_at, inner = [-1], [True]
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                after = edges.get(key)
                if after is None:
                    after = edges[key] = len(token_at)
                    token_at.append(-1)
                    inner.append(False)
                    inner[node] = True
                node = after
            token_at[node] = rank
        self.edges, self.token_at, self.inner = edges, token_at, inner

    def _reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.start = _State(-1, (((), 0),), ())

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge gives this token; the token itself, twice, for a single byte."""
        found = self.made_of.get(token)
        if found is None:
            raw, ranks = self.pieces[token], self.ranks
            parts = [raw[i : i + 1] for i in range(len(raw))]
            while len(parts) > 2:
                best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if best == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = (ranks[parts[0]], ranks[parts[-1]]) if len(parts) == 2 else (token, token)
            self.made_of[token] = found
        return found

    def _agrees(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; a is -1 before the first token."""
        if a < 0:
            return True
        key = a << 32 | b
        known = self.agree.get(key)
        if known is None:
            if len(self.agree) >= 4 * self.max_states:
                self.agree.clear()
            known = self.agree[key] = self._border_stays(a, b)
        return known

    def _border_stays(self, a: int, b: int) -> bool:
        """Takes a and b apart, last merge first: a merge over the border must come later than both sides' merges."""
        before, pieces, ranks = 1 << 60, self.pieces, self.ranks
        while True:
            over = ranks.get(pieces[a] + pieces[b])
            if over is not None and over < before:
                return False
            (_, inner), (outer, _) = self.halves(a), self.halves(b)
            if a > b and inner != a or outer == b:
                if inner == a:
                    return True
                before, a = a, inner
            else:
                before, b = b + 1, outer

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple]:
        """Determinises the transition of state on byte: one encoding of the bytes so far is right, others may become so."""
        edges, token_at, inner = self.edges, self.token_at, self.inner
        configs, end = [], None
        for pending, node in state.configs:
            node = edges.get(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                configs.append((pending, node))
            token = token_at[node]
            if token >= 0 and end is None and self._agrees(pending[-1] if pending else state.last, token):
                end = (*pending, token)
        shared = end
        for pending, _ in configs:
            if not pending:
                shared = ()
                break
            while pending[: len(shared)] != shared:
                shared = shared[:-1]
        if shared:
            cut, last = len(shared), shared[-1]
            configs = [(pending[cut:], node) for pending, node in configs]
            rest = end[cut:]
        else:
            last, rest = state.last, end
        configs.append((rest, 0))
        key = (last, *configs)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = _State(last, tuple(configs), rest)
        state.next[byte] = found = (target, shared)
        return found

    def _new(self, word: str) -> tuple[int, ...]:
        """The ids of a pre-token not met before."""
        if len(self.states) > self.max_states or self.held > self.max_chars:
            self._reset()
        state, out = self.start, []
        for byte in word.encode("utf-8"):
            move = state.next.get(byte) or self._step(state, byte)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(state.end)
        ids = tuple(out)
        if len(word) <= self.LONG:
            self.words[word] = ids
            self.held += len(word)
        return ids

    def split(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._unicode(text)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and empty texts."""
        if not text:
            return []
        out: list[int] = []
        known, extend = self.words, out.extend
        for word in self.split(text):
            extend(known[word] if word in known else self._new(word))
            known = self.words
        return out

    def count(self, text: str | None) -> int:
        """How many ids a text has."""
        return len(self.encode(text))


class Utf8Machine:
    """Incremental UTF-8 decoding: takes pieces cut anywhere, gives the text that is complete so far.

    States are the number of bytes still due and the range the next byte must lie in; bytes that fit no state come
    out as U+FFFD, one for each maximal part, as Python's own decoder gives them.
    """

    #: First byte ranges of UTF-8 with the bytes due and the range of the second byte.
    LEADS = (
        (0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
        (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF),
        (0xF4, 0xF4, 3, 0x80, 0x8F),
    )

    def __init__(self) -> None:
        self.held, self.due, self.low, self.high = bytearray(), 0, 0, 0

    def feed(self, piece: bytes) -> str:
        if not self.due and piece.isascii():
            return piece.decode("ascii")
        out = []
        for byte in piece:
            if self.due:
                if self.low <= byte <= self.high:
                    self.held.append(byte)
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(self.held.decode("utf-8"))
                        self.held.clear()
                    continue
                out.append("�")
                self.held.clear()
                self.due = 0
            due = next(((n, lo, hi) for a, b, n, lo, hi in self.LEADS if a <= byte <= b), None)
            if due is None:
                out.append("�")
            elif due[0] == 0:
                out.append(chr(byte))
            else:
                self.held.append(byte)
                self.due, self.low, self.high = due
        return "".join(out)

    def close(self) -> str:
        """What an unfinished character gives at the end."""
        left = "�" if self.due else ""
        self.held.clear()
        self.due = 0
        return left
