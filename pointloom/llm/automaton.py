"""Regular expressions to one minimal deterministic automaton over bytes, and its vectorised run."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


ALL = frozenset(range(256))


class _Parser:
    """Patterns of bytes, [classes], \\x20 and other escapes, (groups), |, *, +, ?, {n} and {n,m}, built into an automaton."""

    def __init__(self, nfa: _Nfa, pattern: str, either_case: bool) -> None:
        self.nfa, self.pattern, self.either_case, self.at = nfa, pattern, either_case, 0

    def build(self, start: int) -> int:
        end = self.choice(start)
        if self.at < len(self.pattern):
            raise ValueError(f"unsupported at {self.at}: {self.pattern}")
        return end

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.pattern[self.at - 1]

    def choice(self, start: int) -> int:
        ends = [self.sequence(start)]
        while self.peek() == "|":
            self.take()
            ends.append(self.sequence(start))
        end = self.nfa.state()
        for e in ends:
            self.nfa.empty[e].append(end)
        return end

    def sequence(self, start: int) -> int:
        begin = self.nfa.state()
        self.nfa.empty[start].append(begin)
        while self.peek() not in ("", "|", ")"):
            begin = self.repeated(begin)
        return begin

    def repeated(self, start: int) -> int:
        again = self.at
        end = self.atom(start)
        behind = self.at
        least, most = self.bounds()
        after = self.at

        def once(state: int) -> int:
            self.at = again
            return self.atom(state)

        if (least, most) != (1, 1):
            end = start
            for _ in range(least):
                end = once(end)
            if most is None:
                loop = self.nfa.state()
                self.nfa.empty[end].append(loop)
                self.nfa.empty[once(loop)].append(loop)
                end = loop
            else:
                ends = [end]
                for _ in range(most - least):
                    ends.append(once(ends[-1]))
                end = self.nfa.state()
                for e in ends:
                    self.nfa.empty[e].append(end)
        self.at = after if after > behind else behind
        return end

    def bounds(self) -> tuple[int, int | None]:
        sign = self.peek()
        if sign in ("*", "+", "?"):
            self.take()
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[sign]
        if sign != "{":
            return 1, 1
        stop = self.pattern.index("}", self.at)
        least, comma, most = self.pattern[self.at + 1 : stop].partition(",")
        self.at = stop + 1
        return int(least), (int(most) if most else None) if comma else int(least)

    def atom(self, start: int) -> int:
        sign = self.take()
        if sign == "(":
            if self.peek() == "?":
                raise ValueError(f"plain groups only: {self.pattern}")
            end = self.choice(start)
            if self.take() != ")":
                raise ValueError(f"an open group: {self.pattern}")
            return end
        if sign in "*+?{^$.":
            raise ValueError(f"unsupported: {sign}")
        on = self.members() if sign == "[" else {self.byte(sign)}
        if self.either_case:
            on |= {ord(chr(x).swapcase()) for x in on if x < 128 and chr(x).isalpha()}
        step, end = self.nfa.state(), self.nfa.state()
        self.nfa.empty[start].append(step)
        self.nfa.on[step] = (frozenset(on), end)
        return end

    def byte(self, sign: str) -> int:
        if sign == "\\":
            sign = self.take()
            if sign == "x":
                self.at += 2
                return int(self.pattern[self.at - 2 : self.at], 16)
            if sign.isalnum():
                raise ValueError(f"unsupported escape: {sign}")
        if ord(sign) > 127:
            raise ValueError("ASCII and \\x escapes only")
        return ord(sign)

    def members(self) -> set[int]:
        negate = self.peek() == "^"
        self.at += negate
        found: set[int] = set()
        while self.peek() != "]" or not found:
            low = self.byte(self.take())
            if self.peek() == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                self.take()
                found |= set(range(low, self.byte(self.take()) + 1))
            else:
                found.add(low)
        self.take()
        return set(ALL) - found if negate else found


class _Nfa:
    """Thompson's construction: edges on byte sets and empty edges."""

    def __init__(self) -> None:
        self.on: list[tuple[frozenset[int], int] | None] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.on.append(None)
        self.empty.append([])
        return len(self.on) - 1

    def turned(self) -> _Nfa:
        """The automaton with every edge the other way round."""
        out = _Nfa()
        for _ in self.on:
            out.state()
        for s, edge in enumerate(self.on):
            for t in self.empty[s]:
                out.empty[t].append(s)
            if edge:
                between = out.state()
                out.on[between] = (edge[0], s)
                out.empty[edge[1]].append(between)
        return out

    def closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass
class Dfa:
    """classes: byte to column. table: flat, its entries are states times the number of columns, as is `start`.
    accept[state]: bit r is set if rule r has a match that ends here; a state without threads is -1 in `dead`."""

    classes: np.ndarray
    table: np.ndarray
    accept: np.ndarray
    columns: int
    dead: int

    def longest(self, data: bytes, start: int, end: int) -> int:
        """The end of the longest match at `start`, -1 if none (for an automaton of anchored rules)."""
        state, found, table, classes, accept, width = 0, -1, self.table, self.classes.tolist(), self.accept, self.columns
        near = min(end, start + STEPWISE)
        for i in range(start, near):
            state = int(table[state + classes[data[i]]])
            if state == self.dead:
                return found
            if accept[state // width]:
                found = i + 1
        while near < end:  # a long match: in step with others of its own bytes, a piece at a time
            piece = np.frombuffer(data, np.uint8, min(end - near, PIECE), near)
            states = run(self, piece, start=state)
            hits = self.hits(states)
            found = near + int(hits[-1]) + 1 if len(hits) else found
            state = int(states[-1])
            if state == self.dead:
                break
            near += len(piece)
        return found

    def hits(self, states: np.ndarray) -> np.ndarray:
        """The places of states in which a rule accepts."""
        flags = np.repeat(self.accept != 0, self.columns)
        return np.concatenate([np.flatnonzero(flags[states[at : at + PIECE]]) + at for at in range(0, len(states), PIECE)] or [np.zeros(0, np.int64)])

    def marks(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, rules' bits) of the states in which rules accept; of places in a row with the same rules, the last."""
        bits = np.repeat(self.accept.astype(np.uint32), self.columns)
        places, rules = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(states), PIECE):
            m = bits[states[at : at + PIECE + 1]]
            last = m != 0
            last[:-1] &= m[1:] != m[:-1]
            found = np.flatnonzero(last[: min(PIECE, len(states) - at)])
            places.append(found + at)
            rules.append(m[found])
        return np.concatenate(places), np.concatenate(rules)


#: Bytes of a match that are stepped through one by one, and bytes that are looked at at once beyond.
STEPWISE = 2048
PIECE = 1 << 20


def compile_rules(rules: list[tuple[str, bool]], anchored: bool = False, backwards: bool = False) -> Dfa:
    """Subset construction over all (pattern, either case) at once, then minimisation. State 0 is the start.

    Unless anchored, a match may begin at any byte, so the automaton sees the matches of every rule in one pass. An automaton that
    reads backwards accepts where a match begins.
    """
    nfa, starts, finals = _Nfa(), [], {}
    for r, (pattern, either_case) in enumerate(rules):
        s = nfa.state()
        end = _Parser(nfa, pattern, either_case).build(s)
        starts.append(end if backwards else s)
        finals[s if backwards else end] = r
    if backwards:
        nfa = nfa.turned()
    signature = [tuple(b in edge[0] for edge in nfa.on if edge) for b in range(256)]
    distinct = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes = np.array([distinct[s] for s in signature], np.int64)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(distinct))]
    first = nfa.closure(starts)
    numbers, todo, rows = {first: 0}, [first], []
    while todo:
        now = todo.pop(0)
        edges, row = [nfa.on[x] for x in now if nfa.on[x]], []
        for b in sample:
            to = nfa.closure({t for on, t in edges if b in on}) | (frozenset() if anchored else first)
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
        rows.append(row)
    table = np.array(rows, np.int64)
    accept = np.array([sum(1 << finals[x] for x in s if x in finals) for s in numbers], np.int64)
    label, n = np.unique(accept, return_inverse=True)[1], 0
    while n != label.max() + 1:
        n = label.max() + 1
        label = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)[1].ravel()
    _, pick = np.unique(label, return_index=True)
    order = np.argsort(pick, kind="stable")  # the start's class comes first
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    dead = numbers.get(frozenset(), -1)
    steps = (rank[label[table[pick[order]]]] * len(distinct)).ravel()
    narrow = np.uint16 if len(steps) < 1 << 16 else np.int32
    return Dfa(classes.astype(np.uint8), steps.astype(narrow), accept[pick[order]], len(distinct), int(rank[label[dead]]) * len(distinct) if dead >= 0 else -1)


WARM_UP = 32
#: Lanes behind a wrong one that are guessed anew in the first turn; so many times more in each further turn.
AHEAD = 8
#: How often a lane is guessed ahead; later it waits for the state in which the lane before it ends.
TRIES = 3


def _stepped(dfa: Dfa, columns: np.ndarray, state: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """The state of each lane after all rows of columns (step, lane); out: (step, lane) takes all of them."""
    at, state = np.empty(len(state), np.intp), state.astype(dfa.table.dtype)
    for j in range(len(columns)):
        np.add(state, columns[j], out=at, dtype=np.intp, casting="unsafe")
        state = np.take(dfa.table, at, out=None if out is None else out[j], mode="clip")
    return state


def run(dfa: Dfa, data: np.ndarray, lanes: int = 4096, start: int = 0) -> np.ndarray:
    """The automaton's state (times its columns) after each byte of data, one pass with many lanes in step.

    Each lane is a stretch of the bytes. Its first state is guessed by running the bytes before it from `start`; a lane whose guess isn't
    the state in which the lane before it ended is run again from that state. In a match longer than lanes all guesses are
    wrong; so the lanes behind a wrong one are guessed again too, from the state that was found, more of them each turn.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dfa.table.dtype)
    length = max(2 * WARM_UP, -(-n // lanes))
    count = -(-n // length)
    codes = np.zeros(count * length, np.uint8)
    codes[:n] = dfa.classes[data]
    by_lane = codes.reshape(count, length)
    warm = by_lane[:, -WARM_UP:]
    guess = np.full(count, start, dfa.table.dtype)
    guess[1:] = _stepped(dfa, np.ascontiguousarray(warm[:-1].T), guess[1:])
    states = np.empty((count, length), dfa.table.dtype)
    again, ahead, tries = np.arange(count), AHEAD, np.zeros(count, np.uint8)
    while len(again):
        for at in range(0, len(again), lanes):
            some = again[at : at + lanes]
            out = np.empty((length, len(some)), dfa.table.dtype)
            _stepped(dfa, np.ascontiguousarray(by_lane[some].T), guess[some], out)
            states[some] = out.T
        true = np.concatenate([np.array([start], dfa.table.dtype), states[:-1, -1]])
        wrong = np.flatnonzero(true != guess)
        if not len(wrong):
            break
        to = np.minimum(np.append(wrong[1:], count), wrong + ahead)
        sizes = to - wrong
        behind = np.repeat(wrong - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        owner = np.repeat(wrong, sizes)
        behind, owner = behind[behind != owner], owner[behind != owner]
        new = _stepped(dfa, np.ascontiguousarray(warm[behind - 1].T), true[owner]) if len(behind) else true[:0]
        changed = (new != guess[behind]) & (tries[behind] < TRIES)
        tries[behind[changed]] += 1
        guess[wrong] = true[wrong]
        guess[behind[changed]] = new[changed]
        again = np.sort(np.concatenate([wrong, behind[changed]]))
        ahead = min(ahead * AHEAD, count)
    return states.reshape(-1)[:n]
