"""Byte-pair encoding as a deterministic transducer that is compiled while it reads.

A merge vocabulary splits a text uniquely, and a split is the right one exactly if each two
neighbouring tokens would be left alone when encoded by themselves. So the last token of each
prefix follows from the last tokens of shorter prefixes. A state keeps what later symbols can
still need: the vocabulary trie's nodes that end here, each with the token before it and the
number of tokens there, counted from here. Such states are finitely many; each is made when first
reached, and each transition is annotated with the tokens that it adds (which can be negative).
"""

from __future__ import annotations


class Node(dict):
    """A trie node: symbol -> Node."""

    __slots__ = ("token", "number")

    def __init__(self, nodes: list):
        self.token, self.number = -1, len(nodes)
        nodes.append(self)


class State(dict):
    """A state of the transducer: symbol -> State. add: tokens that its incoming transition adds; token, size: the last token and its symbols; kept: whether it is in the table."""

    __slots__ = ("machine", "alive", "add", "token", "size", "kept")

    def __missing__(self, symbol):
        after = self.machine.step(self, symbol)
        if after.kept:
            self[symbol] = after
        return after


class MergeAutomaton:
    """tokens: each token's symbols, by id. rank(left, right): when the pair of symbol strings is merged (lower first), None if never.

    The table stops growing at LIMIT states: what is rarer is then worked out anew each time.
    A symbol of no token becomes a token of its own, with id -1 - ord(symbol); nothing merges across it.
    """

    LIMIT = 100_000

    def __init__(self, tokens: dict[int, str], ranks: dict):
        """ranks: (left, right) -> rank, or merged -> rank where any two parts of a token merge."""
        self.tokens, self.ranks, self.by_pair = tokens, ranks, isinstance(next(iter(ranks)), tuple)
        self.ids = {s: i for i, s in tokens.items()}
        self.nodes: list[Node] = []
        self.root = Node(self.nodes)
        for i, s in tokens.items():
            node = self.root
            for c in s:
                nxt = dict.get(node, c)
                if nxt is None:
                    nxt = node[c] = Node(self.nodes)
                node = nxt
            node.token = i
        self.size = {i: len(s) for i, s in tokens.items()}
        self.own: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, State] = {}
        self.full = False
        self.start = self.state(((self.root.number, None, 0),), 0, None, 0)

    def state(self, alive: tuple, add: int, token: int | None, size: int) -> State:
        key = (add, token, alive)
        found = self.states.get(key)
        if found is None:
            found = State()
            found.kept = not self.full
            if found.kept:
                self.states[key] = found
                self.full = len(self.states) >= self.LIMIT
            found.machine, found.alive, found.add, found.token, found.size = self, alive, add, token, size
        return found

    def step(self, at: State, symbol: str) -> State:
        hit, kept = None, []
        for number, before, rel in at.alive:
            nxt = self.nodes[number].get(symbol)
            if nxt is None:
                continue
            t = nxt.token
            if hit is None and t >= 0 and self.follows(before, t):
                hit = (t, rel + 1)
            if nxt:
                kept.append((nxt.number, before, rel))
        if hit is None:
            return self.state(((self.root.number, None, 0),), 1, -1 - ord(symbol), 1)
        token, add = hit
        return self.state((*((n, b, r - add) for n, b, r in kept), (self.root.number, token, 0)), add, token, self.size[token])

    def follows(self, before: int | None, token: int) -> bool:
        if before is None:
            ok = self.own.get(token)
            if ok is None:
                ok = self.own[token] = self.merge(self.tokens[token]) == [self.tokens[token]]
            return ok
        ok = self.pairs.get((before, token))
        if ok is None:
            a, b = self.tokens[before], self.tokens[token]
            ok = self.follows(None, token) and self.merge(a + b) == [a, b]
            if len(self.pairs) < self.LIMIT:
                self.pairs[before, token] = ok
        return ok

    def merge(self, text: str) -> list[str]:
        """Plain merging, lowest rank first and the leftmost of equals."""
        parts, ranks, by_pair = list(text), self.ranks, self.by_pair
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]) if by_pair else parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def encode(self, text: str) -> list[int]:
        """Ids of a text's tokens: the last tokens of all prefixes, followed back from the end."""
        state, path = self.start, []
        for c in text:
            state = state[c]
            path.append(state)
        out, i = [], len(path) - 1
        while i >= 0:
            state = path[i]
            out.append(state.token)
            i -= state.size
        return out[::-1]
