"""Byte-pair merges compiled into a deterministic tokenization automaton.

Construction.  Start with one state that loops on every single byte.  Then, for
merge number ``k`` of the pair ``(u, v)`` into ``uv``, splice one gadget in: the
state entered by ``u`` is cloned without its ``v`` arc, the ``u`` arcs are led
into the clone, and every state that still has a ``u`` arc gets a ``uv`` arc to
where ``u v`` led before.  After the last merge the automaton accepts exactly the
token sequences that byte-pair encoding produces, and it is deterministic: a
state is known from the last token alone.

One gadget is a difference against the state it was cloned from, so it is stored
as such (``cut_from``, ``cut_token``): the whole automaton takes one entry per
merge, and the states form a tree.  A state has arc ``y`` unless it, or a state it
was cloned from, has cut ``y``, or has cut the token that ``y`` begins with before
``y`` was made of it, and so on down to the first byte of ``y``.  So an arc is looked
up along the tree: which of the gadgets above a state cut a given token is told by
numbering the tree in preorder (``_arc_tables``).  Answers are kept in a table of
fixed size.

To run it over bytes, all tokens are put into one suffix machine (``step``): at
each byte it names the longest token that ends there; the shorter ones follow
by ``shorter``.  Exactly one of them continues an accepted path.  The arc taken
also carries the change in the number of emitted tokens, so counting needs no
token list.
"""

from __future__ import annotations

import json

import numpy as np

VECTOR_LIMIT = 64
"""Words of up to so many bytes run side by side in numpy, longer ones one by one."""


def byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies spell the 256 bytes.

    Printable Latin-1 characters stand for themselves; the other bytes take the
    code points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The automaton of one ``tokenizers`` JSON file with a byte-level BPE model."""

    def __init__(self, content: bytes | str):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError("a byte-level BPE model is needed")
        alphabet = byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = [""] * 256
        for c, b in alphabet.items():
            names[b] = c
        number = {c: b for b, c in enumerate(names)}
        left, right = [-1] * 256, [-1] * 256
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if a + b in number:
                raise ValueError(f"two merges make {a + b!r}")
            number[a + b] = len(names)
            names.append(a + b)
            left.append(number[a])
            right.append(number[b])
        self.labels = [bytes(alphabet[c] for c in name) for name in names]
        self.ids = np.array([vocab[name] for name in names], np.uint32)
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        self.label_of_id = dict(zip(self.ids.tolist(), self.labels, strict=True))
        self.label_of_id |= {i: text.encode() for text, i in self.special.items()}
        self._gadgets()
        self._arc_tables()
        self._suffix_machine()
        self._known_key = np.full(1 << 20, -1, np.int64)
        self._known_cut = np.zeros(1 << 20, bool)

    # construction

    def _gadgets(self) -> None:
        """Splice one gadget for each merge; see the module's text."""
        total = len(self.labels)
        self.cut_from = np.zeros(total - 256 + 1, np.int32)
        self.cut_token = np.full(total - 256 + 1, -1, np.int32)
        enters = [0] * total
        for k, (u, v) in enumerate(zip(self.left[256:].tolist(), self.right[256:].tolist(), strict=True)):
            enters[256 + k] = enters[v]
            self.cut_from[k + 1], self.cut_token[k + 1] = enters[u], v
            enters[u] = k + 1
        self.enters = np.array(enters, np.int32)

    def _arc_tables(self) -> None:
        """The tree of gadgets in preorder, the gadgets by the token they cut, and what each token begins with.

        ``gadget_above`` and ``gadget_top``: of the gadgets from which one was cloned
        and which cut the same token, the nearest, and the first (or itself).
        """
        states, total = len(self.cut_from), len(self.labels)
        below: list[list[int]] = [[] for _ in range(states)]
        for g in range(1, states):
            below[self.cut_from[g]].append(g)
        self.enter, self.leave = np.zeros(states, np.int32), np.zeros(states, np.int32)
        self.gadget_above, self.gadget_top = np.full(states, -1, np.int32), np.arange(states, dtype=np.int32)
        cutting: dict[int, list[int]] = {}
        stack, clock = [(0, False)], 0
        while stack:
            g, done = stack.pop()
            token = int(self.cut_token[g])
            if done:
                self.leave[g] = clock
                if g:
                    cutting[token].pop()
                continue
            self.enter[g] = clock
            clock += 1
            if g:
                line = cutting.setdefault(token, [])
                if line:
                    self.gadget_above[g], self.gadget_top[g] = line[-1], line[0]
                line.append(g)
            stack.append((g, True))
            stack += [(child, False) for child in below[g]]
        keys = self.cut_token[1:].astype(np.int64) * states + self.enter[1:]
        order = np.argsort(keys)
        self.gadget_keys, self.gadgets = keys[order], (order + 1).astype(np.int32)
        # the tokens that a token begins with, itself first, and with which merge each of them got its next part
        depth = np.ones(total, np.int32)
        for t in range(256, total):
            depth[t] = depth[self.left[t]] + 1
        self.open_depth = depth
        self.open_token = np.full((total, int(depth.max())), -1, np.int32)
        self.open_until = np.full((total, int(depth.max())), -1, np.int32)
        self.open_token[:, 0], self.open_until[:, 0] = np.arange(total), total
        for t in range(256, total):
            n, first = depth[self.left[t]], self.left[t]
            self.open_token[t, 1 : n + 1], self.open_until[t, 1 : n + 1] = self.open_token[first, :n], self.open_until[first, :n]
            self.open_until[t, 1] = t

    def _suffix_machine(self) -> None:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for t, label in enumerate(self.labels):
            at = 0
            for b in label:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = children[at][b] = len(children)
                    children.append({})
                at = nxt
            ends[at] = t
        # a node without children steps as the node it falls back to, so it shares that one's row
        self.row = np.zeros(len(children), np.int32)
        self.row[[at for at, below in enumerate(children) if below]] = np.arange(sum(map(bool, children)))
        self.step = np.zeros((int(self.row.max()) + 1, 256), np.int32)
        self.longest = np.full(len(children), -1, np.int32)
        self.shorter = np.full(len(self.labels), -1, np.int32)
        fail = [0] * len(children)
        line = list(children[0].values())
        for b, child in children[0].items():
            self.step[0, b] = child
        for at in line:
            back = fail[at]
            self.longest[at] = self.longest[back] if back else -1
            if at in ends:
                self.shorter[ends[at]] = self.longest[at]
                self.longest[at] = ends[at]
            behind = self.step[self.row[back]]
            if not children[at]:
                self.row[at] = self.row[back]
                continue
            row = behind.copy()
            for b, child in children[at].items():
                fail[child] = int(row[b])
                row[b] = child
                line.append(child)
            self.step[self.row[at]] = row
        self.length = np.array([len(x) for x in self.labels], np.int32)

    # arcs

    def _cut(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether arc ``y`` is missing at the state that ``x`` enters."""
        states = len(self.cut_from)
        cut = np.zeros(len(x), bool)
        at = self.enter[self.enters[x]]
        for b in range(self.open_token.shape[1]):
            rows = np.flatnonzero((self.open_depth[y] > b) & ~cut)
            if not len(rows):
                break
            token = self.open_token[y[rows], b]
            # the last gadget before the state that cuts the token; then up the tree to one that the state was cloned from
            place = np.searchsorted(self.gadget_keys, token.astype(np.int64) * states + at[rows], "right") - 1
            gadget = np.where(place >= 0, self.gadgets[place], -1)
            gadget = np.where((gadget >= 0) & (self.cut_token[gadget] == token), gadget, -1)
            while len(off := np.flatnonzero((gadget >= 0) & (self.leave[gadget] <= at[rows]))):
                gadget[off] = self.gadget_above[gadget[off]]
            # gadget g belongs to the merge that makes token 255 + g; one of a pair of equal tokens cuts that pair itself
            cut[rows] = (gadget >= 0) & (self.gadget_top[gadget] + 255 <= self.open_until[y[rows], b])
        return cut

    def cut(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``_cut`` through a table of fixed size; colliding entries overwrite each other."""
        key = x.astype(np.int64) * len(self.labels) + y
        slot = ((key * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFF) >> 37) & (len(self._known_key) - 1)
        out = self._known_cut[slot]
        new = np.flatnonzero(self._known_key[slot] != key)
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            some = new[first]
            found = self._cut(x[some], y[some])
            self._known_key[slot[some]], self._known_cut[slot[some]] = key[some], found
            # two keys of one call may share a slot; the last one written wins both arrays
            out[new] = found[back]
        return out

    # runs

    def _last_tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each byte of each word, the token that ends the encoding of the word up to it.

        Also the offsets of the words, which have to come longest first, and the
        number of tokens up to each byte.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        data = np.frombuffer(b"".join(words), np.uint8)
        last, count = np.zeros(len(data), np.int32), np.zeros(len(data), np.int32)
        node = np.zeros(len(words), np.int32)
        alive = len(words)
        for i in range(int(sizes[0]) if len(words) else 0):
            while sizes[alive - 1] <= i:
                alive -= 1
            at = start[:alive]
            node = self.step[self.row[node[:alive]], data[at + i]]
            token = self.longest[node]
            wait = np.arange(alive)
            while len(wait):
                begin = i + 1 - self.length[token[wait]]
                wait, begin = wait[begin > 0], begin[begin > 0]
                if len(wait):
                    wait = wait[self.cut(last[at[wait] + begin - 1], token[wait])]
                    token[wait] = self.shorter[token[wait]]
            before = i - self.length[token]
            last[at + i] = token
            count[at + i] = np.where(before >= 0, count[at + np.maximum(before, 0)], 0) + 1
        return start, last, count

    def _one(self, word: bytes) -> tuple[list[int], list[int]]:
        """``_last_tokens`` of one long word."""
        step, row = memoryview(self.step.reshape(-1)), memoryview(self.row)
        longest, shorter, length = self.longest, self.shorter, self.length
        last, count, node, known = [], [], 0, {}
        for i, b in enumerate(word):
            node = step[row[node] * 256 + b]
            token = int(longest[node])
            while True:
                before = i - int(length[token])
                if before < 0:
                    break
                key = (last[before], token)
                if key not in known:
                    known[key] = bool(self._cut(np.array(key[:1]), np.array(key[1:]))[0])
                    if len(known) > 1 << 18:
                        known = {key: known[key]}
                if not known[key]:
                    break
                token = int(shorter[token])
            last.append(token)
            count.append(count[before] + 1 if before >= 0 else 1)
        return last, count

    def _split(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Places of the short words, longest first, and of the long ones."""
        short = sorted((i for i, w in enumerate(words) if 0 < len(w) <= VECTOR_LIMIT), key=lambda i: -len(words[i]))
        return short, [i for i, w in enumerate(words) if len(w) > VECTOR_LIMIT]

    def counts(self, words: list[bytes]) -> list[int]:
        """Number of tokens of each pre-split word: the counts on the arcs, added up."""
        out = [0] * len(words)
        short, long = self._split(words)
        if short:
            chosen = [words[i] for i in short]
            start, _, count = self._last_tokens(chosen)
            ends = start + np.array([len(w) for w in chosen]) - 1
            for i, n in zip(short, count[ends].tolist(), strict=True):
                out[i] = n
        for i in long:
            out[i] = self._one(words[i])[1][-1]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-split word, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        short, long = self._split(words)
        if short:
            chosen = [words[i] for i in short]
            start, last, count = self._last_tokens(chosen)
            place = start + np.array([len(w) for w in chosen]) - 1
            sizes = count[place].astype(np.int64)
            ends = np.cumsum(sizes)
            ids = np.zeros(int(ends[-1]), "<u4")
            put, left = ends - 1, np.arange(len(chosen))
            while len(left):
                token = last[place[left]]
                ids[put[left]] = self.ids[token]
                put[left] -= 1
                place[left] -= self.length[token]
                left = left[place[left] >= start[left]]
            flat, begin = ids.tobytes(), 0
            for i, end in zip(short, (ends * 4).tolist(), strict=True):
                out[i] = flat[begin:end]
                begin = end
        for i in long:
            last, _ = self._one(words[i])
            at, path = len(last) - 1, []
            while at >= 0:
                path.append(last[at])
                at -= int(self.length[path[-1]])
            out[i] = self.ids[path[::-1]].astype("<u4").tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The labels of the arcs that these ids name, one after the other."""
        return b"".join(map(self.label_of_id.__getitem__, memoryview(ids).cast("I")))
