"""Byte-level BPE as a deterministic automaton: encoding by table transitions, decoding by arc labels."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.batches import bound_batches

#: The pattern by which the public vocabulary's texts are split before merging, with the
#: Unicode White_Space characters spelled out.
BLANK = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
NEVER = 1 << 60
REMEMBERED = 300_000
#: States that the transition table holds at most.
MOST_STATES = 400_000


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable letter; the others start at U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    """Accepts exactly the token sequences that merging yields; every byte string has one accepted path.

    At first one state loops on the 256 bytes. The gadget of a merge (a, b) -> c splits the state that a
    leads to: the copy loses its arc b, all arcs a lead to the copy, and wherever a then b could be read an
    arc c leads to where b led. All arcs of a token thus lead to one state, named after the token, and a
    state is stored as what it lost itself (``lost``) plus what the state of its token's right part had lost
    when it was split off. Whether a state has an arc t follows from t's left parts in the same way; each
    answer is kept in a transition table.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_of_letter()
        self.label = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            self.label[i] = bytes(letters[x] for x in name)
        n = len(self.label)
        self.left, self.right, self.born = [-1] * n, [-1] * n, [NEVER] * n
        self.lost: list[dict[int, int]] = [{} for _ in range(n)]
        self.arcs: dict[int, bool] = {}
        for i, label in enumerate(self.label):
            if len(label) == 1:
                self.born[i] = -1
        for step, (a, b) in enumerate(merges):
            self._gadget(step, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self._ends()

    def _gadget(self, step: int, a: int, b: int, c: int) -> None:
        if not self._has_arc(a, b):
            return  # a then b is never read at this stage
        if self.born[c] != NEVER:
            raise ValueError(f"two merges make token {c}")
        self.lost[a][b] = step
        self.left[c], self.right[c], self.born[c] = a, b, step

    def _has_arc(self, state: int, token: int) -> bool:
        until = NEVER
        while state >= 0:
            if lost := self.lost[state]:
                front, fronted = token, NEVER
                while front >= 0:
                    step = lost.get(front)
                    if step is not None and step < until and step <= fronted:
                        return False
                    front, fronted = self.left[front], self.born[front]
            state, until = self.right[state], self.born[state]
        return True

    def _ends(self) -> None:
        """The table that reads bytes: a state per beginning of a token, the state to fall back to, and the tokens
        that end there, the longest first."""
        self.token = {label: i for i, label in enumerate(self.label) if self.born[i] != NEVER}
        self.size = [len(label) for label in self.label]
        self.step: dict[int, int] = {}
        own: list[int] = [-1]
        for label, i in self.token.items():
            state = 0
            for byte in label:
                key = state << 8 | byte
                state = self.step.get(key, -1)
                if state < 0:
                    state = self.step[key] = len(own)
                    own.append(-1)
            own[state] = i
        below: list[list[tuple[int, int]]] = [[] for _ in own]
        for key, state in self.step.items():
            below[key >> 8].append((key & 255, state))
        self.fall, self.depth = [0] * len(own), [0] * len(own)
        self.ends: list[tuple[int, ...]] = [()] * len(own)
        queue = [0]
        for state in queue:  # states of shorter beginnings first
            for byte, after in below[state]:
                self.depth[after] = self.depth[state] + 1
                if state:
                    self.fall[after] = self._read(self.fall[state], byte)
                shorter = self.ends[self.fall[after]]
                self.ends[after] = (own[after], *shorter) if own[after] >= 0 else shorter
                queue.append(after)
        self._restart()

    def _read(self, state: int, byte: int) -> int:
        while (after := self.step.get(state << 8 | byte)) is None:
            if not state:
                return 0
            state = self.fall[state]
        return after

    def _restart(self) -> None:
        """Only the state before the first byte is left: no token begun, nothing read."""
        start = (0, (-1,))
        self.next: dict[int, int] = {}
        self.states: list[tuple[int, tuple[int, ...]]] = [start]
        self.number = {start: 0}

    def _compile(self, state: int, byte: int) -> int:
        """The transition of a state by a byte, entered in the table.

        A state is the longest beginning of a token that the bytes read end with, and the last arc of the accepted
        path at each place inside it. Of the tokens that end at the new place exactly one is the last arc there:
        the one for which the arc before it has a follower.
        """
        if len(self.states) >= MOST_STATES:
            return -1
        begun, lasts = self.states[state]
        after = self._read(begun, byte)
        for token in self.ends[after]:
            before = lasts[-self.size[token]]
            key = before << 20 | token
            holds = before < 0 or self.arcs.get(key)
            if holds is None:
                holds = self.arcs[key] = self._has_arc(before, token)
            if holds:
                break
        else:
            raise ValueError("a byte without a token")
        entry = (after, (*lasts, token)[-self.depth[after] - 1 :])
        found = self.number.get(entry)
        if found is None:
            found = self.number[entry] = len(self.states)
            self.states.append(entry)
        self.next[state << 8 | byte] = found
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Labels of the one accepted path over a pre-split piece: one table look-up a byte, then back along the
        last arcs. The table is filled as bytes are met; when it is full it is begun anew."""
        whole = self.token.get(piece)
        if whole is not None:
            return (whole,)
        table = self.next
        state, passed = 0, [0]
        for byte in piece:
            after = table.get(state << 8 | byte)
            if after is None:
                after = self._compile(state, byte)
                if after < 0:
                    self._restart()
                    return self.encode(piece) if len(piece) < MOST_STATES else self._long(piece)
            state = after
            passed.append(state)
        states, size = self.states, self.size
        path, at = [], len(piece)
        while at:
            token = states[passed[at]][1][-1]
            path.append(token)
            at -= size[token]
        path.reverse()
        return tuple(path)

    def _long(self, piece: bytes) -> tuple[int, ...]:
        """As ``encode`` for a piece that may fill the table by itself: last arcs are kept, states are not."""
        last, state = [-1], (0, (-1,))
        for byte in piece:
            self._restart()
            self.states[0] = state
            state = self.states[self._compile(0, byte)]
            last.append(state[1][-1])
        self._restart()
        path, at = [], len(piece)
        while at:
            path.append(last[at])
            at -= self.size[last[at]]
        path.reverse()
        return tuple(path)


class Remembered(dict):
    """Token numbers of pieces seen before; emptied when full, so its size is bounded."""

    def __init__(self, work, entries: int = REMEMBERED):
        super().__init__()
        self.work, self.entries = work, entries

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.work(piece)
        if len(piece) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[piece] = found
        return found


class NotApart(ValueError):
    """A run of characters that a neighbour across a space can change."""


class Tokenizer:
    """A compiled byte-level vocabulary file: text to token numbers and back."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pieces = regex.compile(SPLIT)
        self.piece_ids = Remembered(self._piece)
        self.run_ids = Remembered(self._run)
        self.label = list(self.automaton.label)
        for name, i in self.special.items():
            self.label += [b""] * (i + 1 - len(self.label))
            self.label[i] = name.encode()
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.edge = regex.compile(f"[{BLANK}]").match
        self.name = list(map(str, range(len(self.label))))
        self.cut = regex.compile("(" + "|".join(names) + ")") if names else None

    def _piece(self, piece: str) -> tuple[int, ...]:
        if len(self.automaton.arcs) >= 2 * REMEMBERED:
            self.automaton.arcs.clear()
        return self.automaton.encode(piece.encode())

    def _run(self, run: str) -> tuple[int, ...]:
        """A run between two single spaces, its leading space included. The pattern always cuts before a
        single space that has no other white space beside it, so such a run is split by itself."""
        if len(run) < 2 or self.edge(run[1]) or self.edge(run[-1]):
            raise NotApart
        pieces = self.pieces.findall(run)
        if len(pieces) == 1:
            return self._piece(run)  # remembered as the run
        return tuple(chain.from_iterable(map(self.piece_ids.__getitem__, pieces)))

    def _ordinary(self, text: str) -> list[int]:
        runs = text.split(" ")
        if len(runs) > 2 and runs[0] and not self.edge(runs[0][0]) and not self.edge(runs[0][-1]):
            try:
                ids = list(chain.from_iterable(map(self.run_ids.__getitem__, [" " + x for x in runs[1:]])))
            except NotApart:
                pass
            else:
                return [*chain.from_iterable(map(self.piece_ids.__getitem__, self.pieces.findall(runs[0]))), *ids]
        return list(chain.from_iterable(map(self.piece_ids.__getitem__, self.pieces.findall(text))))

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(x in text for x in self.special):
            return self._ordinary(text)
        ids: list[int] = []
        for part in self.cut.split(text):
            ids += [self.special[part]] if part in self.special else self._ordinary(part)
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def compiled(content: bytes) -> Tokenizer:
    """One compilation per worker process and vocabulary."""
    return Tokenizer(content)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the token numbers (array of int) of every whole text.

    Null and empty texts have no tokens. Rows are encoded one by one: repeated, tied and null ids are kept.
    The vocabulary file is read by the driver and broadcast (a few MB).
    """
    return _over_texts(docs, tokenizer_path, id_col, text_col, "ids array<int>", lambda t, texts: {"ids": [np.array(t.encode(x), np.int32) for x in texts]})


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the text that the column ``ids`` stands for; null ids count as none."""
    content = encoded.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = compiled(content.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [tokenizer.decode([] if x is None else x) for x in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its tokens again, and return count and digests of both.

    Columns doc_id, n_tokens, ids_sha256 (of decimal numbers joined by commas), decoded_sha256. A null or
    empty text has no tokens and the digests of the empty string.
    """

    def digests(tokenizer: Tokenizer, texts: list[str]) -> dict[str, list]:
        numbers, ids_sha, decoded_sha = [], [], []
        for text in texts:
            ids = tokenizer.encode(text)
            numbers.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(tokenizer.name.__getitem__, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(tokenizer.decode(ids).encode()).hexdigest())
        return {"n_tokens": numbers, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

    return _over_texts(docs, tokenizer_path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _over_texts(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, schema: str, work) -> DataFrame:
    content = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = compiled(content.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"]} | work(tokenizer, ["" if x is None else x for x in batch["text"]]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id long, {schema}")
