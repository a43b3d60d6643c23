"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a string the table stores the one token that ends the prefix's encoding.  Candidates
are the tokens that an automaton finds to end there; the right one is compatible with the last token of
the prefix before it, that is, encoding the two together gives just these two.  Ids are then recovered
from the end backwards.  Time is linear in the text, however long its words are.

Why that is enough: merges are taken by priority, then from the left, and no merge crosses a border of
the result, so each token encodes to itself alone, and a sequence is an encoding exactly if all its
neighbours are compatible.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

SPACE = "▁"
_NEVER = 1 << 40


class PrefixTable:
    """Encoder for one model file.  Memory is bounded: caches are emptied at ``cache`` entries."""

    def __init__(self, model_file: str, cache: int = 300_000):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(sp.get_piece_size())]
        self.text = [sp.id_to_piece(i) for i in range(len(special))]
        self.ids = {t: i for i, t in enumerate(self.text) if not special[i]}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(len(special)) if sp.is_byte(i)}
        self.end = sp.eos_id()
        if len(self.bytes) < 256 or any(SPACE in t.lstrip(SPACE) or t[:2] == SPACE * 2 and t.strip(SPACE) for t in self.ids):
            raise ValueError("only models with byte fallback and no piece that goes on after a space are supported")
        spaces = [t for t in self.ids if not t.strip(SPACE)]
        self.most_spaces = longest = len(max(spaces, key=len))
        runs = [self._spaces(n) for n in range(2 * longest)]
        if len({sp.get_score(self.ids[t]) for t in spaces if len(t) > 1}) > 1 or any(runs[longest + n] != runs[longest] + runs[n] for n in range(longest)):
            raise ValueError("pieces of spaces must have one score, and the longest must take what it can")
        self.runs = runs[: longest + 1]
        # priority: the better the score, the smaller; single characters were there before any merge
        by_score = sorted((i for t, i in self.ids.items() if len(t) > 1 and t.strip(SPACE)), key=lambda i: -sp.get_score(i))
        self.rank = dict.fromkeys(self.ids.values(), -1) | {i: n for n, i in enumerate(by_score)}
        self.sizes = [len(t) for t in self.text]
        self.chars = {t for t in self.ids if len(t) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) == 1 or t.strip(SPACE) and self._by_merging(t, i):
                automaton.add_word(t, (len(t), i))  # what ends at a place comes longest first
        automaton.make_automaton()
        self.automaton = automaton
        self.cache, self.pairs, self.known = cache, {}, {}
        # the rules before merging: no characters replaced, one space put before, all spaces kept
        for t in ("a", " a", "a  b ", "Ａ①ﬁ", "e\u0301\u00a0\u3000x", "a\n b\t", "\u200bA", "ÅÅ"):
            if self.encode(t) != sp.encode(t, add_eos=True):
                raise ValueError(f"the model's normalization is not supported: {t!r}")
        self.pairs.clear()
        self.known.clear()

    def _spaces(self, n: int) -> list[int]:
        """Encode ``n`` spaces: all their merges have one priority, so the leftmost comes first."""
        got = [1] * n
        while (at := next((k for k in range(len(got) - 1) if SPACE * (got[k] + got[k + 1]) in self.ids), -1)) >= 0:
            got[at : at + 2] = [got[at] + got[at + 1]]
        return [self.ids[SPACE * k] for k in got]

    def _by_merging(self, text: str, token: int) -> bool:
        """Whether merging the characters of ``text`` gives ``token`` alone; notes the last merge's parts."""
        got, last = list(text), None
        while len(got) > 1:
            best, at = _NEVER, -1
            for k in range(len(got) - 1):
                i = self.ids.get(got[k] + got[k + 1])
                if i is not None and self.rank[i] < best:
                    best, at = self.rank[i], k
            if at < 0:
                return False
            last = (got[at], got[at + 1])
            got[at : at + 2] = [got[at] + got[at + 1]]
        self.parts[token] = (self.ids[last[0]], self.ids[last[1]])
        return True

    def _compatible(self, left: int, right: int) -> bool:
        """Whether encoding both together leaves the border between them.

        Undo merges, latest first, and see whether the tokens that then meet at the border would have
        merged before the merge just undone.  Equal priorities go by place: a merge at the border comes
        before one to its right, and after one to its left.
        """
        limit, rank, text = _NEVER, self.rank, self.text
        while True:
            both = self.ids.get(text[left] + text[right])
            if both is not None and rank[both] < limit:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                limit, left = rank[left], self.parts[left][1]
            else:
                limit, right = rank[right] + 1, self.parts[right][0]

    def _run(self, text: str) -> list[int]:
        """Encode a string of vocabulary characters without a run of spaces."""
        last, pairs, sizes = [-1] * (len(text) + 1), self.pairs, self.sizes  # last[k]: of the prefix that ends at k, last[-1] of none
        for end, (size, token) in self.automaton.iter(text):
            if last[end] < 0:
                if (start := end - size) >= 0:
                    pair = last[start] << 20 | token
                    if (fits := pairs.get(pair)) is None:
                        if len(pairs) > 2 * self.cache:
                            pairs.clear()
                        fits = pairs[pair] = self._compatible(last[start], token)
                    if not fits:
                        continue
                last[end] = token
        out, n = [], len(text) - 1
        while n >= 0:
            token = last[n]
            out.append(token)
            n -= sizes[token]
        out.reverse()
        return out

    def unit(self, text: str) -> list[int]:
        """Encode spaces and what follows up to the next one; no piece reaches over that border.

        Pieces of spaces have the worst score, so they merge last, over the spaces that no other piece took.
        """
        head = len(text) - len(text.lstrip(SPACE))
        body = self._mixed(text[max(head - 1, 0) :])
        spaces = max(head - 1, 0)
        if head > 1 and body[0] == self.ids[SPACE]:
            spaces, body = spaces + 1, body[1:]
        return self.runs[-1] * (spaces // self.most_spaces) + self.runs[spaces % self.most_spaces] + body

    def _mixed(self, text: str) -> list[int]:
        if self.chars.issuperset(text):
            return self._run(text)
        out, start = [], 0
        for k, c in enumerate(text):
            if c not in self.chars:
                if start < k:
                    out += self._run(text[start:k])
                out += [self.bytes[b] for b in c.encode()]
                start = k + 1
        return out + (self._run(text[start:]) if start < len(text) else [])

    def _miss(self, word: str) -> list[int]:
        # a word after a line end stands without the space that other words have before them
        ids = self._mixed(word if word[:1] == "\n" else SPACE + word)
        if len(word) <= 64:
            if len(self.known) >= self.cache:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of ``text`` with the end id."""
        if not text:
            return [self.end]
        if "  " in text or text[0] == " " or SPACE in text or text[0] == "\n":
            units = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", SPACE + text.replace(" ", SPACE))
            found = map(self.unit, units)
        else:
            known, miss = self.known.get, self._miss
            found = [known(w) or miss(w) for w in text.replace("\n", " \n").split(" ")]
        return [*chain.from_iterable(found), self.end]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def table(model_file: str) -> PrefixTable:
    return PrefixTable(model_file)


def encode(docs: DataFrame, model_file: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, ``ids`` (with the end id; no sampling) and ``decoded``, for every row.

    A null text counts as an empty one, whose ids are the end id alone.  Equal texts get equal ids; other
    columns are ignored; an empty table gives an empty one.  Rows are encoded alone, nothing is shuffled.
    Each worker holds one table and bounded caches.
    """
    kind = dict(docs.dtypes)[id_col]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = table(model_file)
        ids = [t.encode(x or "") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(t.decode, ids), pa.string())], ["id", "ids", "decoded"])

    return arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), each, f"id {kind}, ids array<int>, decoded string", 500).withColumnRenamed("id", id_col)
