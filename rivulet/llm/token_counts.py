"""Token counts by prefix dynamic programming.

For every prefix of a word the last token of its encoding is found: a token t
ending at i follows the prefix before it exactly if the merges leave the pair
(last token before, t) as it is.  Exactly one token qualifies, so each prefix
gets its exact count from a shorter one.  The counts of all prefixes of a word
are stored.  Words are independent, so a text's counts are running sums over its
words, and the count of a whole text, of any prefix of it, and the longest
prefix within a budget are read from the same tables, without encoding again.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rivulet.llm.common import Recent, ship, slices, text_of

END = "</w>"
PAIRS_SIZE = 400_000
# The tokenizer's white space and word pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = re.compile(f"[{SPACE}]+")
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones themselves, the others from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b if b in plain else 256 + sum(x not in plain for x in range(b))) for b in range(256)]


class PrefixTables(Recent):
    """word -> token counts of its prefixes, one entry a code point."""

    def __init__(self, path: str):
        super().__init__(self.count_prefixes)
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["end_of_word_suffix"] != END:
            raise ValueError("a vocabulary with word ends is needed")
        self.vocab = spec["model"]["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.specials = regex.compile("|".join(map(regex.escape, (t["content"] for t in spec["added_tokens"]))))
        self.library = Tokenizer.from_file(path)
        self.begin = self.tree()
        self.letters = byte_letters()
        #: token -> (rank, left, right) of the merge that makes it.
        self.made: dict[str, tuple[int, str, str]] = {}
        for (a, b), i in self.ranks.items():
            self.made.setdefault(a + b, (i, a, b))
        self.own: dict[str, bool] = {}
        #: token -> whether each token asked for may follow it; n_pairs answers in all.
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def tree(self) -> dict[str, tuple]:
        """The tokens by letters: letter -> (token inside a word, token at a word's end, letters that go on), empty where there is none."""
        begin: dict[str, list] = {}
        for t in self.vocab:
            node, bare = [None, None, begin], t.removesuffix(END)
            for c in bare:
                node = node[2].setdefault(c, ["", "", {}])
            node[t.endswith(END)] = t
        none: dict[str, tuple] = {}

        def firm(level):
            return {c: (inner, end, firm(more)) for c, (inner, end, more) in level.items()} if level else none

        return firm(begin)

    def merged(self, symbols: list[str]) -> list[str]:
        get = self.ranks.get
        while len(symbols) > 1:
            rank, at, left = 1 << 30, 0, symbols[0]
            for i in range(1, len(symbols)):
                right = symbols[i]
                r = get((left, right))
                if r is not None and r < rank:
                    rank, at = r, i
                left = right
            if rank == 1 << 30:
                break
            symbols[at - 1 : at + 1] = [symbols[at - 1] + symbols[at]]
        return symbols

    def whole(self, token: str) -> bool:
        """Whether the merges make the token of its own letters."""
        bare = token.removesuffix(END)
        symbols = list(bare)
        if bare != token:
            symbols[-1] += END
        return self.merged(symbols) == [token]

    def follows(self, before: str, token: str) -> bool:
        """Whether the merges leave before, token as they are; before may be empty.

        Seen backwards: the merge made last on either side is undone, and what
        then meets at the border must not be a pair that would have come first.
        """
        row = self.pairs.get(before)
        known = None if row is None else row.get(token)
        if known is None:
            known = self.own.get(token)
            if known is None:
                known = self.own[token] = self.whole(token)
            left, right, limit = before, token, len(self.ranks)
            while known and left:
                rank = self.ranks.get((left, right))
                if rank is not None and rank < limit:
                    known = False
                    break
                a, b = self.made.get(left), self.made.get(right)
                if a and (not b or a[0] > b[0]):
                    limit, left = a[0], a[2]
                elif b:
                    limit, right = b[0] + 1, b[1]
                else:
                    break
            if self.n_pairs >= PAIRS_SIZE:
                self.pairs.clear()
                self.n_pairs = 0
            self.pairs.setdefault(before, {})[token] = known
            self.n_pairs += 1
        return known

    def run(self, u: str) -> list[int]:
        """Counts of u's prefixes as if a word ended there.

        last and count describe the prefixes as beginnings of longer words.
        """
        n, begin, pairs, follows = len(u), self.begin, self.pairs, self.follows
        last, count, ended = [""] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        unknown: dict[str, bool] = {}
        for j in range(n):
            before, then, letters = last[j], count[j] + 1, begin
            known = pairs.get(before, unknown).get
            for i in range(j + 1, n + 1):
                node = letters.get(u[i - 1])
                if node is None:  # no token begins so
                    break
                inner, end, letters = node
                if inner and not last[i]:
                    ok = known(inner)
                    if follows(before, inner) if ok is None else ok:
                        last[i], count[i] = inner, then
                if end and not ended[i]:
                    ok = known(end)
                    if follows(before, end) if ok is None else ok:
                        ended[i] = then
        return ended

    def count_prefixes(self, word: str):
        data = word.encode()
        ended = self.run("".join([self.letters[b] for b in data]))
        if len(data) == len(word):
            out = ended[1:]
        else:
            ends = list(accumulate(len(c.encode()) for c in word))
            out = [ended[e] for e in ends]
        if word in CONTRACTIONS:  # cut short, a contraction is an apostrophe and a letter
            out[1] = self["'"][-1] + self[word[1]][-1]
        return bytes(out) if max(out) < 256 else out

    def normal(self, text: str) -> str:
        """The text as the library normalises it: NFC, each run of white space one space, lower case; beyond U+024F by the library itself."""
        if not text.isascii():
            if max(text) >= "ɐ":
                return self.library.normalizer.normalize_str(text)
            text = unicodedata.normalize("NFC", text)
        return SPACES.sub(" ", text).lower()

    def words(self, text: str) -> list[str]:
        """The tokenizer's words of a text without special tokens."""
        if text.isascii():
            return ASCII_WORD.findall(text.lower())
        if max(text) < "ɐ":
            return WORD.findall(unicodedata.normalize("NFC", text).lower())
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        parts = self.specials.split(text) if "<|" in text else [text]
        get = self.__getitem__
        return len(parts) - 1 + sum([get(w)[-1] for part in parts for w in self.words(part)])

    def parts(self, text: str):
        """The text between special tokens as normal() gives it, each with the special token that follows it (none after the last)."""
        at = 0
        for m in self.specials.finditer(text):
            yield self.normal(text[at : m.start()]), m[0]
            at = m.end()
        yield self.normal(text[at:]), ""

    def plain_counts(self, text: str) -> list[int]:
        """Token count of every prefix of a normalised text without special tokens."""
        out, total, at = [], 0, 0
        for m in WORD.finditer(text):
            counts = self[m[0]]
            out += [total] * (m.start() - at)
            out += [total + c for c in counts]
            total, at = total + counts[-1], m.end()
        return out + [total] * (len(text) - at)

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token count of every prefix, by code points of the text's parts() put together.

        A special token that is cut short is ordinary text, which may continue the word before it.
        """
        out, base = [], 0
        for part, special in self.parts(text):
            counts = self.plain_counts(part + special[:-1])
            out += [base + c for c in counts]
            if special:
                base += 1 + (counts[len(part) - 1] if part else 0)
                out.append(base)
        return out

    def fit(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of the text's parts() with at most budget tokens."""
        best = done = base = 0
        for part, special in self.parts(text):
            for m in WORD.finditer(part):
                counts = self[m[0]]
                if base + counts[-1] > budget:
                    return max(best, done + m.start() + max((i + 1 for i, c in enumerate(counts) if base + c <= budget), default=0))
                base += counts[-1]
            best = done + len(part)
            if special:
                # Cut short, a special token may cost more than whole.
                tail = self.plain_counts(part + special[:-1])
                before = base - (tail[len(part) - 1] if part else 0)
                best = max([best] + [done + i + 1 for i in range(len(part), len(tail)) if before + tail[i] <= budget])
                base, done = base + 1, done + len(part) + len(special)
                if base > budget:
                    return best
                best = done
        return best


@functools.lru_cache(maxsize=4)
def tables(path: str) -> PrefixTables:
    return PrefixTables(path)


def _count(path: str, limit: int):
    def run(batches):
        t = tables(path)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n = [t.count(x) for x in texts]
            size = [len(x.encode()) for x in texts]
            cut = [t.fit(x, limit) if k > limit else None for x, k in zip(texts, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(cut, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_at"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens (long), over_limit, cut_at: one row per input row, no shuffle.

    cut_at, of a text over the limit only: code points of its longest prefix
    within the limit, as the library normalises it but for special tokens.  Null and empty texts have 0 tokens; repeated rows repeat their result.
    vocabulary: a tokenizer file on every executor.
    """
    slim = ship(docs).select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_count(vocabulary, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_at long")


def _prefixes(path: str, budgets: tuple[int, ...]):
    def run(batches):
        t = tables(path)
        for b in slices(batches, 200, 1 << 20):
            texts = b.column(1).to_pylist()
            cols = [pa.array([t.prefix_counts(x) for x in texts], pa.list_(pa.int32())), pa.array([[t.fit(x, k) for k in budgets] for x in texts], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "counts", "fits"])

    return run


def prefix_tables(docs: DataFrame, vocabulary: str, budgets=(2048,)) -> DataFrame:
    """doc_id, counts (tokens of every prefix, by code point of the normalised text), fits (longest prefix within each budget).

    Null and empty texts have no prefixes; repeated rows repeat their result.
    """
    slim = ship(docs).select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_prefixes(vocabulary, tuple(budgets)), f"doc_id {kind}, counts array<int>, fits array<int>")
