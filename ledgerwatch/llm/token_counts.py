"""Token counts by prefix dynamic programming.

A BPE encoding has one token ending at any prefix, and a sequence of tokens is the encoding of its text exactly if every two neighbours
are the encoding of theirs. So for the letters of a word, ``last[i]`` (the last token of the first ``i`` bytes) is the one token that ends there and
agrees with ``last[i - its length]``, and ``count[i] = count[i - its length] + 1``. The tables give the exact count at *every* prefix; where to cut a text
for a token budget, or how many tokens a prefix has, is read from them, and nothing is encoded again.

A prefix that ends inside a word ends that word there (its last letter takes the word-end form), as if the truncated text were given to the tokenizer.
Agreement of a pair of tokens is found by the merge rule of ``bpe`` and remembered, CACHE_PAIRS pairs at most. Pieces between white space and the words in them
repeat, so each worker keeps bounded tables of both; the new words of a batch are taken in order, and each goes on from the table of the letters that it shares with the one before. There is no shuffle.

Nulls and empty texts have no bytes and no tokens and are never over the limit. Equal texts have equal counts; repeated rows are rows of their own. Very long texts are handled whole, one piece between
white space at a time; a slice of a batch holds about 2 MB or one text. An empty table gives an empty result, other columns are ignored. There are no ties: a text has one encoding.
"""

from __future__ import annotations

import unicodedata
from functools import partial
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_PIECES, Vocabulary, default_tokenizer_path, pieces, shared_file
from .common import map_batches

#: Pairs of tokens whose agreement a worker remembers before it starts anew.
CACHE_PAIRS = 400_000
#: Words whose counts a worker remembers; at so many they become the older half, and the older half goes.
CACHE_WORDS = 100_000
#: Limit of the contract: texts of more tokens are marked.
LIMIT = 2048


class PrefixCounter:
    def __init__(self, text: str):
        self.vocabulary = v = Vocabulary.read(text)
        letters, ends = {}, {}
        byte_of = {int(s): b for b, s in enumerate(v.first)}
        end_of = {int(s): b for b, s in enumerate(v.last)}
        raw: dict[int, bytes] = {i: bytes([b]) for i, b in byte_of.items()} | {i: bytes([b]) for i, b in end_of.items()}
        final = set(end_of)
        order = np.argsort(v.pair_rank, kind="stable")
        #: rank and new token of a pair
        self.merges = dict(zip(v.pair_keys.tolist(), zip(v.pair_rank.tolist(), v.pair_new.tolist(), strict=True), strict=True))
        self.parts: dict[int, tuple[int, int]] = {}
        for key, new in zip(v.pair_keys[order].tolist(), v.pair_new[order].tolist(), strict=True):
            a, b = divmod(key, v.base)
            raw[new] = raw[a] + raw[b]
            if b in final:
                final.add(new)
            self.parts[new] = (a, b)
        for i, x in raw.items():
            (ends if i in final else letters)[x] = i
        # tokens inside a word and tokens that end one, by their bytes; None for what is no token but the end of a longer one
        self.inner, self.closing = ({x[k:]: None for x in own for k in range(1, len(x))} | own for own in (letters, ends))
        self.split_all = regex.compile(v.split.pattern + "|\\n")
        self.agrees: dict[int, bool] = {}
        self.totals: dict[str, int] = {}
        self.words: dict[str, int] = {"\n": -1}  # the end of a piece
        self.older: dict[str, int] = {}

    def symbols(self, token: int) -> list[int]:
        stack, out = [token], []
        while stack:
            x = stack.pop()
            if x in self.parts:
                stack.extend(reversed(self.parts[x]))
            else:
                out.append(x)
        return out

    def pair_agrees(self, a: int, b: int) -> bool:
        """Whether the text of two tokens is encoded as these two."""
        key = a * self.vocabulary.base + b
        found = self.agrees.get(key)
        if found is None:
            symbols, merges, base = self.symbols(a) + self.symbols(b), self.merges, self.vocabulary.base
            while True:  # the merge rule, for a handful of letters
                best, k = min(((merges[x * base + y], i) for i, (x, y) in enumerate(pairwise(symbols)) if x * base + y in merges), default=(None, 0))
                if best is None:
                    break
                symbols[k : k + 2] = [best[1]]
            if len(self.agrees) >= CACHE_PAIRS:
                self.agrees.clear()
            found = self.agrees[key] = symbols == [a, b]
        return found

    def inside(self, word: bytes) -> tuple[list[int], list[int]]:
        """For every prefix of a word whose end isn't reached: its last token, its count."""
        last, count = [-1], [0]
        self.go_on(word, last, count, len(word))
        return last, count

    def go_on(self, word: bytes, last: list[int], count: list[int], upto: int) -> None:
        """Add what ``last`` and ``count`` lack of the first ``upto`` bytes."""
        inner, agrees, base = self.inner, self.agrees, self.vocabulary.base
        for i in range(len(last), upto + 1):
            for j in range(i - 1, -1, -1):
                t = inner.get(word[j:i], -1)
                if t is None:
                    continue
                if t < 0:
                    raise AssertionError("every byte is a token")
                if j:
                    ok = agrees.get(last[j] * base + t)
                    if ok is None:
                        ok = self.pair_agrees(last[j], t)
                    if not ok:
                        continue
                last.append(t)
                count.append(count[j] + 1)
                break

    def ended(self, word: bytes, at: int, last: list[int], count: list[int]) -> int:
        """Tokens of the first ``at`` bytes as a whole word."""
        agrees, base = self.agrees, self.vocabulary.base
        for j in range(at - 1, -1, -1):
            t = self.closing.get(word[j:at], -1)
            if t is None:
                continue
            if t < 0:
                break
            if j:
                ok = agrees.get(last[j] * base + t)
                if ok is None:
                    ok = self.pair_agrees(last[j], t)
                if not ok:
                    continue
            return count[j] + 1
        raise AssertionError("every byte is a token")

    def word_total(self, word: bytes) -> int:
        last, count = self.inside(word[:-1])
        return self.ended(word, len(word), last, count)

    def learn(self, new: list[str]) -> None:
        split = self.split_all.findall("".join(x + "\n" for x in new))
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {"\n": -1}
        words, older = self.words, self.older
        fresh = {}
        for w in set(split).difference(words):
            if w in older:
                words[w] = older[w]
            else:
                fresh[w.encode()] = w
        before, last, count = b"", [-1], [0]
        for raw in sorted(fresh):
            k, most = 0, min(len(last) - 1, len(raw))
            while k < most and raw[k] == before[k]:
                k += 1
            del last[k + 1 :], count[k + 1 :]
            self.go_on(raw, last, count, len(raw) - 1)
            words[fresh[raw]] = self.ended(raw, len(raw), last, count)
            before = raw
        counts = np.fromiter(map(words.__getitem__, split), dtype=np.int64, count=len(split))
        ends = counts < 0
        upto = np.cumsum(np.where(ends, 0, counts))[ends]
        self.totals.update(zip(new, np.diff(upto, prepend=0).tolist(), strict=True))

    def prefix_counts(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece, by code point."""
        out, before = [], 0
        for m in self.vocabulary.split.finditer(piece):
            w = m[0]
            raw = w.encode()
            last, count = self.inside(raw)
            ends = list(accumulate(len(c.encode()) for c in w))
            for k, end in enumerate(ends, 1):
                if w[0] == "'" and len(w) == 3 and k == 2:  # a contraction cut short falls apart
                    out.append(before + self.word_total(b"'") + self.word_total(w[1].encode()))
                else:
                    out.append(before + self.ended(raw, end, last, count))
            before = out[-1]
        return out

    def ready(self, docs: list[list[tuple[list[str], str]]]) -> None:
        wanted = {p for doc in docs for ps, _ in doc for p in ps}
        if len(self.totals) > CACHE_PIECES:
            self.totals.clear()
        self.learn(list(wanted.difference(self.totals)))

    def parse(self, text: str | None) -> list[tuple[list[str], str]]:
        return [(pieces(a), b) for a, b in self.vocabulary.segments(text)] if text else []

    def count(self, doc: list[tuple[list[str], str]]) -> int:
        return sum(sum(map(self.totals.__getitem__, ps)) + bool(s) for ps, s in doc)

    def table(self, text: str) -> np.ndarray:
        """Tokens of every prefix of the normalised text, by code point; entry 0 is 0. Inside a special string the count before it stands."""
        out, done = [np.zeros(1, dtype=np.int64)], 0
        for segment, special in self.vocabulary.segments(text):
            shown, at = normalised(segment), 0
            for piece in pieces(segment):
                start = shown.index(piece, at)
                out += [np.full(start - at, done), done + np.array(self.prefix_counts(piece))]
                done, at = int(out[-1][-1]), start + len(piece)
            out.append(np.full(len(shown) - at + max(0, len(special) - 1), done))
            if special:
                done += 1
                out.append(np.array([done]))
        return np.concatenate(out)

    def cut(self, text: str, doc: list[tuple[list[str], str]], limit: int) -> int:
        """Code points in the longest prefix of the normalised text that has at most ``limit`` tokens."""
        done = shift = 0
        for (segment, special), (found, _) in zip(self.vocabulary.segments(text), doc, strict=True):
            shown, at = normalised(segment), 0
            for piece in found:
                start = shown.index(piece, at)
                if done + self.totals[piece] > limit:
                    # counts don't only grow: a longer prefix of a word may be one token where a shorter one is several
                    within = np.flatnonzero(np.array(self.prefix_counts(piece)) <= limit - done)
                    return shift + start + (int(within[-1]) + 1 if len(within) else 0)
                done, at = done + self.totals[piece], start + len(piece)
            if special and done + 1 > limit:
                return shift + len(shown)
            done, shift = done + bool(special), shift + len(shown) + len(special)
        return shift


def normalised(text: str) -> str:
    """The text whose code points a prefix counts: NFC, lower case; white space stays as it is."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


_counters: dict[int, PrefixCounter] = {}


def counter(text: str) -> PrefixCounter:
    """Tokens and the bounded tables of pairs and pieces stay with the Python worker from task to task."""
    key = hash(text)
    if key not in _counters:
        _counters.clear()
        _counters[key] = PrefixCounter(text)
    return _counters[key]


def count_tokens(df: DataFrame, limit: int = LIMIT, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``cut_chars`` of every row.

    ``cut_chars``: code points of the longest prefix (of the NFC, lower-case text) within ``limit`` tokens; null if the whole text is within it.
    """
    file = shared_file(df, path or default_tokenizer_path())
    key_type = df.schema[key].dataType.simpleString()

    def run(own: PrefixCounter, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        docs = [own.parse(t) for t in texts]
        own.ready(docs)
        counts = [own.count(d) for d in docs]
        cuts = [own.cut(t, d, limit) if n > limit else None for t, d, n in zip(texts, docs, counts, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(cuts, pa.int64())], [key, "n_bytes", "n_tokens", "cut_chars"])

    narrow = df.select(key, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    done = map_batches(narrow, lambda: partial(run, counter(file.value)), f"`{key}` {key_type}, n_bytes long, n_tokens long, cut_chars long", max_bytes=2 << 20)
    return done.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_chars")


def prefix_tables(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``prefix_tokens array<int>``: entry ``i`` is the exact token count of the first ``i`` code points (NFC, lower case).

    ``prefix_tokens[n]`` answers a truncation at ``n`` code points; the last ``i`` with ``prefix_tokens[i] <= budget`` answers a budget.
    """
    file = shared_file(df, path or default_tokenizer_path())
    key_type = df.schema[key].dataType.simpleString()

    def run(own: PrefixCounter, batch: pa.RecordBatch) -> pa.RecordBatch:
        tables = [own.table(t or "").astype(np.int32) for t in batch.column(1).to_pylist()]
        offsets = np.append(0, np.cumsum([len(x) for x in tables]))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*tables, np.zeros(0, np.int32)])))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "prefix_tokens"])

    return map_batches(df.select(key, text), lambda: partial(run, counter(file.value)), f"`{key}` {key_type}, prefix_tokens array<int>", max_bytes=2 << 20)
