"""BPE encoding and decoding in batched numpy merge rounds.

The tokenizer file (``tokenizers`` JSON: NFC, white space, lower case, split pattern, byte alphabet,
word-end suffix) is read on the driver and broadcast; it is a few MB whatever the corpus.

* Text is cut at white space. A piece between white space is encoded alone, since no pre-token crosses white space,
  and pieces repeat; each task keeps a bounded table of the pieces that it has met.
* The new pieces of a batch are encoded together: the symbols of all their pre-tokens lie in one flat array, the rank of each adjacent
  pair is found by binary search over the sorted pair keys, and each round merges every word's lowest-ranked pair.
* Decoding takes token strings by id and joins them with spaces (the file names no decoder).

Nulls and empty texts give no ids and the empty string. Special strings inside a text become their special ids, as the library does by
default. There is no shuffle: output partitions follow the input's. A pair's rank is one merge's alone; of equal pairs that overlap, the left one merges first.

Very long texts are encoded whole. A slice of a batch holds about 2 MB or one text, whose pieces take some 15 times its size; a single word of a million letters takes a round for each rank that its
pairs show, so its time grows faster than its length. Equal texts get equal ids, repeated rows are rows of their own, an empty table gives an empty result. Other columns are ignored; ``decode`` reads the
key and the ids alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Pieces that a task remembers before it starts anew.
CACHE_PIECES = 100_000
NO_RANK = np.int64(1 << 40)


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """What the merge rounds need; built once in each Python worker."""

    tokens: list[str]
    specials: dict[str, int]
    split: regex.Pattern
    first: np.ndarray  # symbol of a byte inside a word
    last: np.ndarray  # symbol of a byte at a word's end
    pair_keys: np.ndarray  # sorted left * base + right
    pair_rank: np.ndarray
    pair_new: np.ndarray
    base: int

    @classmethod
    def read(cls, text: str) -> Vocabulary:
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("a byte-level BPE file is needed")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = [""] * (1 + max([*vocab.values(), *specials.values()]))
        for k, v in [*vocab.items(), *specials.items()]:
            tokens[v] = k
        letters = byte_letters()
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        base = len(tokens)
        keys = np.array([vocab[a] * base + vocab[b] for a, b in pairs], dtype=np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        return cls(tokens, specials, regex.compile(pattern), np.array([vocab[c] for c in letters], dtype=np.int64), np.array([vocab[c + suffix] for c in letters], dtype=np.int64), keys[order], order.astype(np.int64), new[order], base)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the sorted pairs and rank (``NO_RANK``: no such merge) of each pair."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return at, np.where(self.pair_keys[at] == keys, self.pair_rank[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one flat array, and each word's token count."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.first[raw]
        ends = np.cumsum(lengths) - 1
        full = lengths > 0
        symbols[ends[full]] = self.last[raw[ends[full]]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        # place of each symbol's pair with its right neighbour, and that pair's rank
        at, rank = self.ranks(symbols[:-1], symbols[1:]) if len(symbols) else (symbols, symbols)
        at, rank = np.append(at, 0), np.append(rank, NO_RANK)
        rank[ends[full]] = NO_RANK
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(word)))
            going = best < NO_RANK
            if not going.all():  # words without a merge left are final
                active = np.repeat(going, sizes)
                done_symbols.append(symbols[~active])
                done_words.append(word[~active])
                symbols, word, at, rank = symbols[active], word[active], at[active], rank[active]
                best, sizes = best[going], sizes[going]
                if not len(symbols):
                    break
            place = np.flatnonzero(rank == np.repeat(best, sizes))
            # of overlapping hits (a symbol repeated), every second one counts, from the left
            run = np.append(True, np.diff(place) != 1)
            if not run.all():
                first_of_run = np.flatnonzero(run)
                within = np.arange(len(place)) - np.repeat(first_of_run, np.diff(np.append(first_of_run, len(place))))
                place = place[within % 2 == 0]
            symbols[place] = self.pair_new[at[place]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[place + 1] = False
            fresh = np.zeros(len(symbols), dtype=bool)
            fresh[place] = True
            before = place[place > 0] - 1
            fresh[before] = True
            fresh[before[~keep[before]] - 1] = True  # the left neighbour was itself just merged away
            symbols, word, at, rank, fresh = symbols[keep], word[keep], at[keep], rank[keep], fresh[keep]
            redo = np.flatnonzero(fresh[:-1])
            at[redo], rank[redo] = self.ranks(symbols[redo], symbols[redo + 1])
            rank[redo[word[redo] != word[redo + 1]]] = NO_RANK
            rank[-1] = NO_RANK
        done_symbols.append(symbols)
        done_words.append(word)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    # -- text around the merges ------------------------------------------------------------------

    def segments(self, text: str) -> list[tuple[str, str]]:
        """The text between special strings, each with the special string that follows it (or '')."""
        if not any(x in text for x in self.specials):
            return [(text, "")]
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")", text)
        return list(zip(parts[::2], [*parts[1::2], ""], strict=True))


#: Control characters that Python takes for white space and the tokenizer's pattern doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"\s+")


def pieces(text: str) -> list[str]:
    """Normalise (NFC, lower case letter by letter) and cut at white space."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no special form of sigma at a word's end
    text = text.lower()
    if SEPARATORS.search(text):
        return [x for x in regex.split(r"[\s--[\x1c-\x1f]]+", text, flags=regex.V1) if x]
    return text.split()


class Encoder:
    """A vocabulary with the table of pieces that a task has met."""

    def __init__(self, own: Vocabulary):
        self.vocabulary = own
        self.ids: dict[str, bytes] = {}
        self.split_all = regex.compile(self.vocabulary.split.pattern + "|\\n")
        self.special_ids = {k: np.int32(v).tobytes() for k, v in self.vocabulary.specials.items()}

    def learn(self, new: list[str]) -> None:
        words = self.split_all.findall("".join(x + "\n" for x in new))
        place = {w: i for i, w in enumerate(dict.fromkeys(words))}
        closing = place.pop("\n", -1)
        flat, counts = self.vocabulary.merge([w.encode() for w in place])
        counts = np.insert(counts, closing, 0) if closing >= 0 else counts
        word_ends = np.append(0, np.cumsum(counts))
        order = np.fromiter(map({**place, "\n": closing}.__getitem__, words), dtype=np.int64, count=len(words))
        sizes = counts[order]
        flat = flat[np.repeat(word_ends[order] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())]
        ends = np.append(0, np.cumsum(sizes)[order == closing])
        raw = flat.astype(np.int32).tobytes()
        self.ids.update((x, raw[4 * a : 4 * b]) for x, a, b in zip(new, ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[bytes, np.ndarray]:
        """All ids as int32 bytes, and the offsets of each text's ids."""
        parts = [[(pieces(a), b) for a, b in self.vocabulary.segments(t)] if t else [] for t in texts]
        wanted = {p for doc in parts for ps, _ in doc for p in ps}
        if len(self.ids) > CACHE_PIECES:
            self.ids.clear()
        self.learn(list(wanted.difference(self.ids)))
        out, ends, total = [], [0], 0
        for doc in parts:
            raw = b"".join(b"".join(map(self.ids.__getitem__, ps)) + (self.special_ids[s] if s else b"") for ps, s in doc)
            out.append(raw)
            total += len(raw) // 4
            ends.append(total)
        return b"".join(out), np.array(ends, dtype=np.int64)


_vocabularies: dict[int, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """One vocabulary for each tokenizer file in a Python worker; it outlives the task, the table of pieces doesn't."""
    key = hash(text)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary.read(text)
    return _vocabularies[key]


def encoder(text: str) -> Encoder:
    return Encoder(vocabulary(text))


def encode_array(own: Encoder, texts: pa.Array) -> pa.ListArray:
    raw, ends = own.encode(texts.to_pylist())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(raw, dtype=np.int32)))


def decode_array(ids: pa.ListArray, strings: pa.Array) -> pa.Array:
    flat = strings.take(pa.array(ids.flatten()))
    offsets = np.asarray(ids.offsets)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), flat), " ")


def shared_file(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())


def encode(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids array<int>`` of every row; a null text has no ids. Other columns are not read."""
    return round_trip(df, path, text, key).select(key, "ids")


def round_trip(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids array<int>`` and ``decoded string`` of every row. Equal rows give equal rows; an empty table gives an empty one."""
    file = shared_file(df, path or default_tokenizer_path())
    key_type = df.schema[key].dataType.simpleString()

    def setup():
        own = encoder(file.value)
        strings = pa.array(own.vocabulary.tokens, pa.string())

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = encode_array(own, batch.column(1))
            return pa.RecordBatch.from_arrays([batch.column(0), ids, decode_array(ids, strings)], [key, "ids", "decoded"])

        return run

    return map_batches(df.select(key, text), setup, f"`{key}` {key_type}, ids array<int>, decoded string", max_bytes=2 << 20)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key`` and ``decoded string`` from an array of ids; null ids give the empty string, an unknown id fails."""
    file = shared_file(df, path or default_tokenizer_path())
    key_type = df.schema[key].dataType.simpleString()

    def setup():
        strings = pa.array(vocabulary(file.value).tokens, pa.string())

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type)).cast(pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0), decode_array(lists, strings)], [key, "decoded"])

        return run

    return map_batches(df.select(key, F.col(ids).cast("array<int>")), setup, f"`{key}` {key_type}, decoded string")


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = round_trip(df, path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
