"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols lie in a row; leaf i of the tree holds the merge rank of symbol i and its right neighbour, and each
inner node the least rank below it. The root names the lowest rank, at its leftmost place. A merge changes two leaves and
removes one, each with an update along one path to the root, until the root says that no pair can be merged.

All new words of a batch are merged at once: words with the same number of leaves are the rows of numpy arrays of binary
trees, and a step takes every row's root, merges there and updates the paths (``merge_rows``). A leaf holds its rank
before its place, so the root itself names the leftmost of the lowest. Words of more than ``ROW_LEAVES`` pairs have a
tree of their own (``RankTree``) whose nodes have ``FAN`` children; a run of a million symbols has one of four levels.

The vocabulary is read from a tokenizer file (BPE model with ``</w>`` word ends). Composed Latin text is lower-cased and
split into words here, by the file's word pattern; all else by the library's own normaliser and pre-tokeniser, whose
tables of letters may be newer or older than Python's. Texts are cut at spaces, tabs and line ends, which no word or
normalisation reaches across; a worker keeps what short pieces and words became, within a bound of entries and bytes.

Defined results: null and empty texts have no ids and decode to the empty text; the strings of special tokens in a
text are those tokens, as in the tokenizers library; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quern.llm import staging
from quern.llm.words import Kept, per_worker, text_slices

FAN, NO_PAIR, ROW_LEAVES, SLICE = 32, 1 << 30, 64, 1 << 20
LATIN = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]+").fullmatch  # composed letters whose lower case is one letter
_PLACE, _NONE = 6, np.int64(NO_PAIR) << 6  # bits of a leaf's place; a leaf without a pair


class RankTree:
    """A segment tree of least ranks with FAN children a node."""

    def __init__(self, ranks: list[int]):
        self.levels = [ranks]
        while len(self.levels[-1]) > FAN:
            below = self.levels[-1]
            self.levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])

    def leftmost_least(self) -> tuple[int, int]:
        """The least rank and the first leaf that has it."""
        top = self.levels[-1]
        least = min(top)
        at = top.index(least)
        for level in reversed(self.levels[:-1]):
            at = level.index(least, at * FAN)
        return least, at

    def update(self, at: int, rank: int) -> None:
        levels = self.levels
        levels[0][at] = rank
        for k in range(1, len(levels)):
            first = at - at % FAN
            at //= FAN
            least = min(levels[k - 1][first : first + FAN])
            if levels[k][at] == least:
                return
            levels[k][at] = least


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable Latin-1, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Ranks of symbol pairs for arrays of pairs, and what each rank merges to."""

    def __init__(self, merges: dict[int, tuple[int, int]]):
        self.pairs = np.array(sorted(merges), np.int64)
        self.rank = np.array([merges[p][0] for p in self.pairs.tolist()], np.int64)
        self.symbol = np.zeros(int(self.rank.max(initial=-1)) + 1, np.int64)
        for rank, symbol in merges.values():
            self.symbol[rank] = symbol

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.rank[at], NO_PAIR) if len(self.pairs) else np.full(len(pair), NO_PAIR)


def merge_rows(symbols: np.ndarray, length: np.ndarray, merges: Merges) -> np.ndarray:
    """Merge every row of ``symbols`` (``length[i]`` of row i count) to its end; merged-away places hold -1 afterwards.

    All rows have a tree of the same ``leaves``, the power of two that the longest row needs.
    """
    rows, width = symbols.shape
    leaves = 1 << max(0, int(width - 2).bit_length())
    tree = np.full((rows, 2 * leaves), _NONE)
    r, c = np.nonzero(np.arange(width - 1) < (length - 1)[:, None])
    tree[r, leaves + c] = merges.ranks(symbols[r, c], symbols[r, c + 1]) << _PLACE | c
    for node in range(leaves - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    after = np.tile(np.arange(1, width + 1), (rows, 1))
    before = after - 2
    after[after >= length[:, None]] = width

    def update(row, place, value):
        node = leaves + place
        tree[row, node] = value
        while node[0] > 1 if len(node) else False:  # all leaves are equally deep
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    live = np.flatnonzero(tree[:, 1] < _NONE)
    while len(live):
        root = tree[live, 1]
        at = root & ((1 << _PLACE) - 1)
        right = after[live, at]
        symbols[live, at] = new = merges.symbol[root >> _PLACE]
        symbols[live, right] = -1
        following, previous = after[live, right], before[live, at]
        after[live, at] = following
        inner = right < leaves
        update(live[inner], right[inner], _NONE)
        more = following < width
        row, place, nxt = live[more], at[more], following[more]
        before[row, nxt] = place
        update(row, place, merges.ranks(new[more], symbols[row, nxt]) << _PLACE | place)
        update(live[~more], at[~more], _NONE)
        back = previous >= 0
        row, place = live[back], previous[back]
        update(row, place, merges.ranks(symbols[row, place], new[back]) << _PLACE | place)
        live = live[tree[live, 1] < _NONE]
    return symbols


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, most: int = 150_000, most_bytes: int = 32 << 20):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        merges: dict[int, tuple[int, int]] = {}  # left << 32 | right -> rank, merged symbol
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        self.merges, self.arrays = merges, Merges(merges)
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.inner_of, self.last_of = np.array(self.inner), np.array(self.last)
        letters_only = spec | {"model": spec["model"] | {"vocab": {}, "merges": []}, "added_tokens": []}  # its model is not needed
        library = Tokenizer.from_str(json.dumps(letters_only))
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.of_word: Kept = Kept(most, most_bytes)  # a word's bytes -> its ids as int32
        self.of_piece: Kept = Kept(most, most_bytes)  # a piece -> decimal ids, a line end, decoded text

    def merged(self, ids: list[int]) -> list[int]:
        """Apply merges to one long word, always the leftmost of the lowest rank, until no adjacent pair has one."""
        n = len(ids)
        if n < 2:
            return ids
        merges, none = self.merges, (NO_PAIR, 0)
        tree = RankTree([merges.get(ids[i] << 32 | ids[i + 1], none)[0] for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while True:
            least, at = tree.leftmost_least()
            if least == NO_PAIR:
                break
            right = after[at]
            ids[at] = merges[ids[at] << 32 | ids[right]][1]
            ids[right] = -1
            following = after[at] = after[right]
            if right < n - 1:
                tree.update(right, NO_PAIR)
            if following < n:
                before[following] = at
                tree.update(at, merges.get(ids[at] << 32 | ids[following], none)[0])
            else:
                tree.update(at, NO_PAIR)
            if (left := before[at]) >= 0:
                tree.update(left, merges.get(ids[left] << 32 | ids[at], none)[0])
        return [i for i in ids if i >= 0]

    def words_of(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids, as int32, of different words (their bytes), merged together."""
        found: dict[bytes, bytes] = {}
        by_width: dict[int, list[bytes]] = {}
        for w in words:
            if len(w) > ROW_LEAVES + 1:
                ids = [self.inner[b] for b in w]
                ids[-1] = self.last[w[-1]]
                found[w] = array("i", self.merged(ids)).tobytes()
            else:
                by_width.setdefault(max(2, 1 + (1 << max(0, (len(w) - 2).bit_length()))), []).append(w)
        for width, group in by_width.items():
            length = np.fromiter(map(len, group), np.int64, len(group))
            raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in group]), np.uint8).reshape(len(group), width)
            symbols = self.inner_of[raw]
            rows = np.arange(len(group))
            symbols[rows, length - 1] = self.last_of[raw[rows, length - 1]]
            symbols[np.arange(width) >= length[:, None]] = -1
            symbols = merge_rows(symbols, length, self.arrays)
            count = 4 * (symbols >= 0).sum(1)
            ends = np.cumsum(count)
            flat = symbols[symbols >= 0].astype(np.int32).tobytes()
            found.update((w, flat[b - n : b]) for w, n, b in zip(group, count.tolist(), ends.tolist()))
        return found

    def parts_of(self, piece: str) -> list[bytes | int]:
        """A piece as words (their bytes) and the ids of special tokens."""
        parts: list[bytes | int] = []
        for part in self.specials.split(piece) if "<|" in piece else (piece,):
            if part in self.special:
                parts.append(self.special[part])
            elif part.isascii() or LATIN(part):
                parts += [w.encode() for w in self.split.findall(part.lower())]
            else:
                byte_of = self.byte_of
                parts += [bytes([byte_of[c] for c in w]) for w, _ in self.pre_tokenize(self.normalize(part))]
        return parts

    @staticmethod
    def pieces(text: str | None) -> list[str]:
        return [p for p in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if p]

    def _ids(self, parts: dict[str, list[bytes | int]]) -> dict[str, bytes]:
        """The ids, as int32, of each piece; new words are merged together and kept."""
        known = self.of_word
        known.tidy()
        new = self.words_of(list({w for p in parts.values() for w in p if type(w) is bytes and w not in known}))
        with known.including(new):
            return {k: b"".join([known[w] if type(w) is bytes else array("i", [w]).tobytes() for w in p]) for k, p in parts.items()}

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pieces(t) for t in texts]
        ids = self._ids({p: self.parts_of(p) for p in {p for pieces in cut for p in pieces}})
        return [np.frombuffer(b"".join([ids[p] for p in pieces]), np.int32).tolist() for pieces in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        return " ".join([self.tokens[i] for i in ids])

    def rendered(self, text: str | None) -> tuple[int, str, str]:
        return self.rendered_all([text])[0]

    def rendered_all(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: how many ids, the ids as decimals joined by spaces, and the decoded text."""
        known, out = self.of_piece, []
        known.tidy()
        cut = [self.pieces(t) for t in texts]
        new = {}
        for piece, raw in self._ids({p: self.parts_of(p) for p in {p for pieces in cut for p in pieces if p not in known}}).items():
            ids = np.frombuffer(raw, np.int32).tolist()
            new[piece] = f"{' '.join(map(str, ids))}\n{self.decode(ids)}" if ids else ""
        with known.including(new):
            for pieces in cut:  # decimal ids and decoded text in turn
                both = "\n".join(filter(None, map(known.__getitem__, pieces))).split("\n")
                decimal = " ".join(both[::2])
                out.append((decimal.count(" ") + bool(decimal), decimal, " ".join(both[1::2])))
        return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encode(batches, path: str):
    bpe = per_worker(Bpe, path)
    for batch in text_slices(batches, SLICE):
        ids = bpe.encode_all(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids. ``path`` is the tokenizer file on every executor."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return staging.small_batches(docs.select("doc_id", "text")).mapInArrow(functools.partial(_encode, path=path), f"doc_id {kind}, ids array<int>")


def _decode(batches, path: str):
    bpe = per_worker(Bpe, path)
    for batch in batches:
        texts = [bpe.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, text of ``ids``' rows."""
    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(functools.partial(_decode, path=path), f"doc_id {kind}, text string")


def _digest(batches, path: str):
    bpe = per_worker(Bpe, path)
    for batch in text_slices(batches, SLICE):
        n, ids, text = [], [], []
        for count, decimal, plain in bpe.rendered_all(batch.column("text").to_pylist()):
            n.append(count)
            ids.append(hashlib.sha256(decimal.encode()).hexdigest())
            text.append(hashlib.sha256(plain.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a round trip of every text in one pass without a shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return staging.small_batches(docs.select("doc_id", "text")).mapInArrow(functools.partial(_digest, path=path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(staging.table(spark, sf_dir, "documents"), default_path())
