"""Token ids in Re-Pair compressed binary shards.

Documents are sorted by doc_id over a range partitioning, encoded, ended by id 0 and cut at document ends into blocks of
about ``BLOCK_TOKENS`` ids, each compressed by itself. Re-Pair replaces frequent adjacent pairs by new symbols, round
after round, until no pair is frequent or no symbol is free: a round counts all pairs, makes rules of the most frequent
ones and replaces their occurrences (where two overlap the more frequent rule wins, the left one of equals). Ids stay
below 2 ** 16, so a block has room for ``65536 - first_symbol`` rules and every symbol takes two bytes.

File format: Parquet, a row for each block.
  part, block            place of the block; blocks are in ascending doc_id order by (part, block)
  before                 ids of the part before this block
  doc_ids, counts        the block's documents and their numbers of ids, the end id included
  first_symbol           smallest symbol that is a rule
  rules                  uint16 little-endian: left and right symbol of each rule
  lengths                uint32 little-endian: how many ids each rule stands for
  symbols                uint16 little-endian: the compressed block
The lengths let a reader find the symbols that cover any range of ids and expand only those.

The tokenizers library's BPE model gives all ids. Texts whose characters are the same in all Unicode tables (Latin, mostly) are cut into
words by arrays over a batch's bytes, and each different word of the batch is looked up once. Other texts are cut before their spaces,
where the word pattern always cuts too; the pieces between are cut by that pattern, those with characters beyond Latin by the library itself,
whose tables are older. Texts with white space after a space, a space at the end, a special token or a zero character are encoded
whole. A worker keeps the ids of the words and pieces that it has seen, within a bound.

Defined results: null and empty texts are the end id alone; documents with the same or a null doc_id stand next to each
other, nulls first, in the order of their texts' hashes; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import staging
from quern.llm.bpe import byte_letters
from quern.llm.words import Kept, per_worker, text_slices

BLOCK_TOKENS, END_ID, SYMBOLS = 1 << 20, 0, 1 << 16
#: Fixed value: the word pattern of byte-level vocabularies of this family.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes are the same in all Unicode tables, but for controls that only some count as white space.
SETTLED = re.compile(r"[\t-\r\x20-\x7e\xa0-\u017f]*")
UNEVEN = re.compile(r" \s")
_UNSETTLED, _LETTER, _NUMBER, _OTHER, _SPACE, _WHITE = range(6)


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start[i] : start[i] + length[i]]."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - (ends - length), length)]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte of settled text, and of each lead byte from 0xC2 with its second byte."""
    patterns = (_SPACE, " "), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_WHITE, r"\s"), (_OTHER, ".")
    one, two = np.zeros(256, np.uint8), np.zeros((62, 64), np.uint8)
    for c in filter(SETTLED.fullmatch, map(chr, range(0x180))):
        kind, raw = next(k for k, p in patterns if regex.match(p, c)), c.encode()
        if len(raw) == 1:
            one[raw[0]] = kind
        else:
            two[raw[0] - 0xC2, raw[1] - 0x80] = kind
    return one, two


_ONE, _TWO = _classes()


def _kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 text, that of its character; more than two bytes are never settled."""
    kind = _ONE[data]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead + 1 < len(data)]
    kind[lead] = kind[lead + 1] = _TWO[data[lead] - 0xC2, data[lead + 1] & 0x3F]
    return kind


def _word_starts(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the word pattern's matches begin in settled texts without white space after a space or a space at the end.

    A word begins at a space or where the class changes, not right after a space; of white space before anything but a
    space or the end, the last character is a word of its own. A quote that begins a word may be that of a short form.
    """
    n = len(data)
    before, after = np.zeros(n + 1, np.uint8), np.zeros(n + 1, np.uint8)
    before[1:], after[:-1] = kind, np.append(kind[1:], 0)
    before, after = before[:-1], after[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = 0
    after[offsets[1:][offsets[1:] > 0] - 1] = 0
    start = (before != kind) & (before != _SPACE)
    white = np.flatnonzero((kind == _WHITE) & (data < 0x80) & (before == _WHITE))
    white = white[(after[white] > 0) & (after[white] < _SPACE)]
    start[white] = True
    hard = np.flatnonzero((data == 0xC2) & (kind == _WHITE) & (before == _WHITE))  # the no-break space, of two bytes
    following = np.where(after[hard] > 0, after[np.minimum(hard + 1, n - 1)], 0)
    start[hard[(following > 0) & (following < _SPACE)]] = True
    quote = np.flatnonzero((data == 0x27) & start)
    if len(quote):
        text_end = offsets[np.searchsorted(offsets, quote, "right")]
        padded = np.append(data, np.zeros(2, np.uint8))
        first = np.where(quote + 1 < text_end, padded[quote + 1], 0)
        second = np.where(quote + 2 < text_end, padded[quote + 2], 0)
        size = np.isin(first, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
        size[((first == 0x72) | (first == 0x76)) & (second == 0x65) | (first == 0x6C) & (second == 0x6C)] = 2
        quote, size, text_end = quote[size > 0], size[size > 0], text_end[size > 0]
        start[quote + 1] = False
        rest = quote + 1 + size
        start[rest[rest < text_end]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids by the tokenizers library's BPE model, as uint16, with memos of words and of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.words = _Words(self.tokenizer.model)
        self.pieces = _Pieces(self.words, self.tokenizer.pre_tokenizer.pre_tokenize_str)

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, each followed by END_ID, and how many each text has with it.

        Settled texts are cut into words by arrays, and every different word of theirs is looked up once.
        """
        self.words.tidy()
        self.pieces.tidy()
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        data, offsets = self._bytes(texts)
        kind = _kinds(data)
        following = np.append(kind[1:], 0)
        following[offsets[1:][offsets[1:] > 0] - 1] = 0
        odd = (kind == _UNSETTLED) | (kind == _SPACE) & ((following == 0) | (following >= _SPACE))
        single = np.zeros(len(texts), bool)
        single[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        single |= pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        found = [array("H", [END_ID]).tobytes(), *self._apart(texts.filter(pa.array(single)).to_pylist())]
        if single.any():
            texts = texts.filter(pa.array(~single))
            data, offsets = self._bytes(texts)
            kind = _kinds(data)
        begin = _word_starts(data, kind, offsets)
        spans = [pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, *spans]).dictionary_encode()
        number = np.asarray(coded.indices) + len(found)
        if len(number):
            one = pa.LargeListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int64()), coded.dictionary)
            found += self.words.of(pc.binary_join(one, pa.scalar(b"\0", pa.large_binary()))[0].as_py().split(b"\0"))
        ends = np.zeros(len(single), np.int64)  # words of all texts up to this one
        ends[~single] = np.searchsorted(begin, offsets[1:])
        ends = np.maximum.accumulate(ends)
        at = np.sort(np.concatenate([ends, ends[single]]))  # where an end is put in, or a text encoded by itself and its end
        extra = np.zeros(len(at), np.int64)
        extra[np.flatnonzero(single) + np.arange(single.sum())] = 1 + np.arange(single.sum())
        number = np.insert(number, at, extra)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        length = sizes[number]
        total = np.append(0, np.cumsum(length))[ends + np.arange(1, len(ends) + 1) + np.cumsum(single)]
        flat = ragged(np.frombuffer(b"".join(found), np.uint16), (np.cumsum(sizes) - sizes)[number], length)
        return flat, np.diff(total, prepend=0)

    @staticmethod
    def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of ``texts``, and where each begins and the last ends."""
        size = np.asarray(pc.binary_length(texts), np.int64)
        offsets = np.append(0, np.cumsum(size))
        if not offsets[-1]:
            return np.zeros(0, np.uint8), offsets
        first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]
        return np.frombuffer(texts.buffers()[2], np.uint8)[first : first + offsets[-1]], offsets

    def _apart(self, texts: list[str]) -> list[bytes]:
        """The ids of each text that is not cut by arrays."""
        cut = []
        for text in texts:
            whole = text[-1] == " " or "<|" in text or "\0" in text or UNEVEN.search(text)
            cut.append(None if whole else ("\0" + text).split(" "))  # a first word has no space before it
        new = set().union(*filter(None, cut)).difference(self.pieces)
        with self.pieces.including(self.pieces.found(list(new))):
            get = self.pieces.__getitem__
            return [b"".join(map(get, pieces)) if pieces else self._whole(text) for text, pieces in zip(texts, cut)]

    def _whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class _Words(Kept):
    """Ids of words (their bytes) of the word pattern; emptied between texts' batches, long ones are not kept."""

    MOST, MOST_BYTES = 1_000_000, 48 << 20

    def __init__(self, model):
        super().__init__(self.MOST, self.MOST_BYTES)
        self.tokenize = model.tokenize
        self.letters = np.array([ord(x) for x in byte_letters()], "<u2")

    def of(self, words: list[bytes]) -> list[bytes]:
        ids = list(map(self.get, words))
        new = [i for i, x in enumerate(ids) if x is None]
        lettered = self.letters[np.frombuffer(b"".join([words[i] for i in new]), np.uint8)].tobytes().decode("utf-16-le")
        begin = 0
        for i in new:
            word = words[i]
            end = begin + len(word)
            ids[i] = known = array("H", [t.id for t in self.tokenize(lettered[begin:end])]).tobytes()
            begin = end
            if len(word) <= self.LONGEST:
                self[word] = known
                self.bytes += len(word) + len(known)
        return ids


class _Pieces(Kept):
    """Ids of what stands between two spaces, after a space or, marked by a zero character, at a text's start."""

    MOST, MOST_BYTES = 800_000, 48 << 20

    def __init__(self, words: _Words, library):
        super().__init__(self.MOST, self.MOST_BYTES)
        self.words, self.split, self.library = words, regex.compile(WORD).findall, library

    def cut(self, piece: str) -> list[str]:
        if piece.isalpha() and piece.isascii():
            return [" " + piece]
        text = piece[1:] if piece[0:1] == "\0" else " " + piece
        return self.split(text) if SETTLED.fullmatch(text) else [text[a:b] for _, (a, b) in self.library(text)]

    def found(self, new: list[str]) -> dict[str, bytes]:
        """The ids of new pieces; each different word of theirs is looked up once."""
        cut = list(map(self.cut, new))
        words = list({w for part in cut for w in part})
        ids = dict(zip(words, self.words.of([w.encode() for w in words])))
        return {piece: b"".join([ids[w] for w in part]) for piece, part in zip(new, cut)}


def _slots(stands: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The place of each pair in ``stands`` (sorted), -1 for others: by a table of hashes, by search where hashes are shared."""
    bits = max(12, len(stands).bit_length() + 3)
    hashed = lambda x: (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    table = np.full(1 << bits, -1, np.int32)
    table[hashed(stands)] = np.arange(len(stands), dtype=np.int32)
    slot = table[hashed(pair)]
    other = np.flatnonzero((slot >= 0) & (stands[slot] != pair))
    found = np.minimum(np.searchsorted(stands, pair[other]), len(stands) - 1)
    slot[other] = np.where(stands[found] == pair[other], found, -1)
    return slot


def compress(ids: np.ndarray, first_symbol: int, least_use: int = 8, fall: int = 4, pairs_a_round: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (pairs of symbols) of one block.

    Every round takes the pairs that occur at least a ``fall``-th as often as the most frequent one, ``pairs_a_round`` of
    the most frequent at least, as long as they occur ``least_use`` times: a rule takes as much room as four symbols. It
    ends when no pair is used so often, or all symbols are taken. Pairs only get rarer, but for those of new symbols; so a
    place whose pair is rare is not looked at again until a neighbour is replaced, and counts are exact all the same.
    """
    seq, rules, known, idle = ids.astype(np.uint16), [], first_symbol, []
    live = np.arange(max(0, len(seq) - 1))  # places whose pair may be frequent
    while known < SYMBOLS and len(live):
        pair = seq[live].astype(np.uint32) << np.uint32(16) | seq[live + 1]
        ordered = np.sort(pair)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(first, len(ordered)))
        often = count >= least_use
        stands, count = ordered[first[often]], count[often]
        if idle:  # pairs of which too few are left beside those they overlap with, in this same sequence
            count[np.isin(stands, np.concatenate(idle))] = 0
        if not count.any():
            break
        own = _slots(stands, pair)
        live, own = live[own >= 0], own[own >= 0]
        nth = min(pairs_a_round, len(count))
        level = max(least_use, min(count.max() / fall, np.partition(count, -nth)[-nth]))
        order = np.lexsort((stands, -count))[: SYMBOLS - known]
        order = order[count[order] >= level]
        none = np.int32(1 << 30)
        rank = np.full(len(stands), none, np.int32)
        rank[order] = np.arange(len(order))
        mine = rank[own]
        at, mine = live[mine < none], mine[mine < none]
        r = np.full(len(seq) + 2, none, np.int32)
        r[at + 1] = mine
        chosen = (mine <= r[at]) & (mine <= r[at + 2])
        at, mine = at[chosen], mine[chosen]
        start = np.concatenate([[True], np.diff(at) != 1])  # a run is of one symbol: every other of its pairs
        chosen = (at - at[start][np.cumsum(start) - 1]) % 2 == 0
        at, mine = at[chosen], mine[chosen]
        useful = np.flatnonzero(np.bincount(mine, minlength=len(order)) >= least_use)
        if not len(useful):
            idle.append(stands[order])
            continue
        idle = []
        symbol = np.full(len(order), -1, np.int64)
        symbol[useful] = known + np.arange(len(useful))
        ready = symbol[mine] >= 0
        at, mine = at[ready], mine[ready]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq[at] = symbol[mine]
        place = np.cumsum(keep, dtype=np.int32) - 1
        seq = seq[keep]
        again = np.zeros(len(seq) + 1, bool)
        again[place[live]] = True
        again[place[at]] = True
        again[place[at] - 1] = True  # of the first place, the end, which has no pair
        live = np.flatnonzero(again[: len(seq) - 1])
        new = stands[order[useful]]
        rules.append(np.stack([new >> np.uint32(16), new & np.uint32(0xFFFF)], 1).astype(np.uint16))
        known += len(useful)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)


def rule_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    length = np.ones(first_symbol + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        length[first_symbol + i] = length[a] + length[b]
    return length[first_symbol:]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    flat = rules.reshape(-1).astype(np.uint16)  # all rules' expansions one after the other
    while len(flat) and (nested := flat >= first_symbol).any():
        pairs = np.zeros((len(flat), 2), np.uint16)
        pairs[:, 0] = flat
        pairs[nested] = rules[flat[nested] - np.uint16(first_symbol)]
        keep = np.ones((len(flat), 2), bool)
        keep[~nested, 1] = False
        flat = pairs[keep]
    start = np.cumsum(lengths) - lengths
    base = np.arange(first_symbol, dtype=np.uint16)
    both = np.concatenate([base, flat])
    starts = np.concatenate([np.arange(first_symbol), first_symbol + start])
    sizes = np.concatenate([np.ones(first_symbol, np.int64), lengths])
    return ragged(both, starts[symbols], sizes[symbols])


def read_range(row: dict, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a block: only the symbols that cover them are expanded."""
    rules, lengths, symbols = (np.frombuffer(row[k], t) for k, t in (("rules", "<u2"), ("lengths", "<u4"), ("symbols", "<u2")))
    first = row["first_symbol"]
    size = np.ones(first + len(lengths), np.int64)
    size[first:] = lengths
    ends = np.cumsum(size[symbols])
    if not len(ends) or stop <= start:
        return np.zeros(0, np.uint16)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    before = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], rules.reshape(-1, 2), lengths.astype(np.int64), first)[start - before : stop - before]


def _block(part: int, block: int, before: int, ids: np.ndarray, doc_ids: pa.Array, counts: np.ndarray, first_symbol: int, schema: pa.Schema):
    symbols, rules = compress(ids, first_symbol)
    lengths = rule_lengths(rules, first_symbol)
    row = [[part], [block], [before], [doc_ids.to_pylist()], [counts.tolist()], [first_symbol]]
    row += [[x.tobytes()] for x in (rules.astype("<u2"), lengths.astype("<u4"), symbols.astype("<u2"))]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)


def _write(batches, path: str, schema: pa.Schema):
    from pyspark import TaskContext

    encoder = per_worker(Encoder, path)
    part, block, before, held, n = TaskContext.get().partitionId(), 0, 0, [], 0

    def flush():
        ids = np.concatenate([x[0] for x in held])
        return _block(part, block, before, ids, pa.concat_arrays([x[1] for x in held]), np.concatenate([x[2] for x in held]), encoder.vocabulary, schema)

    for batch in text_slices(batches, 1 << 20):
        ids, counts = encoder.encode(batch.column("text"))
        held.append((ids, batch.column("doc_id"), counts))
        n += len(ids)
        if n >= BLOCK_TOKENS:
            yield flush()
            block, before, held, n = block + 1, before + n, [], 0
    if held:
        yield flush()


def write(docs: DataFrame, path: str, to: str) -> None:
    """Write the token ids of ``docs`` to folder ``to``. ``path`` is the tokenizer file on every executor."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"part int, block int, before long, doc_ids array<{kind}>, counts array<long>, first_symbol int, rules binary, lengths binary, symbols binary"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )
    staging.small_batches(ordered).mapInArrow(functools.partial(_write, path=path, schema=schema), ddl).write.parquet(to)


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            rules, lengths, symbols = (np.frombuffer(row[k], t) for k, t in (("rules", "<u2"), ("lengths", "<u4"), ("symbols", "<u2")))
            ids = expand(symbols, rules.reshape(-1, 2), lengths.astype(np.int64), row["first_symbol"]).astype("<u4")
            counts = np.array(row["counts"], np.int64)
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
            n = len(counts)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": row["doc_ids"], "part": np.full(n, row["part"], np.int32), "local": row["before"] + ends - counts, "n_tokens": counts, "ids_crc32": np.array(crc, np.int64)},
                schema=pa.schema([("doc_id", batch.schema.field("doc_ids").type.value_type), ("part", pa.int32()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]),
            )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: one row per document with doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    rows = files.select("part", "before", "doc_ids", "counts", "first_symbol", "rules", "lengths", "symbols").mapInArrow(
        _read, f"doc_id {kind}, part int, local long, n_tokens long, ids_crc32 long"
    )
    total = F.expr("aggregate(counts, 0L, (a, c) -> a + c)")
    parts = files.select("part", total.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))  # a row for each file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = staging.new_path(spark, "repair")
    write(staging.table(spark, sf_dir, "documents"), default_path(), to)
    return read(spark, to)
