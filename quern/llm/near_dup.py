"""Near-duplicate documents by SetSketch registers, verified on whole shingle sets.

1. Sketch. A document's set holds its distinct runs of five words (fewer words: the whole sequence). Register i keeps
   the least of an exponential variable over the set, on an exponentially spaced grid of base ``BASE`` and truncated to
   a byte. Registers merge by maximum, and two registers are equal about as often as the sets' similarity.
2. Classes. Documents with equal sets (by count and a 128-bit sum of hashes) become one class, named by its smallest
   doc_id; only classes go on.
3. Bands. Classes that agree in a whole band of registers share a bucket. ``banding`` gives the longest bands with which
   two classes at the threshold share none with a probability of at most ``MISS``: 32 bands of 6 at 0.85, 38 of 5 at 0.80.
4. Stars. In every bucket the class with the most company over all bands is the pivot: the text that others were made
   from, where there is one. Every class first meets one of its pivots, that with the most company, and then those
   pivots that are not connected with it by now. Pairs are estimated from their registers and known set sizes by
   maximum likelihood; those within reach of the threshold are verified on full sets.
5. The rest. Members that are connected by now need no more links. Every bucket's members outside the pivot's component
   meet all members of other components, in blocks of bounded size, each pair in the first band that it shares. First
   on registers alone: who has no pair that the likelihood estimate leaves open leaves the block. The texts of those
   who stay then join the blocks, which verify their open pairs and return links that connect what is not connected
   yet. So no pair of a bucket is left out, and what leaves a block is never more than its members.
6. Components of all verified links.

Verification sends each pair's texts, not its sets, to groups of one pivot and ``CHUNK`` partners. Only the texts of
classes that share a bucket are read again.

Defined results: null and empty texts have no set, link with nothing and are kept; a null doc_id links with nothing and
is kept; rows that repeat a doc_id are one document; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import graph, staging
from quern.llm.words import text_slices

WORDS, REGISTERS, BASE, OFFSET = 5, 192, 1.1, 24
MISS = 3e-7
CHUNK, BLOCK, BLOCK_SHINGLES = 64, 512, 1 << 21
SLACK = 4.5  # standard deviations by which an estimate may fall short of the threshold

U = np.uint64
_DRAW = np.random.default_rng(20240229)
_BYTE = _DRAW.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_STEP = int(_DRAW.integers(1, 2**63)) | 1
_BACK = pow(_STEP, -1, 2**64)
_MUL = _DRAW.integers(1, 2**63, REGISTERS, dtype=np.uint64) * U(2) + U(1)
_ADD = _DRAW.integers(0, 2**63, REGISTERS, dtype=np.uint64) * U(2) + U(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(by)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def _part_hashes(parts: list[list[bytes]]) -> list[np.ndarray]:
    """Hashes of the shingles of each non-empty list of words: polynomials over the bytes between two word ends."""
    data = np.frombuffer(b"".join([b" ".join(p) + b" " for p in parts]), np.uint8)
    step, back = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * step[: len(data)], out=total[1:])
    end = np.flatnonzero(data == 32)
    start = np.concatenate([[0], end[:-1] + 1])
    words = np.array([len(p) for p in parts])
    count = np.maximum(1, words - WORDS + 1)
    ends = np.cumsum(count)
    first = np.arange(ends[-1]) + np.repeat(np.cumsum(words) - words - (ends - count), count)
    last = first + np.repeat(np.minimum(words, WORDS), count) - 1
    h = mix((total[end[last]] - total[start[first]]) * back[start[first]])
    return np.split(h, ends[:-1])


def shingle_sets(texts: list[str | None], most_words: int = 50_000, most_bytes: int = 1 << 20) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Long texts are hashed in overlapping parts, and parts by about a MB."""
    sets: list[list[np.ndarray]] = [[] for _ in texts]
    parts, of, held = [], [], 0

    def hashed():
        for i, h in zip(of, _part_hashes(parts) if parts else ()):
            sets[i].append(h)

    for i, t in enumerate(texts):
        words = t.encode().lower().split() if t else []  # of bytes: A-Z only, ASCII white space only
        for a in range(0, max(1, len(words) - WORDS + 1), most_words) if words else ():
            parts.append(words[a : a + most_words + WORDS - 1])
            of.append(i)
        held += len(t or "")
        if held > most_bytes:
            hashed()
            parts, of, held = [], [], 0
    hashed()
    return [np.unique(np.concatenate(s) if len(s) > 1 else s[0]) if s else np.empty(0, np.uint64) for s in sets]


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row each."""
    h = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((REGISTERS, len(sets)), np.uint64)
    for i in range(REGISTERS):
        v = h * _MUL[i]
        v += _ADD[i]
        least[i] = np.minimum.reduceat(v, starts)
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 + OFFSET - np.log(x) / math.log(BASE)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimated(up: np.ndarray, down: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity, given how many registers are larger in the set of n (up) and in that of m (down)."""
    u, v = n / (n + m), m / (n + m)
    c, log_b = (BASE - 1) / BASE, math.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    equal = REGISTERS - up - down

    def slope(j):
        x, y = np.maximum(u - v * j, 0), np.maximum(v - u * j, 0)
        p, q = -np.log1p(-x * c) / log_b, -np.log1p(-y * c) / log_b
        dp, dq = -v * c / (1 - x * c) / log_b, -u * c / (1 - y * c) / log_b
        tiny = 1e-12
        return up * dp / np.maximum(p, tiny) + down * dq / np.maximum(q, tiny) - equal * (dp + dq) / np.maximum(1 - p - q, tiny)

    for _ in range(12):  # the likelihood is concave: halve the interval by the sign of its slope
        middle = (low + high) / 2
        rising = slope(middle) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    return (low + high) / 2


def banding(percent: int) -> tuple[int, int]:
    """Bands, and rows a band, for a threshold; single registers below about 0.08, where 192 of them miss more than MISS."""
    for rows in range(REGISTERS, 0, -1):
        bands = REGISTERS // rows
        if rows == 1 or (1 - (percent / 100) ** rows) ** bands <= MISS:
            return bands, rows


def least_estimate(percent: int) -> float:
    t = percent / 100
    return t - SLACK * math.sqrt(t * (1 - t) / REGISTERS)


def _open(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of registers and set sizes leave a similarity of ``percent`` possible."""
    sizes = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    out = np.zeros(len(a), bool)
    at = np.flatnonzero(sizes)
    if len(at):
        up, down = (a[at] > b[at]).sum(1), (a[at] < b[at]).sum(1)
        out[at] = estimated(up, down, n[at].astype(float), m[at].astype(float)) >= least_estimate(percent)
    return out


def _sketch(batches):
    for batch in text_slices(batches, 1 << 18):
        sets = shingle_sets(batch.column("text").to_pylist())
        n = np.array([len(s) for s in sets])
        full = [s for s in sets if len(s)]
        registers, digest = [None] * len(sets), [b""] * len(sets)
        if full:
            found = iter(registers_of(full))
            for i, s in enumerate(sets):
                if len(s):
                    registers[i] = next(found).tobytes()
                    digest[i] = mix(s, 0x94D049BB133111EB).sum(dtype=np.uint64).tobytes() + mix(s, 0xD6E8FEB86659FD93).sum(dtype=np.uint64).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "n", "digest", "registers"])


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), digest and registers of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return staging.small_batches(docs.select("doc_id", "text")).mapInArrow(_sketch, f"doc_id {kind}, n long, digest binary, registers binary")


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), REGISTERS)


def _within_reach(batches, percent: int):
    for batch in batches:
        if batch.num_rows:
            keep = _open(_rows(batch.column("ra")), _rows(batch.column("rb")), np.asarray(batch.column("na")), np.asarray(batch.column("nb")), percent)
            yield batch.filter(pa.array(keep)).select(["a", "b"])


def _verify(table, percent: int):
    """Links of one group: its pivots' texts (role 0) with its partners' (role 1)."""
    sets = shingle_sets(table.column("text").to_pylist())
    ids, role = table.column("id").to_pylist(), table.column("role").to_pylist()
    pivot = next((s for s, r in zip(sets, role) if r == 0), None)
    u, v = [], []
    for i, s, r in zip(ids, sets, role):
        if r == 1 and pivot is not None:
            both = len(np.intersect1d(pivot, s, assume_unique=True))
            if 100 * both >= percent * (len(pivot) + len(s) - both):
                u.append(i)
                v.append(table.column("a")[0].as_py())
    kind = table.schema.field("id").type
    return pa.table({"u": pa.array(u, kind), "v": pa.array(v, kind)})


def verified(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar enough, as (u, v). ``texts``: id, text."""
    kind = texts.schema["id"].dataType.simpleString()
    partners = pairs.groupBy("a").count()
    dealt = pairs.join(partners, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / CHUNK)).alias("chunk"))
    attend = dealt.select(F.col("b").alias("id"), "a", "chunk", F.lit(1).alias("role")).unionByName(
        dealt.select(F.col("a").alias("id"), "a", "chunk", F.lit(0).alias("role")).distinct()
    )
    return texts.join(attend, "id").groupBy("a", "chunk").applyInArrow(lambda rows: _verify(rows, percent), f"u {kind}, v {kind}")


class _Block:
    """One block: its members (role 0) and those outside the pivot's component (role 1), who meet them."""

    def __init__(self, table, percent: int):
        role = np.asarray(table.column("role"))
        self.members, self.outside = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        self.registers, self.n = _rows(table.column("registers").combine_chunks()), np.asarray(table.column("n"))
        self.ids, self.component = np.asarray(table.column("rep")), np.asarray(table.column("component"))
        self.away, self.band, self.percent = np.asarray(table.column("outside")), table.column("band")[0].as_py(), percent

    def open_with(self, i: int, component: np.ndarray) -> np.ndarray:
        """Members of other components than i's whose pairs with i belong to this band and are open."""
        n, m, other = self.n, self.n[i], self.members[component[self.members] != component[i]]
        # a pair of two outsiders comes up twice: keep it where the smaller one is the outsider
        other = other[~self.away[other] | (self.ids[other] > self.ids[i])]
        other = other[100 * np.minimum(n[other], m) >= self.percent * np.maximum(n[other], m)]
        if not len(other):
            return other
        bands, rows = banding(self.percent)
        same = (self.registers[other] == self.registers[i])[:, : bands * rows].reshape(len(other), bands, rows).all(2)
        other = other[same.argmax(1) == self.band]  # the first band that a pair shares
        one = np.broadcast_to(self.registers[i], (len(other), REGISTERS))
        return other[_open(self.registers[other], one, n[other], np.broadcast_to(m, len(other)), self.percent)] if len(other) else other


def _still_open(table, percent: int):
    """The rows of a block that have an open pair."""
    block, stays = _Block(table, percent), np.zeros(table.num_rows, bool)
    for i in block.outside:
        other = block.open_with(i, block.component)
        stays[other] = True
        stays[i] |= len(other) > 0
    return table.filter(pa.array(stays))


def _block_links(table, percent: int):
    """Verified links of a block with texts: enough to connect whatever its open pairs connect."""
    block = _Block(table, percent)
    sets = shingle_sets(table.column("text").to_pylist())
    size, values = np.array([len(s) for s in sets]), np.concatenate(sets)
    values = np.unique(values, return_inverse=True)[1]  # a small number for each shingle
    start = np.cumsum(size) - size
    component, marked = block.component.copy(), np.zeros(int(values.max(initial=0)) + 1, np.int64)
    u, v = [], []
    for i in block.outside:
        other = block.open_with(i, component)
        if not len(other):
            continue
        own = values[start[i] : start[i] + size[i]]
        marked[own] = 1
        for part in np.array_split(other, -(-int(size[other].sum()) // (1 << 22)) or 1):
            flat = np.concatenate([values[start[j] : start[j] + size[j]] for j in part]) if len(part) else own[:0]
            both = np.add.reduceat(marked[flat], np.cumsum(size[part]) - size[part]) if len(part) else part
            linked = part[100 * both >= percent * (size[part] + size[i] - both)]
            for j in linked:
                if component[j] != component[i]:
                    u.append(block.ids[i])
                    v.append(block.ids[j])
                    component[component == component[j]] = component[i]
        marked[own] = 0
    kind = table.schema.field("rep").type
    return pa.table({"u": pa.array(u, kind), "v": pa.array(v, kind)})


def _placed(members: DataFrame, pivots: DataFrame, component: DataFrame) -> DataFrame:
    """Members with their bucket's pivot, their component, and whether that is another one than the pivot's."""
    named = members.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    of_pivot = pivots.join(component.select(F.col("rep").alias("pivot"), F.col("component").alias("of_pivot")), "pivot", "left")
    of_pivot = of_pivot.select("band", "key", "pivot", F.coalesce("of_pivot", "pivot").alias("of_pivot"))
    return named.join(of_pivot, ["band", "key"]).withColumn("outside", F.col("component") != F.col("of_pivot"))


def _rest(placed: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between different components that share a bucket."""
    kind = classes.schema["rep"].dataType.simpleString()
    placed = placed.join(placed.where("outside").select("band", "key").distinct(), ["band", "key"])  # the others are connected
    placed = placed.join(classes.select("rep", "n", "registers"), "rep").select("band", "key", "rep", "component", "outside", "n", "registers")
    blocks = lambda rows, words: F.ceil(F.greatest(rows / BLOCK, words / BLOCK_SHINGLES))
    out = lambda c: F.sum(F.when(F.col("outside"), c))
    counts = placed.groupBy("band", "key").agg(blocks(out(F.lit(1)), out(F.col("n"))).alias("outs"), blocks(F.count(F.lit(1)), F.sum("n")).alias("ins"))
    placed = placed.join(counts, ["band", "key"])
    share = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = placed.select("*", F.lit(0).alias("role"), share("ins").alias("x"), every("outs").alias("y")).unionByName(
        placed.where("outside").select("*", F.lit(1).alias("role"), share("outs").alias("y"), every("ins").alias("x"))
    )
    rows = rows.drop("ins", "outs")
    open_ = rows.groupBy("band", "key", "x", "y").applyInArrow(lambda t: _still_open(t, percent), rows.schema)
    open_ = staging.staged(open_, "open")
    with_texts = texts.withColumnRenamed("id", "rep").join(open_, "rep")
    return with_texts.groupBy("band", "key", "x", "y").applyInArrow(lambda t: _block_links(t, percent), f"u {kind}, v {kind}")


def links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Verified links (u, v) between class names: enough of them to connect whatever is connected."""
    kind = classes.schema["rep"].dataType.simpleString()
    bands, rows = banding(percent)
    key = F.expr(f"transform(sequence(0, {bands - 1}), i -> substring(registers, i * {rows} + 1, {rows}))")
    banded = classes.select("rep", F.posexplode(key).alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = staging.staged(banded.join(buckets, ["band", "key"]), "members")
    texts = staging.staged(staging.only(docs.select("doc_id", "text"), members.select("rep").distinct()).withColumnRenamed("doc_id", "id"), "texts")
    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    first = F.max(F.struct("company", (-F.col("rep")).alias("rep")))
    pivots = members.join(company, "rep").groupBy("band", "key").agg(first.alias("first"))
    pivots = staging.staged(pivots.select("band", "key", (-F.col("first.rep")).alias("pivot"), "first.company"), "pivots")
    known = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias("n" + x), F.col("registers").alias("r" + x))

    def tried(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Pairs that the registers leave open, and the links among them."""
        near = pairs.join(known("b"), "b").join(known("a"), "a").mapInArrow(lambda batches: _within_reach(batches, percent), f"a {kind}, b {kind}")
        near = staging.staged(near, name)
        return near, staging.staged(verified(texts, near, percent), f"{name}-links")

    def connected(found: DataFrame) -> DataFrame:
        return staging.staged(graph.components(found).select(F.col("node").alias("rep"), "component"), "connected")

    one = members.join(pivots, ["band", "key"]).where("rep <> pivot").groupBy("rep").agg(F.max(F.struct("company", (-F.col("pivot")).alias("pivot"))).alias("best"))
    seen, found = tried(one.select((-F.col("best.pivot")).alias("a"), F.col("rep").alias("b")), "stars")
    away = _placed(members, pivots, connected(found)).where("outside").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    _, more = tried(away.join(seen, ["a", "b"], "left_anti"), "other-stars")
    found = found.unionByName(more)
    placed = staging.staged(_placed(members.where("size > 2"), pivots, connected(found)), "placed")
    return found.unionByName(staging.staged(_rest(placed, classes, texts, percent), "rest-links"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. doc_id must be an integer."""
    with staging.scratch() as kept:
        return _near_duplicates(docs, percent, kept)


def _near_duplicates(docs: DataFrame, percent: int, kept: list) -> DataFrame:
    sketches = staging.staged(sketched(docs), "sketches", kept)
    usable = sketches.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = usable.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.min("registers").alias("registers"))
    classes = staging.staged(classes, "classes", kept)
    component = staging.staged(graph.components(links(docs, classes, percent)).withColumnRenamed("node", "rep"), "components", kept)
    named = classes.select("digest", "n", "rep").join(component, "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component_id"))
    return (
        sketches.select("doc_id", "n", "digest")
        .join(named, ["digest", "n"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def keep_representatives(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that stand for their components, with all their columns."""
    return staging.without(docs, near_duplicates(docs, percent).where(~F.col("kept")))


def op9_setsketch_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(staging.table(spark, sf_dir, "documents"), percent=85)
