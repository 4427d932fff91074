"""Jaccard join on word n-grams by vertical partitioning, and the classes that its links make.

A document is the set of its distinct word n-grams. All n-grams stand in one global order, from
rare to frequent, cut into fragments of about equal mass; a document is cut where the order is.
Partial overlaps of a candidate pair are counted fragment by fragment, separately, and summed
for the pair, so no row ever holds more than a fragment of a document.

* **Order.** Frequencies come from a count sketch over all documents, of a fixed size whatever
  the table. It only has to be the same for all: an n-gram that it overestimates comes later in
  the order, and results don't change.
* **Candidates.** Two sets of Jaccard at least t share ``w`` n-grams among the first
  ``n - ceil(t n) + w`` of each. Documents are posted under these, where frequent passages
  hardly ever occur, and compared only if they share w of them and sizes and positions allow
  enough overlap; w goes from 1 to 3 with the size (``witnesses``).
* **Copies.** Documents of equal sets are one vertex, named by half of a 128-bit digest of the set,
  or by the other half where sets that differ agree in the first. Under each n-gram, members are first
  compared with one leader, and only members of different classes need any further comparison,
  so a group of near copies costs about its size and not its square. After the leader rounds
  every remaining pair of members of different classes is compared. Hence no link that would
  join two classes is missed, and the classes are exact.

Sets are held as 64-bit hashes of n-grams. What is written on the way is deleted at the end; what
is returned is a written table of a few columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, fleeting_shuffles, give_back, stash
from .graph import components

#: Counters of the sketch (a fixed 2^22) and the parts it is summed in.
SKETCH_BITS, SKETCH_PARTS = 22, 64
#: Bits of the bitmaps that keep rows without partners out of shuffles (fixed; a full bitmap
#: keeps out less, and changes no result).
BITMAP_BITS = 24
FRAGMENTS = 8
#: Words whose hashes a task remembers.
MEMO_WORDS = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], dtype=np.uint64)


def witnesses(n: str) -> str:
    """SQL: how many n-grams of their prefixes a pair must share, for a set of n. For a pair it is
    that of the smaller set."""
    return f"(1 + least(2, {n} div 60))"


class _Memo(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= _ODD[5]
    h ^= h >> np.uint64(29)
    h *= _ODD[6]
    h ^= h >> np.uint64(32)
    return h


def shingle_sets(texts: list[str | None], q: int, memo: dict) -> Iterator[np.ndarray]:
    """For each text its set of distinct q-word n-grams as sorted hashes. Words are what stands
    between ASCII white space, A-Z in lower case; a text of fewer words is one n-gram; null and
    wordless texts are empty."""
    odd = np.resize(_ODD, max(q, 2)) + np.arange(max(q, 2), dtype=np.uint64) * np.uint64(2)
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        n = len(words)
        if not n:
            yield np.empty(0, np.uint64)
            continue
        w = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
        if n < q:
            yield _mix((w * odd[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
            continue
        h = w[: n - q + 1] * odd[0]
        for i in range(1, q):
            h += w[i : n - q + 1 + i] * odd[i]
        yield np.unique(_mix(h))


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def frequency_levels(docs: DataFrame, text_col: str, q: int) -> np.ndarray:
    """A level (0 to 255) for each counter of the sketch: eight steps for each doubling of the
    number of documents counted there. 4 MB come to the driver, whatever the table."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = _Memo(), np.zeros(size, np.uint32)
        shift, seen = np.uint64(64 - SKETCH_BITS), False
        for b in _slices(batches):
            for s in shingle_sets(_column(b, text_col), q, memo):
                if len(s):
                    np.add.at(total, (s >> shift).astype(np.int64), 1)
                    seen = True
        if seen:
            for i, p in enumerate(total.reshape(SKETCH_PARTS, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.minimum(p, 65535).astype("<u2").tobytes()], pa.binary())], ["part", "counts"])
        memo.clear()
        total = p = None
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = np.frombuffer(raw.as_buffer(), "<u2")
                sums[part] = sums[part] + got if part in sums else got.astype(np.uint64)
        if sums:
            levels = [np.minimum(255, np.floor(8 * np.log2(v + 1.0))).astype(np.uint8).tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    counted = docs.select(text_col).mapInArrow(count, "part int, counts binary").repartition(SKETCH_PARTS // 4, "part")
    out = np.zeros((SKETCH_PARTS, size // SKETCH_PARTS), np.uint8)
    with fleeting_shuffles(docs.sparkSession):
        summed = counted.mapInArrow(add, "part int, levels binary").collect()
    for row in summed:
        out[row["part"]] = np.frombuffer(row["levels"], np.uint8)
    return out.reshape(-1)


def fragment_starts(levels: np.ndarray) -> np.ndarray:
    """For each level the share of the order's mass before it, and the share of the level: with
    these, a place in the global order becomes a number from 0 to 1."""
    mass = np.bincount(levels, minlength=256) * (2.0 ** (np.arange(256) / 8))
    share = mass / max(mass.sum(), 1e-9)
    return np.stack([np.cumsum(share) - share, share])


def _halves(digests: list[bytes]) -> np.ndarray:
    """The halves of 128-bit digests, as two rows of integers."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T.copy()


def signatures(docs: DataFrame, text_col: str, q: int, num: int, den: int, levels) -> DataFrame:
    """The other columns of ``docs`` and ``n, v, w, prefix``: the size of the set, the halves of a
    128-bit digest of it, and the n-grams that begin it in the global order."""
    own = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo, level = _Memo(), levels.value
        shift = np.uint64(64 - SKETCH_BITS)
        for b in _slices(batches):
            sizes, digests, firsts = [], [], []
            for s in shingle_sets(_column(b, text_col), q, memo):
                n = len(s)
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                take = min(n, n - -(-num * n // den) + 1 + min(2, n // 60)) if n else 0
                rank = (level[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                firsts.append(s[np.argsort(rank, kind="stable")[:take]].view(np.int64))
            offsets = np.cumsum([0, *map(len, firsts)])
            prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(firsts)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in own), pa.array(sizes, pa.int64()), *(pa.array(x) for x in _halves(digests)), prefix], [*(f.name for f in own), "n", "v", "w", "prefix"])
        memo.clear()
        give_back()

    added = T._parse_datatype_string("n long, v long, w long, prefix array<long>")
    return docs.mapInArrow(run, T.StructType([*own, *added.fields]))


def _bitmap(df: DataFrame, key: str) -> DataFrame:
    """``word, bits``: which hashes of ``key`` occur; 2^18 rows at most, so it can be broadcast."""
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << BITMAP_BITS))
    return df.select(F.shiftright(h, 6).cast("int").alias("word"), (h % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def _in_bitmap(df: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << BITMAP_BITS))
    at = df.withColumn("_word", F.shiftright(h, 6).cast("int")).withColumn("_bit", (h % 64).cast("int"))
    met = at.join(F.broadcast(bitmap.select(F.col("word").alias("_word"), "bits")), "_word")
    return met.filter(F.expr("(shiftright(bits, _bit) & 1) = 1")).select(*df.columns)


def split_by_keys(df: DataFrame, key: str, keys: DataFrame, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two parts of ``df``: rows whose ``key`` is surely not among ``keys`` (column of that name),
    and the rest, which has all rows whose key is and some others. Neither is shuffled."""
    bitmap = stash(_bitmap(keys, key), "keys", paths)
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << BITMAP_BITS))
    at = df.withColumn("_word", F.shiftright(h, 6).cast("int")).withColumn("_bit", (h % 64).cast("int"))
    met = at.join(F.broadcast(bitmap.select(F.col("word").alias("_word"), "bits")), "_word", "left")
    hit = F.expr("coalesce(shiftright(bits, _bit) & 1, 0) = 1")
    return met.filter(~hit).select(*df.columns), met.filter(hit).select(*df.columns)


class Join:
    """A join over one table; see ``jaccard_classes``. ``k``, a hash of id and text, names a row when
    its text is to be read again; rows that share it by chance are read in vain."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, q: int, num: int, den: int, carry: list[str]) -> None:
        kept = [F.col(c).alias(f"c_{c}") for c in carry]
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), *kept, F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("k"))
        self.q, self.num, self.den = q, num, den
        self.paths: list[str] = []
        bounded_batches(docs.sparkSession)
        sc = docs.sparkSession.sparkContext
        levels = frequency_levels(self.docs, "text", q)
        self.levels, self.starts = sc.broadcast(levels), sc.broadcast(fragment_starts(levels))
        raw = self.stash(signatures(self.docs, "text", q, num, den, self.levels), "signatures")
        self.twins = frozenset()
        self.classes = self._classes(raw)
        # of n sets some n^2 / 2^65 pairs agree in the first half: none, or very few
        twins = [r["v"] for r in self.classes.filter("lo <> hi").select("v").collect()]
        if twins:
            self.twins = frozenset(twins)
            raw = raw.withColumn("v", F.when(F.col("v").isin(twins), F.col("w")).otherwise(F.col("v")))
            self.classes = self._classes(raw)
        self.rows = self.stash(raw.drop("prefix", "k", "w"), "rows")
        self.drop("signatures")
        self.members = self._members()

    def _classes(self, sigs: DataFrame) -> DataFrame:
        """One row a set, with the least id and one row that has it. Copies meet before the shuffle."""
        own = [F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.min("k").alias("k"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.first("prefix").alias("prefix")]
        return self.stash(sigs.filter("n > 0").groupBy("v").agg(*own), "classes")

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        return stash(df, name, self.paths)

    def drop(self, *names: str) -> None:
        """Delete what was written under these names."""
        gone = [p for p in self.paths if p.rsplit("/", 1)[1].rsplit("-", 1)[0] in names]
        self.paths = [p for p in self.paths if p not in gone]
        discard(self.docs.sparkSession, gone)

    def close(self) -> None:
        discard(self.docs.sparkSession, self.paths)
        self.levels.unpersist()
        self.starts.unpersist()

    def _members(self) -> DataFrame:
        """``key, v, n, cap``: postings under n-grams that two or more sets have. cap is the
        largest set that can be linked, if less than w n-grams before this one are common: the
        overlap is then at most w - 1 and what is left of the set. A linked pair x, y meets its
        first w common n-grams with ``y.n <= x.cap`` and ``x.n <= y.cap``. Postings stay out that
        no other of their key can meet so: exactly where a key has two, else by the least n and
        the greatest cap of the key."""
        keys = self.classes.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        shared = self.stash(_bitmap(keys, "key"), "shared")
        cap = F.expr(f"((n - pos + {witnesses('n')} - 1) * {self.num + self.den}) div {self.num} - n").cast("int").alias("cap")
        posts = self.classes.select("v", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "key"))
        kept = _in_bitmap(posts, "key", shared).select("key", "v", "n", cap)
        sums = kept.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n1"), F.max("cap").alias("m1"), F.sum("n").alias("sn"), F.sum("cap").alias("sc")).filter("c > 1")
        met = kept.join(sums, "key").filter("if(c = 2, cap >= sn - n and n <= sc - cap, cap >= n1 and n <= m1)")
        return self.stash(met.select("key", "v", "n", "cap"), "members")

    def segments(self, wanted: DataFrame) -> DataFrame:
        """``v, frag, tokens`` of the sets in ``wanted`` (column v), and of few others. One text of
        each is read again."""
        q, levels, starts, frags, twins = self.q, self.levels, self.starts, FRAGMENTS, self.twins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            memo, level, (before, share) = _Memo(), levels.value, starts.value
            shift = np.uint64(64 - SKETCH_BITS)
            for b in _slices(batches):
                digests, count, which, tokens = [], [], [], []
                for s in shingle_sets(_column(b, "text"), q, memo):
                    lv = level[(s >> shift).astype(np.int64)]
                    place = before[lv] + share[lv] * (s.astype(np.float64) / 2.0**64)
                    frag = np.minimum(frags - 1, (place * frags).astype(np.int64))
                    own = np.unique(frag).tolist()
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    count.append(len(own))
                    which += own
                    tokens += [s[frag == f].view(np.int64) for f in own]
                v, w = _halves(digests)
                if twins:
                    v = np.where(np.isin(v, list(twins)), w, v)
                offsets = np.cumsum([0, *map(len, tokens)])
                flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(v, count)), pa.array(which, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["v", "frag", "tokens"])
            memo.clear()
            give_back()

        rows = self.classes.join(wanted.distinct(), "v", "left_semi")
        texts = _in_bitmap(self.docs.select("text", "k"), "k", self.stash(_bitmap(rows, "k"), "wanted"))
        cut = texts.select("text").mapInArrow(run, "v long, frag int, tokens array<long>")
        return cut.groupBy("v", "frag").agg(F.first("tokens").alias("tokens"))  # equal sets have equal tokens

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b, na, nb`` whose overlap, summed over fragments, makes them linked."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("v"))
        segs = self.stash(self.segments(ends), "segments")
        left = pairs.join(segs.select(F.col("v").alias("a"), "frag", F.col("tokens").alias("ta")), "a")
        both = left.join(segs.select(F.col("v").alias("b"), "frag", F.col("tokens").alias("tb")), ["b", "frag"])
        partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("o"))
        summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
        return summed.filter(F.expr(f"o * {self.num + self.den} >= {self.num} * (na + nb)")).select("a", "b")

    def classes_of(self) -> DataFrame:
        """``v, comp`` of the sets that have links; comp is the least of the class."""
        spark = self.docs.sparkSession
        # not from a local list, for which Python workers of another kind would start and stay
        comps = spark.range(0).select(F.col("id").alias("v"), F.col("id").alias("comp"))
        tried = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
        central = F.max(F.struct("cap", "v", "n", "comp"))
        first = F.min(F.struct("v", "n", "cap", "comp"))
        for leader in (central, first, None):
            m = self.members.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
            pairs = self._all_pairs(m) if leader is None else self._leader_pairs(m, leader)
            pairs = self.stash(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
            if pairs.limit(1).count() == 0:
                continue
            links = self.stash(self.verify(pairs), "links")
            self.drop("segments", "wanted", "live")
            tried = tried.unionByName(pairs.select("a", "b"))
            comps = components(links.unionByName(comps.select(F.col("v").alias("a"), F.col("comp").alias("b"))), self.paths).select(F.col("node").alias("v"), "comp")
        return comps

    def _leader_pairs(self, m: DataFrame, leader: Column) -> DataFrame:
        """For each member the leader with which it shares most n-grams, among the leaders of its
        keys that are of another class and that it may be linked with."""
        lead = m.groupBy("key").agg(leader.alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        met = m.join(lead.select("key", "l"), "key").filter("comp <> l.comp and n <= l.cap and l.n <= cap")
        votes = met.groupBy("v", F.col("l.v").alias("lead"), "n", F.col("l.n").alias("ln")).agg(F.count(F.lit(1)).alias("votes")).filter(f"votes >= {witnesses('least(n, ln)')}")
        best = votes.groupBy("v").agg(F.max(F.struct("votes", "lead", "n", "ln")).alias("l"))
        small = F.least("v", "l.lead")
        own = F.col("v") == small
        return best.select(small.alias("a"), F.greatest("v", "l.lead").alias("b"), F.when(own, F.col("l.n")).otherwise(F.col("l.ln")).alias("na"), F.when(own, F.col("l.ln")).otherwise(F.col("l.n")).alias("nb")).distinct()

    def _all_pairs(self, m: DataFrame) -> DataFrame:
        """All pairs of members of different classes that may be linked under a common n-gram.

        Members go first that no other class of their key can be linked with, judged by the
        smallest size and largest cap among the other classes. Then the sizes of classes meet,
        and only those that hold a pair that may be linked, under as many n-grams as it must
        share, are expanded, against each other. Of a key only sums meet in one task.
        """
        kc = m.groupBy("key", "comp").agg(F.min("n").alias("mn"), F.max("cap").alias("mc"))
        heads = kc.groupBy("key").agg(F.min(F.struct("mn", "comp")).alias("s"), F.max(F.struct("mc", "comp")).alias("g"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        heads = heads.select("key", F.col("s.mn").alias("n1"), F.col("s.comp").alias("c1"), F.col("g.mc").alias("m1"), F.col("g.comp").alias("d1"))
        # the smallest and the largest among classes other than those of the heads
        seconds = kc.join(heads, "key").groupBy("key").agg(F.min(F.expr("if(comp = c1, null, mn)")).alias("n2"), F.max(F.expr("if(comp = d1, null, mc)")).alias("m2"))
        live = m.join(heads.join(seconds, "key"), "key").filter("cap >= if(comp = c1, n2, n1) and n <= if(comp = d1, m2, m1)")
        live = self.stash(live.select("key", "v", "n", "cap", "comp"), "live")
        lc = live.groupBy("key", "comp", "n").agg(F.max("cap").alias("mc"))
        meet = lc.alias("x").join(lc.alias("y"), "key").filter("x.comp < y.comp and x.n <= y.mc and y.n <= x.mc").select("key", F.col("x.comp").alias("cx"), F.col("x.n").alias("nx"), F.col("y.comp").alias("cy"), F.col("y.n").alias("ny"))
        groups = ["cx", "nx", "cy", "ny"]
        often = meet.groupBy(*groups).agg(F.count(F.lit(1)).alias("w")).filter(f"w >= {witnesses('least(nx, ny)')}")
        meet = meet.join(often.select(*groups), groups, "left_semi")
        x = live.select("key", F.col("comp").alias("cx"), F.col("n").alias("nx"), F.struct("v", "n", "cap").alias("x"))
        y = live.select("key", F.col("comp").alias("cy"), F.col("n").alias("ny"), F.struct("v", "n", "cap").alias("y"))
        met = meet.join(x, ["key", "cx", "nx"]).filter("ny <= x.cap").join(y, ["key", "cy", "ny"]).filter("nx <= y.cap")
        flip = F.expr("x.v > y.v")
        pick = lambda f: (F.when(flip, F.col(f"y.{f}")).otherwise(F.col(f"x.{f}")), F.when(flip, F.col(f"x.{f}")).otherwise(F.col(f"y.{f}")))
        (a, b), (na, nb) = pick("v"), pick("n")
        shared = met.select(a.alias("a"), b.alias("b"), na.alias("na"), nb.alias("nb")).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("w"))
        return shared.filter(f"w >= {witnesses('least(na, nb)')}").drop("w")


def jaccard_classes(docs: DataFrame, q: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, class`` for every row: the size of its n-gram set, the
    smallest id that links reach from it, where sets with ``den * |x & y| >= num * |x | y|`` are
    linked, and a number that names its class (null for an empty set). ``carry``: columns of
    ``docs`` that come along under their own names.

    A row stands for its own text: rows that repeat an id with different texts may be in different
    classes, and no link of either is lost; rows that repeat a row give equal rows. Null, empty and
    wordless texts have no n-grams and are linked with nothing. Rows without id take part like
    others; a class of such rows only has a null component_id. An empty table gives no rows. Extra
    columns are left out.
    """
    carry = carry or []
    join = Join(docs, id_col, text_col, q, num, den, carry)
    comps = join.classes_of()
    named = join.classes.join(comps, "v", "left").select("v", "rep", F.coalesce("comp", "v").alias("class"))
    ids = named.groupBy("class").agg(F.min("rep").alias("component_id"))
    out = join.rows.join(named.join(ids, "class").select("v", "component_id", "class"), "v", "left")
    some = F.col("n") > 0
    done = stash(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("class")).alias("class"), *[F.col(f"c_{c}").alias(c) for c in carry]), "ngram-classes")
    join.close()
    return done
