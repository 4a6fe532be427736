"""How the sources of a language differ in their words: term frequencies by single-pass in-memory indexing.

1. Blocks: a task adds its documents to in-memory postings until ``BLOCK_TOKENS`` or
   ``BLOCK_TERMS`` are held, then spills them as runs sorted by term: one per hash shard
   of the terms, cut into chunks.
2. Merge: the chunks of a shard arrive sorted by their first term; a heap merges the terms of the
   open ones, and their postings are added up. Only terms in enough documents leave. The
   result, the index, is stored sorted by term.
3. Corrections: two groups' divergence over all V terms is V times the value of a term that
   neither has, corrected for the terms that one has (by how many terms have each
   count: a small table) and for the terms that both have (streamed term by term, one partial
   sum per task and pair).

All arithmetic is on integers; sums that could pass 64 bits are decimals.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import Decimal
from itertools import count, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.llm.common import pick, read, written

ONE = 1_000_000_000
MIN_DOCS, TOP_TERMS = 3, 200
#: Tokens and different terms that a block holds before it is spilled, postings of a chunk of a run, and
#: postings that a merge takes at once.
BLOCK_TOKENS, BLOCK_TERMS, CHUNK_POSTINGS, MERGED_POSTINGS = 4_000_000, 400_000, 10_000, 300_000
#: Pairs of groups that are compared, and partial sums that are held, at once.
PAIRS, HELD_SUMS = 2_000_000, 500_000
#: A-Z to a-z; every other byte below 0x80 separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a whole text: runs of ASCII letters, lower-cased, and of other characters above 0x7F."""
    return text.encode().translate(_FOLD).split()


#: A chunk of a run: terms in order with their documents and how many postings each has, and per posting a place in
#: ``sources`` and the occurrences (little-endian numbers).
_CHUNK = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("terms", pa.list_(pa.binary())), ("sources", pa.list_(pa.string())),
                    ("docs", pa.binary()), ("sizes", pa.binary()), ("which", pa.binary()), ("counts", pa.binary())])
_CHUNK_DDL = "shard int, lang string, first binary, terms array<binary>, sources array<string>, docs binary, sizes binary, which binary, counts binary"


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], *[np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values]


class _Block:
    """Postings of some documents in memory: a dictionary of terms, and the texts as its numbers."""

    def __init__(self):
        self.terms: dict[bytes, int] = defaultdict(count().__next__)
        self.groups: dict[tuple[str, str], int] = defaultdict(count().__next__)
        self.texts: list[np.ndarray] = []
        self.group_of: list[int] = []
        self.tokens = 0

    def add(self, lang: str, source: str, text: str) -> None:
        found = terms(text)
        self.texts.append(np.fromiter(map(self.terms.__getitem__, found), np.int32, len(found)))
        self.group_of.append(self.groups[lang, source])
        self.tokens += len(found)

    def full(self) -> bool:
        return self.tokens >= BLOCK_TOKENS or len(self.terms) >= BLOCK_TERMS

    def runs(self, shards: int) -> Iterator[pa.RecordBatch]:
        if not self.tokens:
            return
        lengths = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        keys = np.repeat(np.arange(len(lengths)), lengths) << 32 | np.concatenate(self.texts)
        keys, counts = _summed(keys, np.ones(len(keys), np.int64))  # one row per document and term
        names = sorted(self.terms)
        rank = np.zeros(len(names), np.int64)
        rank[[self.terms[t] for t in names]] = np.arange(len(names))
        group = np.array(self.group_of, np.int64)[keys >> 32]
        keys, counts, docs = _summed(group << 32 | rank[keys & 0xFFFFFFFF], counts, np.ones(len(keys), np.int64))
        shard_of = np.fromiter((zlib.crc32(t) % shards for t in names), np.int64, len(names))
        group, term = keys >> 32, keys & 0xFFFFFFFF
        by_lang: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for (lang, source), number in self.groups.items():
            by_lang[lang].append((source, number))
        for lang, own in by_lang.items():
            place = np.full(len(self.groups), -1, np.int64)
            place[[number for _, number in own]] = np.arange(len(own))
            at = np.flatnonzero(place[group] >= 0)
            at = at[np.lexsort((term[at], shard_of[term[at]]))]
            yield from _chunks(lang, [s for s, _ in own], names, shard_of, term[at], place[group[at]], counts[at], docs[at])


def _chunks(lang: str, sources: list[str], names: list[bytes], shard_of: np.ndarray, term: np.ndarray, which: np.ndarray,
            counts: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One batch per chunk of postings that are sorted by shard and term."""
    if not len(term):
        return
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    sizes = np.diff(np.append(starts, len(term)))
    firsts, with_docs = term[starts], np.add.reduceat(docs, starts)
    chunk = np.cumsum(sizes) // CHUNK_POSTINGS + shard_of[firsts] * (len(term) // CHUNK_POSTINGS + 2)
    for a, b in pairwise([*np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])).tolist(), len(starts)]):
        lo, hi = starts[a], starts[b] if b < len(starts) else len(term)
        row = [int(shard_of[firsts[a]]), lang, names[firsts[a]], [names[t] for t in firsts[a:b].tolist()], sources,
               with_docs[a:b].astype("<i8").tobytes(), sizes[a:b].astype("<i4").tobytes(), which[lo:hi].astype("<i4").tobytes(), counts[lo:hi].astype("<i8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _CHUNK)], schema=_CHUNK)


def _runs(docs: DataFrame, shards: int) -> DataFrame:
    """Term-sorted runs of postings of ``docs`` (lang, source, text), cut into chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64)
                for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    block.add(lang, source, text)
                    if block.full():
                        yield from block.runs(shards)
                        block = _Block()
        yield from block.runs(shards)

    return docs.select("lang", "source", "text").mapInArrow(run, _CHUNK_DDL)


class _Open:
    """A chunk during the merge: what of it is still to come."""

    def __init__(self, row: dict):
        self.terms, self.sources, self.at = row["terms"], row["sources"], 0
        self.docs, self.sizes = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["sizes"], "<i4")
        self.which, self.counts = np.frombuffer(row["which"], "<i4"), np.frombuffer(row["counts"], "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])


def merged_runs(chunks: Iterator[dict], min_docs: int) -> Iterator[tuple[str, list[bytes], list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Heap merge of chunks that come sorted by (lang, first term).

    Yields (lang, terms, sources, term, source, occurrences): the last three per posting, numbers
    of the terms, ascending, and of the sources. Terms before the first term of the next
    chunk are complete: their postings are merged as soon as enough of them are open.
    """
    opened: list[_Open] = []
    lang, held = None, 0
    pending = next(chunks, None)
    while pending or opened:
        if pending and (not opened or (pending["lang"] == lang and held < MERGED_POSTINGS)):
            lang = pending["lang"]
            opened.append(_Open(pending))
            held += len(opened[-1].which)
            pending = next(chunks, None)
            continue
        bound = pending["first"] if pending and pending["lang"] == lang else None
        parts = [(c, c.at, len(c.terms) if bound is None else bisect_left(c.terms, bound, c.at)) for c in opened]
        parts = [p for p in parts if p[1] < p[2]]
        if not parts:  # all that is open begins with the next chunk's first term
            opened.append(_Open(pending))
            held += len(opened[-1].which)
            pending = next(chunks, None)
            continue
        yield lang, *_merge(parts, min_docs)
        for c, _, b in parts:
            held -= int(c.starts[b] - c.starts[c.at])
            c.at = b
        opened = [c for c in opened if c.at < len(c.terms)]


def _merge(parts: list[tuple[_Open, int, int]], min_docs: int) -> tuple[list[bytes], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The postings of the named places of chunks, terms in heap order, those of terms in enough documents."""
    known: dict[str, int] = defaultdict(count().__next__)
    names: list[bytes] = []
    number = [np.zeros(b - a, np.int64) for _, a, b in parts]
    for term, i, k in heapq.merge(*[zip(c.terms[a:b], repeat(i), range(b - a)) for i, (c, a, b) in enumerate(parts)]):
        if not names or names[-1] != term:
            names.append(term)
        number[i][k] = len(names) - 1
    docs = np.zeros(len(names), np.int64)
    keys, counts = [], []
    for (c, a, b), own in zip(parts, number):
        docs[own] += c.docs[a:b]  # a chunk has a term once
        sources = np.array([known[s] for s in c.sources], np.int64)
        lo, hi = c.starts[a], c.starts[b]
        keys.append(np.repeat(own, c.sizes[a:b]) << 32 | sources[c.which[lo:hi]])
        counts.append(c.counts[lo:hi])
    keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
    kept = docs[keys >> 32] >= min_docs
    keys = keys[kept]
    return names, list(known), keys >> 32, keys & 0xFFFFFFFF, counts[kept]


_INDEX_DDL = "lang string, term string, source string, n bigint, lang_n bigint, new int"


def index(docs: DataFrame, min_docs: int = MIN_DOCS, shards: int | None = None) -> DataFrame:
    """One row per kept term and group that has it: ``lang``, ``term``, ``source``, ``n``, ``lang_n``; ``new`` is 1
    once per term. Rows of a term follow each other in one file. Stored.

    ``docs`` has ``lang``, ``source`` and ``text`` without nulls. ``shards``: hash shards of the terms, by default as many as shuffle partitions.
    """
    if shards is None:
        shards = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = _runs(docs, shards)
    dealt = runs.repartition(shards, "shard").sortWithinPartitions("shard", "lang", "first")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(batch.num_rows):
                    yield batch.slice(at, 1).to_pylist()[0]

        def by_shard(stream):
            """The chunks of one shard after the other: a task may hold several shards."""
            pending = next(stream, None)
            while pending:
                shard, held = pending["shard"], pending

                def own():
                    nonlocal held
                    while held and held["shard"] == shard:
                        chunk, held = held, next(stream, None)
                        yield chunk

                yield own()
                pending = held

        for chunks in by_shard(rows()):
            for lang, names, sources, term, source, n in merged_runs(chunks, min_docs):
                if not len(term):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                new = np.zeros(len(term), np.int32)
                new[starts] = 1
                everywhere = np.repeat(np.add.reduceat(n, starts), np.diff(np.append(starts, len(term))))
                words = pa.array([t.decode() for t in names])
                for a in range(0, len(term), 50_000):
                    own = slice(a, a + 50_000)
                    size = len(term[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * size, pa.string()), words.take(pa.array(term[own])), pa.array(sources, pa.string()).take(pa.array(source[own])),
                         pa.array(n[own]), pa.array(everywhere[own]), pa.array(new[own])], names=["lang", "term", "source", "n", "lang_n", "new"])

    return written(dealt.mapInArrow(merge, _INDEX_DDL), "index")


def _share(count: str, total: str, kept: str = "kept") -> str:
    """SQL: 1 + floor(1e9 (count + 1) / (total + kept)), exact for any counts."""
    return f"1 + (cast({ONE} as decimal(20,0)) * ({count} + 1)) div cast({total} + {kept} as decimal(20,0))"


def _value(p: str, q: str) -> str:
    """SQL: floor((p - q)^2 / q); |p - q| is at most 1e9, so the square fits a bigint."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
               min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Divergence of the sources of each language, in pairs and by term.

    Rows ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: part ``pair`` has every other
    source of the language, part ``term`` the group's first ``top_terms`` terms that are more frequent in
    it than in the language. Each language keeps the terms in at least ``min_docs`` of its documents.
    Null language, source or text is the empty string; a language with one source has no pair;
    groups without any term still have pairs (value 0 if the language keeps no term). Repeated rows
    count as documents; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    own = pick(docs, lang=lang_col, source=source_col, text=text_col)
    own = own.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms_of = index(own, min_docs)
    kept = terms_of.groupBy("lang").agg(F.sum("new").alias("kept"))
    totals = terms_of.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
              .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")))
    groups = written(groups.withColumn("p0", F.expr(f"if(kept = 0, 0, {_share('0', 'total')})")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))

    shared = terms_of.join(groups, ["lang", "source"]).join(langs, "lang")
    shared = shared.select("lang", "source", "term", "p0", F.expr(_share("n", "total")).alias("p"), F.expr(_share("lang_n", "lang_total")).alias("q"))
    scored = shared.where("p > q").withColumnRenamed("term", "item")
    terms_part = scored.select("lang", "source", F.lit("term").alias("part"), "item", F.expr(_value("p", "q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms_part = terms_part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    pairs = groups.select("lang", "source", "kept", F.col("total").alias("total_g"), F.col("p0").alias("g0")).join(
        groups.select("lang", F.col("source").alias("item"), F.col("total").alias("total_h"), F.col("p0").alias("h0")), "lang").where("source <> item")
    # terms by group and count: as many rows as the group has different counts
    counts = written(terms_of.groupBy("lang", "source", "n").agg(F.count("*").alias("many")), "counts")
    g, h = _share("n", "total_g"), _share("n", "total_h")
    of_g = pairs.join(counts, ["lang", "source"]).select("lang", "source", "item", F.expr(f"cast({_value(g, 'h0')} - {_value('g0', 'h0')} as decimal(20,0)) * many").alias("d"))
    of_h = pairs.join(counts.withColumnRenamed("source", "item"), ["lang", "item"]).select(
        "lang", "source", "item", F.expr(f"cast({_value('g0', h)} - {_value('g0', 'h0')} as decimal(20,0)) * many").alias("d"))
    of_both = _common(shared)
    corrected = of_g.unionByName(of_h).unionByName(of_both).groupBy("lang", "source", "item").agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d"))
    value = F.expr(f"cast(if(kept = 0, 0, cast(kept as decimal(20,0)) * ({_value('g0', 'h0')}) + coalesce(d, 0)) as bigint)")
    pairs_part = pairs.select("lang", "source", "item", "kept", "g0", "h0").join(corrected, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs_part = pairs_part.withColumn("rank", F.row_number().over(order))
    return pairs_part.unionByName(terms_part)


def _common(shared: DataFrame) -> DataFrame:
    """Corrections for terms that both groups of a pair have: partial sums (lang, source, item, d).

    ``shared``: the index with each group's share ``p`` of the term and ``p0`` of a term
    that it lacks. A task reads it term by term and holds one sum per pair of groups;
    a full table is passed on as partial sums, so what leaves a task follows the pairs, not the terms.
    """

    def corrections(sizes: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (number of one source, of another) and sums over some terms; ``sizes``: postings of each."""
        ends = np.cumsum(sizes)
        last = np.repeat(ends, sizes)
        width = np.repeat(sizes, sizes)
        one = np.repeat(np.arange(len(source)), width)
        other = np.arange(len(one)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(last - width, width)
        one, other = one[one != other], other[one != other]
        x, x0, y, y0 = p[one], p0[one], p[other], p0[other]
        d = (x - y) ** 2 // y - (x - y0) ** 2 // y0 - (x0 - y) ** 2 // y + (x0 - y0) ** 2 // y0
        return _summed(source[one] << 32 | source[other], d)

    def flush(sums: dict) -> Iterator[pa.RecordBatch]:
        rows = [(*k, Decimal(v)) for k, v in sums.items()]
        kinds = [pa.string(), pa.string(), pa.string(), pa.decimal128(38, 0)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lang", "source", "item", "d"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def terms_of() -> Iterator[tuple[str, list, np.ndarray, np.ndarray]]:
            """Whole terms, one after the other: language, sources, p, p0. A term's rows may lie in two batches."""
            held, now = [], None
            for batch in batches:
                lang, term, source = (batch.column(i).to_pylist() for i in range(3))
                p, p0 = (batch.column(i).to_numpy() for i in (3, 4))
                bounds = [i for i in range(len(term)) if i == 0 or term[i] != term[i - 1] or lang[i] != lang[i - 1]] + [len(term)]
                for a, b in pairwise(bounds):
                    if held and (lang[a], term[a]) != now:
                        yield now[0], *held
                        held = []
                    now = (lang[a], term[a])
                    held = [held[0] + source[a:b], np.append(held[1], p[a:b]), np.append(held[2], p0[a:b])] if held else [source[a:b], p[a:b], p0[a:b]]
            if held:
                yield now[0], *held

        sums: Counter = Counter()
        numbers: dict[str, int] = defaultdict(count().__next__)
        taken: list[tuple] = []
        pairs, lang = 0, None

        def close() -> None:
            sizes = np.array([len(t[0]) for t in taken], np.int64)
            source = np.fromiter((numbers[s] for t in taken for s in t[0]), np.int64, int(sizes.sum()))
            names = list(numbers)
            keys, d = corrections(sizes, source, np.concatenate([t[1] for t in taken]), np.concatenate([t[2] for t in taken]))
            for k, v in zip(keys.tolist(), d.tolist()):
                sums[lang, names[k >> 32], names[k & 0xFFFFFFFF]] += v

        for own, source, p, p0 in terms_of():
            if taken and (own != lang or pairs + len(source) ** 2 > PAIRS):
                close()
                taken, pairs = [], 0
                if len(sums) >= HELD_SUMS:
                    yield from flush(sums)
                    sums = Counter()
            lang = own
            if len(source) > 1:
                taken.append((source, p, p0))
                pairs += len(source) ** 2
        if taken:
            close()
        yield from flush(sums)

    dealt = shared.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(stream, "lang string, source string, item string, d decimal(38,0)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same for DuckDB: every group against every kept term of its language."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
each AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM each GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
many AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
freq AS (SELECT lang, source, term, count(*) AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM freq f WHERE f.lang = d.lang AND f.source = d.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) d),
share AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + ({ONE}::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p,
         1 + ({ONE}::HUGEINT * (lang_n + 1)) // (lang_total + v) AS q
  FROM groups JOIN kept USING (lang) JOIN many USING (lang) LEFT JOIN freq USING (lang, source, term)),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM share WHERE n > 0 AND p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {TOP_TERMS}),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)"""
