"""Source divergence audit: how the sources of a language differ in their use of terms, after collapsing duplicate texts.

1. Collapse. Identical texts of a language (equal SHA-256) become one text with its multiplicity in each source. Multiplicities are counted on
   digests alone, and one copy of each text is kept by a combining aggregate, so that a text that a third of all rows share travels once per task.
2. Count. Every distinct text is tokenized once; its term counts and its one document count are added times its multiplicity in each
   source. A task adds up its terms in Arrow before they are shuffled.
3. Keep the terms that occur in at least `LEAST_DOCS` documents of their language.
4. Shares. A group's share of a term is p = 1 + floor(SCALE (count + 1) / (N + V)) in whole numbers, by long division in 64 bits.
5. Pairs, sparsely. Over all V terms the divergence of two sources is V times the value for a term that neither has, plus what each
   source's own terms add, which depends on its counts alone and is summed over its distinct counts, plus what terms of both add. Only
   the last needs terms with more than one source; tasks sum it per pair of sources, and no pair of a term is ever a row.

What is as large as the output, sources times sources of a language, is the only table of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from masklake.llm.common import bound_batches, byte_classes, pieces
from masklake.session import discard, materialize

LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
PIECE_BYTES = 4 << 20
HELD_ROWS = 1_500_000
PAIR_ROWS = 1 << 21
SALTS = 16
#: Terms are runs of ASCII letters and anything beyond ASCII, A-Z in lower case.
LETTERS = byte_classes(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(multiplicities: lang, digest, source, copies; texts: lang, digest, text), null read as empty."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("copies"))
    return copies, rows.select("lang", "digest", "text").where("text != ''").dropDuplicates(["lang", "digest"])


def terms_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the terms of all texts in order, bounds): text r has those from bounds[r] up to bounds[r + 1]."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    mapped = LETTERS[raw]
    inside = mapped != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = (off - off[0])[1:-1]
    edge = edge[edge < len(raw)]
    begin[edge] = inside[edge]
    place = np.concatenate([[0], np.cumsum(inside)])
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, off - off[0])
    bounds = np.append(place[starts], place[-1]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(mapped[inside].tobytes()))
    return words.dictionary_encode(), first


def _added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values)


def _stretches(weights: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose weights sum to at most PAIR_ROWS, or hold one entry."""
    reach, a = np.concatenate([[0], np.cumsum(weights)]), 0
    while a < len(weights):
        z = max(a + 1, int(np.searchsorted(reach, reach[a] + PAIR_ROWS, "right")) - 1)
        yield a, z
        a = z


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts and document counts of texts with multiplicities, added up inside the task."""

    def combined(tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return table.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(_COUNTED.names).cast(_COUNTED)

    held: list[pa.Table] = []
    size = 0
    for batch in pieces(batches, "text", PIECE_BYTES):
        coded, first = terms_of(batch.column("text"))
        words = len(coded.dictionary)
        if not words:
            continue
        row = np.repeat(np.arange(len(batch)), np.diff(first))
        key, tf = _added(row * words + coded.indices.to_numpy(zero_copy_only=False), np.ones(len(row), np.int64))
        row, code = key // words, key % words
        shares = batch.column("sources")
        each = np.diff(np.asarray(shares.offsets))
        share = shares.flatten()
        groups = pc.struct_field(share, "source").dictionary_encode()
        langs = batch.column("lang").dictionary_encode()
        low, many = np.cumsum(each) - each, each[row]
        lang, number, copies = langs.indices.to_numpy().astype(np.int64), groups.indices.to_numpy(), pc.struct_field(share, "copies").to_numpy()
        for a, z in _stretches(many):
            reach = many[a:z]
            entry = np.repeat(low[row[a:z]] - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
            group = np.repeat(lang[row[a:z]], reach) * len(groups.dictionary) + number[entry]
            key, n, docs = _added(group * words + np.repeat(code[a:z], reach), np.repeat(tf[a:z], reach) * copies[entry], copies[entry])
            group, term = key // words, key % words
            held.append(pa.table([langs.dictionary.take(pa.array(group // len(groups.dictionary))), groups.dictionary.take(pa.array(group % len(groups.dictionary))),
                                  coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(docs)], schema=_COUNTED))
            size += len(key)
        if size > HELD_ROWS:
            held = [combined(held)]
            size = len(held[0])
            if size > HELD_ROWS // 2:
                yield from held[0].to_batches(max_chunksize=100_000)
                held, size = [], 0
    if held:
        yield from combined(held).to_batches(max_chunksize=100_000)


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups: lang, source; terms: lang, term, n (of the language), counts (array of source, n)) for the kept terms; written tables."""
    bound_batches(docs.sparkSession, PIECE_BYTES)
    copies, texts = _texts(docs)
    copies = materialize(copies, "text-copies")
    shares = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "copies")).alias("sources"))  # an entry for each source at most
    counted = texts.join(shares, ["lang", "digest"]).select("lang", "text", "sources").mapInArrow(
        _count, "lang string, source string, term string, n bigint, docs bigint")
    each = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    terms = materialize(terms.where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    groups = materialize(copies.select("lang", "source").distinct(), "term-groups")
    discard(copies)
    return groups, terms


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exactly, for totals below 2 ** 53: long division by three digits at a time."""
    out = F.when(count + 1 >= total, 1).otherwise(0).cast("bigint")  # a count is below the total
    rest = count + 1 - out * total
    for _ in range(3):
        digit = F.call_function("div", rest * 1000, total)
        out, rest = out * 1000 + digit, rest * 1000 - digit * total
    return out + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q), exactly; both are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b, value: what terms that both sources have add, beyond what each of them adds alone, summed over a stretch of terms."""
    f = lambda p, q: (p - q) * (p - q) // q
    for batch in batches:
        entries = batch.column("entries")
        size = np.diff(np.asarray(entries.offsets)).astype(np.int64)
        flat = entries.flatten()
        p, zero = (pc.struct_field(flat, c).to_numpy() for c in ("p", "zero"))
        groups, langs = pc.struct_field(flat, "source").dictionary_encode(), batch.column("lang").dictionary_encode()
        number, lang = groups.indices.to_numpy().astype(np.int64), langs.indices.to_numpy().astype(np.int64)
        begin, k = np.cumsum(size) - size, len(groups.dictionary)
        # an entry meets the others of its term; stretches of entries bound the memory
        partner = np.repeat(size, size)
        for a, z in _stretches(partner):
            x = np.repeat(np.arange(a, z), partner[a:z])
            term = np.repeat(np.repeat(np.arange(len(size)), size)[a:z], partner[a:z])
            y = begin[term] + np.arange(len(x)) - (np.cumsum(partner[a:z]) - partner[a:z])[x - a]
            keep = x != y
            x, y, term = x[keep], y[keep], term[keep]
            both = f(p[x], p[y]) - f(p[x], zero[y]) - f(zero[x], p[y]) + f(zero[x], zero[y])
            key, value = _added((lang[term] * k + number[x]) * k + number[y], both)
            yield pa.record_batch({"lang": langs.dictionary.take(pa.array(key // k // k)).cast(pa.string()), "a": groups.dictionary.take(pa.array(key // k % k)).cast(pa.string()),
                                   "b": groups.dictionary.take(pa.array(key % k)).cast(pa.string()), "value": pa.array(value)})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: all other sources of the language by divergence; part `term`: the `top` terms
    by which a source exceeds its language. Ranks go from 1 by value, descending, then item by its bytes.

    Null text, lang and source are read as ''; a text without terms adds nothing, but its source is a group. Repeated rows count as documents of
    their own. A language without kept terms gives pairs of value 0; one with a single source gives no pair. Very long terms are terms.
    An empty table gives an empty result. doc_id and other columns are not read.
    """
    groups, terms = term_counts(docs, least_docs)
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    counts = terms.select("lang", "term", "n", F.explode("counts").alias("c")).select("lang", "term", F.col("n").alias("all"), "c.source", "c.n")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    totals = groups.join(sums, ["lang", "source"], "left").join(kept.select("lang", "v"), "lang", "left").select(
        "lang", "source", F.coalesce("v", zero).alias("v"), (F.coalesce("total", zero) + F.coalesce("v", zero)).alias("base"))
    totals = materialize(totals.withColumn("zero", F.when(F.col("v") > 0, share(zero, F.col("base")))), "group-totals")

    # what a group's own terms add against another group, by distinct counts; copies of the small table spread a large language
    salt = F.pmod(F.xxhash64("source", "n"), F.lit(SALTS))
    distinct = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).withColumn("salt", salt)
    own = distinct.join(totals.drop("v"), ["lang", "source"]).select("lang", "source", "m", "salt", share(F.col("n"), F.col("base")).alias("p"), F.col("zero").alias("own_zero"))
    others = totals.select("lang", F.col("source").alias("other"), F.col("zero").alias("q"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(SALTS)])).alias("salt"))
    met = own.join(others, ["lang", "salt"]).where("source != other")
    alone = met.groupBy("lang", "source", "other").agg(
        F.sum(F.col("m") * (excess(F.col("p"), F.col("q")) - excess(F.col("own_zero"), F.col("q")))).alias("as_p"),
        F.sum(F.col("m") * (excess(F.col("q"), F.col("p")) - excess(F.col("q"), F.col("own_zero")))).alias("as_q"))
    alone = materialize(alone, "alone")
    placed = counts.join(totals.select("lang", "source", "base", "zero"), ["lang", "source"])
    placed = placed.join(kept.select("lang", (F.col("total") + F.col("v")).alias("lang_base")), "lang").select(
        "lang", "source", "term", share(F.col("n"), F.col("base")).alias("p"), "zero", share(F.col("all"), F.col("lang_base")).alias("q"))
    placed = materialize(placed, "term-shares")
    entries = placed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("entries")).where(F.size("entries") > 1)
    both = entries.select("lang", "entries").mapInArrow(_both, "lang string, a string, b string, value bigint")
    both = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("both"))
    pairs = totals.select("lang", F.col("source").alias("a"), "v", F.col("zero").alias("p0")).join(
        totals.select("lang", F.col("source").alias("b"), F.col("zero").alias("q0")), "lang").where("a != b")
    pairs = pairs.join(alone.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), "as_p"), ["lang", "a", "b"], "left")
    pairs = pairs.join(alone.select("lang", F.col("source").alias("b"), F.col("other").alias("a"), "as_q"), ["lang", "a", "b"], "left")
    pairs = pairs.join(both, ["lang", "a", "b"], "left")
    value = F.when(F.col("v") > 0, F.col("v") * excess(F.col("p0"), F.col("q0"))).otherwise(zero)
    for part in ("as_p", "as_q", "both"):
        value = value + F.coalesce(part, zero)
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
    above = placed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(above.withColumn("rank", rank).where(F.col("rank") <= top))
