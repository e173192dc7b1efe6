"""How far the sources of a language differ in their words, over wide term vectors.

1. Terms are counted for each language and source, task by task, before they are shuffled.
2. Terms in at least ``min_docs`` documents of a language are kept; each is one row with an
   array of its counts, one place for each source of the language.
3. Higher-order functions turn counts into smoothed shares and pairs of sources into absolute
   differences, row by row; partial sums by pair are made in each task, so what is shuffled is
   pairs times tasks, not pairs times terms.
4. Each source's terms are ranked against the language's share; only each task's best go on.

All numbers are whole: a share is 1 + floor(10^9 * (count + 5) / (N + 5 V)).  A language with
most of the documents is dealt by term, never by language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm import _io
from factloom.llm._text import _FOLD, as_strings, chunks

MIN_DOCS = 30
TOP = 50
SPREAD = 64
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def terms_of(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of some rows (runs of ASCII letters and non-ASCII characters, A-Z lower-cased) and each one's row."""
    letter = _LETTER[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    begins[first] = letter[first]
    starts = np.flatnonzero(begins)
    kept = np.cumsum(letter)
    edges = np.concatenate((kept[starts] - 1, kept[-1:] if len(kept) else [0])).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(_FOLD[data[letter]].tobytes()))
    return words, np.searchsorted(off, starts, "right") - 1


def _counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it), in parts of each task."""

    def count(batches):
        for b in batches:
            langs, sources = (as_strings(b.column(k)) for k in (0, 1))
            lang, source = (pc.dictionary_encode(c).indices.to_numpy().astype(np.int64) for c in (langs, sources))
            _, one, group = np.unique(lang * (b.num_rows + 1) + source, return_index=True, return_inverse=True)  # one: a row of each group
            for i, _, data, off in chunks(as_strings(b.column(2))):
                words, row = terms_of(data, off)
                if not len(words):
                    continue
                coded = pc.dictionary_encode(words)
                code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                pair, n = np.unique(row * size + code, return_counts=True)  # row and term
                key, at = np.unique(group[i + pair // size] * size + pair % size, return_inverse=True)  # group and term
                g = pa.array(one[key // size])
                yield pa.RecordBatch.from_arrays(
                    [langs.take(g), sources.take(g), coded.dictionary.take(pa.array(key % size)), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(np.bincount(at).astype(np.int64))],
                    names=["lang", "source", "term", "n", "docs"],
                )

    parts = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / total), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * wide(count + 5), wide(total))


def _vectors(counts: DataFrame, groups: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, n: each kept term with its counts in all sources of its language, by their places."""
    sizes = groups.groupBy("lang").agg(F.count("*").cast("int").alias("width"))
    placed = counts.join(groups.select("lang", "source", "place"), ["lang", "source"])
    terms = placed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("own")).filter(F.col("docs") >= min_docs)
    # a language's sources, dealt by term: one row of the small side for each language and salt
    rows = terms.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SPREAD)))
    wide = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.col("own")[i], F.lit(0).cast("long")))
    return rows.join(_salted(sizes), ["lang", "salt"]).select("lang", "term", wide.alias("n"))


def _salted(languages: DataFrame) -> DataFrame:
    return languages.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others.

    Part ``pair``: each other source of the language, by the sum over all kept terms of the
    absolute difference of the two shares.  Part ``term``: the kept terms that the source has
    and whose share is above the language's, by the difference; the first ``top`` of them.
    Ranks are from 1, by value descending, then by item in UTF-8 order.

    Null texts, languages and sources count as empty; every language and source that occurs is
    a group, also without terms.  Rows that repeat count each; identifiers and other columns
    are not read; an empty table gives an empty result.  The width of a row is the number of
    the language's sources.
    """
    none = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), none).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    groups = rows.select("lang", "source").distinct().withColumn("place", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))
    groups = _io.stored(groups, "groups")
    vectors = _io.stored(_vectors(_counts(rows), groups, min_docs), "term-vectors")
    sums = vectors.select("lang", F.posexplode("n").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("N"), F.count("*").alias("V"))
    zero = F.lit(0).cast("long")
    bases = groups.join(sums, ["lang", "place"], "left").select("lang", "place", (F.coalesce("N", zero) + 5 * F.coalesce("V", zero)).alias("base"), F.coalesce("N", zero).alias("N"), F.coalesce("V", zero).alias("V"))
    bases = bases.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "base"))), lambda s: s["base"]).alias("bases"), (F.sum("N") + 5 * F.max("V")).alias("all"), F.count("*").cast("int").alias("width"))
    bases = _io.stored(bases, "bases")  # one row a language
    dealt = vectors.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SPREAD))).join(_salted(bases), ["lang", "salt"])
    shares = dealt.select("lang", "term", "n", F.zip_with("n", "bases", share).alias("p"), share(F.aggregate("n", zero, lambda a, x: a + x), F.col("all")).alias("q"))
    shares = _io.stored(shares, "shares")
    # a row of zeros for each language gives every pair a sum, also without kept terms
    level = shares.select("lang", "p").unionByName(bases.select("lang", F.array_repeat(zero, F.col("width")).alias("p")))
    left = level.select("lang", "p", F.posexplode("p").alias("a", "own"))
    far = F.transform(F.slice("p", F.col("a") + 2, F.size("p")), lambda x: F.abs(x - F.col("own")))
    sums = left.select("lang", "a", F.posexplode(far).alias("k", "f")).groupBy("lang", "a", "k").agg(F.sum("f").alias("value"))
    sums = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("place"), (F.col("a") + F.col("k") + 1).alias("other")), F.struct((F.col("a") + F.col("k") + 1).alias("place"), F.col("a").alias("other")))).alias("e")).select("lang", "value", "e.*")
    names = groups.select("lang", F.col("place").alias("other"), F.col("source").alias("item"))
    order = Window.partitionBy("lang", "place").orderBy(F.desc("value"), "item")
    pairs = sums.join(names, ["lang", "other"]).select("lang", "place", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    each = shares.select("lang", "term", "q", F.explode(F.transform(F.arrays_zip("n", "p"), lambda x, i: F.struct(i.alias("place"), x["n"].alias("n"), x["p"].alias("p")))).alias("e"))
    above = each.filter("e.n > 0 and e.p > q").select("lang", F.col("e.place").alias("place"), F.col("term").alias("item"), (F.col("e.p") - F.col("q")).alias("value"))
    best = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    found = pairs.unionByName(best.select("lang", "place", F.lit("term").alias("part"), "item", "value", "rank"))
    return found.join(groups, ["lang", "place"]).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
